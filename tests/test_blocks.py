"""Markdown blocks, by hand, and their properties on random pages."""

import random

from evidara.sources import blocks


def kinds(text):
    return [(k, d, t) for k, d, _, _, t in blocks.parsed(text)]


def test_blocks_by_hand(spark):
    assert kinds("") == [] and kinds("\n \n") == []
    assert kinds("# A\ntext\nmore\n\n## B ##\n#no\n#") == [("heading", 1, "A"), ("paragraph", 0, "text more"), ("heading", 2, "B"), ("paragraph", 0, "#no"), ("heading", 1, "")]
    assert kinds("- a\n  - b\n    1. c\n  - d\n* e\n\tf") == [("item", 0, "a"), ("item", 1, "b"), ("item", 2, "c"), ("item", 1, "d"), ("item", 0, "e f")]
    assert [(k, n, t) for k, _, _, n, t in blocks.parsed("- [ ] open\n+ [X] shut\n- [y] none\n- []")] == [("task", False, "open"), ("task", True, "shut"), ("item", None, "[y] none"), ("item", None, "[]")]
    assert kinds("a | b\n--|--\n1 | 2\n3 | 4\nno") == [("header", 0, "a\tb"), ("row", 0, "1\t2"), ("row", 0, "3\t4"), ("paragraph", 0, "no")]
    assert kinds("a | b\n--|--|--\n") == [("paragraph", 0, "a | b --|--|--")]
    assert kinds("````\n```\n# x\n````\n~~~\nopen\n- y") == [("fence", 0, "```\n# x"), ("fence", 0, "open\n- y")]
    assert kinds("> a\n>b\n\n> c\n- - -\n***\n---") == [("quote", 0, "a b"), ("quote", 0, "c"), ("rule", 0, ""), ("rule", 0, ""), ("rule", 0, "")]
    assert kinds("---\ntitle: x\n---\n# T")[0] == ("front", 0, "title: x") and kinds("---\nno end")[0][0] == "rule"
    assert [line for *_, line, _, _ in blocks.parsed("a\r\n\r\n- b\r\n")] == [0, 2]
    rows = [("p", "- a\n- b", 1), ("q", None, 2), ("r", "", 3)]
    got = blocks.blocks(spark.createDataFrame(rows, "path string, content string, place int")).collect()
    assert [(r.path, r.place, r.kind, r.text) for r in sorted(got)] == [("p", 0, "item", "a"), ("p", 1, "item", "b")]


def test_no_word_is_lost_and_lines_ascend():
    r = random.Random(1)
    parts = ["# h{}", "w{}", "  w{} x", "- i{}", "  - j{}", "- [ ] t{}", "> q{}", "", "", "| c{} | d |\n|---|---|\n| r{} | s |", "```\nf{}\n```", "1. n{}"]
    for _ in range(300):
        text = "\n".join(r.choice(parts).replace("{}", str(n)) for n in range(r.randrange(30)))
        found = list(blocks.parsed(text))
        lines = [line for _, _, line, _, _ in found]
        assert lines == sorted(lines) and len(set(lines)) == len(lines) and all(d >= 0 for _, d, *_ in found)
        words = lambda t: sorted(w for w in t.replace("|", " ").split() if any(c.isdigit() for c in w) and w[-1:] != ".")
        assert words(" ".join(t for *_, t in found)) == words(text)
