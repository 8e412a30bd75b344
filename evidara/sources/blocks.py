"""Markdown pages as blocks, by a table function that a query joins to its pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

BLOCKS = "place int, kind string, depth int, line int, done boolean, text string"
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
ITEM = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])(?:[ \t]+(.*))?$")
TASK = re.compile(r"\[([ xX])\][ \t]+(.+)$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
DELIMITER = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def cells(line: str) -> list[str]:
    """The cells of a table's row; a bar behind a backslash belongs to its cell."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def parsed(content: str) -> Iterator[tuple[str, int, int, bool | None, str]]:
    """(kind, depth, line, done, text) of each block, in order: front, heading (depth: its level), item and task (depth: how many
    lists it is nested in), header and row (text: its cells, joined by tabs), fence (text: its lines), quote, rule, paragraph.

    A line that opens no block goes on with the paragraph, item or quote above it. An open fence lasts to the end of the page.
    """
    lines = content.replace("\r\n", "\n").split("\n")
    at = 0
    if lines[0].rstrip() == "---" and (end := next((n for n in range(1, len(lines)) if lines[n].rstrip() == "---"), None)):
        yield "front", 0, 0, None, "\n".join(lines[1:end])
        at = end + 1
    held: list | None = None  # the block that may go on
    indents: list[int] = []  # of the lists that are open
    while at < len(lines):
        line, start = lines[at], at
        at += 1
        fence, heading, item = FENCE.match(line), HEADING.match(line), ITEM.match(line)
        table = "|" in line and at < len(lines) and "-" in lines[at] and bool(DELIMITER.match(lines[at])) and len(cells(lines[at])) == len(cells(line))
        if not line.strip():
            if held:
                yield tuple(held)
            held = None
            continue
        new = None
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            end = next((n for n in range(at, len(lines)) if close.match(lines[n])), len(lines))
            new, at = [("fence", 0, start, None, "\n".join(lines[at:end]))], end + 1
        elif heading:
            new = [("heading", len(heading[1]), start, None, (heading[2] or "").strip())]
        elif RULE.match(line) and not (item and item[2] and not set(line) <= set("-*_ \t")):
            new = [("rule", 0, start, None, "")]
        elif table and not item:
            new = [("header", 0, start, None, "\t".join(cells(line)))]
            at += 1
            while at < len(lines) and "|" in lines[at]:
                new.append(("row", 0, at, None, "\t".join(cells(lines[at]))))
                at += 1
        if new:
            if held:
                yield tuple(held)
            held, indents = None, []
            yield from new
            continue
        if item:
            if held:
                yield tuple(held)
            indent = len(item[1].expandtabs(4))
            while indents and indents[-1] > indent:
                indents.pop()
            if not indents or indents[-1] < indent:
                indents.append(indent)
            task = TASK.match(item[2] or "")
            held = ["task" if task else "item", len(indents) - 1, start, task[1] != " " if task else None, (task[2] if task else item[2] or "").strip()]
        elif line.lstrip().startswith(">"):
            text = line.lstrip()[1:].strip()
            if held and held[0] == "quote":
                held[4] = f"{held[4]} {text}".strip()
            else:
                if held:
                    yield tuple(held)
                held, indents = ["quote", 0, start, None, text], []
        elif held:
            held[4] = f"{held[4]} {line.strip()}".strip()
        else:
            indents = indents if line[:1] in " \t" else []
            held = ["paragraph", len(indents), start, None, line.strip()]
    if held:
        yield tuple(held)


class _Blocks:
    def eval(self, content: str) -> Iterator[tuple]:
        if content is not None:
            for place, block in enumerate(parsed(content)):
                yield place, *block


def blocks(pages: DataFrame) -> DataFrame:
    """pages (path, content) -> path and BLOCKS, a row for each block; a null or empty page has none."""
    spark = pages.sparkSession
    spark.udtf.register("markdown_blocks", udtf(_Blocks, returnType=BLOCKS, useArrow=True))
    return spark.sql("SELECT p.path, b.* FROM {pages} p, LATERAL markdown_blocks(p.content) b", pages=pages.select("path", "content"))
