"""Personal data by candidate gradient boosting.

Fixed patterns give the base spans, which always stay. High-recall generators propose further, overlapping spans (spelled
out addresses, national phone numbers, identity and account numbers, IPv6, keys); boosted trees score each from its format
and its context, calibrated, and those above their kind's threshold are selected, best first, without overlap. As no
table has labels for these, the trees are trained on formats written into contexts by a fixed rule.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.boosting import Boosted, fit
from evidara.llm.common import column, in_arrow
from evidara.llm.token_counts import texts_of

Span = tuple[str, int, int]
#: In order of listing; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "identity", "account", "secret")
RANK = {k: i for i, k in enumerate(KINDS)}
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A failed start fails for every later digit of its run as well, so looking behind changes no match.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")

#: Generators: (kind, pattern, texts each of which must be there for a match; a digit must be for the pattern None).
GENERATORS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]++(?:(?:\s*+[\[({]\s*+dot\s*+[\])}]\s*+|\s++dot\s++)[\w+-]++){0,2}(?:\s*+[\[({]\s*+at\s*+[\])}]\s*+|\s++at\s++)[\w-]++(?:(?:\s*+[\[({]\s*+dot\s*+[\])}]\s*+|\s++dot\s++|\.)[\w-]{2,}+){1,4}", re.I), ("at",)),
    ("phone", re.compile(r"(?<![\w.,+-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]?[0-9]{2,5}[ ./-][0-9]{2,6}(?:[ ./-][0-9]{2,6}){0,3}(?![\w-])"), None),
    ("phone", re.compile(r"(?<![\w.,+-])0[0-9]{2,4}[ ./-][0-9]{5,8}(?![\w-])"), None),
    ("identity", re.compile(r"(?<![\w-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![\w-])"), None),
    ("account", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), None),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?![\w:])"), None),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])"), None),
    ("secret", re.compile(r"(?<![\w/+=-])[A-Za-z0-9_/+-]{16,}+={0,2}(?![\w/+=-])"), None),
    ("secret", re.compile(r"(?<=[=:\"'])[^\s\"'=:]{8,}+(?=[\"'\s]|$)"), None),
    ("secret", re.compile(r"(?<=[=:] )[^\s\"'=:,;]{8,}+(?=[\"'\s,;]|$)"), None),
)
#: Endings of addresses that are spelled out (fixed values).
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl")
#: Context words by group (fixed values).
CUES = (
    ("tel", "phone", "call", "mobile", "fax", "cell", "whatsapp", "contact"), ("ssn", "social", "security", "identity", "passport"), ("iban", "account", "bank", "konto", "cuenta", "compte"),
    ("key", "token", "secret", "pass", "pwd", "auth", "bearer", "credential"), ("ip", "host", "server", "address", "addr"), ("mail", "write", "reach", "email"),
    ("order", "invoice", "isbn", "version", "page", "no.", "ref", "part", "sku", "commit", "hash", "sha", "md5", "build", "date", "year", "since", "from", "to"), ("$", "€", "£", "usd", "eur", "price", "cost", "total"),
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _ascii_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that hold its condition, by start and kind. Linear in the text."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = _ascii_digits(m[0]) if m.end() - m.start() < 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if m.end() - m.start() > 4096:
                digits = sum(c.isdigit() for c in m[0])
            else:
                digits = len(_ascii_digits(m[0]))
            if 9 <= digits <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], RANK[s[0]]))


def candidates(text: str) -> list[Span]:
    """The spans that the generators propose. What is skipped holds no match: secrets have a digit, and addresses an "at"."""
    digit, low = bool(DIGIT.search(text)), None
    out: list[Span] = []
    for kind, pattern, need in GENERATORS:
        if need is None:
            if not digit:
                continue
        else:
            low = text.lower() if low is None else low
            if not all(x in low for x in need):
                continue
        out += [(kind, *m.span()) for m in pattern.finditer(text) if kind != "secret" or _mixed(m[0])]
    return list(dict.fromkeys(out))


def _mixed(token: str) -> bool:
    return bool(DIGIT.search(token)) and any(c.isalpha() for c in token)


def _numbers(text: str, span: Span) -> list[float]:
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 32) : start].lower(), text[end : end + 12].lower()
    digits = _ascii_digits(body)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)]
    n = len(body)
    counts = {c: body.count(c) for c in set(body)}
    entropy = -sum(v / n * np.log2(v / n) for v in counts.values())
    upper, lower = sum(c.isupper() for c in body), sum(c.islower() for c in body)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(body[:-1], body[1:], strict=True))
    # Whether a date or time: two or three groups, each in range.
    values = [int(g) if len(g) < 5 else 10**4 for g in re.findall(r"[0-9]+", body)]
    date = float(len(values) == 3 and any(1900 <= v <= 2100 for v in values) and sum(v <= 31 for v in values) >= 2)
    mod97 = 0.0
    if kind == "account":
        packed = body.replace(" ", "")
        mod97 = float(int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1)
    return [
        *(float(kind == k) for k in KINDS), n, len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0, float(luhn(digits)) if 8 <= len(digits) <= 19 else 0.5,
        body.count(" "), body.count("-"), body.count("."), body.count("/"), body.count(":"), float("(" in body), float("at" in body.lower()), entropy, upper / n, lower / n, changes / n, date, mod97,
        float(body.startswith("AKIA")), float(all(c in "0123456789abcdefABCDEF" for c in body)), float(bool(re.match(r"\s*[=:]|[\"']", before[-1:] or " "))), float(after[:1].isalnum()),
        float(body.lower().endswith(ENDINGS)), float(body.lstrip("(")[:1] == "0"), body.count("::"), float(bool(re.search(r"[=:][ \"']?$", before))),
        *(float(any(re.search(rf"(?<![a-z]){re.escape(w)}", before) if w[0].isalpha() else w in before[-3:] for w in own)) for own in CUES),
    ]


@dataclass
class Model:
    trees: Boosted
    thresholds: dict[str, float]


def _examples(n: int, seed: int = 7) -> list[tuple[str, Span, int]]:
    """Texts with a candidate span and whether it is personal, by a fixed rule."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(of) for _ in range(k))
    word = lambda: letters(r.randint(2, 9))

    def iban(valid: bool) -> str:
        land, rest = letters(2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), digits(r.choice((12, 14, 16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
        body = f"{land}{check if valid else (check + r.randint(1, 90)) % 97:02d}{rest}"
        return " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if r.random() < 0.5 else body

    kinds: list[tuple[str, int, object]] = [
        ("email", 1, lambda: f"{word()}{r.choice(('.', ''))}{word()} {r.choice(('[at]', '(at)', 'at'))} {word()} {r.choice(('[dot]', '(dot)', 'dot'))} {r.choice(('com', 'org', 'net', 'de'))}"),
        ("email", 1, lambda: f"{word()}{r.choice(('.', ''))}{word()} {r.choice(('[at]', '(at)', '{at}'))} {word()}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io'))}"),
        ("email", 1, lambda: f"{word()} dot {word()} at {word()} dot {r.choice(ENDINGS)}"), ("email", 0, lambda: f"{word()} at {word()}.{word()}x"), ("email", 0, lambda: f"{word()} at {word()} dot {word()}x"),
        ("phone", 1, lambda: f"0{digits(r.randint(2, 4))}{r.choice(' -/')}{digits(r.randint(5, 8))}"), ("phone", 0, lambda: f"0{digits(r.randint(2, 4))}.{digits(r.randint(5, 8))}"),
        ("ip", 1, lambda: f"{r.choice(('fe80', 'fd' + letters(2, '0123456789abcdef'), '2001:db8', '2a0' + digits(1)))}::{':'.join(letters(r.randint(1, 4), '0123456789abcdef') for _ in range(r.randint(1, 4)))}"), ("ip", 0, lambda: f"{letters(r.randint(1, 3), 'abcdef')}::{letters(r.randint(1, 4), 'abcdef')}"),
        ("phone", 1, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", 1, lambda: f"0{digits(r.randint(2, 3))}{r.choice(' -/')}{digits(r.randint(3, 4))}{r.choice(' -')}{digits(r.randint(3, 4))}"), ("phone", 1, lambda: f"{r.randint(200, 999)}-{digits(3)}-{digits(4)}"),
        ("phone", 0, lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 31):02d}"), ("phone", 0, lambda: f"{r.randint(1, 31):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2030)}"), ("phone", 0, lambda: f"{digits(2)} {digits(3)} {digits(3)}"), ("phone", 0, lambda: f"{digits(r.randint(2, 5))}-{digits(r.randint(2, 5))}"), ("phone", 0, lambda: f"978-{digits(1)}{digits(1)}-{digits(5)}-{digits(2)}"), ("phone", 0, lambda: " ".join(digits(r.randint(2, 4)) for _ in range(r.randint(3, 5)))),
        ("identity", 1, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"), ("identity", 0, lambda: f"{digits(3)} {digits(2)} {digits(4)}"),
        ("account", 1, lambda: iban(True)), ("account", 0, lambda: iban(False)), ("account", 0, lambda: letters(2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + digits(2) + letters(8, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")),
        ("ip", 1, lambda: ":".join(letters(r.randint(2, 4), "0123456789abcdef") for _ in range(8))), ("ip", 0, lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"), ("ip", 0, lambda: f"{digits(1)}:{digits(2)}:{digits(2)}:{digits(2)}"),
        ("secret", 1, lambda: "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")), ("secret", 1, lambda: "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")), ("secret", 1, lambda: letters(r.randint(16, 44), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")), ("secret", 1, lambda: letters(r.randint(16, 40), "0123456789abcdef")), ("secret", 1, lambda: letters(r.randint(8, 15), "abcdefghijklmnopqrstuvwxyz0123456789")), ("secret", 1, lambda: letters(r.randint(45, 400), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")),
        ("secret", 0, lambda: "-".join(word() for _ in range(r.randint(3, 6))) + f"-{digits(4)}"), ("secret", 0, lambda: letters(40, "0123456789abcdef")), ("secret", 0, lambda: word() + "_" + word() + "_" + word() + digits(2)), ("secret", 0, lambda: f"{digits(1)}.{digits(1)}.{digits(1)}-{word()}{digits(2)}"), ("secret", 0, lambda: letters(r.randint(2, 4)) + digits(r.randint(6, 9))), ("secret", 0, lambda: f"{word()}/{word()}/{word()}/{digits(4)}"),
    ]
    cues = {"phone": CUES[0], "identity": CUES[1], "account": CUES[2], "secret": CUES[3], "ip": CUES[4], "email": CUES[5]}
    out = []
    for i in range(n):
        kind, label, make = kinds[i % len(kinds)]
        body = make()
        cue = r.choice(cues[kind] if label or r.random() < 0.1 else (*CUES[6], *CUES[7]))
        near = r.random() < (0.75 if label else 0.6)
        if kind == "secret" and label and not body.startswith("AKIA"):
            lead = f"{word()} {r.choice(('api_', '', 'my'))}{cue}{r.choice(('=', ': ', '=' + chr(34)))}"
        elif kind == "secret" and not label:
            lead = f"{word()} {cue if near else word()}{r.choice((' ', ' ', ': '))}"
        else:
            lead = f"{word()} {word()} {cue + ' ' if near else ''}"
        text = lead + body + r.choice((" ", ". ", ", ", '" ')) + word()
        out.append((text, (kind, len(lead), len(lead) + len(body)), label))
    r.shuffle(out)
    return out


def train(n: int = 8000, precision: float = 0.98) -> Model:
    """The trees, calibrated, and for each kind the lowest threshold of at least 0.5 with that precision on held-out examples."""
    rows = _examples(n)
    x, y = np.array([_numbers(t, s) for t, s, _ in rows]), np.array([float(v) for *_, v in rows])
    cut = int(0.75 * n)
    trees = fit(x[:cut], y[:cut], trees=80, depth=4)
    score, held = trees.score(x[cut:]), y[cut:]
    thresholds = {}
    for k in KINDS:
        own = np.array([s[0] == k for _, s, _ in rows[cut:]])
        thresholds[k] = 1.1
        for t in np.linspace(0.98, 0.5, 25):
            hit = own & (score >= t)
            if hit.any() and held[hit].mean() >= precision:
                thresholds[k] = float(t)
    return Model(trees, thresholds)


def all_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, by start and kind. Spans that are added overlap neither base spans nor
    one another."""
    bases, found = [base_spans(t) for t in texts], [candidates(t) for t in texts]
    flat = [(i, s) for i, own in enumerate(found) for s in own]
    kept: dict[int, list[Span]] = {}
    if flat:
        scores = model.trees.score(np.array([_numbers(texts[i], s) for i, s in flat]))
        taken: dict[int, list[tuple[int, int]]] = {}
        for score, (i, s) in sorted(zip(scores.tolist(), flat, strict=True), key=lambda p: (p[1][0], -p[0], p[1][1][1], p[1][1][2], p[1][1][0])):
            if score >= model.thresholds[s[0]]:
                own = taken.setdefault(i, [(a, b) for _, a, b in bases[i]])
                if all(s[2] <= a or b <= s[1] for a, b in own):
                    own.append(s[1:])
                    kept.setdefault(i, []).append(s)
    return [(base, sorted(base + kept.get(i, []), key=lambda s: (s[1], RANK[s[0]]))) for i, base in enumerate(bases)]


def redacted(text: str, spans: list[Span]) -> str:
    """Each span, with what overlaps it, becomes the first one's kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card and n_phone of the base spans, base_sha256, spans (all), and text redacted.

    Spans count code points, end exclusive. A null text counts as empty for the spans and stays null when redacted; rows
    are independent, so repeated rows, null keys and empty tables do no harm; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = column(batch, "k"), column(batch, "t")
            for i, j, texts in texts_of(batch, "t"):
                rows = all_spans(texts, sent.value)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS[:4]]
                digest = pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in rows], pa.string())
                clean = pa.array([redacted(t, spans) if there else None for t, (_, spans), there in zip(texts, rows, raw.slice(i, j - i).is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), *counts, digest, pa.array([_listed(s) for _, s in rows], pa.string()), clean], names)

    names = ["k", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"]
    kind = docs.schema[key].dataType.simpleString()
    out = in_arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
    return out.withColumnRenamed("k", key)
