"""Small frozen artifacts: strict JSON, pinned files, snapshots of table folders with manifests, models by their hash, and
claims about JSON documents with their evaluation. All of it runs in the driver over files of bounded size."""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import os
import re
import shutil
import string
import tempfile
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import SparkSession

from evidara.sources.sinks import publish


def strict(raw: bytes, most: int = 10_000_000) -> Any:
    """JSON without repeated keys, and without NaN or infinities."""
    if len(raw) > most:
        raise ValueError("the document is too large")

    def pairs(items: list[tuple[str, Any]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("a key is repeated")
        return dict(items)

    def refuse(text: str) -> None:
        raise ValueError(f"{text} is no JSON number")

    return json.loads(raw, object_pairs_hook=pairs, parse_constant=refuse)


def canonical(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def file_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def pinned(path: str, sha256: str, most: int = 4_000_000, expanded: int = 10_000_000) -> Any:
    """A gzipped JSON document with a known hash, within bounds of size."""
    if os.path.getsize(path) > most or file_hash(path) != sha256:
        raise ValueError("the artifact is not the one that was pinned")
    with gzip.open(path) as f:
        raw = f.read(expanded + 1)
    return strict(raw, expanded)


def folder_manifest(path: str) -> dict[str, str]:
    """relative name -> SHA-256 of every file below a folder, but for hidden ones and checksums of the writer."""
    out = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if not name.startswith((".", "_")):
                at = os.path.join(folder, name)
                out[os.path.relpath(at, path)] = file_hash(at)
    return out


def guard(source: str, target: str) -> None:
    """An output may not lie in its source, nor replace it."""
    a, b = os.path.realpath(source), os.path.realpath(target)
    if a == b or b.startswith(a + os.sep) or a.startswith(b + os.sep):
        raise ValueError("the output would change its source")


class Snapshot:
    """A frozen view of a folder of Parquet tables, for reading only: files that appear later are not seen, and a table
    whose files changed or went is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = {t[: -len(".parquet")]: sorted(os.path.join(path, t, n) for n in os.listdir(os.path.join(path, t)) if n.endswith(".parquet")) if os.path.isdir(os.path.join(path, t)) else [os.path.join(path, t)] for t in os.listdir(path) if t.endswith(".parquet")}
        self.stamps = {f: (os.path.getsize(f), os.stat(f).st_mtime_ns) for own in self.files.values() for f in own}

    def table(self, name: str):
        for f in self.files[name]:
            if not os.path.exists(f) or (os.path.getsize(f), os.stat(f).st_mtime_ns) != self.stamps[f]:
                raise RuntimeError(f"{f} changed since the snapshot")
        return self.spark.read.parquet(*self.files[name])


def archive(source: str, target: str, tables: tuple[str, ...], config: dict, most_bytes: int = 1 << 34, most_archives: int = 100) -> dict:
    """Copies a folder of tables to target/<time>, with a manifest of hashes; the folder may hold nothing but the tables. The
    copy is checked, put in place at once, and counted against the budget of bytes and archives."""
    guard(source, target)
    names = {n for n in os.listdir(source) if not n.startswith((".", "_"))}
    if names - {f"{t}.parquet" for t in tables}:
        raise ValueError(f"unknown tables: {sorted(names - {f'{t}.parquet' for t in tables})}")
    os.makedirs(target, exist_ok=True)
    have = [os.path.join(target, n) for n in os.listdir(target) if os.path.exists(os.path.join(target, n, "manifest.json"))]
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)
    if len(have) >= most_archives or sum(map(size, have)) + size(source) > most_bytes:
        raise RuntimeError("the archive's budget is used up")
    before = folder_manifest(source)
    work = tempfile.mkdtemp(dir=target, prefix=".work-")
    try:
        for name in sorted(names):
            copy = shutil.copytree if os.path.isdir(os.path.join(source, name)) else shutil.copy2
            copy(os.path.join(source, name), os.path.join(work, name))
        if folder_manifest(source) != before or folder_manifest(work) != before:
            raise RuntimeError("the source changed while it was copied")
        at = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ")
        document = {"schema_version": 1, "created_at": at, "files": before, "config": config, "bytes": size(work)}
        publish(os.path.join(work, "manifest.json"), document)
        os.replace(work, os.path.join(target, at))
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise
    return document | {"path": os.path.join(target, at)}


def archive_status(path: str, run: Callable[[], dict]) -> dict:
    """Runs an archiving job and publishes its outcome; after an error the last success stays in the status."""
    try:
        with open(path, encoding="utf-8") as f:
            last = json.load(f).get("last_success")
    except (OSError, ValueError):
        last = None
    try:
        found = run()
        status = {"state": "ok", "last_success": {k: found[k] for k in ("created_at", "bytes")}, "error": None}
    except Exception as error:  # the status says so
        status = {"state": "error", "last_success": last, "error": type(error).__name__}
    publish(path, status)
    return status


def model_by_hash(model, folder: str) -> str:
    """Saves a fitted pipeline under the SHA-256 of its files, once; its name."""
    work = tempfile.mkdtemp(prefix="model-", dir=folder)
    model.write().overwrite().save(work)
    name = hashlib.sha256(canonical({k: v for k, v in folder_manifest(work).items() if not k.endswith(".crc")})).hexdigest()
    target = os.path.join(folder, name)
    if os.path.exists(target):
        shutil.rmtree(work)
    else:
        os.replace(work, target)
    return name


def run_metadata(settings: dict, feature_names: tuple[str, ...], artifact: str | None = None, revision: str | None = None) -> dict:
    """What a prediction run records of how it came about; what isn't known is null."""
    return {"origin": "recorded_run", "settings": settings, "feature_names": list(feature_names), "feature_version": hashlib.sha256(canonical(list(feature_names))).hexdigest()[:16], "artifact_sha256": artifact, "revision": revision}


WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
MONTHS = "January February March April May June July August September October November December".split()


def pointer(document: Any, path: str) -> Any:
    """The value at a JSON pointer; an error if it isn't there."""
    if path and not path.startswith("/"):
        raise ValueError(f"{path!r} is no pointer")
    for part in path.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        if isinstance(document, list):
            if not re.fullmatch(r"0|[1-9][0-9]*", key) or int(key) >= len(document):
                raise ValueError(f"nothing at {path}")
            document = document[int(key)]
        elif isinstance(document, dict) and key in document:
            document = document[key]
        else:
            raise ValueError(f"nothing at {path}")
    return document


def leaves(document: Any, at: str = "") -> dict[str, Any]:
    """pointer -> value of every leaf."""
    if isinstance(document, (dict, list)) and document:
        items = document.items() if isinstance(document, dict) else enumerate(document)
        return {k: v for key, value in items for k, v in leaves(value, f"{at}/{str(key).replace('~', '~0').replace('/', '~1')}").items()}
    return {at: document}


def _number(value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{value!r} is no finite number")
    return value


def _shown(template: str, values: dict[str, Any]) -> str:
    out, used = [], set()
    for text, name, spec, conversion in string.Formatter().parse(template):
        out.append(text)
        if name is None:
            continue
        if name not in values or conversion:
            raise ValueError(f"{name!r} is no plain name of a value")
        used.add(name)
        if spec in ("words", "Words"):
            if type(values[name]) is not int or not 0 <= values[name] < len(WORDS):
                raise ValueError("only counts up to twenty have words")
            out.append(WORDS[values[name]].capitalize() if spec == "Words" else WORDS[values[name]])
        elif spec in ("", ",", ".2%", ".1f", ".2f"):
            out.append(format(values[name], spec))
        else:
            raise ValueError(f"unknown format {spec!r}")
    if used != set(values):
        raise ValueError("a value is not used")
    return "".join(out)


def _numbers(value: Any, least: int = 0) -> list[float]:
    if not isinstance(value, list) or len(value) < least:
        raise ValueError("a list of numbers is needed")
    return [_number(v) for v in value]


def _size(value: Any) -> int:
    if not isinstance(value, (list, dict)):
        raise ValueError("only lists and objects have a length")
    return len(value)


def _rows(value: Any, fields: set[str]) -> list[dict]:
    rows = list(value.values()) if isinstance(value, dict) else value
    if not isinstance(rows, list) or not all(isinstance(r, dict) and fields <= r.keys() for r in rows):
        raise ValueError(f"rows with {sorted(fields)} are needed")
    return rows


def _chosen(value: Any, where: dict[str, Any]) -> list[dict]:
    if not where or not isinstance(value, list):
        raise ValueError("a list and conditions are needed")
    alike = lambda a, b: type(a) is type(b) and a == b
    return [r for r in _rows(value, set(where)) if all(alike(r[k], v) for k, v in where.items())]


def _share(top: Any, bottom: Any) -> float:
    if _number(bottom) <= 0:
        raise ValueError("a ratio needs a positive denominator")
    return _number(top) / bottom


def _part(text: str, part: str) -> int | str:
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("a date needs a zone")
    at = at.astimezone(UTC)
    return {"year": at.year, "month_name": MONTHS[at.month - 1]}[part]


def _singles(values: list) -> int:
    if not values or any(len(_numbers(v)) != 1 for v in values):
        raise ValueError("a series has not exactly one value")
    return len(values)


#: For each operation its arguments that are expressions (one, a list or an object of them), its plain ones, and its meaning.
OPERATIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...], Callable]] = {
    "len": (("value",), (), _size),
    "sum": (("value",), (), lambda v: sum(_numbers(v))),
    "max": (("value",), (), lambda v: max(_numbers(v, 1))),
    "pluck": (("value",), ("field",), lambda v, field: [r[field] for r in _rows(v, {field})]),
    "filter": (("value", "where"), (), _chosen),
    "ratio": (("numerator", "denominator"), (), _share),
    "date_part": (("value",), ("part",), _part),
    "constant_series_count": (("values",), (), _singles),
    "format": (("values",), ("template",), lambda values, template: _shown(template, values)),
}


def evaluate(node: Any, artifacts: dict[str, Any], depth: int = 20) -> Any:
    """The value of a claim's expression: {"literal": v}, {"artifact": name, "pointer": p}, or {"op": name, arguments}."""
    if depth < 0 or not isinstance(node, dict):
        raise ValueError("no expression, or one too deep")
    match node:
        case {"literal": value, **rest} if not rest:
            return value
        case {"artifact": name, "pointer": path, **rest} if not rest:
            if name not in artifacts:
                raise ValueError(f"unknown artifact {name!r}")
            return pointer(artifacts[name], path)
    inner, plain, meaning = OPERATIONS.get(node.get("op", ""), ((), (), None))
    if meaning is None or set(node) != {"op", *inner, *plain}:
        raise ValueError(f"unknown expression {node.get('op')!r}")

    def value_of(name: str) -> Any:
        got = node[name]
        if name == "values" and isinstance(got, list):
            return [evaluate(x, artifacts, depth - 1) for x in got]
        if name in ("where", "values"):
            return {k: evaluate(x, artifacts, depth - 1) for k, x in got.items()}
        return evaluate(got, artifacts, depth - 1)

    return meaning(*(value_of(n) for n in inner), *(node[n] for n in plain))


def checked_claims(claims: list[dict], artifacts: dict[str, Any], pins: dict[str, str] | None = None, raw: dict[str, bytes] | None = None, tolerance: float = 1e-10) -> list[str]:
    """What is wrong with claims [{id, value, expression}] about artifacts: hashes that differ, ids that repeat, values that the
    artifacts don't give. None: all hold."""
    wrong = [f"{name}: hash" for name, sha in (pins or {}).items() if hashlib.sha256((raw or {}).get(name, b"")).hexdigest() != sha]
    seen: set[str] = set()
    for claim in claims:
        if claim["id"] in seen:
            wrong.append(f"{claim['id']}: repeated")
        seen.add(claim["id"])
        try:
            value = evaluate(claim["expression"], artifacts)
        except (ValueError, TypeError, KeyError) as error:
            wrong.append(f"{claim['id']}: {error}")
            continue
        numbers = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (value, claim["value"]))
        if not (math.isclose(value, claim["value"], rel_tol=0, abs_tol=tolerance) if numbers else type(value) is type(claim["value"]) and value == claim["value"]):
            wrong.append(f"{claim['id']}: {value!r} is not {claim['value']!r}")
    return wrong


def uncovered(claims: list[dict], artifact: str, document: Any) -> list[str]:
    """Pointers of numeric leaves of a document that no claim's expression reads."""
    read: set[str] = set()

    def walk(node: Any) -> None:
        if isinstance(node, dict):
            if node.get("artifact") == artifact:
                read.add(node["pointer"])
            for v in node.values():
                walk(v)
        elif isinstance(node, list):
            for v in node:
                walk(v)

    for claim in claims:
        walk(claim["expression"])
    return [p for p, v in leaves(document).items() if isinstance(v, (int, float)) and not isinstance(v, bool) and not any(p == r or p.startswith(r + "/") for r in read)]
