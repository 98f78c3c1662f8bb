"""Verified renames: edit every site of an id, read the result again, and write only what proves to mean the same."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import markdown as md
from . import checks
from .evidence import SIGIL, markers_of
from .extract import Corpus, World, load


class Refused(ValueError):
    pass


@dataclass
class Change:
    file: str
    old: str
    new: str
    edits: int


def sites(source: str, old: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every place that names the id: definitions, one-line depends and because lists, links."""
    f, out = md.facts(source), []

    def add(at: int, kind: str) -> None:
        out.append((at, at + len(old), kind))

    for start, end, _, text in f.headings:
        if md.token_of(text, False) == old and (at := source.find(f"[{old}]", start, end)) >= 0:
            add(at + 1, "definition")
    for start, end, token in f.bolds:
        if token == old:
            add(source.find(f"[{old}]", start, end) + 1, "definition")
    for start, end, token in f.anchors:
        if token == old and (m := re.compile(rf"\sid\s*=\s*[\"']({re.escape(old)})[\"']").search(source, start, end)):
            add(m.start(1), "definition")
    for start, end, info, _ in f.fences:
        if info == "claim":
            for m in re.finditer(r"^[ >]*(depends|because)[ \t]*:[ \t]*\[([^\]\n]*)\]", source[start:end], re.M):
                for x in re.finditer(r"[^\s,\"']+", m[2]):
                    if x[0] == old:
                        add(start + m.start(2) + x.start(), m[1])
    for start, dest in f.links:
        if dest == old or dest.rpartition("#")[2] == old and "#" in dest:
            m = re.compile(rf"\]\(\s*<?({re.escape(dest)})[\s>)]").search(source, start)
            if m:
                add(m.end(1) - len(old), "link")
    return sorted(set(out))


def sites_of(files: DataFrame) -> DataFrame:
    """file, start, end, kind of every site of `old` in files (path, content, old)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *site) for path, content, old in zip(batch["path"], batch["content"], batch["old"]) for site in sites(bytes(content).decode(), old)]
            yield pd.DataFrame(rows, columns=["file", "start", "end", "kind"])

    return files.select("path", "content", "old").mapInPandas(run, "file string, start int, end int, kind string")


def totals(changes: list[Change]) -> tuple[int, int]:
    """Files and edits of a rename."""
    return len(changes), sum(c.edits for c in changes)


def edited(source: str, edits: list[tuple[int, int, str]], old: str, new: str) -> str:
    """source with each span, which must hold old and overlap no other, replaced."""
    out, at = [], 0
    for start, end, _ in edits:
        if start < at or source[start:end] != old:
            raise Refused(f"an edit at {start} does not hold {old!r}")
        out += [source[at:start], new]
        at = end
    return "".join([*out, source[at:]])


def snapshot(c: Corpus, markers: DataFrame | None = None) -> dict[str, DataFrame]:
    index = checks.index_claims(c)
    found = checks.diagnostics(c, markers).drop("sort_key")
    prose = c.claims.select("id", "file", "block_line", "prose_links", "prose_code")
    return {"index": index, "findings": found, "prose": prose}


def substituted(s: dict[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    """The snapshot that a faithful rename leaves."""
    one = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    tail = lambda x: F.when(x == old, F.lit(new)).when(x.endswith("#" + old), F.concat(x.substr(F.lit(1), F.length(x) - len(old)), F.lit(new))).otherwise(x)
    each = lambda c, f: F.transform(c, f).alias(c)
    whole = lambda x: F.when(x == old, F.lit(new)).otherwise(x)
    index = s["index"].select(one("id"), *[c for c in s["index"].columns if c not in ("id", "depends", "because")], each("depends", whole), each("because", whole))
    found = s["findings"].select("check", "severity", "file", "line", one("claim_id"), F.replace("message", F.lit(old), F.lit(new)).alias("message"))
    prose = s["prose"].select(one("id"), "file", "block_line", each("prose_links", tail), "prose_code")
    return {"index": index.select(s["index"].columns), "findings": found, "prose": prose}


def differences(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> list[str]:
    """Names of the relations that differ, counted as multisets."""
    return [k for k in a if not a[k].exceptAll(b[k]).isEmpty() or not b[k].exceptAll(a[k]).isEmpty()]


def plan_rename(files: DataFrame, config: dict, old: str, new: str, world: World | None = None, sigil: str = SIGIL) -> list[Change]:
    """The changes of a rename, or Refused; nothing is written."""
    before = load(files, config, world)
    known = lambda i: not before.claims.filter(F.col("id") == i).isEmpty()
    if not known(old):
        raise Refused(f"no claim {old!r}")
    markers = markers_of(files, sigil)
    if left := markers.filter(F.col("id") == old).collect():
        raise Refused("markers name it: " + ", ".join(f"{m.file}:{m.line}" for m in left))
    if not md.ID.fullmatch(new):
        raise Refused(f"{new!r} is no id")
    if known(new) or not before.unregistered.filter(F.col("id") == new).isEmpty():
        raise Refused(f"{new!r} exists")
    texts = before.documents.select("file").join(files, F.col("file") == F.col("path")).filter(F.col("content").cast("string").contains(old)).select("file", F.col("content").cast("string").alias("text")).orderBy("file").collect()
    changes = []
    for r in texts:
        found = sites(r.text, old)
        if found:
            changes.append(Change(r.file, r.text, edited(r.text, found, old, new), len(found)))
    spark = files.sparkSession
    overrides = spark.createDataFrame([(c.file, c.new.encode()) for c in changes], "path string, content binary")
    after = load(files.join(overrides.withColumnRenamed("content", "new"), "path", "left").select("path", F.coalesce("new", "content").alias("content")), config, world)
    if wrong := differences(substituted(snapshot(before, markers), old, new), snapshot(after, markers)):
        raise Refused("the renamed corpus would mean something else: " + ", ".join(wrong))
    return changes


def write_changes(root: str, changes: list[Change]) -> None:
    for c in changes:
        with open(os.path.join(root, c.file), "w", encoding="utf-8", newline="") as f:
            f.write(c.new)
