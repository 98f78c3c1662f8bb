"""Relations of a corpus: one pass of the Markdown reader over each file, then DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import refs
from ..sources import markdown as md
from ..sources.corpus import World, in_genres
from .graph import cut

ROWS = """row string, file string, ordinal int, line int, block_line int, level int, id string, text string, slug string, yaml string,
yaml_error string, types map<string,string>, kind string, evaluator string, depends array<string>, because array<string>, strings map<string,boolean>,
axes map<string,string>, axis_types map<string,string>, prose_links array<string>, prose_code array<string>"""


class Loader(yaml.SafeLoader):
    """YAML whose only booleans are true and false, and whose keys are unique."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        for i, k in enumerate(keys):
            if k in keys[:i]:
                raise yaml.constructor.ConstructorError(None, None, f"duplicate key {k!r}", node.start_mark)
        return super().construct_mapping(node, deep)


Loader.yaml_implicit_resolvers = {c: [(t, r) for t, r in rs if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _type(x) -> str:
    return "string" if isinstance(x, str) else "list" if isinstance(x, list) else "map" if isinstance(x, dict) else "null" if x is None else "other"


def payload(text: str) -> dict:
    """What a claim block says, as columns; wrong types are named, not repaired."""
    try:
        value = yaml.load(text, Loader)
    except (yaml.YAMLError, ValueError, TypeError) as e:
        return {"yaml_error": " ".join(str(e).split())}
    if not isinstance(value, dict):
        return {}
    value = {str(k): v for k, v in value.items()}
    lists = {k: [x for x in value[k] if isinstance(x, str)] if isinstance(value.get(k), list) else [] for k in ("depends", "because")}
    axes = value.get("verification") if isinstance(value.get("verification"), dict) else {}
    axes = {str(k): v for k, v in axes.items()}
    one = lambda k: value[k] if isinstance(value.get(k), str) else None
    return {
        "types": {k: _type(v) for k, v in value.items()},
        "kind": one("kind"),
        "evaluator": one("evaluator"),
        **lists,
        "strings": {k: isinstance(value.get(k), list) and all(isinstance(x, str) for x in value[k]) for k in ("depends", "because") if k in value},
        "axes": {k: v for k, v in axes.items() if isinstance(v, str)},
        "axis_types": {k: _type(v) for k, v in axes.items()},
    }


@dataclass
class Definition:
    start: int
    form: int  # headings before bold before html at one start
    id: str
    line: int
    scope: tuple[int, int]


def definitions(f: md.Facts, source: str) -> tuple[list[Definition], list[tuple[int, str]]]:
    """Definitions in order of their starts, and malformed (offset, id)."""
    out, malformed = [], []
    starts = sorted([h[0] for h in f.headings] + [b[0] for b in f.bolds if md.ID.fullmatch(b[2])] + [a[0] for a in f.anchors if md.ID.fullmatch(a[2])])

    def section(i: int) -> tuple[int, int]:
        return f.headings[i][1], next((h[0] for h in f.headings[i + 1 :] if h[2] <= f.headings[i][2]), len(source) + 1)

    def judge(start: int, token: str, form: int, line: int, scope, empty: bool = False) -> None:
        if md.ID.fullmatch(token):
            out.append(Definition(start, form, token, line, scope))
        elif (token or empty) and not re.search(r"\s", token):
            malformed.append((start, token))

    for i, (start, _, _, text) in enumerate(f.headings):
        token = md.token_of(text, False) if text.startswith("[") and source[start:].lstrip(" #").startswith("[") else None
        if token is not None:
            judge(start, token, 0, f.line(start), section(i))
    for start, end, token in f.bolds:
        judge(start, token, 1, f.line(start), (end, next((s for s in starts if s > end), len(source) + 1)))
    for start, end, token in f.anchors:
        near = []
        for i, (hs, he, _, _) in enumerate(f.headings):
            if end <= hs and not source[end:hs].strip():
                near.append((hs - end, 0, i))
            elif he <= start and not source[he:start].strip():
                near.append((start - he + 1, 1, i))
        if near and md.ID.fullmatch(token):
            i = min(near)[2]
            out.append(Definition(min(start, f.headings[i][0]), 2, token, f.line(f.headings[i][0]), section(i)))
        else:
            judge(start, token, 2, f.line(start), (end, next((s for s in starts if s > end), len(source) + 1)), empty=True)
    return sorted(out, key=lambda d: (d.start, d.form)), sorted(malformed)


def rows_of_file(file: str, source: str) -> list[dict]:
    f = md.facts(source)
    defs, malformed = definitions(f, source)
    out, claimed = [], set()
    names = md.slugs([h[3] for h in f.headings])
    add = lambda row, **k: out.append({"row": row, "file": file, "ordinal": len(out), **k})
    for (start, _, level, text), name in zip(f.headings, names):
        add("heading", line=f.line(start), level=level, text=text, slug=name)
    for start, end, info, text in f.fences:
        if info != "claim":
            continue
        owner = next((d for d in reversed(defs) if d.start < start), None)
        if owner is None:
            add("orphan", line=f.line(start))
            continue
        claimed.add(owner.start)
        inside = lambda p: owner.scope[0] <= p < owner.scope[1] and not start <= p < end  # noqa: E731, B023
        add("claim", id=owner.id, line=owner.line, block_line=f.line(start), yaml=text, prose_links=[d for p, d in f.links if inside(p)], prose_code=[t for p, t, h in f.codes if not h and inside(p)], **payload(text))
    for d in defs:
        if d.start not in claimed:
            add("unregistered", line=d.line, id=d.id)
    for p, token in malformed:
        add("malformed", line=f.line(p), id=token)
    for p, w in f.words:
        add("normative", line=f.line(p), text=w)
    for p, dest in f.links:
        add("link", line=f.line(p), text=dest)
    for p, text, _ in f.codes:
        add("code", line=f.line(p), text=text)
    return out


def extracted(files: DataFrame) -> DataFrame:
    """Tagged rows of Markdown files (path, content). Parsing takes time, not bytes, so files are dealt over all partitions."""
    spark = files.sparkSession
    schema = to_arrow_schema(StructType.fromDDL(ROWS))
    maps = [f.name for f in schema if pa.types.is_map(f.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += rows_of_file(path, content.decode("utf-8"))  # not UTF-8: a hard error
            for r in rows:
                for m in maps:
                    if r.get(m) is not None:
                        r[m] = list(r[m].items())
            yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = files.select("path", "content").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(run, ROWS)


@dataclass
class Corpus:
    """The relations of a tree; all are DataFrames over one written extraction."""

    files: DataFrame
    documents: DataFrame  # doc_path, file, genre_path, kinds
    claims: DataFrame
    headings: DataFrame
    links: DataFrame
    code_references: DataFrame
    orphans: DataFrame
    normative: DataFrame
    unregistered: DataFrame
    malformed: DataFrame
    unreachable: DataFrame

    def edges(self) -> DataFrame:
        from .graph import edges_of

        return edges_of(self.claims)


def load(files: DataFrame, config: dict, world: World | None = None) -> Corpus:
    """Relations of files (path, content): Markdown of a genre is read whole, other files of a genre for `code` in backticks."""
    placed = cut(in_genres(files, config))
    spark = files.sparkSession
    texts = placed.filter(F.col("path").endswith(".md"))
    rows = cut(extracted(texts))
    of = lambda row, *columns: rows.filter(F.col("row") == row).select("file", "ordinal", *columns)
    documents = texts.select(refs.without_md(F.col("path")).alias("doc_path"), F.col("path").alias("file"), "genre_path", "kinds")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    claims = of("claim", "id", F.col("line").alias("heading_line"), "block_line", "yaml", "yaml_error", "types", "kind", "evaluator", empty("depends"), empty("because"), "strings", "axes", "axis_types", empty("prose_links"), empty("prose_code"))
    other = placed.filter(~F.col("path").endswith(".md")).filter(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("at", "content"))
    ticks = other.select(F.col("path").alias("file"), (F.col("at") + 1).alias("line"), F.posexplode(F.regexp_extract_all("content", F.lit("`([^`]*)`"), F.lit(1))).alias("ordinal", "dest"))
    codes = of("code", "line", F.col("text").alias("dest")).unionByName(ticks.select("file", "ordinal", "line", "dest"))
    links = of("link", "line", F.col("text").alias("dest")).filter(~refs.is_external(F.col("dest")))
    return Corpus(files, documents, claims, of("heading", "line", "level", "text", "slug").withColumn("doc_path", refs.without_md(F.col("file"))), links, codes, of("orphan", "line"), of("normative", "line", F.col("text").alias("keyword")), of("unregistered", "line", "id"), of("malformed", "line", "id"), unreachable(spark, links, codes, world or World()))


def unreachable(spark, links: DataFrame, codes: DataFrame, world: World) -> DataFrame:
    """(file, line, dest, resolved) of references to git-ignored paths.

    Links count where their target exists, code spans where they name a .md file. Only
    distinct candidate paths reach the driver, which asks git once.
    """
    path = refs.path_part(F.col("dest"))
    from_link = links.withColumn("resolved", refs.resolved(refs.directory(F.col("file")), path)).withColumn("is_link", F.lit(True))
    named = F.regexp_replace(path, "\\A/", "")
    from_code = codes.filter(~refs.is_external(F.col("dest"))).withColumn("resolved", F.when(named.endswith(".md"), named)).withColumn("is_link", F.lit(False))
    wanted = cut(from_link.unionByName(from_code).filter(F.col("resolved").isNotNull() & ~refs.is_degenerate(F.col("resolved"))))
    asked = wanted.groupBy("resolved").agg(F.bool_or("is_link").alias("l"), F.bool_or(~F.col("is_link")).alias("c")).collect()
    there = world.exists([r.resolved for r in asked if r.l])
    ignored = world.ignored(sorted(r.resolved for r in asked if r.c or r.resolved in there))
    answers = spark.createDataFrame([(p, p in there) for p in sorted(ignored)], "resolved string, there boolean")
    return wanted.join(answers, "resolved").filter("there or not is_link").select("file", "ordinal", "line", "dest", "resolved")
