"""The engine's surface: open a tree, then check, blast, signals, run or rename."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import refs
from .operators import checks, evidence, extract, graph, rename
from .sources import corpus as sources


class Engine:
    def __init__(self, spark: SparkSession, files: DataFrame, config: dict, world: sources.World | None = None, sigil: str = evidence.SIGIL, register: dict[str, Callable] | None = None):
        self.spark, self.files, self.config, self.world, self.sigil = spark, files, config, world or sources.World(), sigil
        self.register = register or checks.CHECKS
        self.corpus = extract.load(files, config, self.world)

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, config: dict, **options) -> Engine:
        return cls(spark, sources.files_of(spark, root), config, sources.world_of(root), **options)

    @classmethod
    def of_texts(cls, spark: SparkSession, texts: dict, config: dict, **options) -> Engine:
        return cls(spark, sources.texts_frame(spark, texts), config, **options)

    def markers(self) -> DataFrame:
        return evidence.markers_of(self.files, self.sigil)

    def check(self, register: dict[str, Callable] | None = None) -> DataFrame:
        """Findings in order; register replaces the checks."""
        return checks.told(checks.diagnostics(self.corpus, self.markers(), register or self.register))

    def report(self, with_findings: bool = False, found: list | None = None) -> str:
        """The index (and findings; found: rows of check, if there are some) as JSON with sorted keys; nulls stay."""
        claims = {r.id: r.asDict(recursive=True) for r in checks.index_claims(self.corpus).collect()}
        documents = {r.doc_path: r.asDict() for r in checks.index_documents(self.corpus).collect()}
        index = {"claims": {k: {x: y for x, y in v.items() if x != "id"} for k, v in claims.items()}, "documents": {k: {x: y for x, y in v.items() if x != "doc_path"} for k, v in documents.items()}}
        if with_findings and found is None:
            found = self.check().collect()
        out = {"index": index, "findings": [r.asDict() for r in found]} if with_findings else index
        return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False)

    def lines(self, found: list | None = None) -> list[str]:
        """Findings (rows of check) for people."""
        found = self.check().collect() if found is None else found
        return [f"{'error' if r.severity == 'fail' else 'warning'}: {r.check}: {r.file}:{r.line}: {r.message}" for r in found]

    def _known(self, ref: str) -> bool:
        if "#" not in ref:
            return not self.corpus.claims.filter(F.col("id") == ref).isEmpty()
        path, _, anchor = ref.partition("#")
        return not self.corpus.headings.filter((F.col("doc_path") == path) & refs.heading_has_anchor(F.col("text"), F.lit(anchor), ascii_only=False)).isEmpty()

    def blast(self, ref: str, exact: bool = False):
        """What cites ref, directly or not: a DataFrame (member); exact: (members in order of discovery, cycles)."""
        if not self._known(ref):
            raise LookupError(ref)
        edges = self.corpus.edges()
        if not exact:
            return graph.closure(edges, self.spark.createDataFrame([(ref,)], "start string")).select("member")
        order = self.corpus.claims.select(F.col("id").alias("source"), F.split("file", "/").alias("parts"), "file", F.col("ordinal").alias("claim"), F.concat("depends", "because").alias("keys"))
        rows = order.select("source", "parts", "claim", F.posexplode("keys").alias("n", "key")).orderBy("parts", "claim", "n").collect()
        return graph.walk([(r.source, r.key) for r in rows], ref)

    def signals(self) -> DataFrame:
        return graph.degrees(self.corpus.claims, self.corpus.edges())

    def signal_lines(self) -> list[str]:
        """Signals for people: claims that nothing cites, each claim's place in the graph, and grades that leave the axis open."""
        rows = self.signals().orderBy(F.split("file", "/"), "line").collect()
        zero = [r for r in rows if not r.in_degree]
        out = [f"{len(rows)} claims, {len(zero)} zero-inbound", "", "Nothing in the corpus cites these; each may stand alone rightly, or be out of use:", *[f"  {r.id}\t{r.file}:{r.line}" for r in zero]]
        out += ["", "id\tfile\tline\tout-degree\tin-degree\treview-surface", *["\t".join(map(str, (r.id, r.file, r.line, r.out_degree, r.in_degree, r.review_surface))) for r in rows]]
        if open_ := checks.legacy_ambiguous(self.corpus).orderBy(F.split("file", "/"), "line").collect():
            out += ["", f"{len(open_)} claim(s) graded review or proof, which may mean design or implementation; `verification` would say which:", *[f"  {r.id}\t{r.file}:{r.line}\t{r.evaluator}" for r in open_]]
        return out

    def affected(self, paths: list[str]) -> dict[str, list[str]]:
        """For each claim of the files at paths that anything cites: what does, directly or not. What a hook before a commit tells."""
        starts = self.corpus.claims.filter(F.col("file").isin(list(paths))).select(F.col("id").alias("start")).distinct()
        rows = graph.closure(self.corpus.edges(), starts).groupBy("start").agg(F.array_sort(F.collect_set("member")).alias("members")).orderBy("start")
        return {r.start: r.members for r in rows.collect()}

    def run(self, claim_id: str, execute: Callable[[str], tuple] | None = None) -> evidence.RunResult | None:
        paths = [r.path for r in self.files.select("path").collect()]
        return evidence.run_claim(self.corpus, self.markers(), claim_id, execute, sorted(self.world.ignored(paths)))

    def rename(self, old: str, new: str) -> list[rename.Change]:
        return rename.plan_rename(self.files, self.config, old, new, self.world, self.sigil)


def shell(root: str) -> Callable[[str], tuple[bool, str, str, int | None]]:
    """Runs a marker's command in the tree's root: code of the corpus, so only on request."""

    def execute(command: str) -> tuple[bool, str, str, int | None]:
        r = subprocess.run(["sh", "-c", command], cwd=root, capture_output=True, text=True, errors="replace")
        return r.returncode == 0, r.stdout, r.stderr, r.returncode if r.returncode >= 0 else None

    return execute
