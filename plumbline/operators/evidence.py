"""Evidence: markers in any file, literals that must be absent, and outcomes of claims."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs

SIGIL = "@evidence:"
#: Line comment, block comment and extensions of each language family.
COMMENTS = (
    ("//", ("/*", "*/"), "rs go java js jsx ts tsx c h cc cpp hpp swift kt scala rescript"),
    ("#", None, "py sh bash zsh rb toml yaml yml ncl pl"),
    ("#", ("/*", "*/"), "nix"),
    ("\\*", ("(*", "*)"), "tla"),
    ("--", ("/-", "-/"), "lean"),
    ("--", ("/*", "*/"), "sql als"),
    ("--", ("{-", "-}"), "hs"),
    ("--", ("--[[", "]]"), "lua"),
    ("--", None, "adb ads"),
)
STRING = r'"(?:[^"\\]|\\.)*"'
OUTCOMES = {"pass": 0, "none": 0, "review": 0, "fail": 1, "absent": 3, "vacuous": 4}


def markers_of(files: DataFrame, sigil: str = SIGIL) -> DataFrame:
    """id, command (null if bare), file, line, exempt: `sigil id`, `sigil id :: command` or `sigil id! :: command` in any UTF-8 file.

    Only the first sigil of a line that no word character precedes is read.
    """
    lines = files.filter(F.is_valid_utf8(F.col("content").cast("string"))).filter(F.col("content").cast("string").contains(sigil)).select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("at", "text"))
    pattern = f"(?<![A-Za-z0-9_]){re.escape(sigil)}(.*)"
    tail = F.regexp_extract("text", pattern, 1)
    form = "\\A\\s*([a-z0-9]+(?:-[a-z0-9]+)*)(?![a-z0-9-])(?:\\s*\\z|(!?)\\s*::\\s*(\\S.*?)\\s*\\z)"
    rows = lines.filter(F.col("text").rlike(pattern)).withColumn("tail", tail).filter(F.col("tail").rlike(form))
    command = F.regexp_extract("tail", form, 3)
    return rows.select(F.regexp_extract("tail", form, 1).alias("id"), F.when(command != "", command).alias("command"), "file", (F.col("at") + 1).cast("int").alias("line"), (F.regexp_extract("tail", form, 2) == "!").alias("exempt"))


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def without_comments(text: str, extension: str) -> str:
    """text with comments blanked, lines and strings kept."""
    for line, block, extensions in COMMENTS:
        if extension in extensions.split():
            parts = [STRING]
            if block:
                parts.append(f"(?P<block>{re.escape(block[0])}.*?(?:{re.escape(block[1])}|\\Z))")
            parts.append(f"(?P<line>{re.escape(line)}[^\n]*)")
            return re.sub("|".join(parts), lambda m: m[0] if m[0].startswith('"') else _blank(m[0]), text, flags=re.DOTALL)
    return text


def without_test_items(text: str) -> str:
    """Rust source with the items under #[test] and #[cfg(test)] blanked, by balanced braces outside strings."""
    out, at = "", 0
    for m in re.finditer(r"#\[(?:cfg\(test\)|test)\]", text):
        if m.start() < at:
            continue
        depth, end = 0, None
        for b in re.finditer(f"{STRING}|[{{}}]", text[m.start() :], re.DOTALL):
            depth += {"{": 1, "}": -1}.get(b[0], 0)
            if b[0] == "}" and depth == 0:
                end = m.start() + b.end()
                break
            if depth < 0:
                depth = 0
        if end is None:
            end = (text.find("\n", m.start()) + 1) or len(text)
        out += text[at : m.start()] + _blank(text[m.start() : end])
        at = end
    return out + text[at:]


def find_literal(files: DataFrame, literal: str, ignored: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(file, line) of lines on which the literal begins outside comments and tests, and (file) of files that are no UTF-8.

    Markdown, test paths and ignored paths are no candidates.
    """
    spark = files.sparkSession
    left = files.filter(~F.col("path").endswith(".md") & ~refs.is_test_path(F.col("path"))).join(spark.createDataFrame([(p,) for p in ignored], "path string"), "path", "left_anti")
    text = F.is_valid_utf8(F.col("content").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = []
            for path, content in zip(batch["path"], batch["content"]):
                source = bytes(content).decode()
                if literal not in source:
                    continue
                extension = path.rsplit("/", 1)[-1].rpartition(".")[2] if "." in path.rsplit("/", 1)[-1] else ""
                source = without_comments(source, extension)
                if extension == "rs":
                    source = without_test_items(source)
                at, seen, line = source.find(literal), 0, 1
                lines = []
                while at >= 0:
                    line, seen = line + source.count("\n", seen, at), at
                    if lines[-1:] != [line]:
                        lines.append(line)
                    at = source.find(literal, at + max(1, len(literal)))
                hits += [(path, n) for n in lines]
            yield pd.DataFrame(hits, columns=["file", "line"])

    return left.filter(text).select("path", "content").mapInPandas(run, "file string, line int"), left.filter(~text).select(F.col("path").alias("file"))


def is_vacuous() -> Column:
    """Whether a marker's success says nothing; exempt markers are taken at their word."""
    return F.col("success") & ~F.col("exempt") & refs.is_vacuous(F.coalesce("stdout", F.lit("")))


def fold(outcomes: DataFrame) -> DataFrame:
    """claim_id, outcome of marker outcomes (claim_id, success, stdout, exempt): any failure fails, else vacuous ones are vacuous, else pass."""
    rows = outcomes.groupBy("claim_id").agg(F.bool_and("success").alias("s"), F.bool_or(is_vacuous()).alias("v"))
    return rows.select("claim_id", F.when(~F.col("s"), "fail").when(F.col("v"), "vacuous").otherwise("pass").alias("outcome"))


def outcomes(claims: DataFrame, markers: DataFrame, results: DataFrame) -> DataFrame:
    """claim_id, outcome of every claim; results (file, line, success, stdout) are what markers with a command came to.

    Claims graded none or review need no marker; bare markers count for types alone; a claim without a
    usable marker is absent. Absence markers are taken at their word, like exempt ones.
    """
    first = claims.groupBy("id").agg(F.min_by(F.coalesce("evaluator", F.lit("")), F.struct(F.split("file", "/").alias("parts"), "ordinal")).alias("evaluator"))
    own = markers.join(first.filter(~F.col("evaluator").isin("none", "review")), "id").filter(F.col("command").isNotNull() | (F.col("evaluator") == "type"))
    bare = F.col("command").isNull()
    told = own.join(results, ["file", "line"], "left").select(F.col("id").alias("claim_id"), F.coalesce(bare | F.col("success"), F.lit(False)).alias("success"), F.coalesce("stdout", F.lit("")).alias("stdout"), (F.col("exempt") | bare | (F.col("evaluator") == "absent")).alias("exempt"))
    rows = first.join(fold(told), F.col("id") == F.col("claim_id"), "left")
    return rows.select(F.col("id").alias("claim_id"), F.when(F.col("evaluator").isin("none", "review"), F.col("evaluator")).otherwise(F.coalesce("outcome", F.lit("absent"))).alias("outcome"))


def conformance(claims: DataFrame, outcomes: DataFrame) -> DataFrame:
    """kind, discharged, total (an extension): how many claims of a kind pass."""
    rows = claims.join(outcomes, F.col("id") == F.col("claim_id"), "left")
    return rows.groupBy("kind").agg(F.count_if(F.col("outcome") == "pass").alias("discharged"), F.count("*").alias("total"))


@dataclass
class MarkerResult:
    """What one marker came to; code is the command's exit code, None if a signal ended it."""

    file: str
    line: int
    command: str | None
    success: bool
    stdout: str = ""
    stderr: str = ""
    code: int | None = None
    exempt: bool = False
    vacuous: bool = False

    def lines(self) -> list[str]:
        """For people: a status line, and what was printed where there is something to look into."""
        status = "vacuous" if self.vacuous else "ok" if self.success and self.command is not None else "ok (bare)" if self.success else "FAIL" + (f" (exit {self.code})" if self.code is not None else "")
        out = [f"  {status}\t{self.file}:{self.line}\t{self.command or '<bare>'}"]
        if self.vacuous or not self.success:
            for name in ("stdout", "stderr"):
                if text := getattr(self, name):
                    out += [f"  --- {name} ---", *[f"  {x}" for x in text.splitlines()]]
        return out


@dataclass
class RunResult:
    claim_id: str
    evaluator: str
    outcome: str
    markers: list = field(default_factory=list)
    hits: list = field(default_factory=list)
    skipped: list = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return OUTCOMES[self.outcome]

    def lines(self, sigil: str = SIGIL) -> list[str]:
        """For people: the outcome, files that could not be searched, each marker, and hits of literals."""
        out = [f"{self.outcome}\t{self.claim_id}\t{self.evaluator}"]
        if self.skipped:
            out += [f"  {len(self.skipped)} file(s) are no UTF-8 and were not searched:", *[f"    {x}" for x in self.skipped]]
        if self.outcome == "absent":
            form = "bare or with a command" if self.evaluator == "type" else "with a command"
            return [*out, f"  no file has a marker `{sigil} {self.claim_id}` {form}"]
        for m in self.markers:
            out += m.lines()
        return out + [f"  {file}:{line}" for file, line in self.hits]


def run_claim(corpus, markers: DataFrame, claim_id: str, execute: Callable[[str], tuple] | None = None, ignored: list[str] = ()) -> RunResult | None:
    """The outcome of one claim; None if there is none of that id.

    execute runs a marker's command on the driver and returns (success, stdout), and may
    add stderr and the exit code; without it, commands of the corpus are not run and claims that need one raise.
    """
    claim = corpus.claims.filter(F.col("id") == claim_id).orderBy(F.split("file", "/"), "ordinal").first()
    if claim is None:
        return None
    evaluator = claim.evaluator or ""
    if evaluator in ("none", "review"):
        return RunResult(claim_id, evaluator, evaluator)
    own = [m for m in markers.filter(F.col("id") == claim_id).orderBy("file", "line").collect() if m.command is not None or evaluator == "type"]
    result = RunResult(claim_id, evaluator, "absent")
    if not own:
        return result
    for m in own:
        if m.command is None:
            told = MarkerResult(m.file, m.line, None, True, exempt=True)
        elif evaluator == "absent":
            hits, skipped = find_literal(corpus.files, m.command, ignored)
            found = [tuple(h) for h in hits.orderBy("file", "line").collect()]
            result.hits += found
            result.skipped += [r.file for r in skipped.collect()]
            told = MarkerResult(m.file, m.line, m.command, not found, exempt=True)
        else:
            if execute is None:
                raise PermissionError(f"the command of {m.file}:{m.line} runs only with an executor given")
            success, stdout, *more = execute(m.command)
            told = MarkerResult(m.file, m.line, m.command, success, stdout, *more, exempt=m.exempt)
        result.markers.append(told)
    result.skipped = sorted(set(result.skipped))
    rows = corpus.files.sparkSession.createDataFrame([(claim_id, n, m.success, m.stdout, m.exempt) for n, m in enumerate(result.markers)], "claim_id string, n int, success boolean, stdout string, exempt boolean")
    for r in rows.filter(is_vacuous()).select("n").collect():
        result.markers[r.n].vacuous = True
    result.outcome = fold(rows).first().outcome
    return result
