"""A documentation tree as DataFrames: files, genres, and what is outside (ignored and existing paths)."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("requirement", "invariant", "constraint")
QUADRANTS = ("tutorial", "how-to", "reference", "explanation")


class ConfigError(ValueError):
    pass


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** is a path component of its own, * and ? may cross /."""
    out, parts = "", glob.split("/")
    for i, part in enumerate(parts):
        if part == "**":
            out += "(?:.*/)?" if i + 1 < len(parts) else ".*"
            continue
        if "**" in part:
            raise ConfigError(f"invalid glob {glob!r}: ** must be a path component")
        j = 0
        while j < len(part):
            c = part[j]
            if c == "[":
                end = part.find("]", j + 2)
                if end < 0:
                    raise ConfigError(f"invalid glob {glob!r}: [ is not closed")
                inner = part[j + 1 : end].replace("\\", "\\\\")
                out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
                j = end
            else:
                out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
            j += 1
        out += "/" if i + 1 < len(parts) else ""
    return f"\\A{out}\\z"


def genre_rows(config: dict | None) -> list[tuple[str, list[str], str, str]]:
    """(path, kinds, quadrant, pattern) of a configuration {"genres": [{"path", "kinds", "quadrant"}]}, or ConfigError."""
    if config is None:
        raise ConfigError("no configuration")
    rows = []
    if not isinstance(config, dict) or not isinstance(config.get("genres", []), list):
        raise ConfigError("the configuration is no mapping with a list of genres")
    for g in config.get("genres", []):
        if not isinstance(g, dict) or not isinstance(g.get("path"), str):
            raise ConfigError("a genre has no path")
        kinds, quadrant = list(g.get("kinds", [])), g.get("quadrant")
        if bad := [k for k in kinds if k not in KINDS]:
            raise ConfigError(f"unknown kind {bad[0]!r}")
        if quadrant not in QUADRANTS:
            raise ConfigError(f"unknown quadrant {quadrant!r}")
        if quadrant == "explanation" and kinds:
            raise ConfigError("an explanation permits no kinds")
        rows.append((g["path"], kinds, quadrant, glob_pattern(g["path"])))
    return rows


def listed(root: str, hidden: bool = False) -> list[str]:
    """Files under root, relative, in order of their path components; names with a leading dot and symlinks are not entered."""
    found = []
    for folder, folders, names in os.walk(root, followlinks=False):
        folders[:] = [d for d in folders if (hidden or not d.startswith(".")) and not os.path.islink(os.path.join(folder, d))]
        for name in names:
            full = os.path.join(folder, name)
            if (hidden or not name.startswith(".")) and not os.path.islink(full):
                found.append(os.path.relpath(full, root).replace(os.sep, "/"))
    return sorted(found, key=lambda p: p.split("/"))


def files_of(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every listed file; the executors read the contents, so root is a folder that they share.

    Spark's own file sources leave out names with a leading underscore, which are files like any others here.
    """
    base = os.path.abspath(root)
    paths = spark.createDataFrame([(p,) for p in listed(base)], "path string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(os.path.join(base, path), "rb") as f:
                    yield pa.record_batch({"path": pa.array([path]), "content": pa.array([f.read()], pa.binary())})

    return paths.mapInArrow(read, "path string, content binary")


def texts_frame(spark: SparkSession, texts: dict[str, str | bytes]) -> DataFrame:
    """(path, content) of texts held in memory."""
    return spark.createDataFrame([(p, t if isinstance(t, bytes) else t.encode()) for p, t in texts.items()], "path string, content binary")


def with_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """files with the contents that overrides (path, content) give."""
    new = overrides.select("path", F.col("content").alias("new"))
    return files.join(new, "path", "left").select("path", F.coalesce("new", "content").alias("content"))


def git_ignored(root: str, paths: Iterable[str]) -> set[str]:
    """Which paths git ignores; without git or a repository, none. One call; after its failure (128), one a path."""

    def ask(some: list[str]) -> set[str] | None:
        try:
            r = subprocess.run(["git", "-C", root, "check-ignore", "-z", "--stdin"], input="\0".join(some).encode(), capture_output=True)
        except OSError:
            return set()
        return None if r.returncode == 128 else {p for p in r.stdout.decode(errors="replace").split("\0") if p}

    paths = list(paths)
    found = ask(paths) if paths else set()
    return found if found is not None else {x for p in paths for x in ask([p]) or ()}


@dataclass
class World:
    """What the checks ask about the outside; all of it can be injected."""

    ignored: Callable[[list[str]], set[str]] = field(default=lambda paths: set())
    exists: Callable[[list[str]], set[str]] = field(default=lambda paths: set())


def world_of(root: str) -> World:
    return World(lambda paths: git_ignored(root, paths), lambda paths: {p for p in paths if os.path.exists(os.path.join(root, p))})


def in_genres(files: DataFrame, config: dict) -> DataFrame:
    """files that one genre matches, with genre_path and kinds; a file of two genres is an error."""
    spark = files.sparkSession
    genres = spark.createDataFrame(genre_rows(config), "genre_path string, kinds array<string>, quadrant string, pattern string")
    matched = files.select("path").join(F.broadcast(genres), F.expr("path rlike pattern"))
    both = matched.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("genre_path")).alias("genres")).filter("n > 1").orderBy("path").first()
    if both:
        raise ConfigError(f"{both.path} matches several genres: {', '.join(both.genres)}")
    return files.join(matched.select("path", "genre_path", "kinds"), "path")
