"""Ids, references, paths and slugs as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID = "\\A[a-z0-9]+(-[a-z0-9]+)*\\z"
ANCHOR_REF = "\\A[^\\s#]+#[^\\s#]+\\z"


def is_id(c: Column) -> Column:
    """Segments of a-z and 0-9 joined by single hyphens."""
    return c.rlike(ID)


def is_reference(c: Column) -> Column:
    """An id, or path#anchor."""
    return c.rlike(ID) | c.rlike(ANCHOR_REF)


def is_malformed_token(c: Column) -> Column:
    """No id, and without white space: a definition that was meant as an id."""
    return ~is_id(c) & ~c.rlike("\\s")


def is_external(c: Column) -> Column:
    return c.contains("://") | c.startswith("mailto:") | c.startswith("tel:")


def path_part(href: Column) -> Column:
    """What precedes the first #, if the href is path-shaped; else null."""
    path = F.substring_index(href, "#", 1)
    return F.when((path != "") & (href.contains("#") | path.contains("/") | path.contains(".")), path)


def is_degenerate(path: Column) -> Column:
    return path.isin("", "/", "..")


def is_test_path(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.lower(s).isin("test", "tests"))


def parsed(ref: Column) -> Column:
    """struct<tag, id, path, anchor, key>, split at the first #."""
    at = F.instr(ref, "#")
    anchor = at > 0
    return F.struct(
        F.when(anchor, "anchor").otherwise("claim").alias("tag"),
        F.when(~anchor, ref).alias("id"),
        F.when(anchor, F.substring_index(ref, "#", 1)).alias("path"),
        F.when(anchor, ref.substr(at + 1, F.length(ref))).alias("anchor"),
        ref.alias("key"),
    )


def is_ref_shaped(ref: Column) -> Column:
    p = parsed(ref)
    return F.when(p["tag"] == "claim", is_id(ref)).otherwise((p["path"] != "") & (p["anchor"] != ""))


def heading_has_anchor(text: Column, anchor: Column, ascii_only: bool = True) -> Column:
    """Text starts with the anchor, and no letter or digit follows it."""
    word = "[A-Za-z0-9]" if ascii_only else "[\\p{IsAlphabetic}\\p{N}]"
    return text.startswith(anchor) & ~text.substr(F.length(anchor) + 1, F.lit(1)).rlike(word)


def directory(path: Column) -> Column:
    """The path without its last segment; empty for a top-level file."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*\\z", "")).otherwise("")


def without_md(path: Column) -> Column:
    return F.regexp_replace(path, "\\.md\\z", "")


def resolved(base: Column, path: Column) -> Column:
    """path as seen from directory base, without . and ..; a leading / means the root; null if it climbs out of it."""
    none = F.array().cast("array<string>")
    start = F.when(path.startswith("/") | (base == ""), none).otherwise(F.split(base, "/"))

    def step(acc: Column, segment: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(acc.isNull() | segment.isin("", "."), acc).when(segment == "..", up).otherwise(F.concat(acc, F.array(segment)))

    parts = F.aggregate(F.split(path, "/"), start, step)
    return F.when(parts.isNotNull(), F.array_join(parts, "/"))


def link_target(file: Column, href: Column) -> Column:
    """The reference that a prose link means, or null: #x is an anchor of its own document, a bare word an id, a path with an anchor a document's heading."""
    at = F.instr(href, "#")
    path = F.substring_index(href, "#", 1)
    anchor = F.when(at > 0, href.substr(at + 1, F.length(href)))
    has_anchor = anchor.isNotNull() & (anchor != "")
    own = F.concat(without_md(file), F.lit("#"), anchor)
    document = without_md(resolved(directory(file), path))
    return (
        F.when((path == "") & has_anchor, own)
        .when(~has_anchor & (path != "") & ~path.contains("/") & ~path.endswith(".md"), path)
        .when(has_anchor & document.isNotNull(), F.concat(document, F.lit("#"), anchor))
    )


def slug(text: Column) -> Column:
    """Heading text in small letters, only letters, digits, marks, space, - and _, spaces as hyphens."""
    return F.replace(F.regexp_replace(F.lower(text), "[^\\p{IsAlphabetic}\\p{N}\\p{M} _-]", ""), F.lit(" "), F.lit("-"))


def is_vacuous(output: Column) -> Column:
    """At least one result line of a test run, and none of them ran a test."""
    lines = F.filter(F.split(output, "\n"), lambda l: l.contains("test result: "))
    return (F.size(lines) > 0) & F.forall(lines, lambda l: l.contains("0 passed; 0 failed"))
