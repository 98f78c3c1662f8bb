import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from plumbline.api import Engine
from plumbline.functions import refs
from plumbline.operators import checks, evidence, graph, rename
from plumbline.sources import corpus as sources
from plumbline.sources import markdown as md
from pyspark.sql import functions as F

CONFIG = {"genres": [{"path": "docs/specs/**", "kinds": ["constraint"], "quadrant": "reference"}, {"path": "docs/adr/**", "kinds": [], "quadrant": "explanation"}, {"path": "src/**", "kinds": [], "quadrant": "reference"}]}
FENCE = "```claim\nkind: {kind}\nevaluator: {evaluator}\n{more}```\n"


def claim(id, prose="", kind="constraint", evaluator="test", more=""):
    return f"### [{id}] — title\n\n{prose}\n\n" + FENCE.format(kind=kind, evaluator=evaluator, more=more)


def found(spark, texts, world=None, **options):
    e = Engine.of_texts(spark, texts, CONFIG, world=world, **options)
    return [(r.check, r.line, r.claim_id) for r in e.check().collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        (claim("a-claim"), []),
        ("```claim\nkind: x\n```\n", [("orphan-claim", 1, None)]),
        (claim("a", more="extra: 1\n"), [("C1", 5, "a")]),
        (claim("a", kind="requirement"), [("C3", 5, "a")]),
        (claim("a", "[b](gone)", more="depends: [gone]\n"), [("C4", 5, "a")]),
        (claim("a", "[b](gone)", more="because: [gone]\n"), [("orphaned-because", 5, "a")]),
        (claim("a") + "\n" + claim("b", more="depends: [a]\n"), [("C5", 10, "b")]),
        (claim("a") + "\n" + claim("b", "see [it](#a)", more="depends: [a]\n"), []),
        (claim("a") + "\n" + claim("a"), [("C2", 1, "a"), ("C2", 10, "a")]),
        ("### [lonely]\n\ntext\n", [("unregistered-definition", 1, None)]),
        ("### [Not_Kebab]\n\ntext\n", [("malformed-id", 1, None)]),
        ("### A [link] later\n\n[x](nothing-there)\n", [("dangling-reference", 3, None)]),
        ("[x](https://a.b/c) [y](../../../up.md#z) [z](other.md)\n", []),
        ("# Six things\n\n[x](#six-things) and [y](#seven-things)\n", [("dangling-reference", 3, None)]),
        ("**[bold-id]** (aside): text\n\n" + FENCE.format(kind="constraint", evaluator="test", more=""), []),
        ('<a id="html-id"></a>\n\n' + FENCE.format(kind="constraint", evaluator="test", more=""), []),
        ("- **[not-first]**: in a list\n", []),
    ],
)
def test_checks(spark, text, expected):
    assert found(spark, {"docs/specs/a.md": text}) == expected


def test_normative_prose(spark):
    text = "It MUST NOT be.\n\n> It MUST.\n\n```\nMUST\n```\n\nA must, `MUST`, MUSTARD.\n"
    assert found(spark, {"docs/adr/a.md": text}) == [("normative-prose", 1, None)]
    assert found(spark, {"docs/specs/a.md": text}) == []


def test_numeric_anchors_resolve_and_slugs_do_not(spark):
    other = "## 6 The fact set\n"
    ok = claim("a", "[x](b.md#6)", more="depends: ['docs/specs/b#6']\n")
    assert found(spark, {"docs/specs/a.md": ok, "docs/specs/b.md": other}) == []
    by_slug = claim("a", "[x](b.md#6-the-fact-set)", more="depends: ['docs/specs/b#6']\n")
    assert found(spark, {"docs/specs/a.md": by_slug, "docs/specs/b.md": other}) == []
    slug = claim("a", "[x](b.md#6-the-fact-set)", more="depends: ['docs/specs/b#6-the-fact-set']\n")
    assert found(spark, {"docs/specs/a.md": slug, "docs/specs/b.md": other}) == [("C4", 5, "a")]


@pytest.mark.parametrize(
    "block,message",
    [
        ("kind: [", "invalid YAML"),
        ("- a", "claim block is not a YAML mapping"),
        ("evaluator: test", "missing required field(s): kind"),
        ("kind: constraint", "missing required field(s): evaluator or verification"),
        ("kind: constraint\nevaluator: test\nverification: {design: test}", "fields `evaluator` and `verification` are mutually"),
        ("kind: other\nevaluator: test", "field `kind` has an invalid value"),
        ("kind: constraint\nevaluator: maybe", "field `evaluator` has an invalid value"),
        ("kind: constraint\nverification: {cost: test}", "verification field(s) not permitted: cost"),
        ("kind: constraint\nverification: {design: maybe}", "field `verification.design` has an invalid value"),
        ("kind: constraint\nevaluator: test\ndepends: [Bad_Id]", "field `depends` must be an array"),
        ("kind: constraint\nevaluator: test\nbecause: 3", "field `because` must be an array"),
        ("kind: constraint\nkind: constraint", "invalid YAML"),
    ],
)
def test_first_schema_problem(spark, block, message):
    e = Engine.of_texts(spark, {"docs/specs/a.md": f"### [a]\n\n```claim\n{block}\n```\n"}, CONFIG)
    told = [r.message for r in e.check().collect() if r.check == "C1"]
    assert len(told) == 1 and told[0].startswith(message)


def test_unreachable(spark):
    world = sources.World(lambda paths: {p for p in paths if p.startswith("private/")}, lambda paths: {p for p in paths if p == "private/x.md"})
    texts = {"docs/specs/a.md": "[x](../../private/x.md) [y](../../private/y.md) `private/z.md` `private/z`\n", "src/m.txt": "see `private/z.md`\n"}
    assert found(spark, texts, world) == [("unreachable-reference", 1, None)] * 3


def test_config_errors(spark):
    for bad in (None, {"genres": [{"path": "a", "kinds": ["x"], "quadrant": "reference"}]}, {"genres": [{"path": "a", "quadrant": "x"}]}, {"genres": [{"path": "a", "kinds": ["constraint"], "quadrant": "explanation"}]}, {"genres": [{"path": "a**", "quadrant": "reference"}]}):
        with pytest.raises(sources.ConfigError):
            Engine.of_texts(spark, {"a": "x"}, bad)
    with pytest.raises(sources.ConfigError):
        Engine.of_texts(spark, {"docs/a.md": "x"}, {"genres": [{"path": "docs/**", "quadrant": "reference"}, {"path": "**", "quadrant": "reference"}]})


def test_tree_and_report(spark, tmp_path):
    (tmp_path / "docs/specs/.hidden").mkdir(parents=True)
    (tmp_path / "docs/specs/_a b.md").write_text(claim("a"))
    (tmp_path / "docs/specs/.hidden/b.md").write_text(claim("b"))
    e = Engine.of_tree(spark, str(tmp_path), CONFIG)
    out = json.loads(e.report(with_findings=True))
    assert out["findings"] == [] and out["index"]["claims"]["a"] == {"file": "docs/specs/_a b.md", "line": 5, "kind": "constraint", "evaluator": "test", "design": None, "implementation": "test", "depends": [], "because": []}
    assert list(out["index"]["documents"]) == ["docs/specs/_a b"]


def chain():
    return {"docs/specs/a.md": claim("a") + "\n" + claim("b", "[x](a) [y](c)", more="depends: [a]\nbecause: [c]\n") + "\n" + claim("c", "[x](b)", more="depends: [b]\n")}


def test_graph(spark):
    e = Engine.of_texts(spark, chain(), CONFIG)
    assert e.blast("a", exact=True) == (["b", "c"], [("b", "c")])
    assert {r.member for r in e.blast("a").collect()} == {"b", "c"}
    assert {r.id: (r.out_degree, r.in_degree, r.review_surface) for r in e.signals().collect()} == {"a": (0, 1, 2), "b": (2, 1, 1), "c": (1, 1, 1)}
    assert e.affected(["docs/specs/a.md"]) == {"a": ["b", "c"], "b": ["c"], "c": ["b"]} and e.affected([]) == {}
    told = e.signal_lines()
    assert told[0] == "3 claims, 0 zero-inbound" and "b\tdocs/specs/a.md\t14\t2\t1\t1" in told
    with pytest.raises(LookupError):
        e.blast("nothing")
    assert graph.walk([("s", "s")], "s") == ([], [("s", "s")])
    assert graph.walk([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "a") == (["b", "d", "c"], [])


def test_evidence(spark):
    texts = {
        "docs/specs/a.md": claim("t") + "\n" + claim("n", evaluator="none") + "\n" + claim("gone", "`Retry`", evaluator="absent") + "\n" + claim("ty", evaluator="type"),
        "src/lib.rs": '// Retry in a comment\nlet x = "Retry";\n#[cfg(test)]\nmod t { fn f() { "Retry" } }\n// @evidence: gone :: Retry\n',
        "src/m.py": "# @evidence: t :: run it\n# x@evidence: n\n# @evidence: ty\n# @evidence: t! :: other\n# @evidence: t!\n# @evidence: Bad :: x\n",
    }
    e = Engine.of_texts(spark, texts, CONFIG)
    assert [(r.id, r.command, r.line, r.exempt) for r in e.markers().filter("file = 'src/m.py'").collect()] == [("t", "run it", 1, False), ("ty", None, 3, False), ("t", "other", 4, True)]
    assert e.run("t", lambda c: (True, "test result: ok. 0 passed; 0 failed" if c == "run it" else "")).outcome == "vacuous"
    assert e.run("t", lambda c: (c == "run it", "")).exit_code == 1
    assert e.run("t", lambda c: (True, "test result: ok. 2 passed; 0 failed")).outcome == "pass"
    assert (e.run("n").outcome, e.run("ty").outcome, e.run("zz")) == ("none", "pass", None)
    gone = e.run("gone")
    assert gone.outcome == "fail" and gone.hits == [("src/lib.rs", 2)]
    assert gone.lines()[0] == "fail\tgone\tabsent" and gone.lines()[-1] == "  src/lib.rs:2"
    told = e.run("t", lambda c: (c != "run it", "out", "err", 3)).lines()
    assert told == ["fail\tt\ttest", "  FAIL (exit 3)\tsrc/m.py:1\trun it", "  --- stdout ---", "  out", "  --- stderr ---", "  err", "  ok\tsrc/m.py:4\tother"]
    with pytest.raises(PermissionError):
        e.run("t")


def test_stale_marker(spark):
    text = claim("gone", "`Other`", evaluator="absent") + "\n<!-- @evidence: gone :: Retry -->\n"
    assert [c for c, _, _ in found(spark, {"docs/specs/a.md": text})] == ["absent-marker-stale"]


def test_comments():
    assert evidence.without_comments('a = "# no" # yes\nb', "py") == 'a = "# no"      \nb'
    assert evidence.without_comments("x /* a\nb */ y // z", "rs") == "x     \n     y     "
    assert evidence.without_comments("x /* a", "sql").rstrip() == "x"
    assert evidence.without_comments("# x", "md") == "# x"


def test_rename(spark):
    texts = chain() | {"docs/specs/b.md": "See [it](a.md#b) and [same](b).\n"}
    e = Engine.of_texts(spark, texts, CONFIG)
    changes = {c.file: c for c in e.rename("b", "better")}
    assert {f: c.edits for f, c in changes.items()} == {"docs/specs/a.md": 3, "docs/specs/b.md": 2}
    assert changes["docs/specs/b.md"].new == "See [it](a.md#better) and [same](better).\n"
    for old, new in (("zz", "x"), ("b", "Bad Id"), ("b", "a")):
        with pytest.raises(rename.Refused):
            e.rename(old, new)
    several = {"docs/specs/a.md": claim("a") + "\n" + claim("b", "[x](a)", more="depends:\n  - a\n")}
    with pytest.raises(rename.Refused):
        Engine.of_texts(spark, several, CONFIG).rename("a", "better")


def test_reference_columns(spark):
    row = spark.range(1).select(
        refs.resolved(F.lit("a/b"), F.lit("../c/./d")).alias("up"),
        refs.resolved(F.lit("a"), F.lit("../../x")).alias("out"),
        refs.resolved(F.lit(""), F.lit("x")).alias("top"),
        refs.resolved(F.lit("a"), F.lit("/x/y")).alias("root"),
        refs.slug(F.lit("Café 🚀 A/b")).alias("slug"),
        refs.parsed(F.lit("p#a#b"))["anchor"].alias("anchor"),
        refs.is_id(F.lit("a-b\n")).alias("newline"),
        refs.is_id(F.lit("a--b")).alias("double"),
        refs.heading_has_anchor(F.lit("6é"), F.lit("6")).alias("ascii"),
        refs.heading_has_anchor(F.lit("6é"), F.lit("6"), ascii_only=False).alias("unicode"),
        refs.is_test_path(F.lit("a/Tests/b")).alias("test"),
    ).first()
    assert row.asDict() == {"up": "a/c/d", "out": None, "top": "x", "root": "x/y", "slug": "café--ab", "anchor": "a#b", "newline": False, "double": False, "ascii": True, "unicode": False, "test": True}


def test_slugs():
    assert md.slugs(["Foo", "foo-1", "Foo", "Foo"]) == ["foo", "foo-1", "foo-2", "foo-3"]


@given(st.text(alphabet="ab#*[]()`<>\n -:!_\\\"'=", max_size=80))
def test_reader_takes_any_text(text):
    f = md.facts(text)
    for start, *_ in f.headings + f.links + f.codes:
        assert 0 <= start <= len(text)


def test_register_can_be_replaced(spark):
    e = Engine.of_texts(spark, {"docs/specs/a.md": claim("a", kind="requirement")}, CONFIG)
    assert e.check({"C1": checks.c1}).collect() == []
    only = Engine.of_texts(spark, {"docs/specs/a.md": claim("a", kind="requirement")}, CONFIG, register={"C2": checks.c2})
    assert json.loads(only.report(with_findings=True))["findings"] == []


def headings(text):
    return [md.slug_of(h[3]) for h in md.facts(text).headings]


@pytest.mark.parametrize(
    "text,want",
    [
        ("## use my_func_name\n", ["use-my_func_name"]),
        ("## a *b* c_d_ ***e*** 2 * 3 __f__g\n", ["a-b-c_d_-e-2--3-__f__g"]),
        ("## salt &amp; pepper &nosuch; &#35;\n", ["salt--pepper-nosuch-"]),
        ("<!-- owner -->\n### [a-claim] x\n", ["a-claim-x"]),
        ("<!--\n\n### gone\n-->\n### kept\n", ["kept"]),
        ("<pre>\n\n# gone\n</pre>\n# kept\n", ["kept"]),
        ("<div>\n# gone\n\n# kept\n", ["kept"]),
        ("text\n<b>\n# kept\n", ["kept"]),
        ("<b>\n# gone\n\n# kept\n", ["kept"]),
        ("-\t# x\n\n\t## y\n", ["x", "y"]),
        ("* * *\n# r\n", ["r"]),
    ],
)
def test_headings_of_markdown(text, want):
    assert headings(text) == want


def test_definitions_over_lines():
    links = [d for _, d in md.facts("[a]:\n  /url\n  'title'\n[b]: <x y>\n[c]: /c?a=1&amp;b=2\nrest [a] [b] [C][] [d](e\\_f)\n").links]
    assert links == ["/url", "x y", "/c?a=1&b=2", "e_f"]


def test_exit_codes(spark, tmp_path, capsys):
    from plumbline.__main__ import main

    def run(*words):
        return main([words[0], str(tmp_path), *words[1:]])

    (tmp_path / "docs").mkdir()
    page = "### [one-claim] x\n\n```claim\nkind: requirement\nevaluator: test\n```\n"
    (tmp_path / "docs" / "a.md").write_text(page)
    (tmp_path / "src.rs").write_text("// @evidence: one-claim :: true\n")
    for bad in ("genres: [", "genres: 3", "genres:\n  - kinds: []\n"):
        (tmp_path / "genres.yaml").write_text(bad)
        assert run("check") == 2
    (tmp_path / "genres.yaml").write_text("genres:\n  - {path: 'docs/**', kinds: [requirement], quadrant: reference}\n")
    assert run("check") == 0 and run("run", "no-claim") == 2
    assert run("run", "one-claim") == 2 and run("run", "one-claim", "--execute") == 0
    assert run("rename", "one-claim", "two-claim", "--write") == 2  # markers name it, and there is no repository
    (tmp_path / "src.rs").unlink()
    assert run("rename", "one-claim", "two-claim", "--write") == 2 and (tmp_path / "docs" / "a.md").read_text() == page
    assert run("rename", "one-claim", "two-claim") == 0 and "1 edit(s) in 1 file(s)" in capsys.readouterr().out
    (tmp_path / "docs" / "b.md").write_bytes(b"\xff\xfe")
    assert run("check") == 2
