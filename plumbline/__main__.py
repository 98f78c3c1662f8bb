"""python -m plumbline check|blast|affected|signals|run|rename ROOT [...]; the configuration is ROOT/genres.yaml."""

from __future__ import annotations

import argparse
import importlib
import os
import subprocess
import sys

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .api import Engine, shell
from .operators import rename
from .operators.evidence import SIGIL
from .sources.corpus import ConfigError


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("command", choices=["check", "blast", "affected", "signals", "run", "rename"])
    p.add_argument("root")
    p.add_argument("names", nargs="*")
    p.add_argument("--json", action="store_true")
    p.add_argument("--out")
    p.add_argument("--sigil", default=SIGIL)
    p.add_argument("--register", help="module:name of a dict of checks that replaces the thirteen")
    p.add_argument("--execute", action="store_true", help="run the commands that markers name")
    p.add_argument("--write", action="store_true")
    a = p.parse_args(argv)
    try:
        with open(os.path.join(a.root, "genres.yaml")) as f:
            config = yaml.safe_load(f)
        spark = SparkSession.builder.appName("plumbline").getOrCreate()
        if a.command == "rename" and a.write:
            refuse_uncommitted(a.root)
        register = None
        if a.register:
            module, _, name = a.register.partition(":")
            register = getattr(importlib.import_module(module), name)
        engine = Engine.of_tree(spark, a.root, config, sigil=a.sigil, register=register)
        return told(a, engine)
    except yaml.YAMLError as e:
        print("genres.yaml:", " ".join(str(e).split()), file=sys.stderr)
    except PySparkException as e:  # a file that can't be read or is no UTF-8 ends the run
        print(next((x.strip() for x in reversed(str(e).splitlines()) if "Error:" in x), str(e).splitlines()[0]), file=sys.stderr)
    except (OSError, LookupError, ConfigError, ImportError, AttributeError, rename.Refused) as e:
        print(e, file=sys.stderr)
    return 2


def refuse_uncommitted(root: str) -> None:
    """Raises Refused unless git says that nothing under root differs from what is committed."""
    git = subprocess.run(["git", "-C", root, "status", "--porcelain", "--", "."], capture_output=True, text=True)
    if git.returncode:
        raise rename.Refused(f"git can't tell whether the tree is committed: {git.stderr.strip()}")
    if git.stdout.strip():
        raise rename.Refused("the tree has changes that are not committed")


def told(a: argparse.Namespace, engine: Engine) -> int:
    """Runs the command and prints what it says; the exit code."""
    if a.command == "check":
        found = engine.check().collect()
        text = engine.report(a.json, found)
        if a.out:
            with open(a.out, "w") as f:
                f.write(text + "\n")
        else:
            print(text)
        if not a.json:
            print("\n".join(engine.lines(found)), file=sys.stderr)
        return 1 if any(r.severity == "fail" for r in found) else 0
    if a.command == "signals":
        print("\n".join(engine.signal_lines()))
        return 0
    if a.command == "affected":
        for claim, members in engine.affected(a.names).items():
            print(claim, *[f"  {m}" for m in members], sep="\n")
        return 0
    if a.command == "blast":
        members, cycles = engine.blast(a.names[0], exact=True)
        where = {r.id: r.file for r in engine.corpus.claims.select("id", "file").collect()}
        print("\n".join(f"{m}\t{where[m]}" for m in members))
        for claim, ancestor in cycles:
            print(f"cycle: {claim} -> {ancestor}", file=sys.stderr)
        return 0
    if a.command == "run":
        result = engine.run(a.names[0], shell(a.root) if a.execute else None)
        if result is None:
            raise LookupError(a.names[0])
        print("\n".join(result.lines(a.sigil)))
        return result.exit_code
    changes = engine.rename(a.names[0], a.names[1])
    for c in changes:
        print(f"{c.file}: {c.edits}")
    n, edits = rename.totals(changes)
    print(f"{edits} edit(s) in {n} file(s)")
    if a.write:
        rename.write_changes(a.root, changes)
    return 0


if __name__ == "__main__":
    sys.exit(main())
