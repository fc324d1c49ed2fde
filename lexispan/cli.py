"""Command line: JSON on standard output for success, on standard error for failure, exit 0 or 1."""

from __future__ import annotations

import argparse
import json
import os
import sys

from lexispan.errors import SpanError

#: Kinds and languages that commands take.
KINDS = ("function", "method", "class", "struct", "interface", "enum", "trait", "impl", "module", "variable", "constructor", "type-alias")
LANGUAGES = ("rust", "python", "c", "cpp", "java", "javascript", "typescript")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexispan")
    top.add_argument("-v", "--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, writes: bool = False, language: bool = True):
        p = sub.add_parser(name)
        if language:
            p.add_argument("--language", choices=LANGUAGES)
        if writes:
            p.add_argument("--create-backup", action="store_true")
            p.add_argument("--operation-id")
            p.add_argument("--metadata")
        return p

    for name in ("delete", "patch"):
        p = command(name, writes=True)
        p.add_argument("-f", "--file", required=name == "delete")
        p.add_argument("-s", "--symbol", required=name == "delete")
        p.add_argument("-k", "--kind", choices=KINDS)
        p.add_argument("--analyzer", default="off")
        p.add_argument("--compilers", action="store_true", help="run the language's compiler after writing, and put all back if it fails")
        if name == "patch":
            p.add_argument("-w", "--with", dest="with_")
            p.add_argument("--batch")
            p.add_argument("--preview", action="store_true")
    command("plan", language=False).add_argument("-f", "--file", required=True)
    command("undo", language=False).add_argument("-m", "--manifest", required=True)
    command("recover", language=False).add_argument("-r", "--root", required=True, help="workspace in which a crash has left commits")
    p = command("apply-files", writes=True)
    for flag in ("glob", "find", "replace"):
        p.add_argument(f"-{flag[0]}", f"--{flag}", required=True)
    p.add_argument("--no-validate", action="store_true")
    p = command("query", language=False)
    p.add_argument("-d", "--db", required=True)
    p.add_argument("-l", "--label", action="append", default=[])
    for flag in ("list", "count", "show-code"):
        p.add_argument(f"--{flag}", action="store_true")
    p = command("get", language=False)
    p.add_argument("-d", "--db", required=True)
    p.add_argument("-f", "--file", required=True)
    p.add_argument("--start", type=int, required=True)
    p.add_argument("--end", type=int, required=True)
    p = command("index", language=False)
    p.add_argument("-r", "--root", required=True)
    p.add_argument("-d", "--db", required=True)
    return top


def run(spark, a: argparse.Namespace) -> dict:
    from lexispan.operators import extract
    from lexispan.plans import commands as c
    from lexispan.sources import files

    audit = {k: getattr(a, k) for k in ("language", "create_backup", "operation_id", "metadata") if hasattr(a, k)}
    kind = getattr(a, "kind", None)
    kind = kind.replace("-", "_") if kind else None
    gate = {"analyzer": getattr(a, "analyzer", "off"), "compilers": getattr(a, "compilers", False)}
    if a.command == "delete":
        return c.delete(spark, a.file, a.symbol, kind, **audit, **gate)
    if a.command == "patch":
        if a.batch:
            if kind or a.preview:
                raise SpanError("Other", "--batch takes neither --kind nor --preview")
            return c.patch_batch(spark, a.batch, **audit, **gate)
        if not (a.file and a.symbol and a.with_):
            raise SpanError("Other", "patch needs --file, --symbol and --with, or --batch")
        try:
            with open(a.with_, encoding="utf-8") as f:
                new = f.read()
        except OSError as e:
            raise SpanError("Io", f"I/O error for path {a.with_}: {e}", file=a.with_) from e
        return c.patch(spark, a.file, a.symbol, new, kind, preview=a.preview, **audit, **gate)
    if a.command == "plan":
        return c.run_plan(spark, a.file)
    if a.command == "undo":
        return c.undo(spark, a.manifest)
    if a.command == "recover":
        return c.recover(spark, a.root)
    if a.command == "apply-files":
        return c.apply_files(spark, a.glob, a.find, a.replace, validate=not a.no_validate, **audit)
    if a.command == "query":
        return c.query(spark, a.db, a.label, a.list, a.count, a.show_code)
    if a.command == "get":
        return c.get(spark, a.db, a.file, a.start, a.end)
    n = extract.index(files.scan_tree(spark, a.root), a.db, os.path.abspath(a.root))
    return {"status": "ok", "message": f"Indexed {n} symbol(s)", "data": {"symbols": n}}


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    try:
        if spark is None:
            from lexispan.session import session

            spark = session()
            spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
        print(json.dumps(run(spark, a), ensure_ascii=False))
        return 0
    except SpanError as e:
        print(json.dumps(e.payload(), ensure_ascii=False), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
