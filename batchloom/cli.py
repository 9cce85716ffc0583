"""A thin command line: python -m batchloom.cli COMMAND ... Results are JSON on standard output; domain errors exit with 2."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from pathlib import Path

from .errors import EngineError, ValidationError
from .sources.provider import Provider

MAX_TEXT = 1 << 20


def read_text(raw: bytes) -> str:
    """Text from standard input: bounded, strict UTF-8, line ends as they are."""
    if len(raw) > MAX_TEXT:
        raise ValidationError("the text is too long", limit=MAX_TEXT)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        raise ValidationError("the text is not UTF-8") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="batchloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("count-tokens", help="count the words of standard input")
    for name, args in (("submit", ("file", "endpoint")), ("poll", ("batch",)), ("wait", ("batch",)), ("retrieve", ("batch", "folder")), ("cancel", ("batch",))):
        c = sub.add_parser(name)
        c.add_argument("--url", required=True)
        for a in args:
            c.add_argument(a)
    for name in ("tables", "health"):
        sub.add_parser(name).add_argument("root")
    return p


def run(args: argparse.Namespace) -> object:
    if args.command == "count-tokens":
        return {"tokens": len(re.findall(r"[^ \t\n\r\x0b\f]+", read_text(sys.stdin.buffer.read(MAX_TEXT + 1))))}
    if args.command in ("tables", "health"):
        from .schemas import TABLES

        there = {t: (Path(args.root) / t).is_dir() for t in TABLES}
        return there if args.command == "tables" else {"ready": all(there.values()), "missing": sorted(t for t, x in there.items() if not x)}
    provider = Provider(args.url, os.environ.get("BATCHLOOM_KEY", ""))
    if args.command == "submit":
        file = Path(args.file)
        return provider.create(provider.upload(file.stem, file.read_bytes()), args.endpoint)
    if args.command == "poll":
        return provider.status(args.batch)
    if args.command == "wait":
        return provider.wait(args.batch, 10.0, 86_400.0)
    if args.command == "cancel":
        return provider.cancel(args.batch)
    found, out = provider.status(args.batch), {}
    if not found["is_complete"]:
        raise ValidationError("the batch isn't finished", batch=args.batch)
    for kind, field in (("result", "output_file_id"), ("error", "error_file_id")):
        if file_id := found.get(field):
            path = Path(args.folder) / f"{args.batch}.{kind}.jsonl"
            path.write_bytes(provider.content(file_id))
            out[kind] = str(path)
    return out


def main(argv: list[str] | None = None) -> int:
    try:
        print(json.dumps(run(parser().parse_args(argv)), ensure_ascii=False))
    except EngineError as e:
        print(json.dumps({"error": e.code, "message": str(e)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
