"""Command line: ``python -m pathloom.cli [QUERY] [FILE] [options]``."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path as File

from .operators import evaluate
from .plans.parser import parse
from .plans.syntax import PathError

VERSION = "0.1.0"


def value_of(text: str):
    """A value given as a flag: null, true, false, digits, digits with a fraction; else a string."""
    words = {"null": None, "true": True, "false": False}
    if text in words:
        return words[text]
    if re.fullmatch(r"\d+", text):
        return int(text)
    return float(text) if re.fullmatch(r"\d+\.\d+", text) else text


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pathloom", description="Query or rewrite a JSON document by path.")
    p.add_argument("words", nargs="*", metavar="QUERY|FILE")
    p.add_argument("-q", "--query-file", help="file that holds the query")
    p.add_argument("-c", "--compact", action="store_true", help="JSON on one line")
    p.add_argument("-v", "--value", help="value for -r and -i")
    p.add_argument("-V", "--value-file", help="JSON file with the value for -r and -i")
    action = p.add_mutually_exclusive_group()
    for short, name in (("-d", "delete"), ("-r", "replace"), ("-i", "insert"), ("-p", "paths")):
        action.add_argument(short, f"--{name}", dest="action", action="store_const", const=name)
    p.add_argument("--version", action="version", version=VERSION)
    found = p.parse_args(argv)
    found.action = found.action or "search"
    if found.action in ("replace", "insert") and found.value is None and found.value_file is None:
        p.error(f"{found.action} needs a value (-v or -V)")
    return found


def main(argv: list[str] | None = None, stdin=None, out=None) -> int:
    stdin, out = stdin or sys.stdin, out or sys.stdout
    args = arguments(sys.argv[1:] if argv is None else argv)
    words = list(args.words)
    try:
        if args.query_file:
            text = File(args.query_file).read_text().strip()
        else:
            text = next((w for w in words if not File(w).is_file()), None)
            if text is None:
                print("no query given", file=out)
                return 1
            words.remove(text)
        query = parse(text)
        data = File(words[0]).read_text() if words else ("" if stdin.isatty() else stdin.read())
        if not data.strip():
            print("Query is valid", file=out)
            return 0
        try:
            root = json.loads(data)
        except ValueError as e:
            print(f"Invalid JSON: {e}"[:257], file=out)
            return 1
        value = json.loads(File(args.value_file).read_text()) if args.value_file else None if args.value is None else value_of(args.value)
        made = {
            "search": lambda: [n.value for n in evaluate.find(query, root)],
            "paths": lambda: [n.path for n in evaluate.find(query, root)],
            "delete": lambda: evaluate.delete(query, root)[0],
            "replace": lambda: evaluate.replace(query, root, value),
            "insert": lambda: evaluate.insert(query, root, value),
        }[args.action]()
        print(json.dumps(made, ensure_ascii=False, indent=None if args.compact else 2, separators=(",", ":") if args.compact else None), file=out)
        return 0
    except PathError as e:
        print(f"Error: {e.detail}", file=out)
        if e.query and e.column is not None:
            print(f"  {e.query}\n  {' ' * e.column}^", file=out)
        return 1


if __name__ == "__main__":
    sys.exit(main())
