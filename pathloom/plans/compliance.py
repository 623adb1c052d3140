"""Runs records of a JSONPath compliance suite: ``{name, selector, document, result | results, result_paths | results_paths, invalid_selector}``."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from ..operators.evaluate import find
from .parser import parse
from .syntax import PathError


class Failure(NamedTuple):
    name: str
    selector: str
    got: object


def load(path: str) -> list[dict]:
    """The records of a suite's file: a list, or an object that holds them as ``tests``."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    return held["tests"] if isinstance(held, dict) else held


def failures(records: Iterable[dict]) -> Iterator[Failure]:
    for r in records:
        try:
            nodes = find(parse(r["selector"]), r.get("document"))
        except PathError as e:
            if not r.get("invalid_selector"):
                yield Failure(r["name"], r["selector"], str(e))
            continue
        if r.get("invalid_selector"):
            yield Failure(r["name"], r["selector"], "accepted")
            continue
        for got, one, many in (([n.value for n in nodes], "result", "results"), ([n.path for n in nodes], "result_paths", "results_paths")):
            allowed = [r[one]] if one in r else r.get(many, [got])
            if got not in allowed:
                yield Failure(r["name"], r["selector"], got)
