"""I-Regexp to the dialects of the two backends. ``^`` and ``$`` are anchors of lines that end in a line feed."""

from __future__ import annotations

from functools import lru_cache

import regex


def body(pattern: str) -> str:
    """A dot outside a class is any character but line feed and carriage return."""
    out, inside, k = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[":
            inside += 1
        elif c == "]" and inside:
            inside -= 1
        out.append("[^\\n\\r]" if c == "." and not inside else c)
        k += 1
    return "".join(out)


@lru_cache(maxsize=1024)
def translate(pattern: str) -> regex.Pattern:
    """Compiled for Python; ValueError for what is no pattern."""
    try:
        return regex.compile(f"(?:{body(pattern)})", regex.MULTILINE | regex.V0)
    except regex.error as e:
        raise ValueError(str(e)) from None


def java(pattern: str, whole: bool) -> str:
    return f"(?dm)\\A(?:{body(pattern)})\\z" if whole else f"(?dm){body(pattern)}"
