"""The parts of a path expression, and their canonical text."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import cached_property

LIMIT = 2**53 - 1
SHORT = re.compile(r"[A-Za-z_\u0080-\ud7ff\ue000-\U0010ffff][0-9A-Za-z_\u0080-\ud7ff\ue000-\U0010ffff]*").fullmatch


class PathError(ValueError):
    """A query is not valid; ``column`` counts from 0."""

    def __init__(self, message: str, query: str = "", column: int | None = None):
        self.detail, self.query, self.column = message, query, column
        place = "" if column is None else f" (col {column})"
        super().__init__(f"Jsonpath query {query}{place} - {message}" if query else message)


def quoted(text: str) -> str:
    """A string literal in single quotes, escaped as normalized paths ask."""
    names = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "'": "\\'", "\\": "\\\\"}
    return "'" + "".join(names.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + "'"


def literal_text(value) -> str:
    return quoted(value) if isinstance(value, str) else json.dumps(value)


@dataclass(frozen=True)
class Name:
    name: str

    def __str__(self) -> str:
        return quoted(self.name)


@dataclass(frozen=True)
class Index:
    index: int

    def __str__(self) -> str:
        return str(self.index)


@dataclass(frozen=True)
class Slice:
    start: int | None = None
    end: int | None = None
    step: int | None = None

    def __str__(self) -> str:
        show = lambda x: "" if x is None else str(x)
        return f"{show(self.start)}:{show(self.end)}" + (f":{self.step}" if self.step is not None else "")

    def bounds(self, n: int) -> range:
        """Positions in an array of ``n``, in the order of selection."""
        step = 1 if self.step is None else self.step
        if step == 0:
            return range(0)
        at = lambda x: x if x >= 0 else n + x
        start = (0 if step > 0 else n - 1) if self.start is None else at(self.start)
        end = (n if step > 0 else -n - 1) if self.end is None else self.end
        end = at(end)
        if step > 0:
            return range(min(max(start, 0), n), min(max(end, 0), n), step)
        return range(min(max(start, -1), n - 1), min(max(end, -1), n - 1), step)


@dataclass(frozen=True)
class Wildcard:
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Filter:
    test: object

    def __str__(self) -> str:
        return f"?{self.test}"


@dataclass(frozen=True)
class Segment:
    selectors: tuple
    descendant: bool = False

    def __str__(self) -> str:
        dots = ".." if self.descendant else ""
        if len(self.selectors) == 1:
            (only,) = self.selectors
            if isinstance(only, Wildcard):
                return f"{dots or '.'}*"
            if isinstance(only, Name) and SHORT(only.name):
                return f"{dots or '.'}{only.name}"
        return f"{dots}[{', '.join(map(str, self.selectors))}]"

    @cached_property
    def singular(self) -> bool:
        return not self.descendant and len(self.selectors) == 1 and isinstance(self.selectors[0], (Name, Index))


@dataclass(frozen=True)
class Path:
    """``$`` or ``@`` and segments; equal by meaning, whatever the source text."""

    root: str
    segments: tuple[Segment, ...]
    source: str = field(default="", compare=False)

    def __str__(self) -> str:
        return self.root + "".join(map(str, self.segments))

    @cached_property
    def singular(self) -> bool:
        return all(s.singular for s in self.segments)

    @property
    def parent(self) -> Path:
        """All but the last segment."""
        if not self.segments:
            raise PathError("the root has no parent", str(self))
        return replace(self, segments=self.segments[:-1], source="")

    def keys(self) -> list[str | int]:
        """Names and indexes of a singular query below the root."""
        if not self.segments:
            raise PathError("the query is just the root", str(self))
        if not self.singular:
            raise PathError("not a singular query", str(self))
        return [s.selectors[0].name if isinstance(s.selectors[0], Name) else s.selectors[0].index for s in self.segments]

    def node_list(self) -> list:
        return [self.root, *self.segments]

    def tree(self) -> str:
        return "\n".join("  " * k + str(part) for k, part in enumerate(self.node_list()))

    def walk(self):
        """This path and all paths within its filters."""
        yield self
        for segment in self.segments:
            for s in segment.selectors:
                if isinstance(s, Filter):
                    yield from paths_in(s.test)


@dataclass(frozen=True)
class Literal:
    value: object

    def __str__(self) -> str:
        return literal_text(self.value)


@dataclass(frozen=True)
class Exists:
    path: Path

    def __str__(self) -> str:
        return str(self.path)


@dataclass(frozen=True)
class Not:
    test: object

    def __str__(self) -> str:
        return f"!{self.test}"


@dataclass(frozen=True)
class Logical:
    op: str
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


def paths_in(part):
    """Every path of an expression, nested ones too."""
    if isinstance(part, Path):
        yield from part.walk()
    elif isinstance(part, Exists):
        yield from part.path.walk()
    elif isinstance(part, Not):
        yield from paths_in(part.test)
    elif isinstance(part, (Logical, Compare)):
        yield from paths_in(part.left)
        yield from paths_in(part.right)
    elif isinstance(part, Call):
        for a in part.args:
            yield from paths_in(a)


def calls_in(part):
    if isinstance(part, Call):
        yield part
        for a in part.args:
            yield from calls_in(a)
    elif isinstance(part, Path):
        for segment in part.segments:
            for s in segment.selectors:
                if isinstance(s, Filter):
                    yield from calls_in(s.test)
    elif isinstance(part, Exists):
        yield from calls_in(part.path)
    elif isinstance(part, Not):
        yield from calls_in(part.test)
    elif isinstance(part, (Logical, Compare)):
        yield from calls_in(part.left)
        yield from calls_in(part.right)
