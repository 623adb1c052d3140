"""Paths as Catalyst expressions and generators over a VARIANT column.

In row form every segment that can match more than one child is one ``variant_explode`` with its selectors as a
predicate on position, key and value; singular segments are ``variant_get``. In expression form (filters) a
nodelist is an array of variants. Predicates are never NULL: NULL is "nothing", ``is_variant_null`` is null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iregexp import java
from ..plans.syntax import Call, Compare, Exists, Filter, Index, Literal, Logical, Name, Not, Path, Slice, Wildcard, calls_in

ORD = "array<struct<branch:int,place:int>>"


def expressible(path: Path) -> bool:
    """No descendant segment anywhere, and no pattern that comes from a document."""
    if any(s.descendant for p in path.walk() for s in p.segments):
        return False
    return all(isinstance(c.args[1], Literal) for c in calls_in(path) if c.name in ("match", "search"))


def array_view(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def object_view(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def kind(v: Column) -> Column:
    """number, string, boolean, null, array or object; NULL for nothing."""
    return let(F.schema_of_variant(v), lambda s: (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    ))


def is_number(v: Column) -> Column:
    """Of a value that a number can be read from, which is no container."""
    return ~F.schema_of_variant(v).isin("STRING", "BOOLEAN", "VOID")


def is_string(v: Column) -> Column:
    """Of a value that text can be read from."""
    return F.schema_of_variant(v) == "STRING"


def member(v: Column, name: str) -> Column:
    if "'" in name or "\\" in name or '"' in name:
        return F.try_element_at(object_view(v), F.lit(name))
    return F.try_variant_get(v, f"$['{name}']", "variant")


def element(v: Column, index: int) -> Column:
    if 0 <= index < 2**31:
        return F.try_variant_get(v, f"$[{index}]", "variant")
    return F.try_element_at(array_view(v), F.lit(index)) if -(2**31) <= index < 0 else F.lit(None).cast("variant")


def _plain(s) -> str | None:
    """The selector as a part of a path that ``variant_get`` takes."""
    if isinstance(s, Name):
        return None if "'" in s.name or "\\" in s.name or '"' in s.name else f"['{s.name}']"
    return f"[{s.index}]" if 0 <= s.index < 2**31 else None


def one(v: Column, path: Path) -> Column:
    """The single node of a singular query, or NULL; runs of plain names and indexes are one step."""
    run = ""
    for segment in path.segments:
        (s,) = segment.selectors
        if (part := _plain(s)) is not None:
            run += part
            continue
        if run:
            v, run = F.try_variant_get(v, f"${run}", "variant"), ""
        v = member(v, s.name) if isinstance(s, Name) else element(v, s.index)
    return F.try_variant_get(v, f"${run}", "variant") if run else v


def chosen(s: Slice, pos: Column, n: Column) -> tuple[Column, Column]:
    """Whether a slice takes position ``pos`` of ``n``, and its place in the order of selection."""
    step = 1 if s.step is None else s.step
    if step == 0:
        return F.lit(False), pos
    at = lambda x: F.lit(x) if x >= 0 else n + x
    low_end, high_end = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)
    clamp = lambda x: F.least(F.greatest(x, low_end), high_end)
    start = clamp((F.lit(0) if step > 0 else n - 1) if s.start is None else at(s.start))
    end = clamp((n if step > 0 else F.lit(-1)) if s.end is None else at(s.end))
    if step > 0:
        return (pos >= start) & (pos < end) & ((pos - start) % step == 0), pos
    return (pos <= start) & (pos > end) & ((start - pos) % -step == 0), -pos


# ---- expression form --------------------------------------------------------------------------


def _children(v: Column) -> Column:
    return F.coalesce(array_view(v), F.map_values(object_view(v)), F.array().cast("array<variant>"))


def _present(v: Column) -> Column:
    return F.filter(F.array(v), lambda x: x.isNotNull())


def _selected(s, v: Column, root: Column) -> Column:
    if isinstance(s, Name):
        return _present(member(v, s.name))
    if isinstance(s, Index):
        return _present(element(v, s.index))
    if isinstance(s, Wildcard):
        return _children(v)
    if isinstance(s, Filter):
        return F.filter(_children(v), lambda x: predicate(s.test, x, root))
    items = F.coalesce(array_view(v), F.array().cast("array<variant>"))
    taken = let(items, lambda all_of: F.filter(all_of, lambda x, k: chosen(s, k, F.size(all_of))[0]))
    return F.reverse(taken) if (s.step or 1) < 0 else taken


def nodelist(path: Path, current: Column, root: Column) -> Column:
    """All nodes of a path as an array of variants."""
    start = current if path.root == "@" else root
    nodes = F.array(start)
    for k, segment in enumerate(path.segments):
        if not k:
            nodes = _step(segment.selectors, root)(start) if len(segment.selectors) == 1 else F.flatten(F.transform(nodes, _step(segment.selectors, root)))
            continue
        nodes = F.flatten(F.transform(nodes, _step(segment.selectors, root)))
    return nodes


def _step(selectors: tuple, root: Column):
    return lambda v: F.concat(*(_selected(s, v, root) for s in selectors)) if len(selectors) > 1 else _selected(selectors[0], v, root)


def operand(part, current: Column, root: Column) -> Column:
    """A variant, or NULL."""
    if isinstance(part, Literal):
        return F.parse_json(F.lit(__import__("json").dumps(part.value)))
    if isinstance(part, Path):
        return one(current if part.root == "@" else root, part)
    if part.name == "value":
        nodes = nodelist(part.args[0], current, root)
        return let(nodes, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))
    return F.to_variant_object(F.array(number(part, current, root)))  # not reached: numbers are compared as numbers


def number(part: Call, current: Column, root: Column) -> Column:
    """length() and count(), NULL for nothing."""
    if part.name == "count":
        (path,) = part.args
        if path.root == "@" and not path.segments:
            return F.coalesce(F.size(array_view(current)), F.lit(1))
        return F.size(nodelist(path, current, root))
    (a,) = part.args
    if isinstance(a, Literal):
        return F.lit(len(a.value) if isinstance(a.value, str) else None).cast("int")
    if isinstance(a, Call) and a.name != "value":
        return F.lit(None).cast("int")
    v = operand(a, current, root)
    k = kind(v)
    return (
        F.when(k == "string", F.char_length(F.try_variant_get(v, "$", "string")))
        .when(k == "array", F.size(array_view(v))).when(k == "object", F.size(object_view(v)))
    )


def _sized(part) -> bool:
    return isinstance(part, Call) and part.name in ("length", "count")


WHOLE = "decimal(38,0)"


def _key(v: Column) -> Column:
    """Text that is equal for equal values that are no numbers; NULL for nothing and for numbers."""
    k = kind(v)
    return F.when(k != "number", F.concat(k, F.lit(":"), F.to_json(v)))


BIG = 2.0**53


def _whole(v: Column) -> Column:
    """A whole number, which is exact beyond 2^53, or NULL."""
    s = F.schema_of_variant(v)
    exact = s.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | s.rlike(r"^DECIMAL\(\d+,0\)$")
    return F.when(exact, F.try_variant_get(v, "$", WHOLE))


def _as_string(part, current: Column, root: Column) -> Column:
    if _sized(part):
        return F.lit(None).cast("string")
    v = operand(part, current, root)
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


OPS = {"==": lambda p, q: p == q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q}
FALSE = lambda: F.lit(False)


class Side(NamedTuple):
    kind: str  # variant, size (an int) or literal
    value: Any


def _side(part, current: Column, root: Column) -> Side:
    if _sized(part):
        return Side("size", number(part, current, root))
    if isinstance(part, Literal):
        v = part.value
        if isinstance(v, (int, float)) and not isinstance(v, bool) and not abs(v) < BIG:
            return Side("variant", operand(part, current, root))
        return Side("literal", v)
    return Side("variant", operand(part, current, root))


def _numbers(op: str, left: Side, right: Side) -> Column:
    """Doubles decide, but for whole numbers from 2^53 on that are equal as doubles. Kinds are looked at last, where the numbers compare at all."""
    sides = (left, right)
    a, b = (F.lit(float(s.value)) if s.kind == "literal" else s.value.cast("double") if s.kind == "size" else F.try_variant_get(s.value, "$", "double") for s in sides)
    out = OPS[op](a, b)
    if left.kind == right.kind == "variant":
        beyond = (a == b) & (F.abs(a) >= BIG)
        exact = OPS[op](_whole(left.value), _whole(right.value))
        out = out & ~(beyond & ~F.coalesce(exact, F.lit(True))) if op != "<" else out | beyond & F.coalesce(exact, FALSE())
    out = F.coalesce(out, FALSE())
    for s in sides:
        if s.kind == "variant":
            out = out & is_number(s.value)
    return out


def _strings(op: str, left: Side, right: Side) -> Column:
    if "size" in (left.kind, right.kind):
        return FALSE()
    a, b = (F.lit(s.value) if s.kind == "literal" else F.try_variant_get(s.value, "$", "string") for s in (left, right))
    kinds = [is_string(s.value) for s in (left, right) if s.kind == "variant"]
    out = OPS[op](a, b) & kinds[0] if len(kinds) == 1 else kinds[0] & kinds[1] & OPS[op](a, b)
    return F.coalesce(out, FALSE())


def _same(left: Side, right: Side) -> Column:
    """Both nothing, or equal and no numbers."""
    none = left.value.isNull() & right.value.isNull()
    return none if "size" in (left.kind, right.kind) else none | F.coalesce(_key(left.value) == _key(right.value), FALSE())


def _constant(v: Side, scalar) -> Column:
    """Whether a value is null, true or false."""
    if v.kind == "size":
        return FALSE()
    if scalar is None:
        return F.coalesce(F.is_variant_null(v.value), FALSE())
    return F.coalesce((F.try_variant_get(v.value, "$", "boolean") == scalar) & (F.schema_of_variant(v.value) == "BOOLEAN"), FALSE())


def compare(op: str, left, right, current: Column, root: Column) -> Column:
    if isinstance(left, Literal) and isinstance(right, Literal):
        from .evaluate import compared

        return F.lit(compared(op, left.value, right.value))
    if op == "!=":
        return ~compare("==", left, right, current, root)
    if op in (">", ">="):
        left, right, op = right, left, {">": "<", ">=": "<="}[op]
    a, b = _side(left, current, root), _side(right, current, root)
    if isinstance(left, Call):  # what takes a nodelist to find is found once
        return let(a.value, lambda x: let(b.value, lambda y: _compared(op, Side(a.kind, x), Side(b.kind, y))) if isinstance(right, Call) else _compared(op, Side(a.kind, x), b))
    if isinstance(right, Call):
        return let(b.value, lambda y: _compared(op, a, Side(b.kind, y)))
    return _compared(op, a, b)


def _compared(op: str, left: Side, right: Side) -> Column:
    literal, other = (left, right) if left.kind == "literal" else (right, left)
    if literal.kind != "literal":
        ordered = _numbers(op, left, right)
        if op != "==":
            ordered = ordered | _strings(op, left, right)
        return ordered if op == "<" else ordered | _same(left, right)
    if literal.value is None or isinstance(literal.value, bool):
        return FALSE() if op == "<" else _constant(other, literal.value)
    return (_strings if isinstance(literal.value, str) else _numbers)(op, left, right)


def predicate(test, current: Column, root: Column) -> Column:
    """A filter's condition, true or false."""
    if isinstance(test, Exists):
        if test.path.singular:
            return one(current if test.path.root == "@" else root, test.path).isNotNull()
        return F.size(nodelist(test.path, current, root)) > 0
    if isinstance(test, Not):
        return ~predicate(test.test, current, root)
    if isinstance(test, Logical):
        a, b = predicate(test.left, current, root), predicate(test.right, current, root)
        return a & b if test.op == "&&" else a | b
    if isinstance(test, Compare):
        return compare(test.op, test.left, test.right, current, root)
    text, pattern = test.args  # match or search
    if not isinstance(pattern.value, str):
        return F.lit(False)
    if isinstance(text, Literal) and isinstance(text.value, str):
        subject = F.lit(text.value)
    else:
        subject = _as_string(text, current, root)
    return F.coalesce(F.regexp_like(subject, F.lit(java(pattern.value, test.name == "match"))), F.lit(False))


# ---- rewriting --------------------------------------------------------------------------------


def _takes(s, x: Column, key: Column | None, pos: Column | None, n: Column | None, root: Column) -> Column:
    """Whether a selector takes the child ``x``, a member of this name or an element at this place of ``n``."""
    if isinstance(s, Name):
        return key == s.name if key is not None else F.lit(False)
    if isinstance(s, Wildcard):
        return F.lit(True)
    if isinstance(s, Filter):
        return predicate(s.test, x, root)
    if pos is None:
        return F.lit(False)
    return chosen(s, pos, n)[0] if isinstance(s, Slice) else pos == (F.lit(s.index) if s.index >= 0 else n + s.index)


def _any(segment, x: Column, key: Column | None, pos: Column | None, n: Column | None, root: Column) -> Column:
    out = F.lit(False)
    for s in segment.selectors:
        out = out | _takes(s, x, key, pos, n, root)
    return out


def edited(v: Column, segments: tuple, root: Column, value: Column | None) -> Column:
    """``v`` with ``value`` (a variant; None: nothing) at all nodes of a query without descendants; only what leads there is built anew,
    and only the kinds of containers are looked for in which a selector can find something. Children are taken out of a container once."""
    segment, *rest = segments
    new = (lambda x: edited(x, tuple(rest), root, value)) if rest else lambda x: value

    def array(items: Column) -> Column:
        n = F.size(items)
        if rest or value is not None:
            return F.transform(items, lambda x, k: F.when(_any(segment, x, None, k, n, root), new(x)).otherwise(x))
        return F.filter(items, lambda x, k: ~_any(segment, x, None, k, n, root))

    def names(members: Column) -> Column:
        if rest or value is not None:
            return F.transform_values(members, lambda k, x: F.when(_any(segment, x, k, None, None, root), new(x)).otherwise(x))
        return F.map_filter(members, lambda k, x: ~_any(segment, x, k, None, None, root))

    out = []
    if not all(isinstance(s, Name) for s in segment.selectors):
        sized = any(isinstance(s, (Index, Slice)) for s in segment.selectors)
        out.append(F.to_variant_object(let(array_view(v), array) if sized else array(array_view(v))))
    if not all(isinstance(s, (Index, Slice)) for s in segment.selectors):
        out.append(F.to_variant_object(names(object_view(v))))
    return F.coalesce(*out, v)


# ---- row form ---------------------------------------------------------------------------------


def _quoted(key: Column) -> Column:
    plain = F.concat(F.lit("['"), key, F.lit("']"))
    out = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    for code in range(32):
        sign = {8: "\\b", 12: "\\f", 10: "\\n", 13: "\\r", 9: "\\t"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(sign))
    return F.when(key.rlike(r"[\x00-\x1f'\\]"), F.concat(F.lit("['"), out, F.lit("']"))).otherwise(plain)


def step_text(key: Column, pos: Column) -> Column:
    """One component of a normalized path."""
    return F.when(key.isNotNull(), _quoted(key)).otherwise(F.concat(F.lit("["), pos.cast("string"), F.lit("]")))


def rows(df: DataFrame, doc: str, path: Path) -> DataFrame:
    """``df`` with a row for each node: ``_value``, ``_parent``, ``_key``, ``_pos``, ``_path``, ``_ord``. ``doc`` is a VARIANT column."""
    root = F.col(f"`{doc}`")
    none = F.lit(None)
    start = {"_value": root, "_parent": none.cast("variant"), "_key": none.cast("string"), "_pos": none.cast("int"), "_path": F.lit("$"), "_ord": F.array().cast(ORD)}
    out = df.where(root.isNotNull()).withColumns(start)
    v, at = F.col("_value"), F.col("_path")
    for segment in path.segments:
        if segment.singular:
            (s,) = segment.selectors
            if isinstance(s, Name):
                new, key, pos = member(v, s.name), F.lit(s.name), none.cast("int")
            else:
                new, key = element(v, s.index), none.cast("string")
                pos = F.lit(s.index) if s.index >= 0 else F.size(array_view(v)) + s.index
            out = out.select(*_kept(df), new.alias("_new"), v.alias("_parent"), key.alias("_key"), pos.cast("int").alias("_pos"), at, "_ord").where("_new is not null")
            out = out.select(*_kept(df), F.col("_new").alias("_value"), "_parent", "_key", "_pos", F.concat(at, step_text(F.col("_key"), F.col("_pos"))).alias("_path"), "_ord")
            continue
        needs_size = any(isinstance(s, (Slice, Index)) for s in segment.selectors)
        if needs_size:
            out = out.withColumn("_n", F.size(array_view(v)))
        each = df.sparkSession.tvf.variant_explode(F.col("_value").outer()).toDF("_at", "_member", "_child")
        pos, key, value, n = F.col("_at"), F.col("_member"), F.col("_child"), F.col("_n")
        out = out.lateralJoin(each)
        choices = []
        for b, s in enumerate(segment.selectors):
            if isinstance(s, Name):
                taken, place = F.coalesce(key == s.name, F.lit(False)), pos
            elif isinstance(s, Index):
                taken, place = key.isNull() & (pos == (F.lit(s.index) if s.index >= 0 else n + s.index)), pos
            elif isinstance(s, Slice):
                taken, place = chosen(s, pos, n)
                taken = key.isNull() & taken
            elif isinstance(s, Wildcard):
                taken, place = F.lit(True), pos
            else:
                taken, place = predicate(s.test, value, root), pos
            choices.append((taken, F.struct(F.lit(b).alias("branch"), place.cast("int").alias("place"))))
        if len(choices) == 1:
            out = out.where(choices[0][0]).withColumn("_o", choices[0][1])
        else:
            all_of = F.filter(F.array(*(F.when(t, o) for t, o in choices)), lambda x: x.isNotNull())
            out = out.withColumn("_o", F.explode(all_of))
        out = out.select(
            *_kept(df), value.alias("_value"), v.alias("_parent"), key.alias("_key"), F.when(key.isNull(), pos).cast("int").alias("_pos"),
            F.concat(at, step_text(key, pos)).alias("_path"), F.concat("_ord", F.array("_o")).cast(ORD).alias("_ord"),
        )
    return out


def with_variant(df: DataFrame, doc: str, name: str) -> DataFrame:
    """``df`` with its JSON text as VARIANT beside it, parsed once a row: a generator of one row lies above the parser, below which the
    optimizer moves no filter and out of which it copies nothing. Of repeated names the last member stays."""
    allow_repeated_names(df.sparkSession)
    kept = _kept(df)
    return df.select(*kept, F.try_parse_json(F.col(f"`{doc}`")).alias("_parsed")).select(*kept, F.explode(F.array("_parsed")).alias(name))


def parsed(df: DataFrame, doc: str) -> DataFrame:
    """``df`` with VARIANT in place of its JSON text."""
    return with_variant(df, doc, "_doc").select(*(F.col("_doc").alias(c) if c == doc else F.col(f"`{c}`") for c in df.columns))


def allow_repeated_names(spark) -> None:
    """JSON texts may repeat a name in an object; as in most parsers the last one counts."""
    if spark.conf.get(REPEATED, "false") != "true":
        spark.conf.set(REPEATED, "true")


REPEATED = "spark.sql.variant.allowDuplicateKeys"


def _kept(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]
