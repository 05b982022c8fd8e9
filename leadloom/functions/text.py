"""Whitespace, casing and lookup helpers as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def squash(c: Column) -> Column:
    """Runs of whitespace become one blank; ends trimmed."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, so ``senior-ios`` gives ``Senior-Ios``."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))),
        "",
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times inside ``body``."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(needles: Sequence[str]) -> Column:
    """Constant string array; one literal in the plan however long the list is."""
    if not needles:
        return F.expr("cast(array() as array<string>)")
    return F.expr("array(" + ", ".join(sql_string(n) for n in needles) + ")")


def is_in(c: Column, table: Sequence[str]) -> Column:
    """Membership in a constant list; one plan literal however long the list is."""
    return F.array_contains(words(table), c)


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    return let(c, lambda text: F.exists(words(needles), lambda n: F.contains(text, n)))


def found(c: Column, needles: Sequence[str]) -> Column:
    """Array of the needles contained in ``c``, in the given order."""
    return let(c, lambda text: F.filter(words(needles), lambda n: F.contains(text, n)))


def hit_count(c: Column, needles: Sequence[str]) -> Column:
    return F.size(found(c, needles))


def first_case(pairs: Sequence[tuple[Column, Column | str]], default: Column | None = None) -> Column:
    """First true condition gives the value (a SQL CASE in list order)."""
    expr = None
    for condition, value in pairs:
        literal = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(condition, literal) if expr is None else expr.when(condition, literal)
    return expr if default is None else expr.otherwise(default)


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """Constant dictionary lookup; null when the key is missing."""
    show = lambda v: sql_string(v) if isinstance(v, str) else str(v)
    pairs = ", ".join(f"{show(k)}, {show(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), c)


def host_matches(host: Column, suffixes: Sequence[str]) -> Column:
    """Host equals a listed domain or is one of its sub-domains."""
    return host.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def ordered_distinct_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element per key, in order: sorted by key and place, the heads of runs, sorted back by place."""

    def heads(rows: Column) -> Column:
        first = F.filter(rows, lambda r, i: (i == 0) | ~r["k"].eqNullSafe(F.get(rows, i - 1)["k"]))
        back = F.sort_array(F.transform(first, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
        return F.transform(back, lambda r: r["x"])

    placed = F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return let(F.sort_array(placed), heads)
