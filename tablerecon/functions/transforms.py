"""Contract transforms compiled to column expressions: a template ``"{a} {b}"``, a call
``f(column, 2, 'text')``, or a call around a template. Calls do not nest."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip, whole_part

#: fixed values: the functions that a transform may call, with their most arguments
FUNCTIONS = {"lower": 1, "upper": 1, "strip": 1, "round": 2}
#: fixed value: a number as an argument
ARGUMENT = r"-?\d+(\.\d+)?"


@dataclass(frozen=True)
class Part:
    kind: str  # column, number or literal
    value: str


@dataclass(frozen=True)
class Transform:
    function: str | None
    args: tuple[tuple[Part, ...], ...]


def _template(text: str) -> tuple[Part, ...]:
    return tuple(Part("column", x[1:-1]) if re.fullmatch(r"\{\w+\}", x) else Part("literal", x) for x in re.split(r"(\{\w+\})", text) if x)


def parse(text: str, feed: set[str]) -> Transform:
    """The transform of a contract; an unknown function or feed column is an error here."""
    text = text.strip()
    call = re.fullmatch(r"(\w+)\((.*)\)", text, re.S)
    if not call:
        return Transform(None, (_template(text),))
    name, args = call[1], [a.strip() for a in call[2].split(",")]
    if name not in FUNCTIONS or len(args) > FUNCTIONS[name]:
        raise ValueError(f"transform {text!r}: unknown function or too many arguments")
    out = []
    for a in args:
        if "{" in a:
            out.append(_template(a))
        elif re.fullmatch(ARGUMENT, a):
            out.append((Part("number", a),))
        elif a[:1] in "'\"" or (feed and a not in feed):
            if a[:1] not in "'\"" and re.fullmatch(r"\w+\(.*", a):
                raise ValueError(f"transform {text!r}: calls do not nest")
            out.append((Part("literal", a.strip("'\"")),))
        else:
            out.append((Part("column", a),))
    return Transform(name, tuple(out))


def inputs_of(t: Transform) -> list[str]:
    return [p.value for arg in t.args for p in arg if p.kind == "column"]


def compiled(t: Transform, feed: set[str] | None = None) -> Column:
    """The transform as a column. ``round`` of text that is no number is null. With ``feed``,
    placeholders that are none of its columns are empty."""

    def part(p: Part) -> Column:
        if p.kind != "column":
            return F.lit(p.value)
        return F.lit("") if feed is not None and p.value not in feed else F.coalesce(F.col(p.value).cast("string"), F.lit(""))

    def arg(parts: tuple[Part, ...]) -> Column:
        own = [part(p) for p in parts]
        return own[0] if len(own) == 1 else F.concat(*own)

    if t.function is None:
        return arg(t.args[0]) if t.args[0] else F.lit("")
    x = arg(t.args[0])
    if t.function == "lower":
        return F.lower(x)
    if t.function == "upper":
        return F.upper(x)
    if t.function == "strip":
        return strip(x)
    digits = int(float(t.args[1][0].value)) if len(t.args) > 1 else 0
    if digits >= 0:  # a cast rounds half up, in one step
        return strip(x).try_cast(f"decimal(38,{digits})").cast("string")
    return F.round(whole_part(strip(x), "decimal(38,0)"), digits).cast("decimal(38,0)").cast("string")


def expected(feed, contract, carry: list[str] | None = None):
    """The table that the feed must become, as text in contract order: one projection. A
    transform wins over a source name. ``carry`` keeps feed columns, such as a row order."""
    own = set(feed.columns)
    cols = [(compiled(parse(c.transform, own), own) if c.transform else F.col(c.source_name)).alias(c.name) for c in contract.columns]
    return feed.select(*cols, *(carry or []))
