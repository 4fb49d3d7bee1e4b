"""Normal forms of feed and target values, as column expressions.

A value has two parts: its typed form, and its text if that cannot be read as the type. Both
are compared, so a value that cannot be read equals only the same text and never a null.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what text stripping removes
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: fixed values: what reads as true
TRUE = ["true", "1", "t", "yes"]
#: fixed values: strptime's directives that a format may hold, with the text that each reads
DIRECTIVES = {
    "%Y": r"(?!0000)[0-9]{4}",
    "%m": "1[0-2]|0[1-9]|[1-9]",
    "%d": "3[01]|[12][0-9]|0[1-9]|[1-9]",
    "%H": "2[0-3]|[01][0-9]|[0-9]",
    "%M": "[0-5][0-9]|[0-9]",
    "%S": "[0-5][0-9]|[0-9]",
    "%f": "[0-9]{1,6}",
}
#: what a format without a directive leaves it at
_UNSAID = {"%Y": "1900", "%m": "1", "%d": "1", "%H": "0", "%M": "0", "%S": "0", "%f": "0"}
#: numbers as text: digits in groups, a fraction, an exponent
_DIGITS = r"[0-9]+(_[0-9]+)*"
_PLAIN = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})$"
NUMBER = rf"^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
#: most numbers, in a form without groups, which is looked for first as it takes less time
_USUAL = r"^[+-]?[0-9]+(?:\.[0-9]+)?$"
#: by a rule, decimal digits of all scripts but ASCII, and their ASCII digits
_OTHER_DIGITS = "".join(chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd")
_THEIR_DIGITS = "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS)


def date_pattern(fmt: str) -> tuple[str, str]:
    """A strptime format as a pattern, and the same value in ISO form with the pattern's groups;
    other directives, and a directive that comes twice, are refused. Blanks read blanks of any
    number, letters any case."""
    out, groups, i = "", {}, 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in DIRECTIVES and two not in groups:
            groups[two] = f"${len(groups) + 1}"
            out, i = out + f"({DIRECTIVES[two]})", i + 2
        elif fmt[i] == "%":
            raise ValueError(f"directive {two} is not supported, or comes twice")
        elif fmt[i].isspace():
            while i < len(fmt) and fmt[i].isspace():
                i += 1
            out += r"\s+"
        else:
            out, i = out + (fmt[i] if fmt[i].isalnum() else "\\" + fmt[i]), i + 1
    said = _UNSAID | groups
    return f"(?iU)^{out}$", f"{said['%Y']}-{said['%m']}-{said['%d']} {said['%H']}:{said['%M']}:{said['%S']}.{said['%f']}"


def java_regex(pattern: str) -> str:
    """A pattern anchored at the start, with Unicode classes."""
    return "(?U)^(?:" + pattern.replace("(?P<", "(?<") + ")"


#: types whose text has no blanks; told when the plan is made, at no cost to rows
_BARE = "^(tinyint|smallint|int|bigint|decimal.*|float|double|date|timestamp.*|boolean)$"


def strip(c: Column) -> Column:
    """Text without blanks at its ends. Text whose first and last characters are visible ASCII ones
    has none, and needs no search for each of them."""
    s = c.cast("string")
    bare = F.substring(s, 1, 1).between("!", "~") & F.substring(s, -1, 1).between("!", "~")
    return F.when(F.typeof(c).rlike(_BARE) | bare, s).otherwise(F.btrim(s, F.lit(WHITE)))


def text(c: Column) -> Column:
    """Stripped text, null if blank. The NaN of a float or double column is null too; the text
    "NaN" of a feed is a text like any other. ``nullif`` strips once a mention."""
    nan = F.when(F.typeof(c).isin("float", "double"), "NaN")
    return F.nullif(F.nullif(strip(c), F.lit("")), nan)


def is_empty(c: Column) -> Column:
    return text(c).isNull()


@dataclass(frozen=True)
class Value:
    typed: Column
    raw: Column  # the text if it is not of the type, else null

    def shown(self) -> Column:
        return F.coalesce(self.typed.cast("string"), self.raw)

    def part(self) -> Column:
        """One text that is never null: V: and the value, B: and unreadable text, N: for null. The
        value is mentioned once, as a row works it out at every mention."""
        return F.coalesce(F.concat(F.lit("V:"), self.typed.cast("string")), F.concat(F.lit("B:"), self.raw), F.lit("N:"))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it; the generated code
    has it once as well."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chosen(items: list[tuple[Column, Column]], kind: str) -> Column:
    """An array (``kind`` is its type) of the items whose condition holds. No function over an array
    is in it, as there is in ``array_compact``: what that holds is not compiled."""
    none = F.array().cast(kind)
    return F.flatten(F.array(*[F.when(there, F.array(item).cast(kind)).otherwise(none) for there, item in items]))


def ascii_digits(s: Column) -> Column:
    """Text with decimal digits of any script as ASCII ones; ASCII text has no others."""
    return F.when(F.octet_length(s) == F.char_length(s), s).otherwise(F.translate(s, _OTHER_DIGITS, _THEIR_DIGITS))


def _day(s: Column, fmt: str) -> Column:
    """A date by its format; the usual form of ISO dates needs no rewriting."""
    slow = _time(s, fmt).cast("date")
    if fmt != "%Y-%m-%d":
        return slow
    return F.coalesce(F.when(s.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), s.try_cast("date")), slow)


def _time(s: Column, fmt: str) -> Column:
    """A time by its format, as the clock shows it: no zone is passed through. What has the
    format's form is rewritten and marked, so that the form is looked for once."""
    pattern, iso = date_pattern(fmt)
    marked = F.regexp_replace(ascii_digits(s), F.lit(pattern), F.lit(iso + "\u0000"))
    return _let(marked, lambda x: F.when(x.endswith("\u0000"), F.rtrim(x, F.lit("\u0000")).try_cast("timestamp_ntz")))


def _ungrouped(s: Column) -> Column:
    """A number's text without the underscores between digits; other text as it is."""
    return F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit(""))).otherwise(s)


def whole_part(s: Column, kind: str) -> Column:
    """A number's digits before the point (cut off, not rounded) as ``kind``; null if the text
    is no number or too large."""
    digits = _ungrouped(s)
    cut = F.regexp_extract(digits, r"^([+-]?[0-9]*)", 1)
    cut = F.when(cut.isin("", "+", "-"), "0").otherwise(cut)
    return F.when(s.rlike(_PLAIN), cut.try_cast(kind)).when(s.rlike(NUMBER), digits.try_cast("decimal(38,18)").try_cast(kind))


def _magnitude(digits: Column) -> Column:
    """Of a number's text: the place of its first digit other than 0, its digits from there to
    its last one other than 0 (none for 0), and whether it is below 0. Numbers of one sign
    compare by place, then digits, at any size."""
    whole, part = (F.regexp_extract(digits, r"^[+-]?([0-9]*)\.?([0-9]*)", i) for i in (1, 2))
    exponent = F.regexp_extract(digits, r"[eE]([+-]?[0-9]+)$", 1)
    far = 1 << 62  # exponents beyond that count as that
    most = F.when(exponent.startswith("-"), -far).otherwise(far)
    shift = F.when(exponent == "", 0).otherwise(F.greatest(F.least(F.coalesce(exponent.try_cast("bigint"), most), F.lit(far)), F.lit(-far)))
    bare = F.ltrim(F.concat(whole, part), F.lit("0"))
    place = F.length(bare) - F.length(part) - 1 + shift
    return F.struct(place.alias("place"), F.rtrim(bare, F.lit("0")).alias("digits"), digits.startswith("-").alias("minus"))


def bound(b: object) -> Decimal:
    """A range's bound; what is no finite number is an error of the contract."""
    try:
        x = Decimal(str(b))
    except ArithmeticError:
        raise ValueError(f"range: {b!r} is no number") from None
    if not x.is_finite():
        raise ValueError(f"range: {b!r} is no number")
    return x


def _against(x: Column, b: Decimal) -> Column:
    """-1, 0 or 1: a number by its magnitude against a bound, exactly."""
    want, at = "".join(map(str, b.as_tuple().digits)).strip("0"), b.adjusted()
    minus = x["minus"] & (x["digits"] != "")
    if not want:
        return F.when(x["digits"] == "", 0).when(minus, -1).otherwise(1)
    size = F.when(x["digits"] == "", -1).when(x["place"] != at, F.when(x["place"] > at, 1).otherwise(-1)).when(x["digits"] == want, 0).when(x["digits"] > want, 1).otherwise(-1)
    return F.when(minus, -size).otherwise(1) if b.is_signed() else F.when(minus, -1).otherwise(size)


def in_range(s: Column, lo: object, hi: object) -> Column:
    """Whether a number is within inclusive bounds, exactly at any size of number and bounds.
    Null if the text is no number."""
    low, high = bound(lo), bound(hi)
    within = lambda x: (_against(x, low) >= 0) & (_against(x, high) <= 0)
    exact = F.when(s.rlike(NUMBER), _let(F.replace(s, F.lit("_"), F.lit("")), lambda digits: _let(_magnitude(digits), within)))
    if not all(x.adjusted() < 20 and x.as_tuple().exponent >= -18 for x in (low, high)):
        return exact
    # short texts are read as decimals, without loss
    short = (F.length(s) < 20) & s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")
    told = s.try_cast("decimal(38,18)").between(*[F.lit(format(x, "f")).cast("decimal(38,18)") for x in (low, high)])
    # the nearest double keeps the order: one strictly within the bounds' own is of a number within
    near = s.try_cast("double")
    return F.when(short, F.when((near > float(low)) & (near < float(high)), True).otherwise(told)).otherwise(exact)


def normalize(c: Column, spec) -> Value:
    """The normal form of ``c`` under the contract column ``spec``."""
    s = text(c)
    if spec.type == "integer":
        typed = F.coalesce(s.try_cast("bigint"), _let(ascii_digits(s), lambda x: whole_part(x, "bigint")))
    elif spec.type == "decimal":
        kind = f"decimal(38,{spec.scale})"
        typed = F.coalesce(s.try_cast(kind), _let(ascii_digits(s), _ungrouped).try_cast(kind))
    elif spec.type == "date":  # a typed date is one already; text must have the declared format
        typed = F.when(F.typeof(c) == "date", s.try_cast("date")).otherwise(_day(s, spec.date_format))
    elif spec.type == "timestamp":  # so is a typed time
        formats = ([spec.ts_format] if spec.ts_format else []) + ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f"]
        typed = F.when(F.typeof(c).startswith("timestamp"), s.try_cast("timestamp_ntz")).otherwise(F.coalesce(*[_time(s, f) for f in formats]))
    elif spec.type == "boolean":
        typed = F.when(s.isNotNull(), F.lower(s).isin(TRUE))
    else:
        typed = s
    return Value(typed, F.when(typed.isNull(), s))


def readable(c: Column, spec) -> Column:
    """Whether populated text has the stricter form that the type rule asks for. Numbers are
    judged by their form, so their size does not matter; NaN and Infinity are no numbers here,
    a deliberate difference, for no decimal column can hold them."""
    s = strip(c)
    if spec.type == "integer":
        return s.rlike("^[+-]?[0-9]+$") | ascii_digits(s).rlike(rf"^[+-]?{_DIGITS}$")
    if spec.type == "decimal":
        return s.rlike(_USUAL) | ascii_digits(s).rlike(NUMBER)
    if spec.type == "date":
        return _day(s, spec.date_format).isNotNull()
    if spec.type == "timestamp":
        return _time(s, spec.ts_format or "%Y-%m-%d %H:%M:%S").isNotNull()
    if spec.type == "boolean":
        return F.lower(s).isin("true", "false", "0", "1")
    return F.lit(True)
