"""Column expressions on text cells: cleaning, type tests and typed values.

Numbers may carry thousands commas, which are all removed before a test, and a
sign; leading zeros count as numbers.  An integer of more than 18 digits stays
text, for it may not fit a BIGINT.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER, REAL = r"^[+-]?[0-9]{1,18}$", r"^[+-]?[0-9]+\.[0-9]+$"
# The accepted date and datetime shapes, fields padded or not, each with the text that has it.
_D, _S, _HM, _HMS = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", r"[0-9]{1,2}:[0-9]{1,2}", r"[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
DATES = {"yyyy-M-d": _D, "yyyy/M/d": _S}
DATETIMES = {"yyyy-M-d H:m:s": f"{_D} {_HMS}", "yyyy-M-d'T'H:m:s": f"{_D}T{_HMS}", "yyyy-M-d H:m": f"{_D} {_HM}", "yyyy-M-d'T'H:m": f"{_D}T{_HM}", "yyyy/M/d H:m:s": f"{_S} {_HMS}", "yyyy/M/d H:m": f"{_S} {_HM}"}


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, where a lambda would work it out again for each element."""
    return F.transform(F.array(value), use)[0]


def glob(c: Column, pattern: str) -> Column:
    """Whether a text matches a pattern whole: ``*`` any characters, ``?`` one, ``[a-c]`` one of a class, ``[^a]`` one that isn't; case counts.

    A ``]`` right after the opening is one of the class; an opening without an end matches nothing.
    """
    out, i = "", 0
    while i < len(pattern):
        x = pattern[i]
        i += 1
        if x in "*?":
            out += ".*" if x == "*" else "."
        elif x == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            end = pattern.find("]", i + 1)
            if end < 0:
                return F.when(c.isNotNull(), F.lit(False))
            own = re.sub(r"([\[\]\\&^~|])", r"\\\1", pattern[i:end])
            out += f"[{'^' * negated}{own}]"
            i = end + 1
        else:
            out += re.escape(x)
    return c.rlike(f"(?s)^(?:{out})\\z")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def clean_number(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit(""))


def is_integer(c: Column) -> Column:
    return clean_number(c).rlike(INTEGER)


def is_real(c: Column) -> Column:
    return clean_number(c).rlike(REAL)


def _parsed(c: Column, shapes: dict[str, str]) -> Column:
    """Only a text of a shape is parsed, by that shape alone: a parse that fails costs far more than a match."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{4}[-/]"), F.coalesce(*(F.when(t.rlike(f"^{text}$"), F.try_to_timestamp(t, F.lit(shape))) for shape, text in shapes.items())))


def is_date(c: Column) -> Column:
    return _parsed(c, DATES).isNotNull()


def is_datetime(c: Column) -> Column:
    return _parsed(c, DATETIMES).isNotNull()


def typed(c: Column, kind: str) -> Column:
    """The value of a cell in a column of type ``kind``; blank cells are null."""
    value = F.when(~blank(c), c)
    if kind == "INTEGER":
        return clean_number(value).try_cast("bigint")
    if kind == "REAL":
        return clean_number(value).try_cast("double")
    if kind == "DATE":
        return _parsed(value, DATES).cast("date")
    if kind == "DATETIME":
        return _parsed(value, DATETIMES).cast("timestamp_ntz")
    return F.trim(value)


def clean_text(c: Column) -> Column:
    """NUL and runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"[\x00\s]+", " "))


def clean_cell(c: Column) -> Column:
    """Like ``clean_text``, and a word broken after a hyphen is joined again."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?<=\w)- (?=\w)", "-")


def clean_table_cell(c: Column) -> Column:
    """A detected cell's text: single spaces, words broken after a hyphen joined, none within brackets or before a mark; null is empty."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    # What is replaced, in this order.
    for found, put in ((r"(?U)(?<=\w)-\s+(?=\w)", "-"), (r"(?U)(?<=\w)\.\s+(?=<\w)", "."), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+([,.;:])", "$1")):
        text = F.regexp_replace(text, found, put)
    return text


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def search_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case tokens of two characters or more."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)")), lambda t: F.length(t) >= 2)
    return F.array_except(F.array_distinct(found), F.array(*(F.lit(s) for s in stop)).cast("array<string>"))
