"""STR-4 / STR-5 / MTH-2: best-effort salary text from a description.

Native form: every match of the amount pattern is listed together with the
characters that follow it (a zero-width lookahead capture), the candidates are
tested in order and the first survivor is kept -- the same as a ``finditer``
loop, but as one JVM expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amount patterns, hourly mark, look-ahead widths, digit minimum.
_AMOUNT = r"(\$[\d,]+(?:\.\d+)?[Kk]?)"
_DOLLAR = _AMOUNT + r"(?:\s*(?:--|—|–|-|to)\s*" + _AMOUNT + r"|\+)?"
_HOURLY = r"(?iU)\$[\d,K k]+\s*(?:/\s*h(?:ou?r|r)?)"
_USD = r"([\d,]+)(?:\s*USD)?\s*(?:--|\x{2014}|\x{2013}|-|to)\s*([\d,]+)(?:\s*USD)?"
_DOLLAR_NEXT = 20
_USD_NEXT = 10
_MIN_DIGITS = 4


def digit_count(c: Column) -> Column:
    """MTH-2: number of digits in a match."""
    return F.length(F.regexp_replace(c, r"(?U)[^\d]", ""))


def _candidates(text: Column, pattern: str, nxt: int) -> Column:
    """array<struct<m, after>>: each match and the next ``nxt`` characters."""
    p = f"(?isU){pattern}(?=(.{{0,{nxt}}}))"
    full = F.regexp_extract_all(text, F.lit(p), 0)
    after = F.regexp_extract_all(text, F.lit(p), 3)
    return F.arrays_zip(full.alias("m"), after.alias("after"))


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))["m"]


def dollar_salary(text: Column) -> Column:
    """STR-4: first '$' amount or range that is not hourly and has >= 4 digits."""
    ok = F.filter(
        _candidates(text, _DOLLAR, _DOLLAR_NEXT),
        lambda z: ~F.concat(z["m"], z["after"]).rlike(_HOURLY) & (digit_count(z["m"]) >= _MIN_DIGITS),
    )
    return F.trim(_first(ok))


def usd_salary(text: Column) -> Column:
    """STR-5: 'a - b' with 'usd' within the match + 10 characters."""
    ok = F.filter(
        _candidates(text, _USD, _USD_NEXT),
        lambda z: F.lower(F.concat(z["m"], z["after"])).contains("usd") & (digit_count(z["m"]) >= _MIN_DIGITS),
    )
    return F.trim(_first(ok))


def extract_salary(description: Column) -> Column:
    """STR-4 then STR-5 on the description with '*' removed; NULL if blank."""
    text = F.regexp_replace(description, r"\*", "")
    found = F.coalesce(dollar_salary(text), usd_salary(text))
    return F.when(F.coalesce(description, F.lit("")) == "", F.lit(None).cast("string")).otherwise(found)
