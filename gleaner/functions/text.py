"""String column functions (STR-1, STR-2, STR-8, STR-10, STR-14, STR-15,
STR-27, STR-28, LIM-2, FLT-7, STR-29 helpers).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as Python's str.strip() sees it: Java's White_Space
# property plus the four information separators U+001C..U+001F.
_WS = r"[\s\x{1c}-\x{1f}]"
_STRIP_RE = rf"(?U)\A{_WS}+|{_WS}+\z"


def strip(c: Column) -> Column:
    """STR-2: Unicode strip (``trim`` only removes spaces)."""
    return F.regexp_replace(c, _STRIP_RE, "")


def nullif_blank(c: Column) -> Column:
    """NULL when empty after strip, else the value unchanged."""
    return F.when(strip(c) == "", F.lit(None).cast("string")).otherwise(c)


def hash_url(url: Column) -> Column:
    """STR-1: SHA-256 hex of the stripped URL (UTF-8)."""
    return F.sha2(strip(url), 256)


def cut(c: Column, n: int) -> Column:
    """LIM-2: keep the first n characters (text caps 5000 / 500)."""
    return F.substring(c, 1, n)


def collapse_blanks(c: Column) -> Column:
    """STR-10: runs of 2+ blanks/tabs -> one space; 3+ newlines -> two."""
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def collapse_text(c: Column) -> Column:
    """STR-10 full form: collapse, strip, NULL if blank."""
    s = strip(collapse_blanks(c))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


# Characters whose Windows-1252 meaning differs from Latin-1 (0x80-0x9F), in
# code order; 0x81, 0x8D, 0x8F, 0x90 and 0x9D are undefined in Windows-1252.
# Fixed values (the Windows-1252 code page).
_CP1252_FROM = "\u0080\u0082\u0083\u0084\u0085\u0086\u0087\u0088\u0089\u008a\u008b\u008c\u008e" \
               "\u0091\u0092\u0093\u0094\u0095\u0096\u0097\u0098\u0099\u009a\u009b\u009c\u009e\u009f"
_CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ" \
             "‘’“”•–—˜™š›œžŸ"


def repair_cp1252(c: Column) -> Column:
    """STR-8: reread a Latin-1 string as Windows-1252; unchanged as a whole
    when a character has no Latin-1 byte or maps to an undefined code."""
    unmappable = c.rlike("[^\\x{00}-\\x{ff}]|[\\x{81}\\x{8d}\\x{8f}\\x{90}\\x{9d}]")
    return F.when(unmappable, c).otherwise(F.translate(c, _CP1252_FROM, _CP1252_TO))


def decode_basic_entities(c: Column) -> Column:
    """STR-9 native subset: the five XML entities (full decoding is in html.py)."""
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def parse_list(raw: Column, trim_items: bool, lower_items: bool) -> Column:
    """FLT-7: split a ``|`` list; blank input -> NULL (no restriction).

    Roles: trim, keep case. Locations: lower, not trimmed per item (only the
    whole string). Departments / blocklist: trim and lower.
    """
    whole = strip(raw)
    items = F.split(whole, r"\|")
    if trim_items:
        items = F.transform(items, strip)
    if lower_items:
        items = F.transform(items, F.lower)
    items = F.filter(items, lambda x: x != "")
    return F.when(F.coalesce(whole, F.lit("")) == "", F.lit(None).cast("array<string>")).otherwise(items)


def join_distinct_locations(parts: Column) -> Column:
    """STR-14: strip, drop blanks, keep the first of equal values, join ' | '."""
    cleaned = F.filter(F.transform(parts, strip), lambda x: x.isNotNull() & (x != ""))
    joined = F.array_join(F.array_distinct(cleaned), " | ")
    return F.when(F.size(cleaned) > 0, joined)


def us_remote(loc: Column) -> Column:
    """STR-15: bare 'United States' -> 'Remote - United States'."""
    return F.when(strip(loc) == "United States", F.lit("Remote - United States")).otherwise(loc)


def city_state(city: Column, state: Column) -> Column:
    """STR-27: 'city, state' with commas/blanks stripped at both ends."""
    s = F.concat(F.coalesce(city, F.lit("")), F.lit(", "), F.coalesce(state, F.lit("")))
    s = F.regexp_replace(s, r"^[, ]+|[, ]+$", "")
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def requirement_lines(text: Column) -> Column:
    """STR-28: split on newline, strip, drop blanks."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _numbered(odd: str, shown: str):
    return lambda x: F.when(x.rlike(odd), F.format_string(shown, F.ascii(x))).otherwise(x)


def py_repr(c: Column) -> Column:
    """Python ``repr`` of a str (or ``None``), as written into decision lines."""
    esc = F.regexp_replace(c, r"\\", r"\\\\")
    esc = F.regexp_replace(esc, "\n", r"\\n")
    esc = F.regexp_replace(esc, "\r", r"\\r")
    esc = F.regexp_replace(esc, "\t", r"\\t")
    # other control, format and blank characters appear by number
    for shown, low, high in ((r"\x%02x", 0, 0xFF), (r"\u%04x", 0x100, 0xFFFF)):
        odd = rf"[\p{{Cc}}\p{{Cf}}\p{{Zl}}\p{{Zp}}\p{{Zs}}&&[^ ]&&[\x{{{low:x}}}-\x{{{high:x}}}]]"
        esc = F.when(esc.rlike(odd), F.array_join(F.transform(F.split(esc, ""), _numbered(odd, shown)), "")).otherwise(esc)
    dq = F.concat(F.lit('"'), esc, F.lit('"'))
    sq = F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'"))
    use_dq = c.contains("'") & ~c.contains('"')
    return F.when(c.isNull(), F.lit("None")).when(use_dq, dq).otherwise(sq)


def py_list_repr(arr: Column) -> Column:
    """Python ``repr`` of a list of str."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(arr, F.array().cast("array<string>")), py_repr), ", "), F.lit("]"))
