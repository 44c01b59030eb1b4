"""Column functions shared by the operators. All are built-in expressions, so plans stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the log format's own trim has it (Java's \s lacks the last ones). Fixed values.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
HEAD, PREVIEW = 220, 80


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.call_function("div", F.unix_micros(F.to_timestamp_ltz(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))), F.lit(1000)).cast("long")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return F.call_function("div", F.octet_length(F.encode(text, "UTF-16BE")), F.lit(2)).cast("long")


def head(text: Column, size: int = HEAD) -> Column:
    """White space collapsed and trimmed, then at most ``size`` characters (basic-plane text)."""
    flat = F.regexp_replace(text, SPACE + "+", " ")
    return F.substring(F.trim(flat), 1, size)


def context(text: Column, at: Column, size: Column | int, width: int = PREVIEW) -> Column:
    """What stands around a hit of ``size`` characters at 1-based ``at``: about ``width`` characters, white space collapsed, ellipses where text is left out."""
    size = F.lit(size) if isinstance(size, int) else size
    half = F.call_function("div", F.greatest(F.lit(0), F.lit(width) - size), F.lit(2)).cast("int")
    start, stop = F.greatest(F.lit(1), at - half), at + size + half
    mark = lambda cut: F.when(cut, F.lit("…")).otherwise(F.lit(""))
    return F.concat(mark(start > 1), F.regexp_replace(F.substring(text, start, stop - start), SPACE + "+", " "), mark(stop <= F.length(text)))


def model_key(raw: Column) -> Column:
    """A recorded model name as a rate key: prefix, context suffix and date off, old ids with the family first."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "^claude-", ""), r"\[1m\]$", ""), r"-[0-9]{8}$", "")
    return F.regexp_replace(F.regexp_replace(bare, "^3-([0-9])-(haiku|sonnet|opus)$", "$2-3-$1"), "^3-(haiku|sonnet|opus)$", "$1-3")


def poison_sum(x: Column) -> Column:
    """A sum that one unknown makes unknown; the sum of nothing is 0."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.coalesce(F.sum(x), F.lit(0)))


def decoded_bytes(base64: Column) -> Column:
    """Bytes that a base64 text stands for, line ends and padding counted off, without decoding it."""
    return F.floor(F.length(F.rtrim(F.translate(base64, "\r\n", ""), F.lit("="))) * 3 / 4).cast("long")


def dollars(tcu: Column) -> Column:
    """Integer money units as dollars and four decimals, rounded half up, as text."""
    tenths = F.call_function("div", F.abs(tcu) + 100_000, F.lit(200_000))
    sign = F.when(tcu < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.call_function("div", tenths, F.lit(10_000)).cast("string"), F.lit("."), F.lpad((tenths % 10_000).cast("string"), 4, "0"))
