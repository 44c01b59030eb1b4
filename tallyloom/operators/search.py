"""Search in recorded text: substring and pattern, with a context window and a resumable cursor."""

from __future__ import annotations

import base64
import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import context
from tallyloom.operators.tables import after


class UnsafePattern(ValueError):
    """A pattern with an unbounded repeat inside another, which may take exponential time."""


#: What a pattern is made of, as far as repeats go: escaped characters and classes are single atoms.
_PARTS = re.compile(r"\\.|\[[^\]]*\]|\{[0-9]+,\}|.", re.DOTALL)


def _unbounded(part: str) -> bool:
    return part in ("*", "+") or part.startswith("{") and len(part) > 1


def check_pattern(pattern: str) -> None:
    """Refuse what can't be compiled and what repeats, without bound, a group that itself repeats without bound inside."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise UnsafePattern(f"not a pattern: {e}") from e
    parts = _PARTS.findall(pattern)
    inside = [False]
    for part, then in zip(parts, [*parts[1:], ""]):
        if part == "(":
            inside.append(False)
        elif part == ")" and len(inside) > 1:
            repeats = inside.pop()
            if repeats and _unbounded(then):
                raise UnsafePattern("a repeated group repeats without bound inside")
            inside[-1] |= repeats
        else:
            inside[-1] |= _unbounded(part)


@F.pandas_udf(T.StringType())
def nfc(texts):
    """Canonical composition; there is no built-in. Texts that are ASCII pass through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """A text in canonical composition; only texts that aren't ASCII are sent to Python."""
    return F.coalesce(nfc(F.when(~text.rlike("^\\p{ASCII}*$"), text)), text)


def substring(df: DataFrame, text: str, needle: str, *, ignore_case: bool = True, normalise: bool = False) -> DataFrame:
    """Rows that have the needle, with ``hit`` (1-based) and ``ctx``. The first hit of a text counts."""
    wanted = unicodedata.normalize("NFC", needle) if normalise else needle
    out = df.withColumn("_t", composed(F.col(text)) if normalise else F.col(text))
    where = F.instr(F.lower("_t"), wanted.lower()) if ignore_case else F.instr("_t", wanted)
    out = out.withColumn("hit", where.cast("long")).where("hit > 0")
    return out.withColumn("ctx", context(F.col("_t"), F.col("hit").cast("int"), len(wanted))).drop("_t")


def java_pattern(expression: str, ignore_case: bool = True) -> str:
    """The pattern as the built-in functions take it; case is that of all letters."""
    check_pattern(expression)
    return f"(?iu){expression}" if ignore_case else expression


def pattern(df: DataFrame, text: str, expression: str, *, ignore_case: bool = True, normalise: bool = True) -> DataFrame:
    """Rows that match anywhere in the text, with ``hit`` (the first matched text), ``ctx`` and ``truncated``: false, whole texts are tried."""
    own = java_pattern(expression, ignore_case)
    out = df.withColumn("_t", composed(F.col(text)) if normalise else F.col(text)).where(F.col("_t").rlike(own))
    out = out.withColumn("hit", F.regexp_substr("_t", F.lit(own)))
    at = F.regexp_instr("_t", F.lit(own))
    return out.withColumns({"ctx": context(F.col("_t"), at, F.greatest(F.lit(1), F.length("hit"))), "truncated": F.lit(False)}).drop("_t")


def resume(found: DataFrame, keys: list[str], last: list, most: int = 500) -> DataFrame:
    """The next hits after a cursor, in scan order."""
    return after(found, keys, last, most)


class StaleCursor(ValueError):
    """A cursor whose session or file is no longer there: what was found before it says nothing about what comes after."""


def _scan_order(listing: DataFrame) -> DataFrame:
    """(session_id, _m): the latest change of each session's files, in milliseconds."""
    return listing.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max("mtime").alias("_m"))


def read_cursor(text: str) -> dict:
    try:
        own = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return {"session": str(own["session"]), "file": str(own["file"]), **{k: int(own[k]) for k in ("line", "mtime", "newest")}}
    except (ValueError, KeyError, TypeError) as e:
        raise StaleCursor("not a cursor") from e


def scan(hits: DataFrame, listing: DataFrame, cursor: str | None = None, most: int = 500) -> DataFrame:
    """The next ``most`` hits (session_id, rel, line, kind) in the order of a scan, each with the ``cursor`` to go on from.

    Sessions come latest change first (of ties the least id), in them the main file and then the others by name. ``listing`` has
    session_id, rel, kind and mtime (milliseconds) of now. A cursor has its place, its session's change and the newest change of all files then:
    sessions that stood before it have been searched, and are again only if they changed since. So hits may come twice and none is left out.
    A cursor whose file is gone is refused.
    """
    order = _scan_order(listing)
    newest = order.agg(F.max("_m").alias("_newest"))
    own = hits.join(order, "session_id").crossJoin(F.broadcast(newest)).withColumn("_rest", F.col("kind") != "main")  # one row
    if cursor is not None:
        at = read_cursor(cursor)
        file = listing.where((F.col("session_id") == at["session"]) & (F.col("rel") == at["file"])).select((F.col("kind") != "main").alias("rest")).first()
        if file is None:
            raise StaleCursor("the cursor's session or file is no longer there")
        session, m = F.col("session_id"), F.col("_m")
        before = (m > at["mtime"]) | ((m == at["mtime"]) & (session < at["session"]))
        later_file = F.struct("_rest", "rel") > F.struct(F.lit(file["rest"]), F.lit(at["file"]))
        inside = later_file | ((F.col("rel") == at["file"]) & (F.col("line") > at["line"]))
        own = own.where(F.when(session == at["session"], inside).when(before, m > at["newest"]).otherwise(True))
    own = own.orderBy(F.desc("_m"), "session_id", "_rest", "rel", "line").limit(most)
    state = F.to_json(F.struct(F.col("session_id").alias("session"), F.col("rel").alias("file"), "line", F.col("_m").alias("mtime"), F.col("_newest").alias("newest")))
    text = F.regexp_replace(F.translate(F.base64(F.encode(state, "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    return own.withColumn("cursor", text).drop("_m", "_rest", "_newest")
