"""What a question is asked of: the store, a project, a session, a turn or an agent; and ranges of days."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that the parts of a scope's name stand for.
KINDS = {"store": (), "project": ("slug",), "session": ("slug", "session_id"), "turn": ("slug", "session_id", "turn_idx"), "agent": ("slug", "session_id", "agent_id")}


class BadScope(ValueError):
    """A name that is no scope."""


class UnknownScope(LookupError):
    """A scope that the data has nothing of: it is reported and never answered by an empty result."""


@dataclass(frozen=True)
class Scope:
    kind: str
    parts: tuple

    def filter(self, df: DataFrame) -> DataFrame:
        """Rows of the scope; the columns that its parts stand for are partition columns or few, so the filter goes down to the scan."""
        for column, value in zip(KINDS[self.kind], self.parts):
            df = df.where(F.col(column) == F.lit(value))
        return df


def parse(text: str | None) -> Scope:
    """``store``, ``project:slug``, ``session:slug/id``, ``turn:slug/id/number`` or ``agent:slug/id/agent``, percent-encoded parts."""
    if not text or text == "store":
        return Scope("store", ())
    kind, colon, rest = text.partition(":")
    if not colon or kind not in KINDS or kind == "store":
        raise BadScope(text)
    parts = [unquote(p, errors="strict") for p in rest.split("/")]
    if len(parts) != len(KINDS[kind]) or "" in parts:
        raise BadScope(text)
    if kind in ("session", "turn", "agent"):
        parts[1] = parts[1].lower()
    if kind == "turn":
        if not parts[2].isascii() or not parts[2].isdigit():
            raise BadScope(text)
        parts[2] = int(parts[2])
    return Scope(kind, tuple(parts))


def within(df: DataFrame, text: str | None) -> DataFrame:
    """Rows of the scope; UnknownScope if there are none at all."""
    scope = parse(text)
    out = scope.filter(df)
    if scope.parts and out.isEmpty():
        raise UnknownScope(text)
    return out


def date_range(first: str | None, last: str | None) -> tuple[str | None, str | None, list[str]]:
    """The bounds that can be applied, and what is wrong with the others. A reversed range is reported and not applied."""
    def day(name: str, value: str | None) -> str | None:
        if not value:
            return None
        try:
            if datetime.date.fromisoformat(value).isoformat() == value:
                return value
        except ValueError:
            pass
        bad.append(f"{name}: {value}")
        return None

    bad: list[str] = []
    a, b = day("from", first), day("to", last)
    if a and b and a > b:
        bad.append(f"from/to: {a} > {b}")
        a = b = None
    return a, b, bad


def in_days(df: DataFrame, day: str, first: str | None, last: str | None) -> tuple[DataFrame, list[str]]:
    """Rows whose day is in the range, and what was wrong with the range."""
    a, b, bad = date_range(first, last)
    if a:
        df = df.where(F.col(day) >= a)
    if b:
        df = df.where(F.col(day) <= b)
    return df, bad
