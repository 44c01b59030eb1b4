"""Quality rules: a learned decision list over document statistics, in DataFrame functions only.

Learning is sequential covering. The labelled rows are quantised once; every step of growing a
rule is one small aggregate (counts by feature and bin of the rows still uncovered that the rule
matches so far), from which the threshold with the best FOIL gain is taken. The same aggregate
counts a held-back pruning part, so a finished rule is cut back to the prefix that is worth most
there. The list is emitted as one ordered ``CASE`` expression.

Defined results: a null text counts as empty (no words: ``base_failed``); repeated rows and ties
are scored row by row; other columns of the input are not looked at, whatever their names; without usable labels there are no rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

#: White space of the word definition [^\x20\x09-\x0D]+, and the symbols that are counted.
BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Statistics that conditions may name.
FEATURES = (
    "f_words", "f_word_len", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_digits", "f_marks", "f_distinct", "f_words_a_line",
)
#: Quantiles (of all rows, and of the bad ones) between which a feature's thresholds lie, conditions in a rule, rules in a list, and rows a rule must catch in the growing part.
BINS, MAX_CONDITIONS, MAX_RULES, MIN_CAUGHT = 24, 4, 12, 5
#: Share of a rule's pruning rows that must be bad.
MIN_PRECISION = 0.75


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the frame hasn't."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the features.

    Columns of those names in ``df`` are replaced. Words repeated in 3-word windows are found by sorting
    the hashes of a text's windows and comparing neighbours, so the cost is n log n in its words.
    """
    _t, _w, _s, _p, _l = (_unused(df, c) for c in ("text", "words", "windows", "places", "lines"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(_t, t).withColumn(_w, F.array_remove(F.split(F.translate(_t, BLANKS, " " * len(BLANKS)), " "), ""))
    df = df.withColumn("n_words", F.size(_w).cast("long"))
    windows = F.transform(_w, lambda w, i: F.struct(F.xxhash64(w, F.get(_w, i + 1), F.get(_w, i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn(_s, F.when(F.col("n_words") > 3, F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size(_w) - 2, F.lit(0))))))
    again = F.filter(_s, lambda x, i: (F.get(_s, i - 1)["h"] == x["h"]) | (F.get(_s, i + 1)["h"] == x["h"]))
    df = df.withColumn(_p, F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform(_p, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(_p, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn(_l, F.filter(F.split(_t, "\n"), lambda line: F.length(F.translate(line, " " + BLANKS, "")) > 0))
    df = df.withColumns(
        {
            "word_chars": F.length(F.translate(_t, " " + BLANKS, "")).cast("long"),
            "n_symbols": _without(F.col(_t), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size(_l) - F.size(F.array_distinct(_l))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    words, chars, lines = (F.greatest(c, F.lit(1)).cast("double") for c in (F.col("n_words"), F.col("word_chars"), F.size(_l)))
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "f_words": F.col("n_words").cast("double"),
            "f_word_len": F.col("word_chars") / words,
            "f_symbols": F.col("n_symbols") / chars,
            "f_dup_lines": F.col("n_dup_lines") / lines,
            "f_repeats": F.col("n_repeat_words") / words,
            "f_upper": _without(F.col(_t), "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
            "f_digits": _without(F.col(_t), "0123456789") / chars,
            "f_marks": _without(F.col(_t), "!?") / chars,
            "f_distinct": F.size(F.array_distinct(_w)) / words,
            "f_words_a_line": words / lines,
        }
    )
    return df.drop(_t, _w, _s, _p, _l)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass(frozen=True)
class RuleList:
    """Rules in order; a document that one matches is bad, the rest are good."""

    rules: tuple[tuple[Condition, ...], ...]

    def bad(self) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(True)).otherwise(out)
        return out


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts the feature exceeds."""
    above = F.filter(F.array(*map(F.lit, cuts)), lambda cut: F.col(feature) > cut)
    return F.size(above) if cuts else F.lit(0)


def learn(stats: DataFrame, *, bins: int = BINS, max_conditions: int = MAX_CONDITIONS, max_rules: int = MAX_RULES) -> RuleList:
    """A rule list from rows of (doc_id, features, y); y = 1 is good, anything else bad.

    ``stats`` is read once for each condition that is tried, so pass a checkpointed frame. Only
    counts by (feature, bin) come to the driver: at most 8 * bins * len(FEATURES) rows a step.
    """
    shares = [i / (bins + 1) for i in range(bins + 2)]
    of_bad = F.when(F.col("y") != 1, F.lit(True))
    cuts = stats.agg(*(F.percentile_approx(x, shares, 2000).alias(f"{f}{k}") for f in FEATURES for k, x in ((0, F.col(f)), (1, F.when(of_bad, F.col(f)))))).first()
    at = {f: [(a + b) / 2 for a, b in pairwise(sorted({*(cuts[f"{f}0"] or []), *(cuts[f"{f}1"] or [])}))] for f in FEATURES}
    binned = stats.select(
        (F.col("y") != 1).cast("int").alias("bad"),
        (F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2).alias("grow"),
        *FEATURES,
        F.array(*(_bin(f, at[f]) for f in FEATURES)).alias("bins"),
    )

    def counts(rows: DataFrame) -> tuple[dict, dict]:
        """{(feature, bin): [bad, good]} of the growing part; {part: [bad, good]} of both parts."""
        got = (
            rows.select("bad", "grow", F.posexplode("bins").alias("f", "b"))
            .groupBy("grow", "f", "b")
            .agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
            .collect()
        )
        cells, parts = {}, {True: [0, 0], False: [0, 0]}
        for r in got:
            if r["grow"]:
                cells[FEATURES[r["f"]], r["b"]] = (r["bad"], r["n"] - r["bad"])
            if r["f"] == 0:
                parts[r["grow"]][0] += r["bad"]
                parts[r["grow"]][1] += r["n"] - r["bad"]
        return cells, parts

    rules: list[tuple[Condition, ...]] = []
    while len(rules) < max_rules:
        left = binned.where(~RuleList(tuple(rules)).bad()) if rules else binned
        rule: list[Condition] = []
        worth: list[tuple[float, int]] = []  # of each prefix on the pruning part: its precision and bad rows caught
        cells, parts = counts(left)
        while len(rule) < max_conditions and parts[True][1] and parts[True][0] >= MIN_CAUGHT:
            best = _best(cells, parts[True], at)
            if best is None:
                break
            rule.append(best)
            cells, parts = counts(left.where(_all(rule)))
            p, n = parts[False]
            worth.append(((p + 1) / (p + n + 2), p))
        if not rule:
            break
        keep = max(range(len(rule)), key=lambda i: (round(worth[i][0], 2), worth[i][1], -i))
        if worth[keep][0] < MIN_PRECISION:
            break
        rules.append(tuple(rule[: keep + 1]))
    return RuleList(tuple(rules))


def _best(cells: dict, totals: list[int], at: dict) -> Condition | None:
    """The condition of most FOIL gain: bad rows kept times the bits by which it purifies them."""
    p0, n0 = totals
    before = math.log2(p0 / (p0 + n0))
    best, gain = None, 1e-9
    for f in FEATURES:
        p = n = 0
        for b, cut in enumerate(at[f]):
            here = cells.get((f, b), (0, 0))
            p, n = p + here[0], n + here[1]
            for above, (kp, kn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if kp >= MIN_CAUGHT and kp + kn < p0 + n0:
                    g = kp * (math.log2(kp / (kp + kn)) - before)
                    if g > gain:
                        best, gain = Condition(f, above, float(cut)), g
    return best


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = common.FIT_ROWS) -> RuleList:
    """Rules learned from at most ``bound`` labelled documents whose labels may be used."""
    sample = with_statistics(common.labelled_sample(docs, labels, "quality", bound)).select("doc_id", "y", *FEATURES)
    return learn(common.cut(sample))


def judge(docs: DataFrame, rules: RuleList) -> DataFrame:
    """``docs`` with its statistics and ``kept``: not failed by the base test and not matched by a rule.

    A filter on ``kept`` must not be pushed below the steps that compute it: Catalyst would put the sorted
    windows inside the function that runs for each of them, which is quadratic. The row number, always
    true here, makes the step nondeterministic and so keeps filters above it.
    """
    out = with_statistics(docs)
    stays = F.monotonically_increasing_id() >= 0
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rules.bad(), F.lit(False)) & stays)
