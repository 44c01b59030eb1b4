"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns with their checks. The field then labels the tokens that hold a
digit or an @, and two neighbours on either side, as one of the kinds or none. Neighbouring
tokens share a potential, and so do distant tokens of a document that are equal or alike (the same
last seven digits, or the same address): a number that is written out once as a phone number and later without
its prefix gets one label. Tokens under a base span are observed; the labels of the others come from
loopy belief propagation over all documents of an Arrow batch at once. Runs of tokens that are one
kind with probability SURE or more (TIED for tokens with a tie), and touch no base span, are added to the spans. A number that is
written with spaces is several tokens: each is tied to the last one of the same number elsewhere.

Weights are fitted by pseudo-likelihood on the base labels of a bounded sample of documents (about
FIT_DOCS, chosen by hash), FIT_TOKENS of their tokens at most by a hash of document and place.

Defined results: null texts are empty and have no spans; repeated rows get equal spans; without any
personal data in the sample nothing is added; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents of the fitting sample (about), their tokens at most, least probability of an added token and of one that is tied to another, rounds of message passing.
FIT_DOCS, FIT_TOKENS, SURE, TIED, ROUNDS, DAMP = 6_000, 40_000, 0.9, 0.6, 12, 0.5
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OCTET = re.compile(r"[0-9]{1,3}")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_OUTER = " \t\n\r.,;:!?\"'`<>[]{}#*$%&|"


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Matches of local@domain from the left, found from each @ so that long runs without one cost nothing."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        before = text[free:at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = at = domain.end()
        else:
            free = at = at + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches that pass their checks, in order."""
    if not _HINT.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def _traits(token: str, before: str, after: str) -> list[str]:
    """The observed features of a token."""
    digits, core = _digits(token), token.strip(_OUTER)
    parts = core.split(".")
    return [
        "bias",
        f"digits:{min(len(digits), 20)}",
        f"length:{min(len(core), 40) // 4}",
        f"letters:{any(c.isalpha() for c in core)}",
        f"at:{core.count('@')}:{'.' in core.rpartition('@')[2]}",
        f"plus:{core.startswith('+')}",
        f"open:{core.startswith('(')}{core.endswith(')')}",
        f"dashes:{min(core.count('-'), 3)}",
        f"dots:{min(core.count('.'), 5)}",
        f"octets:{len(parts) == 4 and all(_OCTET.fullmatch(p) and int(p) < 256 for p in parts)}",
        f"luhn:{14 <= len(digits) <= 19 and luhn(digits)}",
        f"before:{bool(_HINT.search(before))}{before[:1] == '+'}{before[:1] == '('}",
        f"after:{bool(_HINT.search(after))}{after[:1] == '('}",
    ]


def _alike(token: str) -> str | None:
    """What distant tokens must share for their labels to be tied."""
    if "@" in token:
        return token.strip(_OUTER).lower()
    digits = _digits(token)
    return digits[-7:] if len(digits) >= 7 else None


def _number_runs(words: list[str], chosen: list[int]) -> dict[int, tuple[str, bool]]:
    """Tokens of numbers that are written with spaces: what ties each to the same number elsewhere, and whether it is the last one."""
    out: dict[int, tuple[str, bool]] = {}
    run: list[int] = []
    for i in [*chosen, -1]:
        part = i >= 0 and any(c.isdigit() for c in words[i]) and not any(c.isalpha() for c in words[i])
        if run and (not part or i != run[-1] + 1):
            digits = _digits("".join(words[j] for j in run))
            if len(run) > 1 and len(digits) >= 7:
                out.update((j, (digits[-7:], j == run[-1])) for j in run)
            run = []
        if part:
            run.append(i)
    return out


@dataclass
class Graph:
    """The tokens of one document that are labelled: spans, traits, base labels (0: none), edges."""

    spans: list
    traits: list
    labels: list
    chain: list
    skip: list


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph:
    tokens = [m.span() for m in _TOKEN.finditer(text)] if _HINT.search(text) else []
    hints = [i for i, (a, b) in enumerate(tokens) if _HINT.search(text, a, b)]
    chosen = sorted({j for i in hints for j in range(max(0, i - 2), min(len(tokens), i + 3))})
    words = [text[a:b] for a, b in tokens] if chosen else []
    spans, traits, labels, chain, skip = [], [], [], [], []
    runs = _number_runs(words, chosen)
    last: dict[str, int] = {}
    at = 0
    for k, i in enumerate(chosen):
        a, b = tokens[i]
        while at < len(base) and base[at][2] <= a:
            at += 1
        covers, k_ = [], at
        while k_ < len(base) and base[k_][0] < b:  # spans of several kinds may overlap, those of one kind don't
            covers += [base[k_][1]] * (base[k_][2] > a)
            k_ += 1
        spans.append((a, b))
        traits.append(_traits(words[i], words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
        labels.append(covers[0] + 1 if covers else 0)
        if k and chosen[k - 1] == i - 1:
            chain.append((k - 1, k))
        whole, ends = runs.get(i, (None, True))
        for key, stands in {_alike(words[i]): True, whole: ends}.items():
            if key in last and last[key] != k:
                skip.append((last[key], k))
            if key and stands:  # of a number in several tokens the last one stands for all
                last[key] = k
    return Graph(spans, traits, labels, chain, skip)


@dataclass(frozen=True)
class Field:
    """Fitted weights: of traits by label, of neighbouring labels, and of labels tied over a distance."""

    names: tuple[str, ...]
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, traits: list[list[str]]) -> np.ndarray:
        index = {n: i for i, n in enumerate(self.names)}
        out = np.zeros((len(traits), len(KINDS) + 1))
        for row, own in zip(out, traits):
            for t in own:
                if t in index:
                    row += self.unary[index[t]]
        return out

    def marginals(self, graphs: list[Graph]) -> list[np.ndarray]:
        """Label probabilities of every graph's tokens, base labels observed, by loopy message passing."""
        width = len(KINDS) + 1
        starts = np.concatenate([[0], np.cumsum([len(g.spans) for g in graphs])]).astype(int)
        unary = self.scores([t for g in graphs for t in g.traits])
        labels = np.array([y for g in graphs for y in g.labels], int)
        seen = labels > 0
        unary[seen] = -30.0
        unary[np.flatnonzero(seen), labels[seen]] = 0.0
        pairs = [(s + a, s + b, kind) for g, s in zip(graphs, starts) for kind, edges in ((0, g.chain), (1, g.skip)) for a, b in edges]
        belief = unary.copy()
        if pairs:
            a, b, kind = np.array(pairs, int).T
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            tables = np.stack([self.chain, self.skip])
            table = np.concatenate([tables[kind], tables[kind].transpose(0, 2, 1)])  # rows: label of the source
            reverse = np.concatenate([np.arange(a.size) + a.size, np.arange(a.size)])
            sent = np.zeros((source.size, width))
            for _ in range(ROUNDS):
                mine = belief[source] - sent[reverse]
                new = np.logaddexp.reduce(mine[:, :, None] + table, axis=1)
                new -= new.max(1, keepdims=True)
                sent = DAMP * sent + (1 - DAMP) * new
                belief = unary.copy()
                np.add.at(belief, target, sent)
        p = np.exp(belief - belief.max(1, keepdims=True)) if len(belief) else belief
        p = p / p.sum(1, keepdims=True) if len(p) else p
        return [p[s:e] for s, e in zip(starts, starts[1:])]


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as (start, kind, end) in order."""
    base = [base_spans(t) for t in texts]
    where = [i for i, t in enumerate(texts) if _HINT.search(t)]
    graphs = [graph(texts[i], base[i]) for i in where]
    out = [(b, b) for b in base]
    for i, g, p in zip(where, graphs, field.marginals(graphs) if graphs else []):
        added, run, chained = [], None, {k for _, k in g.chain}
        tied = {k for edge in g.skip for k in edge}
        for k, ((a, b), y) in enumerate(zip(g.spans, p.argmax(1) if len(p) else [])):
            if y and p[k, y] >= (TIED if k in tied else SURE) and not g.labels[k]:
                run = (run[0], y, b) if run and run[1] == y and k in chained and not texts[i][run[2] : a].strip() else (a, y, b)
                added = added[:-1] + [run] if added and added[-1][0] == run[0] else [*added, run]
            else:
                run = None
        free, at, extra = 0, 0, []  # base spans and added ones both stand in order: one walk over both
        for a, y, b in added:
            while a < b and texts[i][a] in _OUTER:
                a += 1
            while a < b and texts[i][b - 1] in _OUTER:
                b -= 1
            while at < len(base[i]) and base[i][at][0] < b:
                free = max(free, base[i][at][2])
                at += 1
            if a < b and free <= a:
                extra.append((a, int(y) - 1, b))
        out[i] = (base[i], sorted(base[i] + extra))
    return out


def _examples(batches):
    """at (a hash of the document's and the token's place), traits, y, and the labels of the neighbours (chain before, after, and over distance), of each token."""
    import pyarrow as pa
    import xxhash

    names = ["at", "traits", "y", "before", "after", "alike"]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
            t = text.as_py() or ""
            g = graph(t, base_spans(t))
            before, after, alike = [-1] * len(g.spans), [-1] * len(g.spans), [-1] * len(g.spans)
            for a, b in g.chain:
                before[b], after[a] = g.labels[a], g.labels[b]
            for a, b in g.skip:
                alike[a], alike[b] = g.labels[b], g.labels[a]
            at = [xxhash.xxh3_64_intdigest(f"{doc},{a}") - 2**63 for a, _ in g.spans]
            rows += zip(at, g.traits, g.labels, before, after, alike)
        cols = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.string())), *(pa.array(c, pa.int32()) for c in cols[2:])], names=names)


def fit(docs: DataFrame) -> Field:
    """Weights from the base labels of about FIT_DOCS documents, FIT_TOKENS tokens at most."""
    one_in = max(1, docs.count() // FIT_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select(F.xxhash64("doc_id", "text").alias("doc"), "text").where(F.col("text").rlike("[0-9@]"))
    rows = some.mapInArrow(_examples, "at long, traits array<string>, y int, before int, after int, alike int")
    got = rows.orderBy(*rows.columns).limit(FIT_TOKENS).collect()
    return train([(r["traits"], r["y"], r["before"], r["after"], r["alike"]) for r in got])


def train(rows: list, *, steps: int = 400, decay: float = 2e-4) -> Field:
    """Pseudo-likelihood: each token's label given its traits and the labels around it, by gradient steps.

    The base patterns find every copy that is written in full, so a token that only its distant twin gives
    away never has a label. The examples therefore count once more with their traits hidden and their own
    label as their twin's: this is where the weights of distant ties come from. Among these each label counts alike, however
    rare it is.
    """
    k = len(KINDS) + 1
    there = sorted({r[1] for r in rows})
    weight = np.concatenate([np.ones(len(rows)), np.full(len(there), len(rows) / max(1, len(there)))])[:, None]
    rows = rows + [(["bias"], label, -1, -1, label) for label in there]
    names = tuple(sorted({t for r in rows for t in r[0]}))
    index = {n: i for i, n in enumerate(names)}
    m = len(names)
    x = np.zeros((len(rows), m + 3 * k), np.float32)
    y = np.array([r[1] for r in rows], int)
    for row, (traits, _, *around) in zip(x, rows):
        row[[index[t] for t in traits]] = 1
        for j, label in enumerate(around):
            if label >= 0:
                row[m + j * k + label] = 1
    w, speed = np.zeros((m + 3 * k, k)), np.zeros((m + 3 * k, k))
    target = np.eye(k)[y] if len(rows) else np.zeros((0, k))
    for _ in range(steps if len(rows) else 0):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (weight * (p - target)) / weight.sum() + decay * w
        speed = 0.9 * speed - 2.0 * g
        w = w + speed
    before, after, alike = (w[m + j * k : m + (j + 1) * k] for j in range(3))
    chain = (before + after.T) / 2  # rows: the label on the left
    return Field(names, w[:m], chain, (alike + alike.T) / 2)


def _written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (all, written kind:start:end), n_added of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = all_spans([t.as_py() or "" for t in batch.column("text")], field)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in got], pa.string())
            cols = [batch.column("doc_id"), *counts, sha, pa.array([_written(s) for _, s in got], pa.string()), pa.array([len(s) - len(b) for b, s in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans) -> str:
    """The text with every span, or run of overlapping spans, replaced by its (first) kind in brackets."""
    out, free = [], 0
    for a, kind, b in spans:
        if a >= free:
            out += [text[free:a], f"[{KINDS[kind].upper()}]"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def redact(field: Field) -> Column:
    """A function of a text column: the text without its personal data; null stays null."""

    @F.pandas_udf("string")
    def run(texts):
        import pandas as pd

        got = all_spans([t or "" for t in texts], field)
        return pd.Series([t if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, got)])

    return run
