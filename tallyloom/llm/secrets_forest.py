"""Secret scans: wide candidate search, then a random forest that removes false positives.

A candidate is a run of at least LEAST characters that keys are written in, with a digit or mixed
case; a sign of assignment ends what stands before it, so that in NAME=VALUE the name is a neighbour. The forest sees its length, character transitions, entropy, the share of it that dictionary
words cover, whether it reads like a path, and the words beside it. It is trained from labelled
findings (candidate, words before, words after, secret or not); where the caller has none of his own,
``labelled_findings`` writes them down by rule from a seed.

Defined results: null and empty texts have no candidates; repeated rows give repeated findings;
candidates of any length are judged whole; a score of exactly the threshold is a secret; other columns are not looked at.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TREES, DEPTH, LEAF, SEED = 16, 40, 9, 3, 11
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.\-]{16,}={0,2}")
_KEYWORDS = re.compile(r"key|token|secret|passw|pwd|api|auth|credential|bearer|private", re.I)
_DECOYS = re.compile(r"example|sample|test|dummy|placeholder|commit|sha|hash|digest|uuid|version|id\b|path|file|url", re.I)
#: Words for dictionary coverage besides those of the findings. Fixed values.
WORDS = "access account admin application archive assets backend backup build cache client cloud code config content control core data database default deploy document download engine error event example export external feature file filter format frontend function handler header helper hidden image import index input install internal interface item language layout library license list local locale login main manager mapping master message method migration model module name network node number object option order output package page panel parser password path pattern plugin policy private process product profile project provider public query queue reader record release report request resource response result router sample schema schedule script search secret section security select server service session setting shared simple source spec static status storage stream string style submit summary support system table target task template test text theme token tools total update upload user utility validate value version video view visual window worker writer".split()
NAMES = ("length", "upper", "lower", "digits", "other", "transitions", "entropy", "hex", "coverage", "slashes", "dots", "extension", "dashes", "underscores", "keyword", "decoy", "assigned", "quoted", "distinct", "longest_letters")


def features(candidate: str, before: str, after: str) -> list[float]:
    """The numbers of NAMES for a candidate and some text on either side."""
    n = len(candidate)
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in candidate]
    counts = Counter(candidate)
    letters = re.findall(r"[A-Za-z]+", candidate)
    covered, low = 0, candidate.lower()
    for run in re.findall(r"[a-z]+", low):
        i = 0
        while i < len(run):
            size = next((k for k in range(min(13, len(run) - i), 3, -1) if run[i : i + k] in _DICTIONARY), 0)
            covered += size
            i += size or 1
    share = lambda k: kinds.count(k) / n
    return [
        float(n), share("u"), share("l"), share("d"), share("o"),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", candidate))),
        covered / n,
        float(candidate.count("/")), float(candidate.count(".")),
        float(bool(re.search(r"\.[a-z]{1,5}$", candidate))),
        float(candidate.count("-")), float(candidate.count("_")),
        float(bool(_KEYWORDS.search(before))), float(bool(_DECOYS.search(before + " " + after))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in ("'", '"')),
        len(counts) / n,
        max(map(len, letters), default=0) / n,
    ]


_DICTIONARY = frozenset(WORDS)


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays; a leaf points to itself, so that DEPTH + 1 steps end every walk."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                above = x[rows, self.feature[t][node]] > self.threshold[t][node]
                node = np.where(above, self.right[t][node], self.left[t][node])
            total += self.value[t][node]
        return total / max(1, len(self.feature))


def train(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, seed: int = SEED) -> Forest:
    """Bootstrap trees by Gini gain, a random third of the features at each node."""
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        nodes: list[list] = []

        def grow(rows: np.ndarray, depth: int, nodes=nodes) -> int:
            me = len(nodes)
            p = float(y[rows].mean())
            nodes.append([0, np.inf, me, me, p])
            if depth == DEPTH or rows.size < 2 * LEAF or p in (0.0, 1.0):
                return me
            best = (1e-9, None, None)
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                k = np.arange(1, rows.size)
                left, right = ones[:-1] / k, (ones[-1] - ones[:-1]) / (rows.size - k)
                gain = p * (1 - p) - (k * left * (1 - left) + (rows.size - k) * right * (1 - right)) / rows.size
                gain[(v[1:] == v[:-1]) | (k < LEAF) | (rows.size - k < LEAF)] = 0
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, (v[i] + v[i + 1]) / 2)
            if best[1] is not None:
                above = x[rows, best[1]] > best[2]
                nodes[me][:2] = best[1:]
                nodes[me][2] = grow(rows[~above], depth + 1)
                nodes[me][3] = grow(rows[above], depth + 1)
            return me

        grow(rng.integers(0, len(x), len(x)), 0)
        grown.append(nodes)
    size = max(map(len, grown))
    cols = [np.array([[n[c] for n in t] + [fill] * (size - len(t)) for t in grown], kind) for c, fill, kind in ((0, 0, np.int64), (1, np.inf, float), (2, 0, np.int64), (3, 0, np.int64), (4, 0.0, float))]
    return Forest(*cols)


def labelled_findings(n: int = 3_000, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(candidate, before, after, 1 for a secret) written down by rule: keys of usual shapes, and what is mistaken for them."""
    rng = random.Random(seed)
    alnum, hexa = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    text = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(WORDS)
    plain = lambda: " ".join(rng.choice(["of", "the", "was", "and", word()]) for _ in range(4)) + " "
    out = []
    for i in range(n):
        if i % 2:
            body = rng.choice([lambda: text(hexa, rng.choice([32, 40, 64])), lambda: text(alnum, rng.randint(20, 48)), lambda: "AK" + text(alnum[26:], 18), lambda: text(alnum + "+/", 40) + "=", lambda: rng.choice(["sk_live_", "pk_", "ghx_", "xox-"]) + text(alnum, 30)])()
            name = rng.choice(["token", "api_key", "secret", "password", "auth", "private_key", "access key"])
            before = plain() + rng.choice([f'{name} = "', f"{name}: ", f"{name}='", f"{name.upper()}=", f"{name} "])
            out.append((body, before, '" ' + plain(), 1))
        else:
            sep = rng.choice(["/", "_", "-", ".", ""])
            many = [word() for _ in range(rng.randint(3, 6))]
            joined = sep.join(many if sep else [many[0], *(w.title() for w in many[1:])])
            body = rng.choice([lambda: joined, lambda: joined + rng.choice([".py", ".html", ".json", "2", "_v1"]), lambda: text(hexa, 40), lambda: "-".join(text(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: text("0123456789", rng.randint(16, 24)), lambda: rng.choice("xX0-_=.") * rng.randint(16, 30), lambda: rng.choice(WORDS).title() * 3 + "1"])()
            before = plain() + rng.choice(["commit ", "sha256 ", "see path ", "uuid: ", "file ", "example ", "", ""])
            out.append((body.ljust(LEAST, "1"), before, " " + plain(), 0))
    return out


def fit(findings: list[tuple[str, str, str, int]]) -> Forest:
    x = np.array([features(c, b[-40:], a[:20]) for c, b, a, _ in findings], float)
    return train(x, np.array([y for *_, y in findings], float))


def candidates(text: str):
    """(start, end) of candidates, outer punctuation left out."""
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-":
            b -= 1
        while a < b and text[a] in ".-":
            a += 1
        own = text[a:b]
        if b - a >= LEAST and (any(c.isdigit() for c in own) or (own != own.lower() and own != own.upper())):
            yield a, b


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points), score and ``secret`` of every candidate of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, x = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                t = text.as_py() or ""
                for a, b in candidates(t):
                    rows.append((doc, a, b))
                    x.append(features(t[a:b], t[max(0, a - 40) : a], t[b : b + 20]))
            score = forest.scores(np.array(x, float).reshape(-1, len(NAMES)))
            ids, starts, ends = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "start", "end", "score", "secret"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, start long, end long, score double, secret boolean")
