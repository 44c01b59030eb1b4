import hashlib
import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from test_tokens import texts
from tokenizers import Tokenizer

from tallyloom.llm import merge_queue

JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def by_hand(symbols, merges):
    """Merges by their definition: again and again the first place of the least rank."""
    symbols = list(symbols)
    while True:
        ranks = [(merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
        if not ranks:
            return symbols
        _, i = min(ranks)
        symbols[i : i + 2] = [merges[symbols[i], symbols[i + 1]][1]]


def test_queue_gives_what_the_definition_gives():
    rng, own = random.Random(4), merge_queue.load(JSON)
    for _ in range(2000):
        raw = "".join(rng.choice(["a", "ab", "er", "in", "the", "é", "日", " ", "1", "ing", "zz", "\n"]) for _ in range(rng.randint(0, 14))).encode()
        assert own.encode_piece(raw) == by_hand([own.symbols[b] for b in raw], own.merges)


def test_texts_encode_and_decode_as_in_the_library(library):
    end, rng, own = "<|endoftext|>", random.Random(6), merge_queue.load(JSON)
    many = texts(1200, 9) + [end, f"a {end}b", f"{end}{end} ", "", "�", "x" * 5000, " " * 4000]
    many += ["".join(rng.choice([end, " ", "a", "\n", "<|", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    for text, ids in zip(many, own.encode(many)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_any_ids_decode_as_in_the_library(library):
    rng, own = np.random.default_rng(3), merge_queue.load(JSON)
    for _ in range(500):
        ids = rng.integers(0, 50_300, rng.integers(0, 12)).astype("<u4")  # torn characters, ids that nothing has
        assert own.decode(ids.tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_other_kinds_of_tokenizers_are_refused():
    with open(JSON) as f:
        spec = json.load(f)
    with pytest.raises(ValueError):
        merge_queue.Bpe({**spec, "normalizer": {"type": "Lowercase"}})
    with pytest.raises(ValueError):
        merge_queue.Bpe({**spec, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}})


def test_rows(odd, nothing, library):
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, merge_queue.round_trip(odd, JSON).collect())) == sorted(want)
    assert merge_queue.round_trip(nothing, JSON).count() == 0
    back = merge_queue.encode_documents(odd, JSON).select("doc_id", merge_queue.decode(JSON)("ids").alias("text")).collect()
    assert sorted(tuple(r) for r in back) == sorted((r["doc_id"], r["text"] or "") for r in odd.collect())
