"""Encoding of whole texts by the chunk: what stands between two places where any pre-split breaks.

The byte-level patterns start a new match at every space that is followed by something other than
white space, wherever it stands, so a text may be cut there and each chunk encoded alone. Chunks
repeat (words do), so their ids are kept in a bounded memo; a chunk that is new is split by the pattern
itself, and only matches that are new as well go through the real encoder.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable

import numpy as np

#: Unicode White_Space, as the patterns' \\s has it. Fixed values.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAK = re.compile(f" (?=[^{WHITE}])")
_ODD = re.compile(f" (?:[{WHITE}]|\\Z)")
#: How byte-level vocabularies write a space. Fixed value.
SPACE = "\u0120"
#: Chunks of the memo for each one that is looked up, at most. Looking up reads the whole memo.
WORTH = 64
#: Chunks and pieces that the memos hold at most, new chunks after which a full memo starts anew, and the longest one taken.
CHUNKS, PIECES, STALE, LONGEST = 1_000_000, 250_000, 16_000_000, 48
#: How the byte-level vocabularies split a text before merging. Fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def little_endian(ids: list[int]) -> bytes:
    """Unsigned 32-bit integers as bytes."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def split(text: str) -> list[str]:
    """The chunks of a text; all but the first stand for themselves with a space before."""
    return _BREAK.split(text) if _ODD.search(text) else text.split(" ")


def matcher(pattern: str) -> Callable[[str], list[str]]:
    """findall of a pattern whose \\s is Unicode White_Space, as in the tokenizers' own engines."""
    import regex

    white = r"\p{White_Space}"
    return regex.compile(pattern.replace(r"[^\s", "[^" + white).replace(r"\s", white).replace(r"\S", r"\P{White_Space}")).findall


class ChunkEncoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers.

    ``encode`` does the work for matches of ``pattern`` that are in no memo: a list of strings to a list of bytes.
    The chunks of a block are numbered first, so that each distinct one is looked up once, and ids are gathered by array;
    the memo of chunks is an Arrow column beside one array of ids.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str = BYTE_LEVEL):
        self.encode, self.match = encode, matcher(pattern)
        self._forget()

    def _forget(self) -> None:
        import pyarrow as pa

        self.pieces: dict[str, bytes] = {}
        self.words = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.seen = 0

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and how many each has."""
        cut = [self.match(t) for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.pieces})
        found = dict(zip(new, self.encode(new)))
        room = PIECES - len(self.pieces)
        self.pieces.update((p, found[p]) for p in new[: max(0, room)] if len(p) <= LONGEST)
        known = self.pieces
        return _flat([b"".join([found[p] if p in found else known[p] for p in pieces]) for pieces in cut])

    def spaced(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Likewise of an Arrow column of chunks that each stand after a space and have none."""
        return self.whole([" " + x for x in words.to_pylist()])

    def _table(self, words, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct chunks, by the memo where it has them. ``repeated``: those that the block has more than once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.seen > STALE:
            self._forget()
        if WORTH * len(words) < len(self.words):  # looking few chunks up takes longer than encoding them
            return self.whole([" " + x for x in words.to_pylist()])
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        inner = pc.match_substring(fresh, " ").to_numpy(zero_copy_only=False)
        alone, joined = np.flatnonzero(inner), np.flatnonzero(~inner)
        ids, sizes = self.spaced(fresh.take(pa.array(joined)))
        more, more_sizes = self.whole([" " + x for x in fresh.take(pa.array(alone)).to_pylist()])
        order = np.concatenate([joined, alone])
        at[new[order]] = len(self.sizes) + np.arange(new.size)
        ids, sizes = np.concatenate([self.ids, ids, more]), np.concatenate([self.sizes, sizes, more_sizes])
        out = _gather(ids, sizes, at), sizes[at]
        self.seen += new.size
        # Half of the memo is for chunks that a block has more than once.
        keep = (pc.utf8_length(fresh).to_numpy() <= LONGEST)[order]
        keep &= repeated[new[order]] if len(self.words) > CHUNKS // 2 else True
        keep = np.flatnonzero(keep)[: max(0, CHUNKS - len(self.words))]
        if keep.size:
            self.words = pa.concat_arrays([self.words, fresh.take(pa.array(order[keep]))])
            own = np.concatenate([np.arange(len(self.sizes)), len(self.sizes) + keep])
            self.ids, self.sizes = _gather(ids, sizes, own), sizes[own]
        return out

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = list(texts)
        if not texts:
            return []
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        there = set(odd)
        plain = [i for i in range(len(texts)) if i not in there] if odd else range(len(texts))
        cut = [_BREAK.split(texts[i]) for i in odd]
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        values = pa.concat_arrays([lists.flatten(), pa.array([x for parts in cut for x in parts], pa.large_string())])
        counts = np.concatenate([pc.list_value_length(lists).to_numpy(), np.array([len(x) for x in cut], np.int64)]).astype(np.int64)
        stops = np.cumsum(counts)
        first = np.zeros(len(values), bool)
        first[stops - counts] = True
        coded = values.filter(pa.array(~first)).dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        ids, sizes = self._table(words, np.bincount(index, minlength=len(words)) > 1)
        more, more_sizes = self.whole(values.filter(pa.array(first)).to_pylist())
        place = np.empty(len(values), np.int64)
        place[~first] = index
        place[first] = len(words) + np.arange(len(texts))
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, more_sizes])
        ends = np.cumsum(sizes[place])[stops - 1]
        ids = _gather(ids, sizes, place)
        out: list[bytes] = [b""] * len(texts)
        at = 0
        for i, stop in zip([*plain, *odd], ends.tolist()):
            out[i] = ids[at:stop].tobytes()
            at = stop
        return out


def _flat(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(items), "<u4"), np.fromiter(map(len, items), np.int64, len(items)) >> 2


def _gather(ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that ``sizes`` tells apart, in the order of ``index``."""
    own = sizes[index]
    shift = (np.cumsum(sizes) - sizes)[index] - np.cumsum(own) + own
    return ids[np.repeat(shift, own) + np.arange(own.sum())]


class AddedTokens:
    """Texts to ids where strings of the vocabulary's added tokens stand for one id each, as the tokenizers library has it.

    A text is cut at them, the leftmost and longest first; what stands between is encoded as texts of its own.
    """

    def __init__(self, encode: Callable[[Iterable[str]], list[bytes]], added: dict[str, int]):
        self.encode = encode
        self.ids = {t: little_endian([i]) for t, i in added.items()}
        self.find = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")").split if added else None

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        if self.find is None:
            return self.encode(texts)
        texts = list(texts)
        where = [i for i, t in enumerate(texts) if any(x in t for x in self.ids)]
        if not where:
            return self.encode(texts)
        cut = [self.find(texts[i]) for i in where]
        for i in where:
            texts[i] = ""
        between = [x for parts in cut for x in parts[::2]]
        got = self.encode(texts + between)
        out, rest = got[: len(texts)], iter(got[len(texts) :])
        for i, parts in zip(where, cut):
            out[i] = b"".join([self.ids[x] if k % 2 else next(rest) for k, x in enumerate(parts)])
        return out


class LibraryEncoder(ChunkEncoder):
    """Chunks by a byte-level tokenizer of the tokenizers library, which splits them itself.

    A chunk after a space begins with a token that has that space, and no other of its tokens does: many
    chunks are encoded as one text and told apart by those tokens.
    """

    JOINED = 1 << 16

    def __init__(self, tokenizer):
        super().__init__(lambda pieces: [])
        self.tokenizer = tokenizer
        self.opens = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token[0] == SPACE

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([little_endian(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def spaced(self, words) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.zeros(0, "<u4")]
        for at in range(0, len(words), self.JOINED):
            (e,) = self.tokenizer.encode_batch_fast([" " + " ".join(words.slice(at, self.JOINED).to_pylist())], add_special_tokens=False)
            parts.append(np.array(e.ids, "<u4"))
        ids = np.concatenate(parts)
        starts = np.flatnonzero(self.opens[ids])
        if starts.size != len(words) or (starts.size and starts[0]):
            raise RuntimeError("the tokenizer doesn't keep chunks apart")
        return ids, np.diff(starts, append=ids.size)


_CACHE: dict[str, AddedTokens] = {}


def tokenizers_encoder(path: str) -> AddedTokens:
    """An encoder by the tokenizers library, kept for later tasks of the same worker.

    Strings of added tokens in a text become their ids, as the library does without further settings.
    """
    if path not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in own.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that take their surroundings in are not supported")
        own.encode_special_tokens = True  # the pieces below have none

        _CACHE[path] = AddedTokens(LibraryEncoder(own), {t: i for t, (i, _) in added.items()})
    return _CACHE[path]


def blocks(column, size: int = 1 << 22):
    """(start, texts) runs of an Arrow string column of about ``size`` characters; null counts as empty."""
    texts, start, n = [], 0, 0
    for i, x in enumerate(column):
        texts.append(x.as_py() or "")
        n += len(texts[-1])
        if n >= size:
            yield start, texts
            texts, start, n = [], i + 1, 0
    if texts:
        yield start, texts
