"""Byte-level BPE by longest match with backtracking.

Bytes become Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds
every token in a piece of text in one pass. A token sequence is the result of the
merges exactly when each adjacent pair is what the merges make of its own bytes. So the
encoder takes the longest token at each position. Where two neighbours do not agree, it
tries shorter ones and steps back when none is left. A position that led nowhere is never
tried again, and pair answers are memoised, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import canonical
from .tokens import chunks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pieces and chunks of texts a worker remembers before it starts anew; twice as many pairs of tokens.
MEMO = 200_000
BATCH = 256


def rank_file(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def read_ranks(name: str) -> dict[bytes, int]:
    with open(rank_file(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """Tokens of a short piece by the merges of ranks under ``below``: the lowest first, the leftmost of equals."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Memo(dict):
    """Answers of a function, asked once each; starts anew beyond a limit."""

    def __init__(self, function, limit: int) -> None:
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) > self.limit:
            self.clear()
        found = self[key] = self.function(key)
        return found


class Decoder:
    """The bytes of every id, end to end; a megabyte where a codec has many."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {r: t for t, r in ranks.items()}
        self.sizes = np.zeros(max(found) + 1, np.int64)
        for r, t in found.items():
            self.sizes[r] = len(t)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(found.get(r, b"") for r in range(len(self.sizes))), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, as an array."""
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.arange(sizes.sum()) + np.repeat(self.starts[ids] - before, sizes)]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: str = RANKS, pattern: str | None = None, memo: int = MEMO) -> None:
        if pattern is None:
            import public_tokenizers
            pattern = public_tokenizers.PATTERN
        self.ranks = read_ranks(ranks)
        self.split = regex.compile(pattern).findall
        self.whole = {t.decode("latin-1"): [r] for t, r in self.ranks.items()}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        #: The two tokens that a token's last merge joins.
        self.halves: dict[int, tuple[int, int]] = {}
        for t, r in self.ranks.items():
            parts = merge(t, self.ranks, r)
            if len(parts) == 2:
                self.halves[r] = self.ranks[parts[0]], self.ranks[parts[1]]
            if len(parts) < 3:  # others never come out of merges inside a piece
                self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        #: The longest token that a token starts with.
        self.shorter: dict[int, int] = {}
        for r, t in self.bytes.items():
            k = next((k for k in range(len(t) - 1, 0, -1) if t[:k].decode("latin-1") in self.automaton), 0)
            if k:
                self.shorter[r] = self.ranks[t[:k]]
        self.agree = _Memo(self._agree, 2 * memo)
        self.pieces = _Memo(self._piece, memo)
        self.chunks = _Memo(self._chunk, memo)
        self.decoder = Decoder(self.ranks)
        self.size = self.decoder.sizes.tolist()

    def _agree(self, pair: tuple[int, int]) -> bool:
        """Whether the merges turn the bytes of two tokens into just these two.

        They do unless some merge across the seam comes before the merges that seal both
        sides. So the merges are undone from the latest on, and at each step the tokens then
        at the seam must have no earlier merge of their own.
        """
        ranks, raw, halves, (left, right), limit = self.ranks, self.bytes, self.halves, pair, 1 << 62
        while True:
            if ranks.get(raw[left] + raw[right], limit) < limit:
                return False
            # of equal ranks the left one merges first, so it is undone last
            late = max((x for x in (left, right) if x in halves), default=None)
            if late is None:
                return True
            if late == right:
                limit, right = right + 1, halves[right][0]
            else:
                limit, left = left, halves[left][1]

    def _piece(self, match: str) -> list[int]:
        """Ids of one match of the split pattern."""
        text = match.encode().decode("latin-1")
        known = self.whole.get(text)
        if known is not None:
            return known
        n, size, agree, shorter = len(text), self.size, self.agree, self.shorter
        longest = [0] * n
        for end, rank in self.automaton.iter(text):
            longest[end + 1 - size[rank]] = rank  # ends come in order, so the longest is last
        out: list[int] = []
        at, rank, dead = 0, longest[0], bytearray(n + 1)
        while at < n:
            while rank is not None and (dead[at + size[rank]] or out and not agree[out[-1], rank]):
                rank = shorter.get(rank)
            if rank is None:
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                rank = shorter.get(last)
                continue
            out.append(rank)
            at += size[rank]
            rank = longest[at] if at < n else None
        return out

    def _chunk(self, text: str) -> bytes:
        return array("i", chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks(text))), np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, as an array."""
        return self.decoder.decode(ids)


_CODECS: dict[tuple, Codec] = {}


def codec(ranks: str, pattern: str | None) -> Codec:
    """The worker's codec."""
    if (ranks, pattern) not in _CODECS:
        _CODECS[ranks, pattern] = Codec(ranks, pattern)
    return _CODECS[ranks, pattern]


_DECODERS: dict[str, Decoder] = {}


def decoder(ranks: str) -> Decoder:
    """The worker's decoder."""
    if ranks not in _DECODERS:
        _DECODERS[ranks] = Decoder(read_ranks(ranks))
    return _DECODERS[ranks]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH):
            yield batch.slice(k, BATCH)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
           pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. Null and empty texts have no ids; rows stay as they are."""
    def run(batches):
        coder = codec(ranks, pattern)
        for b in _slices(batches):
            ids = [coder.encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])
    return canonical(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """Add the bytes of every id list of a table made by ``encode``; a null list stays null."""
    def run(batches):
        coder = decoder(ranks)
        for b in _slices(batches):
            lists = b.column(b.schema.get_field_index(ids_col))
            text = [None if x is None else coder.decode(x.values.to_numpy()).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.binary())], [*b.schema.names, out])
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, `{out}` binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS,
               pattern: str | None = None, out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one worker: (doc_id, ids array<int>, bytes that the ids decode to).

    Two steps would run two workers per task, and workers that take turns would all come to hold a codec.
    """
    def run(batches):
        coder = codec(ranks, pattern)
        for b in _slices(batches):
            ids = [coder.encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            back = pa.array([coder.decode(i).tobytes() for i in ids], pa.binary())
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), listed, back], ["doc_id", "ids", out])
    return canonical(df, id_col, text_col).mapInArrow(run, f"doc_id long, ids array<int>, `{out}` binary")
