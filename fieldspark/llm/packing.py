"""Sequence packing: first-fit decreasing in randomised groups of bounded size.

A document's ids are cut into whole sequences and one remainder. All pieces are dealt to
groups of about ``group`` pieces by a hash; each group packs on its own: remainders, longest first,
go to the first open sequence with room, found in a tournament tree of free space.
Ids stay where they are; only piece lengths move.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import canonical, materialise
from .tokens import VOCABULARY, encoded

LENGTH = 1024
#: Pieces packed together, about.
GROUP = 4096

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
           end: int | None = 0, length: int = LENGTH) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, start, length, ids_crc32, doc_tokens, salt.

    A document with no ids at all (possible only without ``end``) has no piece.
    """
    width = 4 * length

    def run(batches):
        row = 0
        for docs, ids in encoded(batches, vocabulary, end):
            out: list[tuple] = []
            for d, b in zip(docs, ids):
                row += 1
                out += [(d, k // 4, len(b[k:k + width]) // 4, zlib.crc32(b[k:k + width]), len(b) // 4, row)
                        for k in range(0, len(b), width)]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
    return canonical(df, id_col, text_col).mapInArrow(run, _PIECES)


class Tournament:
    """Free space of open sequences; every inner node holds the largest below it."""

    def __init__(self, n: int, room: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.free = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first sequence that has it; its number."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return found


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every size in 1..room; larger first, ties in the given order."""
    tree, bins, offsets = Tournament(len(sizes), room), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        b = tree.place(int(sizes[i]))
        bins[i], offsets[i] = b, filled[b]
        filled[b] += sizes[i]
    return bins, offsets


def assign(found: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = 0) -> DataFrame:
    """Add sequence_id and offset to stored pieces.

    The number of groups follows the number of pieces. Sequence ids are group * 2^32 + bin.
    """
    n = max(1, -(-found.count() // group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["no_id", "doc_id", "start", "ids_crc32", "salt"], ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        out = pdf.drop(columns=["salt", "bucket"])
        return out.assign(sequence_id=(pdf["bucket"].to_numpy() << 32) + bins, offset=offsets)

    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "salt"), F.lit(n)).cast("long")
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, no_id boolean, "
              "sequence_id long, offset long")
    # pandas would turn a column of ids with a null into floats, so the null is a column of its own
    whole = found.withColumns({"bucket": bucket, "no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    placed = whole.groupBy("bucket").applyInPandas(run, schema)
    return placed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
         end: int | None = 0, length: int = LENGTH, group: int = GROUP, seed: int = 0) -> DataFrame:
    """Pieces of every document with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its ``end`` id alone; very long ones are many pieces. Repeated
    rows and null ids are packed like any other row. No documents give no pieces.
    """
    return assign(materialise(pieces(df, id_col, text_col, vocabulary, end, length), "pieces"), length, group, seed)
