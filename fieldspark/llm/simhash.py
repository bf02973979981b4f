"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by population count. Two fingerprints within
``radius`` bits have population counts within ``radius``, so other tile pairs are
skipped; the rest are compared exactly with exclusive-or and bit counts. A tile pair
returns a spanning forest of the links it found: no link is lost and a dense group costs
one row per member. Work grows with the square of the number of *distinct* fingerprints
that have similar population counts: exact copies collapse first.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from .common import LAST, canonical, fresh, materialise
from .components import connected_components
from .tiles import Forest, compare, tiled

#: Differing bits up to which two fingerprints link.
RADIUS = 4
#: Words per shingle.
SHINGLE = 4
#: Fingerprints per tile.
TILE = 8192
SEED = 42

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16


def shingle_spans(text: str, shingle: int = SHINGLE) -> tuple[bytes, list[int], list[int]]:
    """(lower-cased words joined by spaces, starts, stops) of the word shingles of a whole text."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return b"", [], []
    ends = list(accumulate((len(w) + 1 for w in found), initial=-1))
    return b" ".join(found), [e + 1 for e in ends[:-1]], ends[shingle:] if len(found) >= shingle else ends[-1:]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a whole text; no words: zero."""
    joined, starts, stops = shingle_spans(text, shingle)
    counts, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(stops), _CHUNK):
        h = np.array([h64(joined[a:b], SEED) for a, b in zip(starts[k:k + _CHUNK], stops[k:k + _CHUNK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(stops), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t or "") for t in text], dtype="int64")


def _links(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = [np.asarray(v, np.int64) for v in pdf["codes"]]
        codes = np.concatenate(tiles)
        u, n = codes.view(np.uint64), len(tiles[0])
        other, forest, step = u[n:] if len(tiles) > 1 else u, Forest(len(u)), 16
        shift = n if len(tiles) > 1 else 0
        for k in range(0, n, step):
            near = np.bitwise_count(u[k:min(k + step, n), None] ^ other[None, :]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                forest.add(i + k, j + shift)
        inner = forest.label != np.arange(len(u))
        return pd.DataFrame({"x": codes[inner], "y": codes[forest.label[inner]]})
    return run


def link_fingerprints(codes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning links (x, y) of distinct fingerprints ``code`` that differ in ``radius`` bits or fewer."""
    rows, counts = tiled(codes.withColumn("ones", F.bit_count("code").cast("int")), ["ones"], F.xxhash64("code"), tile)
    tiles = rows.groupBy("ones", "tile").agg(F.collect_list("code").alias("codes"))
    # at most 65 rows of counts
    each = counts.select("ones", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("tile"))
    near = each.select(F.col("ones").alias("a_ones"), F.col("tile").alias("a_tile"),
                       F.explode(F.sequence(F.col("ones"), F.least(F.col("ones") + radius, F.lit(64)))).alias("b_ones"))
    other = counts.select(F.col("ones").alias("b_ones"), F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("b_tile"))
    pairs = near.join(other, "b_ones").filter("a_ones < b_ones OR a_tile <= b_tile")
    pairs = materialise(pairs.withColumn("pair", F.monotonically_increasing_id()), "tile_pairs")
    return compare(tiles, pairs, ["ones", "tile"], _links(radius), "x long, y long")


def _components(marked: DataFrame, radius: int) -> DataFrame:
    """(code, component, least) of every fingerprint of stored (doc_id, code) rows."""
    codes = materialise(marked.groupBy("code").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("least")), "codes")
    parts = connected_components(link_fingerprints(codes.select("code"), radius), "x", "y")
    return codes.join(parts.withColumnRenamed("node", "code"), "code", "left") \
        .withColumn("component", F.coalesce("component", "code"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint, component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other; a null doc_id
    counts after every other id. Repeated rows are kept. An empty table gives no rows.
    """
    docs = canonical(df, id_col, text_col)
    marked = materialise(docs.select("doc_id", fingerprint_udf("text").alias("code")), "fingerprints")
    grouped = _components(marked, radius)
    roots = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_code = grouped.select("code", "component").join(roots, "component").select("code", "component_id")
    return marked.join(by_code, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") != LAST, F.col("component_id")).alias("component_id"))


def one_per_component(df: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of ``df`` that stands for each component of ``placed`` (doc_id, h as hash of the text, component)."""
    key, h = fresh(df, "_key", "_h")
    winners = placed.groupBy("component").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("k"), "h")).alias("w")).select(
        F.col("w.k").alias(key), F.col("w.h").alias(h))
    tagged = df.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)),
                             h: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}).join(winners, [key, h], "left_semi")
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if t in ("string", "bigint", "int", "double", "float", "boolean")]
    # reduced map-side, so that many copies of one row do not meet in one task
    row = tagged.groupBy(key, h).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.xxhash64(*plain)).alias("row"))
    return row.select("row.*")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``df`` per component: that of the smallest doc_id, a null one last, then of the smallest hash of its text.

    Rows that resemble nothing all stay, whatever ids they share. Of rows with the same id
    and text the one with the smallest hash over its plain columns stays. An empty table
    gives no rows.
    """
    docs = canonical(df, id_col, text_col)
    marked = materialise(docs.select("doc_id", F.xxhash64("text").alias("h"), fingerprint_udf("text").alias("code")), "fingerprints")
    grouped = _components(marked.select("doc_id", "code"), radius).select("code", "component")
    return one_per_component(df, marked.join(grouped, "code").select("doc_id", "h", "component"), id_col, text_col)
