"""Blocked all-against-all comparison of vectors inside and across bounded tiles.

Rows are dealt into tiles of about ``size`` rows by a hash, so no tile grows with a hot
block. Tile pairs are rows; each task joins two tiles and returns at most one row per
member, never the pairs it found.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def tiled(rows: DataFrame, block: list[str], spread: Column, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``tile``, tiles per block with their number ``n_tiles``)."""
    counts = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("n_tiles"))
    return rows.join(counts, block).withColumn("tile", F.pmod(spread, F.col("n_tiles"))).drop("n_tiles"), counts


def compare(tiles: DataFrame, pairs: DataFrame, key: list[str], run: Callable[[pd.DataFrame], pd.DataFrame],
            schema: str) -> DataFrame:
    """Apply ``run`` to every tile pair.

    ``tiles`` has one row per tile under ``key``; ``pairs`` has ``pair`` and the keys of
    its two tiles as ``a_*`` and ``b_*`` (equal for a tile against itself).
    """
    sides = [pairs.select("pair", F.lit(i).alias("side"), *[F.col(f"{s}_{k}").alias(k) for k in key])
             for i, s in enumerate("ab")]
    sides[1] = sides[1].join(pairs.filter(" AND ".join(f"a_{k} = b_{k}" for k in key)).select("pair"),
                             "pair", "left_anti")
    n = max(12, 2 * int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    members = sides[0].union(sides[1]).join(tiles, key)
    return members.repartition(n, "pair").groupBy("pair").applyInPandas(run, schema)


class Forest:
    """Union-find over positions with a whole-array label view, for links found in blocks."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Join i and j; the positions of the links that joined two trees."""
        a, b = self.label[i], self.label[j]
        new = np.flatnonzero(a != b)
        if not len(new):
            return new
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        n, used = len(self.label), []
        keys, first = np.unique(a[new].astype(np.int64) * n + b[new], return_index=True)
        for at, p, q in zip(first.tolist(), (keys // n).tolist(), (keys % n).tolist()):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                used.append(at)
        to = np.arange(n)
        for x in up:
            to[x] = root(x)
        self.label = to[self.label]
        return new[used]
