"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

A unit vector x is stored as s*q with q int8; its quantisation error e = |x - s*q| is
measured in double precision. Then

    |x.y - s_x s_y q_x.q_y| <= e_x |s_y q_y| + e_y

since |x| = |y| = 1. Only pairs whose approximate product plus that bound can reach the
threshold are recomputed in double precision. Products of int8 vectors are exact in
single precision while 127^2 * dims < 2^24, so longer vectors are multiplied in slices.
Equal vectors of a label collapse to one class with a multiplicity before any product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .components import connected_components
from .tiles import Forest, compare, tiled

#: Cosine from which two vectors link.
THRESHOLD = 0.98
#: Vector classes per tile.
TILE = 1024
_SLICE = 1024
#: Slack for the rounding of the bound itself.
_SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes as float32, scales, errors, norms of the dequantised vectors) of unit rows."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    near = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(x - near, axis=1), np.linalg.norm(near, axis=1)


def _candidates(a: tuple, b: tuple, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    (qa, sa, ea, _), (qb, sb, eb, nb) = a, b
    product = np.zeros((rows.stop - rows.start, len(qb)))
    for k in range(0, qa.shape[1], _SLICE):
        product += qa[rows, k:k + _SLICE] @ qb[:, k:k + _SLICE].T
    bound = ea[rows, None] * nb[None, :] + eb[None, :] + _SLACK
    return np.nonzero(product * (sa[rows, None] * sb[None, :]) + bound >= threshold)


def _links(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = len(pdf) == 1
        cid = np.concatenate([np.asarray(v, np.int64) for v in pdf["cids"]])
        size = np.concatenate([np.asarray(v, np.int64) for v in pdf["sizes"]])
        raw = np.stack([np.asarray(v, np.float64) for t in pdf["vectors"] for v in t])
        raw = raw / np.abs(raw).max(1)[:, None]  # the cosine does not change, and squares cannot overflow
        norm, n = np.sqrt((raw * raw).sum(1)), len(pdf["cids"].iloc[0])
        coded = quantise(raw / norm[:, None])
        a = tuple(v[:n] for v in coded)
        shift = 0 if one else n
        b = tuple(v[shift:] for v in coded)
        links, forest = np.zeros(len(cid), np.int64), Forest(len(cid))
        for k in range(0, n, 256):
            i, j = _candidates(a, b, slice(k, min(k + 256, n)), threshold)
            i, j = i + k, j + shift
            if one:
                i, j = i[i < j], j[i < j]
            sure = np.concatenate([
                (raw[p] * raw[q]).sum(1) / (norm[p] * norm[q]) >= threshold
                for p, q in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(j) // 65536 + 1))])
            i, j = i[sure], j[sure]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            forest.add(i, j)
        hit = links > 0
        return pd.DataFrame({"cid": cid[hit], "links": links[hit], "root": cid[forest.label[hit]]})
    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors meet only under equal, non-null labels and equal length. Vectors that are
    null, zero, or hold null or non-finite components link with nothing: they are their
    own component and kept. A null vec_id never is a component id unless its component
    has no other. Repeated rows are vectors like any other. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                     F.col(vector_col).cast("array<double>").alias("v"))
    inf = F.lit(float("inf"))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False)))
        & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable)
    # numbered when written, so an id never changes afterwards
    classes = materialise(
        good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("cid"), "label", F.size("v").alias("dim"), "v", "size", "least"),
        "vector_classes")
    dealt, counts = tiled(classes, ["label", "dim"], F.xxhash64("cid"), tile)
    tiles = dealt.groupBy("label", "dim", "tile").agg(
        F.collect_list(F.struct("cid", "size", "v")).alias("m")).select(
        "label", "dim", "tile", F.col("m.cid").alias("cids"), F.col("m.size").alias("sizes"), F.col("m.v").alias("vectors"))
    pairs = counts.select("label", "dim", "n_tiles", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("a_tile"))
    pairs = pairs.withColumn("b_tile", F.explode(F.sequence(F.col("a_tile"), F.col("n_tiles") - 1)))
    pairs = materialise(pairs.select(
        F.monotonically_increasing_id().alias("pair"), F.col("label").alias("a_label"), F.col("label").alias("b_label"),
        F.col("dim").alias("a_dim"), F.col("dim").alias("b_dim"), "a_tile", "b_tile"), "tile_pairs")
    found = materialise(compare(tiles, pairs, ["label", "dim", "tile"], _links(threshold),
                                "cid long, links long, root long"), "vector_links")
    parts = connected_components(found, "cid", "root").withColumnRenamed("node", "cid")
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    each = classes.drop("v", "label", "dim").join(parts, "cid", "left").join(linked, "cid", "left") \
        .withColumn("component", F.coalesce("component", "cid"))
    roots = each.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = each.join(roots, "component").select(
        "cid", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    by_vector = classes.select("cid", "label", "v").join(by_class, "cid").drop("cid")
    joined = good.join(by_vector, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
