"""Removal of every byte covered by a ``WIDTH``-byte string that starts earlier in the corpus.

One suffix order of a whole corpus needs about a hundred shuffled bytes per byte, so the
corpus is first cut, without loss, into parts that can be ordered on their own. The core of a
window of ``WIDTH`` bytes is the smallest hash among its ``GRAM``-byte strings, a function of
the window's content alone: equal windows have equal cores. Consecutive windows with one
core make a block, on average one per 25 bytes. Then

* a block with a core of its own holds no repeat;
* blocks with the same core and the same bytes repeat the earliest one, and go entirely;
* what remains are different blocks under one core. Only their bytes are shuffled, to the
  place of their core, and ordered there by the difference-cover method: sampled triples are
  sorted and named, names recursed on, remaining suffixes merged, and neighbours in suffix
  order compared over the window's width. The earliest of equal windows stays.

Cores that very many different blocks share are split once more: their windows are dealt by
the hash of their bytes, so equal ones still meet, and a place keeps each different window
once, however often it comes. Documents go by (doc_id, hash of the text); nothing depends on
how the table is partitioned, so lost tasks are simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LAST, canonical, materialise
from .difference_cover import equal_windows

#: Bytes of a string that counts as repeated, and of the strings that are hashed for cores.
WIDTH, GRAM = 100, 51
#: Window starts hashed at once; longer texts go in overlapping parts.
PART = 1 << 20
#: Documents whose repeated blocks collapse before the shuffle.
SLICE = 256
#: Different blocks under one core before its windows are dealt by their bytes.
CROWD = 4096
#: Bytes ordered at once; a group beyond twice that is reduced to its different windows first.
RUN = 1 << 18
#: Bitmap of documents: so many buckets of 4 KB.
BUCKETS = 1024

_SPAN = "doc long, h long, start long, end long"
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), 6364136223846793005  # odd 64-bit constants
_FINAL = np.uint64(0xBF58476D1CE4E5B9)


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes, by doubling."""
    unit = data.astype(np.uint64) * _MIX
    unit ^= unit >> np.uint64(29)
    unit *= _FINAL
    out, covered, size, power = None, 0, 1, _STEP
    while True:
        if width & 1:
            if out is None:
                out, covered = unit, size
            else:
                n = min(len(out), len(unit) - covered)
                out = out[:n] * np.uint64(power) + unit[covered:covered + n]
                covered += size
        width >>= 1
        if not width:
            break
        unit = unit[:-size] * np.uint64(power) + unit[size:]
        power, size = power * power % (1 << 64), 2 * size
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(30))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size, now = 1, values
    while size * 2 <= width:
        now, size = np.minimum(now[:-size], now[size:]), size * 2
    n = len(values) - width + 1
    return np.minimum(now[:n], now[width - size:width - size + n])


def blocks(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(starts, ends, cores, loops) of the blocks of one text: bytes ``start:end`` hold its windows.

    ``loops`` marks blocks in which a core stands more than once, so that windows of the
    same block may be equal. A block has at most ``width - gram + 1`` windows.
    """
    reach = width - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    for base in range(0, len(data) - width + 1, PART):
        part = np.frombuffer(data, np.uint8, min(PART + width - 1, len(data) - base), base)
        h = _hashes(part, gram)
        core = _least(h, reach)
        heads = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
        size = np.diff(np.append(heads, len(core)))
        if size.max() > reach:  # periodic text
            cuts = -(-size // reach)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            heads = np.repeat(heads, cuts) + nth * reach
            size = np.diff(np.append(heads, len(core)))
        ends = heads + size
        steps = np.arange(reach)
        loops = np.empty(len(heads), bool)
        for k in range(0, len(heads), 1 << 14):
            a, b = heads[k:k + (1 << 14)], ends[k:k + (1 << 14)] - 1
            first = a + h[a[:, None] + steps].argmin(1)
            last = b + reach - 1 - h[b[:, None] + steps[::-1]].argmin(1)
            loops[k:k + (1 << 14)] = first != last
        out.append((heads + base, ends + base + width - 1, core[heads].view(np.int64), loops))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(4))


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions at which a new run begins, of intervals in (doc, start) order that do not lie within earlier ones."""
    return np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])]))


def _anchored(width: int, gram: int):
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                rows = sorted(zip(*[c.to_pylist() for c in batch.slice(k, SLICE).columns]), key=lambda r: r[:2])
                found = []
                for i, (_, _, text) in enumerate(rows):
                    data = text.encode()
                    if len(data) >= width:
                        start, end, core, loop = blocks(data, width, gram)
                        same = [digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())]
                        found.append((np.full(len(start), i), start, end, core, np.array(same, np.uint64).view(np.int64), loop))
                if not found:
                    continue
                row, start, end, core, block, loop = (np.concatenate(c) for c in zip(*found))
                doc, h = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                # of equal blocks in this slice only the earliest is compared with others
                order = np.lexsort((block, core))
                again = np.concatenate([[False], (core[order][1:] == core[order][:-1]) & (block[order][1:] == block[order][:-1])])
                seen = np.zeros(len(row), bool)
                seen[order[again]] = True
                gone, kept = np.flatnonzero(seen), np.flatnonzero(~seen)
                # rows of one document listed twice are one document
                twin = np.concatenate([[False], (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])])
                gone = gone[~twin[row[gone]]]
                if len(gone):
                    run_at = _joined(row[gone], start[gone], end[gone])
                    heads, tails = gone[run_at], gone[np.append(run_at[1:], len(gone)) - 1]
                else:
                    heads = tails = gone
                parts = [core[kept], block[kept], doc[row[kept]], h[row[kept]], start[kept], end[kept] - start[kept], loop[kept]]
                spans = [start[heads] * 7919 + h[row[heads]], end[tails], doc[row[heads]], h[row[heads]], start[heads],
                         np.zeros(len(heads), np.int64), np.zeros(len(heads), bool)]
                cols = [np.concatenate(c) for c in zip(parts, spans)]
                at = (cols[4] << 17) | (cols[6].astype(np.int64) << 16) | cols[5]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols[:4], at)], ["core", "block", "doc", "h", "at"])
    return run


def _verdicts(anchored: DataFrame) -> DataFrame:
    """Blocks that go (``core`` null) and blocks to be compared (``crowd`` different ones under their core)."""
    size, loop, start = F.col("at").bitwiseAND(0xFFFF), F.col("at").bitwiseAND(1 << 16) != 0, F.shiftright("at", 17)
    place = Window.partitionBy("core", "block").orderBy("doc", "h", "at")
    ranked = anchored.repartition("core").withColumn("first", F.rank().over(place) == 1)
    ranked = ranked.withColumn("crowd", F.sum(F.col("first").cast("int")).over(Window.partitionBy("core")))
    gone = (size == 0) | ~F.col("first")
    return ranked.filter(gone | (F.col("crowd") > 1) | loop).select(
        "doc", "h", start.alias("start"), F.when(size == 0, F.col("block")).otherwise(start + size).alias("end"),
        F.when(~gone, F.col("core")).alias("core"), F.when(~gone, F.col("crowd")).alias("crowd"))


def _bytes_of(width: int, gram: int, crowd: int, limit: int):
    """Bytes of the wanted blocks; those of crowded cores window by window, dealt by content.

    A core's windows are dealt so that the different ones of a place have ``limit`` bytes or so.
    """
    digest, most = xxhash.xxh64_intdigest, width * (width - gram + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                out: list[tuple] = []
                for doc, h, text, wanted in zip(*[c.to_pylist() for c in batch.slice(k, SLICE).columns]):
                    data = text.encode()
                    for w in wanted:
                        core, start, end = w["core"], w["start"], w["end"]
                        if w["crowd"] <= crowd:
                            out.append((core, 0, doc, h, start, data[start:end]))
                            continue
                        deal = -(-w["crowd"] * most // limit)
                        for p in range(start, end - width + 1):
                            window = data[p:p + width]
                            out.append((core, 1 + digest(window) % deal, doc, h, p, window))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, [pa.int64()] * 5 + [pa.binary()])],
                    ["core", "deal", "doc", "h", "start", "bytes"])
    return run


def _repeats(width: int, limit: int):
    """Spans of the windows that equal an earlier one of their core; rows come in (core, deal, position) order."""
    def solve(rows: list[tuple]) -> tuple[list[np.ndarray], list[tuple]]:
        """(spans to remove, rows that hold a window no earlier row has)."""
        size = np.array([len(r[5]) for r in rows])
        text = np.frombuffer(b"\0".join(r[5] for r in rows) + b"\0", np.uint8).astype(np.int64) + 1
        begin = np.cumsum(size + 1) - size - 1
        text[begin + size] = 0
        count = size - width + 1
        row = np.repeat(np.arange(len(rows)), count)
        starts = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        new = equal_windows(text, starts, width) == starts
        left = np.unique(row[new])
        p, r = starts[~new], row[~new]
        if not len(p):
            return [], [rows[i] for i in left]
        heads = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1] + 1]))
        r, first, last = r[heads], p[heads], p[np.append(heads[1:], len(p)) - 1]
        doc, h, start = (np.array([rows[i][c] for i in r], np.int64) for c in (2, 3, 4))
        return [doc, h, start + first - begin[r], start + last - begin[r] + width], [rows[i] for i in left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "h", "start", "end"]
        held: list[tuple] = []
        size, opened, bound = 0, 0, 2 * limit  # opened: where the last group begins in held
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if held and r[:5] == held[-1][:5]:
                    continue
                if held and r[:2] != held[-1][:2]:
                    if size >= limit:
                        spans, _ = solve(held)
                        if spans:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in spans], names)
                        held, size = [], 0
                    opened, bound = len(held), 2 * limit
                held.append(r)
                size += len(r[5]) + 1
                if size >= bound:
                    for part in (held[:opened], held[opened:]):
                        spans, part = solve(part) if part else ([], [])
                        if spans:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in spans], names)
                    held, opened = part, 0
                    size = sum(len(x[5]) + 1 for x in held)
                    bound = max(2 * limit, 2 * size)
        if held:
            spans, _ = solve(held)
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in spans], names)
    return run


def _listed(docs: DataFrame, some: DataFrame) -> DataFrame:
    """``docs`` with ``listed``: false only where (doc, h) is not in ``some``.

    One bit per document hash in ``BUCKETS`` bitmaps of 4 KB, 4 MB whatever the tables
    hold; a bit set by another document only costs that text a shuffle.
    """
    def hashed(c: str) -> Column:
        return F.xxhash64("doc", "h") if c == "bucket" else F.shiftrightunsigned(F.xxhash64("doc", "h"), 20)
    bucket, place = F.pmod(hashed("bucket"), F.lit(BUCKETS)), F.pmod(hashed("place"), F.lit(32768))
    bits = some.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return docs.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket", "left") \
        .withColumn("listed", F.coalesce(hit, F.lit(False))).drop("bucket", "bits")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, spans, kept) of documents with the intervals that go."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            size, spans, kept = [], [], []
            for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                data, runs, pieces, at = text.encode(), [], [], 0
                for start, end in sorted((g["start"], g["end"]) for g in gone or []):
                    if runs and start <= runs[-1]["end"]:
                        runs[-1]["end"] = max(end, runs[-1]["end"])
                    else:
                        runs.append({"start": start, "end": end})
                for r in runs:
                    pieces.append(data[at:r["start"]])
                    at = r["end"]
                size.append(len(data))
                spans.append(runs)
                kept.append(b"".join([*pieces, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, crowd: int = CROWD, run: int = RUN) -> DataFrame:
    """(doc, h, start, end): intervals that cover the repeated strings of (doc, h, text) rows; they may overlap."""
    anchored = docs.select("doc", "h", "text").mapInArrow(
        _anchored(width, gram), "core long, block long, doc long, h long, at long")
    verdicts = materialise(_verdicts(anchored), "block_verdicts")
    wanted = materialise(verdicts.filter("core IS NOT NULL").groupBy("doc", "h").agg(
        F.collect_set(F.struct("core", "start", "end", "crowd")).alias("wanted")), "blocks_wanted")
    texts = _listed(docs, wanted).filter("listed").join(wanted, ["doc", "h"]).select("doc", "h", "text", "wanted")
    dealt = texts.mapInArrow(_bytes_of(width, gram, crowd, run), "core long, deal long, doc long, h long, start long, bytes binary")
    compared = dealt.repartition("core", "deal").sortWithinPartitions("core", "deal", "doc", "h", "start") \
        .mapInArrow(_repeats(width, run), _SPAN)
    return materialise(verdicts.filter("core IS NULL").select("doc", "h", "start", "end").union(compared), "repeated_spans")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
                   crowd: int = CROWD, run: int = RUN) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, spans (maximal removed runs), kept (remaining bytes).

    Texts are UTF-8 bytes, a null one is empty; strings never cross documents and are judged
    on the input. Earlier is a smaller doc_id, then an earlier start; null ids come last, and
    of different texts under one id the one with the smaller hash is earlier. Rows with equal
    doc_id and text are one document and get the same result. An empty table gives no rows.
    """
    docs = canonical(df, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("h"), "text")
    spans = repeated_spans(docs, width, gram, crowd, run).groupBy("doc", "h").agg(
        F.collect_list(F.struct("start", "end")).alias("gone"))
    spans = materialise(spans, "spans_by_document")
    marked = _listed(docs, spans)
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    changed = marked.filter("listed").join(spans, ["doc", "h"], "left").select("doc_id", "text", "gone").mapInArrow(_cut, schema)
    whole = marked.filter("NOT listed").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.expr("CAST(array() AS array<struct<start:long,end:long>>)").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return whole.union(changed)


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of ``remove_repeats``."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
