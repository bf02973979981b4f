"""Line dedup by a segment-partition edit join.

Two lines within ``threshold`` edits share one of the ``threshold + 1`` segments the
shorter is cut into, at a nearby place. Every distinct line is indexed under its segments
(with their number and the line's length) and probes the segments that lines of its
length, or up to ``threshold`` shorter, may share with it, at the few places where they
can stand. Lines that meet are verified with a banded bit-parallel edit distance.

Of equal lines the one in the smallest doc_id stays (its first place there). A line goes
too when an earlier line is within the threshold: one of a smaller doc_id or, in the same
document, of the smaller line hash. Lines of fewer than ``min_chars`` characters carry
structure rather than content and always stay. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LAST, canonical, fresh, let, materialise

#: Edits up to which two lines are copies of each other.
THRESHOLD = 1
#: Shortest line that takes part, in code points.
MIN_CHARS = 20
_BLOCKS = 4


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """(start, length) of segment ``i`` of a line of ``length``; later segments take the remainder."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = F.greatest(F.lit(i) - (parts - longer), F.lit(0))
    return base * i + extra, base + F.when(F.lit(i) >= parts - longer, 1).otherwise(0)


def _piece(line: Column, start: Column, size: Column) -> Column:
    return F.substring(line, (start + 1).cast("int"), size.cast("int"))


def _sides(line: Column, start: Column, size: Column, shift: int) -> Column:
    """Eight 4-bit block hashes of the part beside a shared segment: four from its start, four from its end."""
    out = None
    step = F.floor(size / _BLOCKS).cast("int")
    for way, by in ((0, 0), (1, shift)):
        for j in range(_BLOCKS):
            width = step if j < _BLOCKS - 1 else size - step * (_BLOCKS - 1)
            bits = F.shiftleft(F.xxhash64(_piece(line, start + step * j + by, width)).bitwiseAND(F.lit(15)).cast("int"),
                               4 * (_BLOCKS * way + j))
            out = bits if out is None else out.bitwiseOR(bits)
    return out


def entries(line: Column, n: Column, threshold: int) -> tuple[list[tuple[Column, Column]], list[tuple[Column, Column]]]:
    """(index, probe) entries of a line of ``n`` characters: its keys and the block hashes beside them."""
    parts, index, probes = threshold + 1, [], []

    def beside(i: int, length: Column, shift: int) -> Column:
        if threshold != 1:
            return F.lit(0)
        # one edit leaves every block of the other segment but one in place, from its start or from its end
        start, size = _segment(length, 1 - i, parts)
        return _sides(line, start, size, shift)

    for i in range(parts):
        start, size = _segment(n, i, parts)
        index.append((F.xxhash64(F.lit(i), n, _piece(line, start, size)), beside(i, n, 0)))
    for d in range(threshold + 1):
        length = n - d
        for i in range(parts):
            start, size = _segment(length, i, parts)
            for k in range(max(-i, d - (threshold - i)), min(i, d + threshold - i) + 1):
                key = F.xxhash64(F.lit(i), length, _piece(line, start + k, size))
                fits = (start + k >= 0) & (start + k + size <= n) & (length >= parts)
                probes.append((F.when(fits, key), beside(i, length, d)))
    return index, probes


def _one_block(a: Column, b: Column) -> Column:
    """Whether block hashes differ in one block at most: those before it from the start, those after it from the end."""
    x = a.bitwiseXOR(b)
    same = None
    for j in range(_BLOCKS):
        before = (1 << (4 * j)) - 1
        after = ((1 << (4 * (_BLOCKS - 1 - j))) - 1) << (4 * (_BLOCKS + j + 1))
        mask = before | after
        hit = x.bitwiseAND(F.lit(mask - (1 << 32) if mask >= 1 << 31 else mask)) == 0
        same = hit if same is None else same | hit
    return same


def within(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two texts at most ``threshold``, by bit vectors over the band of 2 * threshold + 1 diagonals.

    Bit k of column j stands for row j - threshold + k. D0 marks cells that equal their
    upper left neighbour, so the distance is the start of the last cell's diagonal plus the
    columns in which that diagonal's bit is clear.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    chars_a, chars_b = F.split(a, ""), F.split(b, "")

    def run(p: Column, t: Column) -> Column:
        diagonal = F.size(p) - F.size(t)

        def column(s: Column, c: Column) -> Column:
            match = None
            for k in range(width):
                row = s["j"] - threshold + k  # of the column now entered, counted from 0
                bit = F.when((row >= 0) & (F.get(p, F.greatest(row, F.lit(0))) == c), 1 << k).otherwise(0)
                match = bit if match is None else match + bit

            def step(m: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                carry = (m.bitwiseAND(vp) + vp).bitwiseXOR(vp)
                d0 = carry.bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(full))

                def vectors(d: Column) -> Column:
                    hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(F.lit(full))
                    hn = d.bitwiseAND(vp)
                    half = F.shiftright(d, 1)
                    clear = F.call_function("shiftright", d, threshold + diagonal).bitwiseAND(F.lit(1)) == 0
                    counts = (s["j"] + 1 + diagonal > 0) & clear
                    return F.struct(
                        (s["j"] + 1).alias("j"),
                        hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"),
                        half.bitwiseAND(hp).alias("vn"),
                        (s["e"] + F.when(counts, 1).otherwise(0)).alias("e"))
                return let(d0, vectors)
            return let(match, step)

        first = F.struct(F.lit(0).alias("j"), F.lit(full ^ ((1 << threshold) - 1)).alias("vp"),
                         F.lit(0).alias("vn"), F.abs(diagonal).alias("e"))
        return F.aggregate(t, first, column, lambda s: s["e"] <= threshold)

    near = F.abs(F.length(a) - F.length(b)) <= threshold
    short = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(~near, F.lit(False)).when(short, near).otherwise(
        let(chars_a, lambda p: let(chars_b, lambda t: run(p, t))))


def _lines(df: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t, line_no, line, h1, h2) of every line that takes part; t tells rows of one doc_id apart."""
    rows = df.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("t"),
                     F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.length("line") >= min_chars)
    # two seeds of one hash, 128 bits in all
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("2"), "line")})


def distinct_lines(df: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per distinct line: h1, h2, first_doc and its entries k*/s* (index) and p*/q* (probe)."""
    lines = _lines(df, min_chars)
    index, probes = entries(F.col("line"), F.length("line"), threshold)
    named = {}
    for (key, side), found in ((("k", "s"), index), (("p", "q"), probes)):
        for n, (hashed, beside) in enumerate(found):
            named |= {f"{key}{n}": hashed, f"{side}{n}": beside}
    # every entry is a function of the line, so any of a group will do; all buffers are numbers
    return lines.select("h1", "h2", "doc_id", *[c.alias(n) for n, c in named.items()]) \
        .groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), *[F.max(n).alias(n) for n in named])


def candidates(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (r, s) of line hashes that share a segment and may be within the threshold, each once."""
    def long(key: str, side: str, name: str) -> DataFrame:
        n = sum(c.startswith(key) and c[1:].isdigit() for c in distinct.columns)
        return distinct.select(F.col("h1").alias(name), F.explode(F.array(*[
            F.struct(F.col(f"{key}{i}").alias("key"), F.col(f"{side}{i}").alias(f"{name}_side"))
            for i in range(n)])).alias("e")).select(name, "e.*").filter("key IS NOT NULL")
    index, probe = long("k", "s", "r"), long("p", "q", "s")
    meet = F.col("r") != F.col("s")
    if threshold == 1:
        meet = meet & _one_block(F.col("r_side"), F.col("s_side"))
    return index.withColumnRenamed("key", "r_key").join(
        probe, (F.col("r_key") == F.col("key")) & meet).select(
        F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s")).distinct()


def _may_hold(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose h1 may be among ``wanted``'s: one bit per hash, 256 bitmaps of 4 KB in all.

    The bitmaps are 1 MB whatever the tables hold, so they may be broadcast; a row that
    passes by chance is left to the join that follows.
    """
    bucket, place = F.pmod("h1", F.lit(256)), F.pmod(F.shiftrightunsigned("h1", 8), F.lit(32768))
    bits = wanted.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return lines.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket").filter(hit).drop("bucket", "bits")


def near_lines(df: DataFrame, distinct: DataFrame, threshold: int = THRESHOLD,
               min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2) of lines that go because an earlier line is within the threshold."""
    pairs = materialise(candidates(distinct, threshold), "line_pairs")
    wanted = materialise(pairs.select(F.explode(F.array("r", "s")).alias("h1")).distinct()
                         .join(distinct.select("h1", "h2", "first_doc"), "h1"), "line_wanted")
    texts = materialise(
        _may_hold(_lines(df, min_chars), wanted).join(wanted.withColumnRenamed("first_doc", "doc_id"), ["h1", "h2", "doc_id"])
        .groupBy("h1", "h2", "doc_id").agg(F.max("line").alias("line")), "line_texts")
    a = texts.select(F.col("h1").alias("r"), F.col("h2").alias("r2"), F.col("doc_id").alias("r_doc"), F.col("line").alias("r_line"))
    b = texts.select(F.col("h1").alias("s"), F.col("h2").alias("s2"), F.col("doc_id").alias("s_doc"), F.col("line").alias("s_line"))
    # dealt out evenly, since verifying costs far more than its bytes tell
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(a, "r").join(b, "s").repartition(n, "r", "s")
    same = both.filter(within(F.col("r_line"), F.col("s_line"), threshold))
    later = F.struct("r_doc", "r") > F.struct("s_doc", "s")
    return same.select(F.when(later, F.struct(F.col("r").alias("h1"), F.col("r2").alias("h2"))).otherwise(
        F.struct(F.col("s").alias("h1"), F.col("s2").alias("h2"))).alias("g")).select("g.h1", "g.h2").distinct()


def _dropped(docs: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """(doc_id, t, dropped) of (doc_id, text) rows that lose lines; null ids are the last number."""
    distinct = materialise(distinct_lines(docs, threshold, min_chars), "distinct_lines")
    near = near_lines(docs, distinct, threshold, min_chars).withColumn("near", F.lit(True))
    firsts = distinct.select("h1", "h2", "first_doc").join(near, ["h1", "h2"], "left")
    rows = _lines(docs, min_chars).select("doc_id", "t", "line_no", "h1", "h2").join(firsts, ["h1", "h2"])
    rows = rows.select("doc_id", "t", "line_no", "h1", "h2", (
        F.coalesce("near", F.lit(False)) | (F.col("doc_id") != F.col("first_doc"))).alias("gone"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the same place in rows repeated as a whole has the same rank
    place = F.rank().over(Window.partitionBy("doc_id", "t", "h1", "h2").orderBy("line_no"))
    return rows.repartition(n, "doc_id", "t").withColumn("gone", F.col("gone") | (place > 1)).filter("gone") \
        .groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
          min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (line numbers from 0) of every row.

    Null and empty texts are one empty line, which stays. Null ids come after all others.
    Rows that share a doc_id count as one document: each keeps its own first copy.
    """
    docs = canonical(df, id_col, text_col)
    gone = _dropped(docs, threshold, min_chars)
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("t"),
                       F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return rows.join(gone, ["doc_id", "t"], "left").select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", none).alias("dropped"))


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD,
          min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with the repeated lines of its texts taken out; every row stays, null texts stay null."""
    key, t, drop = fresh(df, "_key", "_t", "_drop")
    gone = _dropped(canonical(df, id_col, text_col), threshold, min_chars).select(
        F.col("doc_id").alias(key), F.col("t").alias(t), F.col("dropped").alias(drop))
    text = F.col(text_col)
    rows = df.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)),
                           t: F.xxhash64(F.coalesce(text, F.lit("")))}).join(gone, [key, t], "left")
    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    kept = let(F.split(text, "\n", -1), without)
    return rows.withColumn(text_col, F.when(F.col(drop).isNull(), text).otherwise(kept)) \
        .select(*[F.col(f"`{c}`") for c in df.columns])
