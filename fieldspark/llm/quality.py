"""Quality rules: base counts per text and a hashed n-gram likelihood ratio.

Words and word pairs are hashed to buckets. Two add-one smoothed multinomials over the
buckets, one of the trusted texts and one of the whole corpus, give every bucket a log
ratio; a text's score is the mean over its n-grams, so length does not matter. Texts
below a low quantile of the trusted texts' own scores go. Counts cover all rows; only the
two bucket tables, of a size set by ``buckets``, and one cut travel. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, canonical, let, materialise, words

BUCKETS = 10_000
#: Share of the trusted texts that may score below the cut.
QUANTILE = 0.001
#: Width of the score bins the quantile is taken from, so that its buffer is bounded.
_BIN = 1e-4


def _repeated(w: Column) -> Column:
    """Words in 3-word windows that a text holds twice or more."""
    grams = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def covered(pos: Column) -> Column:
        return F.aggregate(
            pos, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"])

    def count(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return covered(F.sort_array(F.transform(hit, lambda x: x["i"])))

    def some(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(ranked, count))

    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(grams, some))


def base_counts(df: DataFrame, *more: Column) -> DataFrame:
    """Base rule columns beside ``more`` and ``text`` for (doc_id, text) rows."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumn("words", words(text)).select(
        "doc_id", "text", *more, F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50)
                          | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_ngrams(df: DataFrame, *keep: str | Column, buckets: int = BUCKETS) -> DataFrame:
    """``keep`` and the buckets ``one`` (a word) and ``two`` (with its successor) of every word of ``text``.

    One row per piece between spaces. An empty piece, found only at the ends of a text, and the
    last word's missing pair are null. Rows instead of arrays keep the hashes in generated code.
    """
    def bucket(*cols: str) -> Column:
        here = F.lit(True)
        for c in cols:
            here = here & F.col(c).isNotNull() & (F.col(c) != "")
        return F.when(here, F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int"))
    # stored once per row: the zip reads the array twice
    split = df.select(*keep, F.split("text", SPACE).alias("_w"))
    zipped = F.arrays_zip(F.col("_w").alias("x"), F.slice("_w", 2, F.size("_w")).alias("y"))
    kept = [c for c in split.columns if c != "_w"]
    pieces = split.select(*kept, F.explode(zipped).alias("_g")).select(*kept, "_g.x", "_g.y")
    return pieces.select(*kept, bucket("x").alias("one"), bucket("x", "y").alias("two"))


def bucket_ratios(df: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row ``ratios``: the log ratio of every bucket, over all (doc_id, text) rows.

    ``trusted`` has the doc_ids whose texts are the target and may be of any size: it meets the
    documents in a shuffled hash join, the same plan for few ids as for many, and no text is sorted.
    """
    marked = df.join(trusted.select("doc_id", F.lit(1).alias("t")).distinct().hint("shuffle_hash"), "doc_id", "left")
    counts = with_ngrams(marked, "t", buckets=buckets) \
        .select("t", F.explode(F.array("one", "two")).alias("b")).filter("b IS NOT NULL") \
        .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("t").alias("target"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"),
                                                  F.coalesce("target", F.lit(0)).alias("target"))
    held = full.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("c"),
                    F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    return held.select(F.transform("c", lambda x: F.when(F.col("n_target") == 0, 0.0).otherwise(F.log(
        ((x["target"] + 1) / (F.col("n_target") + buckets)) / ((x["raw"] + 1) / (F.col("n_raw") + buckets))))).alias("ratios"))


def score_cut(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> float:
    """Lowest score of a kept text: the ``quantile`` of all trusted texts that pass the base rules, rounded down.

    ``scored`` is a stored table. Without such a text nothing is known of good scores: minus infinity.
    """
    good = scored.filter("NOT base_failed").join(trusted.select("doc_id"), "doc_id", "left_semi")
    bins = good.groupBy(F.floor(F.col("score") / _BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    at = bins.agg(F.floor(F.percentile("bin", F.lit(quantile), F.col("n"))).alias("at")).first()["at"]
    return float("-inf") if at is None else at * _BIN


def judge(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          buckets: int = BUCKETS, threshold: float | None = None) -> DataFrame:
    """doc_id, base counts, base_failed, score and kept of every row.

    ``threshold`` is the lowest score of a kept text, by default ``score_cut``. Null and empty
    texts have no words, fail the base rules and score 0. Repeated rows get equal answers.
    With no trusted text every ratio is 0 and only the base rules decide.
    """
    docs = canonical(df, id_col, text_col)
    # `buckets` numbers, folded into one constant
    found = bucket_ratios(docs, trusted, buckets).first()["ratios"]
    ratios = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")
    # a row's number keeps equal rows apart; its n-grams are summed where they are made, then one row per text moves
    counted = base_counts(docs, F.monotonically_increasing_id().alias("_row"))
    keys = [c for c in counted.columns if c != "text"]
    summed = with_ngrams(counted, *keys, buckets=buckets).groupBy(*keys).agg(F.coalesce(F.sum(
        F.coalesce(F.get(ratios, F.col("one")), F.lit(0.0)) + F.coalesce(F.get(ratios, F.col("two")), F.lit(0.0))), F.lit(0.0)).alias("total"))
    scored = summed.withColumn("score", F.col("total") / F.greatest(2 * F.col("n_words") - 1, F.lit(1))).drop("_row", "total")
    if threshold is None:
        scored = materialise(scored, "quality_scores")
        threshold = score_cut(scored, trusted)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
