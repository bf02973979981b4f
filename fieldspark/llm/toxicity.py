"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the bag of its character n-grams (with word marks) and itself, hashed to
``buckets`` embeddings; a text is the average over its words; two softmax outputs read it.
Embeddings and softmax are trained jointly in numpy, so a misspelling that was never
seen shares most of its n-gram vectors with the words it resembles.

The model is fitted on a bounded sample of labelled rows (``sample`` per class, chosen by
a hash of the id) inside one task; the corpus is scored in parallel with the fitted
model, at most buckets * dims numbers.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from .common import canonical, materialise

#: Rows per class that the fit may use.
SAMPLE = 3000
BUCKETS = 1 << 17
DIMS = 4
EPOCHS = 10
RATE = 0.5
SEED = 7
#: Subwords in fewer fitted texts are left out.
MIN_ROWS = 10
#: Neutral words every text is averaged with, so that a few words alone decide little.
NEUTRAL = 10
#: Averages are scaled by this, since the words that matter are a small share of a text.
SCALE = 100.0
#: Bytes of words a worker remembers before it starts anew, and what a word costs besides.
MEMO, _ENTRY = 32 << 20, 150
#: Characters of texts whose new words are looked up together.
TOGETHER = 1 << 18

_MARKS = ".,;:!?\"'`()[]{}<>|/\\*#-_…«»“”„‘’0123456789"


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word: itself and its n-grams of 3 to 6 characters."""
    return [zlib.crc32(g.encode()) % buckets for g in grams(word)]


def grams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked, *[marked[i:i + n] for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)]]


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def _buckets_of(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(``subwords`` of all words end to end, their number per word), as arrays.

    The n-grams from every character of the marked words grow by one character at a time, their
    checksums by that character's UTF-8 bytes.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(marked)), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the word's end
    wide = bool(len(codes)) and int(codes.max()) > 127
    hashes = [np.fromiter((zlib.crc32(m.encode()) for m in marked), np.uint32, len(marked))]
    order = [np.arange(len(marked)) * 5]
    at, crc = np.arange(len(codes)), np.full(len(codes), 0xFFFFFFFF, np.uint32)
    for n in range(1, 7):
        if n >= 3:
            live = room[at] >= n
            at, crc = at[live], crc[live]
        else:
            live = at + n <= len(codes)
            at, crc = at[live], crc[live]
        c = codes[at + n - 1]
        if not wide:
            crc = _CRC[(crc ^ c) & 255] ^ (crc >> 8)
        else:
            high = c > 127
            lead = np.where(high, np.where(c < 0x800, 0xC0 | c >> 6, np.where(c < 0x10000, 0xE0 | c >> 12, 0xF0 | c >> 18)), c)
            crc = _CRC[(crc ^ lead) & 255] ^ (crc >> 8)
            for shift, above in ((12, 0xFFFF), (6, 0x7FF), (0, 127)):
                more = np.flatnonzero(c > above)
                if len(more):
                    b, old = 0x80 | c[more] >> shift & 63, crc[more]
                    crc[more] = _CRC[(old ^ b) & 255] ^ (old >> 8)
        if n >= 3:
            hashes.append(~crc)
            order.append(owner[at] * 5 + n - 2)
    # a word's own bucket comes first, then its n-grams by length and place
    into = np.argsort(np.concatenate(order), kind="stable")
    sizes = 1 + sum(np.maximum(lengths - n + 1, 0) for n in range(3, 7))
    return (np.concatenate(hashes)[into] % np.uint32(buckets)).astype(np.int64), sizes


def plain(token: str) -> str:
    """A token between white space without the marks around it."""
    return token.strip(_MARKS)


def word_counts(text: str) -> Counter:
    counts: Counter = Counter()
    for token, n in Counter(text.lower().split()).items():
        counts[plain(token)] += n
    counts.pop("", None)
    return counts


def _rows(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (ends, buckets, weights) of average subword bags."""
    cols, weights, ends = [], [], [0]
    for t in texts:
        counts = word_counts(t)
        total = sum(counts.values())
        found, sizes = _buckets_of(list(counts), buckets)
        part = SCALE * np.fromiter(counts.values(), np.float64, len(counts)) / ((total + NEUTRAL) * sizes)
        ids, at = np.unique(found, return_inverse=True)
        cols.append(ids.astype(np.int32))
        weights.append(np.bincount(at, np.repeat(part, sizes), len(ids)).astype(np.float32))
        ends.append(ends[-1] + len(ids))
    return np.array(ends), np.concatenate(cols or [np.empty(0, np.int32)]), np.concatenate(weights or [np.empty(0, np.float32)])


def fit(texts: list[str], toxic: list[int], buckets: int = BUCKETS, dims: int = DIMS, epochs: int = EPOCHS,
        seed: int = SEED) -> tuple[np.ndarray, float]:
    """(score weight of every bucket, bias): the trained embeddings times the softmax difference.

    Without rows of both classes all weights
    are zero and the bias is the log odds of what there is, as if one toxic and two clean rows more had been seen.
    """
    y = np.array(toxic, np.int64)
    ones, n = int(y.sum()), len(y)
    if not 0 < ones < n:
        return np.zeros(buckets, np.float32), float(np.log((ones + 1) / (n - ones + 2)))
    rng = np.random.default_rng(seed)
    ends, cols, weights = _rows(texts, buckets)
    common = np.bincount(cols, minlength=buckets)
    used = np.flatnonzero(common)
    place = np.zeros(buckets, np.int32)
    place[used] = np.arange(len(used))
    cols, common = place[cols], common[used]
    # columns are brought to one scale, so that plain steps follow how steadily a subword goes with a
    # label, not how often it occurs; a subword of few texts would only recall them
    spread = np.sqrt(np.bincount(cols, weights.astype(np.float64) ** 2, len(used)) / n) + 1e-3
    factor = np.where(common >= MIN_ROWS, 1 / spread, 0).astype(np.float32) / np.float32(np.sqrt(len(used)))
    # entries without weight do nothing from here on
    heavy = factor[cols] > 0
    ends = np.concatenate([[0], np.cumsum(heavy, dtype=np.int64)])[ends]
    cols, weights = cols[heavy], weights[heavy]
    weights *= factor[cols]
    table = rng.uniform(-0.1, 0.1, (len(used), dims)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    target = np.stack([1 - y, y], 1)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 64)):
            at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in batch])
            row = np.repeat(np.arange(len(batch)), ends[batch + 1] - ends[batch])
            w = weights[at]
            part, local = np.unique(cols[at], return_inverse=True)
            small = table[part]
            hidden = np.stack([np.bincount(row, w * small[local, d], len(batch)) for d in range(dims)], 1)
            out = hidden @ soft + bias
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p - target[batch]
            g_soft, g_bias, g_hidden = hidden.T @ g, g.sum(0), g @ soft.T
            g_part = np.stack([np.bincount(local, w * g_hidden[row, d], len(part)) for d in range(dims)], 1)
            table[part] -= RATE * g_part
            soft -= RATE / len(batch) * g_soft
            bias -= RATE / len(batch) * g_bias
    score = np.zeros(buckets, np.float32)
    score[used] = table @ (soft[:, 1] - soft[:, 0]) * factor
    return score, float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on labelled rows outside the held-out fifth (crc32(doc_id) mod 5 = 0).

    At most ``sample`` rows per class, the smallest by hash of the id. Labels other than 0
    and 1, null ids and labels without a document are ignored.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")) \
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # at most 2 * sample ids, so this side is bounded whatever the tables hold
    chosen = known.filter("y = 1").orderBy(*order).limit(sample).union(known.filter("y = 0").orderBy(*order).limit(sample))
    rows = canonical(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id") \
        .agg(F.max("y").alias("y"), F.max("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame({"doc_id": [], "y": [], "text": []}), *batches]).sort_values("doc_id")
        weights, bias = fit(pdf["text"].tolist(), pdf["y"].astype(int).tolist())
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})
    model = rows.coalesce(1).mapInPandas(run, "weights binary, bias double")
    found = materialise(model, "toxicity_model").first()
    if found is None:  # no labelled row at all
        return fit([], [])
    return np.frombuffer(found["weights"], np.float32), found["bias"]


def held_out(doc_id):
    """The rows that labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float64), bias
        self.memo: dict[str, float] = {}
        self.held = 0

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[float]:
        out, k = [], 0
        while k < len(texts):
            found, size = [], 0
            while k < len(texts) and size < TOGETHER:
                found.append(texts[k].lower().split())
                size += len(texts[k])
                k += 1
            self.learn(set().union(*found))
            out += map(self._one, found)
        return out

    def learn(self, tokens: set[str]) -> None:
        if self.held > MEMO:
            self.memo.clear()
            self.held = 0
        new = list(tokens.difference(self.memo))
        self.memo.update(zip(new, self.words(new)))
        self.held += sum(map(len, new)) + _ENTRY * len(new)

    def words(self, tokens: list[str]) -> list[float]:
        """Mean weight of each word's subwords; zero, as for a token without letters, does not count as a word."""
        if not tokens:
            return []
        words = [t.strip(_MARKS) for t in tokens]
        found, sizes = _buckets_of(words, len(self.weights))
        sums = np.bincount(np.repeat(np.arange(len(words)), sizes), self.weights[found], len(words))
        return np.where(sizes > 1, sums / sizes, 0.0).tolist()

    def _one(self, found: list[str]) -> float:
        got = list(map(self.memo.__getitem__, found))
        n = len(got) - got.count(0.0)
        out = SCALE * sum(got) / (n + NEUTRAL) + self.bias
        return 1 / (1 + math.exp(-min(max(out, -700.0), 700.0)))


def scorer(weights: np.ndarray, bias: float):
    """A column function: probability that a text is toxic; null and empty texts get the model's prior."""
    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(weights, bias)
        for texts in batches:
            yield pd.Series(s.scores([t or "" for t in texts]), dtype="float64")
    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Repeated rows get equal scores; a null id is not held out. An empty label table gives
    1/3 everywhere, an empty ``docs`` no rows.
    """
    run = scorer(*train(docs, labels, id_col, text_col, label_col, sample))
    return canonical(docs, id_col, text_col).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), run("text").alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
