"""Ranked lexical search of many queries at once, with common subexpressions evaluated once.

A score is a sum over the terms of a query, so queries that share terms share partial
sums. Shared term sets are mined among the queries of a block: terms that the very same
queries hold form one leaf; then the pair of nodes that most queries hold together becomes
a node of its own, again and again, until no pair is shared. The result is a graph in
which every query is a sum of few nodes and every node a sum of two earlier ones. Tasks
turn a batch of documents into one accumulator per leaf and document, add the accumulators
up along the graph once for all queries, and keep the best documents per query.

Two passes: statistics and postings of the queries' terms (written), then scores. Blocks of
queries hold a bounded number of terms, so what travels with tasks does not grow with the
query table; each block reads all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import LAST, canonical, materialise

#: Documents reported per query.
TOP = 50
#: Weight of a term that occurs once, share of the length in it, and fixed-point steps.
ONE, SLOPE, UNIT, STEPS = 1_000_000_000, 50, 1000, 20
#: Terms of the queries in a block; a longer query is a block of its own.
BLOCK_TERMS = 1 << 16
#: Accumulators held at once, nodes times documents.
CELLS = 1 << 22
#: First groups in which the best of the tasks meet, per query.
SALTS = 64

#: Everything but digits, ASCII letters and bytes of other characters separates terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in UTF-8, A-Z lower-cased, with repeats."""
    return (text or "").encode().translate(_TERMS).split(b" ") if text else []


def counted(text: str | None) -> Counter:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


class Graph:
    """Sums of a block's queries as a graph of shared partial sums.

    ``leaf`` gives the leaf of every term; ``pairs[i]`` are the two nodes that make node
    ``leaves + i``; ``parts[q]`` are the nodes whose sum is query ``q``.
    """

    def __init__(self, queries: list[set[bytes]]) -> None:
        holders: dict[bytes, list[int]] = defaultdict(list)
        for q, found in enumerate(queries):
            for t in found:
                holders[t].append(q)
        sets: dict[tuple, int] = {}
        self.leaf = {t: sets.setdefault(tuple(holders[t]), len(sets)) for t in sorted(holders)}
        self.leaves = len(sets)
        self.parts: list[set[int]] = [set() for _ in queries]
        where: list[set[int]] = [set(s) for s in sets]
        for n, s in enumerate(where):
            for q in s:
                self.parts[q].add(n)
        self.pairs: list[tuple[int, int]] = []
        self._share(where)

    def _share(self, where: list[set[int]]) -> None:
        """Make the pair that most queries hold a node, until none is held twice."""
        shared: Counter = Counter()
        for p in self.parts:
            many = sorted(n for n in p if len(where[n]) > 1)
            for i, a in enumerate(many):
                shared.update((a, b) for b in many[i + 1:])
        heap = [(-c, *ab) for ab, c in shared.items() if c > 1]
        heapq.heapify(heap)
        while heap:
            count, a, b = heapq.heappop(heap)
            both = where[a] & where[b]
            if len(both) < 2:
                continue
            if len(both) != -count:  # other pairs have taken some of its queries meanwhile
                heapq.heappush(heap, (-len(both), a, b))
                continue
            node = self.leaves + len(self.pairs)
            self.pairs.append((a, b))
            where[a] -= both
            where[b] -= both
            where.append(set(both))
            beside: Counter = Counter()
            for q in both:
                self.parts[q] -= {a, b}
                beside.update(self.parts[q])
                self.parts[q].add(node)
            for n, c in beside.items():
                if c > 1:
                    heapq.heappush(heap, (-c, n, node))

    def additions(self) -> int:
        return len(self.pairs) + sum(max(0, len(p) - 1) for p in self.parts)

    def evaluate(self, leaf_sums: np.ndarray) -> np.ndarray:
        """Query x document sums from leaf x document sums."""
        sums = np.zeros((self.leaves + len(self.pairs), leaf_sums.shape[1]), np.int64)
        sums[:self.leaves] = leaf_sums
        for i, (a, b) in enumerate(self.pairs):
            np.add(sums[a], sums[b], out=sums[self.leaves + i])
        return np.stack([sums[sorted(p)].sum(0) if p else np.zeros(sums.shape[1], np.int64) for p in self.parts])


def _postings(vocabulary: dict[bytes, int]):
    known = vocabulary.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids, n, term, count = [], [], [], []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tf = counted(t)
                    if tf:
                        hit = sorted((vocabulary[x], tf[x]) for x in known & tf.keys())
                        ids.append(d)
                        n.append(tf.total())
                        term.append([i for i, _ in hit])
                        count.append([c for _, c in hit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())),
                     pa.array(count, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])
    return run


def _best(docs: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` positive scores, ties by document."""
    some = np.flatnonzero(scores > 0)
    if len(some) > 4 * top:
        least = np.partition(scores[some], len(some) - top)[len(some) - top]
        some = some[scores[some] >= least]
    return some[np.lexsort((docs[some], -scores[some]))][:top]


def _scores(graph: Graph, leaf_of: np.ndarray, weights: np.ndarray, n_docs: int, length: int, top: int):
    rows = max(1, min(4096, CELLS // (graph.leaves + len(graph.pairs) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in graph.parts]
        for b in batches:
            for k in range(0, b.num_rows, rows):
                part = b.slice(k, rows)
                docs = np.array([LAST if d is None else d for d in part.column(0).to_pylist()], np.int64)
                m = np.array([100 - SLOPE + (SLOPE * n * n_docs) // length for n in part.column(1).to_pylist()], np.int64)
                lists, tf = part.column(2), part.column(3).flatten().to_numpy()
                term, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets)
                doc = np.repeat(np.arange(len(docs)), np.diff(ends))
                sums = np.zeros((graph.leaves, len(docs)), np.int64)
                np.add.at(sums, (leaf_of[term], doc), weights[term] * ((ONE * tf) // (UNIT * tf + STEPS * m[doc])))
                for q, scores in enumerate(graph.evaluate(sums)):
                    best = _best(docs, scores, top)
                    if len(best):
                        d, s = np.append(kept[q][0], docs[best]), np.append(kept[q][1], scores[best])
                        best = _best(d, s, top)
                        kept[q] = d[best], s[best]
        for q, (d, s) in enumerate(kept):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), q)), pa.array(d, mask=d == LAST), pa.array(s)],
                                                 ["query", "doc_id", "score"])
    return run


def _blocks(queries: DataFrame, budget: int) -> DataFrame:
    """Queries with ``block``: consecutive ones whose terms together fit the budget."""
    size = F.length("text")  # at least the number of terms
    # one row of two numbers per query
    before = Window.orderBy("query").rowsBetween(Window.unboundedPreceding, -1)
    return queries.withColumn("block", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / (8 * budget)))


def search(df: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id",
           query_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query id, rank, doc_id, score): the ``top`` documents with a positive score per row of ``queries``.

    Terms are runs of ASCII letters and digits and of all non-ASCII characters, A-Z
    lower-cased; null and empty texts have none and are not counted as documents. Equal
    scores rank by doc_id, a null one last; rows of documents or queries that share an id
    are ranked each for themselves. Queries without a term found give no rows, nor do empty
    tables. Columns besides the named ones are not read.
    """
    spark = df.sparkSession
    docs = canonical(df, id_col, text_col)
    asked = queries.select(F.col(query_id).alias("item"), F.coalesce(F.col(query_text), F.lit("")).alias("text"))
    asked = materialise(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = materialise(_blocks(asked, block_terms), "query_blocks")
    found = None
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        rows = asked.filter(F.col("block") == block).select("query", "text").orderBy("query").collect()
        graph = Graph([set(counted(r["text"])) for r in rows])
        vocabulary = {t: i for i, t in enumerate(graph.leaf)}
        if not vocabulary:
            continue
        postings = materialise(docs.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, tf array<long>"),
                               "postings")
        n_docs, length = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for t, n in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's terms
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        leaf_of = np.array(list(graph.leaf.values()))
        best = postings.mapInArrow(_scores(graph, leaf_of, weights, n_docs, length, top), "query long, doc_id long, score long")
        numbers = spark.createDataFrame([(i, r["query"]) for i, r in enumerate(rows)], "n long, query long")
        best = best.withColumnRenamed("query", "n").join(numbers, "n").drop("n")
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long")
    # the best of the tasks meet in two steps, each cut to ``top`` before it is shuffled
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))) \
        .filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))) \
        .filter(F.col("rank") <= top)
    return ranked.join(asked.select("query", "item"), "query").select(F.col("item").alias(query_id), "rank", "doc_id", "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_PATTERN}')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_PATTERN}')) AS term FROM benchmark),
p AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY term, doc_id),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
s AS (SELECT item_id, doc_id, CAST(sum(w * (({ONE} * tf) // ({UNIT} * tf + {STEPS} * (100 - {SLOPE} + ({SLOPE} * n * docs) // len)))) AS BIGINT)
      AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), total GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}"""
