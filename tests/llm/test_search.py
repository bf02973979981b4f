"""Suffix order and exact repeats, Orchard search, ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldspark.llm import difference_cover, exact_repeats, lexical, orchard

from . import fixtures


def test_suffix_order_and_equal_windows():
    r = random.Random(1)
    for _ in range(400):
        n, k = r.randrange(60), r.choice([1, 2, 3, 200])
        t = np.array([r.randrange(k + 1) for _ in range(n)], np.int64)
        assert difference_cover.suffix_order(t, 10 ** 9).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        w = r.randrange(1, 6)
        places = range(max(n - w + 1, 0))
        starts = np.array(sorted(r.sample(places, min(8, len(places)))), np.int64)
        assert difference_cover.equal_windows(t, starts, w).tolist() == [
            min(x for x in starts if t[x:x + w].tolist() == t[s:s + w].tolist()) for s in starts]


def test_suffix_order_of_bounded_prefixes():
    t = np.tile(np.random.default_rng(2).integers(0, 3, 700), 9)
    order = difference_cover.suffix_order(t, 100)
    assert sorted(order.tolist()) == list(range(len(t)))
    prefixes = [t[i:i + 100].tolist() for i in order]
    assert prefixes == sorted(prefixes)


@pytest.mark.parametrize("part", [exact_repeats.PART, 130])
def test_blocks_depend_on_their_windows_only(monkeypatch, part):
    monkeypatch.setattr(exact_repeats, "PART", part)
    r, core_of = random.Random(4), {}
    shared = bytes(r.randrange(97, 102) for _ in range(400))
    for n in (0, 99, 100, 101, 149, 150, 151, 700, 2500):
        for data in (bytes(r.randrange(97, 102) for _ in range(n)), b"x" * n, b"ab" * (n // 2), shared[:n] + b"-" * n):
            start, end, core, loop = exact_repeats.blocks(data)
            windows = [p for a, e in zip(start, end) for p in range(a, e - 99)]
            assert windows == list(range(len(data) - 99))
            assert (end - start <= 149).all()
            for a, e, c, looped in zip(start, end, core, loop):
                inside = [data[p:p + 100] for p in range(a, e - 99)]
                assert all(core_of.setdefault(w, c) == c for w in inside)
                assert looped or len(set(inside)) == len(inside)


def brute_removed(rows, width=100):
    """doc -> (bytes, removed, runs, hash); rows that share (id, text) are one document."""
    seen, out = set(), {}
    for d, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            w = data[i:i + width]
            if w in seen:
                gone[i:i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d, text or ""] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def removed(df, **kw):
    full = exact_repeats.remove_repeats(df, **kw)
    got = exact_repeats.digests(full).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


@pytest.mark.parametrize("kw", [{}, {"crowd": 1, "run": 2000}])
def test_repeats_match_brute_force(docs, kw):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_removed(rows)
    assert removed(docs, **kw) == Counter((d, *want[d, t or ""]) for d, t in rows)


def test_repeats_of_hot_passages(spark):
    """One passage in most documents, under very many different surroundings, and loops."""
    r = random.Random(8)
    hot = fixtures.prose(3, 16)[:104]
    rows = [(i, fixtures.prose(100 + i, 20) + hot + fixtures.prose(900 + i, 20)) for i in range(120)]
    rows += [(200 + i, r.choice(["ab", "x", "abc "]) * r.randrange(40, 400)) for i in range(20)]
    rows += [(300 + i, "é漢" * 60 + hot) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_removed(rows)
    for kw in ({}, {"crowd": 4, "run": 1000}):
        assert removed(df, **kw) == Counter((d, *want[d, t]) for d, t in rows)


def test_repeats_outputs_and_awkward_tables(spark):
    line = "a line of more than one hundred bytes that stands in two documents and has a tail of its own, " + "z" * 40
    df = spark.createDataFrame([(1, line + "!"), (2, "head " + line)], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_repeats.remove_repeats(df).collect()}
    assert got[1].spans == [] and bytes(got[1].kept).decode() == line + "!"
    assert [(s.start, s.end) for s in got[2].spans] == [(5, 5 + len(line))] and bytes(got[2].kept) == b"head "
    assert removed(fixtures.clashing(spark)) == removed(fixtures.documents(spark))
    assert exact_repeats.remove_repeats(fixtures.empty(spark)).count() == 0
    odd = spark.createDataFrame([(1, "q" * 150), (1, "q" * 149 + "r"), (None, None), (None, "q" * 150), (None, "q" * 150)],
                                "doc_id long, text string")
    rows = exact_repeats.digests(exact_repeats.remove_repeats(odd)).collect()
    # windows of equal ids: one of both texts is earlier; of the null ids both rows are one document
    assert sorted((r.n_removed for r in rows if r.doc_id is None and r.n_bytes)) == [150, 150]
    assert len(rows) == 5


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def dist(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min(range(len(centroids)), key=lambda c: (dist(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    d = [dist(v, centroids[a]) for (_, v), a in zip(kept, at)]
    return Counter((i, a, x, sum(y for y, b in zip(d, at) if a == b), sum(d),
                    hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest())
                   for (i, _), a, x in zip(kept, at, d))


def clusters(df):
    got = orchard.with_inertia(orchard.cluster(df)[0]).collect()
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_clusters_match_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-.5, -.01, 0., .01, .25, 1.]) for _ in range(64)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(7, rows[9][1]), (None, rows[2][1]), (None, rows[2][1])]
    rows += [(300, None), (301, []), (302, [1.] * 63), (303, [1.] * 63 + [None]), (304, [1.] * 63 + [float("nan")]),
             (305, [1.] * 63 + [float("inf")]), (306, [0.] * 64), (307, [-1e-9] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert clusters(df) == brute_clusters(rows)
    extra = df.selectExpr("*", "1 AS x", "2 AS cluster", "3 AS distance")
    assert clusters(extra) == brute_clusters(rows)
    few = [x for x in rows if x[0] is not None and x[0] < 4]
    assert clusters(df.filter("vec_id < 4")) == brute_clusters(few)
    assert clusters(df.limit(0)) == Counter()
    huge = spark.createDataFrame([(1, [3e38] + [0.] * 63), (2, [0.] * 64)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in orchard.cluster(huge)[0].collect()] == [2]


def test_orchard_measures_fewer_and_breaks_ties_low():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-3, 4, (40, 2))  # many ties
    x = rng.integers(-3, 4, (500, 2))
    at, best = orchard.nearest(x, centroids, orchard.neighbours(centroids))
    full = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=50):
    def found(t):
        return Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    bags = [(d, found(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for i, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 50 + (50 * b.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 20 * m))
                    for t in found(text) if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out.update((i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1))
    return out


def searched(df, items, **kw):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(df, items, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"top": 3, "block_terms": 4}])
def test_search_matches_brute_force(spark, docs, kw):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(i, fixtures.prose(i % 7, 9 + i) + " É漢字 x") for i in range(14)]
    asked += [(90, None), (91, ""), (92, " -- "), (93, "unheardof"), (3, "alpha ALPHA beta_gamma1"), (None, "alpha")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    want = brute_search(rows, asked, kw.get("top", 50))
    assert searched(docs, items, **kw) == want
    assert searched(docs.selectExpr("*", "1 AS query", "2 AS n", "3 AS score"), items.selectExpr("*", "1 AS block"), **kw) == want
    assert searched(docs, items.limit(0)) == Counter() and searched(docs.limit(0), items) == Counter()


def test_shared_sums_are_added_once():
    r = random.Random(6)
    topic = [{f"t{r.randrange(30)}".encode() for _ in range(12)} for _ in range(4)]
    queries = [r.choice(topic) | r.choice(topic) | {f"own{i}".encode()} for i in range(60)] + [set()]
    graph = lexical.Graph(queries)
    values = {t: r.randrange(1000) for t in graph.leaf}
    sums = np.zeros((graph.leaves, 1), np.int64)
    for t, n in graph.leaf.items():
        sums[n] += values[t]
    assert graph.evaluate(sums)[:, 0].tolist() == [sum(values[t] for t in q) for q in queries]
    assert graph.pairs and graph.additions() < sum(len(q) - 1 for q in queries if q) / 3
    pairs = Counter()
    for parts in graph.parts:
        pairs.update((a, b) for a in parts for b in parts if a < b)
    assert max(pairs.values(), default=0) < 2
