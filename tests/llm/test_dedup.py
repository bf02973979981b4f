import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldspark.llm import components, embed_dedup, line_dedup, simhash

from . import fixtures


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    links += [(1000, i) for i in range(1001, 1100)]
    got = {x.node: x.component for x in components.connected_components(
        spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({x for p in real for x in p}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    ids = {d for d, _ in prints}
    links = [(a, b) for a, x in prints for b, y in prints if a is not None and b is not None and (x ^ y).bit_count() <= 4]
    return prints, roots(ids - {None}, links)


def test_simhash(docs, rows):
    prints, root = brute_components(rows)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, f"{p:016x}") for d, p in prints)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == root[r.doc_id]


def test_simhash_tiles(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    codes = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in base for _ in range(8)} | {0, (1 << 64) - 1, 15}
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "code long"), tile=5).collect()
    got = roots([c for c, in signed], [(x.x, x.y) for x in links])
    want = roots([c for c, in signed], [(a, b) for a, in signed for b, in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    assert got == want


def test_simhash_keep_one(spark, rows):
    df = fixtures.clashing(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    _, root = brute_components(rows)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(root.values()))
    assert simhash.keep_one(fixtures.empty(spark)).count() == 0


def vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + r.normal(size=16) * r.choice([0, .02, .15])).astype(np.float32).tolist(), int(i % 3 == 0)) for i in range(200)]
    rows += [(i, rows[3][1], rows[3][2]) for i in range(200, 230)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, rows[0][1], None),
             (305, [float("inf")] + [1.0] * 15, 0), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (None, rows[1][1], rows[1][2]),
             (309, [1e-30] * 16, 0), (310, [3e38] * 16, 0), (311, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def brute_cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not a or any(x is None or not math.isfinite(x) for x in a + b):
        return None
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    if not a.any() or not b.any():
        return None
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("tile", [7, 1024])
def test_embeddings(spark, tile):
    df, rows = vectors(spark)
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(n) if i != j and rows[i][2] is not None and rows[i][2] == rows[j][2]
             and (c := brute_cosine(rows[i][1], rows[j][1])) is not None and c >= 0.98]
    count = Counter(i for i, _ in links)
    root = roots(range(n), links)
    groups = {}
    for i in range(n):
        groups.setdefault(root[i], []).append(rows[i][0])
    least = {k: min((v for v in g if v is not None), default=None) for k, g in groups.items()}
    want = Counter((rows[i][0], count[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(n))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, tile=tile).collect())
    assert got == want


def test_quantisation_bound_holds():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 2500))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e, n = embed_dedup.quantise(x)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(x @ x.T - approx) <= e[:, None] * n[None, :] + e[None, :] + 1e-12).all()


def test_embedding_edge_tables(spark):
    df, rows = vectors(spark)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    extra = df.withColumns({"cid": F.lit(1), "tile": F.lit(1), "v": F.lit(2), "pair": F.lit(3)})
    assert embed_dedup.near_duplicates(extra).count() == len(rows)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(a, b, threshold):
    if abs(len(a) - len(b)) > threshold:
        return False
    if threshold > 1:
        return distance(a, b) <= threshold
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def edited(r, s, n):
    for _ in range(n):
        k = r.randrange(len(s) + 1)
        s = r.choice([s[:k] + r.choice("xyé😀") + s[k:], s[:k] + s[k + 1:], s[:k] + "z" + s[k + 1:]])
    return s


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    r = random.Random(threshold)
    pairs = [(s, edited(r, s, r.randrange(6))) for s in ("".join(r.choices("abc é😀", k=r.randrange(30))) for _ in range(300))]
    pairs += [("", ""), ("", "a"), ("abcd", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("x")).collect()
    for row in got:
        assert row.x == (distance(row.a, row.b) <= threshold), (row, distance(row.a, row.b))


def lines_corpus():
    r = random.Random(11)
    base = ["".join(r.choices("abcdefgh éß", k=r.randrange(20, 60))) for _ in range(60)]
    docs = []
    for i in range(50):
        lines = [edited(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randrange(8))] + ["short", "", "short"]
        r.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    return docs + [(None, base[0] + "\n" + base[1]), (90, None), (91, ""), docs[3], docs[3], (4, base[2])]


def brute_lines(docs, threshold, least=20):
    key = lambda d: (1 << 63) - 1 if d is None else d
    first = {}
    for d, t in docs:
        for s in (t or "").split("\n"):
            if len(s) >= least:
                first[s] = min(first.get(s, 1 << 64), key(d))
    h = {s: (x := xxhash.xxh64_intdigest(s.encode(), seed=42)) - (x >> 63 << 64) for s in first}
    by_length = {}
    for s in first:
        by_length.setdefault(len(s), []).append(s)
    near = {s for s in first for k in range(-threshold, threshold + 1) for q in by_length.get(len(s) + k, ())
            if q != s and (first[q], h[q]) < (first[s], h[s]) and close(q, s, threshold)}
    out = []
    for d, t in docs:
        lines, seen, gone = (t or "").split("\n"), set(), []
        for i, s in enumerate(lines):
            if len(s) >= least:
                if s in seen or s in near or first[s] != key(d):
                    gone.append(i)
                seen.add(s)
        out.append((d, len(lines), len(gone), tuple(gone)))
    return Counter(out)


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_dedup(spark, threshold):
    docs = lines_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, tuple(r.dropped)) for r in line_dedup.dedup(df, threshold=threshold).collect())
    assert got == brute_lines(docs, threshold)


def test_line_dedup_applied(spark):
    docs = [d for d in lines_corpus() if d[0] != 4]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, dropped string")
    gone = {r.doc_id: r.dropped for r in line_dedup.dedup(df).collect()}
    out = line_dedup.apply(df)
    assert out.columns == df.columns
    want = Counter((d, None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone[d])) for d, t in docs)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_line_dedup_edge_tables(spark):
    assert line_dedup.dedup(fixtures.empty(spark)).count() == 0
    df = fixtures.clashing(spark)
    assert line_dedup.dedup(df).count() == df.count() == line_dedup.apply(df).count()


def test_keep_one_goes_by_rows(spark):
    """Null and repeated ids: rows that resemble nothing stay, a copy goes whatever its id."""
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("oak", "elm", "ash", "fir", "yew")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4])]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == Counter(rows[:5])
