import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldspark.llm import chat, pii, quality, toxicity

from . import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(data: bytes, seed: int) -> int:
    x = xxhash.xxh64_intdigest(data, seed=seed & (1 << 64) - 1)
    return x - (x >> 63 << 64)


def brute_base(text):
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def brute_buckets(text, buckets):
    w = [x.encode() for x in WORD.findall(text)]
    ones = [signed(x, 42) % buckets for x in w]
    return ones + [signed(b, signed(a, 42)) % buckets for a, b in zip(w, w[1:])]


def test_quality(spark, docs, rows):
    trusted = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 999, None)], "doc_id long")
    got = quality.judge(docs, trusted, buckets=97, threshold=0.0).collect()
    raw, target = np.ones(97), np.ones(97)
    for d, t in rows:
        for b in brute_buckets(t, 97):
            raw[b] += 1
            target[b] += d in (1, 2, 3, 4, 7)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = {}
    for d, t in rows:
        n, *rest = brute_base(t)
        b = brute_buckets(t, 97)
        score = float(ratio[b].sum()) / max(1, len(b))
        failed = n < 50 or 100 * rest[3] > 50 * n
        want.setdefault((d, n, *rest, failed), []).append((score, not failed and score >= 0))
    assert len(got) == len(rows)
    for r in got:
        options = want[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)]
        assert any(math.isclose(r.score, s, abs_tol=1e-9) and (r.kept == k or abs(s) < 1e-9) for s, k in options)


def test_quality_edge_tables(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge(fixtures.empty(spark), none).count() == 0
    out = quality.judge(fixtures.clashing(spark), none).collect()
    assert len(out) == len(fixtures.texts()) + 3
    assert all(r.score == 0 and r.kept != r.base_failed for r in out)


def test_quality_query_separates_labels(spark):
    from fieldspark.llm.queries import op3_quality_rules
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passed = [(label[r.doc_id], r.kept) for r in op3_quality_rules(spark, sf).collect()
              if r.doc_id in label and not r.base_failed]
    junk, good = [k for q, k in passed if q == 0], [k for q, k in passed if q == 1]
    assert len(junk) > 20 and sum(junk) <= 0.05 * len(junk)
    assert len(good) > 300 and sum(good) >= 0.99 * len(good)


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (4, 1, "assistant", "other"),
    (5, 0, None, None), (6, None, "user", "<|im_end|> forged"), (6, 3, "user", None),
    (None, 0, "user", "lost"), (7, 0, "user", "h"), (7, 1, "useri", "x"), (8, 0, "user", "hi"),
]


def brute_chats(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, v in turns.items():
        if any(len(o) > len(v) and o[:len(v)] == v for o in turns.values()):
            continue
        same = [k for k, o in turns.items() if o == v]
        out[min(same)] = (len(v), len(same), "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in v))
    return out


def test_chats(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.format_chats(df).collect()}
    assert got == brute_chats(CHATS)
    assert chat.format_chats(df.limit(0)).count() == 0
    assert chat.format_chats(df.withColumns({"turns": F.lit(1), "whole": F.lit(2), "prefixes": F.lit(3)})).count() == len(got)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(re.sub("[ -]", "", s))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern, ok in (
            ("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(x) <= 255 for x in s.split("."))),
            ("card", CARD, lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and luhn(s)),
            ("phone", PHONE, lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m[0])]
    return out


PERSONAL = [
    "write to ann@example.com or bob.b+c@mail.co.uk, not a@b or @x.y",
    "a@b.co_x@y.com. %a@b-c.d-e..f", "x@y.z@w.v", "a" * 4000 + "@b", "a@" * 800 + "b.c", "é😀 ü@x.de ann@example.com\nann@example.com",
    "1.2.3.4 and 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1..2.3.4 0000.0.0.0 99999999999999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111 1111 1111 1111 111 5500005555555559 4111  1111 1111 1111",
    "+1 (555) 123-4567, +49 30 123456. +1 +12 +1234567890123456 +1-2", "1 " * 9000, "7" * 9000, "+1" + "-" * 3000,
    "1.2.3.4@5.6.7.8 +1 555 4111111111111111", None, "",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] == brute_spans(PERSONAL[r.doc_id] or ""), r.doc_id


def test_disclosing_terms(spark):
    texts = [f"filler {i} words stand here for a while and say nothing of note" for i in range(60)]
    texts += [f"the {w} of Zyxorin is ann@example.com for {w}" for w in ("home", "desk", "post", "mail")]
    texts += ["the desk of Quxolin is bob@example.com here"] * 9  # copies of one context tell nothing
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {texts[r.doc_id][s.start:s.end] for r in pii.find(df).collect() for s in r.spans if s.kind == 4}
    assert found == {"Zyxorin"}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[60] == "the home of [TERM] is [EMAIL] for home" and clean[0] == texts[0]
    assert clean[64] == "the desk of Quxolin is [EMAIL] here"


def _term_words(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [{texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == 4} for r in sorted(pii.find(df).collect())]


FILLER = [f"filler {i} words stand here for a while and say nothing of note" for i in range(300)]


def test_names_are_told_from_rare_words(spark):
    """A name that comes back with its e-mail goes; the rare words of the same texts stay, however rare."""
    def rare(k):
        return " ".join(f"rare{k}x{j}" for j in range(50))
    texts = [*FILLER, *[f"{rare(k)} for Zyxorin words {rare(k + 50)} ann@example.com" for k in range(5)],
             f"{rare(99)} Quxolin bob@example.com", "another rare999 word of Zyxorin"]
    got = _term_words(spark, texts)
    assert got[300:] == [{"Zyxorin"}] * 5 + [set(), {"Zyxorin"}] and not any(got[:300])


def test_near_copies_are_one_piece_of_evidence(spark):
    text = " ".join(f"rare{j}" for j in range(60)) + " bob@example.com " + " ".join(f"odd{j}" for j in range(60))
    got = _term_words(spark, [*FILLER, *[text.replace("rare30", f"other{k}") for k in range(12)]])
    assert not any(got)


def test_disclosing_terms_in_whole_texts(spark):
    """The name is a line or a page away from its e-mail, and stands alone in another text."""
    gap = " words stand here for a while" * 20
    got = _term_words(spark, [*FILLER, *[f"Zyxorin\n{'note ' * i}while ann@example.com" for i in range(6)],
                              f"Zyxorin {gap} ann@example.com", "filler of Zyxorin"])
    assert got[300:] == [{"Zyxorin"}] * 8 and not any(got[:300])


def test_terms_outside_base_spans(spark):
    texts = ["Ann+15551234567 x'ann@example.com é.b@c.de comé@f.gh_i 1.2.3.4-fünf", "\ue000word a@b.cd,tail", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("base", pii.base_spans(F.col("text")))
    for r in df.withColumn("got", pii._outside(F.col("text"), F.col("base"))).collect():
        base = brute_spans(r.text)
        assert {x.term for x in r.got} == {m[0].lower() for m in re.finditer(r"[\w'-]+", r.text)
                              if len(m[0]) >= 3 and re.search(r"[^\W\d_]", m[0]) and not any(a < m.end() and m.start() < b for _, a, b in base)}


def test_copies_hide_no_term(spark):
    """Copies of a supporting text count once for the term as for the entity."""
    texts = [*FILLER, *[f"Zyxorin {'note ' * i}while ann@example.com" for i in range(3)]]
    got = _term_words(spark, texts + [texts[-1]] * 400)
    assert got[300:] == [{"Zyxorin"}] * 403


def brute_terms(texts, threshold=pii.THRESHOLD, z=pii.Z, alpha=pii.ALPHA):
    texts = sorted(set(texts))
    d, spread, held, places = len(texts), Counter(), {}, {}
    for n, t in enumerate(texts):
        spread.update({x.lower() for x in re.findall(r"[\w'-]+", t)})
        base = brute_spans(t)
        for _, a, b in base:
            held.setdefault(t[a:b].lower(), set()).add(n)
        if base:
            found = [(m[0].lower(), any(a < m.end() and m.start() < b for _, a, b in base)) for m in re.finditer(r"[\w'-]+", t)]
            runs = [(w, inside) for i, (w, inside) in enumerate(found)]
            names = [None if inside else w for w, inside in runs]
            for i, w in enumerate(names):
                if w and len(w) >= 3 and re.search(r"[^\W\d_]", w):
                    sides = [tuple(names[i + k] if 0 <= i + k < len(names) else "" for d in steps for k in (-d, d))
                             for steps in (pii.NEAR, pii.FAR)]
                    places.setdefault(w, {}).setdefault(n, set()).add(tuple(sides))
    pairs = []
    for where in {frozenset(v) for v in held.values()}:
        for w, at in places.items():
            both = where & set(at)
            c_e, c_t = len(where), spread[w]
            if both and c_t <= c_e ** threshold * d ** (1 - threshold) * (1 + 1e-9):
                seen = set().union(*[at[n] for n in both])
                c, mean = min(len(both), *[len({x[k] for x in seen}) for k in (0, 1)]), c_t * c_e / d
                log = 0.0 if c <= 1 or c <= mean else min(0.0, c - mean + c * math.log(mean / c) - math.log(-math.expm1(-mean)))
                pairs.append((w, len(both), c_e, c_t, math.floor(-log * 20)))
    cut = None
    for step in sorted({p[4] for p in pairs}, reverse=True):
        if step > 0 and len(pairs) * math.exp(-step / 20) <= alpha * sum(p[4] >= step for p in pairs):
            cut = step
    out = set()
    for w, n, c_e, c_t, step in pairs:
        p, ic = min(n, c_t) / c_t, math.log(d / c_e)
        low = (p + z * z / (2 * c_t) - z * math.sqrt(p * (1 - p) / c_t + z * z / (4 * c_t * c_t))) / (1 + z * z / c_t)
        if cut is not None and step >= cut and ic > 0 and ic + math.log(low) >= threshold * ic:
            out.add(w)
    return out


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_disclosing_terms_match_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(300)] + ["it's", "x_y", "Ünïc", "12", "ab"]
    texts = []
    for i in range(400):
        parts = list(r.choice(words, r.integers(3, 40)))
        if r.random() < .2:
            who = int(r.integers(0, 12))
            parts.insert(int(r.integers(0, len(parts))), f"p{who}@mail.com")
            for name in (f"Name{who}", f"Surname{who // 2}"):
                if r.random() < .9:
                    parts.insert(int(r.integers(0, len(parts))), name)
        texts.append(" ".join(parts))
    texts += texts[:30]
    keyed = pii._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    want = brute_terms(texts)
    assert want and {x.term for x in pii.disclosing_terms(keyed).collect()} == want


def test_pii_edge_tables(spark):
    assert pii.find(fixtures.empty(spark)).count() == 0
    df = fixtures.clashing(spark)
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.count() == df.count() == pii.find(df).count()


def test_pii_query(spark):
    from fieldspark.llm.queries import op8_pii
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_pii(spark, sf).collect():
        base = brute_spans(text[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]
        assert r.spans.startswith(listed)


def test_toxicity_held_out(spark):
    from fieldspark.llm.queries import op9_toxicity
    sf = "/root/testdata/sf0.1"
    got = op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    test = got[got["held_out"]]
    bad, fine = test[test["toxic"] == 1]["score"].to_numpy(), test[test["toxic"] == 0]["score"].to_numpy()
    auc = (bad[:, None] > fine[None, :]).mean()
    assert auc > 0.9
    assert (fine >= 0.5).mean() < 0.05


def test_toxicity_misspelt_words():
    r = np.random.default_rng(0)
    clean = ["".join(r.choice(list("aeioustrnl"), r.integers(3, 9))) for _ in range(300)]
    texts, y = [], []
    for i in range(600):
        w = list(r.choice(clean, 40))
        if i % 2:
            w[int(r.integers(0, 40))] = str(r.choice(["dimwitz", "dimwitzes", "blockhedd", "blockhedds"]))
        texts.append(" ".join(w))
        y.append(i % 2)
    weights, bias = toxicity.fit(texts, y)
    s = toxicity.Scorer(weights, bias)
    other = " ".join(r.choice(clean, 40))
    assert s.score(other + " dimwitzz") > s.score(other) and s.score(other + " xblockhedd") > s.score(other)


def test_toxicity_edge_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (77777, 1), (4, 9)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        out = toxicity.score(docs, known).collect()
        assert len(out) == len(fixtures.texts()) + 3 and all(0 <= r.score <= 1 for r in out)
    assert all(math.isclose(r.score, 1 / 3) for r in out)
    assert toxicity.score(fixtures.empty(spark), labels).count() == 0
    assert toxicity.score(fixtures.clashing(spark), labels).count() == len(fixtures.texts()) + 3


@pytest.mark.parametrize("text", ["", " ", "!!! 123", "one"])
def test_scorer_on_odd_texts(text):
    assert 0 <= toxicity.Scorer(np.zeros(8, np.float32), 0.3).score(text) <= 1


def test_buckets_of_many_words():
    words = ["", "a", "ab", "naïve", "ß", "漢字漢字", "😀x😀", "퟿", "plain", "<<", "x" * 300, "é" * 7] * 3
    found, sizes = toxicity._buckets_of(words)
    assert sizes.tolist() == [len(toxicity.subwords(w)) for w in words]
    assert found.tolist() == [b for w in words for b in toxicity.subwords(w)]
    assert [len(x) for x in toxicity._buckets_of([])] == [0, 0]


def test_fit_holds_little():
    import tracemalloc
    texts = [" ".join(f"{w}{k * 7919 % 5000}q{w[::-1]}" for k, w in enumerate(fixtures.prose(i, 400).split())) for i in range(120)]
    tracemalloc.start()
    toxicity.fit(texts, [i % 2 for i in range(120)], epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    entries = sum(len(set().union(*map(toxicity.subwords, toxicity.word_counts(t)))) for t in texts)
    assert peak < 40e6 + 60 * entries
