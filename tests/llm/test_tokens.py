import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fieldspark.llm import bpe, packing, token_files, tokens

from . import fixtures


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ranked():
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def noise(seed):
    r = random.Random(seed)
    alphabet = ["a", "b", "E", "th", "ing", "é", "ß", "漢", "😀", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", "　",
                "'s", "'", "1", "234", ".", "!?", "_", "́", "‍"]
    return "".join(r.choice(alphabet) for _ in range(r.randrange(60)))


def test_chunks_encode_like_whole_texts(library):
    coder = tokens.Encoder(tokens.VOCABULARY, memo=50)
    for k in range(0, 1500, 50):
        part = [noise(i) for i in range(k, k + 50)]
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(part)] == [library(t) for t in part]
        assert ["".join(tokens.chunks(t)) for t in part] == part


def test_bpe_equals_the_library(ranked):
    coder = bpe.Codec(memo=200)
    r = random.Random(1)
    samples = [noise(i) for i in range(1500)] + ["".join(map(chr, r.choices(range(32, 0x2fff), k=30))) for _ in range(300)]
    samples += ["a" * 3000, "ab" * 2000, "x" * 5001, "🙂" * 500]
    for t in samples:
        ids = coder.encode(t)
        assert ids.tolist() == ranked(t)
        assert coder.decode(ids).tobytes() == t.encode()


def test_adjacent_tokens_agree_as_the_merges_say():
    coder = bpe.Codec()
    r = random.Random(9)
    some = list(coder.bytes)
    pairs = [(r.choice(some), r.choice(some)) for _ in range(4000)] + [(i, j) for i in range(60) for j in range(60)]
    for t in r.sample(some, 3000):  # neighbours that do occur in tokens
        raw = coder.bytes[t]
        k = r.randrange(len(raw) + 1)
        pairs += [(coder.ranks[raw[:k]], coder.ranks[raw[k:]])] if raw[:k] in coder.ranks and raw[k:] in coder.ranks else []
    reachable = {t for t in some if len(bpe.merge(coder.bytes[t], coder.ranks, t)) < 3}
    for a, b in pairs:
        if {a, b} <= reachable:
            x, y = coder.bytes[a], coder.bytes[b]
            assert coder.agree[a, b] == (bpe.merge(x + y, coder.ranks) == [x, y]), (x, y)


def test_bpe_query_round_trip(docs, rows, ranked):
    out = bpe.decode(bpe.encode(docs)).collect()
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in out)
    assert got == Counter((d, tuple(ranked(t)), t.encode()) for d, t in rows)


def test_bpe_edge_tables(spark):
    assert bpe.decode(bpe.encode(fixtures.empty(spark))).count() == 0
    assert bpe.encode(fixtures.clashing(spark)).count() == len(fixtures.texts()) + 3


def test_packing_covers_every_id_once(docs, rows, library):
    got = packing.pack(docs, group=7).collect()
    want = Counter()
    for d, t in rows:
        ids = np.array(library(t) + [0], "<u4")
        for k in range(0, len(ids), 1024):
            want[(d, k, len(ids[k:k + 1024]), zlib.crc32(ids[k:k + 1024].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in places.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024


def brute_first_fit(sizes, room):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, f in enumerate(bins) if f + sizes[i] <= room), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += sizes[i]
    return [out[i] for i in range(len(sizes))]


def test_first_fit_decreasing_matches_brute_force():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 257):
        sizes = r.integers(1, 1025, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 1024)
        assert list(zip(bins.tolist(), offsets.tolist())) == brute_first_fit(sizes.tolist(), 1024)
    sizes = r.integers(1, 1025, 4096)
    bins, _ = packing.first_fit_decreasing(sizes, 1024)
    assert (bins.max() + 1) * 1024 < 1.02 * sizes.sum()


def test_packing_edge_tables(spark):
    assert packing.pack(fixtures.empty(spark)).count() == 0
    assert packing.pack(fixtures.clashing(spark)).select("doc_id").distinct().count() == len(fixtures.texts()) + 1


def test_token_files(spark, docs, rows, library):
    path = token_files.token_path(spark)
    manifest = token_files.write_tokens(docs, path)
    read = token_files.read_tokens(manifest, path)
    got = sorted((r.start, r.doc_id, tuple(r.ids)) for r in read.collect())
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    at = 0
    for (start, doc, ids), (want, _) in zip(got, order):
        assert (start, doc) == (at, want)
        at += len(ids)
    assert Counter((d, i) for _, d, i in got) == Counter((d, (*library(t), 0)) for d, t in rows)
    digest = {(r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(read).collect()}
    assert digest == {(s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, _, i in got}


def test_token_files_edge_tables(spark):
    path = token_files.token_path(spark)
    assert token_files.read_tokens(token_files.write_tokens(fixtures.empty(spark), path), path).count() == 0
    path = token_files.token_path(spark)
    df = fixtures.clashing(spark)
    assert token_files.read_tokens(token_files.write_tokens(df, path), path).count() == df.count()


def test_token_id_digest_of_the_query(spark, ranked):
    from fieldspark.llm.queries import op4_byte_bpe
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_byte_bpe(spark, sf).collect():
        ids = ranked(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_packing_keeps_ids_beside_a_null_one(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    df = spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string").coalesce(1)
    assert Counter(r.doc_id for r in packing.pack(df).collect()) == Counter(ids)


def test_encoder_forgets_by_bytes():
    coder = tokens.Encoder(tokens.VOCABULARY, memo=20000)
    texts = [f"word{i} and  more\nlines{i} here " + "x" * (i % 50) for i in range(400)]
    kept = tokens.Encoder(tokens.VOCABULARY)
    assert [coder.encode([t])[0] for t in texts] == kept.encode(texts)
    assert coder.held < 20000 + 2000


def test_unseen_words_ask_for_their_parts_once():
    coder = tokens.Encoder(tokens.VOCABULARY)
    whole = coder.tokenizer.encode
    words = ["Über", "naïve", "ªº", "ŉa", "O'Neil", "it's", "they'll", "x1", "a_b", "don't's", "漢字", "ʼn", "Ωmega", "😀"]
    marks = ["", ",", "'", "''", "...", "_", "&&&", "'s", "’", "\x1c"]
    texts = [f"{a}{w}{m}{s}{w}{m}" for w in words for m in marks for s in (" ", "\n", "  ", "\n\n", "\t") for a in ("", "b ")]
    assert coder.encode(texts) == [np.array(whole(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    asked, model = [], coder.model

    class Counted:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)

    coder.model = Counted()
    coder.encode(["x zebrine, zebrine. zebrine; zebrine\nzebrine!"])
    assert sum("zebrine" in a for a in asked) == 2


def test_round_trip_in_one_worker(spark):
    out = bpe.round_trip(fixtures.clashing(spark)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, bpe.decode(bpe.encode(fixtures.clashing(spark))).collect()))
    plan = bpe.round_trip(fixtures.empty(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert bpe.round_trip(fixtures.empty(spark)).count() == 0
    assert not hasattr(bpe.decoder(bpe.RANKS), "automaton")
