"""The pipeline and the registered queries."""

import inspect
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from fieldspark.llm import queries
from tools.verify import compare, oracle

from . import fixtures
from .test_dedup import brute_lines, roots
from .test_near_copies import brute_links
from .test_text import brute_spans

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert all(list(inspect.signature(f).parameters) == ["spark", "sf_dir"] for f in queries.QUERIES.values())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, name):
    assert isinstance(oracle(SF), duckdb.DuckDBPyConnection)
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(got, oracle(SF).execute(queries.SQL[name]).df()).startswith("ok")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialise(stage(spark, out[-1], SF), "test_stage"))
    return [x.toPandas() for x in out]


def test_stages_match_brute_force(stages):
    raw, clean, lines, single, safe, packed = stages
    assert all(list(x.columns) == list(raw.columns) for x in (clean, lines, single, safe))
    assert set(clean["doc_id"]) <= set(raw["doc_id"]) and len(clean) > 0.7 * len(raw)
    want = {(d, gone) for d, _, _, gone in brute_lines(list(zip(clean["doc_id"], clean["text"])), 1)}
    text = dict(zip(clean["doc_id"], clean["text"]))
    kept = {d: "\n".join(s for i, s in enumerate(text[d].split("\n")) if i not in gone) for d, gone in want}
    assert kept == dict(zip(lines["doc_id"], lines["text"]))
    root = roots(lines["doc_id"], brute_links(list(zip(lines["doc_id"], lines["text"]))))
    assert set(root.values()) <= set(single["doc_id"])
    copies = {d for d in root if root[d] != d}
    assert copies and len(copies - set(single["doc_id"])) >= 0.9 * len(copies)
    assert all(not brute_spans(t) for t in safe["text"])
    assert set(safe["doc_id"]) == set(single["doc_id"])
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for d, x in zip(safe["doc_id"], safe["text"])}
    got = Counter(zip(packed["doc_id"], packed["start"], packed["length"], packed["ids_crc32"]))
    assert got == Counter((d, k, len(v[k:k + 1024]), zlib.crc32(v[k:k + 1024].tobytes())) for d, v in ids.items() for k in range(0, len(v), 1024))


def test_stages_on_awkward_tables(spark):
    for make in (fixtures.documents, fixtures.clashing, fixtures.empty):
        df = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.materialise(stage(spark, df, SF), "test_stage")
            if name != "packing":
                assert out.columns == df.columns
            assert (out.count() > 0) == (df.count() > 0)
