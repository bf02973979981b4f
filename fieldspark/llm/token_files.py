"""Token-id files: flat unsigned integers beside 64-bit document offsets.

Documents are range-partitioned and sorted by id; each task encodes its range and writes
``<part>.bin`` (ids, back to back, in the smallest unsigned type the vocabulary fits)
and ``<part>.idx`` (one little-endian 64-bit offset per document plus the end). A
manifest table lists the parts; the base of a part is the prefix sum of the token counts
before it. Files go to the shared folder under a name that holds the attempt, and only
parts that the manifest of the finished job lists count, so retried or lost tasks leave
nothing in the result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import LAST, canonical, materialise, shared_path
from .tokens import VOCABULARY, encoded, encoder

_MANIFEST = "part long, name string, first_doc long, n_docs long, n_tokens long, width long"


def _files(uri: str):
    """(file system, path) of a shared folder, for tasks."""
    from pyarrow import fs
    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY, end: int | None = 0) -> DataFrame:
    """Encode every text and write the files under ``path``; returns their manifest.

    Manifest rows: part (in document order), name, first_doc (documents before it), base
    (ids before it), n_docs, n_tokens, width (bytes per id). Null texts are empty, null
    ids come last, rows with equal ids lie side by side. No documents give no parts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if encoder(vocabulary).size <= 1 << 16 else 4
        kind = f"<u{width}"
        part, name, ends, total, out = TaskContext.get().partitionId(), "", [0], 0, None
        keys: list = []
        for docs, ids in encoded(batches, vocabulary, end):
            if out is None:
                name = f"{part:06d}-{uuid.uuid4().hex}"
                files, folder = _files(path)
                files.create_dir(folder, recursive=True)
                out = files.open_output_stream(f"{folder}/{name}.bin")
            for b in ids:
                total += len(b) // 4
                ends.append(total)
            out.write(np.frombuffer(b"".join(ids), "<u4").astype(kind).tobytes())
            keys += docs
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{folder}/{name}.idx") as f:
            f.write(np.array(ends, "<i8").tobytes())
        with files.open_output_stream(f"{folder}/{name}.doc") as f:
            f.write(np.array([LAST if k is None else k for k in keys], "<i8").tobytes())
        row = (part, name, 0, len(keys), total, width)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row],
                                         ["part", "name", "first_doc", "n_docs", "n_tokens", "width"])

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = canonical(df, id_col, text_col).repartitionByRange(n, F.col("doc_id").asc_nulls_last()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    parts = materialise(ordered.mapInArrow(run, _MANIFEST), "token_parts")
    # one row per part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(parts.select(
        "part", "name", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("first_doc"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_docs", "n_tokens", "width"), "token_manifest")


def _mapped(path: str, name: str, kind: str) -> np.ndarray:
    files, folder = _files(path)
    from pyarrow import fs
    if isinstance(files, fs.LocalFileSystem):
        source = f"{folder}/{name}"
        return np.memmap(source, kind, "r") if files.get_file_info(source).size else np.empty(0, kind)
    with files.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document, read back from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                ids = _mapped(path, m["name"] + ".bin", f"<u{m['width']}")
                ends = _mapped(path, m["name"] + ".idx", "<i8")
                docs = _mapped(path, m["name"] + ".doc", "<i8")
                for k in range(0, m["n_docs"], 256):
                    e = np.asarray(ends[k:k + 257])
                    flat = np.asarray(ids[e[0]:e[-1]]).astype(np.int32)
                    keys = np.asarray(docs[k:k + 256])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=keys == LAST), pa.array(m["base"] + e[:-1]),
                         pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(flat))],
                        ["doc_id", "start", "ids"])
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "base", "n_docs", "width").repartition(n, "name") \
        .mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (ids as little-endian unsigned 32-bit) of read documents."""
    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat, at = lists.flatten().to_numpy().astype("<u4"), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])
    return read.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_path(spark: SparkSession) -> str:
    return shared_path(spark, "tokens")
