"""Blocked raster files: written by tasks block by block, read by windows with byte ranges.

A file is ``FSB1``, compressed blocks, a JSON footer with the grid and the place and
checksum of every block, the footer's length, and ``FSB1`` again. A writer streams blocks and
never holds a file; a reader fetches the footer and only the blocks its windows touch, so
one file can be read by many tasks. Blocks are float32, bands first, padded with NaN.

Tasks open files by ``pyarrow.fs``, so ``root`` may be local or any store it knows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAGIC = b"FSB1"
#: Rows and columns of a block.
BLOCK = 256
#: Blocks a task keeps while its windows go along a file.
KEEP = 32

_META = ("height long, width long, bands int, dtype string, crs string, res double, nodata double, "
         "band_names array<string>, error string")


class CorruptBlock(ValueError):
    """A block that cannot be read or does not match its checksum."""


def _file_system(uri: str):
    from pyarrow import fs
    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def encode_block(values: np.ndarray) -> bytes:
    """(bands, rows, columns) as compressed little-endian float32."""
    return zlib.compress(np.ascontiguousarray(values, "<f4").tobytes(), 1)


def footer(meta: dict, index: dict[str, list[int]]) -> bytes:
    text = json.dumps(meta | {"index": index}).encode()
    return text + len(text).to_bytes(4, "little") + MAGIC


class BlockFile:
    """One open file; ``file`` needs ``size()`` and ``read_at(count, offset)``."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        tail = bytes(file.read_at(8, size - 8)) if size >= 12 else b""
        if tail[4:] != MAGIC:
            raise ValueError("no footer")
        length = int.from_bytes(tail[:4], "little")
        self.meta = json.loads(bytes(file.read_at(length, size - 8 - length)))
        self.index = self.meta.pop("index")
        self.kept: dict[str, np.ndarray] = {}

    def block(self, row: int, col: int) -> np.ndarray | None:
        """(bands, block, block) values; None where nothing was written."""
        name, side = f"{row},{col}", self.meta["block"]
        if name not in self.index:
            return None
        if name not in self.kept:
            at, length, crc = self.index[name]
            data = bytes(self.file.read_at(length, at))
            if zlib.crc32(data) != crc:
                raise CorruptBlock(f"block {name}: checksum differs")
            while len(self.kept) >= KEEP:
                self.kept.pop(next(iter(self.kept)))
            self.kept[name] = np.frombuffer(zlib.decompress(data), "<f4").reshape(self.meta["bands"], side, side)
        return self.kept[name]

    def window(self, row_off: int, col_off: int, size: int) -> np.ndarray:
        """(bands, size, size) values from an offset; what lies outside the raster or was not written is NaN."""
        side = self.meta["block"]
        out = np.full((self.meta["bands"], size, size), np.nan, np.float32)
        r0, c0 = max(row_off, 0), max(col_off, 0)
        r1, c1 = min(row_off + size, self.meta["height"]), min(col_off + size, self.meta["width"])
        for br in range(r0 // side, -(-r1 // side) if r1 > r0 else 0):
            for bc in range(c0 // side, -(-c1 // side) if c1 > c0 else 0):
                values = self.block(br, bc)
                if values is not None:
                    a, b = max(r0, br * side), min(r1, (br + 1) * side)
                    c, d = max(c0, bc * side), min(c1, (bc + 1) * side)
                    out[:, a - row_off:b - row_off, c - col_off:d - col_off] = \
                        values[:, a - br * side:b - br * side, c - bc * side:d - bc * side]
        return out


class _Ranges:
    """Byte ranges of a stored file."""

    def __init__(self, uri: str) -> None:
        files, path = _file_system(uri)
        self.file = files.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, count: int, offset: int) -> bytes:
        return self.file.read_at(count, offset)


def write_blocks(pixels: DataFrame, grids: DataFrame, root: str, bands: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Write (file, row, col, bands) pixels as files under ``root``; returns (file, blocks, bytes).

    ``grids`` has one row per file: file, height, width, crs, res, nodata. Pixels are encoded
    block by block in parallel; each file is then streamed by one task from its compressed
    blocks. A file appears under its name only when it is whole, so a retried task leaves
    the same file. Of pixels given twice the larger values stay.
    """
    names = list(bands)
    keys = ["file", "_br", "_bc"]
    one = pixels.groupBy("file", "row", "col").agg(*[F.max(b).cast("float").alias(b) for b in names])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.full((len(names), block, block), np.nan, np.float32)
        values[:, (pdf["row"] % block).to_numpy(), (pdf["col"] % block).to_numpy()] = pdf[names].to_numpy(np.float32).T
        return pd.DataFrame({"file": [key[0]], "_br": [key[1]], "_bc": [key[2]], "data": [encode_block(values)]})

    blocks = one.withColumns({"_br": F.expr(f"row div {block}"), "_bc": F.expr(f"col div {block}")}) \
        .groupBy(*keys).applyInPandas(pack, "file string, _br long, _bc long, data binary")
    whole = blocks.join(grids.select("file", "height", "width", "crs", "res", "nodata"), "file")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, index, meta, done = None, None, 0, {}, {}, []

        def close() -> None:
            tail = footer(meta, index)
            out.write(tail)
            out.close()
            files.move(part, path)
            done.append((name, len(index), at + len(tail)))
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != name:
                    if out is not None:
                        close()
                    name, index = r["file"], {}
                    files, path = _file_system(f"{root.rstrip('/')}/{name}")
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(part)
                    out.write(MAGIC)
                    at = len(MAGIC)
                    meta = {"height": r["height"], "width": r["width"], "bands": len(names), "block": block, "dtype": "float32",
                            "crs": r["crs"], "res": r["res"], "nodata": r["nodata"], "band_names": names}
                out.write(r["data"])
                index[f"{r['_br']},{r['_bc']}"] = [at, len(r["data"]), zlib.crc32(r["data"])]
                at += len(r["data"])
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * 3,
                                                                        (pa.string(), pa.int64(), pa.int64()))],
                                         ["file", "blocks", "bytes"])
    return whole.repartition("file").sortWithinPartitions(*keys).mapInArrow(store, "file string, blocks long, bytes long")


def listing(spark: SparkSession, root: str, pattern: str = "*.fsb") -> DataFrame:
    """(file, uri, length) of the files below ``root``; no content is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root) \
        .select(F.substring("path", F.lit(len(base) + 2), F.length("path")).alias("file"), F.col("path").alias("uri"), "length")


def raster_metadata(spark: SparkSession, root: str, pattern: str = "*.fsb") -> DataFrame:
    """Grid, bands, type, CRS, resolution and nodata of every file, from its footer; ``error`` where it has none."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("height", "width", "bands", "dtype", "crs", "res", "nodata", "band_names")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()))
        for batch in batches:
            rows = []
            for uri in batch.column(1).to_pylist():
                try:
                    meta = BlockFile(_Ranges(uri)).meta
                    rows.append([*[meta.get(f) for f in fields], None])
                except (OSError, ValueError) as e:
                    rows.append([None] * len(fields) + [str(e)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((*kinds, pa.string()))]],
                ["file", *fields, "error"])
    return listing(spark, root, pattern).select("file", "uri").mapInArrow(read, f"file string, {_META}")


def read_windows(planned: DataFrame, root: str, pattern: str = "*.fsb", values: bool = False,
                 stripe: int = 8) -> DataFrame:
    """Planned window reads with what was found: ``status``, ``finite_share`` and, if wanted, ``values``.

    ``planned`` has file (below ``root``), row_off, col_off, size and any key columns. Every
    planned read comes back once: ``missing`` where the file is absent, ``unreadable`` where
    it has no footer, ``corrupt`` where a block of the window fails its checksum, else ``ok``.
    Windows of ``stripe`` chip rows of a file form a unit, so a large file spreads over tasks
    and neighbours share their blocks. ``values`` is bands x rows x columns, flat.
    """
    spark = planned.sparkSession
    kept = [c for c in planned.columns if c not in ("uri", "length", "status", "finite_share", "values")]
    found = planned.select(*kept).join(listing(spark, root, pattern).select("file", "uri"), "file", "left")
    extra = "status string, finite_share double" + (", values array<float>" if values else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*kept).schema) + ", " + extra

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file, failed = None, None, False
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                status, share, out = [], [], []
                for r in part.select(["uri", "row_off", "col_off", "size"]).to_pylist():
                    got = None
                    if r["uri"] is None:
                        status.append("missing")
                    else:
                        if r["uri"] != uri:
                            uri, failed = r["uri"], False
                            try:
                                file = BlockFile(_Ranges(uri))
                            except (OSError, ValueError):
                                failed = True
                        try:
                            got = None if failed else file.window(r["row_off"], r["col_off"], r["size"])
                            status.append("unreadable" if failed else "ok")
                        except (OSError, CorruptBlock, zlib.error):
                            status.append("corrupt")
                    share.append(None if got is None else float(np.isfinite(got).mean()))
                    out.append(None if got is None else got.ravel())
                columns = [part.column(c) for c in kept] + [pa.array(status), pa.array(share, pa.float64())]
                if values:
                    columns.append(pa.array(out, pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "status", "finite_share", *["values"] * values])

    unit: Column = F.floor(F.col("row_off") / (F.col("size") * stripe))
    return found.repartition("file", unit).sortWithinPartitions("file", "row_off", "col_off") \
        .select(*kept, "uri").mapInArrow(read, schema)
