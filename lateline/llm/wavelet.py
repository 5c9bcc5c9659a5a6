"""Token ids as wavelet matrices, one file per shard.

A shard holds the ids of consecutive documents as bit planes, the highest bit first; each plane is ordered by the bits
above it, zeros before ones, and carries a directory of ones per 512 bits. So one file, of as many bits per id as the
largest id needs, gives an id at a place (``access``), how often an id occurs before a place (``rank``), where its k-th
occurrence is (``select``), and all ids (``decode``) without another index.

``write`` orders documents by id over a range partitioning and writes shards from the tasks to a folder that all of them
see; a file appears under its name only when complete, and a repeated task writes the same bytes. ``read`` takes the
files alone.

Nulls and edge cases: a null text is empty and is the end id alone; null ids come first; rows that repeat an id are kept
one by one, in order of their text; other columns are ignored. An empty table writes no file and reads as an empty table.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder

MAGIC = b"WAVE1\0\0\0"
BLOCK = 64                # bytes of a plane per directory entry
SHARD = 1 << 21           # ids after which a shard closes; a document is never split
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_shard(ids: np.ndarray, names: list[int | None], sizes: list[int]) -> bytes:
    """File content for documents ``names`` with ``sizes`` ids each."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    out = [MAGIC, struct.pack("<QQQ", len(ids), len(names), bits),
           np.array([0 if x is None else x for x in names], "<i8").tobytes(),
           np.packbits(np.array([x is None for x in names], bool)).tobytes(), np.array(sizes, "<u8").tobytes()]
    seq = ids.astype(np.uint32 if bits > 16 else np.uint16)
    for bit in range(bits - 1, -1, -1):
        ones = (seq & seq.dtype.type(1 << bit)) != 0
        packed = np.packbits(ones)
        full = np.zeros(-(-len(packed) // BLOCK) * BLOCK, np.uint8)
        full[:len(packed)] = packed
        per = np.bitwise_count(full.view(np.uint64)).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        out += [np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u4").tobytes() if len(per) else b"", full.tobytes()]
        then, zeros = np.empty_like(seq), len(seq) - int(per.sum())
        np.compress(~ones, seq, out=then[:zeros])
        np.compress(ones, seq, out=then[zeros:])
        seq = then
    return b"".join(out)


class WaveletMatrix:
    """Reader of one shard's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.n, n_docs, self.bits = struct.unpack_from("<QQQ", data, 8)
        at = 32
        ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        null = np.unpackbits(np.frombuffer(data, np.uint8, -(-n_docs // 8), at), count=n_docs)
        at += -(-n_docs // 8)
        self.names = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.sizes = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        blocks = -(-(-(-self.n // 8)) // BLOCK)
        self.planes = []
        for _ in range(self.bits):
            before = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            plane = np.frombuffer(data, np.uint8, blocks * BLOCK, at)
            at += blocks * BLOCK
            ones = int(before[-1]) + int(_ONES[plane[-BLOCK:]].sum()) if blocks else 0
            self.planes.append((before, plane, self.n - ones))

    @staticmethod
    def _ones(plane, i: int) -> int:
        """Ones before place ``i``."""
        before, data, _ = plane
        block = min(i // (8 * BLOCK), len(before) - 1)
        byte, bit = divmod(i, 8)
        n = int(before[block]) + int(_ONES[data[block * BLOCK:byte]].sum())
        return n + (int(_ONES[data[byte] >> (8 - bit)]) if bit else 0)

    @staticmethod
    def _find(plane, one: bool, k: int) -> int:
        """Place of the k-th (from 0) one or zero."""
        before, data, _ = plane
        starts = before if one else np.arange(len(before), dtype=np.int64) * 8 * BLOCK - before
        block = int(np.searchsorted(starts, k, "right")) - 1
        bits = np.unpackbits(data[block * BLOCK:(block + 1) * BLOCK])
        return block * 8 * BLOCK + int(np.flatnonzero(bits == one)[k - int(starts[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in self.planes:
            one = p[1][i // 8] >> (7 - i % 8) & 1
            r = self._ones(p, i)
            i = p[2] + r if one else i - r
            value = value << 1 | int(one)
        return value

    def _span(self, symbol: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for depth, p in enumerate(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (p[2] + a, p[2] + b) if symbol >> (self.bits - 1 - depth) & 1 else (low - a, high - b)
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` before place ``i``."""
        if symbol >> self.bits or not self.n:
            return 0
        low, high = self._span(symbol, i)
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        low, high = self._span(symbol, self.n) if self.n and not symbol >> self.bits else (0, 0)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for depth in range(self.bits - 1, -1, -1):
            p = self.planes[depth]
            one = bool(symbol >> (self.bits - 1 - depth) & 1)
            i = self._find(p, one, i - p[2] if one else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids: planes are merged from the lowest to the highest."""
        seq = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for depth in range(self.bits - 1, -1, -1):
            _, plane, zeros = self.planes[depth]
            ones = np.unpackbits(plane, count=self.n).view(bool)
            back = np.empty_like(seq)
            back[np.flatnonzero(~ones)] = seq[:zeros]
            back[np.flatnonzero(ones)] = seq[zeros:] | seq.dtype.type(1 << (self.bits - 1 - depth))
            seq = back
        return seq.astype("<u4")


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole: it gets its name when complete."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    own = f"{root}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{root}/{name}")


def write(docs: DataFrame, folder: str, path: str, *, id: str = "doc_id", text: str = "text", end: int = 2,
          drops_white: bool = True, shard: int = SHARD, special: bool = False) -> DataFrame:
    """Write the shards; rows (part, shard, file, n_tokens), lazily: the files exist once these rows are computed."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        enc = encoder(path, drops_white, special)
        names, raws, total, k, part = [], [], 0, 0, None

        def close():
            file = f"shard-{part:06d}-{k:06d}.wave"
            ids = np.frombuffer(b"".join(raws), "<u4")
            _put(folder, file, encode_shard(ids, names, [len(r) // 4 for r in raws]))
            return pd.DataFrame({"part": [part], "shard": [k], "file": [file], "n_tokens": [len(ids)]})

        for b in batches:
            for i, p, raw in zip(b["id"], b["part"], enc.encode(b["text"]), strict=True):
                part = int(p)
                names.append(None if pd.isna(i) else int(i))
                raws.append(raw + tail)
                total += len(raw) // 4 + 1
                if total >= shard:
                    yield close()
                    names, raws, total, k = [], [], 0, k + 1
        if names:
            yield close()

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    system.create_dir(root)
    kept = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    parts = kept.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return (parts.withColumn("part", F.spark_partition_id())
            .mapInPandas(run, "part int, shard int, file string, n_tokens long"))


def read(spark: SparkSession, folder: str, *, id: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32, file, place) of every document, from the files in ``folder``."""
    def run(batches):
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                w = WaveletMatrix(bytes(data))
                raw, ends = w.decode().tobytes(), np.concatenate([[0], np.cumsum(w.sizes)])
                yield pd.DataFrame({
                    "id": pd.array(w.names, "Int64"), "place": ends[:-1], "n_tokens": w.sizes,
                    "ids_crc32": [zlib.crc32(raw[4 * f:4 * t]) for f, t in zip(ends, ends[1:], strict=False)],
                    "file": file.rpartition("/")[2], "size": w.n})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wave").load(folder).select("path", "content")
    rows = files.mapInPandas(run, "id long, place long, n_tokens long, ids_crc32 long, file string, size long")
    return rows.withColumnRenamed("id", id)


def starts(manifest: DataFrame) -> DataFrame:
    """Rows (file, base): ids in all files before one. Totals per part first, so the only unpartitioned window has a
    row per part, whose number the session's shuffle partitions fix."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("shard")
    return (manifest.withColumn("own", F.sum("n_tokens").over(within) - F.col("n_tokens")).join(parts, "part")
            .select("file", (F.col("before") + F.col("own")).alias("base")))


def documents(spark: SparkSession, folder: str, manifest: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) of all documents read back."""
    return (read(spark, folder, id=id).join(starts(manifest), "file")
            .select(id, (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"))
