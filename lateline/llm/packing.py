"""Best-fit packing of token sequences into windows of fixed capacity.

Only documents over the capacity are cut, into full pieces with a shorter first one. What decides a packing is how many
pieces there are of each length, so the plan is made from that histogram (at most ``capacity`` numbers): lengths above a
third of the capacity share a window at most in twos and are matched greedily, the largest with the largest partner that
fits; smaller ones then go, in falling order, to the smallest gap that takes them. The plan is a bounded list of window
kinds with counts. Pieces of a length are numbered (counts per bucket, then numbers within a bucket), and an equality join
on the length with the bounded plan gives each its window and offset: no task and no driver sees all pieces.

Nulls and edge cases: a null text is empty and is the end id alone; a null id is packed like any other; rows that repeat
an id are packed once per row; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, written
from .tokens import encoder

BUCKET = 50_000           # pieces numbered by one window partition


@dataclass
class Kind:
    """``count`` windows with the same content: lengths with how often each lies in one window."""

    count: int
    gap: int
    holds: list[tuple[int, int]] = field(default_factory=list)


def plan(counts: dict[int, int], capacity: int) -> list[Kind]:
    left = {n: c for n, c in counts.items() if c}
    kinds: list[Kind] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        twin = left[a] - 1
        i = bisect_left(large, capacity - a + 1) - 1
        if i >= 0 and large[i] == a and twin == 0:
            i -= 1
        if i < 0:
            kinds.append(Kind(left[a], capacity - a, [(a, 1)]))
            left[a] = 0
        elif large[i] == a:
            kinds.append(Kind(left[a] // 2, capacity - 2 * a, [(a, 2)]))
            left[a] %= 2
        else:
            b, k = large[i], min(left[a], left[large[i]])
            kinds.append(Kind(k, capacity - a - b, [(a, 1), (b, 1)]))
            left[a], left[b] = left[a] - k, left[b] - k
            if not left[b]:
                large.pop(i)
        if not left[a]:
            large.pop()
    gaps = sorted((k.gap, i) for i, k in enumerate(kinds))
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(gaps, (s, -1))
            if at == len(gaps):
                kinds.append(Kind(-(-n // (capacity // s)), capacity))
                insort(gaps, (capacity, len(kinds) - 1))
                continue
            gap, i = gaps.pop(at)
            each, kind = gap // s, kinds[i]
            full, over = divmod(n, each)
            for number, times in ((min(full, kind.count), each), (1 if full < kind.count else 0, over)):
                if number and times:
                    new = Kind(number, gap - times * s, [*kind.holds, (s, times)])
                    kinds.append(new)
                    insort(gaps, (new.gap, len(kinds) - 1))
                    kind.count -= number
                    n -= number * times
            if kind.count:
                insort(gaps, (gap, i))
    return [k for k in kinds if k.count]


def slots(kinds: list[Kind]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first number, past the last number, per window, first window, offset in it)."""
    taken: dict[int, int] = {}
    out, window = [], 0
    for kind in kinds:
        offset = 0
        for length, times in kind.holds:
            at = taken.get(length, 0)
            taken[length] = at + kind.count * times
            out.append((length, at, taken[length], times, window, offset))
            offset += length * times
        window += kind.count
    return out


def pieces(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2,
           drops_white: bool = False, keep_ids: bool = False, special: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): each document's ids, the end id last, cut where over capacity."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        enc = encoder(path, drops_white, special)
        for b in batches:
            rows = []
            for i, raw in zip(b["id"], enc.encode(b["text"]), strict=True):
                raw += tail
                n = len(raw) // 4
                first = n if n <= capacity else n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for p, (f, t) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = raw[4 * f:4 * t]
                    rows.append((i, p, f, t - f, zlib.crc32(part), *([part] if keep_ids else [])))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])
            yield out.astype({"id": "Int64"})

    kept = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return kept.mapInPandas(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(cut: DataFrame, *, capacity: int = 1024, bucket: int = BUCKET) -> DataFrame:
    """Add (sequence_id, offset) to pieces of at most ``capacity``; reads its input more than once, so write it before."""
    spark = cut.sparkSession
    # At most ``capacity`` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    n = max(1, sum(counts.values()) // bucket)
    put = spark.createDataFrame(slots(plan(counts, capacity)),
                                "length long, low long, high long, times long, window long, place long")
    own = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(n)))
    before = Window.partitionBy("length").orderBy("bucket")
    base = (own.groupBy("length", "bucket").agg(F.count("*").alias("n"))
            .select("length", "bucket", (F.sum("n").over(before) - F.col("n")).alias("base")))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    numbered = (own.withColumn("k", F.row_number().over(within)).join(base, ["length", "bucket"])
                .withColumn("k", F.col("base") + F.col("k") - 1))
    # The plan has a few thousand rows at most, a function of the capacity alone.
    return (numbered.join(F.broadcast(put), "length").where("k >= low and k < high")
            .withColumn("j", F.col("k") - F.col("low"))
            .withColumn("sequence_id", F.expr("window + j div times"))
            .withColumn("offset", F.expr("place + (j % times) * length"))
            .select(*cut.columns, "sequence_id", "offset"))


def packed(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2,
           drops_white: bool = False, keep_ids: bool = False, special: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    cut = written(pieces(docs, path, id=id, text=text, capacity=capacity, end=end, drops_white=drops_white,
                         keep_ids=keep_ids, special=special), "pieces", TEXTS)
    return pack(cut, capacity=capacity).withColumnRenamed("id", id)


def sequences(packed_rows: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, length) from rows packed with ``keep_ids``: each window's ids in order."""
    return (packed_rows.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
            .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "length"))
