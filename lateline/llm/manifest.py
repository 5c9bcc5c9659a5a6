"""Merkle manifest of a dataset: a tree per group of rows, one tree over the groups, and a proof per row.

Rows become leaves of 64 hex digits at once; texts are read once and never travel. Leaves are numbered by a range sort
(counts of its partitions give the offsets) and cut into superblocks of ``arity ** height`` consecutive leaves. Upwards, a
superblock's leaves are reduced to one node, and these nodes are the leaves of the next round until one node is left. Downwards,
the nodes of each round and the outer nodes their superblock needs for its proofs are cogrouped by superblock: every task
finishes its local levels, joins them to the outer ones, and either hands the longer paths to the round below or, at the
leaves, folds each leaf up to the root. No task holds more than a superblock and the paths above it, no group is sent
anywhere whole, and the driver receives single counts.

Nulls and edge cases: a null field is written ``-``; rows with a null group are a group of their own, the first; null ids come
first in their group and equal ids are ordered by their leaves, so repeated rows are leaves each, in any order the same; an
empty table gives an empty result; columns besides the stated ones are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ARITY, HEIGHT = 8, 3


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields: ``-`` for null, else UTF-8 byte count, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place from 0 of each row in its group; ``order`` must tell all rows apart. Written."""
    def count(batches):
        last, n = object(), 0
        for b in batches:
            at = []
            for g in b.column(group).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                at.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "at"])

    sorted_ = (rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("part", F.spark_partition_id()))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = written(sorted_.mapInArrow(count, f"{kinds}, part int, at long"), "placed")
    # One row per group and partition; a group's rows here are as many as partitions it spans.
    sizes = placed.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = sizes.selectExpr(f"{group} AS g", "part", f"sum(n) OVER (PARTITION BY {group} ORDER BY part) - n AS before")
    return written(placed.join(before.withColumnRenamed("part", "p"), F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
                   .withColumn("pos", F.col("before") + F.col("at")).drop("part", "at", "before", "g", "p"), "numbered")


def _levels(hashes: list[str], levels: int, arity: int) -> list[list[str]]:
    out = [hashes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest("".join(last[i:i + arity])) for i in range(0, len(last), arity)])
    return out


def _local(rest: int, arity: int, height: int) -> int:
    """Levels a superblock of a group of ``rest`` nodes reduces: all that are left, at most ``height``."""
    levels = 0
    while rest > 1 and levels < height:
        rest, levels = -(-rest // arity), levels + 1
    return levels


def _tree(leaves: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of nodes (g, n, pos, h) from the leaves up, and the top node (g, h) of each group. ``n``: the group's nodes in the round."""
    size = arity ** height

    def reduce(key, b):
        b = b.sort_values("pos")
        n = int(b["n"].iloc[0])
        top = _levels(list(b["h"]), _local(n, arity, height), arity)[-1]
        return pd.DataFrame({"g": [key[0]], "n": [-(-n // size)], "pos": [key[1]], "h": [top[0]]})

    rounds, now = [], leaves
    while True:
        rounds.append(now)
        now = written(now.withColumn("block", F.expr(f"pos div {size}")).groupBy("g", "block")
                      .applyInPandas(reduce, "g long, n long, pos long, h string"), "nodes")
        if now.where("n > 1").isEmpty():
            return rounds, now.select("g", "h")


def _paths(nodes: pd.DataFrame, over: pd.DataFrame, arity: int, height: int):
    """Each node's siblings, lowest level first: those in its superblock, then the outer ones that were cogrouped with it.

    A level is (how many siblings come before, all of them in a row)."""
    levels = _levels(list(nodes["h"]), _local(int(nodes["n"].iloc[0]), arity, height), arity)
    far = [(int(at), others) for at, others in over.sort_values("level")[["at", "others"]].itertuples(index=False)]
    for i in range(len(nodes)):
        own, k = [], i
        for level in levels[:-1]:
            run = level[k // arity * arity:k // arity * arity + arity]
            own.append((k % arity, "".join(run[:k % arity] + run[k % arity + 1:])))
            k //= arity
        yield own + far


PATH = "g long, block long, level int, at int, others string"


def _descend(rounds: list[DataFrame], outer: DataFrame, arity: int, height: int) -> DataFrame:
    """Paths from every node of the lowest of ``rounds`` to the end of ``outer``; ``block`` is the node's place."""
    def down(nodes, over):
        nodes = nodes.sort_values("pos")
        rows = [(g, p, level, at, others)
                for path, g, p in zip(_paths(nodes, over, arity, height) if len(nodes) else [], nodes["g"], nodes["pos"], strict=True)
                for level, (at, others) in enumerate(path)]
        return pd.DataFrame(rows, columns=["g", "block", "level", "at", "others"])

    for nodes in reversed(rounds):
        left = nodes.withColumn("block", F.expr(f"pos div {arity ** height}"))
        outer = written(left.groupBy("g", "block").cogroup(outer.groupBy("g", "block")).applyInPandas(down, PATH), "outer")
    return outer


def _folded(leaves: DataFrame, outer: DataFrame, arity: int, height: int) -> DataFrame:
    """Leaves with the digest of their siblings and the root their altered value leads to."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema)
    names = [*leaves.columns, "proof", "folded"]

    def fold(nodes, over):
        nodes = nodes.sort_values("pos")
        proof, up = [], []
        for path, h in zip(_paths(nodes, over, arity, height) if len(nodes) else [], nodes["altered"], strict=True):
            proof.append(digest("".join(others for _, others in path)))
            for at, others in path:
                h = digest(others[:64 * at] + h + others[64 * at:])
            up.append(h)
        return nodes.assign(proof=proof, folded=up)[names]

    left = leaves.withColumn("block", F.expr(f"pos div {arity ** height}"))
    return (left.groupBy("g", "block").cogroup(outer.groupBy("g", "block"))
            .applyInPandas(fold, f"{kinds}, proof string, folded string"))


def manifest(docs: DataFrame, *, id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             found: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof_sha256, folded_root, verified), one per row of ``docs``.

    ``found`` names fields whose value is another at the time of the check: a row's ``folded_root`` starts from the leaf of
    these values and goes up along the siblings of the manifest; ``verified`` tells whether it ends at the root.
    """
    now = [(found or {}).get(c, F.col(f"`{c}`")) for c in fields]
    was = [F.col(f"`{c}`") for c in fields]
    rows = written(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{group}`").alias("lang"), leaf_of(was).alias("h"), leaf_of(now).alias("altered")), "leaves")
    # The last order is only there to spread rows that repeat wholly; rows it moves are the same rows.
    rows = _numbered(rows.withColumn("tie", F.monotonically_increasing_id()), "lang", ["id", "h", "tie"])
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    groups = _numbered(sizes.withColumn("one", F.lit(0)), "one", ["lang"]).withColumnRenamed("pos", "g")
    leaves = written(rows.join(groups.select(F.col("lang").alias("l"), "g", "n"), F.col("lang").eqNullSafe(F.col("l")))
                     .select("g", "n", "pos", "h", "altered", F.col("id").cast("string").alias("id")), "tree")
    rounds, tops = _tree(leaves, arity, height)
    subroots = tops.select(F.lit(0).cast("long").alias("g"), F.lit(groups.count()).cast("long").alias("n"), F.col("g").alias("pos"), "h")
    upper, top = _tree(subroots, arity, height)
    root = F.lit(next((r["h"] for r in top.take(1)), None)).cast("string")
    none = docs.sparkSession.createDataFrame([], PATH)
    above = _descend(upper, none, arity, height).withColumn("g", F.col("block")).withColumn("block", F.lit(0).cast("long"))
    told = _folded(leaves, _descend(rounds[1:], above, arity, height), arity, height)
    return (told.join(tops.select("g", F.col("h").alias("subroot")), "g")
            .select(F.col("id").cast(docs.schema[id].dataType).alias(id), F.col("h").alias("leaf"), "subroot", root.alias("root"),
                    F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified")))


# Unsigned crc32 of a short ASCII text, bit by bit (DuckDB has none built in).
_CRC = """xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INT), 1)) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), CAST(4294967295 AS BIGINT)))"""

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("text")} AS h,
    {_leaf("CASE WHEN " + _CRC.format("CAST(doc_id AS VARCHAR)") + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS altered
  FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS g, count(*) AS n FROM d GROUP BY lang),
leaf AS (SELECT g.g, g.n, d.doc_id, d.h, d.altered, row_number() OVER (PARTITION BY g.g ORDER BY d.doc_id NULLS FIRST, d.h) - 1 AS pos
  FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
node AS (SELECT g, n, 0 AS level, pos, h FROM leaf
  UNION ALL SELECT g, (any_value(n) + 7) // 8, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY g, pos // 8),
sub AS (SELECT g, h, level AS levels FROM node WHERE n = 1),
up AS (SELECT (SELECT count(*) FROM sub) AS n, 0 AS level, g - 1 AS pos, h FROM sub
  UNION ALL SELECT (any_value(n) + 7) // 8, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY pos // 8),
top AS (SELECT h AS root FROM up WHERE n = 1),
side AS (SELECT l.g, l.pos, n.level, string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < l.pos >> (3 * n.level)) AS a,
    string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > l.pos >> (3 * n.level)) AS b
  FROM leaf l JOIN node n ON n.g = l.g AND n.n > 1 AND n.pos >> 3 = l.pos >> (3 * n.level + 3) GROUP BY l.g, l.pos, n.level
  UNION ALL SELECT l.g, l.pos, s.levels + u.level, string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < (l.g - 1) >> (3 * u.level)),
    string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > (l.g - 1) >> (3 * u.level))
  FROM leaf l JOIN sub s ON s.g = l.g JOIN up u ON u.n > 1 AND u.pos >> 3 = (l.g - 1) >> (3 * u.level + 3) GROUP BY l.g, l.pos, s.levels, u.level),
proof AS (SELECT g, pos, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY level) AS p FROM side GROUP BY g, pos),
fold AS (SELECT g, pos, 0 AS level, altered AS h FROM leaf
  UNION ALL SELECT f.g, f.pos, f.level + 1, sha256(coalesce(s.a, '') || f.h || coalesce(s.b, '')) FROM fold f JOIN side s ON s.g = f.g AND s.pos = f.pos AND s.level = f.level),
ends AS (SELECT g, pos, arg_max(h, level) AS h FROM fold GROUP BY g, pos)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.root, sha256(coalesce(p.p, '')) AS proof_sha256, e.h AS folded_root, e.h = t.root AS verified
FROM leaf l JOIN sub s ON s.g = l.g CROSS JOIN top t JOIN ends e ON e.g = l.g AND e.pos = l.pos LEFT JOIN proof p ON p.g = l.g AND p.pos = l.pos
"""
