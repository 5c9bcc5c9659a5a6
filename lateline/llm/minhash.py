"""Near duplicates by bottom-k sketches of one hash function.

A document's set of word shingles is hashed once; its sketch is the k smallest hashes. Equal sets are merged into
numbered classes first, so copies cost one row. Inverted lists then bring classes together: a list's key is a run of
consecutive retained values (large sets) or a pair from the prefix that sets of that similarity must share (small sets, where
no link can be missed). Within a list, sets meet the list's leader only, so a list of n sets gives n - 1 candidates. A candidate
stays if the sketch of the union suggests a similarity well below the threshold or more, and becomes a link if the full sets,
taken from the texts, confirm it.

Lists that still hold different components are opened: their sets meet by exact prefixes. Values are ordered by how few of
these sets hold them; two similar sets share one of their first (1 - similarity) * size + 1 values, at places that leave room for
enough shared values behind them. A passage in many otherwise different documents is frequent, so it comes last and brings
nobody together, and no link is lost.

With similarity s a run of three retained values survives somewhere in 64 values but for about 1e-10 of the pairs at
s = 0.8 (the chance that 64 trials of 0.8 have no three successes in a row).

Nulls and edge cases: a null or empty text has an empty set and links with nothing; a null ``id`` gets a null component, is
not kept and links nothing; rows that repeat an id are a document each, with the same text or another; columns besides the id
and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, components, let_go, run_hashes, text_hashes, slices, written

K = 64            # retained values
RUN = 3           # consecutive values that make a list's key
SMALL = 64        # sets up to this size also use prefix pairs; runs serve sets from LARGE on
LARGE = 48        # LARGE * 1.25 < SMALL, so two similar sets always have one kind of key in common
SLACK = 0.5       # estimates below this are dropped: 6 standard deviations under 0.8 at k = 64


def shingle_sets(texts, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one shingle."""
    texts = list(texts)
    for start, end in slices([len(t or "") for t in texts]):
        h, at = text_hashes(texts[start:end], lower=True)
        runs = run_hashes(h, words)
        for i in range(len(at) - 1):
            n = int(at[i + 1] - at[i])
            if n >= words:
                yield np.unique(runs[at[i]:at[i + 1] - words + 1])
            elif n:
                short = run_hashes(h[at[i]:at[i + 1]], n)
                yield short ^ np.uint64(0x5851F42D4C957F2D + n)
            else:
                yield np.empty(0, np.uint64)


def _sketches(words: int):
    def run(batches):
        let_go()
        for b in batches:
            n, f1, f2, sk = [], [], [], []
            for s in shingle_sets(b["text"], words):
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64)))
                f2.append(int((s * (s | np.uint64(1)) ^ (s >> np.uint64(29))).sum(dtype=np.uint64)))
                sk.append(s[:K].tobytes())
            yield pd.DataFrame({"id": b["id"], "h": b["h"], "n": np.array(n, np.int64), "f1": np.array(f1, np.uint64).view(np.int64),
                                "f2": np.array(f2, np.uint64).view(np.int64), "sketch": sk})
    return run


def _pairs_of(values: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(values), 1)
    return values[i] * np.uint64(0x9E3779B97F4A7C15) ^ (values[j] + np.uint64(0x632BE59BD9B4E019))


def _list_keys(percent: int):
    def run(batches):
        for b in batches:
            ids, sizes, keys = [], [], []
            for i, n, raw in zip(b["id"], b["n"], b["sketch"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                own = []
                if n >= LARGE:
                    own.append(run_hashes(s, RUN))
                if n <= SMALL:  # sets that share percent of both must share two values of these prefixes
                    own.append(_pairs_of(s[:int(n) * (100 - percent) // 100 + 2]))
                own = np.concatenate(own)
                keys.append(own)
                ids.append(np.full(len(own), i, np.int64))
                sizes.append(np.full(len(own), n, np.int64))
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids), "n": np.concatenate(sizes), "key": np.concatenate(keys).view(np.int64)})
    return run


def _estimates(batches):
    """Similarity of two sets as the share of the k smallest values of their union that both retain."""
    for b in batches:
        est = np.zeros(len(b))
        for r, (x, y) in enumerate(zip(b["sa"], b["sb"], strict=True)):
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort()
            new = np.append(True, both[1:] != both[:-1])
            last = np.flatnonzero(new)[:K]          # first places of the k smallest values of the union
            est[r] = np.mean(np.append(~new, False)[last + 1]) if len(last) else 0.0
        yield pd.DataFrame({"a": b["a"], "b": b["b"], "est": est})[est >= SLACK]


def _compare(words: int, percent: int):
    """Pairs whose full sets, taken from their texts, meet the threshold."""
    def run(batches):
        for b in batches:
            for at, to in slices(list(b["ta"].map(len) + b["tb"].map(len))):
                p = b.iloc[at:to]
                rows = []
                for i, j, x, y in zip(p["a"], p["b"], shingle_sets(p["ta"], words), shingle_sets(p["tb"], words), strict=True):
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    if n and 100 * n >= percent * (len(x) + len(y) - n):
                        rows.append((i, j))
                yield pd.DataFrame(rows, columns=["a", "b"])
    return run


def _values(words: int):
    """Every value of every set."""
    def run(batches):
        for b in batches:
            for start, end in slices(list(b["text"].map(len))):
                p = b.iloc[start:end]
                sets = list(shingle_sets(p["text"], words))
                size = [len(s) for s in sets]
                yield pd.DataFrame({"id": np.repeat(p["c"].to_numpy(), size), "v": np.concatenate(sets).view(np.int64)})
    return run


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = 2,
                    percent: int = 80) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept): one per row of ``docs``.

    Two documents link if 100 * shared shingles >= percent * shingles of the union; a component is what links reach.
    """
    base = (docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
            .withColumn("h", F.xxhash64("text")))
    rows = written(base.mapInPandas(_sketches(words), "id long, h long, n long, f1 long, f2 long, sketch binary"), "sketches", TEXTS)
    # A class is one set with all its rows; a row with the smallest id gives its text.
    classes = written(rows.where("n > 0 and id is not null").groupBy("f1", "f2", "n")
                      .agg(F.min(F.struct("id", "h")).alias("r"), F.first("sketch").alias("sketch"))
                      .select(F.monotonically_increasing_id().alias("c"), "r.*", "f1", "f2", "n", "sketch"), "classes")
    reached = components(written(_links(base, classes, words, percent), "links", TEXTS))
    rooted = (classes.join(reached.select(F.col("id").alias("c"), "component"), "c", "left")
              .select("f1", "f2", "n", F.col("id").alias("low"), F.coalesce("component", "c").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    told = rooted.join(lowest, "root").select("f1", "f2", "n", "component")
    return (rows.drop("sketch", "h").join(told, ["f1", "f2", "n"], "left")
            .select(F.col("id").alias(id), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False))))


def _links(base: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links between classes, by number; what they reach equals what all links reach."""
    base = _Texts(base, classes.select("c", "id", "h"))
    reps = classes.select(F.col("c").alias("id"), "n", "sketch")
    # A list of one set gives nothing: only keys with two or more are written.
    keyed = reps.mapInPandas(_list_keys(percent), "id long, n long, key long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    lists = written(keyed.join(shared.select("key"), "key"), "lists")

    # The set with most shared lists leads: what others were copied from has all of its values retained elsewhere.
    weight = lists.groupBy("id").agg(F.count("*").alias("w"))
    lead = (lists.join(weight, "id").groupBy("key").agg(F.max(F.struct(F.col("w"), -F.col("id"))).alias("top"))
            .select("key", F.col("top.w").alias("w"), (-F.col("top.col2")).alias("lead")))
    star = written(lists.join(lead, "key").where("id != lead")
                   .select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"), "id", "lead", "w").distinct(), "star")
    likely = written(_likely(star.select("a", "b").distinct(), reps), "likely")
    # Each set's home, the likely leader that leads most, first; then only what would still join two components.
    best = (likely.join(star, ["a", "b"]).groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("w"), -F.col("lead"))).alias("p"))
            .select("p.a", "p.b", "id"))
    links = written(_confirmed(best.select("a", "b").distinct(), base, words, percent), "tried", TEXTS)
    rest = _between(likely.select("a", "b"), components(links)).join(best.select("a", "b"), ["a", "b"], "left_anti")
    links = written(links.unionAll(_confirmed(rest, base, words, percent)), "links", TEXTS)

    label = written(components(links), "labels")
    rows = lists.join(label, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c < d").select("key")
    open_ = written(rows.join(mixed, "key").select("id", "n", "comp").distinct(), "open")
    pairs = _by_prefix(open_, base, words, percent).join(star.select("a", "b"), ["a", "b"], "left_anti")
    last = written(_likely(pairs, reps).select("a", "b"), "pairs")
    return links.unionAll(_confirmed(last, base, words, percent))


def _by_prefix(sets: DataFrame, base: _Texts, words: int, percent: int) -> DataFrame:
    """Pairs of ``sets`` (id, n, comp) of different components that may link. Exact: no link is lost.

    Values in the order of (how many of these sets hold it, value). Sets that link share at least percent of the larger one,
    so they share one of the first n - ceil(percent n) + 1 values of each; at the first value they share, at places i and j,
    what is left of both sets must suffice for the overlap that percent of the union takes.
    """
    values = written(base.of(sets.select(F.col("id").alias("c"))).mapInPandas(_values(words), "id long, v long"), "values", TEXTS)
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = values.join(shared, "v").join(sets, "id")
    own = Window.partitionBy("id")
    # A set's values that no other set holds come first in its order.
    first = (held.withColumn("i", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "v")))
             .where(f"i <= n - ({percent} * n + 99) div 100 + 1").select("v", "id", "n", "comp", "i"))
    first = written(first, "prefixes")
    need = f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}"
    return (first.alias("x").join(first.alias("y"), "v").where("x.comp < y.comp")
            .where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and 1 + least(x.n - x.i, y.n - y.i) >= {need}")
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())


def _between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends no link chain joins yet."""
    a, b = label.toDF("a", "ca"), label.toDF("b", "cb")
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    x = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    y = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(x, "a").join(y, "b").mapInPandas(_estimates, "a long, b long, est double")


class _Texts:
    """Texts of classes: ``who`` says which row's id and text hash stand for a class."""

    def __init__(self, base: DataFrame, who: DataFrame):
        self.base, self.who = base.where("id is not null"), who

    def of(self, classes: DataFrame) -> DataFrame:
        """Rows (c, text), one per class; only the texts asked for leave the scan's side of the join."""
        need = self.who.join(classes.distinct(), "c")
        # Rows of a class are told apart by the columns of the join, so no text is shuffled a second time.
        return written(self.base.join(need, ["id", "h"]).dropDuplicates(["id", "h", "c"]).select("c", "text"), "texts")

    def beside(self, pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select("a", "b"), "wanted")
        text = self.of(pairs.select(F.col("a").alias("c")).unionAll(pairs.select("b")))
        return pairs.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b")


def _confirmed(pairs: DataFrame, base: _Texts, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold."""
    return base.beside(pairs).mapInPandas(_compare(words, percent), "a long, b long")
