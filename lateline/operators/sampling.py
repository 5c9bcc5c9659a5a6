"""Exact-size samples and splits that do not depend on partitioning.

Rows are ordered by a seeded hash of their key. To take the first n of that order without sorting
the table in one task, rows are counted per hash prefix; every prefix below the cut is taken whole
and only the one prefix at the cut is ranked. The cut is found once and every row compared with it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col
from ..session import checkpoint
from .quantiles import exact_edges, quantile_edges
from .windows import with_previous

PREFIX_DIGITS = 5


def key_hash(seed: int | str, key: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def hash_fraction(seed: int | str, key: Sequence[str]) -> Column:
    """Uniform number in [0, 1) that depends only on seed and key."""
    return hash_bucket(key_hash(seed, key), 8) / F.lit(float(16**8))


def hash_bucket(hashed: Column, digits: int = PREFIX_DIGITS) -> Column:
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("bigint")


class HashCut:
    """The first ``quota`` rows of each stratum in hash order, as a mark on every row.

    Two narrow passes over key and strata find the cut: rows are counted per hash prefix, then only the prefix at the cut is
    put in order, and its last row taken is remembered (one row per stratum, written to the checkpoint folder). ``marked`` then
    compares every row with the cut of its stratum, so both sides of a split come from one reading without another shuffle.
    """

    def __init__(self, df: DataFrame, seed: int, key: Sequence[str], strata: Sequence[str], quota: Column | None, quotas: DataFrame | None = None):
        self.seed, self.key, self.strata = seed, list(key), list(strata)
        slim = self._placed(df.select(*dict.fromkeys([*key, *strata])))
        per = slim.groupBy(*strata, "__pre").agg(F.count(F.lit(1)).alias("__k"))
        w = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(1))
        upto = w.orderBy("__pre").rowsBetween(Window.unboundedPreceding, 0)
        cum = per.withColumns({"__upto": F.sum("__k").over(upto), "__all": F.sum("__k").over(w)})
        if quotas is not None:
            cum = cum.join(quotas.withColumnsRenamed({s: f"__s{s}" for s in strata}), self._same()).drop(*[f"__s{s}" for s in strata])
            quota = F.col("__quota")
        cum = cum.withColumn("__need", quota)
        # The prefix that the quota reaches; those before it are taken whole.
        edge = F.when(F.col("__upto") >= F.col("__need"), F.col("__pre"))
        prefix = checkpoint(cum.groupBy(*[F.col(s).alias(f"__s{s}") for s in strata]).agg(
            F.coalesce(F.min(edge), F.lit(16**PREFIX_DIGITS)).alias("__cut"),
            (F.max("__need") - F.coalesce(F.max(F.when(F.col("__upto") < F.col("__need"), F.col("__upto"))), F.lit(0))).alias("__room")))
        border = self._beside(slim, prefix).filter(F.col("__pre") == F.col("__cut"))
        place = Window.partitionBy(*strata).orderBy("__hash", *key) if strata else Window.partitionBy(F.lit(1)).orderBy("__hash", *key)
        ranked = checkpoint(border.select(*strata, "__room", self._mark().alias("__mark"), F.row_number().over(place).alias("__rn")))
        last = F.max(F.when(F.col("__rn") <= F.col("__room"), F.col("__mark")))
        ends = ranked.groupBy(*[F.col(s).alias(f"__s{s}") for s in strata]).agg(last.alias("__last"))
        # Rows that repeat hash and key of the last one taken cannot be told apart; how many of them belong to the cut is counted.
        tied = self._beside(ranked, ends).filter(F.col("__mark") == F.col("__last")).groupBy(*[F.col(s).alias(f"__t{s}") for s in strata]).agg(
            F.count_if(F.col("__rn") <= F.col("__room")).alias("__few"), F.count(F.lit(1)).alias("__ties"))
        cut = self._beside(prefix, ends, "__s")
        self.cut = checkpoint(self._beside(cut, tied, "__s", "__t"))
        self.ties = not self.cut.filter("__few < __ties").isEmpty()

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__hash", key_hash(self.seed, self.key)).withColumn("__pre", hash_bucket(F.col("__hash")))

    def _mark(self) -> Column:
        return F.struct(F.col("__hash"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(self.key)])

    def _same(self, left: str = "", right: str = "__s") -> Column:
        cond = F.lit(True)
        for s in self.strata:
            cond = cond & F.col(left + s).eqNullSafe(F.col(right + s))
        return cond

    def _beside(self, rows: DataFrame, per: DataFrame, left: str = "", right: str = "__s") -> DataFrame:
        """Rows with what their stratum has in ``per``; without strata that is one row, taken as literals."""
        if self.strata:
            if left == right:
                per = per.withColumnsRenamed({f"{right}{s}": f"__o{s}" for s in self.strata})
                right = "__o"
            return rows.join(per, self._same(left, right), "left").drop(*[f"{right}{s}" for s in self.strata])
        one = per.first()
        kinds = {f.name: f.dataType for f in per.schema.fields}
        return rows.withColumns({c: _literal(one[c] if one else None, kinds[c]) for c in per.columns})

    def marked(self, df: DataFrame, out: str = "__first") -> DataFrame:
        """``df`` with ``out``: whether the row is among the first of its stratum."""
        rows = self._beside(self._placed(df), self.cut)
        mark, last = self._mark(), F.col("__last")
        at = F.coalesce(mark < last if self.ties else mark <= last, F.lit(False))
        rows = rows.withColumn(out, (F.col("__pre") < F.col("__cut")) | ((F.col("__pre") == F.col("__cut")) & at))
        if self.ties:
            tie = F.coalesce(mark == last, F.lit(False))
            w = Window.partitionBy(*self.strata, tie).orderBy("__hash") if self.strata else Window.partitionBy(tie).orderBy("__hash")
            ties = rows.filter(tie).withColumn(out, F.row_number().over(w) <= F.col("__few"))
            rows = rows.filter(~tie).unionByName(ties)
        return rows.select(*df.columns, out)


def _literal(value, kind) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if hasattr(kind, "fields"):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def first_by_hash(
    df: DataFrame, seed: int, key: Sequence[str], strata: Sequence[str], quota: Column | None,
    quotas: DataFrame | None = None, invert: bool = False,
) -> DataFrame:
    """Rows among the first ``quota`` of each stratum in hash order (or all the others)."""
    rows = HashCut(df, seed, key, strata, quota, quotas).marked(df)
    return rows.filter(~F.col("__first") if invert else F.col("__first")).select(*df.columns)


def _both(df: DataFrame, cut: HashCut) -> tuple[DataFrame, DataFrame]:
    rows = cut.marked(df)
    return rows.filter(~F.col("__first")).select(*df.columns), rows.filter("__first").select(*df.columns)


def sample_exact(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Uniform sample of exactly min(n, rows) rows."""
    if n <= 0:
        return df.limit(0)
    return first_by_hash(df, seed, key, [], F.lit(n))


def fraction_size(total: int, fraction: float) -> int:
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie strictly between 0 and 1")
    return max(1, int(total * fraction))


def sample_fraction(df: DataFrame, fraction: float, seed: int, key: Sequence[str]) -> DataFrame:
    return sample_exact(df, fraction_size(df.count(), fraction), seed, key)


def stratum_of(value, edges: Sequence[float]) -> Column:
    """Number of the quantile bin; first and last bin are open, NULL stays NULL."""
    value = col(value)
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (value > F.lit(e)).cast("int")
    return F.when(value.isNotNull(), out)


def allocate(counts: Sequence[int], n: int) -> list[int]:
    """Share n over strata in proportion to their counts, at least one each, summing to n.

    The list has one entry per quantile bin, so this runs on a handful of numbers.
    """
    total = sum(counts)
    shares = [max(1, int(_half_even(c / total * n))) for c in counts]
    while sum(shares) < n:
        shares[shares.index(max(shares))] += 1
    while sum(shares) > n:
        # Never push a stratum below one row while a larger one can give.
        small = [s for s in shares if s > 1]
        if not small:
            raise ValueError(f"{n} rows cannot cover {len(shares)} strata")
        shares[shares.index(min(small))] -= 1
    return shares


def _half_even(x: float) -> int:
    low = math.floor(x)
    rest = x - low
    return low + int(rest > 0.5 or (rest == 0.5 and low % 2 == 1))


def sample_stratified(
    df: DataFrame, n: int, on: str, seed: int, key: Sequence[str], bins: int = 10, exact: bool = True
) -> DataFrame:
    """Exactly n rows, spread over quantile bins of ``on`` like the whole table.

    ``exact=False`` takes the bin edges from a sketch, which may depend on the partitioning. An n below the number of
    bins that hold rows is an error, because every bin gives at least one.
    """
    edges = exact_edges(df, on, bins) if exact else quantile_edges(df, on, bins)
    if len(edges) < 2:
        return sample_exact(df, n, seed, key)
    binned = df.withColumn("__stratum", stratum_of(on, edges)).filter(F.col("__stratum").isNotNull())
    # At most ``bins`` rows.
    counts = {r["__stratum"]: r["count"] for r in binned.groupBy("__stratum").count().collect()}
    order = sorted(counts)
    shares = dict(zip(order, allocate([counts[s] for s in order], n)))
    quota = F.element_at(
        F.create_map(*[x for s in order for x in (F.lit(s), F.lit(shares[s]))]), F.col("__stratum"))
    picked = first_by_hash(binned, seed, key, ["__stratum"], quota)
    return picked.drop("__stratum")


def train_test(
    df: DataFrame, seed: int, key: Sequence[str], test_size: float = 0.2, exact: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Random split; ``exact`` gives ceil(test_size * rows) test rows, else a hash threshold."""
    if test_size <= 0:
        return df.limit(0), df
    if not exact:
        u = hash_fraction(seed, key)
        return df.filter(u >= test_size), df.filter(u < test_size)
    quota = F.ceil(F.col("__all") * F.lit(test_size))
    return _both(df, HashCut(df, seed, key, [], quota))


def stratified_train_test(
    df: DataFrame, label: str, seed: int, key: Sequence[str], test_size: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Split with the same test share (rounded) in every class."""
    quota = F.round(F.col("__all") * F.lit(test_size)).cast("bigint")
    return _both(df, HashCut(df, seed, key, [label], quota))


def time_ordered_split(df: DataFrame, ts: str, cut) -> tuple[DataFrame, DataFrame]:
    """Everything before ``cut`` trains, the rest tests."""
    return df.filter(F.col(ts) < F.lit(cut)), df.filter(F.col(ts) >= F.lit(cut))


def with_fold(df: DataFrame, k: int, seed: int, key: Sequence[str], out: str = "fold") -> DataFrame:
    """Fold number from the key's hash: no shuffle, same fold on every run."""
    return df.withColumn(out, F.pmod(hash_bucket(key_hash(seed, key), 8), F.lit(k)).cast("int"))


def with_stratified_fold(
    df: DataFrame, label: str, k: int, seed: int, key: Sequence[str], out: str = "fold", hot_rows: int | None = None
) -> DataFrame:
    """Folds of equal size within every class (sizes differ by at most one)."""
    hashed = df.withColumn("__hash", key_hash(seed, key))
    kw = {} if hot_rows is None else {"hot_rows": hot_rows}
    placed = with_previous(
        hashed, [label], ["__hash", *key], index="__rank", base=0,
        chunk=F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int"), **kw,
    )
    return placed.withColumn(out, F.pmod(F.col("__rank"), F.lit(k)).cast("int")).drop("__hash", "__rank")
