"""Benchmark decontamination by winnowing, in DataFrame functions only.

A span of ``window`` words holds window - k + 1 k-grams. Both sides keep the smallest k-gram hash of every such run, so a
shared span of ``window`` words or more always shares a kept fingerprint. Items shorter than a window are one window of
their own length; the lengths that occur (fewer than ``window`` of them) are looked up at every place. Fingerprints are
joined by equality; around each common one the windows that contain it are compared word by word with the items' windows,
and a document's hit words are the union of the windows found. The join with the items carries no hint: their fingerprints
are written first, so Spark broadcasts them by measured size and sorts and merges beyond its threshold.

Nulls and edge cases: a null or empty text has no words, no hits and is not contaminated; a null id is reported like any
other; rows that repeat an id are judged row by row; an item without words has no window; items with a null id count
through their words but are not listed; other columns are ignored. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The word rule and the letters it lower-cases.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 7
NONE = "cast(array() as array<bigint>)"


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOW), F.lit(WORD), F.lit(0)),
                      F.expr("cast(array() as array<string>)"))


def _grams(n: int) -> Column:
    """Hash of every run of ``n`` words, from the word hashes ``h``; the length is part of it."""
    run = ", ".join(f"get(h, i + {j})" for j in range(n))
    return F.expr(f"if(size(h) >= {n}, transform(sequence(0, size(h) - {n}), i -> xxhash64({n}, {run})), {NONE})")


def _smallest(n: int) -> Column:
    """Smallest of every ``n`` neighbours in ``g``."""
    if n == 1:
        return F.col("g")
    run = ", ".join(f"get(g, i + {j})" for j in range(n))
    return F.expr(f"if(size(g) >= {n}, transform(sequence(0, size(g) - {n}), i -> least({run})), {NONE})")


def _hashed(rows: DataFrame) -> DataFrame:
    """Add word hashes ``h`` and k-gram hashes ``g``."""
    return rows.withColumn("h", F.expr("transform(words, w -> xxhash64(w))")).withColumn("g", _grams(K))


def row_key(id: str, text: str) -> Column:
    """Names a row by its id and text, so null and repeated ids do no harm."""
    return F.xxhash64(F.col(id), F.col(text))


def hits(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = 13, hit_share: int = 20) -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items_sha256, items, key, contaminated), one per document; see ``row_key``.

    Contaminated: at least one word is hit and hit_share * n_hit >= n_words.
    """
    if window < K + 1:
        raise ValueError(f"a window needs {K + 1} words or more")
    per = window - K + 1
    bench = written(items.select(F.col(item_id).cast("string").alias("item"), words_of(item_text).alias("words"))
                    .where("size(words) > 0"), "items")
    # Lengths below the window: fewer than ``window`` values.
    short = sorted(r[0] for r in bench.where(F.size("words") < window).select(F.size("words")).distinct().collect())

    long_marks = _hashed(bench.where(F.size("words") >= window)).select(F.explode(_smallest(per)).alias("mark"))
    marks = long_marks
    for n in short:
        marks = marks.unionAll(_hashed(bench.where(F.size("words") == n)).select(F.explode(_grams(n)).alias("mark")))
    marks = written(marks.distinct(), "marks")

    rows = docs.select(F.col(id).alias("id"), row_key(id, text).alias("key"), F.col(text).alias("text"))
    worded = _hashed(rows.select("id", "key", words_of("text").alias("words")))
    parts = [_smallest(per), *[_grams(n) for n in short]]
    base = written(worded.select("id", "key", F.size("words").cast("long").alias("n_words"),
                                 F.array_distinct(F.concat(*parts)).alias("marks")), "marked")
    found = written(base.select("key", F.explode("marks").alias("mark")).join(marks, "mark").groupBy("key")
                    .agg(F.collect_set("mark").alias("found")), "found")

    wide = bench.where(F.size("words") >= window).selectExpr(
        "item", f"explode(transform(sequence(1, size(words) - {window - 1}), i -> concat_ws(' ', slice(words, i, {window})))) as win")
    whole = bench.where(F.size("words") < window).selectExpr("item", "concat_ws(' ', words) as win")
    wins = written(wide.unionAll(whole).groupBy("win").agg(F.collect_set("item").alias("items")), "windows")

    near = _hashed(rows.join(found, "key").select("key", words_of("text").alias("words"), "found").dropDuplicates(["key"]))
    spans = [F.expr(f"""flatten(transform(filter(sequence(0, greatest(size(g) - 1, 0)), i -> array_contains(found, get(g, i))),
        i -> transform(filter(sequence(i - {window - K}, i), s -> s >= 0 and s + {window} <= size(words)),
                       s -> struct(s as at, {window} as n))))""")]
    for n in short:
        near = near.withColumn(f"g{n}", _grams(n))
        spans.append(F.expr(f"""transform(filter(sequence(0, greatest(size(g{n}) - 1, 0)),
            i -> array_contains(found, get(g{n}, i))), i -> struct(i as at, {n} as n))"""))
    tried = (near.select("key", "words", F.explode(F.array_distinct(F.concat(*spans))).alias("s"))
             .selectExpr("key", "s.at as at", "s.n as n", "concat_ws(' ', slice(words, s.at + 1, s.n)) as win"))
    held = (tried.join(wins, "win").groupBy("key")
            .agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("to")))).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
            .select("key", "items", F.expr("""aggregate(spans, struct(0L as n, 0 as reach), (a, s) -> struct(
                a.n + greatest(s.to - greatest(s.at, a.reach), 0) as n, greatest(a.reach, s.to) as reach), a -> a.n)
                """).alias("n_hit")))
    return (base.drop("marks").join(held, "key", "left")
            .select(F.col("id").alias(id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.coalesce("items", F.expr("cast(array() as array<string>)")), ",").cast("binary"), 256)
                    .alias("items_sha256"),
                    "items", "key")
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(hit_share) * F.col("n_hit") >= F.col("n_words"))))


SQL = """
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
      FROM documents, letters),
i AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark, letters WHERE text IS NOT NULL),
iw AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""
