"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one; all
but the last return the columns of ``docs``. A stage sees all that its predecessor kept.

Rows with a null id pass the near-duplicate stage unjudged (there is no id to tell them by); all other stages judge them
like any other. Null texts pass every stage and pack as an end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateline.llm import decontaminate, minhash, packing, pii, toxicity
from lateline.llm.common import importable, written
from lateline.llm.queries import PSEUDONYM_KEY, table, vocabulary

# Some stage picks its rows by trained scores and another by token ids, which SQL cannot express.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half. Labels of the held-out fifth are not learnt from."""
    importable(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scorer = toxicity.learn(table(spark, sf_dir, "labels").where(~held), docs)
    told = toxicity.score(docs, scorer, names=("__score", "__toxic"))
    return told.where("__toxic = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; a repeated row stays once. Documents are near on
    runs of five words: runs of two, which the registered query compares, repeat in texts that are no copies."""
    importable(spark)
    kept = (minhash.near_duplicates(docs, words=5).where("kept").groupBy(F.col("doc_id").alias("__id"))
            .agg(F.count("*").alias("__rows")))
    rows = docs.join(kept, F.col("doc_id") == F.col("__id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.where("__rows = 1").select(*columns)
    again = rows.where("__rows > 1").dropDuplicates(["doc_id", "text"]).select(*columns)
    return once.unionAll(again).unionAll(docs.where("doc_id is null"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    importable(spark)
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("key").alias("__key"))
    return docs.join(found, decontaminate.row_key("doc_id", "text") == F.col("__key"), "left_anti")


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data and secrets."""
    return pii.pseudonymise(docs, key=PSEUDONYM_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 ids."""
    importable(spark)
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), special=True)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_dedup", one_of_each),
    ("decontamination", without_benchmarks),
    ("pii", pseudonymised),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
