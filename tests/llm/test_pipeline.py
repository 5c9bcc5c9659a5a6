"""The pipeline: stages keep columns and clean rows; the whole equals the stages one by one."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "pii", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("key", F.lit(1))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    odd = spark.createDataFrame([(9000, None), (9001, ""), (None, "null id 4111111111111111 text"), (9002, item + " extra"), (9003, "same words here again"),
                                 (9003, "same words here again"), (9004, "Same words HERE again")], "doc_id long, text string")
    return base.unionByName(odd.withColumn("kept", F.lit("k")), allowMissingColumns=True)


def test_stages(spark, sf, docs):
    now, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        ids[name] = [r["doc_id"] for r in rows]
        assert {9000, 9001} <= set(ids[name])
        now = spark.createDataFrame(rows, docs.schema)
    assert ids["minhash_dedup"].count(9003) == 1 and 9004 not in ids["minhash_dedup"] and None in ids["minhash_dedup"]
    assert 9002 in ids["minhash_dedup"] and 9002 not in ids["decontamination"] and ids["pii"].count(None) == 1
    assert sorted(map(str, ids["pii"])) == sorted(map(str, ids["decontamination"]))
    assert "4111111111111111" not in now.where("doc_id is null").first()["text"]
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert last.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_run(spark, sf):
    sf = sf.replace("0.001", "0.01")         # the smallest tables have eleven toxic rows, too few to learn from
    got = corpus_pipeline.run(spark, sf)
    rows = got.collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    left = {r["doc_id"] for r in rows}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(i) == 1 for i in left) <= 0.5 * sum(y == 1 for y in labels.values())
    assert len(left) >= 0.4 * spark.read.parquet(f"{sf}/documents.parquet").count()


def test_near_on_two_words_is_not_near_on_five(spark, sf):
    first = [f"w{i}" for i in range(100)]
    second = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(first)]      # two words: 89 of 109; five words: 71 of 121
    third = first[:-1] + ["end"]                                                # near on both
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(third))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from lateline.llm import minhash

    assert {r["doc_id"] for r in minhash.near_duplicates(df).where("kept").collect()} == {1}
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, df, sf).collect()} == {1, 2}
