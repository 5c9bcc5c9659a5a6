import datetime as dt
import os
import random

from pyspark.sql import functions as F

from lateline.operators.windows import previous_value
from lateline.streaming import jobs

SCHEMA = "id int, day date, k string, t timestamp_ntz, v double"


def batches(seed=1, late=False):
    rng = random.Random(seed)
    out, n = [], 0
    for b in range(3):
        rows = []
        for _ in range(150):
            minute = b * 400 + rng.randrange(400)
            at = dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minute)
            rows.append((n, at.date(), rng.choice(["hot", "hot", "a", "b", None]), at, float(rng.randrange(100))))
            n += 1
        out.append(rows)
    return out


def run(spark, root, chunk=None, **kw):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.previous_value_job(s, ["day", "k"], ["t", "id"], "v", out=f"{root}/out", state=f"{root}/state", checkpoint=f"{root}/cp", chunk=chunk, **kw).awaitTermination()


def add(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def test_batches_equal_one_window(spark, folder):
    parts = batches()
    for p in parts:  # each arrives in its own run, so state crosses restarts
        add(spark, folder, p)
        run(spark, folder, chunk=F.hour("t"))
    got = {r.id: r.previous for r in spark.read.parquet(f"{folder}/out").collect()}
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    want = {r.id: r.previous for r in previous_value(whole, ["day", "k"], ["t", "id"], "v", "previous").collect()}
    assert got == want and len(got) == 450


def test_late_rows_and_expired_keys(spark, folder):
    at = lambda m: dt.datetime(2025, 1, 1, 0, m)
    day = dt.date(2025, 1, 1)
    add(spark, folder, [(1, day, "a", at(10), 5.0), (2, day, "z", at(10), 6.0)])
    run(spark, folder, expire=F.col("k") == "z")
    add(spark, folder, [(3, day, "a", at(5), 7.0), (4, day, "a", at(10), 8.0), (5, day, "z", at(11), 9.0)])
    run(spark, folder, expire=F.col("k") == "z")
    got = {r.id: r.previous for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 5.0, 5: None}


def test_ingest_reads_each_file_once(spark, folder):
    os.makedirs(f"{folder}/in")
    def put(name, trip):
        with open(f"{folder}/in/{name}", "w") as f:
            f.write(f"FAHRT_BEZEICHNER;BPUIC\n{trip};1\nNA;2\n")
    def go():
        s = jobs.new_actuals(spark, f"{folder}/in", ["FAHRT_BEZEICHNER", "BPUIC"])
        jobs.ingest_new(s, lambda b: b.filter("TRIP_ID is not null"), f"{folder}/out", f"{folder}/cp").awaitTermination()
        return sorted(r.TRIP_ID for r in spark.read.parquet(f"{folder}/out").collect())
    put("a.csv", "t1")
    assert go() == ["t1"]
    assert go() == ["t1"]
    put("b.csv", "t2")
    assert go() == ["t1", "t2"]


def test_scoring_stream(spark, folder):
    from lateline.learn.experiment import vectors
    from lateline.learn.models import Ridge
    df = spark.range(50).selectExpr("cast(id as double) as x", "cast(id * 2 as double) as label")
    df.coalesce(1).write.parquet(f"{folder}/in")
    m = Ridge(alpha=0.0).fit(vectors(["x"]).transform(df))
    s = vectors(["x"]).transform(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
    jobs.score_new(s, m, f"{folder}/out", f"{folder}/cp", ["x", "prediction"]).awaitTermination()
    assert all(abs(r.prediction - 2 * r.x) < 1e-6 for r in spark.read.parquet(f"{folder}/out").collect())


def test_chunk_stream_is_bounded(spark, folder):
    from lateline.sources.tables import stream_chunks
    spark.range(40).repartition(4).write.parquet(f"{folder}/in")
    s = stream_chunks(spark, f"{folder}/in", spark.range(1).schema)
    seen = []
    q = s.writeStream.foreachBatch(lambda b, i: seen.append(b.count())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 40 and len(seen) == 4


def test_state_store_over_batches_late_rows_and_new_periods(spark, folder):
    from lateline.streaming.state import previous_value_state
    kind = "id long, k string, day int, at long, v double"

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(kind).parquet(f"{folder}/in")
        previous_value_state(s, ["k"], "day", ["at", "id"], "v", out=f"{folder}/out", checkpoint=f"{folder}/cp").awaitTermination()

    arrive([(1, "a", 1, 10, 1.0), (2, "a", 1, 30, 2.0), (3, None, 1, 5, 3.0), (4, "b", 1, 9, None)])
    arrive([(5, "a", 1, 20, 4.0), (6, "a", 1, 30, 5.0), (7, None, 1, 6, 6.0), (8, "b", 1, 10, 7.0)])       # 5 is late, 6 a tie
    arrive([(9, "a", 2, 1, 8.0), (10, "a", 2, 2, 9.0)])                                                    # day 1 expires
    arrive([(11, "a", 1, 40, 10.0), (12, "a", 2, 2, 11.0), (13, "c", 5, 1, 12.0)])                         # 11 is of an expired day
    got = {r.id: r.previous for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {1: None, 2: 1.0, 3: None, 4: None, 5: None, 6: 2.0, 7: 3.0, 8: None, 9: None, 10: 8.0, 11: None, 12: 9.0, 13: None}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_state_store_forgets_idle_keys(spark, folder):
    import time

    from lateline.streaming.state import previous_value_state
    kind = "id long, k string, day int, at long, v double"
    for n, row in enumerate([(1, "a", 1, 10, 1.0), (2, "a", 1, 11, 2.0)]):
        spark.createDataFrame([row], kind).write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(kind).parquet(f"{folder}/in")
        previous_value_state(s, ["k"], "day", ["at", "id"], "v", out=f"{folder}/out", checkpoint=f"{folder}/cp", ttl_hours=1 / 3_600_000).awaitTermination()
        time.sleep(0.1)
    assert {r.id: r.previous for r in spark.read.parquet(f"{folder}/out").collect()} == {1: None, 2: None}


def test_state_store_keys_share_calls(spark, folder):
    import pandas as pd

    from lateline.streaming import state as S

    class Map(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.get, dict.__setitem__

    # One call, three keys: a late row, rows of the state's period and of a later one, an unknown key.
    p = S.PreviousValue("day", ["at", "id"], "v", "previous", 0, None)
    p.last = Map({("a",): (1, 30, 5.0), ("b",): (1, 10, 6.0)})
    batch = pd.DataFrame({"id": [1, 2, 3, 4, 5, 6], "day": [1, 1, 1, 2, 2, 7], "at": [30, 20, 31, 1, 2, 0], "v": [7.0, 8.0, None, 1.0, 2.0, 3.0],
                          S.KEY: ["a", "a", "a", "b", "b", "c"], S.BUCKET: 0})
    got = pd.concat(p.handleInputRows((0,), iter([batch[:2], batch[2:]]), None))
    assert dict(zip(got["id"], got["previous"])) == {1: 5.0, 2: None, 3: 7.0, 4: None, 5: 1.0, 6: None}
    assert dict(p.last) == {("a",): (1, 31, None), ("b",): (2, 2, 2.0), ("c",): (7, 0, 3.0)}

    # Keys of several columns, NULLs and both zeros among them, over two runs and in as many calls as there are buckets.
    kind = "id long, k string, x double, day int, at long, v double"
    rows = [(i, [None, "a", "b"][i % 3], [None, 0.0, -0.0, 2.5][i % 4], 1, i, float(i)) for i in range(60)]
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        s = spark.readStream.schema(kind).parquet(f"{folder}/in")
        S.previous_value_state(s, ["k", "x"], "day", ["at", "id"], "v", out=f"{folder}/out", checkpoint=f"{folder}/cp", buckets=2).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    last, want = {}, {}
    for i, k, x, _, _, v in rows:
        want[i], last[k, x] = last.get((k, x)), v
    assert {r.id: r.previous for r in out.collect()} == want and out.columns == ["id", "k", "x", "day", "at", "v", "previous"]
