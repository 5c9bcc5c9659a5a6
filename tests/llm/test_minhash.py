"""Near duplicates against a brute-force comparison of all sets."""
import os
import random
import re
import time

import pytest
from pyspark.sql import types as T

from lateline.llm import minhash
from lateline.llm.common import components, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("component_id", T.StringType()), T.StructField("kept", T.StringType())])


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                both = len(sets[i] & sets[j])
                if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return {i: (len(sets[i]), low[i], low[i] == i) for i in ids}


def told(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_equals_brute_force_on_edits_copies_and_short_texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 6, 12, 30, 60, 66, 120, 300]))]
        for edit in range(9):
            copy = list(text)
            for _ in range(edit * max(1, len(text) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if edit % 4 == 3:
                copy += copy[:2]
            rows.append((n, " ".join(copy).upper() if edit == 2 else " \n".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, " \t\n "), (n + 3, "One"), (n + 4, "oNE"), (n + 5, "É"), (n + 6, "é")]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], DOCS).repartition(3)
    assert told(minhash.near_duplicates(df)) == brute(rows)


def test_a_crowd_around_one_centre_and_a_shared_passage(spark):
    rng = random.Random(9)
    centre = [f"c{i}" for i in range(80)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(1000, " ".join(centre))]
    for i in range(90):                      # 7 new words each: close to the centre, not to each other
        w = list(centre)
        for k in rng.sample(range(80), 4):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
    for i in range(100, 190):                # one passage, otherwise different
        rows.append((i, " ".join(passage + [f"q{i}x{k}" for k in range(rng.randrange(20, 90))])))
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    assert told(minhash.near_duplicates(df)) == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "A B C D"), (None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 3, 7, True)] * 2 + [(9, 3, 7, False), (None, 3, None, False), (None, 0, None, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_chains_rings_and_hubs(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 32), (32, 30)] + [(99, 50 + i) for i in range(12)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 30: 30, 31: 30, 32: 30, **{50 + i: 50 for i in range(12)}, 99: 50}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_repeated_id_with_another_text(spark):
    a, b = [" ".join(f"{p}{i}" for i in range(60)) for p in "ab"]
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (3, b + " z")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False)]


def passage_rows(n, seed, size=70, own=(20, 60)):
    """Documents with one long passage and their own rest, some of them near each other."""
    rng = random.Random(seed)
    passage, rows = [f"p{i}" for i in range(size)], []
    for i in range(n):
        rest = [f"q{i if rng.random() < 0.9 else i // 7}x{k}" for k in range(rng.randrange(*own))]
        rows.append((i, " ".join(rest[:len(rest) // 2] + passage + rest[len(rest) // 2:])))
    return rows


def test_a_third_share_a_passage(spark):
    rng = random.Random(2)
    rows = passage_rows(120, 3) + [(1000 + i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(100))) for i in range(60)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    assert told(minhash.near_duplicates(df)) == brute(rows)


def test_candidates_of_a_passage_grow_with_its_rows(spark, monkeypatch):
    counts = []
    likely = minhash._likely
    monkeypatch.setattr(minhash, "_likely", lambda pairs, reps: (counts.append(pairs.count()), likely(pairs, reps))[1])
    for n in (100, 200, 400):
        before = len(counts)
        df = spark.createDataFrame([(*r, None, None) for r in passage_rows(n, 5)], DOCS)
        minhash.near_duplicates(df).count()
        counts[before:] = [sum(counts[before:])]
    assert counts[1] <= 3 * max(counts[0], 50) and counts[2] <= 3 * max(counts[1], 100), counts


def test_a_very_long_text(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    near = list(long)
    for k in range(0, 300_000, 100):
        near[k] = "new"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "short text")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    got = told(minhash.near_duplicates(df))
    assert got == {1: (len(shingles(rows[0][1])), 1, True), 2: (len(shingles(rows[1][1])), 1, False), 3: (1, 3, True)}


def test_a_write_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before, was = files(), spark.conf.get(key)
    sums = spark.range(5000).selectExpr("id % 7 as k").groupBy("k").count()
    out = written(sums, "sums")
    until = time.time() + 10
    while files() - before and time.time() < until:          # executors are told to remove them, and do so a little later
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(key) == was
    # What was written stays whole, and its source can be asked again.
    assert sorted(r["count"] for r in out.collect()) == sorted(r["count"] for r in sums.collect()) == [714] * 5 + [715] * 2
    spark.conf.set(key, "false")
    with pytest.raises(Exception, match="broken"):
        written(sums.selectExpr("raise_error('broken') as x"), "broken", 10)
    assert spark.conf.get(key) == "false"
    spark.conf.unset(key)


def test_texts_are_shuffled_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(minhash, "written", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df)[1])
    base = spark.createDataFrame([(1, "a b", 5), (2, "c d", 6)], "id long, text string, h long")
    who = spark.createDataFrame([(10, 1, 5), (11, 2, 6)], "c long, id long, h long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = minhash._Texts(base, who).of(who.select("c").unionAll(who.select("c")))
        assert sorted(map(tuple, got.collect())) == [(10, "a b"), (11, "c d")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plans[0] and not any("hashpartitioning(c" in x for x in plans[0].split("SortMergeJoin")[0].splitlines())
