"""Output codes: codewords, held-out accuracy, rows without letters."""
import random

import numpy as np

from lateline.llm import language

SAMPLES = {"aa": "shin kora mitu pala", "bb": "zwert krampf schtolz", "cc": "oui leau feuille eux", "dd": "ción ñando llero que", "ee": "qxv zzt wkj"}


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SAMPLES))
        out.append((i, " ".join(rng.choice(SAMPLES[lang].split()) + rng.choice(["", "a", "e"]) for _ in range(rng.randrange(4, 60))), lang))
    return out


def test_held_out_and_odd_rows(spark):
    train = spark.createDataFrame(rows(300, 1) + [(900, None, "aa"), (901, "no lang", None), (902, "123", "bb")], "doc_id long, text string, lang string")
    codes = language.learn(train)
    test = rows(200, 2)
    odd = [(500, None, "x"), (501, "", "x"), (502, "12 + 3!", "x"), (None, SAMPLES["dd"], "x"), (503, SAMPLES["aa"] * 9000, "x"), (503, SAMPLES["aa"] * 9000, "x")]
    got = language.identify(spark.createDataFrame(test + odd, "doc_id long, text string, score string"), codes).collect()
    assert [r["lang_pred"] for r in got[:200]] == [x[2] for x in test]
    assert [r["lang_pred"] for r in got[200:]] == ["und", "und", "und", "dd", "aa", "aa"] and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["ambiguous"] for r in got[200:203])


def test_mixed_text_is_flagged(spark):
    train = spark.createDataFrame(rows(200, 3), "doc_id long, text string, lang string")
    codes = language.learn(train)
    name, score, _ = codes.answer(SAMPLES["aa"])
    mixed = codes.answer(SAMPLES["aa"] + " " + SAMPLES["bb"])
    assert name == "aa" and score > mixed[1]


def test_codewords_differ_and_split():
    for n in (1, 2, 3, 4, 7, 8, 40, 300):
        c = language.codewords(n)
        assert len(c) == n and len({tuple(r) for r in c}) == n
        if 2 < n <= 7:
            assert c.shape[1] == 2 ** (n - 1) - 1 and all(abs(x.sum()) < n for x in c.T)
        if n > 7:
            assert min((np.abs(a - b).sum() / 2 for i, a in enumerate(c[:40]) for b in c[:i]), default=1) >= 5


def test_nothing_to_learn_from_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    one = spark.createDataFrame([(1, "words", "aa")], "doc_id long, text string, lang string")
    assert language.learn(none) is None
    assert [r["lang_pred"] for r in language.identify(one, None).collect()] == ["und"]
    assert [r["lang_pred"] for r in language.identify(one, language.learn(one)).collect()] == ["aa"]
    assert language.identify(none, language.learn(one)).collect() == []


def test_registered_query_on_held_out_rows(spark, sf):
    from lateline.llm.queries import QUERIES

    got = QUERIES["op10_output_code_language"](spark, sf.replace("0.001", "0.01")).toPandas()
    true = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got[got.held_out].merge(true, on="doc_id")
    assert len(got) == len(true) and (both.lang_pred == both.lang).mean() > 0.97


def test_a_rare_language_stays_in_the_sample(spark):
    """Ten million rows, five of them in one language: the plan's condition keeps all five and about the bound of the others."""
    from pyspark.sql import functions as F

    sizes = {"en": 9_000_000, "de": 999_995, "rm": 5}
    rows = spark.range(2_000_000).select("id", F.when(F.col("id") % 400_000 == 0, "rm").when(F.col("id") % 10 == 1, "de").otherwise("en").alias("lang"))
    got = {r["lang"]: r["count"] for r in rows.where(language._taken(sizes, F.col("lang"), F.col("id"), 20_000)).groupBy("lang").count().collect()}
    assert got["rm"] == 5 and 3000 < got["en"] < 4300 and 300 < got["de"] < 500
