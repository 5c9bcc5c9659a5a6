"""Restored spellings, held-out accuracy, and rows without use."""
import random

from lateline.llm import toxicity

CLEAN = "the quick brown fox jumps over a lazy dog while many people walk along the river and talk about weather".split()
BAD = ["idiot", "moron", "stupid"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(CLEAN) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randrange(5, 80))]
        bad = i % 6 == 0
        for _ in range(2 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((i, " ".join(w), "c"))
        labels.append((i, int(bad)))
    return docs, labels


def test_restores_and_separates(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    ls = spark.createDataFrame(labels[:600] + [(None, 1), (5, None), (7, 9), (0, 1)], "doc_id long, toxic int")
    scorer = toxicity.learn(ls, d)
    got = {r["doc_id"]: r for r in toxicity.score(d, scorer).collect()}
    assert all(got[i]["predicted"] == y and 0 <= got[i]["score"] <= 1 for i, y in labels[600:])
    odd = [(0, None), (1, ""), (2, "you 1d10t st*pid"), (3, "m.o.r.o.n and s t u p i d"), (4, "mooooron stuuuupid!!!"), (5, "clean 123 text 50% a@b.c 2.5"),
           (5, "clean 123 text 50% a@b.c 2.5"), (None, "M0R0N, 1diot!"), (6, "the fox " * 30000)]
    rows = spark.createDataFrame(odd, "doc_id long, text string")
    told = [(r["text"], r["predicted"]) for r in toxicity.score(rows, scorer).collect()]
    assert told == [(t, int(t is not None and any(x in t for x in ("1d10t", "m.o", "mooo", "M0R")))) for _, t in odd]


def test_without_labels_and_empty_table(spark):
    docs, _ = corpus(20)
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(d, toxicity.learn(none, d)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(d, toxicity.learn(one, d)).collect()} == {0}
    assert toxicity.score(d.limit(0), toxicity.learn(one, d.limit(0))).collect() == []


def test_registered_query_on_held_out_rows(spark, sf):
    from lateline.llm.queries import QUERIES

    got = QUERIES["op5_noisy_channel_toxicity"](spark, sf.replace("0.001", "0.1")).toPandas()
    true = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/labels.parquet").toPandas()
    both = got[got.held_out].merge(true, on="doc_id")
    assert len(got) == 10000 and (both.predicted == both.toxic).mean() > 0.96
    assert both.predicted[both.toxic == 0].mean() < 0.01


def test_obfuscations_reach_the_search():
    import numpy as np

    n = np.zeros((27, 27, 27))
    for w in [*CLEAN, "idiot", "stupid", "asshole", "pussy", "idiot"] * 50:
        x = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            n[a, b, c] += 1
    two = n.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    model = np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5))
    reader = toxicity.Reader(model)
    for text, word in [("a$$hole", "asshole"), ("pu$$y", "pussy"), ("i--d--i--o--t", "idiot"), ("i..d..i..o..t", "idiot"), ("st" + "u" * 50 + "pid", "stupid"),
                       ("idiiot", "idiot"), ("iddiot", "idiot"), ("!diot", "idiot"), ("!d!ot!!", "idiot"), ("1d10t.", "idiot"), ("s  t  u  p  i  d", "stupid"),
                       ("s\tt\tu\tp\ti\td", "stupid"), ("y o u  i d i o t", "idiot"), ("(idiot)", "idiot")]:
        assert word in reader.words(text), (text, reader.words(text))
    assert any(w[0] == "f" and w[-1] == "k" for w in reader.words("f**k") - {"f**k"})
    scorer = toxicity.Scorer(model, {"stupid": 4.0, "idiot": 5.0}, (0.0, 0.0, 0.0))
    assert scorer.facts(reader, "s t u p i d i d i o t") == (9.0, 5.0)
    assert scorer.facts(reader, "12 3 4 5 6 walk along the river") == (0.0, 0.0)


def test_a_reader_goes_with_its_table(spark):
    import gc
    import weakref

    import numpy as np
    reader = toxicity.Reader(np.zeros((27, 27, 27)))
    assert "abc" in reader.read("abc")
    gone = weakref.ref(reader)
    gc.disable()
    try:
        del reader
        assert gone() is None
    finally:
        gc.enable()


def test_a_token_is_weighed_once_for_many_texts():
    import numpy as np

    class Counted(dict):
        asked = 0

        def __contains__(self, key):
            self.asked += 1
            return super().__contains__(key)

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    model = np.zeros((27, 27, 27))
    reader = toxicity.Reader(model)
    weights = Counted({"idiot": 5.0, "idio*": 4.0, "moro*": 3.0, "fox": 2.0})
    scorer = toxicity.Scorer(model, weights, (0.0, 0.0, 0.0))
    texts = [" ".join([*CLEAN, "idiot", "Idiot", "idiot,", "Moronic", "idiotic"])] * 40
    # A word counts once, by its strongest entry, however many tokens stand for it.
    assert {scorer.facts(reader, t) for t in texts} == {(2.0 + 5.0 + 3.0 + 4.0, 5.0)}
    assert weights.asked <= 12 * len(set(texts[0].split())), weights.asked
    other = toxicity.Scorer(model, {"fox": 1.0}, (0.0, 0.0, 0.0))
    assert other.facts(reader, texts[0]) == (1.0, 1.0) and scorer.facts(reader, texts[0]) == (14.0, 5.0)
    assert scorer.facts(reader, None) == scorer.facts(reader, "") == (0.0, 0.0)
