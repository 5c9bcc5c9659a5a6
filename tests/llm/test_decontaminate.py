"""Benchmark hits against a brute-force comparison of all windows."""
import hashlib
import random
import re

from lateline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    own |= wins[tuple(w[k:k + n])]
        names = sorted(str(x) for x in own)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)] + ["É", "ñandú", "x1"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 7, 12, 13, 14, 30])))) for i in range(30)]
    items = [x for x in items if len(x[1].split()) > 2] + [(90, None), (91, ""), (92, "..."), (93, items[5][1]), (94, "Single"), (95, items[3][1])]
    docs = []
    for i in range(60):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 300))]
        for _ in range(i % 4):
            part = rng.choice(items)[1] or ""
            at = rng.randrange(len(w) + 1)
            cut = part.split()
            w[at:at] = cut if rng.random() < 0.7 else cut[:12]
        docs.append((i, ", ".join(w).upper() if i % 5 == 0 else " - ".join(w)))
    docs += [(70, None), (71, ""), (72, "single"), (3, docs[3][1]), (3, docs[3][1]), (None, docs[7][1]), (73, items[0][1] * 1)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert told(decontaminate.hits(d, b)) == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.hits(d.limit(0), b).collect() == []
    assert told(decontaminate.hits(d, b.limit(0))) == brute([(1, "a b c")], [])


def test_main_path_has_no_python(spark, sf):
    from lateline.llm.queries import QUERIES

    for name in ("op8_winnowing_decontamination", "op6_feistel_pii"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
