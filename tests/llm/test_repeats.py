"""Repeated windows against a count of all windows."""
import hashlib
import random
import re
from collections import Counter

import pytest

from lateline.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, groups", [(35, 400), (5, 300), (2, 10**9), (1, 300)])
def test_equals_brute_force(spark, monkeypatch, window, groups):
    monkeypatch.setattr(repeats, "GROUP_CHARS", groups)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 4000)
    rng = random.Random(window)
    words = [f"w{i}" for i in range(3000)] if window > 2 else [f"w{i}" for i in range(40)]
    passage = [rng.choice(words) for _ in range(window + 9)]
    rows = []
    for i in range(40):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(4):len(passage) - rng.randrange(4)]
        rows.append((i, ("\t" if i % 2 else " ").join(w)))
    rows += [(50, "a b " * 60), (51, None), (52, ""), (53, rows[4][1]), (4, rows[4][1]), (None, rows[5][1]), (54, "É é " * window)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, grp int").repartition(4)
    got = sorted((tuple(r) for r in repeats.without_repeats(df, window=window).collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
