"""The manifest against a tree computed in one piece."""
import hashlib

import pytest
from pyspark.sql import functions as F

from lateline.llm import manifest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)))


def climb(hashes, arity):
    """Top node, and per node its levels of (siblings before, siblings after)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i in range(len(paths)):
            k = at[i] // arity * arity
            paths[i].append(("".join(hashes[k:at[i]]), "".join(hashes[at[i] + 1:k + arity])))
            at[i] //= arity
        hashes = [h("".join(hashes[k:k + arity])) for k in range(0, len(hashes), arity)]
    return (hashes or [None])[0], paths


def brute(rows, arity, changed=lambda r: r):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, own = [], []
    for g in order:
        rs = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        top, paths = climb([leaf(*r) for r in rs], arity)
        subs.append(top)
        own.append((rs, paths))
    root, ups = climb(subs, arity)
    out = []
    for (rs, paths), up, sub in zip(own, ups, subs, strict=True):
        for r, p in zip(rs, paths, strict=True):
            x = leaf(*changed(r))
            for a, b in p + up:
                x = h(a + x + b)
            out.append((r[0], leaf(*r), sub, root, h("".join(a + b for a, b in p + up)), x, x == root))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


ROWS = [(i * 7 % 1000, f"Text {i} Ä\n", "en", None if i % 5 else "web", i) for i in range(70)] + [
    (5000 + i, "x", lang, "s", None) for i, lang in enumerate(["de", "é", "zz", "Z", "", None, None, "de"])] + [
    (None, "no id", "en", "s", 1), (None, None, None, None, None), (9, "same", "en", "s", 2), (9, "same", "en", "s", 2), (9, "other", "en", "s", 2),
    ((1 << 62) + 1, "long id", "en", "s", 2), (-3, "", "fr", "", 0)]


@pytest.mark.parametrize("arity,height", [(8, 3), (2, 1), (2, 2), (3, 2)])
def test_equals_brute_force(spark, arity, height):
    df = spark.createDataFrame(ROWS, KIND).repartition(3)
    changed = {"text": F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))}
    got = told(manifest.manifest(df, found=changed, arity=arity, height=height))
    want = brute(ROWS, arity, lambda r: (r[0], r[1].upper() if r[1] and r[0] is not None and r[0] % 2 == 0 else r[1], *r[2:]))
    assert got == want and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_of_one_group(spark, n):
    rows = [(i, "t", "en", "s", 1) for i in range(n)]
    got = told(manifest.manifest(spark.createDataFrame(rows, KIND), height=1))
    assert got == brute(rows, 8) and all(r[-1] for r in got)


def test_many_groups_and_clashing_columns(spark):
    rows = [(i, "t", f"g{i % 90}", "s", 1) for i in range(200)]
    df = spark.createDataFrame(rows, KIND)
    for c in ("pos", "n", "g", "h", "id", "part", "tie", "block", "altered", "one"):
        df = df.withColumn(c, F.lit("clash"))
    assert told(manifest.manifest(df, height=1)) == brute(rows, 8)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], KIND)
    assert manifest.manifest(df).collect() == []
    rows = [(4, "same text", "en", "s", 1)] * 700 + [(i, None, "en", None, None) for i in range(40)]
    assert told(manifest.manifest(spark.createDataFrame(rows, KIND).repartition(4), height=2)) == brute(rows, 8)


def test_long_text(spark):
    rows = [(1, "ab " * 700_000, "en", "s", 1), (2, "b", "en", "s", 1)]
    assert told(manifest.manifest(spark.createDataFrame(rows, KIND))) == brute(rows, 8)
