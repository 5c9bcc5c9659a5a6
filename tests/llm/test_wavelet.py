"""Wavelet shards: access, rank, select and the round trip through files."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lateline.llm import wavelet
from lateline.llm.common import written

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=900), st.integers(0, 5))
def test_queries_equal_a_list(ids, few):
    ids = [x % (few + 1) for x in ids] if few else ids
    w = wavelet.WaveletMatrix(wavelet.encode_shard(np.array(ids, "<u4"), [None, 5], [0, len(ids)]))
    assert w.decode().tolist() == ids and w.names == [None, 5]
    for i in range(0, len(ids), 37):
        assert w.access(i) == ids[i] and w.rank(ids[i], i) == ids[:i].count(ids[i])
    for s in {*ids[:5], 3, 99999}:
        places = [i for i, x in enumerate(ids) if x == s]
        assert w.count(s) == len(places) and w.occurrences(s) == places
    with pytest.raises(IndexError):
        w.select(7, len(ids))


def test_round_trip_of_documents(spark, folder):
    rows = [(5, "Hello there, World"), (1, None), (3, ""), (2, "one two  three\nfour"), (None, "null id"), (5, "Hello there, World"), (9, "x " * 4000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    made = written(wavelet.write(df, f"file://{folder}/out", PATH, shard=8), "shards")
    got = [tuple(r) for r in wavelet.documents(spark, f"file://{folder}/out", made).collect()]
    t = Tokenizer.from_file(PATH)
    want, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert made.count() > 1


def test_empty_table(spark, folder):
    df = spark.createDataFrame([], "doc_id long, text string")
    made = written(wavelet.write(df, f"{folder}/none", PATH), "shards")
    assert wavelet.documents(spark, f"{folder}/none", made).collect() == []


def test_files_answer_rank_and_select(spark, folder):
    """The end id's occurrences in the files are the documents' ends."""
    import glob

    df = spark.createDataFrame([(i, "some words and more " * (i % 9)) for i in range(60)], "doc_id long, text string").repartition(3)
    made = written(wavelet.write(df, f"file://{folder}/out", PATH, shard=400), "shards")
    names = []
    for file in glob.glob(f"{folder}/out/*.wave"):
        w = wavelet.WaveletMatrix(open(file, "rb").read())
        ends = np.cumsum(w.sizes) - 1
        assert w.count(2) == len(w.names) and w.occurrences(2) == ends.tolist() and [w.access(int(e)) for e in ends] == [2] * len(ends)
        assert w.rank(2, int(ends[-1])) == len(ends) - 1 and w.select(2, len(ends) - 1) == ends[-1]
        names += w.names
    assert sorted(names) == list(range(60)) and made.count() > 1
