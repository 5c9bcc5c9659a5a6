"""Packing: whole round trip, order and gaps, near the bound."""
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lateline.llm import packing
from lateline.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello, world.", "two  spaces and\ttab\r\nline", " lead and trail ", "a\n\n\nb", "é ü ñandú, Straße.", "x" * 5000,
         "word, word. WORD! 'tis don't 12,345.67 @user #tag", " nbsp  em  space", "<|endoftext|> is text", "日本語 テキスト", "a\x1cb c\x85d"]


def direct(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_ids_equal_the_library_for_both_vocabularies():
    rng = random.Random(1)
    pool = ["the", "and,", "Straße", "ñ.", "x1", "--", "I'm", "", "\n", "été", "\t", "UPPER", "ﬁ", "İst", "a,b", "..."]
    texts = TEXTS + [" ".join(rng.choice(pool) for _ in range(40)) for _ in range(60)] + ["\n".join(rng.choice(pool) for _ in range(20)) for _ in range(20)]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        enc = Encoder(public_tokenizers.path(name), drops)
        assert list(enc.encode(texts)) == direct(public_tokenizers.path(name), texts)
        assert list(enc.encode(texts)) == direct(public_tokenizers.path(name), texts)


def test_long_texts_are_cut_between_tokens(monkeypatch):
    from lateline.llm import tokens

    monkeypatch.setattr(tokens, "SEGMENT", 300)
    text = ("some words, and more.\nnext line of text " * 60).strip()
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        assert list(Encoder(public_tokenizers.path(name), drops).encode([text])) == direct(public_tokenizers.path(name), [text])


def test_plan_keeps_every_piece_once_and_fits():
    rng = random.Random(3)
    for _ in range(30):
        cap = rng.choice([9, 10, 64, 1024])
        counts = {}
        for _ in range(rng.randrange(1, 300)):
            n = rng.randrange(1, cap + 1)
            counts[n] = counts.get(n, 0) + rng.randrange(1, 5)
        kinds = packing.plan(dict(counts), cap)
        held = {}
        for k in kinds:
            assert sum(n * c for n, c in k.holds) + k.gap == cap and k.count > 0 and k.gap >= 0
            assert sum(c for n, c in k.holds if 3 * n > cap) <= 2
            for n, c in k.holds:
                held[n] = held.get(n, 0) + c * k.count
        assert held == counts
        bound = max(-(-sum(n * c for n, c in counts.items()) // cap), sum(c for n, c in counts.items() if 2 * n > cap))
        assert sum(k.count for k in kinds) <= 11 * bound / 9 + 1
    assert packing.plan({}, 8) == [] and packing.plan({4: 3}, 8)[0].holds == [(4, 2)]


def test_pieces_and_places(spark):
    rng = random.Random(2)
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "c"), (3, TEXTS[3], "again"), (3, TEXTS[3], "again")]
    rows += [(100 + i, " ".join(rng.choice(["alpha", "beta"]) for _ in range(rng.randrange(1, 60))), "") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.packed(df, PATH, capacity=32, keep_ids=True).collect()
    want = [b + np.array([2], "<u4").tobytes() for b in direct(PATH, [t for _, t, _ in rows])]
    assert sum(r["length"] for r in got) * 4 == sum(map(len, want))
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] <= 32
    for i, _, _ in rows[:len(TEXTS)]:
        if i == 3:
            continue
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in own) == want[i] and [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert all(r["length"] == 32 for r in own[1:])
    assert sum(r["doc_id"] == 3 and r["piece"] == 0 for r in got) == 3
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 32
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 32) + 3
    joined = packing.sequences(packing.packed(df, PATH, capacity=32, keep_ids=True)).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(map(len, want)) and all(len(r["ids"]) == 4 * r["length"] for r in joined)


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_one_length_held_by_all(spark):
    df = spark.range(0, 500).selectExpr("id", "0 as piece", "0L as start", "3L as length", "id as ids_crc32")
    got = packing.pack(df, capacity=8, bucket=7).collect()
    assert len({r["sequence_id"] for r in got}) == 250 and len({(r["sequence_id"], r["offset"]) for r in got}) == 500


def test_special_tokens_are_the_librarys():
    rng = random.Random(6)
    pool = ["<|endoftext|>", "<|startoftext|>", "a<|endoftext|>b", "<|endoftext|>,", "the", "word,", "", "\n", "\t", "é", "<|ENDOFTEXT|>", "x1"]
    texts = ["<|endoftext|>", " <|endoftext|> ", "a  <|endoftext|>\n\nb"] + [s.join(rng.choice(pool) for _ in range(15)) for s in (" ", "\n", "  ") for _ in range(60)]
    for name, drops, end in (("byte_bpe_50k.json", False, 50256), ("word_bpe_49k.json", True, 49407)):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert list(Encoder(public_tokenizers.path(name), drops, special=True).encode(texts)) == want
        assert np.frombuffer(want[0], "<u4").tolist() == [end]


def test_queries_and_pipeline_keep_special_tokens(spark, folder):
    import corpus_pipeline
    from lateline.llm.queries import QUERIES

    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    df.write.parquet(f"{folder}/documents.parquet")
    assert [r["length"] for r in QUERIES["op2_best_fit_packing"](spark, folder).collect()] == [5]
    assert [r["n_tokens"] for r in QUERIES["op3_wavelet_tokens"](spark, folder).collect()] == [4]
    assert [r["length"] for r in corpus_pipeline.packed(spark, df, folder).collect()] == [5]


def test_a_piece_is_looked_up_once_and_signs_end_a_word(monkeypatch):
    from lateline.llm import tokens

    words = ["alpha", "Straße", "x1", "don't", "日本", "wörd…", "<|endoftext|>", "a<|endoftext|>", "l'été"]
    texts = [f"{w}{s} {w}{s}\n{w}{s} x" for w in words for s in ("", ",", "...", "***", "&&&", "'", "',", "\"!", "<|", "|>", "'s")]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        for special in (False, True):
            library = Tokenizer.from_file(public_tokenizers.path(name))
            library.encode_special_tokens = not special
            want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
            for kept in (500_000, 3):
                monkeypatch.setattr(tokens, "KEPT", kept)
                assert list(Encoder(public_tokenizers.path(name), drops, special).encode(texts)) == want
    monkeypatch.setattr(tokens, "KEPT", 500_000)
    enc, asked = Encoder(PATH, False), []
    ask = enc.rest._word
    enc.rest._word = lambda w: asked.append(w) or ask(w)
    list(enc.encode(["see cat, cat, cat dog*** dog", "see cat, dog***", "two cat"]))
    assert sorted(asked) == ["cat", "cat", "dog", "dog"]


def test_other_work_frees_the_encoder_and_texts_go_in_small_batches(spark, monkeypatch):
    from lateline.llm import common, minhash, tokens, toxicity

    enc = tokens.encoder(PATH, False)
    assert tokens.encoder(PATH, False) is enc and len(common._KEPT) == 1
    assert tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), True) is not enc and len(common._KEPT) == 1
    list(minhash._sketches(2)([]))
    assert not common._KEPT
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield b.assign(id=len(b))

    rows = common.written(spark.range(0, 50, 1, 1).mapInPandas(sizes, "id long"), "sizes", 20)
    assert {r["id"] for r in rows.collect()} == {20, 10} and spark.conf.get(name) == before
