"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; each bit is one binary classifier of byte n-grams that tells the languages
with +1 from those with -1. Up to seven languages get the exhaustive code (every split once), more a seeded random code.
A bit's classifier is the log ratio of n-gram rates on both sides, read off counts per language, and answers with its mean
over a text. Decoding takes the language whose codeword loses least, each bit weighted by how far its classifier separates
the training languages; a small lead over the second marks a text as ambiguous.

The counts come from a bounded sample of labelled rows (``sample``, by a hash of the id); whole texts are counted and scored.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0; rows with null language are scored and
never learnt from; a null id counts as held out of nothing (its remainder is null, so it is scored, not learnt from); rows
that repeat are scored one by one; other columns are ignored. Without any row to learn from every text is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER

BINS = 1 << 13
SAMPLE = 20_000           # labelled rows to learn from
FLOOR = 200               # rows of each language in the sample at least, if it has them
MOST = 512                # languages
LEAD = 0.1                # a smaller lead of the best score over the second is ambiguous
_LETTER = re.compile(r"[^\W\d_]")


def _grams(text: str) -> np.ndarray:
    """Hashed runs of two to four bytes, lower-cased."""
    a = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(LOWER) + b" ", np.uint8).astype(np.uint32)
    out, x = [], a
    for n in range(2, 5):
        x = (x[:-1] << np.uint32(8)) + a[n - 1:]
        out.append((x * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x05EBCA6B)) >> np.uint32(19))
    return np.concatenate(out)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 per language."""
    if n <= 2:
        return np.array([[1], [-1]], float)[:n]
    if n <= 7:
        cols = [[1 if i == 0 or m >> (i - 1) & 1 else -1 for i in range(n)] for m in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    bits = int(np.ceil(15 * np.log2(n)))
    return np.random.default_rng(seed).choice([-1.0, 1.0], (n, bits))


class Codes:
    """Bit classifiers and decoder, from n-gram counts per language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        rate = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        bits = []
        for c in self.code.T:
            pos = rate[c > 0].mean(0) if (c > 0).any() else np.zeros(counts.shape[1])
            neg = rate[c < 0].mean(0) if (c < 0).any() else np.zeros(counts.shape[1])
            bits.append(np.log((pos + 1e-6) / (neg + 1e-6)))
        self.bits = np.array(bits).T
        # Answers of each bit on the languages it was learnt from: its scale, and how well it separates them.
        told = (rate @ self.bits) * self.code
        self.scale = np.maximum(np.abs(told).mean(0), 1e-9)
        self.weight = np.maximum(told.min(0), 0.05 * self.scale) / self.scale
        self.weight /= self.weight.sum()

    def answer(self, text: str) -> tuple[str, float, bool]:
        g = _grams(text)
        told = np.bincount(g, minlength=BINS) @ self.bits / len(g) / self.scale
        loss = np.log1p(np.exp(np.clip(-4 * told * self.code, -30, 30))) @ self.weight
        p = np.exp(4 * (loss.min() - loss))
        p /= p.sum()
        best = int(np.argmin(loss))
        second = np.sort(p)[-2] if len(p) > 1 else 0.0
        return self.names[best], float(p[best]), bool(p[best] - second < LEAD)


def _taken(sizes: dict[str, int], lang, id, sample: int):
    """Condition on a row: whether it is in the sample, by a hash of its id and its language's share."""
    n = sum(sizes.values())
    if n <= sample:
        return F.lit(True)
    cuts = {name: int((1 << 40) * min(1.0, max(sample / n, FLOOR / size))) for name, size in sizes.items()}
    table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    return F.pmod(F.xxhash64(id), F.lit(1 << 40)) < F.element_at(table, lang)


def learn(labelled: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Codes | None:
    """Codes from about ``sample`` labelled rows, in the languages' own shares but at least about ``FLOOR`` of each (all, if
    fewer), so a language that is learnt at a small size is learnt at every size."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(F.col(lang).cast("string").alias("lang")).count().limit(MOST + 1).collect()
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages")
    rows = rows.where(_taken({r["lang"]: r["count"] for r in sizes}, F.col(lang).cast("string"), F.col(id), sample))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b["lang"], b["text"], strict=True):
                if _LETTER.search(t):
                    g = np.bincount(_grams(t), minlength=BINS)
                    total[name] = total[name] + g if name in total else g
        for name, g in total.items():
            at = np.flatnonzero(g)
            yield pd.DataFrame({"lang": name, "gram": at, "n": g[at]})

    counts = (rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
              .mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    got = counts.toPandas()                               # at most MOST * BINS rows
    if not len(got):
        return None
    names = sorted(got["lang"].unique())
    table = np.zeros((len(names), BINS))
    table[got["lang"].map({x: i for i, x in enumerate(names)}), got["gram"]] = got["n"]
    return Codes(names, table)


def identify(docs: DataFrame, codes: Codes | None, *, text: str = "text") -> DataFrame:
    """``docs`` with (lang_pred, score, ambiguous) appended; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def told(texts: pd.Series) -> pd.DataFrame:
        rows = [codes.answer(t) if codes is not None and t is not None and _LETTER.search(t) else ("und", 0.0, True) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "ambiguous"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], told(F.col(text)).alias("__t")).select(*[F.col(f"`{c}`") for c in keep], "__t.*")
