"""Exact repeats of long word windows by fixed-block anchors.

A window of L words always contains a whole aligned block of b = (L + 1) / 2 words, wherever it starts. So every document
indexes its non-overlapping blocks and probes all indexed blocks with each of its rolling windows of b words; a block that
is met at a second place is an anchor. Anchors are extended to the L-word windows around them, and those windows that
start at two places or more mark their words.

Documents are dealt to groups of bounded size by a hash. A group sends each of its distinct hashes once, packed and split
by hash range, and gets back those that repeat, so a passage that a third of all documents share costs one entry per
group. Words are compared as 64-bit hashes of whole windows.

Nulls and edge cases: a null or empty text has no words; documents shorter than a window keep all words; a null id is
reported like any other; rows that repeat, ids included, are separate documents, so each removes the other's windows;
other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_hashes, text_hashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
GROUP_CHARS = 6_000_000        # characters of text in a group, on average
RANGE_BYTES = 16 << 20          # of packed hashes in a range, on average


def _within(at: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of the n - length + 1 runs over concatenated documents stay inside one document."""
    ok = np.ones(max(0, n - length + 1), bool)
    for end in at[1:-1]:
        ok[max(0, int(end) - length + 1):int(end)] = False
    return ok


def _hashes(texts, length: int):
    """Word hashes, document offsets, and hash and place of every run of ``length`` inside a document."""
    h, at = text_hashes(texts, lower=False)
    place = np.flatnonzero(_within(at, len(h), length))
    return h, at, run_hashes(h, length)[place], place


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values occur in ``of``, sorted."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    return of[np.minimum(at, len(of) - 1)] == values


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and whether each occurs twice or more."""
    v = np.sort(values)
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.empty(0, np.int64)
    return v[first], np.diff(np.append(first, len(v))) > 1


def _short(values: np.ndarray) -> np.ndarray:
    """The upper 48 bits. Anchors only point to windows that are compared afterwards, so they travel without the rest."""
    return values & ~np.uint64(0xFFFF)


def _bytes(values: np.ndarray, short: bool) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() if short else values.tobytes()


def _numbers(raw: bytes, short: bool) -> np.ndarray:
    if not short:
        return np.frombuffer(raw, np.uint64)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _packed(group: int, values: np.ndarray, blocks: np.ndarray, ranges: int, short: bool) -> pd.DataFrame:
    """A row per range of hashes: distinct values in order, and two flags each (repeats here, starts a block) as bits."""
    v, many = _distinct(values)
    part = (v >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(v)) if len(v) else np.zeros(1, np.int64)
    spans = list(zip(edge[:-1], edge[1:], strict=True))
    mark = _member(v, np.sort(blocks))
    return pd.DataFrame({"part": part[edge[:-1]].astype(np.int64), "grp": np.full(len(spans), group, np.int64),
                         "v": [_bytes(v[f:t], short) for f, t in spans], "many": [np.packbits(many[f:t]).tobytes() for f, t in spans],
                         "mark": [np.packbits(mark[f:t]).tobytes() for f, t in spans]})


_PACKED = "part long, grp long, v binary, many binary, mark binary"


def _repeated(anchored: bool):
    """Of a range of hashes: those that repeat (and, for anchors, start a block), for each group that has them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vs = [_numbers(x, anchored) for x in pdf["v"]]

        def flagged(name):
            return np.sort(np.concatenate([v[np.unpackbits(np.frombuffer(f, np.uint8), count=len(v)).view(bool)]
                                           for f, v in zip(pdf[name], vs, strict=True)]))

        v, many = _distinct(np.concatenate(vs))
        keep = many | _member(v, flagged("many"))
        if anchored:
            keep &= _member(v, flagged("mark"))
        kept = v[keep]
        rows = [(g, _bytes(x[_member(x, kept)], anchored)) for g, x in zip(pdf["grp"], vs, strict=True)]
        return pd.DataFrame([r for r in rows if r[1]], columns=["grp", "v"])
    return run


def _values(pdf: pd.DataFrame, short: bool) -> np.ndarray:
    return np.sort(np.concatenate([np.empty(0, np.uint64), *[_numbers(x, short) for x in pdf["v"]]]))


def _search(rows: DataFrame, window: int, ranges: int) -> DataFrame:
    """Rows (grp, v): per group, packed hashes of its windows that start anywhere else as well."""
    block = (window + 1) // 2

    def probe(key, pdf):
        _, at, run, place = _hashes(pdf["text"], block)
        start = at[np.searchsorted(at, place, "right") - 1]
        run = _short(run)
        return _packed(key[0], run, run[(place - start) % block == 0], ranges, True)

    def extend(key, left, right):
        h, at, run, place = _hashes(left["text"], block)
        near = np.zeros(len(h) + 1, np.int64)
        hit = place[_member(_short(run), _values(right, True))]
        np.add.at(near, np.maximum(hit - (window - block), 0), 1)
        np.add.at(near, hit + 1, -1)
        near = np.cumsum(near)[:-1] > 0
        wide = np.flatnonzero(_within(at, len(h), window))
        wide = wide[near[wide]]
        return _packed(key[0], run_hashes(h, window)[wide], np.empty(0, np.uint64), ranges, False)

    anchors = (rows.groupBy("grp").applyInPandas(probe, _PACKED)
               .groupBy("part").applyInPandas(_repeated(True), "grp long, v binary"))
    wide = rows.groupBy("grp").cogroup(anchors.groupBy("grp")).applyInPandas(extend, _PACKED)
    return wide.groupBy("part").applyInPandas(_repeated(False), "grp long, v binary")


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = 35,
                    keep_text: bool = True) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256[, kept]): each document without the words that repeated windows cover.

    ``kept`` joins the kept words by one space; the digest is of its UTF-8 bytes.
    """
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    chars, n = base.agg(F.sum(F.length("text")), F.count("*")).first()
    groups = max(1, (chars or 0) // GROUP_CHARS, n // 50_000)
    ranges = max(1, (chars or 0) * 8 // 6 // RANGE_BYTES)      # about one word, so one hash, for six characters
    # All passes shuffle the same rows by the same key, so Spark deals the texts once and reads that exchange three times.
    rows = base.withColumn("grp", F.pmod(F.xxhash64("id", F.md5("text")), F.lit(groups)))
    found = _search(rows, window, int(ranges))

    def remove(key, left, right):
        repeated = _values(right, False)
        h, at, run, place = _hashes(left["text"], window)
        edge = np.zeros(len(h) + 1, np.int64)
        hit = place[np.isin(run, repeated)]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        out = []
        for i, (name, t) in enumerate(zip(left["id"], left["text"], strict=True)):
            words = WORDS.findall(t) if isinstance(t, str) else []
            lost = gone[at[i]:at[i + 1]]
            n = int(lost.sum())
            kept = " ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x] if n else words)
            out.append((name, len(words), n, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), *([kept] if keep_text else [])))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])]).astype({"id": "Int64"})

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return (rows.groupBy("grp").cogroup(found.groupBy("grp")).applyInPandas(remove, schema).withColumnRenamed("id", id))


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS k,
             coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
p AS (SELECT k, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
x AS (SELECT k, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM p),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
gone AS (SELECT k, list(DISTINCT i) AS places FROM (SELECT k, unnest(range(s, s + 35)) AS i FROM x JOIN r USING (h)) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(places, z[2])), lambda z: z[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (k)
"""
