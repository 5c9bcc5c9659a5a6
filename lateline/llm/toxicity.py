"""Toxicity with noisy-channel deobfuscation.

Obfuscated spellings (digits and signs for letters, letters set apart, letters repeated) are channel noise over ordinary
letters. Each token with a choice (a sign or digit that may be a letter or a gap, a letter twice) becomes a lattice of the
letters its characters may stand for; a Viterbi search with a trigram character model, counted over all documents, restores
the likeliest spelling. Only what has neither a letter nor a sign for one, such as a number, is not read as a word. Letters set
apart by white space are restored together, at wider gaps apart, and searched for lexicon words. The score is taken from the
plain and the restored words.

The lexicon is learnt: for every word and word beginning, how many toxic and other documents of a bounded labelled sample
hold it; entries with enough support and a high rate ratio are kept. A logistic function of the summed and the strongest
weights of a text, fitted on sample rows that the lexicon was not learnt from, gives the score.

Nulls and edge cases: null and empty texts score as texts without any entry; rows without a label are scored and never
learnt from; repeated labels of an id count once, as toxic if any says so; labels other than 0 and 1 are ignored; rows that
repeat are scored one by one; other columns are kept, but for those named like the two added ones, which are replaced. With no
usable label, or one class only, every score is the smoothed share of toxic labels.
"""


import math
import re
import weakref
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go

SAMPLE = 20_000           # labelled rows to learn from
ENTRIES = 20_000          # lexicon entries, the strongest
SUPPORT = 4               # toxic documents that must hold an entry
RATIO = 3.0               # least log ratio of the rates
STEMS = (4, 5, 6)         # lengths of word beginnings
WITHIN = 4                # letters of a lexicon word that is looked for within letters set apart
TOKENS = 200_000          # tokens whose reading a reader remembers

# Letters that a sign stands for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "ß": "ss"}
GAPS = set(".-_*'’·~^/\\,")
_EDGE = ".,;:!?\"'()[]{}<>«»“”„…#$%&*+-/=@\\^_`|~"        # around a plain word
_FRAME = ".,;:?\"')[]{}>«»“”„…#%&*=~^`"                   # around a disguised one, where other signs may be letters
_SHUT, _OPEN = "!" + _FRAME, "(<¡" + _FRAME
_CHOICE = re.compile(r"[0-9@$!|+€£(<¡ß*.\-_'’·~^/\\,]|([a-z])\1")
_LETTERS = re.compile(r"[^\W\d_]|[@$!|+€£(<¡]")
# Longer repeats only add a constant to all paths: gaps always stand for nothing, and more than 40 masked letters cost more
# than the characters beside them can gain.
_REPEAT = re.compile(r"([.\-_'’·~^/\\,])\1+|([^*])\2{3,}|(\*)\3{40,}")
_APART = re.compile(r"(?<!\S)(?:[^\s.,;]\s+){3,}[^\s](?!\S)")
_GAP = re.compile(r"\s+")

_PLACE = np.zeros(256, np.int64)                      # 0: other, 1 to 26: letters
for _c in range(26):
    _PLACE[97 + _c] = _PLACE[65 + _c] = _c + 1


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of a letter after two (27 x 27 x 27, 0 for what is no letter), counted over all rows.

    Every task counts its own texts; the 19683 sums are what reaches the driver.
    """
    def count(batches):
        let_go()
        total = np.zeros(27 ** 3, np.int64)
        for b in batches:
            for t in b["text"]:
                if t:
                    x = _PLACE[np.frombuffer(b"  " + t.encode("utf-8", "surrogatepass") + b" ", np.uint8)]
                    total += np.bincount(x[:-2] * 729 + x[1:-1] * 27 + x[2:], minlength=27 ** 3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    got = (docs.select(F.col(text).cast("string").alias("text")).mapInPandas(count, "gram int, n long")
           .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    n = np.zeros(27 ** 3)
    n[got["gram"].to_numpy(np.int64)] = got["n"]
    n = n.reshape(27, 27, 27)
    two = n.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5))


_ONE = {c: [(c, 0.0)] for c in "abcdefghijklmnopqrstuvwxyz"}


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character: what it may stand for, with its cost. A gap or a repeated letter may stand for nothing."""
    out, letters = [], token.lower()
    for i, c in enumerate(letters):
        before = letters[i - 1] if i else ""
        if c != before and c in _ONE:
            options = _ONE[c]
        elif c in SIGNS:
            options = [(x, 0.3) for x in SIGNS[c]] if c != "ß" else [("ss", 0.1)]
            if not c.isalnum():
                options.append(("", 2.0))
            elif before and before in SIGNS[c]:
                options.append(("", 0.5))
        elif "a" <= c <= "z":
            # Twice may be meant; three times and more is stretched.
            drawn = c in (letters[i - 2:i - 1], letters[i + 1:i + 2])
            options = [(c, 0.6), ("", 0.2)] if drawn else [(c, 0.0), ("", 6.0)]
        elif c == "*":
            options = [("", 0.2), *((x, 2.5) for x in "abcdefghijklmnopqrstuvwxyz")]
        elif c in GAPS or c.isspace():
            options = [("", 0.2)]
        else:
            options = [(c, 0.0)]
        out.append(options)
    return out


def _collapsed(token: str) -> str:
    return _REPEAT.sub(lambda m: m[1] or (m[2] or "") * 3 or m[3] * 40, token)


def restore(token: str, model: list | np.ndarray) -> str:
    """The likeliest letters behind a token. States are the last two letters; other letters count as a break."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}      # with the letters so far, last first
    for options in _lattice(token):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        if len(options) == 1 and options[0][0] in _ONE:
            # Most characters have no choice: every path goes on by this letter.
            x, cost = options[0]
            k = ord(x) - 96
            for (i, j), (p, s) in states.items():
                q = p - cost + model[i][j][k]
                if (j, k) not in new or q > new[j, k][0]:
                    new[j, k] = (q, (s, x))
            states = new
            continue
        for (i, j), (p, s) in states.items():
            for letters, cost in options:
                q, a, b = p - cost, i, j
                for x in letters:
                    k = ord(x) - 96 if "a" <= x <= "z" else 0
                    q, a, b = q + (model[a][b][k] if k else -3.0), b, k
                if (a, b) not in new or q > new[a, b][0]:
                    new[a, b] = (q, (s, letters) if letters else s)
        states = new
    (_, _), (_, s) = max(states.items(), key=lambda x: x[1][0] + model[x[0][0]][x[0][1]][0])
    out = []
    while s is not None:
        s, letters = s
        out.append(letters)
    return "".join(reversed(out))


class Reader:
    """Words of a text, plain and restored."""

    def __init__(self, model: np.ndarray):
        model = model.tolist()
        self.restored = lambda token: restore(token, model)
        # The table does not hold its reader: in a ring they would stay in the worker, task after task, until a collection.
        own = weakref.proxy(self)
        self.read = lru_cache(TOKENS)(lambda w: own._read(w))
        self._lexicon: dict[str, float] | None = None

    def _read(self, w: str) -> tuple[str, ...]:
        """What a token may be: itself, restored, and restored without the signs at its ends that close a sentence."""
        out = {w if w.isalpha() else w.strip(_EDGE)}
        if not _CHOICE.search(w) or not _LETTERS.search(w):
            return tuple(out)
        bare = _collapsed(w).strip(_FRAME)
        if _CHOICE.search(bare):
            shut = bare.rstrip(_SHUT)
            for x in {bare, shut, shut.lstrip(_OPEN)}:
                if _CHOICE.search(x):
                    out.add(self.restored(x))
        return tuple(out)

    def found(self, weights: dict[str, float]) -> Callable[[str], tuple[tuple[str, float], ...]]:
        """From a token to the words behind it that have entries in ``weights``, with their strongest; nearly all have none.
        The table of tokens seen is of one lexicon at a time."""
        if self._lexicon is not weights:
            own = weakref.proxy(self)
            self._lexicon, self._found = weights, lru_cache(TOKENS)(lambda w: strongest(own._read(w), weights))
        return self._found

    def apart(self, text: str, tokens: set[str]) -> list[str]:
        """Letters set apart, restored: each run as a whole, and what wider gaps part it into. ``tokens``: all of the text."""
        # Fewer tokens of one character than two make no word of letters set apart.
        if list(map(len, tokens)).count(1) < 2:
            return []
        out = []
        for m in _APART.findall(text.lower()):
            if not _LETTERS.search(m):
                continue
            gaps = _GAP.findall(m)
            least = min(map(len, gaps))
            parts, at = [""], iter([*gaps, ""])
            for c in _GAP.split(m):
                parts[-1] += c
                if len(next(at)) > least:
                    parts.append("")
            out.append("".join(parts))
            if len(parts) > 1:
                out += parts
        return [self.restored(_collapsed(x)) for x in out]

    def told(self, text: str | None) -> tuple[set[str], list[str]]:
        """All words, and those of letters set apart once more."""
        if not text:
            return set(), []
        out = set()
        tokens = set(text.lower().split())
        out.update(*map(self.read, tokens))
        apart = self.apart(text, tokens)
        out.update(apart)
        out.discard("")
        return out, apart

    def words(self, text: str | None) -> set[str]:
        return self.told(text)[0]

    def entries(self, text: str | None) -> set[str]:
        words = self.words(text)
        out = {*words}
        for n in STEMS:
            out |= {f"{w[:n]}*" for w in words if len(w) > n}
        return out


def strongest(words: Iterable[str], weights: dict[str, float]) -> tuple[tuple[str, float], ...]:
    """Words that have entries, each with its strongest."""
    out = []
    for word in words:
        here = [weights[k] for k in (word, *[f"{word[:n]}*" for n in STEMS]) if k in weights]
        if here and word:
            out.append((word, max(here)))
    return tuple(out)


class Scorer:
    def __init__(self, model: np.ndarray, weights: dict[str, float], line: tuple[float, float, float]):
        self.model, self.weights, self.line = model, weights, line
        self.longest = max(map(len, weights), default=0)

    def within(self, run: str) -> list[float]:
        """Weights of the lexicon words in restored letters, apart from each other, that add up to most."""
        best: list[tuple[float, tuple | None]] = [(0.0, None)]
        for end in range(1, len(run) + 1):
            top = best[-1]
            for n in range(WITHIN, min(self.longest, end) + 1):
                x = self.weights.get(run[end - n:end])
                if x is not None and best[end - n][0] + x > top[0]:
                    top = (best[end - n][0] + x, (best[end - n][1], x))
            best.append(top)
        found, out = best[-1][1], []
        while found is not None:
            found, x = found
            out.append(x)
        return out

    def facts(self, reader: Reader, text: str | None) -> tuple[float, float]:
        """Summed weights, of which a word gives its strongest entry only, and the strongest."""
        if not text:
            return 0.0, 0.0
        tokens, words = set(text.lower().split()), {}
        for found in filter(None, map(reader.found(self.weights), tokens)):
            words.update(found)
        apart = reader.apart(text, tokens)
        words.update(strongest(apart, self.weights))
        best = list(words.values())
        for run in apart:
            if run not in self.weights:
                best += self.within(run)
        return (math.fsum(best), max(best)) if best else (0.0, 0.0)


def learn(labelled: DataFrame, docs: DataFrame, *, id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          sample: int = SAMPLE) -> Scorer:
    """``labelled`` has (id, toxic), the rows that may be learnt from; ``docs`` has all texts."""
    model = character_model(docs, text)
    own = (labelled.where(F.col(toxic).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("id"))
           .agg(F.max(toxic).cast("int").alias("toxic")))
    picked = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` rows of two numbers, so this side may be broadcast.
    rows = (docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
            .join(F.broadcast(picked), "id").withColumn("fit", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0))

    def count(batches):
        reader, seen = Reader(model), {}
        for b in batches:
            for t, y in zip(b["text"], b["toxic"], strict=True):
                for e in reader.entries(t):
                    seen.setdefault(e, [0, 0])[y] += 1
        yield pd.DataFrame([(e, a, b) for e, (a, b) in seen.items()], columns=["entry", "other", "toxic"])

    counts = (rows.where("not fit").select("text", "toxic").mapInPandas(count, "entry string, other long, toxic long")
              .groupBy("entry").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")))
    # Rows of each label need no text, so no text is read for them.
    whole = rows.where("not fit").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other")).first()
    if not whole["other"] or not whole["toxic"]:
        share = ((whole["toxic"] + 0.5) / (whole["toxic"] + whole["other"] + 1)) if whole["toxic"] is not None else 0.5
        return Scorer(model, {}, (float(np.log(share / (1 - share))), 0.0, 0.0))
    # The log ratio of the rates, less a margin of one and a half standard errors of the toxic count.
    weight = (F.log((F.col("toxic") / F.lit(float(whole["toxic"]))) / ((F.col("other") + 1) / F.lit(float(whole["other"] + 1))))
              - 1.5 / F.sqrt("toxic"))
    kept = (counts.where(f"toxic >= {SUPPORT}").withColumn("w", weight).where(f"w >= {RATIO}").orderBy(F.desc("w"), "entry").limit(ENTRIES))
    weights = {r["entry"]: r["w"] for r in kept.select("entry", "w").collect()}    # at most ENTRIES rows
    scorer = Scorer(model, weights, (0.0, 0.0, 0.0))

    def facts(batches):
        reader = Reader(model)
        for b in batches:
            f = [scorer.facts(reader, t) for t in b["text"]]
            yield pd.DataFrame({"s": [x for x, _ in f], "m": [x for _, x in f], "toxic": b["toxic"]})

    seen = rows.where("fit").select("text", "toxic").mapInPandas(facts, "s double, m double, toxic int").toPandas()
    scorer.line = _logistic(seen[["s", "m"]].to_numpy(), seen["toxic"].to_numpy()) if len(seen) else (-4.0, 0.5, 0.5)
    return scorer


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic fit by Newton steps, on at most a third of the sample and two facts per row."""
    a = np.column_stack([np.ones(len(x)), x / 10])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return float(w[0]), float(w[1] / 10), float(w[2] / 10)


def score(docs: DataFrame, scorer: Scorer, *, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with (score, predicted) appended under ``names``; columns of these names are replaced."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in names]

    @F.pandas_udf("double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        reader, (c, s, m) = Reader(scorer.model), scorer.line
        for texts in batches:
            f = np.array([scorer.facts(reader, t) for t in texts]).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(c + s * f[:, 0] + m * f[:, 1], -30, 30))))

    out = docs.select(*keep, told(F.col(text).cast("string")).alias(names[0]))
    return out.withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))
