"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with its ends marked), so unseen misspellings share vectors with known
words. Vectors are averaged over a window of ``WINDOW`` words, and a linear softmax scores it; a text is as toxic as
its most toxic window, so a few words in a long text count. ``WINDOW``, ``per_class`` and ``steps`` were chosen on
training rows alone: learned without those of crc32(doc_id) mod 5 = 1 and compared on them.

Training takes at most ``per_class`` labelled rows of either class (those of the smallest hash of id and text), first
over whole-text averages, then over each text's top window; scoring reads every whole text map-side. Rows of over
``max_chars`` characters and repeats of an id's text are left out before the sample is drawn, so they take no places
in it; an id with contradicting labels is toxic; several texts under one id are a row each. Empty and null texts get
the score of no words; repeated rows and those without an id are scored each; very long texts are scored whole; an
empty table gives an empty result; further columns are not read, whatever their names; without labels of both classes
the model knows nothing and scores 0.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_mod, held, smallest_hashes

VOCABULARY, DIM, WINDOW, CACHE = 1 << 17, 8, 2, 200_000
#: Characters of a word that are judged at once, and how many of them the next piece of a longer word shares.
LONG, SHARED = 40, 4
JUNK = re.compile(r"[\W_]+")


def subwords(word: str) -> list[str]:
    """The n-grams of 3 to 5 characters and the word, with its ends marked."""
    w = f"<{word}>"
    n = len(w)
    return [w, *[w[i : i + 3] for i in range(n - 2)], *[w[i : i + 4] for i in range(n - 3)], *[w[i : i + 5] for i in range(n - 4)]]


def clean(token: str) -> str:
    return JUNK.sub("", token.lower())


def pieces(word: str) -> list[str]:
    """The word, or overlapping pieces of one longer than LONG, each judged as a word."""
    return [word[i : i + LONG] for i in range(0, max(1, len(word) - SHARED), LONG - SHARED)]


class Model:
    """Vectors of the n-grams in ``names``; others have the zero vector."""

    def __init__(self, names: list[str], vectors: np.ndarray, softmax: np.ndarray, bias: float | None):
        self.names, self.vectors, self.softmax, self.bias = names, vectors, softmax, bias
        self.share = dict(zip(names, (vectors @ softmax).tolist(), strict=True))  # the softmax of an average is the average of these
        self.known: dict[str, float] = {}
        self.words: dict[str, float] = {"": float("nan")}

    def word(self, token: str) -> float:
        """The averaged embedding's share in the logit (of a long word, its top piece's); a token of no letter or digit has none (NaN)."""
        v = self.known.get(token)
        if v is None:
            w = clean(token)
            v = self.words.get(w)
            if v is None:
                v = max(sum([self.share.get(g, 0.0) for g in grams]) / len(grams) for grams in map(subwords, pieces(w)))
                if len(self.words) < CACHE and len(w) < 60:
                    self.words[w] = v
            if len(self.known) < CACHE and len(token) < 60:
                self.known[token] = v
        return v

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        tokens = (text or "").split()
        values = list(map(self.known.get, tokens))
        if None in values:
            values = [self.word(t) if v is None else v for t, v in zip(tokens, values, strict=True)]
        s = np.array(values, float)
        s = s[~np.isnan(s)]
        top = 0.0
        if len(s):
            c = np.concatenate([[0.0], np.cumsum(s)])
            n = min(WINDOW, len(s))
            top = (c[n:] - c[:-n]).max() / n
        return float(1 / (1 + np.exp(-np.clip(top + self.bias, -30, 30))))


def fit(texts: list[str | None], labels: list[int], steps: tuple[int, int] = (40, 100), seed: int = 0) -> Model:
    """Adam over all texts at once: gradients reach vectors and softmax together."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(DIM, np.float32), None)
    ids: dict[str, int] = {}
    seqs = []
    for t in texts:
        words = [p for w in map(clean, (t or "").split()) if w for p in pieces(w)]
        seqs.append(np.array([ids.setdefault(w, len(ids)) for w in words] or [ids.setdefault("", len(ids))], np.int32))
    often: Counter = Counter()
    texts_with = np.bincount(np.concatenate([np.unique(s) for s in seqs]), minlength=len(ids)).tolist()
    for w, n in zip(ids, texts_with, strict=True):
        for g in set(subwords(w)):
            often[g] += n
    names = [g for g, n in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1] or [""]
    index = {g: i for i, g in enumerate(names)}
    del often
    each = [np.array([index.get(g, -1) for g in subwords(w)], np.int32) for w in ids]  # numbers, not the texts of n-grams
    sizes = np.array(list(map(len, each)))
    gram = np.concatenate(each)
    of_word = np.repeat(np.arange(len(ids)), sizes)[gram >= 0]
    gram = gram[gram >= 0]
    flat, length = np.concatenate(seqs), np.array(list(map(len, seqs)))
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    doc_of = np.repeat(np.arange(len(seqs)), length)
    # the windows that lie inside one text; a shorter text is one window
    n_win = np.minimum(WINDOW, length)
    ok = np.arange(len(flat)) + n_win[doc_of] <= (begin + length)[doc_of]
    w_at, w_doc = np.flatnonzero(ok), doc_of[ok]
    w_first = np.concatenate([[0], np.flatnonzero(np.diff(w_doc)) + 1])
    rng = np.random.default_rng(seed)
    E, u, b = rng.normal(0, 0.1, (len(names), DIM)), rng.normal(0, 0.5, DIM), np.zeros(1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, u, b)]
    weight = np.where(y > 0, 0.5 / y.sum(), 1.0 / (1 - y).sum())
    for step in range(1, sum(steps) + 1):
        scores = np.bincount(of_word, (E @ u)[gram], len(ids)) / sizes
        s = scores[flat]
        c = np.concatenate([[0.0], np.cumsum(s)])
        if step <= steps[0]:
            z = (c[begin + length] - c[begin]) / length * np.sqrt(np.minimum(length, 64)) + b
        else:
            v = (c[w_at + n_win[w_doc]] - c[w_at]) / n_win[w_doc]
            top = np.maximum.reduceat(v, w_first)
            z = top + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        if step <= steps[0]:
            on_words = np.bincount(flat, (g / length * np.sqrt(np.minimum(length, 64)))[doc_of], len(ids))
        else:
            best = np.flatnonzero(v >= top[w_doc] - 1e-12)
            best = best[np.concatenate([[True], np.diff(w_doc[best]) > 0])]
            on_words = np.zeros(len(ids))
            for k in range(WINDOW):
                d = w_doc[best]
                use = k < n_win[d]
                on_words += np.bincount(flat[w_at[best][use] + k], (g / n_win)[d[use]], len(ids))
        on_grams = np.bincount(gram, (on_words / sizes)[of_word], len(names))
        grads = (np.outer(on_grams, u) + 1e-6 * E, E.T @ on_grams + 1e-6 * u, np.array([g.sum()]))
        for p, d, m in zip((E, u, b), grads, moments, strict=True):
            m[0] += 0.1 * (d - m[0])
            m[1] += 0.01 * (d * d - m[1])
            p -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    return Model(names, E.astype(np.float32), u.astype(np.float32), float(b[0]))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 800, max_chars: int = 100_000, fold: tuple[int, int] = (5, 0)) -> Model:
    """Learns from at most 2 * per_class rows of up to max_chars characters (training only) outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("d"), F.col(label).alias("y")).where("d is not null and y is not null")
    known = known.where(crc_mod(F.col("d"), fold[0]) != fold[1]).groupBy("d").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).alias("d"), F.coalesce(text, F.lit("")).alias("t")).where(F.col("d").isNotNull() & (F.length("t") <= max_chars))
    rows = rows.withColumn("h", F.xxhash64("d", "t"))
    few = smallest_hashes(rows.select("d", "h").distinct().join(known, "d"), "y", [F.col("h"), F.col("d")], per_class)
    got = rows.join(F.broadcast(few.select("d", "h", "y")), ["d", "h"]).groupBy("d", "h", "y").agg(F.first("t").alias("t")).orderBy("d", "h").collect()
    return fit([r["t"] for r in got], [r["y"] for r in got])


def scorer(docs: DataFrame, model: Model):
    """A column function: text to score. The model (VOCABULARY n-grams at most, under 8 MB) is broadcast; word scores are cached by worker, for the tasks of a stage."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.vectors, model.softmax, model.bias))
    key = uuid.uuid4().hex

    def score(texts: pd.Series) -> pd.Series:
        model = held(key, lambda: Model(*shared.value))
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return F.pandas_udf(score, "double")


def toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held: Column = F.coalesce(crc_mod(F.col(doc_id), fold[0]) == fold[1], F.lit(False))
    scored = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), scorer(docs, model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
