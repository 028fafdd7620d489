"""Language ID by a linear-chain conditional random field over words.

A word's features are its affixes, character n-grams, itself, and the languages whose lexicon of frequent words holds
it; transitions between neighbouring labels are learned with them. A third of the training chains are spliced from
spans of several languages, so that transitions see switches. Forward-backward gives each word's label probabilities, so
code-switched texts are labelled part by part (``spans``); a text's language is the one with the largest sum, and its
score that sum's share. Chains are at most ``CHAIN`` words; longer texts are several chains, all of them read.

Training takes at most ``per_lang`` rows of each language (smallest hash of id and text). Null texts, those of over
``max_chars`` characters and repeats of an id's text are left out before the sample is drawn; an id with several
languages is a row each. Null texts and those without a letter are ``und`` with score 0; repeated rows and those
without an id are judged each; very long texts are read whole; an empty table gives an empty result; further columns
are not read, whatever their names; without any labelled row all are ``und``.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, held, smallest_hashes

VOCABULARY, CHAIN, CACHE, LONG = 1 << 17, 256, 200_000, 40
JUNK = regex.compile(r"\P{L}+")


def clean(token: str) -> str:
    return JUNK.sub("", token.lower())


def split(text: str | None) -> list[str]:
    """Tokens by white space; those longer than LONG characters (scripts without spaces too) as pieces of that many."""
    tokens = (text or "").split()
    if max(map(len, tokens), default=0) > LONG:
        tokens = [x[i : i + LONG] for x in tokens for i in range(0, len(x), LONG)]
    return tokens


def features(word: str, lexicon: dict[str, tuple[str, ...]]) -> list[str]:
    """The word, its affixes, its languages by lexicon, and its n-grams; names tell them apart by their first sign."""
    w, n = word, len(word)
    named = ["=" + w, "^" + w[:1], "^" + w[:2], "^" + w[:3], "$" + w[-1:], "$" + w[-2:], "$" + w[-3:]]
    if w in lexicon:
        named += ["@" + x for x in lexicon[w]]
    return [*named, *w, *[w[i : i + 2] for i in range(n - 1)], *[w[i : i + 3] for i in range(n - 2)]]


def forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (T, N, L) of N chains padded to T, and expected transition counts (L, L). Potentials, not logs."""
    t_max, n, k = e.shape
    a, b, total = np.zeros_like(e), np.ones_like(e), np.zeros((k, k))
    a[0] = start * e[0]
    a[0] /= a[0].sum(1, keepdims=True)
    for t in range(1, t_max):
        x = a[t - 1] @ trans * e[t]
        x /= x.sum(1, keepdims=True)
        a[t] = np.where(mask[t][:, None], x, a[t - 1])
    for t in range(t_max - 2, -1, -1):
        y = e[t + 1] * b[t + 1]
        x = y @ trans.T
        x /= x.sum(1, keepdims=True)
        b[t] = np.where(mask[t + 1][:, None], x, b[t])
        pair = a[t][:, :, None] * trans * y[:, None, :]
        total += (pair / pair.sum((1, 2), keepdims=True))[mask[t + 1]].sum(0)
    p = a * b
    return p / p.sum(2, keepdims=True), total


def marginals(e: np.ndarray, trans: np.ndarray, start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """As forward_backward, without transition counts."""
    a, b = np.empty_like(e), np.ones_like(e)
    a[0] = start * e[0]
    for t in range(1, len(e)):
        x = a[t - 1] @ trans * e[t]
        a[t] = x / x.sum(1, keepdims=True)
    for t in range(len(e) - 2, -1, -1):
        x = (e[t + 1] * b[t + 1]) @ trans.T
        b[t] = np.where(mask[t + 1][:, None], x / x.sum(1, keepdims=True), 1)
    p = a * b
    return p / p.sum(2, keepdims=True)


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the first word of each chain of CHAIN words at most."""
    n = -(-lengths // CHAIN)
    row = np.repeat(np.arange(len(lengths)), n)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * CHAIN


class Model:
    """Weights of the features in ``names``; others weigh nothing."""

    def __init__(self, langs: list[str], names: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, lexicon: dict):
        self.langs, self.names, self.weights, self.trans, self.start, self.lexicon = langs, names, weights, trans, start, lexicon
        self.index = {x: i for i, x in enumerate(names)}
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {"": -1}
        self.table = np.zeros((CACHE, max(1, len(langs))), np.float32)

    def learn(self, tokens: list[str], found: list) -> np.ndarray | None:
        """Fills in the rows of the table of tokens without one (-1: no letter); what the table cannot hold is returned beside it."""
        missing = [i for i, r in enumerate(found) if r is None]
        new: dict[str, list[int]] = {}
        for i in missing:
            w = clean(tokens[i])
            r = self.words.get(w)
            if r is None:
                new.setdefault(w, []).append(i)
            else:
                found[i] = r
                if len(self.known) < CACHE and len(tokens[i]) < 60:
                    self.known[tokens[i]] = r
        if not new:
            return None
        none = len(self.names)
        feats = [[self.index.get(f, none) for f in features(w, self.lexicon)] for w in new]
        sizes = np.array(list(map(len, feats)))
        z = np.add.reduceat(np.concatenate([self.weights, self.weights[:1] * 0])[np.fromiter(chain.from_iterable(feats), np.int64)], np.cumsum(sizes) - sizes)
        z = np.exp(np.maximum(z - z.max(1, keepdims=True), -30))
        beyond = []
        for k, (w, places) in enumerate(new.items()):
            row = len(self.words) - 1
            if row < CACHE and len(w) < 60:
                self.table[row] = z[k]
                self.words[w] = row
            else:
                row = CACHE + len(beyond)
                beyond.append(z[k])
            for i in places:
                found[i] = row
                if row < CACHE and len(self.known) < CACHE and len(tokens[i]) < 60:
                    self.known[tokens[i]] = row
        return np.array(beyond, np.float32) if beyond else None

    def predict(self, texts: list[str | None], most: int = 100_000) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        out, held, size = [], [], 0
        for t in texts:
            held.append(split(t))
            size += len(held[-1])
            if size >= most:
                out += self._rows(held)
                held, size = [], 0
        return out + self._rows(held)

    def _rows(self, held: list[list[str]]) -> list[tuple[str, float]]:
        tokens = [x for h in held for x in h]
        found = list(map(self.known.get, tokens))
        beyond = self.learn(tokens, found) if None in found else None
        table = self.table if beyond is None else np.concatenate([self.table, beyond])
        flat, out, at = np.array(found, np.int64), [], 0
        for h in held:
            a = flat[at : at + len(h)]
            out.append(a[a >= 0])
            at += len(h)
        return self._judge(out, table)

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first token, end token, language) of the parts of a text; tokens without a letter go with those before them."""
        tokens = split(text)
        if not self.langs or not tokens:
            return []
        found = list(map(self.known.get, tokens))
        beyond = self.learn(tokens, found) if None in found else None
        table = self.table if beyond is None else np.concatenate([self.table, beyond])
        flat = np.array(found, np.int64)
        words = np.flatnonzero(flat >= 0)
        best = np.concatenate([marginals(table[flat[c]][:, None, :], self.trans, self.start, np.ones((len(c), 1), bool))[:, 0].argmax(1) for c in (words[i : i + CHAIN] for i in range(0, len(words), CHAIN))] or [words])
        out: list[tuple[int, int, str]] = []
        for w, y in zip(words.tolist(), best.tolist(), strict=True):
            if out and out[-1][2] == self.langs[y]:
                out[-1] = (out[-1][0], w + 1, out[-1][2])
            else:
                if out:
                    out[-1] = (out[-1][0], w, out[-1][2])
                out.append((w if out else 0, w + 1, self.langs[y]))
        return [*out[:-1], (out[-1][0], len(tokens), out[-1][2])] if out else []

    def _judge(self, rows: list[np.ndarray], table: np.ndarray) -> list[tuple[str, float]]:
        if not rows:
            return []
        lengths = np.array(list(map(len, rows)))
        sums = np.zeros((len(rows), len(self.langs)))
        flat = np.concatenate(rows)
        begin = np.cumsum(lengths) - lengths
        row, first = chains(lengths)
        size = np.minimum(CHAIN, lengths[row] - first)
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), 512):
            c = order[i : i + 512]
            t = np.arange(size[c[0]])[:, None]
            mask = t < size[c]
            at = (begin[row[c]] + first[c])[None, :] + np.minimum(t, size[c] - 1)
            p = marginals(table[flat[at]], self.trans, self.start, mask)
            np.add.at(sums, row[c], (p * mask[:, :, None]).sum(0, dtype=float))
        best = sums.argmax(1)
        return [(self.langs[b], float(min(1.0, sums[i, b] / lengths[i]))) if lengths[i] else ("und", 0.0) for i, b in enumerate(best)]


def spliced(seqs: list[np.ndarray], ys: list[np.ndarray], part: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Half as many chains as given, each of spans of 2 to 12 words of chains of any language, with the words' labels."""
    out = []
    for _ in range(-(-len(seqs) // 2)):
        x, y = [], []
        while sum(map(len, x)) < part and len(x) < part:
            j, n = int(rng.integers(len(seqs))), int(rng.integers(2, 13))
            at = int(rng.integers(max(1, len(seqs[j]) - n + 1)))
            x.append(seqs[j][at : at + n])
            y.append(ys[j][at : at + n])
        out.append((np.concatenate(x)[:part], np.concatenate(y)[:part]))
    return out


def fit(texts: list[str], labels: list[str], steps: int = 40, part: int = 32, lexicon_size: int = 200, seed: int = 0) -> Model:
    """Maximum likelihood by Adam, all chains at once; a text's words bear its label."""
    langs = sorted(set(labels))
    k = len(langs)
    if not k:  # nothing to learn
        return Model([], [], np.zeros((1, 1), np.float32), np.ones((1, 1), np.float32), np.ones(1, np.float32), {})
    docs = [([w for w in map(clean, split(t)) if w], langs.index(x)) for t, x in zip(texts, labels, strict=True)]
    counts = [Counter() for _ in langs]
    for words, y in docs:
        counts[y].update(words)
    lexicon: dict = {}
    for name, c in zip(langs, counts, strict=True):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            lexicon[w] = (*lexicon.get(w, ()), name)
    ids: dict[str, int] = {}
    seqs, ys = [], []
    for words, y in docs:
        x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        seqs += [x[i : i + part] for i in range(0, len(x), part)]
        ys += [np.full(len(c), y) for c in seqs[len(ys) :]]
    if not seqs:
        return fit([], [])
    mixed = spliced(seqs, ys, part, np.random.default_rng(seed)) if k > 1 else []
    seqs, ys = [*seqs, *(c for c, _ in mixed)], [*ys, *(c for _, c in mixed)]
    n = len(seqs)
    size = np.array(list(map(len, seqs)))
    x, y = np.zeros((n, part), np.int64), np.zeros((n, part), np.int64)
    for i, (s, labels_of) in enumerate(zip(seqs, ys, strict=True)):
        x[i, : len(s)], y[i, : len(s)] = s, labels_of
    x, y, mask = x.T, y.T, (np.arange(part)[:, None] < size)
    often: Counter = Counter()
    for w in ids:
        often.update(features(w, lexicon))
    names = [f for f, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]]
    index = {f: i for i, f in enumerate(names)}
    del often
    feats = [np.array([index[f] for f in features(w, lexicon) if f in index], np.int32) for w in ids]  # numbers, not the features' texts
    sizes = np.array(list(map(len, feats)))
    flat, at, of_word = np.concatenate(feats), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(ids)), sizes)
    W, T, S = np.zeros((len(names), k)), np.eye(k) * 2.0, np.zeros(k)
    gold_words = np.bincount((x * k + y)[mask], minlength=len(ids) * k).reshape(-1, k)
    gold_trans = np.bincount((y[:-1] * k + y[1:])[mask[1:]], minlength=k * k).reshape(k, k)
    gold_start = np.bincount(y[0], minlength=k)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (W, T, S)]
    for step in range(1, steps + 1):
        z = np.add.reduceat(W[flat], at)
        z = np.exp(np.maximum(z - z.max(1, keepdims=True), -30))
        trans, start = np.exp(T), np.exp(S)
        p, pairs = forward_backward(z[x], trans, start, mask)
        p *= mask[:, :, None]
        on_words = np.stack([np.bincount(x.ravel(), p[:, :, j].ravel(), len(ids)) for j in range(k)], 1) - gold_words
        grad = np.stack([np.bincount(flat, on_words[of_word, j], len(names)) for j in range(k)], 1)
        grads = (grad / n + 1e-5 * W, (pairs - gold_trans) / n + 1e-3 * T, (p[0].sum(0) - gold_start) / n)
        for q, d, m in zip((W, T, S), grads, moments, strict=True):
            m[0] += 0.1 * (d - m[0])
            m[1] += 0.01 * (d * d - m[1])
            q -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Model(langs, names, W.astype(np.float32), np.exp(T).astype(np.float32), np.exp(S).astype(np.float32), lexicon)


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 150, max_chars: int = 50_000, fold: tuple[int, int] = (4, 2)) -> Model:
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).alias("y")).where("d is not null and y is not null and t is not null")
    rows = rows.where((crc_mod(F.col("d"), fold[0]) != fold[1]) & (F.length("t") <= max_chars)).withColumn("h", F.xxhash64("d", "t"))
    few = smallest_hashes(rows.select("d", "h", "y").distinct(), "y", [F.col("h"), F.col("d")], per_lang)
    got = rows.join(F.broadcast(few), ["d", "h", "y"]).groupBy("d", "h", "y").agg(F.first("t").alias("t")).orderBy("d", "y", "h").collect()
    return fit([r["t"] for r in got], [r["y"] for r in got])


def predictor(docs: DataFrame, model: Model):
    """A column function: text to (lang, score). The model holds VOCABULARY features at most (a few MB)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.names, model.weights, model.trans, model.start, model.lexicon))
    key = uuid.uuid4().hex

    def predict(texts: pd.Series) -> pd.DataFrame:
        model = held(key, lambda: Model(*shared.value))
        return pd.DataFrame(model.predict(list(texts)), columns=["lang", "score"])

    return F.pandas_udf(predict, "lang string, score double")


def language_id(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    held = F.coalesce(crc_mod(F.col(doc_id), fold[0]) == fold[1], F.lit(False))
    got = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), predictor(docs, model)(F.col(text)).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def language_spans(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the parts of every row's text: first and end token (split by white space, long ones in pieces), language."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.names, model.weights, model.trans, model.start, model.lexicon))
    key = uuid.uuid4().hex

    def label(texts: pd.Series) -> pd.Series:
        model = held(key, lambda: Model(*shared.value))
        return pd.Series([[{"first": a, "end": b, "lang": x} for a, b, x in model.spans(t)] for t in texts], dtype=object)

    column = F.pandas_udf(label, "array<struct<first int, end int, lang string>>")
    return docs.select(F.col(doc_id).alias("doc_id"), column(F.col(text)).alias("spans"))
