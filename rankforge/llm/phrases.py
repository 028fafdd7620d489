"""Phrase collocations: merged count-min sketches, exact counts of what may be frequent, scores, subsumption.

A first pass over the texts counts the n-grams of one to four words in a count-min sketch. Up to some 200 MB of text it is
a sketch a task of two rows; counters saturate at 255, sketches are added up block by block, and the sum (``2 * width``
bytes, at most ``2 * MOST``) is broadcast. Beyond, that would fill and let all pass: there the one row of counters, of up
to ``BITS``, is held by no task. Tasks send (counter, count) of some millions of n-grams at a time to the counter's block,
and of the sums only a bit each is broadcast, whether it reaches ``min_count`` (``width / 8`` bytes, at most 64 MB).
Either never says less than the true count, so the second pass sends on just the n-grams whose estimate, and that of
whose every part, reaches ``min_count``: all frequent ones and few others, counted exactly by a grouped sum with map-side
partial sums. ``width`` follows the input up to ``BITS`` (some 20 counts a counter at 20 GB of text; far above, the second
pass counts nearly all n-grams: the result is the same, the shuffle larger; ``min_count`` should grow with the corpus).
Parts of a candidate are at least as frequent as it is, so their counts are there to be joined.

Null texts are empty; a null language is ``und``; empty texts and tables give nothing; very long texts are cut between
words, phrases across a cut are counted; repeated rows count each; ties are broken by score, count and the phrase's
bytes; ids are not read, further columns neither, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

#: A-Z to a-z, tab to space, piece ends to a byte that UTF-8 never has.
WORDS = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
LONGEST, BLOCK, MOST, SLICE = 4, 1 << 16, 1 << 24, 1_000_000
BITS, BUFFER = 1 << 29, 1 << 22
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def slices(texts: list[bytes | None], size: int = SLICE) -> Iterator[tuple[list[bytes], int]]:
    """The words of texts, b"\\xff" between pieces, some ``size`` bytes at a time; how many of a slice's words were in the one before."""
    carry, held, n = [], [], 0

    def cut(t: bytes) -> Iterator[bytes]:
        a = 0
        while len(t) - a > size:
            b = t.find(b" ", a + size)
            if b < 0:
                break
            yield t[a:b]
            a = b
        yield t[a:]

    def out():
        words = carry + b" ".join(held).split()
        return words, len(carry)

    for t in texts:
        for part in cut((t or b"").translate(WORDS).replace(b"\xff", b" \xff ") + b" \xff"):
            held.append(part)
            n += len(part)
            if n >= size:
                words, seen = out()
                yield words, seen
                carry, held, n = words[-(LONGEST - 1) :], [], 0
    if held:
        yield out()


def word_hashes(words: list[bytes], lang: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, each word's number among them (-1 between pieces), and the hashes of the distinct ones."""
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    seed = xxhash.xxh64_intdigest(lang.encode())
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in index], np.uint64)
    if b"\xff" in index:
        ids[ids == index[b"\xff"]] = -1
    return list(index), ids, hashes


def ngrams(ids: np.ndarray, hashes: np.ndarray, seen: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: where n-grams begin that lie in one piece and end in a word not seen before, and their hashes."""
    h = np.where(ids >= 0, hashes[ids] if len(hashes) else np.uint64(0), np.uint64(0))
    whole, mixed = ids >= 0, h
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(mixed) < 2:
                return
            mixed = (mixed[:-1] ^ mixed[:-1] >> np.uint64(29)) * _ODD[0] + h[n - 1 :]
            whole = whole[:-1] & (ids[n - 1 :] >= 0)
        at = np.flatnonzero(whole)
        at = at[at + n - 1 >= seen]
        yield n, at, mixed[at]


def places(h: np.ndarray, width: int) -> np.ndarray:
    """The counter of each hash in either row."""
    return (((h ^ h >> np.uint64(32)) * _ODD[:, None]) >> np.uint64(65 - width.bit_length())).astype(np.int64)


class Sketch:
    def __init__(self, width: int, rows: np.ndarray | None = None):
        self.width, self.rows = width, np.zeros((2, width), np.uint16) if rows is None else rows

    def add(self, h: np.ndarray) -> None:
        h, n = np.unique(h, return_counts=True)
        n = np.minimum(n, 255).astype(np.uint16)
        for row, at in zip(self.rows, places(h, self.width), strict=True):
            np.add.at(row, at, n)
            row[at] = np.minimum(row[at], 1 << 15)  # far from its end again

    def reaches(self, h: np.ndarray, least: int) -> np.ndarray:
        a, b = places(h, self.width)
        return (self.rows[0][a] >= least) & (self.rows[1][b] >= least)


class Marks:
    """A bit for each counter of a single row: whether it reaches the least count."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.width = bits, 8 * len(bits)

    def reaches(self, h: np.ndarray, least: int) -> np.ndarray:
        at = places(h, self.width)[0]
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def by_lang(b: pa.RecordBatch) -> Iterator[tuple[str, list[bytes | None]]]:
    """A batch's texts as bytes, language by language."""
    langs = b.column("lang").to_pylist()
    texts = b.column("t").cast(pa.large_binary())
    for lang in dict.fromkeys(langs):
        yield lang, texts.filter(pa.array([x == lang for x in langs])).to_pylist()


def texts_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(text).alias("t"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))


def sketch(rows: DataFrame, width: int, tasks: int) -> np.ndarray:
    """The merged sketch, two rows of ``width`` counters that end at 255."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(width)
        for b in batches:
            for lang, texts in by_lang(b):
                for words, seen in slices(texts):
                    _, ids, hashes = word_hashes(words, lang)
                    own.add(np.concatenate([h for _, _, h in ngrams(ids, hashes, seen)] or [hashes[:0]]))
        flat = own.rows.reshape(-1)
        for i in range(0, len(flat), BLOCK):
            part = np.minimum(flat[i : i + BLOCK], 255).astype(np.uint8)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "c"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for block, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                part = np.frombuffer(c, np.uint8)
                if block == at:
                    total += np.minimum(part, 255 - total)
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "c"])
                at, total = block, part.copy()
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "c"])

    blocks = -(-2 * width // BLOCK)
    parts = rows.coalesce(tasks).mapInArrow(count, "block int, c binary")
    merged = parts.repartition(min(blocks, 256), "block").sortWithinPartitions("block").mapInArrow(merge, "block int, c binary")
    out = np.zeros(2 * width, np.uint8)
    for r in merged.collect():  # at most 2 * MOST bytes
        out[r["block"] * BLOCK :][: len(r["c"])] = np.frombuffer(r["c"], np.uint8)
    return out.reshape(2, width)


def marks(rows: DataFrame, width: int, least: int) -> np.ndarray:
    """The bits of ``Marks``. A task holds ``BUFFER`` n-grams, then the blocks of its share of the counters."""
    blocks, most = width // BLOCK, BUFFER

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(places(np.concatenate(held), width)[0].astype(np.uint32), return_counts=True)
        ends = np.searchsorted(at, np.arange(blocks + 1, dtype=np.uint64) * BLOCK)
        some = np.flatnonzero(np.diff(ends))
        binary = lambda x, size: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.append(ends[some], len(at)) * size).astype(np.int32)), pa.py_buffer(x)])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), binary((at % BLOCK).astype(np.uint16), 2), binary(np.minimum(n, 255).astype(np.uint8), 1)], ["block", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for lang, texts in by_lang(b):
                for words, seen in slices(texts):
                    _, ids, hashes = word_hashes(words, lang)
                    own = [h for _, _, h in ngrams(ids, hashes, seen)]
                    held += own
                    size += sum(map(len, own))
                    if size >= most:
                        yield sent(held)
                        held, size = [], 0
        if size:
            yield sent(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(len(b)):
                block, at, n = (c[i].as_py() for c in b.columns)
                if block not in totals:
                    totals[block] = np.zeros(BLOCK, np.uint32)
                totals[block][np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint8)  # each once
        for block, total in totals.items():
            if (bits := np.packbits(total >= least, bitorder="little")).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "c"])

    sent_on = rows.mapInArrow(count, "block int, at binary, n binary").repartition(min(blocks, 256), "block")
    out = np.zeros(width // 8, np.uint8)
    for r in sent_on.mapInArrow(merge, "block int, c binary").collect():  # at most BITS / 8 bytes
        out[r["block"] * (BLOCK // 8) :][: len(r["c"])] = np.frombuffer(r["c"], np.uint8)
    return out


def counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 30, width: int | None = None, task_bytes: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of every n-gram with f >= min_count, and (lang, n), the words of each language."""
    rows = texts_of(docs, text, lang)
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    width = width or min(BITS, max(1 << 16, 1 << math.ceil(math.log2(size / 12 + 1))))  # an n-gram begins at every sixth byte or so, for each length
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))  # a sketch a task: texts are read in larger tasks
    least, dense = min(min_count, 255), width <= MOST
    shared = spark.sparkContext.broadcast(sketch(rows, width, tasks) if dense else marks(rows, width, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = Sketch(width, shared.value) if dense else Marks(shared.value)
        for b in batches:
            for of, texts in by_lang(b):
                for words, seen in slices(texts):
                    yield from _frequent(merged, of, words, seen, least)

    made = rows.mapInArrow(count, "lang string, words int, phrase string, f long")
    sums = materialize(made.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= min_count)), "ngrams")
    return sums.where("words > 0"), sums.where("words = 0").select("lang", F.col("f").alias("n"))


def _frequent(merged: Sketch | Marks, lang: str, words: list[bytes], seen: int, least: int) -> Iterator[pa.RecordBatch]:
    """A slice's n-grams that may be frequent, each once with its count; 0 words: the number of words."""
    names, ids, hashes = word_hashes(words, lang)
    may, numbers, texts = np.zeros(len(ids), bool), None, None
    for n, at, h in ngrams(ids, hashes, 0):
        if n > 1:  # only where both parts may be frequent
            good = may[at] & may[at + 1]
            at, h = at[good], h[good]
        at = at[merged.reaches(h, least)]
        may = np.zeros(len(ids), bool)
        may[at] = True
        key = ids[at] if n == 1 else numbers[at] * (len(names) + 1) + ids[at + n - 1]
        found, first, number = np.unique(key, return_index=True, return_inverse=True)
        numbers = np.zeros(len(ids), np.int64)
        numbers[at] = number
        new = at + n - 1 >= seen
        times = np.bincount(number[new], minlength=len(found))
        there = np.flatnonzero(times)
        texts = [b" ".join(words[i : i + n]) for i in at[first[there]].tolist()]
        total = int(((ids >= 0) & (np.arange(len(ids)) >= seen)).sum()) if n == 1 else 0
        k = len(texts)
        phrase = pa.array([*texts, *[b""] * (total > 0)], pa.binary()).cast(pa.string())
        f = pa.array([*times[there].tolist(), *[total] * (total > 0)], pa.int64())
        size = pa.array(np.array([n] * k + [0] * (total > 0), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), size, phrase, f], ["lang", "words", "phrase", "f"])


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 30, top: int = 2000, share: tuple[int, int] = (80, 100), width: int | None = None, task_bytes: int = 256 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases that no longer candidate holds at that share."""
    grams, words = counts(docs, text=text, lang=lang, min_count=min_count, width=width, task_bytes=task_bytes)
    known = grams.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    phrases = grams.where("words > 1").withColumn("w", F.split("phrase", " "))
    run = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    # the parts of each cut, joined one cut at a time by the side that has one row a key
    cut = phrases.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w")
    ends = cut.select("lang", "phrase", "a", "words", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), run(1, F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), run(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("e")).select("lang", "phrase", "a", "words", "k", "e.*")
    found = ends.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "words", "k").agg(F.max(F.when(F.col("left"), F.col("pf"))).alias("l"), F.max(F.when(~F.col("left"), F.col("pf"))).alias("r"))
    scored = found.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + r)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r")
    inside = phrases.where("words > 2").select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    inside = inside.select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("at"))
    longest = inside.select("lang", run(F.col("at"), F.col("n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * share[1] < F.col("a").cast("decimal(20,0)") * share[0]))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    dealt = kept.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language's best of 64 slots meet, no more
    dealt = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
worded AS (SELECT lang, list_filter(string_split(replace(p, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, m AS words, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM worded) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM grams WHERE words > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (c.a::HUGEINT * 2000000) // (l.f + r.f) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, w, m, unnest(range(1, words - m + 2)) AS i FROM (SELECT lang, f, words, string_split(phrase, ' ') AS w, unnest(range(2, words)) AS m FROM grams WHERE words > 2)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer::HUGEINT * 100 < a::HUGEINT * 80)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept k JOIN sizes USING (lang) QUALIFY rank <= 2000"""
