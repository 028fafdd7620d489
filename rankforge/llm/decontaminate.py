"""Benchmark decontamination by pigeonhole edit matching.

Items and texts become lower-cased words joined by single spaces. An item of n characters may be found with
k = floor(rate * n) edits; cut into k + 1 pieces, one of them must occur exactly. One automaton finds all pieces in
one pass over a text, their hits imply candidate places, and Myers' bit-parallel distance verifies those. Items under
``least_chars`` have no error budget and must stand as whole words. A worker holds one list of about ``most_items``
items at a time; further ones take a further pass each, which writes the hits it finds, without texts.

Null and empty texts or items match nothing; an item id with several texts is found at most once a text, at its least
distance; items without an id are searched by their texts and found with a null id, each text; documents without an id
are judged like any others, repeated rows each; very long texts are searched whole; an empty table gives an empty
result; further columns are kept by ``with_hits`` and not read, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fresh, held, in_files, materialize

#: A-Z to a-z; digits, a-z and the bytes of non-ASCII characters stay; all else separates words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
HITS = "array<struct<item_id long, distance int, start long, end long>>"


def normal(text: str | None) -> str:
    """Words by single spaces; UTF-8 bytes shown as characters, so that edits count bytes."""
    return b" ".join((text or "").encode().translate(WORDS).split()).decode("latin-1")


def myers(pattern: str, text: str, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """The least edit distance of the pattern to any part of the text, and where that part first ends; None if over most.

    ``anchored``: parts begin where the text does.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << max(0, m - 1)
    pv, mv, score, best, end = full, 0, m, min(m, most + 1), 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return (best, end) if best <= most else None


class Finder:
    def __init__(self, items: list[tuple[int | None, str]], rate: float, least_chars: int):
        import ahocorasick

        self.items, seeds = [], {}
        for item_id, text in items:
            n = len(text)
            if not n:
                continue
            k, i = int(rate * n) if n >= least_chars else 0, len(self.items)
            self.items.append((item_id, text, k, n < least_chars))
            cuts = [n * x // (k + 1) for x in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((i, a))
        self.machine = None
        if seeds:
            self.machine = ahocorasick.Automaton()
            for piece, places in seeds.items():
                self.machine.add_word(piece, (len(piece), places))
            self.machine.make_automaton()

    def search(self, text: str | None) -> list[dict]:
        """For each item found: its least distance, and the first end that has it with the nearest start (characters of the normal form)."""
        t = normal(text)
        if self.machine is None or not t:
            return []
        near: dict[int, set[int]] = {}
        for end, (size, places) in self.machine.iter(t):
            for i, offset in places:
                near.setdefault(i, set()).add(end + 1 - size - offset)
        out: dict[int | str, dict] = {}
        for i, starts in near.items():
            item_id, item, k, whole = self.items[i]
            best, done = None, None
            for s in sorted(starts):
                if done is not None and s <= done:
                    continue  # the window judged last holds all that this start may
                done = s + k
                a, b = max(0, s - k), min(len(t), s + len(item) + 3 * k)
                if t.startswith(item, max(0, s)) and s >= 0:
                    if whole and (s and t[s - 1] != " " or t[s + len(item) : s + len(item) + 1].strip()):
                        done = None
                        continue
                    found = (0, s + len(item), s)
                elif (m := myers(item, t[a:b], k)) is None:
                    continue
                else:  # back from the end: the shortest part of that distance
                    back = myers(item[::-1], t[a : a + m[1]][::-1], m[0], anchored=True)
                    found = (m[0], a + m[1], a + m[1] - back[1])
                if best is None or found[0] < best[0]:
                    best = found
                    if not best[0]:
                        break
            if best:
                hit = {"item_id": item_id, "distance": best[0], "start": best[2], "end": best[1]}
                key = item if item_id is None else item_id
                out[key] = min(out.get(key, hit), hit, key=lambda x: (x["distance"], x["start"]))
        return sorted(out.values(), key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["start"]))


def finder(spark, items: list[tuple[int | None, str]], rate: float, least_chars: int):
    """A column function: text to the items found in it."""
    shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def find(texts: pd.Series) -> pd.Series:
        search = held(key, lambda: Finder(shared.value, rate, least_chars)).search
        return pd.Series([search(t) for t in texts], dtype=object)

    return F.pandas_udf(find, HITS)


def with_hits(docs: DataFrame, benchmark: DataFrame, column: str, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.06, least_chars: int = 40, most_items: int = 20_000) -> DataFrame:
    """The rows with a column of the items found; one pass over the texts a list of items.

    With several lists each pass writes (place of the row, hits) of the rows that have some, and rows fetch them once.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    lists = -(-items.count() // most_items) or 1
    slot = F.pmod(F.xxhash64(F.coalesce("i", F.xxhash64("t"))), F.lit(lists))  # an id's texts share a list

    def found(k: int):  # a list's items, most_items or little more, are all that the driver and a worker hold
        got = sorted(((r["i"], normal(r["t"])) for r in items.where(slot == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        return finder(docs.sparkSession, got, rate, least_chars)(F.col(text))

    if lists == 1:
        return docs.withColumn(column, found(0))
    held, file, at = in_files(docs), fresh([*docs.columns, column], "file"), fresh([*docs.columns, column], "at")
    place = [F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)]
    parts = [materialize(held.select(*place, found(k).alias("hits")).where("size(hits) > 0"), "hits") for k in range(lists)]
    every = reduce(DataFrame.unionByName, parts).groupBy(file, at).agg(F.flatten(F.collect_list("hits")).alias(column))
    got = held.select(*[c for c in docs.columns if c != column], *place).join(every, [file, at], "left")
    return got.withColumn(column, F.coalesce(column, F.array().cast(HITS))).drop(file, at)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, distance, start, end: a row for each item found in a row's text."""
    rows = with_hits(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), benchmark, "hits", text="t", **options)
    return rows.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
