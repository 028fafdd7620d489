"""Fuzzy search for short licence notices in whole texts.

A text becomes its lower-cased words joined by single spaces. Each notice of error budget k is split into k + 1 pieces
(pigeonhole: one of them survives k edits); exact hits of pieces give candidate places, and only those are judged, by
comparison at the implied place and else by the regex library's bounded-error matching, which reports the span and
its edits. All exact places of a notice are kept; fuzzy ones lie between them, whole words each, without overlap, and
any span of words within the budget overlaps a place that is kept.

Null and empty texts have no words; every row is judged, repeated ones and those without an id too; an empty table
gives an empty result; further columns are not read, whatever their names. Very long texts are searched whole, in time
that grows with their length and the number of notices in them.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int
    base: bool = False


NOTICES = (
    Notice("gpl", "gnu general public license", 3, True),
    Notice("apache", "apache license", 1, True),
    Notice("cc-by", "cc by", 0, True),
    Notice("mit", "mit license", 1, True),
    Notice("cc-by-nc", "licensed under cc by nc", 2),
    Notice("apache-2.0", "licensed under the apache license version 2 0", 4),
    Notice("all-rights-reserved", "all rights reserved", 2),
)
#: A-Z to a-z; digits, a-z and the bytes of non-ASCII characters stay; all else separates words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def pieces(phrase: str, errors: int) -> list[tuple[int, bytes]]:
    cuts = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, phrase[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = [(n, n.phrase.encode(), pieces(n.phrase, n.errors), regex.compile(b"(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(n.phrase.encode()), n.errors))) for n in notices]

    @staticmethod
    def window(joined: bytes, a: int, b: int) -> tuple[int, int]:
        """The whole words of joined[a:b]."""
        a, b = max(0, a), min(len(joined), b)
        if a and joined[a - 1] != 32:
            at = joined.find(b" ", a, b)
            a = at + 1 if at >= 0 else b
        if b < len(joined) and joined[b] != 32:
            b = joined.rfind(b" ", a, b)
        return a, b

    def places(self, joined: bytes, phrase: bytes, k: int, parts: list, pattern) -> list[tuple[int, int, int]]:
        """Start, end and edits of each place of a notice, in order."""
        starts = set()
        for offset, piece in parts:
            at = joined.find(piece)
            while at >= 0:
                starts.add(at - offset)
                at = joined.find(piece, at + 1)
        n, spans = len(phrase), []
        for s in sorted(starts):
            if s >= 0 and joined.startswith(phrase, s) and (s == 0 or joined[s - 1] == 32) and (s + n == len(joined) or joined[s + n] == 32):
                spans.append((s, s + n, 0))
        exact = {s for s, _, _ in spans}
        for s in sorted(starts - exact) if k else ():
            todo = [(s - k, s + n + 2 * k)]
            while todo:
                a, b = todo.pop()
                i = bisect_right(spans, (s,))  # the gap around the candidate, or beside the span that covers it
                before, after = spans[i - 1 : i], spans[i : i + 1]
                left = [(a, min(b, before[0][0]))] if before and a < before[0][0] else []
                a = max(a, before[0][1]) if before else a
                b = min(b, after[0][0]) if after else b
                for x, y in [*left, (a, b)]:
                    x, y = self.window(joined, x, y)
                    m = pattern.search(joined, x, y) if y - x >= n - k else None
                    if m and m.end() > m.start() and sum(m.fuzzy_counts):
                        insort(spans, (m.start(), m.end(), sum(m.fuzzy_counts)))
                        todo += [(x, m.start()), (m.end(), y)]
        return spans

    def search(self, text: str | None) -> tuple[int, list[tuple[Notice, int, int, int, bytes]]]:
        """The number of words, and (notice, first word, end word, edits, matched words) of each place."""
        words = (text or "").encode().translate(WORDS).split()
        joined, found = b" ".join(words), []
        for notice, phrase, parts, pattern in self.notices:
            at = first = 0
            for a, b, e in self.places(joined, phrase, notice.errors, parts, pattern):
                first += joined.count(b" ", at, a)
                at = a
                found.append((notice, first, first + joined.count(b" ", a, b) + 1, e, joined[a:b]))
        return len(words), found


PLACES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("words", pa.string()), ("likeness", pa.float64())]))


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and places: label, base, first and end word, edits, matched words, likeness."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for b in batches:
            got = [scanner.search(t) for t in b.column("t").to_pylist()]
            places = [[{"label": n.label, "base": n.base, "first": f, "end": e, "edits": x, "words": w.decode("utf-8", "replace"), "likeness": 1 - x / len(n.phrase)} for n, f, e, x, w in found] for _, found in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array(places, PLACES)], ["doc_id", "n_words", "places"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, places array<struct<label string, base boolean, first long, end long, edits int, words string, likeness double>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the numbered query from the operator's places."""
    exact = F.filter("places", lambda p: p["base"] & (p["edits"] == 0))
    firsts = F.transform(exact, lambda p: p["first"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["likeness"])), F.lit(0.0))
    return scanned.select("doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"), names(exact).alias("base_labels"), names(F.col("places")).alias("labels"), score.alias("score"))
