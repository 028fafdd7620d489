"""Exact token ids by the tokenizers library, word by word through caches that a Python worker keeps for a stage's tasks.

A byte-level BPE tokenizer merges only inside pre-tokens, and a space between two non-space characters always begins
a pre-token. So texts are cut there, each distinct piece is cut by the tokenizer's own pattern, and each distinct
pre-token is given to the tokenizer's BPE model once. Whatever leaves these assumptions (another kind of tokenizer,
special strings, scripts beyond U+052F, where Unicode versions may differ) goes to ``Tokenizer.encode`` whole.

Ids of many texts (``Codec.each``) are made in slices: the pattern's cuts are found for all bytes of a slice by array
comparisons, its distinct pre-tokens by Arrow's dictionary, and the ids are gathered from one array that holds those
of all cached pre-tokens, so Python handles a distinct pre-token of a slice, not a word.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from .common import held

#: The split pattern of byte-level BPE; a fixed value of the format.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Entries that a worker keeps of either cache; further ones are encoded each time they come.
CACHE = 500_000
#: Pre-tokens that a worker keeps for ``Codec.each`` (some 150 bytes each); further ones are encoded once a slice.
SLOTS = 1_000_000
#: Bytes of text that ``Codec.each`` takes at once (a longer text alone).
SLICE = 4 << 20
LETTER, NUMBER, OTHER, SPACE, END = range(5)


def _byte_chars() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(others)) for b in range(256)}


@cache
def _classes() -> np.ndarray:
    """The split pattern's class of each code point up to U+052F."""
    return np.array([LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else SPACE if regex.match(r"\s", c) else OTHER for c in map(chr, range(0x530))], np.uint8)


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the split pattern's pre-tokens begin in UTF-8 texts up to U+052F; a byte at each of ``ends`` closes a text and stands alone."""
    kind = _classes()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _classes()[(data[lead].astype(np.int32) & 31) << 6 | data[lead + 1] & 63]
    kind[ends] = END
    begins = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[ends] = True
    begins[ends[:-1] + 1] = True
    after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE)) + 1  # a word behind white space, whose last character stands apart
    last = data[after - 1]
    begins[after - 1 - ((last & 0xC0) == 0x80)] = True
    begins[after[last == 32]] = False  # a space joins the word
    q = np.flatnonzero(data[:-1] == 39)
    q = q[begins[q] & (kind[q + 1] == LETTER)]  # an apostrophe that a space joined, or that follows others, begins nothing
    if len(q):
        a, b = data[q + 1], data[np.minimum(q + 2, len(data) - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        begins[q[one | two] + 1] = False
        begins[q[one] + 2] = begins[q[two] + 3] = True
    return np.flatnonzero(begins)


class Codec:
    """value(ids) of whole texts, joined by ``join`` from those of pre-tokens: bytes of ids, or their number."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        self.fast = spec.get("normalizer") is None and spec.get("truncation") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.model, self.chars = self.whole.model, str.maketrans({chr(b): c for b, c in _byte_chars().items()})
        self.value, self.join = (len, sum) if kind == "count" else (lambda ids: np.array(ids, "<u4").tobytes(), b"".join)
        self.pre: dict = {}
        self.chunks: dict = {}
        self.slots: dict[bytes, int] = {}  # pre-token: its number k; its ids are flat[stops[k] : stops[k + 1]]
        self.stops, self.flat = array("q", [0]), array("I")

    def _encode(self, text: str):
        return self.value(self.whole.encode(text, add_special_tokens=False).ids)

    def pretokens(self, unit: str) -> list[str]:
        return BYTE_LEVEL.findall(unit)

    def pretoken(self, p: str):
        v = self.pre.get(p)
        if v is None:
            v = self.value([t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.chars))])
            if len(self.pre) < CACHE and len(p) < 60:
                self.pre[p] = v
        return v

    def _unit(self, unit: str):
        if not unit:
            return self.join([])
        if max(unit) >= "԰":
            return self._encode(unit)
        return self.join([self.pretoken(p) for p in self.pretokens(unit)])

    def text(self, text: str | None):
        if not text:
            return self.join([])
        if not self.fast or any(s in text for s in self.special):
            return self._encode(text)
        head, *rest = text.split(" ")
        values = list(map(self.chunks.get, rest))
        if head == "" or head[-1].isspace() or None in values and self._learn(rest, values):
            return self.join(map(self._unit, self._merged(head, rest)))
        return self.join([self._unit(head), *values])

    def _learn(self, rest: list, values: list) -> bool:
        """Fills in what the cache lacks; true if a space stands beside other white space, where cutting would be wrong."""
        for i, v in enumerate(values):
            if v is None:
                c = rest[i]
                if not c or c[0].isspace() or c[-1].isspace():
                    return True
                values[i] = v = self.chunks.get(c)
                if v is None:
                    values[i] = v = self._unit(" " + c)
                    if len(self.chunks) < CACHE and len(c) < 60:
                        self.chunks[c] = v
        return False

    def each(self, texts: list[bytes | None], end: bytes = b"") -> Iterator[memoryview | bytes]:
        """The bytes of each text's ids and of ``end``, an id or nothing; texts in UTF-8."""
        i = 0
        while i < len(texts):
            k, room = i, SLICE
            while k < len(texts) and (k == i or room >= len(texts[k] or b"")):
                room -= len(texts[k] or b"")
                k += 1
            yield from self._slice([t or b"" for t in texts[i:k]], end)
            i = k

    def _slice(self, texts: list[bytes], end: bytes) -> Iterator[memoryview | bytes]:
        if not self.fast:
            yield from (self._encode(t.decode()) + end for t in texts)
            return
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        joined = b"\0".join(texts) + b"\0"
        data = np.frombuffer(joined, np.uint8)
        high = np.flatnonzero(data >= 0xD4)
        high = high[(data[high] > 0xD4) | (data[np.minimum(high + 1, len(data) - 1)] >= 0xB0)]
        odd = set(np.unique(np.searchsorted(ends, high)).tolist())
        for s in map(str.encode, self.special):
            if s in joined:
                odd |= {i for i, t in enumerate(texts) if s in t}
        if odd:
            plain = self._slice([b"" if i in odd else t for i, t in enumerate(texts)], end)
            yield from (self.text(t.decode()) + end if i in odd else x for i, (t, x) in enumerate(zip(texts, plain, strict=True)))
            return
        begins = cuts(data, ends)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(joined)]).dictionary_encode()
        _, at, raw = found.dictionary.buffers()
        at, raw = np.frombuffer(at, np.int64, len(found.dictionary) + 1).tolist(), raw.to_pybytes()
        word = np.array(self._numbers([raw[a:z] for a, z in zip(at, at[1:])]))[found.indices.to_numpy()]
        ids, stops = self._gathered(word, np.searchsorted(begins, ends), end)
        n = len(self.slots)
        del self.stops[n + 1 :], self.flat[self.stops[n] :]  # what was encoded for this slice alone
        at = 0
        for z in stops.tolist():
            yield ids[4 * at : 4 * z]
            at = z

    def _numbers(self, pretokens: list[bytes]) -> list[int]:
        """The numbers of distinct pre-tokens; those without one are encoded."""
        out, once = list(map(self.slots.get, pretokens)), []
        for i in [i for i, k in enumerate(out) if k is None]:
            p = pretokens[i]
            if len(self.slots) < SLOTS and len(p) < 60:
                out[i] = self.slots[p] = self._numbered(p)
            else:
                once.append(i)
        for i in once:  # behind all that stay
            out[i] = self._numbered(pretokens[i])
        return out

    def _numbered(self, p: bytes) -> int:
        self.flat.extend([t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.chars))])
        self.stops.append(len(self.flat))
        return len(self.stops) - 2

    def _gathered(self, word: np.ndarray, closing: np.ndarray, end: bytes) -> tuple[memoryview, np.ndarray]:
        """The ids of numbered pre-tokens one after another, ``end`` for those at ``closing``, and where each of these ends."""
        stops, flat = np.frombuffer(self.stops, np.int64), np.frombuffer(self.flat or array("I", [0]), np.uint32)
        first = stops[word]
        size = stops[word + 1] - first
        first[closing], size[closing] = 0, len(end) // 4
        stop = np.cumsum(size)
        ids = flat[np.repeat(first - stop + size, size) + np.arange(stop[-1])]
        if end:
            ids[stop[closing] - 1] = int.from_bytes(end, "little")
        return memoryview(ids.astype("<u4", copy=False)).cast("B"), stop[closing]

    @staticmethod
    def _merged(head: str, rest: list):
        parts = [head]
        for c in rest:
            if not parts[-1] or parts[-1][-1].isspace() or not c or c[0].isspace():
                parts[-1] += " " + c
            else:
                parts.append(" " + c)
        return parts


class Pieces:
    """Token counts of a sentencepiece model by words.

    Where the model puts its word sign before every word, splits at white space and no piece spans words, a text of
    plain words is the sum of its words; whatever leaves that (other normalization, control signs, user-defined pieces
    in a word, scripts beyond U+024F) is encoded whole. ``fast`` is decided once from the model's own settings.
    """

    #: Words of these alone are left unchanged by the usual normalizations; a fixed choice.
    PLAIN = regex.compile(r"[A-Za-z0-9.,;:!?'\"()\-]+")

    def __init__(self, path: str):
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        sign = "▁"
        count = lambda t: len(self.whole.encode(t, num_threads=1))
        names = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        self.fast = not any(sign in x.lstrip(sign) for x in names) and count("a b") == count("a") + count("b") and count(" a") == count("a")
        self.pre: dict[str, int] = {}

    def pretokens(self, unit: str) -> list[str]:
        return unit.split(" ")

    def pretoken(self, p: str) -> int:
        v = self.pre.get(p)
        if v is None:
            v = len(self.whole.encode(p, num_threads=1))
            if len(self.pre) < CACHE and len(p) < 60:
                self.pre[p] = v
        return v

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if self.fast and all(map(self.PLAIN.fullmatch, words)):
            return sum(map(self.pretoken, words))
        return len(self.whole.encode(text, num_threads=1))


def codec(path: str, kind: str) -> Codec:
    """This worker's codec; its caches outlive a task and go with the stage."""
    return held((path, kind), lambda: Codec(path, kind))


def counter(path: str):
    """This worker's counter: a .json of the tokenizers library or a .model of sentencepiece."""
    if not path.endswith(".model"):
        return codec(path, "count")
    return held(path, lambda: Pieces(path))


def frequent(texts, path: str, most: int) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of some texts with their lengths in tokens."""
    c, n = counter(path), Counter()
    if not c.fast:
        return []
    for t in texts:
        n.update(c.pretokens(t or ""))
    plain = (lambda p: c.PLAIN.fullmatch(p)) if isinstance(c, Pieces) else (lambda p: max(p) < "԰")
    return [(p, c.pretoken(p)) for p, _ in n.most_common(most) if p and len(p) < 60 and plain(p)]
