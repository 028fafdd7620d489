"""Personal data by fixed patterns and a semi-Markov conditional random field that finds what they miss.

The patterns (email, ip, card, phone) give the base spans, which always stay. The model scores whole candidate spans:
their shape, digit groups, checks (Luhn, address parts up to 255), separators, ends, and what stands around them;
transitions between neighbouring labels are learned with these. A segment has at most ``LONGEST`` tokens and ``REACH``
characters, so a dynamic program over (end, type) chooses boundaries and types jointly. Every segment of a type holds a
trigger (a digit, ``@`` or a written-out "at"), so texts are decoded in islands around triggers; tokens between islands
can only be outside and change nothing. Added are the model's spans that touch no base span.

Training is weak supervision: of at most ``per_kind`` texts a kind (and as many with digits but no such data) of up to
``max_chars`` characters (training only) the base spans are labels; copies in which spans are written another way
("name (at) host (dot) org", ``10[.]0[.]0[.]1``, dotted cards, phones without a plus) teach the variants, and copies
that fail the checks, dates, versions and plain numbers teach what is none.

Null and empty texts have no spans; very long texts are read whole, in time linear in their length; repeated rows and
those without an id are judged each; an empty table gives an empty result and further columns are not read, whatever
their names; where nothing can be learned only the base spans are found. Places are in code points, ends exclusive.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import held, smallest_hashes

KINDS = ("email", "ip", "card", "phone")
LONGEST, REACH, CACHE = 24, 64, 50_000
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[{<] ?at ?[)\]}>]|\bat\s+[\w-]*[^\W\d_][\w-]*(?:\s+dot\s|\.\w{2})", re.I)
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    at, last = t.find("@"), 0
    while at >= 0:
        a = at
        while a > last and t[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(t, at + 1) if a < at else None
        if m:
            yield a, m.end()
            last = m.end()
        at = t.find("@", max(last, at + 1))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(t)]
    for m in DOTTED.finditer(t):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in four):
                out.append((1, at, at + size))
            at += size + 1
    for m in CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(t):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append((3, *m.span()))
    return out


def kind_of(c: str) -> str:
    return "^" if not c else " " if c.isspace() else "9" if c in "0123456789" else "a" if c.isalpha() else c


def span_features(s: str) -> list[str]:
    """Of a whole candidate span, from its text alone."""
    exact = re.sub(r"[^\W\d_]+", "a", re.sub(r"\s", " ", re.sub(r"[0-9]", "9", s)))
    short = re.sub(r"9+", "9", exact)
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    out = ["c:" + short, f"n:{min(len(digits), 21)}", f"f:{kind_of(s[0])}", f"l:{kind_of(s[-1])}", "p:" + "".join(sorted(set(re.sub(r"[9a]", "", exact))))]
    if re.search(r"[^\W\d_]", s):
        low = s.lower()
        sign = "@" if "@" in s else next((x for x in ("(at)", "[at]", "{at}", "<at>") if x in low.replace(" ", "")), "at")
        parts = re.split(r"@|[(\[{<] ?at ?[)\]}>]|\bat\b", low)
        host = parts[-1].strip()
        labels = [x.strip() for x in re.split(r"\.|[(\[{<] ?dot ?[)\]}>]|\bdot\b", host)]
        out += ["mail", "at:" + sign, f"ats:{len(parts) - 1}", f"tld:{min(len(labels[-1]), 5)}{labels[-1].isalpha()}", f"labels:{min(len(labels), 5)}", f"odd:{any(not x or ' ' in x for x in labels)}", f"local:{' ' in parts[0].strip()}", "edge:" + short[:3]]
        return out
    if len(s) < 40:
        out.append("s:" + exact)
    out += ["number", "g:" + "-".join(map(str, map(len, groups))), f"groups:{min(len(groups), 8)}"]
    if 13 <= len(digits) <= 19:
        out.append(f"luhn:{luhn(digits)}:{len(digits) > 15}")
    if len(groups) == 4:
        out.append(f"parts:{all(int(g) < 256 for g in groups if len(g) < 9) and max(map(len, groups)) < 4}")
    return out


def before(t: str, a: int) -> list[str]:
    word = re.search(r"([^\W\d_]+)\W*$", t[max(0, a - 24) : a])
    return ["<" + kind_of(t[a - 1 : a] if a else ""), "w:" + (word[1].lower()[:12] if word else "")]


def after(t: str, b: int) -> list[str]:
    next_two = kind_of(t[b : b + 1]) + kind_of(t[b + 1 : b + 2])
    return [">" + next_two, ">1" + next_two[0]]


def islands(t: str, reach: int = REACH + 16) -> Iterator[tuple[int, int]]:
    """Parts of a text outside of which no segment of a type can reach; a smaller ``reach`` serves training alone."""
    begin = end = None
    for m in TRIGGER.finditer(t):
        a, b = m.start() - reach, m.end() + reach
        if end is not None and a <= end:
            end = b
        else:
            if begin is not None:
                yield max(0, begin), min(len(t), end)
            begin, end = a, b
    if begin is not None:
        yield max(0, begin), min(len(t), end)


def candidates(t: str, tokens: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(first token, end token) of the spans that may be of a type."""
    n = len(tokens)
    for i, (a, _, kind) in enumerate(tokens):
        if kind not in "9a+(":
            continue
        digits = letters = groups = 0
        at = dot = named = False
        for j in range(i, min(i + LONGEST, n)):
            x, y, k = tokens[j]
            if y - a > REACH or j > i and (x - tokens[j - 1][1] > 2 or "\n" in t[tokens[j - 1][1] : x]):
                break
            if k == "9":
                digits, groups = digits + y - x, groups + 1
            elif k == "a":
                letters += 1
                named |= at
                at |= j > i and t[x:y].lower() == "at"
                dot |= at and t[x:y].lower() == "dot"
            at |= k == "@"
            dot |= at and k == "."
            if not letters and (digits > 19 or k not in "9.-()+/[] ,"):
                if k != "@" and k not in "_%":
                    break
            if letters and not at and k not in "9a._%+-([{<":
                break
            if kind in "9a" and named and dot and k in "9a" or kind != "a" and not letters and not at and k == "9" and (digits >= 7 or groups >= 4):
                yield i, j + 1


def tokens_of(t: str, a: int, b: int) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), kind_of(m[0][0])) for m in TOKEN.finditer(t, a, b)]


def outside(t: str, token: tuple[int, int, str]) -> str:
    a, b, kind = token
    return f"o:{kind}{min(b - a, 20)}" if kind == "9" else "o:" + kind


class Model:
    """Weights (feature, kind) of spans, of outside tokens, and of transitions (label before, label; the last label is outside)."""

    def __init__(self, names: list[str], weights: np.ndarray, out: dict[str, float], trans: np.ndarray):
        self.names, self.weights, self.out, self.trans = names, weights, out, trans
        self.index = {x: i for i, x in enumerate(names)}
        self.shapes: dict[str, np.ndarray] = {}

    def total(self, features: list[str]) -> np.ndarray:
        return self.weights[[self.index[f] for f in features if f in self.index]].sum(0)

    def shape(self, s: str) -> np.ndarray:
        own = self.shapes.get(s)
        if own is None:
            own = self.total(span_features(s))
            if len(self.shapes) < CACHE:  # spans have at most REACH characters
                self.shapes[s] = own
        return own

    def decode(self, t: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """The best segmentation of an island: (kind, start, end) of its spans."""
        tokens = tokens_of(t, a, b)
        ending: dict[int, list[tuple[int, list[float]]]] = {}
        left, right = {}, {}  # what stands before a token, and after
        for i, j in candidates(t, tokens):
            x, y = tokens[i][0], tokens[j - 1][1]
            if i not in left:
                left[i] = self.total(before(t, x))
            if j not in right:
                right[j] = self.total(after(t, y))
            ending.setdefault(j, []).append((i, (self.shape(t[x:y]) + left[i] + right[j]).tolist()))
        if not ending:
            return []
        k, trans = len(KINDS), self.trans.tolist()
        best = [[-np.inf] * k + [0.0]]
        into: list[list[float]] = []  # the best way to a place with the transition to each label
        back: list[list[tuple[int, int]]] = [[(0, k)] * (k + 1)]
        for j in range(len(tokens) + 1):
            if j:
                row, ways = [-np.inf] * (k + 1), [(0, k)] * (k + 1)
                row[k] = into[j - 1][k][0] + self.out.get(outside(t, tokens[j - 1]), 0.0)
                ways[k] = (j - 1, into[j - 1][k][1])
                for i, s in ending.get(j, ()):
                    for y, v in enumerate(s):
                        if (v := v + into[i][y][0]) > row[y]:
                            row[y], ways[y] = v, (i, into[i][y][1])
                best.append(row)
                back.append(ways)
            into.append([max((best[j][p] + trans[p][y], p) for p in range(k + 1)) for y in range(k + 1)])
        j, y, out = len(tokens), int(np.argmax(best[-1])), []
        while j:
            i, p = back[j][y]
            if y < k:
                out.append((y, tokens[i][0], tokens[j - 1][1]))
            j, y = i, p
        return out[::-1]

    def added(self, t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The model's spans that touch no base span."""
        if not self.names:
            return []
        out = [x for a, b in islands(t) for x in self.decode(t, a, b)]
        if not out or not base:
            return out
        taken = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken])
        at = np.searchsorted(starts, [b for _, _, b in out])  # of the base spans that begin before the end, the furthest end
        return [x for x, i in zip(out, at, strict=True) if not i or reach[i - 1] <= x[1]]


def variants(kind: int, s: str, rng: np.random.Generator) -> str:
    """The same datum, written in a way that the fixed patterns miss."""
    digits = re.sub(r"[^0-9]", "", s)
    if kind == 0:
        local, host = s.split("@", 1)
        at = str(rng.choice([" (at) ", " [at] ", "(at)", "[at]", " at ", " @ ", " AT "]))
        dot = str(rng.choice([" (dot) ", "[dot]", " dot ", "(dot)"])) if at != " @ " else str(rng.choice([".", " . "]))
        return local + at + (host if rng.random() < 0.3 and at != " at " else host.replace(".", dot))
    if kind == 1:
        return s.replace(".", str(rng.choice(["[.]", " . ", "(.)"])))
    if kind == 2:
        sep = str(rng.choice([".", " - ", "  ", "/"]))
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    ten = digits[-10:]
    form = str(rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "{} {} {}", "001 {} {} {}", "1-{}-{}-{}"]))
    return form.format(ten[:3], ten[3:6], ten[6:])


def decoys(s: str, kind: int, rng: np.random.Generator) -> str:
    """A text that looks alike and is none."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = int(rng.integers(0, 7))
    if kind == 1 or pick == 0:
        return str(rng.choice([f"{n(1)}.{n(2)}.{n(1)}", f"{300 + int(n(2))}.{n(2)}.{n(3)}.{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}"]))
    if kind == 2 or pick == 1:
        digits = re.sub(r"[^0-9]", "", s) if kind == 2 else n(16)
        digits = digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(0, 9))) % 10)
        digits = digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return str(rng.choice([digits, " ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "-".join(digits[i : i + 4] for i in range(0, len(digits), 4)), ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]))
    return [f"20{n(2)}-{n(2)}-{n(2)} {n(2)}:{n(2)}:{n(2)}", n(int(rng.integers(7, 13))), f"{n(1)},{n(3)},{n(3)}.{n(2)}", f"{n(2)}/{n(2)}/20{n(2)}", f"{n(3)} {n(4)} {n(2)} {n(3)}", f"@{s[:3]}", f"20{n(2)}{n(2)}{n(2)}"][pick]


def examples(texts: list[str], seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Islands as (text, spans): as they are, in other writings, and with decoys in their place."""
    rng, out = np.random.default_rng(seed), []
    for t in texts:
        spans, last = [], 0
        for k, a, b in sorted(base_spans(t), key=lambda x: x[1]):  # of overlapping ones the first
            if a >= last:
                spans.append((k, a, b))
                last = b
        for a, b in itertools.islice(islands(t, 40), 40):  # of a text that is all numbers a part will do
            inside = [(k, x - a, y - a) for k, x, y in spans if x >= a and y <= b]
            if sum(1 for _, x, y in spans if y > a and x < b) == len(inside) and b - a < 260:
                out.append((t[a:b], inside))
                for make in (variants, variants, decoys) if inside else ():
                    text, made, at = "", [], 0
                    for k, x, y in inside:
                        s = t[a + x : a + y]
                        new = variants(k, s, rng) if make is variants else decoys(s, k, rng)
                        text += t[a + at : a + x]
                        if make is variants:
                            made.append((k, len(text), len(text) + len(new)))
                        text, at = text + new, y
                    out.append((text + t[a + at : b], made))
    return out


def fit(texts: list[str], steps: int = 60, seed: int = 0) -> Model:
    """Maximum likelihood by Adam over all islands at once, forward and backward by end places."""
    k = len(KINDS)
    empty = Model([], np.zeros((0, k)), {}, np.zeros((k + 1, k + 1)))
    rows, feats, outs, gold, n_tok = [], [], [], [], []
    for text, spans in examples(texts, seed):
        tokens = tokens_of(text, 0, len(text))
        found = list(candidates(text, tokens))
        place = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j in found}
        if not found or len(tokens) > 48 or any((a, b) not in place for _, a, b in spans):
            continue
        named = {place[a, b]: y for y, a, b in spans}
        isl = len(n_tok)
        n_tok.append(len(tokens))
        for i, j in found:
            rows.append((isl, i, j))
            a, b = tokens[i][0], tokens[j - 1][1]
            feats.append(span_features(text[a:b]) + before(text, a) + after(text, b))
            gold.append(named.get((i, j), -1))
        outs += [(isl, i, outside(text, x)) for i, x in enumerate(tokens)]
    if not rows or max(gold) < 0:
        return empty
    often = Counter(f for fs in feats for f in set(fs))
    names = sorted(f for f, n in often.items() if n > 2)
    index = {f: i for i, f in enumerate(names)}
    rows, gold = np.array(rows), np.array(gold)
    flat = np.concatenate([np.array([index[f] for f in fs if f in index], np.int64) for fs in feats])
    of = np.repeat(np.arange(len(feats)), [sum(f in index for f in fs) for fs in feats])
    kinds = sorted({x[2] for x in outs})
    o_isl, o_at = np.array([x[0] for x in outs]), np.array([x[1] for x in outs])
    o_id = np.array([kinds.index(x[2]) for x in outs])
    n, longest = len(n_tok), max(n_tok)
    last = np.array(n_tok)
    emit = np.zeros((n, longest + 1))
    by_end = [np.flatnonzero(rows[:, 2] == j) for j in range(longest + 1)]
    by_start = [np.flatnonzero(rows[:, 1] == j) for j in range(longest + 1)]
    # the true path: which tokens are outside, and its transitions
    cover = np.zeros((n, longest + 1), int) - 1
    ends_at = np.zeros((n, longest + 1), int) + k
    for (isl, i, j), y in zip(rows.tolist(), gold.tolist(), strict=True):
        if y >= 0:
            cover[isl, i:j] = y
            cover[isl, i] = y
            ends_at[isl, j] = y
    true_out = cover[o_isl, o_at] < 0
    true_trans = np.zeros((k + 1, k + 1))
    np.add.at(true_trans, (ends_at[o_isl[true_out], o_at[true_out]], k), 1)
    got = gold >= 0
    np.add.at(true_trans, (ends_at[rows[got, 0], rows[got, 1]], gold[got]), 1)
    W, O, T = np.zeros((len(names), k)), np.zeros(len(kinds)), np.zeros((k + 1, k + 1))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (W, O, T)]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    low = -1e30

    def add(to: np.ndarray, isl: np.ndarray, x: np.ndarray) -> None:
        """The log-sum of each island's rows; ``isl`` ascends."""
        first = np.flatnonzero(np.diff(isl, prepend=-1))
        top = np.maximum.reduceat(x, first)
        to[isl[first]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(first, len(isl))), axis=0)), first))

    for step in range(1, steps + 1):
        s = np.stack([np.bincount(of, W[flat, y], len(feats)) for y in range(k)], 1)
        emit[:] = 0
        emit[o_isl, o_at] = O[o_id]
        alpha, beta = np.full((n, longest + 1, k + 1), low), np.full((n, longest + 1, k + 1), low)
        into = np.full((n, longest + 1, k + 1), low)  # the sum over labels before, with the transition to each label
        alpha[:, 0, k] = 0
        for j in range(longest + 1):
            if j:
                alpha[:, j, k] = into[:, j - 1, k] + emit[:, j - 1]
                if len(e := by_end[j]):
                    add(alpha[:, j, :k], rows[e, 0], into[rows[e, 0], rows[e, 1], :k] + s[e])
            into[:, j] = lse(alpha[:, j, :, None] + T, 1)
        beta[np.arange(n), last] = 0
        follow = np.full((n, longest + 1, k + 1), low)  # what may follow with each next label
        for j in range(longest - 1, -1, -1):
            live = j < last
            follow[live, j, k] = beta[live, j + 1, k] + emit[live, j]
            if len(e := by_start[j]):
                add(follow[:, j, :k], rows[e, 0], beta[rows[e, 0], rows[e, 2], :k] + s[e])
            b = lse(T + follow[:, j, None, :], 2)
            beta[live, j] = b[live]
        z = lse(alpha[np.arange(n), last], 1)
        p = np.exp(np.minimum(0, into[rows[:, 0], rows[:, 1], :k] + s + beta[rows[:, 0], rows[:, 2], :k] - z[rows[:, 0], None]))
        po = np.exp(np.minimum(0, into[o_isl, o_at, k] + O[o_id] + beta[o_isl, o_at + 1, k] - z[o_isl]))
        pt = np.exp(np.minimum(0, alpha[:, :-1, :, None] + T + follow[:, :-1, None, :] - z[:, None, None, None])).sum((0, 1))
        d = p.copy()
        d[got, gold[got]] -= 1
        grads = (np.stack([np.bincount(flat, d[of, y], len(names)) for y in range(k)], 1) / n + 1e-4 * W, (np.bincount(o_id, po, len(kinds)) - np.bincount(o_id[true_out], minlength=len(kinds))) / n + 1e-4 * O, (pt - true_trans) / n + 1e-4 * T)
        for q, g, m in zip((W, O, T), grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            q -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Model(names, W, dict(zip(kinds, O.tolist(), strict=True)), T)


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", per_kind: int = 80, max_chars: int = 20_000) -> Model:
    """Learns from at most 5 * per_kind texts: those that look as if they held a kind, or digits alone."""
    rows = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= max_chars)).withColumn("h", F.xxhash64("t"))
    t = F.col("t")
    looks = F.when(t.rlike("[A-Za-z0-9]@[A-Za-z0-9-]+\\.[A-Za-z0-9]"), "email").when(t.rlike("\\+[0-9][ ().0-9-]{6,}"), "phone").when(t.rlike("[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]"), "ip")
    looks = looks.when(t.rlike("[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"), "card").when(t.rlike("[0-9]{2}"), "digits")
    seen = rows.withColumn("y", looks).where("y is not null")
    few = smallest_hashes(seen.select("h", "y").distinct(), "y", [F.col("h")], per_kind)
    got = seen.join(F.broadcast(few), ["h", "y"]).groupBy("y", "h").agg(F.first("t").alias("t")).orderBy("y", "h").collect()
    return fit([r["t"] for r in got])


def spans(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, array of (kind, start, end, base): a row's base spans and the model's, by kind, then start."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.out, model.trans))
    key = uuid.uuid4().hex

    def find(texts: pd.Series) -> pd.Series:
        m, out = held(key, lambda: Model(*shared.value)), []
        for t in texts:
            base = base_spans(t) if t and TRIGGER.search(t) else []
            more = m.added(t, base) if t else []
            both = sorted([(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in more])
            out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in both])
        return pd.Series(out, dtype=object)

    column = F.pandas_udf(find, "array<struct<kind string, start int, end int, base boolean>>")
    return docs.select(F.col(doc_id).alias("doc_id"), column(F.col(text)).alias("spans"))


def personal_data(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans, n_added."""
    found = spans(docs, model, doc_id=doc_id, text=text)
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: lambda s: s["base"] & (s["kind"] == k)
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias("n_" + k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def redacted(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, in which each part that spans cover is the name of its first span's kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.out, model.trans))
    key = uuid.uuid4().hex

    def mask(texts: pd.Series) -> pd.Series:
        m, out = held(key, lambda: Model(*shared.value)), []
        for t in texts:
            base = base_spans(t) if t else []
            at, parts = 0, []
            for k, a, b in sorted(base + (m.added(t, base) if t else []), key=lambda x: x[1]):
                if a >= at:
                    parts += [t[at:a], f"[{KINDS[k]}]"]
                at = max(at, b)
            out.append("".join(parts) + t[at:] if t else t)
        return pd.Series(out, dtype=object)

    return docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(mask, "string")(F.col(text)).alias("text"))
