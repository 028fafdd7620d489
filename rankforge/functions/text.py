"""Column functions: cleaning, parsing, rendering and hashing of texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Tokens that stand for a missing value.
NULL_TOKENS = ("", "na", "n/a", "nan", "none", "null", "unknown")


def strip(c: Column) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_value(c: Column) -> Column:
    """Stripped text; null where it stands for a missing value."""
    s = strip(c)
    return F.when(F.lower(s).isin(*NULL_TOKENS), None).otherwise(s)


def normalized_token(c: Column) -> Column:
    """Lower-cased, with runs of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def render_fields(fields: dict[str, Column]) -> Column:
    """KEY: value lines; an empty or missing value is 'none'."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(F.when(v != "", v), F.lit("none"))) for k, v in fields.items()])


def parse_field(c: Column, key: str) -> Column:
    """The value of the last 'KEY: value' line, whatever the key's case; null without one."""
    lines = F.filter(F.split(c, r"\R"), lambda x: F.upper(F.trim(F.substring_index(x, ":", 1))) == key.upper())
    lines = F.filter(lines, lambda x: F.instr(x, ":") > 0)
    last = F.try_element_at(lines, F.lit(-1))
    return F.trim(F.regexp_replace(last, "^[^:]*:", ""))


def hash_fraction(c: Column) -> Column:
    """SHA-256's first 12 hex digits as a fraction from 0 to 1."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 12), 16, 10).cast("double") / F.lit(281474976710655.0)


def hash_split(c: Column, train: float, validation: float) -> Column:
    f = hash_fraction(c)
    return F.when(f < train, "train").when(f < train + validation, "val").otherwise("test")


def stable_id(family: Column, split: Column, key: Column) -> Column:
    return F.concat_ws(":", family, split, F.substring(F.sha1(key), 1, 12))


def choice(seed: Column, n: int) -> Column:
    """A number under n by the seed's SHA-1."""
    return F.pmod(F.conv(F.substring(F.sha1(seed), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def symbol_mentions(c: Column) -> Column:
    """Distinct tokens of letters, digits, '-' of three characters or more with two capitals or a digit, sorted."""
    tokens = F.regexp_extract_all(c, F.lit("([A-Za-z0-9-]+)"))
    good = F.filter(tokens, lambda t: (F.length(t) >= 3) & ((F.length(F.regexp_replace(t, "[^A-Z]", "")) >= 2) | t.rlike("[0-9]")))
    return F.array_sort(F.array_distinct(good))


def strip_links(c: Column) -> Column:
    """Without URLs, Markdown links (their text stays) and repeated white space."""
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"https?://[^ \t\n\r)]+", ""), "[ \t\n\r]+", " "))
