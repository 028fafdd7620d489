"""Column functions: parsers of answers, questions, labels and nested values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rankforge.functions.text import choice, parse_field, strip

#: Tokens that stand for "not known", and those that mean yes.
UNKNOWN = ("", "unknown", "n/a", "none")
TRUE = ("true", "1", "yes", "y")


def items(c: Column, separators: str = ",") -> Column:
    """Trimmed, non-empty parts of a list in text; 'none' is an empty list."""
    parts = F.filter(F.transform(F.split(c, f"[{separators}]"), strip), lambda x: (x != "") & (F.lower(x) != "none"))
    return F.coalesce(parts, F.array().cast("array<string>"))


def structured_answer(c: Column, single: tuple[str, ...], lists: tuple[str, ...]) -> Column:
    """A struct of an answer's fields: single values as they stand, list fields as arrays."""
    fields = [parse_field(c, k).alias(k.lower()) for k in single] + [items(parse_field(c, k)).alias(k.lower()) for k in lists]
    return F.struct(*fields)


def strict_field(c: Column, key: str) -> Column:
    """The value of the first 'key: value' line, whatever its case; null where there is none or it is empty."""
    found = F.regexp_extract(c, rf"(?im)^[ \t]*{key}[ \t]*:[ \t]*(\S[^\r\n]*?)[ \t]*$", 1)
    return F.when(found != "", found)


def answer_keys(c: Column) -> Column:
    """The upper-cased keys of all 'KEY: value' lines, in order."""
    lines = F.filter(F.split(c, r"\R"), lambda x: F.instr(x, ":") > 1)
    return F.transform(lines, lambda x: F.upper(F.trim(F.substring_index(x, ":", 1))))


def question_items(c: Column, marker: str, stops: tuple[str, ...]) -> Column:
    """The words between a marker and the first stop (or the end)."""
    ends = "|".join(rf"\n{s}" for s in stops)
    return F.filter(F.split(F.regexp_extract(c, rf"(?s){marker}\n?(.*?)(?:{ends}|$)", 1), r"\s+"), lambda x: x != "")


def tokens(c: Column, limit: int) -> Column:
    """Words by white space or commas, without '.' and ';' at their ends, at most ``limit``."""
    cut = F.transform(F.split(c, r"[\s,]+"), lambda x: F.regexp_replace(x, r"^[.;]+|[.;]+$", ""))
    return F.slice(F.filter(cut, lambda x: x != ""), 1, limit)


def profile_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


def ranked_lists(c: Column, limit: int = 200) -> Column:
    """A map from profile ids to their lists in 'Profile X: a, b, c' lines; of a repeated profile the first counts."""
    names = F.regexp_extract_all(c, F.lit(r"(?im)^(profile [^:\n]+):([^\n]*)"), 1)
    blobs = F.regexp_extract_all(c, F.lit(r"(?im)^(profile [^:\n]+):([^\n]*)"), 2)
    pairs = F.zip_with(names, blobs, lambda k, v: F.struct(profile_id(k).alias("k"), tokens(v, limit).alias("v")))
    first = F.filter(pairs, lambda x, i: F.size(F.filter(F.slice(pairs, 1, i), lambda y: y["k"] == x["k"])) == 0)
    return F.map_from_entries(first)


def marker_set(c: Column) -> Column:
    """The distinct upper-cased items of a comma or semicolon list, in order."""
    return F.array_distinct(F.transform(items(c, ",;"), F.upper))


def plain(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", " "))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def quoted(c: Column) -> Column:
    """A value as a pattern of itself."""
    return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}-])", r"\\$1")


def without_label_sentence(c: Column, label: Column, openers: tuple[str, ...] = ("Therefore, this cell is", "Overall, this cell is")) -> Column:
    """Without last sentences that only say the label after an opener, with or without an article, in any case.

    Each opener is looked for once with and once without the article, in turn. Where text or label is null or empty the
    text stays as it is.
    """
    out = c
    for opener in openers:
        for article in ("an? ", ""):
            out = F.regexp_replace(out, F.concat(F.lit(rf"(?iu)\s*{opener} {article}"), quoted(label), F.lit(r"\.?$")), F.lit(""))
    return F.when((c == "") | F.coalesce(label == "", F.lit(True)), c).otherwise(stripped(out))


def without_lines(c: Column, prefixes: tuple[str, ...]) -> Column:
    """Without the lines that start with one of the prefixes (white space before them aside); white space at the ends goes."""
    keep = lambda x: ~reduce(lambda a, b: a | b, [F.startswith(stripped(x), F.lit(p)) for p in prefixes])
    return stripped(F.array_join(F.filter(F.split(c, r"\R"), keep), "\n"))


def malformed(c: Column, marks: tuple[str, ...] = ("raw_gpt_output", "http://", "https://"), least: int = 12) -> Column:
    """Null or empty, begins as an object or a list, holds one of the marks in any case, or has under ``least`` words."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    marked = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(m)) for m in marks])
    return F.coalesce((c == "") | F.substring(c, 1, 1).isin("{", "[") | marked | (words < least), F.lit(True))


#: What may stand before a label, one after another.
INTRODUCTIONS = ("most likely identity:", "most likely cell identity:", "predicted label:")


def canonical_label(c: Column, replacements: tuple[tuple[str, str], ...], introductions: tuple[str, ...] = INTRODUCTIONS) -> Column:
    """A label in plain form: without introductions and parts in parentheses, signs as words or spaces, the caller's
    replacements in their order, and no punctuation at its ends."""
    table = [*((rf"^{x}\s*", "") for x in introductions), (r"\([^)]*\)", " "), (r"\+", " positive "), (r"[/,]", " "), *replacements, (r"\bcell type\b", "cell"), (r"\s+", " "), (r"^[ ;:,.]+|[ ;:,.]+$", "")]
    return reduce(lambda x, pair: F.regexp_replace(x, *pair), table, plain(c))


def label_candidates(c: Column, replacements: tuple[tuple[str, str], ...]) -> Column:
    """The distinct canonical labels of a list by ';' or lines; of a text without any the text's own label.

    Before a label may stand 'cell X:' or 'profile X:', then one word and a colon; after such a name only what follows
    the next ': ' counts. What follows ' -- ' is a remark. A text that says 'not known' has none.
    """
    name, word = r"(?i)^\s*(?:cell|profile)\s+[a-z0-9]+\s*:", r"(?i)^\s*[a-z0-9]+\s*:\s*"
    cut = lambda x: F.split(F.regexp_replace(F.regexp_replace(x, name + r"\s*", ""), word, ""), " -- ", 2)[0]
    after = lambda x: F.when(x.rlike(name) & F.contains(cut(x), F.lit(": ")), F.try_element_at(F.split(cut(x), ": ", 2), F.lit(2))).otherwise(cut(x))
    some = lambda xs: F.array_distinct(F.filter(xs, lambda x: x != ""))
    found = some(F.transform(F.split(c, r"[;\n]"), lambda x: canonical_label(after(x), replacements)))
    own = some(F.array(canonical_label(c, replacements)))
    return F.when(F.coalesce(plain(c).isin(*UNKNOWN), F.lit(True)), F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(own)


def mentioned(text: Column, options: Column) -> Column:
    """The options that the text holds, distinct, in their order."""
    return F.array_distinct(F.filter(options, lambda o: F.contains(text, o)))


def first_mentioned(text: Column, options: Column) -> Column:
    """The option whose first place in the text is the smallest, both in plain form; the earlier option on a tie, empty ones never."""
    x = plain(text)
    at = F.transform(options, lambda o, i: F.struct(F.when(plain(o) != "", F.instr(x, plain(o))).otherwise(0).alias("at"), i.alias("i"), o.alias("o")))
    return F.try_element_at(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), F.lit(1))["o"]


def by_keyword(c: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], otherwise: str, topic: str | None = None) -> Column:
    """The first class with a keyword as a word of the plain text; texts that name the topic count parts of words too, and first."""
    x, out = plain(c), F.lit(otherwise)
    any_of = lambda test, words: reduce(lambda a, b: a | b, map(test, words))
    for name, words in reversed(classes):
        out = F.when(any_of(lambda w: F.contains(F.concat(F.lit(" "), x, F.lit(" ")), F.lit(f" {w} ")), words), name).otherwise(out)
    for name, words in reversed(classes if topic else ()):
        out = F.when(F.contains(x, F.lit(topic)) & any_of(lambda w: F.contains(x, F.lit(w)), words), name).otherwise(out)
    return out


def unknown_paths(rows: DataFrame, key: str, value: str, words: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """(key, path): the paths of a variant column's strings that are one of the words, at any depth.

    One exploding step a level, each from the nested values that the last one left, written until none is left; the
    depth is that of the data, and no view stays in the session.
    """
    from rankforge.sources.scratch import new_path

    spark, out, level = rows.sparkSession, None, rows.select(key, F.lit("$").alias("path"), F.col(value).alias("v"))
    nested = lambda c: F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)")
    while True:
        named = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("name"), F.col("value").alias("inner")))
        step = F.when(F.col("name").isNotNull(), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        named = named.select(key, F.concat("path", step).alias("path"), F.col("inner").alias("v"))
        text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
        path = new_path(spark, "level")
        named.where(nested(F.col("v")) | F.lower(stripped(text)).isin(*words)).select(key, "path", F.to_json("v").alias("j")).write.parquet(path)
        done = spark.read.schema(f"{key} {dict(rows.dtypes)[key]}, path string, j string").parquet(path).withColumn("v", F.parse_json("j"))
        found = done.where(~nested(F.col("v"))).select(key, "path")
        out = found if out is None else out.unionByName(found)
        level = done.where(nested(F.col("v"))).select(key, "path", "v")
        if level.isEmpty():
            return out


def prose(values: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(values)
    many = F.concat_ws(" and ", F.array_join(F.slice(values, 1, F.greatest(n - 1, F.lit(1))), ", "), F.element_at(values, -1))
    return F.when(n == 0, "").when(n == 1, F.try_element_at(values, F.lit(1))).otherwise(many)


def from_template(templates: tuple[str, ...], seed: Column, values: dict[str, Column]) -> Column:
    """The template that the seed's hash picks, with {name} places filled."""
    x = F.element_at(F.array(*map(F.lit, templates)), choice(seed, len(templates)) + 1)
    for name, v in values.items():
        x = F.replace(x, F.lit("{" + name + "}"), v)
    return x


def group_of_sample(c: Column) -> Column:
    """What stands after the first ':' and before the last '_'; null without both."""
    g = F.regexp_extract(c, r"^[^:]*:(.*)_[^_]*$", 1)
    return F.when(g != "", g)


def resolve_group(values: dict[str, Column], sample: Column) -> Column:
    """'key:value' of a single known key, 'k=v|k2=v2' of several, else the sample's own group or the sample itself."""
    known = {k: F.when(F.lower(F.trim(v)).isin("", "none", "nan"), None).otherwise(F.trim(v)) for k, v in values.items()}
    n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in known.values()])
    one = F.coalesce(*[F.concat(F.lit(f"{k}:"), v) for k, v in known.items()])
    several = F.concat_ws("|", *[F.concat(F.lit(f"{k}="), v) for k, v in known.items()])
    prefix = F.concat(F.lit("sample_prefix:"), group_of_sample(sample))
    return F.when(n == 1, one).when(n > 1, several).otherwise(F.coalesce(prefix, F.concat(F.lit("sample:"), sample)))


def json_payload(c: Column) -> Column:
    """From the first '{' to the last '}', as text; null if that is no JSON. Single quotes are tried as double ones."""
    cut = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    fixed = F.replace(cut, F.lit("'"), F.lit('"'))
    return F.when(F.try_parse_json(cut).isNotNull() & (cut != ""), cut).when(F.try_parse_json(fixed).isNotNull() & (fixed != ""), fixed)


def int_fields(c: Column, keys: tuple[str, ...]) -> Column:
    """A map of the known keys of a JSON object whose values are whole numbers, as numbers or in text."""
    entries = [F.struct(F.lit(k).alias("k"), F.get_json_object(c, f"$.{k}").try_cast("long").alias("v")) for k in keys]
    return F.map_from_entries(F.filter(F.array(*entries), lambda x: x["v"].isNotNull()))


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*TRUE), F.lit(False))


def is_unknown(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit("")).isin(*UNKNOWN)


def format_number(c: Column, signed: bool = False) -> Column:
    return F.when(c.isNotNull(), F.format_string("%+.3f" if signed else "%.3f", c))


def same_values(a: Column, b: Column) -> Column:
    """Equal lists of texts whatever their order, case and outer spaces."""
    norm = lambda x: F.array_sort(F.transform(x, lambda v: F.lower(strip(v))))
    return norm(a) == norm(b)


def schema_errors(c: Column, texts: tuple[str, ...], lists: dict[str, str]) -> Column:
    """What a JSON object lacks of its schema: text keys that are missing or empty, list keys (with their codes) that are no list."""
    v = F.try_parse_json(c)
    value = lambda k: F.get_json_object(c, f"$.{k}")
    tests = [F.when(value(k).isNull(), F.lit(f"missing:{k}")).when(strip(value(k)) == "", F.lit(f"empty:{k}")) for k in texts]
    tests += [F.when(~F.coalesce(F.startswith(value(k), F.lit("[")), F.lit(False)), F.lit(code)) for k, code in lists.items()]
    return F.when(v.isNull(), F.array(F.lit("not_json"))).otherwise(F.array_compact(F.array(*tests)))
