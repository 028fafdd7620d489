"""Column functions: set scores and metrics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets: 1 if both are empty, 0 if one is or nothing is shared."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def mention_recall(text: Column, marks: Column) -> Column:
    """The share of marks that the text holds; 1 without marks."""
    found = F.size(F.filter(marks, lambda m: F.contains(text, m)))
    return F.when(F.size(marks) == 0, 1.0).otherwise(F.try_divide(found, F.size(marks)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def routing_scores(picked: Column, target: Column) -> Column:
    """0.5 hit + 0.3 recall + 0.2 precision; 1 if both sets are empty, 0 if one is."""
    shared = F.size(F.array_intersect(picked, target))
    some = 0.5 * (shared > 0).cast("double") + 0.3 * F.try_divide(shared, F.size(target)) + 0.2 * F.try_divide(shared, F.size(picked))
    return F.when((F.size(picked) == 0) & (F.size(target) == 0), 1.0).when((F.size(picked) == 0) | (F.size(target) == 0), 0.0).otherwise(some)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of lower-cased alphanumeric words."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))
    return set_f1(words(a), words(b))


def label_pair_score(a: Column, b: Column, specific: dict[str, tuple[str, ...]], broad: dict[str, tuple[str, ...]], conflicts: list[tuple[str, str]]) -> Column:
    """Likeness of two labels: 1 if equal, else word F1, raised to 0.85 if one holds the other or both bear a specific
    term, to 0.7 if both bear a broad one; 0.45 at most if they name conflicting subtypes. A term is borne by its name
    or any of its patterns."""
    nothing = F.lit(False)

    def any_of(tests: list[Column]) -> Column:
        out = nothing
        for x in tests:
            out = out | x
        return out

    bears = lambda c, term, patterns: any_of([F.contains(c, F.lit(p)) for p in (term, *patterns)])
    both = lambda terms: any_of([bears(a, k, p) & bears(b, k, p) for k, p in terms.items()])
    has = lambda c, x: F.contains(c, F.lit(x))
    apart = any_of([has(a, x) & has(b, y) | has(a, y) & has(b, x) for x, y in conflicts])
    raised = F.when(both(specific), 0.85).when(both(broad), 0.7).otherwise(0.0)
    score = F.greatest(token_f1(a, b), F.when(F.contains(a, b) | F.contains(b, a), 0.85).otherwise(0.0), raised)
    return F.when(a == b, 1.0).otherwise(F.when(apart, F.least(score, F.lit(0.45))).otherwise(score))


def label_field_score(a: Column, b: Column, pair) -> Column:
    """Over two lists of labels: the best pair if either has one label, else the mean of both sides' best-match means.
    Two empty lists are alike (1), an empty and another one not (0)."""
    best = lambda x, y: F.transform(x, lambda e: F.array_max(F.transform(y, lambda o: pair(e, o))))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    one = F.array_max(best(a, b))
    cover = 0.5 * (mean(best(a, b)) + mean(best(b, a)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when((F.size(a) == 1) | (F.size(b) == 1), one).otherwise(cover)


def support_grounding(cited: Column, given: Column, text: Column) -> Column:
    """The share of what is cited that was given; without citations 0.25 for an answer with text, else 0."""
    cited = F.array_distinct(cited)
    none = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", 0.25).otherwise(0.0)
    return F.when(F.size(cited) == 0, none).otherwise(F.try_divide(F.size(F.array_intersect(cited, given)), F.size(cited)))


def evidence_alignment(support: Column, support_seen: Column, negative: Column, negative_seen: Column) -> Column:
    """0.9 of the F1 of supporting items and 0.1 of the F1 of negative ones."""
    return 0.9 * set_f1(support, support_seen) + 0.1 * set_f1(negative, negative_seen)


def semantic_field(expected: Column, observed: Column) -> Column:
    """1 if both are unknown or equal but for case and spaces, 0 if one is unknown, else the F1 of their words."""
    from rankforge.functions.parsing import is_unknown

    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    same = F.when(norm(expected) == norm(observed), 1.0).otherwise(token_f1(expected, observed))
    return F.when(is_unknown(expected) & is_unknown(observed), 1.0).when(is_unknown(expected) | is_unknown(observed), 0.0).otherwise(same)


def abstention(expected: Column, observed: Column) -> Column:
    """1 if both or neither abstain, 0.35 for a needless abstention, 0 for a missing one."""
    return F.when(expected == observed, 1.0).when(observed & ~expected, 0.35).otherwise(0.0)


def weighted_total(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * parts[name]
    return total


def result_record(df, want: str, got: str, made: str, given: str):
    """Adds exact (two missing labels match), made and grounded (repeats count), and their rate (null without any)."""
    grounded = F.size(F.filter(made, lambda g: F.array_contains(given, g)))
    out = df.withColumn("exact", F.col(want).eqNullSafe(F.col(got))).withColumn("grounded", grounded).withColumn("made", F.size(made))
    return out.withColumn("rate", F.try_divide("grounded", "made"))
