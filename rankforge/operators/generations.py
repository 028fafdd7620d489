"""Checks of generated questions and answers against their own row's labels and markers.

Every row has a dictionary of its own: the ways to write its label, and its markers. Texts are normalised once a row
and searched for each of the row's few phrases as whole words, so no pattern is compiled for a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rankforge.operators.verifier import answer_fields, said, sure

EDGE = "\u0001"


def words_of(c: Column) -> Column:
    """Lower-cased runs of letters and digits with single spaces, one at either end too."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def label_variants(label: Column, others: Column, endings: tuple[tuple[str, tuple[str, ...]], ...] = ()) -> Column:
    """The ways to write a label: itself, ``others`` (canonical forms, aliases), and by endings that may be written otherwise; distinct, trimmed, none empty."""
    made = [F.when(F.endswith(label, F.lit(end)), F.concat(F.substring(label, F.lit(1), F.length(label) - len(end)), F.lit(new))) for end, news in endings for new in news]
    every = F.concat(F.array(label), F.coalesce(others, F.array().cast("array<string>")), F.array(*made).cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: sure(v != "")))


def says_any(text: Column, variants: Column) -> Column:
    """Whether the text holds one of the phrases, word for word."""
    x = words_of(text)
    return F.exists(variants, lambda v: (F.trim(words_of(v)) != "") & F.contains(x, words_of(v)))


def edged(c: Column) -> Column:
    """Upper case, with a sign at both ends of each run of letters and digits."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "([A-Z0-9]+)", f"{EDGE}$1{EDGE}")


def names_any(text: Column, markers: Column) -> Column:
    """Whether the text names one of the markers, in any case and not as part of a longer run; markers begin and end with a letter or digit."""
    x = edged(text)
    return F.exists(markers, lambda m: (m != "") & F.contains(x, edged(m)))


def label_text(answer: Column, keys: tuple[str, ...] = ("LABEL", "FINAL_LABEL", "CELL_TYPE", "FINAL_ANSWER")) -> Column:
    """The first of the keys that the answer gives a value, else the whole answer."""
    fields = answer_fields(answer)
    return F.coalesce(*[F.when(said(fields, k) != "", said(fields, k)) for k in keys], answer)


def generation_issues(question: Column, answer: Column, label: Column, variants: Column, allowed: dict[str, Column], used: dict[str, Column], place: Column, needs_place: Column) -> Column:
    """The codes of a generation's faults, in a fixed order; a marker that the answer lacks is named after its code.

    ``allowed`` and ``used`` hold ``evidence`` and ``negative`` lists. Null texts and lists are empty.
    """
    none = F.array().cast("array<string>")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    allowed, used = ({k: F.coalesce(v, none) for k, v in d.items()} for d in (allowed, used))
    markers = F.concat(used["evidence"], used["negative"])
    rules = {
        "missing_question": text(question) == "",
        "missing_answer": text(answer) == "",
        "question_leaks_label": says_any(question, variants),
        "question_names_marker": names_any(question, F.concat(allowed["evidence"], allowed["negative"])),
        "label_mismatch": (text(label) != "") & ~F.exists(variants, lambda v: (words_of(v) == words_of(label)) & (F.trim(words_of(v)) != "")),
        "answer_lacks_label": ~says_any(label_text(F.coalesce(answer, F.lit(""))), variants),
        "answer_lacks_place": sure(needs_place) & (text(place) != "") & ~F.contains(F.lower(text(answer)), F.lower(text(place))),
        "no_markers": F.size(markers) == 0,
        "unsupported_evidence": F.size(F.array_except(used["evidence"], allowed["evidence"])) > 0,
        "unsupported_negative": F.size(F.array_except(used["negative"], allowed["negative"])) > 0,
    }
    absent = F.filter(markers, lambda m: ~F.contains(F.lower(text(answer)), F.lower(m)))
    held = F.array_compact(F.array(*[F.when(sure(c), F.lit(n)) for n, c in rules.items()]))
    return F.concat(held, F.transform(absent, lambda m: F.concat(F.lit("not_in_text:"), m)))
