"""Queries of parsing: answers, questions, labels, groups and nested values, each made from rows and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import parsing as ps, scores, text as tx
from rankforge.plans.registry import _LISTS, _lists, query, t

_ORDERS = """x AS (SELECT o_orderkey AS k, any_value(o_orderpriority) AS label, any_value(o_orderstatus) AS status,
    list_sort(list(DISTINCT 'P' || l_partkey) FILTER (l_returnflag = 'N')) AS kept, list_sort(list(DISTINCT 'P' || l_partkey) FILTER (l_returnflag = 'R')) AS back
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""


def _orders(spark, d):
    """An order's priority as its label, the parts of its open lines as evidence and of its returned ones as exclusions."""
    parts = lambda flag: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == flag, F.concat(F.lit("P"), F.col("l_partkey")))))
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_returnflag").groupBy("k").agg(parts("N").alias("kept"), parts("R").alias("back"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status")).join(lines, "k")


def _answer(x):
    return tx.render_fields({
        "LABEL": F.col("label"), "NEGATIVE_MARKERS": F.lit(None).cast("string"), "EVIDENCE": F.array_join("kept", ", "), "EXCLUSIONS": F.array_join("back", ", "),
        "CONTEXT": F.concat(F.lit("status="), "status"), "CONFIDENCE": F.lit("high"), "FINAL": F.col("label"),
    })


@query(f"WITH {_ORDERS} SELECT k, label, label AS final, array_to_string(coalesce(kept, []), '|') AS evidence, array_to_string(coalesce(back, []), '|') AS exclusions, 0 AS negative FROM x")
def structured_answers(spark, d):
    x = _orders(spark, d)
    a = x.select("k", ps.structured_answer(_answer(x), ("LABEL", "FINAL"), ("EVIDENCE", "EXCLUSIONS", "NEGATIVE_MARKERS")).alias("a"))
    return a.select("k", "a.label", "a.final", F.array_join("a.evidence", "|").alias("evidence"), F.array_join("a.exclusions", "|").alias("exclusions"), F.size("a.negative_markers").alias("negative"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN source END AS label FROM documents")
def strict_labels(spark, d):
    """Answers of four kinds, two of them without a value."""
    kind = F.col("doc_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("Some words\n  label:  "), "lang", F.lit("  \nmore"))).when(kind == 1, F.concat(F.lit("LABEL: "), "source")).when(kind == 2, F.lit("label:   \nend")).otherwise(F.col("text"))
    return t(spark, d, "documents").select("doc_id", ps.strict_field(answer, "label").alias("label"))


@query(f"WITH {_LISTS} SELECT l_suppkey, string_agg('P' || l_partkey, ' ' ORDER BY r) AS items FROM lists GROUP BY 1")
def question_items(spark, d):
    x = _lists(spark, d).withColumn("items", F.transform("genes", lambda g: F.concat(F.lit("P"), g)))
    question = F.concat(F.lit("Read this.\nCell sentence:\n"), F.array_join("items", " "), F.lit("\nQuestion: which label?"))
    return x.select("l_suppkey", F.array_join(ps.question_items(question, "Cell sentence:", ("Question:", "The label")), " ").alias("items"))


@query(f"WITH {_LISTS} SELECT l_suppkey, 2 AS profiles, string_agg('P' || l_partkey, ' ' ORDER BY r) FILTER (r <= 7) AS first, string_agg('P' || l_partkey, ' ' ORDER BY r) FILTER (r > 7) AS second FROM lists GROUP BY 1")
def question_profiles(spark, d):
    """Two ranked lists of a question by their profiles; a third that repeats a profile does not count."""
    x = _lists(spark, d).withColumn("items", F.transform("genes", lambda g: F.concat(F.lit("P"), g)))
    part = lambda a, b: F.array_join(F.slice("items", a, b), ", ")
    question = F.concat(F.lit("Compare.\nProfile A 1: "), part(1, 7), F.lit(".\nprofile B: "), part(8, 100), F.lit(";\nPROFILE  b: none\nend"))
    x = x.select("l_suppkey", ps.ranked_lists(question).alias("m"))
    return x.select("l_suppkey", F.size("m").alias("profiles"), F.array_join(F.col("m")["profilea1"], " ").alias("first"), F.array_join(F.col("m")["profileb"], " ").alias("second"))


@query("SELECT p_partkey, array_to_string(CASE WHEN lower(p_type) = lower(split_part(p_name, ' ', 1)) THEN [upper(p_type)] ELSE [upper(p_type), upper(split_part(p_name, ' ', 1))] END, ',') AS markers FROM part")
def marker_sets(spark, d):
    listed = F.concat(F.lit(" ; "), "p_type", F.lit(", none,"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" ;"), F.lower("p_type"))
    return t(spark, d, "part").select("p_partkey", F.array_join(ps.marker_set(listed), ",").alias("markers"))


_SAID = """x AS (SELECT p_partkey, p_name, p_size, 'Made by ' || p_brand || ' for ' || p_type || chr(10) || 'It holds (so [far]).' || CASE p_size % 8 WHEN 0 THEN ' Therefore, this cell is a ' || p_name || '.' WHEN 1 THEN ' OVERALL, THIS CELL IS ' || upper(p_name)
    WHEN 2 THEN ' Overall, this cell is an ' || p_name || '. therefore, this cell is ' || p_name || '.' WHEN 3 THEN ' This is a ' || p_name || '.' WHEN 4 THEN ' Therefore, this cell is a ' || p_name || '! ' WHEN 5 THEN ' Therefore, this cell is ' || p_type || '.' WHEN 6 THEN ' Therefore, this cell is ' || p_name || '. Overall, this cell is ' || p_name || '.' ELSE '' END AS said FROM part)"""


@query(f"""WITH {_SAID}, y AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(said, '\\s*Therefore, this cell is an? ' || p_name || '\\.?$', '', 'i'), '\\s*Therefore, this cell is ' || p_name || '\\.?$', '', 'i'),
    '\\s*Overall, this cell is an? ' || p_name || '\\.?$', '', 'i'), '\\s*Overall, this cell is ' || p_name || '\\.?$', '', 'i') AS cut FROM x)
  SELECT p_partkey, trim(cut, ' ' || chr(10)) AS text FROM y""")
def cleaned_answers(spark, d):
    """Texts of parts with several last sentences, some of which only say the name."""
    name, n = F.col("p_name"), F.col("p_size") % 8
    last = F.when(n == 0, F.concat(F.lit(" Therefore, this cell is a "), name, F.lit("."))).when(n == 1, F.concat(F.lit(" OVERALL, THIS CELL IS "), F.upper(name))).when(n == 2, F.concat(F.lit(" Overall, this cell is an "), name, F.lit(". therefore, this cell is "), name, F.lit(".")))
    last = last.when(n == 3, F.concat(F.lit(" This is a "), name, F.lit("."))).when(n == 4, F.concat(F.lit(" Therefore, this cell is a "), name, F.lit("! "))).when(n == 5, F.concat(F.lit(" Therefore, this cell is "), "p_type", F.lit("."))).when(n == 6, F.concat(F.lit(" Therefore, this cell is "), name, F.lit(". Overall, this cell is "), name, F.lit("."))).otherwise(F.lit(""))
    said = F.concat(F.lit("Made by "), "p_brand", F.lit(" for "), "p_type", F.lit("\nIt holds (so [far])."), last)
    return t(spark, d, "part").select("p_partkey", ps.without_label_sentence(said, name).alias("text"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE NOT contains(text, chr(13)))
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT (starts_with(trim(l, ' ' || chr(9)), 'The') OR starts_with(trim(l, ' ' || chr(9)), 'La '))), ''), '^\\s+', ''), '\\s+$', '') AS kept FROM l GROUP BY 1""")
def lines_without(spark, d):
    """Documents without the lines that begin with one of two words."""
    x = t(spark, d, "documents").where(~F.contains("text", F.lit("\r")))
    return x.select("doc_id", ps.without_lines(F.col("text"), ("The", "La ")).alias("kept"))


@query("""SELECT doc_id, coalesce(x = '' OR x[1] IN ('{', '[') OR contains(lower(x), 'http://') OR contains(lower(x), 'https://') OR contains(lower(x), 'raw_gpt_output') OR len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) < 12, true) AS malformed
  FROM (SELECT doc_id, CASE WHEN source = 'src3' THEN NULL WHEN source = 'src5' THEN '[' || text WHEN source = 'src7' THEN text || ' RAW_GPT_output' ELSE text END AS x FROM documents)""")
def malformed_texts(spark, d):
    """Documents as answers: null ones, lists, raw output, links and short ones are malformed."""
    x = F.when(F.col("source") == "src5", F.concat(F.lit("["), "text")).when(F.col("source") == "src7", F.concat("text", F.lit(" RAW_GPT_output"))).when(F.col("source") != "src3", F.col("text"))
    return t(spark, d, "documents").select("doc_id", ps.malformed(x).alias("malformed"))


_REWRITES = ((r"\bwidget\b", "gadget"), (r"\bgadget positive\b", "plus gadget"))
_CANON = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), '^most likely identity:\\s*', ''), '^most likely cell identity:\\s*', ''), '^predicted label:\\s*', ''),
  '\\([^)]*\\)', ' ', 'g'), '\\+', ' positive ', 'g'), '[/,]', ' ', 'g'), '\\bwidget\\b', 'gadget', 'g'), '\\bgadget positive\\b', 'plus gadget', 'g'), '\\bcell type\\b', 'cell', 'g'), '\\s+', ' ', 'g'), ' ;:,.')"""
_NAMED = """x AS (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Predicted label: ' || upper(replace(p_name, ' ', '/')) || '+ (of one kind),' WHEN 2 THEN 'Cell A1: ' || p_name || ' -- as ' || p_type || '; profile b : kind: ' || p_type || ';; ' || p_name
    WHEN 3 THEN 'b2: ' || p_name || chr(10) || 'B3 : ' || p_name || ' cell type' WHEN 4 THEN ' n/a ; ;' WHEN 5 THEN '(none)' WHEN 6 THEN 'Profile of A: ' || p_name || ';Most likely identity: Predicted label: ' || p_name WHEN 7 THEN 'cell 3:: ' || p_name || ': sub: ' || p_type ELSE p_name || ' --' || p_type || ' -- x -- y' END AS said FROM part)"""


@query(f"""WITH {_NAMED}, p AS (SELECT p_partkey, i, s FROM (SELECT p_partkey, unnest(regexp_split_to_array(said, '[;\\n]')) AS s, generate_subscripts(regexp_split_to_array(said, '[;\\n]'), 1) AS i FROM x)),
  c AS (SELECT *, string_split(regexp_replace(regexp_replace(s, '^\\s*(?:cell|profile)\\s+[a-z0-9]+\\s*:\\s*', '', 'i'), '^\\s*[a-z0-9]+\\s*:\\s*', '', 'i'), ' -- ')[1] AS cut, regexp_matches(s, '^\\s*(?:cell|profile)\\s+[a-z0-9]+\\s*:', 'i') AS named FROM p),
  k AS (SELECT p_partkey, i, {_CANON.format("CASE WHEN named AND contains(cut, ': ') THEN substr(cut, strpos(cut, ': ') + 2) ELSE cut END")} AS v FROM c), f AS (SELECT p_partkey, v, min(i) AS i FROM k WHERE v <> '' GROUP BY ALL), g AS (SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS vs FROM f GROUP BY 1)
  SELECT p_partkey, {_CANON.format('said')} AS label, CASE WHEN trim(lower(said)) IN ('', 'unknown', 'n/a', 'none') THEN '' ELSE coalesce(vs, {_CANON.format('said')}) END AS candidates FROM x LEFT JOIN g USING (p_partkey)""")
def canonical_labels(spark, d):
    """Labels and lists of labels with introductions, names of profiles, remarks and words for 'not known'."""
    n, name, kind = F.col("p_size") % 9, F.col("p_name"), F.col("p_type")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = ("Unknown",), ("Predicted label: ", F.upper(F.replace(name, F.lit(" "), F.lit("/"))), "+ (of one kind),"), ("Cell A1: ", name, " -- as ", kind, "; profile b : kind: ", kind, ";; ", name), ("b2: ", name, "\nB3 : ", name, " cell type"), (" n/a ; ;",), ("(none)",), ("Profile of A: ", name, ";Most likely identity: Predicted label: ", name), ("cell 3:: ", name, ": sub: ", kind), (name, " --", kind, " -- x -- y")
    said = F.coalesce(*[F.when(n == i, text(*f)) for i, f in enumerate(forms)])
    return t(spark, d, "part").select("p_partkey", ps.canonical_label(said, _REWRITES).alias("label"), F.array_join(ps.label_candidates(said, _REWRITES), "|").alias("candidates"))


_OPTIONS = ("idiot", "THE  of", "", "und", " Que", "der", "zz")
_PLAIN = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS x, {_PLAIN.format('text')} AS p FROM documents), o AS (SELECT doc_id, i, o, strpos(x, o) AS held, CASE WHEN {_PLAIN.format('o')} <> '' THEN strpos(p, {_PLAIN.format('o')}) ELSE 0 END AS place FROM d, (SELECT unnest({list(_OPTIONS)}) AS o, unnest(range({len(_OPTIONS)})) AS i))
  SELECT doc_id, arg_min(o, place * 100 + i) FILTER (place > 0) AS first, coalesce(string_agg(o, ',' ORDER BY i) FILTER (held > 0 AND o <> ''), '') AS every FROM o GROUP BY 1""")
def options_in_text(spark, d):
    """The option that a document names first, one of them empty, and all that it holds letter by letter."""
    options = F.array(*map(F.lit, _OPTIONS))
    some = F.filter(options, lambda o: o != "")
    return t(spark, d, "documents").select("doc_id", ps.first_mentioned(F.col("text"), options).alias("first"), F.array_join(ps.mentioned(F.lower("text"), some), ",").alias("every"))


_CONFIDENCE = (("low", ("idiot", "der")), ("moderate", ("license", "und")), ("high", ("the", "que")))
_WORD = lambda w: f"contains(' ' || p || ' ', ' {w} ')"
_PART = lambda w: f"contains(p, '{w}')"


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN contains(p, 'email') AND ({' OR '.join(map(_PART, ws))}) THEN '{k}'" for k, ws in _CONFIDENCE)} {' '.join(f"WHEN {' OR '.join(map(_WORD, ws))} THEN '{k}'" for k, ws in _CONFIDENCE)} ELSE '' END AS confidence,
  regexp_matches(lower(text), '\\b(the|la) [a-z]+ of\\b|email') AND source <> 'src1' AS unfair FROM (SELECT *, {_PLAIN.format('text')} AS p FROM documents)""")
def text_classes(spark, d):
    """A keyword class, parts of words only where the topic is named, and a guard of forbidden patterns with one source exempt."""
    unfair = F.lower("text").rlike(r"\b(the|la) [a-z]+ of\b|email") & (F.col("source") != "src1")
    return t(spark, d, "documents").select("doc_id", ps.by_keyword(F.col("text"), _CONFIDENCE, "", topic="email").alias("confidence"), unfair.alias("unfair"))


@query(f"""WITH {_LISTS}, x AS (SELECT l_suppkey, list('P' || l_partkey ORDER BY r) FILTER (r <= l_suppkey % 4) AS p, ('0x' || substr(sha1(l_suppkey::varchar), 1, 8))::bigint % 3 AS k FROM lists GROUP BY 1),
  y AS (SELECT *, CASE coalesce(len(p), 0) WHEN 0 THEN '' WHEN 1 THEN p[1] ELSE array_to_string(p[:-2], ', ') || ' and ' || p[-1] END AS s FROM x)
  SELECT l_suppkey, CASE k WHEN 0 THEN 'Which label has ' || s || '?' WHEN 1 THEN s || ': of supplier ' || l_suppkey || '?' ELSE 'Name it.' END AS question FROM y""")
def rendered_questions(spark, d):
    x = _lists(spark, d).withColumn("some", F.slice(F.transform("genes", lambda g: F.concat(F.lit("P"), g)), F.lit(1), (F.col("l_suppkey") % 4).cast("int")))
    forms = ("Which label has {items}?", "{items}: of supplier {who}?", "Name it.")
    key = F.col("l_suppkey").cast("string")
    return x.select("l_suppkey", ps.from_template(forms, key, {"items": ps.prose(F.col("some")), "who": key}).alias("question"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'lang=' || lang || '|source=' || source WHEN doc_id % 3 = 1 THEN 'source:' || source
  WHEN doc_id % 2 = 0 THEN 'sample_prefix:' || source || '_' || lang ELSE 'sample:' || doc_id END AS g FROM documents""")
def group_resolution(spark, d):
    k = F.col("doc_id")
    sample = F.when(k % 2 == 0, F.concat(F.lit("set:"), "source", F.lit("_"), "lang", F.lit("_"), k.cast("string"))).otherwise(k.cast("string"))
    values = {"lang": F.when(k % 3 == 0, F.col("lang")).otherwise(F.lit("NaN")), "source": F.when(k % 3 < 2, F.concat(F.lit(" "), "source"))}
    return t(spark, d, "documents").select("doc_id", ps.resolve_group(values, sample).alias("g"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k')::bigint END AS k,
  CASE WHEN event_id % 4 = 3 THEN 0 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS known FROM events""")
def json_payloads(spark, d):
    """Objects between other words, with single quotes, or broken; known whole-number fields are kept."""
    kind = F.col("event_id") % 4
    k = F.get_json_object("props", "$.k")
    said = F.when(kind == 0, F.concat(F.lit('```json\n{"helpful": 3, "k": '), k, F.lit("}\n``` done"))).when(kind == 1, F.concat(F.lit("{'k': "), k, F.lit(", 'bogus': 9}")))
    said = said.when(kind == 2, F.concat(F.lit('see {"k": "'), k, F.lit('", "harmful": 1, "neutral": "x"}'))).otherwise(F.lit("{broken"))
    m = ps.int_fields(ps.json_payload(said), ("helpful", "harmful", "neutral", "k"))
    return t(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.size("m").alias("known"))


@query("""SELECT doc_id, '$.a.lang' AS path FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, '$.b[1]' FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, '$.c' FROM documents WHERE n_chars < 500
  UNION ALL SELECT doc_id, '$.a.deep[0].x.y[2]' FROM documents WHERE lang = 'de' AND n_chars > 1000 UNION ALL SELECT doc_id, '$.a.deep[0].x.y[0].z' FROM documents WHERE lang = 'es'""")
def unknown_paths(spark, d):
    """The paths of a nested object whose value is 'unknown', from the first level to the sixth."""
    say = lambda when, c: F.when(when, " Unknown ").otherwise(c)
    lang, size = F.col("lang"), F.col("n_chars")
    deep = F.array(F.struct(F.struct(F.array(F.struct(say(lang == "es", lang).alias("z")).cast("struct<z: string>"), F.struct(F.lit("known").alias("z"))).alias("y")).alias("x")))
    doc = F.struct(F.struct(say(lang == "fr", lang).alias("lang"), F.lit(1).alias("n"), deep.alias("deep")).alias("a"), F.array(F.lit("x"), say(F.col("source") == "src1", F.col("source"))).alias("b"), say(size < 500, F.lit("y")).alias("c"))
    text = F.to_json(doc)
    text = F.when((lang == "de") & (size > 1000), F.regexp_replace(text, r'\{"z":"known"\}', '{"z":"known"},"UNKNOWN"')).otherwise(text)
    return ps.unknown_paths(t(spark, d, "documents").select("doc_id", F.parse_json(text).alias("v")), "doc_id", "v")


@query(f"WITH {_ORDERS} SELECT a.k, coalesce(a.kept, []) = coalesce(b.kept, []) AS same FROM x a JOIN x b ON b.k = a.k + 1")
def same_answers(spark, d):
    """Lists of parts compared whatever their order, case and spaces."""
    x = _orders(spark, d).select("k", "kept")
    after = x.select((F.col("k") - 1).alias("k"), F.transform(F.reverse("kept"), lambda v: F.concat(F.lit(" "), F.lower(v))).alias("other"))
    return x.join(after, "k").select("k", ps.same_values(F.col("kept"), F.col("other")).alias("same"))


@query("SELECT event_id, event_type = 'view' AS yes, printf('%+.3f', value - 50) AS signed, CASE WHEN event_type <> 'click' THEN printf('%.3f', value) END AS plain, event_type IN ('error', 'signup') AS unknown FROM events")
def parsed_values(spark, d):
    said = F.when(F.col("event_type") == "view", F.lit(" Yes ")).when(F.col("event_type") == "click", F.lit(None)).otherwise(F.lit("2"))
    missing = F.when(F.col("event_type") == "error", F.lit(" N/A")).when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.lit("x"))
    plain = F.when(F.col("event_type") != "click", F.col("value"))
    return t(spark, d, "events").select("event_id", ps.parse_bool(said).alias("yes"), ps.format_number(F.col("value") - 50, True).alias("signed"), ps.format_number(plain).alias("plain"), ps.is_unknown(missing).alias("unknown"))


@query("""WITH p AS (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b, a.p_size % 5 AS u FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
  SELECT p_partkey, round_even(CASE WHEN u = 0 THEN 1.0 WHEN u = 1 THEN 0.0 WHEN a = b THEN 1.0 ELSE
    2.0 * len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / (len(list_distinct(string_split(a, ' '))) + len(list_distinct(string_split(b, ' ')))) END, 6)::double AS score FROM p""")
def semantic_scores(spark, d):
    """Fields that are both unknown (1), unknown on one side (0), equal (1), or scored by their words."""
    p = t(spark, d, "part").select("p_partkey", "p_name", (F.col("p_size") % 5).alias("u"))
    x = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    a = F.when(F.col("u") <= 1, F.lit("Unknown")).otherwise(F.col("p_name"))
    b = F.when(F.col("u") == 0, F.lit(None).cast("string")).otherwise(F.upper("b"))
    return x.select("p_partkey", F.bround(scores.semantic_field(a, b), 6).alias("score"))


@query(f"""WITH {_ORDERS}, y AS (SELECT a.k, a.label AS want, b.label AS got, a.kept AS given, b.kept AS made FROM x a JOIN x b ON b.k = a.k + 1)
  SELECT k, want = got AS exact, coalesce(len(made), 0) AS made, coalesce(len(list_intersect(made, given)), 0) AS grounded,
    round_even(len(list_intersect(made, given)) / nullif(len(made), 0), 6)::double AS rate FROM y""")
def result_records(spark, d):
    """An order's label and parts against the next one's as generated: matches, counts and a rate that can be null."""
    x = _orders(spark, d).select("k", "label", "kept")
    after = x.select((F.col("k") - 1).alias("k"), F.col("label").alias("got"), F.col("kept").alias("made"))
    return scores.result_record(x.join(after, "k"), "label", "got", "made", "kept").select("k", "exact", "made", "grounded", F.bround("rate", 6).alias("rate"))


_SHARES = {"label": 0.3, "routing": 0.2, "abstention": 0.1, "evidence": 0.2, "explanation": 0.1, "mentions": 0.1, "grounding": 0.05}


@query(f"""WITH {_ORDERS}, y AS (SELECT a.k, (a.label = b.label)::double AS label, coalesce(a.kept, []) AS t, coalesce(b.kept, []) AS p FROM x a JOIN x b ON b.k = a.k + 1),
  z AS (SELECT k, label, len(t) AS nt, len(p) AS np, len(list_intersect(t, p)) AS s FROM y),
  r AS (SELECT *, CASE WHEN nt = 0 AND np = 0 THEN 1.0 WHEN nt = 0 OR np = 0 THEN 0.0 ELSE 0.5 * (s > 0)::int + 0.3 * s / nt + 0.2 * s / np END AS routing,
    CASE WHEN nt = 0 AND np = 0 THEN 1.0 WHEN nt = 0 THEN 0.35 WHEN np = 0 THEN 0.0 ELSE 1.0 END AS abstention FROM z)
  SELECT k, round_even(routing, 6)::double AS routing, abstention::double AS abstention,
    round_even(0.3 * label + 0.2 * routing + 0.1 * abstention + 0.2 * routing + 0.1 * label + 0.1 * abstention + 0.05 * label, 6)::double AS total FROM r""")
def record_totals(spark, d):
    """Routing and abstention scores, and the weighted total of seven parts; the weights sum to 1.05, as they should."""
    x = _orders(spark, d).select("k", "label", "kept")
    x = x.join(x.select((F.col("k") - 1).alias("k"), F.col("label").alias("got"), F.col("kept").alias("picked")), "k")
    label = (F.col("label") == F.col("got")).cast("double")
    routing = scores.routing_scores(F.col("picked"), F.col("kept"))
    abstain = scores.abstention(F.size("picked") == 0, F.size("kept") == 0)
    parts = {"label": label, "routing": routing, "abstention": abstain, "evidence": routing, "explanation": label, "mentions": abstain, "grounding": label}
    return x.select("k", F.bround(routing, 6).alias("routing"), abstain.alias("abstention"), F.bround(scores.weighted_total(parts, _SHARES), 6).alias("total"))
