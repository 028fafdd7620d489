"""Queries of rule books: users as books, events as operations on their bullets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.operators import playbook
from rankforge.plans.registry import query, t
from rankforge.sources.scratch import new_path
from rankforge.streaming import playbook as stream

_K = "try_cast(get_json_object(props, '$.k') as bigint)"
_SECTION = "CASE WHEN value > 50 THEN 'Tips and tricks' ELSE 'facts' END"
_ROWS = f"""user_id AS book, event_id AS seq, event_id div 200 AS step, CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'error' THEN 'Remove' WHEN 'click' THEN 'TAG' ELSE 'update' END AS op, {_SECTION} AS section, CASE WHEN {_K} % 7 <> 0 THEN concat('c', event_id) END AS content,
  CASE WHEN event_type = 'signup' AND {_K} % 3 = 0 THEN NULL WHEN {_K} % 4 = 0 THEN concat(CASE WHEN value > 50 THEN 'tips' ELSE 'facts' END, '-0000', {_K} % 3 + 1) ELSE concat('s', {_K} % 5) END AS id,
  map('helpful', CASE WHEN {_K} % 2 = 0 THEN floor(value) END, 'harmful', CASE WHEN {_K} % 5 = 1 THEN {_K} END, 'neutral', CASE WHEN {_K} % 3 = 2 THEN 1L END, 'other', 5L) AS metadata"""
_SQL = f"""o0 AS (SELECT user_id AS book, event_id AS seq, event_id // 200 AS step, upper(CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'error' THEN 'Remove' WHEN 'click' THEN 'TAG' ELSE 'update' END) AS op, {_SECTION} AS section, value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events),
 o1 AS (SELECT *, CASE WHEN k % 7 <> 0 THEN 'c' || seq END AS content, CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN NULL WHEN k % 4 = 0 THEN CASE WHEN value > 50 THEN 'tips' ELSE 'facts' END || '-0000' || (k % 3 + 1) ELSE 's' || k % 5 END AS given,
   CASE WHEN k % 2 = 0 THEN floor(value)::BIGINT END AS helpful, CASE WHEN k % 5 = 1 THEN k END AS harmful, CASE WHEN k % 3 = 2 THEN 1::BIGINT END AS neutral FROM o0),
 o AS (SELECT *, CASE WHEN op = 'ADD' AND given IS NULL THEN lower(string_split(section, ' ')[1]) || '-' || lpad((count(*) FILTER (op = 'ADD' AND given IS NULL) OVER (PARTITION BY book ORDER BY seq))::VARCHAR, 5, '0') ELSE given END AS id FROM o1),
 w AS (SELECT *, coalesce(max(seq) FILTER (op = 'ADD') OVER p > coalesce(max(seq) FILTER (op = 'REMOVE') OVER p, -1), false) AS live FROM o WINDOW p AS (PARTITION BY book, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 e AS (SELECT book, id, max(seq) FILTER (op = 'ADD') AS born FROM o WHERE id IS NOT NULL GROUP BY ALL HAVING max(seq) FILTER (op = 'ADD') > coalesce(max(seq) FILTER (op = 'REMOVE'), -1)),
 y AS (SELECT o.*, born FROM o JOIN e ON e.book = o.book AND e.id = o.id AND seq >= born),
 z AS (SELECT book, id, any_value(born) AS born, arg_max(section, seq) FILTER (op = 'ADD') AS section, arg_max(CASE WHEN op = 'ADD' THEN coalesce(content, '') ELSE content END, seq) FILTER (op = 'ADD' OR op = 'UPDATE' AND content IS NOT NULL) AS content,
   {', '.join(f"max(seq) FILTER (op = 'ADD' OR op = 'UPDATE' AND {c} IS NOT NULL) AS s_{c}, coalesce(arg_max(coalesce({c}, 0), seq) FILTER (op = 'ADD' OR op = 'UPDATE' AND {c} IS NOT NULL), 0) AS n_{c}" for c in playbook.TAGS)} FROM y GROUP BY ALL),
 b AS (SELECT z.book AS book, z.id AS id, any_value(z.section) AS section, any_value(z.content) AS content, {', '.join(f"(any_value(n_{c}) + coalesce(sum(y.{c}) FILTER (y.op = 'TAG' AND y.seq > s_{c}), 0))::BIGINT AS {c}" for c in playbook.TAGS)}, any_value(z.born) AS "at" FROM z JOIN y ON y.book = z.book AND y.id = z.id GROUP BY z.book, z.id)"""


def _ops(spark, d):
    return t(spark, d, "events").selectExpr(*_split(_ROWS))


def _split(columns: str) -> list[str]:
    """Select expressions by their commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def _log(spark, d):
    """The operations as a stream, drained to its end into this run's own folder."""
    source = spark.readStream.schema(t(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return stream.drain_by_kind(stream.book_stream(source.selectExpr(*_split(_ROWS))), new_path(spark, "books"), new_path(spark, "books-at"))


@query(f"WITH {_SQL} SELECT * FROM b")
def rule_books(spark, d):
    """The bullets that live after all operations, by grouped sums."""
    return playbook.books(_ops(spark, d))


@query(f"WITH {_SQL} SELECT * FROM b")
def rule_books_streamed(spark, d):
    """The same from the stream's end."""
    return stream.latest_bullets(_log(spark, d))


@query(f"WITH {_SQL} SELECT book, step, seq, op, id, op = 'ADD' OR op IN ('UPDATE', 'TAG', 'REMOVE') AND live AS done FROM w")
def rule_book_changes(spark, d):
    """The stream's log of changes: the id that each operation met, and whether it did anything."""
    return _log(spark, d).where("kind = 'change'").select("book", "step", "seq", "op", "id", "done")


@query(f"""WITH {_SQL}, c AS (SELECT book, step, seq, coalesce(sum(CASE WHEN op = 'ADD' AND NOT live THEN 1 WHEN op = 'REMOVE' AND live THEN -1 ELSE 0 END) OVER (PARTITION BY book ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM w)
  SELECT book, step, arg_min(n, seq)::BIGINT AS bullets FROM c GROUP BY ALL""")
def rule_book_snapshots(spark, d):
    """The stream's log of snapshots: how many bullets a book had before each step."""
    return _log(spark, d).where("kind = 'snapshot'").select("book", "step", "bullets")


@query(f"""WITH {_SQL}, s AS (SELECT book, section, string_agg('- [' || id || '] ' || content || ' (helpful=' || helpful || ', harmful=' || harmful || ', neutral=' || neutral || ')', chr(10) ORDER BY "at") AS lines FROM b GROUP BY ALL)
  SELECT book, string_agg('## ' || section || chr(10) || lines, chr(10) ORDER BY encode(section)) AS prompt FROM s GROUP BY 1""")
def rule_book_prompts(spark, d):
    return playbook.as_prompt(playbook.books(_ops(spark, d)))
