"""Registered queries, part 2: conversation context (V) and analysis documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.functions import text as tx
from tabsight.operators import conversation as cv
from tabsight.operators import ledger as lg
from tabsight.plans import fixtures as fx
from tabsight.plans.catalog import register
from tabsight.plans.fixtures import load

STRIP = "strip_ws({x})"
NOISE = ("coalesce(contains(text, '> Dataset mounted') OR contains(text, '> Analysis complete') "
         "OR contains(text, 'PIPELINE CRASHED'), false)")


def _context_sql(src: str) -> str:
    """V1-V6 over ``src`` (conv_id, turn, role, text) -> CTE chain ending in ``ctx``."""
    content = STRIP.format(x="split_part(coalesce(text, ''), '```', 1)")
    return f"""
last4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {src} s) WHERE rn <= 4),
kept AS (SELECT conv_id, turn, CASE WHEN coalesce(role, 'user') = 'user' THEN 'user' ELSE 'assistant' END AS role,
                left({content}, 1000) AS content
         FROM last4 WHERE NOT {NOISE}),
ne AS (SELECT * FROM kept WHERE content <> ''),
st AS (SELECT * FROM (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM ne) WHERE seen = 1),
isl AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS nw FROM st),
isl2 AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mi FROM isl),
ctx AS (SELECT conv_id, mi::BIGINT AS msg_index, any_value(role) AS role,
               string_agg(content, chr(10) || chr(10) ORDER BY turn) AS content FROM isl2 GROUP BY conv_id, mi)"""


SPLIT_SQL = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS prn FROM {fx.NOISY_HISTORY_SQL} n),
hist AS (SELECT conv_id, turn, role, text FROM ranked WHERE prn > 1),
p AS (SELECT conv_id, text AS prompt FROM ranked WHERE prn = 1)"""


@register("context_window", f"WITH {_context_sql(fx.NOISY_HISTORY_SQL)}\nSELECT * FROM ctx")
def q_context_window(spark, sf_dir):
    """V1-V6: last 4 messages, noise dropped, roles normalised, content cleaned, leading
    assistant turns dropped, consecutive same-role turns merged, for every conversation."""
    return cv.context_window(fx.noisy_history(spark, sf_dir))


@register("append_command", f"""WITH {SPLIT_SQL}, {_context_sql('hist')},
lst AS (SELECT conv_id, max(msg_index) AS li, arg_max(role, msg_index) AS lr FROM ctx GROUP BY conv_id)
SELECT c.conv_id, c.msg_index, c.role,
       CASE WHEN c.msg_index = l.li AND l.lr = 'user' THEN c.content || chr(10) || chr(10) || 'NEW COMMAND: ' || p.prompt
            ELSE c.content END AS content
FROM ctx c JOIN lst l USING (conv_id) JOIN p USING (conv_id)
UNION ALL
SELECT p.conv_id, (coalesce(l.li, 0) + 1)::BIGINT, 'user', p.prompt FROM p LEFT JOIN lst l USING (conv_id)
WHERE l.lr IS NULL OR l.lr <> 'user'""")
def q_append_command(spark, sf_dir):
    """V7: the newest turn is the new command; glued onto a trailing user message or added."""
    history, prompts = cv.split_prompt(fx.noisy_history(spark, sf_dir))
    return cv.append_command(cv.context_window(history), prompts)


@register("transcript", f"""WITH {SPLIT_SQL},
lines AS (SELECT conv_id, turn, upper(coalesce(role, 'user')) || ': ' ||
                 CASE WHEN length(coalesce(text, '')) > 1500 THEN left(coalesce(text, ''), 1500) || '... [TRUNCATED]'
                      ELSE coalesce(text, '') END || chr(10) AS line
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM hist) WHERE rn <= 4),
c AS (SELECT conv_id, string_agg(line, '' ORDER BY turn) AS transcript FROM lines GROUP BY conv_id)
SELECT p.conv_id, coalesce(c.transcript, '') AS transcript,
       CASE WHEN c.transcript IS NULL THEN p.prompt
            ELSE 'CHAT HISTORY:' || chr(10) || c.transcript || chr(10) || chr(10) || 'USER''S NEW COMMAND: ' || p.prompt
                 || chr(10) || chr(10) || 'REWRITTEN STANDALONE COMMAND:' END AS rewriter_prompt
FROM p LEFT JOIN c USING (conv_id)""")
def q_transcript(spark, sf_dir):
    """V8: transcript of the last 4 raw messages and the rewriter prompt."""
    history, prompts = cv.split_prompt(fx.noisy_history(spark, sf_dir))
    return cv.transcript(history, prompts)


@register("pruned_history", f"""WITH {SPLIT_SQL},
nx AS (SELECT p.conv_id, p.prompt, coalesce(m.mx + 1, 0)::BIGINT AS nxt
       FROM p LEFT JOIN (SELECT conv_id, max(turn) AS mx FROM hist GROUP BY conv_id) m USING (conv_id)),
u AS (SELECT conv_id, turn::BIGINT AS pos, role, text AS content FROM hist
      UNION ALL SELECT conv_id, nxt, 'user', prompt FROM nx
      UNION ALL SELECT conv_id, nxt + 1, 'assistant', 'Processed data.' FROM nx)
SELECT conv_id, pos, role, content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS rn FROM u) WHERE rn <= 10""")
def q_pruned_history(spark, sf_dir):
    """V9: history plus the new user/assistant pair, newest 10 kept."""
    history, prompts = cv.split_prompt(fx.noisy_history(spark, sf_dir))
    return cv.prune_history(history, prompts)


@register("pruned_documents", """
WITH m AS (SELECT doc_id // 25 AS conv_id, doc_id AS turn, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text FROM documents),
p AS (SELECT conv_id, max(turn) + 1 AS nxt FROM m GROUP BY 1),
u AS (SELECT conv_id, turn AS pos, role, text AS content FROM m
      UNION ALL SELECT conv_id, nxt, 'user', 'Summarise ' || conv_id FROM p
      UNION ALL SELECT conv_id, nxt + 1, 'assistant', CASE WHEN conv_id % 4 <> 0 THEN 'Summary of ' || conv_id ELSE 'Processed data.' END FROM p)
SELECT conv_id, pos, role, content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS rn FROM u) WHERE rn <= 10""")
def q_pruned_documents(spark, sf_dir):
    """V9 where much is pruned: 25 documents are a conversation, with a reply given or missing."""
    d = load(spark, sf_dir, "documents")
    conv = F.floor(F.col("doc_id") / 25)
    history = d.select(conv.alias("conv_id"), F.col("doc_id").alias("turn"),
                       F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant").alias("role"), "text")
    ids = d.select(conv.alias("conv_id")).distinct()
    prompts = ids.select("conv_id", F.concat(F.lit("Summarise "), F.col("conv_id").cast("string")).alias("prompt"))
    replies = ids.where("conv_id % 4 <> 0").select("conv_id", F.concat(F.lit("Summary of "), F.col("conv_id").cast("string")).alias("reply"))
    return cv.prune_history(history, prompts, replies)


@register("turn_titles", r"""
WITH t1 AS (SELECT conv_id, turn, text,
              left(strip_ws(regexp_replace(coalesce(text, ''), '(?mi)^(To|From|Subject|Executive Memo):.*$', '', 'g')), 500) AS body
            FROM """ + fx.MEMOS_SQL + r""" m),
t2 AS (SELECT conv_id, turn, text, strip_ws(translate(body, '"''*', '')) AS t FROM t1),
s1 AS (SELECT conv_id, turn, t, left(coalesce(text, 'Analysis Task'), 45) || '...' AS snip FROM t2),
s2 AS (SELECT *, strip_ws(regexp_replace(snip, '(?i)^(To:|From:|Subject:|Executive Memo:)\s*', '')) AS st FROM s1)
SELECT conv_id, turn, snip AS prompt_snippet, CASE WHEN t = '' THEN 'Advanced Data Analysis' ELSE t END AS title,
       CASE WHEN st = '' THEN 'Analysis Session' ELSE array_to_string(string_split(st, ' ')[1:4], ' ') || '...' END AS short_title
FROM s2""")
def q_turn_titles(spark, sf_dir):
    """V10-V12 over every turn of every conversation."""
    m = fx.memos(spark, sf_dir)
    return m.select("conv_id", "turn", tx.snippet("text").alias("prompt_snippet"), tx.clean_title("text").alias("title"),
                    tx.short_title(tx.snippet("text")).alias("short_title"))


FIRST_USER_SQL = f"""fu AS (SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
                           FROM {fx.MEMOS_SQL} m WHERE role = 'user') WHERE rn = 1)"""


def _first_user(spark, sf_dir):
    m = fx.memos(spark, sf_dir).where(F.col("role") == "user")
    return cv.last_messages(m.withColumn("__neg", -F.col("turn")), 1, "conv_id", "__neg").select("conv_id", "text")


@register("titles", r"""WITH """ + FIRST_USER_SQL + r""",
t1 AS (SELECT conv_id, text,
              left(strip_ws(regexp_replace(coalesce(text, ''), '(?mi)^(To|From|Subject|Executive Memo):.*$', '', 'g')), 500) AS body
       FROM fu),
t2 AS (SELECT conv_id, text, strip_ws(translate(body, '"''*', '')) AS t FROM t1),
s1 AS (SELECT conv_id, t, left(coalesce(text, 'Analysis Task'), 45) || '...' AS snip FROM t2),
s2 AS (SELECT conv_id, t, strip_ws(regexp_replace(snip, '(?i)^(To:|From:|Subject:|Executive Memo:)\s*', '')) AS st FROM s1)
SELECT conv_id, CASE WHEN t = '' THEN 'Advanced Data Analysis' ELSE t END AS title,
       CASE WHEN st = '' THEN 'Analysis Session' ELSE array_to_string(string_split(st, ' ')[1:4], ' ') || '...' END AS short_title
FROM s2""")
def q_titles(spark, sf_dir):
    """Session title from the first request; fallback short title from its snippet."""
    fu = _first_user(spark, sf_dir)
    return fu.select("conv_id", tx.clean_title("text").alias("title"),
                     tx.short_title(tx.snippet("text")).alias("short_title"))


@register("snippets", "WITH " + FIRST_USER_SQL + """
SELECT conv_id, left(coalesce(text, 'Analysis Task'), 45) || '...' AS prompt_snippet FROM fu""")
def q_snippets(spark, sf_dir):
    """First 45 characters + '...'."""
    return _first_user(spark, sf_dir).select("conv_id", tx.snippet("text").alias("prompt_snippet"))


@register("text_chunks", """
SELECT doc_id, (i // 900)::BIGINT AS chunk_index, substr(text, i + 1, 900) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), 900)) AS i FROM documents)""")
def q_text_chunks(spark, sf_dir):
    """900-character chunks of every whole document."""
    return cv.chunk_text(load(spark, sf_dir, "documents"), "text", 900, "doc_id")


@register("extract_sql", r"""WITH r AS """ + fx.REPLIES_SQL + r""",
p AS (SELECT conv_id, turn, reply, string_split(reply, '```') AS parts FROM r),
b AS (SELECT conv_id, turn, CASE WHEN len(parts) > 2 THEN regexp_replace(parts[2], '^(?i:sql)', '') ELSE reply END AS body FROM p),
s AS (SELECT *, regexp_extract(body, '(?is)\b(SELECT\s|WITH\s+\w+\s*(\([^()]*\)\s*)?AS\s*\().*') AS found FROM b)
SELECT conv_id, turn, strip_ws(CASE WHEN found <> '' THEN found ELSE body END) AS extracted_sql
FROM s""")
def q_extract_sql(spark, sf_dir):
    """SQL pulled out of model replies (fenced, bare SELECT, WITH kept whole, prose)."""
    r = fx.replies(spark, sf_dir)
    return r.select("conv_id", "turn", tx.extract_sql("reply").alias("extracted_sql"))


PROSE_SQL = """(SELECT conv_id, turn, CASE turn % 4
  WHEN 0 THEN 'With this query you get it: SELECT ' || turn || ' AS n -- as asked'
  WHEN 1 THEN 'With pleasure. ' || chr(10) || 'with t AS (SELECT ' || conv_id || ' AS c) SELECT c FROM t'
  WHEN 2 THEN 'With regret: no selection can answer this.'
  ELSE 'First:' || chr(10) || '```SQL' || chr(10) || 'select ' || conv_id || ';' || chr(10) || '```' || chr(10) || 'with notes' END AS reply
FROM conversations)"""


@register("extract_sql_prose", f"""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'SELECT ' || turn || ' AS n -- as asked'
  WHEN 1 THEN 'with t AS (SELECT ' || conv_id || ' AS c) SELECT c FROM t' WHEN 2 THEN reply ELSE 'select ' || conv_id || ';' END AS extracted_sql
FROM {PROSE_SQL} r""")
def q_extract_sql_prose(spark, sf_dir):
    """Replies whose prose starts with "With"; only the head of a named part begins a statement."""
    c, t = F.col("conv_id").cast("string"), F.col("turn")
    reply = (F.when(t % 4 == 0, F.concat(F.lit("With this query you get it: SELECT "), t.cast("string"), F.lit(" AS n -- as asked")))
             .when(t % 4 == 1, F.concat(F.lit("With pleasure. \nwith t AS (SELECT "), c, F.lit(" AS c) SELECT c FROM t")))
             .when(t % 4 == 2, "With regret: no selection can answer this.")
             .otherwise(F.concat(F.lit("First:\n```SQL\nselect "), c, F.lit(";\n```\nwith notes"))))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.extract_sql(reply).alias("extracted_sql"))


# ---------------------------------------------------------------- analysis documents

BRIEF_SQL = """(SELECT doc_id,
  'Quality score ' || quality || ' for document ' || doc_id AS diagnostic,
  'Document_' || doc_id || ' reviewed' AS descriptive,
  CASE WHEN toxic <> 1 THEN 'Expected quality ' || quality END AS predictive,
  CASE WHEN quality = 1 THEN 'Keep_in_corpus' ELSE 'Review_before_use' END AS prescriptive,
  CASE WHEN doc_id % 5 <> 0 THEN 'Labels cover part of the corpus' END AS limitations, quality
FROM labels)"""


@register("narration", f"""SELECT doc_id,
  replace('Executive Summary. Diagnostic Analysis: ' || coalesce(diagnostic, 'Data analyzed.') ||
          ' Prescriptive Recommendation: ' || coalesce(prescriptive, 'Awaiting actions.'), '_', ' ') AS script
FROM {BRIEF_SQL} b""")
def q_narration(spark, sf_dir):
    """Narration script from each analysis document (JSON parsed with from_json)."""
    return lg.narration_text(fx.analysis_docs(spark, sf_dir), "analysis", "doc_id")


@register("brief_sections", f"""SELECT doc_id, s.section_index, s.section, s.body FROM (
  SELECT doc_id, unnest([
    {{'section_index': 0, 'section': 'diagnostic', 'body': coalesce(diagnostic, 'Awaiting diagnostic analysis...')}},
    {{'section_index': 1, 'section': 'descriptive', 'body': coalesce(descriptive, 'Awaiting descriptive analysis...')}},
    {{'section_index': 2, 'section': 'predictive', 'body': coalesce(predictive, 'Awaiting predictive analysis...')}},
    {{'section_index': 3, 'section': 'prescriptive', 'body': coalesce(prescriptive, 'Awaiting prescriptive analysis...')}},
    {{'section_index': 4, 'section': 'limitations', 'body': coalesce(limitations, 'Awaiting limitations analysis...')}}
  ]) AS s FROM {BRIEF_SQL} b)""")
def q_brief_sections(spark, sf_dir):
    """Five sections in fixed order, placeholders for missing ones."""
    return lg.brief_sections(fx.analysis_docs(spark, sf_dir), "analysis", "doc_id")


@register("point_rows", """
SELECT doc_id, 0::BIGINT AS pos, 'Query_1' AS point_id, 'Quality of ' || doc_id AS point_title, 'See chart' AS point_answers,
       'bar' AS chart_type, 'quality' AS x_col, 'toxic' AS y_col, CAST(NULL AS VARCHAR) AS color_col FROM labels
UNION ALL
SELECT doc_id, 1, 'heatmap', 'Correlation for ' || doc_id, 'Weak links', 'heatmap', 'quality', 'toxic', 'toxic'
FROM labels WHERE quality = 1""")
def q_point_rows(spark, sf_dir):
    """Point analyses exploded with their position."""
    return lg.point_rows(fx.analysis_docs(spark, sf_dir), "analysis", "doc_id")
