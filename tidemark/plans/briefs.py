"""Registered queries over campaign briefs, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import board, briefs, patterns
from tidemark.plans.catalog import _FLOOR, _KIND_ROWS, DEFAULT_BANNED, _t, _values, query


_SPACE = patterns.BLANK.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}")  # within a line
_UNDER = "regexp_replace(regexp_extract(text, '(?s)(?:^|\\n)##[ \\t][" + _SPACE + "]*{}(.*?)(?:\\n##?(?:[ \\t\\n]|$)|$)', 1), '^([^\\n]*?)[" + _SPACE + "]+(\\n|$)', '\\1\\2')"  # ends at a heading of one or two marks, empty ones too


@query(rf"""WITH b AS (SELECT doc_id, coalesce(text, '') AS text FROM v_briefs), r AS (SELECT doc_id, text, concat({_UNDER.replace("{}", "Rules text", 1)}, chr(10), {_UNDER.replace("{}", "On-modal requirements", 1)}) AS r FROM b),
           c AS (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN regexp_matches(r, '[^{patterns.BLANK}]') THEN r ELSE text END, '\(none[^)]*\)', '', 'gi'), '^[{patterns.BLANK}]+|[{patterns.BLANK}]+$', '', 'g') AS c FROM r)
           SELECT doc_id, length(c) AS n_clean, length(c) < 160 OR regexp_matches(lower(c), '{patterns.POINTER}') AS pointer FROM c""")
def rules_pointer_flag(spark, d):
    return briefs.rules_pointer_flag(_t(spark, d, "v_briefs"))


def _rules(spark, d):
    lines, more = _t(spark, d, "v_brief_lines", "v_brief_rules")
    return lines, board.rules_floor(lines, DEFAULT_BANNED).unionByName(more)


_RULES = "WITH q AS (" + _FLOOR.replace("v_rule_lines", "v_brief_lines") + " SELECT campaign, field, ord, value FROM floor UNION ALL SELECT campaign, field, ord, value FROM v_brief_rules)"
_NOTHING = "SELECT DISTINCT campaign, {0}, 9, CAST(0 AS BIGINT), 'none', '{1}' FROM v_brief_lines WHERE campaign NOT IN ({2})"
_TOLD = "SELECT campaign, sentence, row_number() OVER (PARTITION BY campaign ORDER BY part, a, b, k) AS ord FROM {0}"
_ONCE = "(SELECT campaign, sentence, part, a, b, k FROM (SELECT *, row_number() OVER (PARTITION BY campaign, sentence ORDER BY part, a, b, k) AS r FROM {0}) z WHERE r = 1)"
_SECTION = "[" + ", ".join(f"'{s}'" for s in briefs.SECTIONS) + "]"


@query(rf"""{_RULES},
  t AS (SELECT campaign, ord, lower(split_part(value, ':', 1)) AS type, CASE WHEN contains(value, ':') THEN trim(regexp_replace(value, '^[^:]*:', '')) ELSE value END AS detail FROM q WHERE field = 'required'),
  x AS (SELECT campaign, 0 AS part, doc_id AS a, line_no AS b, text FROM v_brief_lines
        UNION ALL SELECT campaign, CASE field WHEN 'submission_process' THEN 1 WHEN 'platform_rules' THEN 2 WHEN 'deadlines' THEN 3 ELSE 5 END, ord, 0, value FROM q WHERE field IN ('submission_process', 'platform_rules', 'deadlines', 'payout_terms')
        UNION ALL SELECT campaign, 4, ord, 0, detail FROM t),
  y AS (SELECT campaign, part, a, b, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS c FROM x),
  s AS (SELECT * FROM (SELECT campaign, part, a, b, trim(unnest(c)) AS sentence, generate_subscripts(c, 1) AS k FROM y) z WHERE sentence <> ''),
  bio AS (SELECT * FROM s WHERE regexp_matches(lower(sentence), '{briefs.LINK_IN_BIO}')), win AS (SELECT * FROM s WHERE regexp_matches(lower(sentence), '{briefs.POSTING}') AND regexp_matches(lower(sentence), '{briefs.TIME_WINDOW}')),
  lst AS (SELECT campaign, part - 10 AS part, a, b, sentence, k FROM s WHERE regexp_matches(lower(sentence), '{briefs.LEAST_VIEWS}') UNION ALL SELECT campaign, part, a, b, sentence, k FROM s WHERE regexp_matches(lower(sentence), '{briefs.LEAST_SECONDS}')),
  m AS (SELECT campaign, value, min(ord) AS ord FROM (SELECT campaign, ord, unnest(regexp_extract_all(value, '{briefs.HANDLE}')) AS value FROM (SELECT campaign, ord, value FROM q WHERE field = 'mentions' UNION ALL SELECT campaign, ord, detail FROM t WHERE type IN ('mention', 'tag')) z) w GROUP BY 1, 2),
  h AS (SELECT campaign, value, min(ord) AS ord FROM (SELECT campaign, ord, unnest(regexp_extract_all(value, '{briefs.HASHTAG}')) AS value FROM (SELECT campaign, ord, value FROM q WHERE field = 'hashtags' UNION ALL SELECT campaign, ord, detail FROM t WHERE type = 'hashtag') z) w GROUP BY 1, 2),
  k AS (SELECT c.campaign, coalesce(max(lower(q.value)), '') AS needed FROM (SELECT DISTINCT campaign FROM v_brief_lines) c LEFT JOIN q ON q.campaign = c.campaign AND q.field = 'watermark_required' GROUP BY 1),
  wl AS (SELECT campaign, sentence, ord FROM ({_TOLD.format(_ONCE.format("win"))}) z WHERE ord <= 4),
  st AS (SELECT * FROM q WHERE field = 'submission_process' AND NOT prefix(ltrim(value), '#')),
  i(campaign, section_no, group_no, ord, kind, item) AS (
    SELECT campaign, 0, 0, ord, 'box', 'mention ' || value || ' in the caption' FROM m UNION ALL SELECT campaign, 0, 1, ord, 'box', detail FROM t WHERE type = 'caption'
    UNION ALL {_NOTHING.format(0, "no required mention or tag found", "SELECT campaign FROM m UNION SELECT campaign FROM t WHERE type = 'caption'")}
    UNION ALL SELECT campaign, 1, 0, ord, 'box', 'include ' || value FROM h UNION ALL {_NOTHING.format(1, "no required hashtag found", "SELECT campaign FROM h")}
    UNION ALL SELECT campaign, 2, 0, ord, 'box', sentence FROM ({_TOLD.format("bio")}) z WHERE ord <= 4
    UNION ALL SELECT campaign, 3, 0, 0, CASE WHEN needed IN ('true', 'false') THEN 'note' ELSE 'verify' END, CASE needed WHEN 'true' THEN 'watermark: required' WHEN 'false' THEN 'watermark: not required' ELSE 'watermark requirement unclear' END FROM k
    UNION ALL SELECT campaign, 3, 1, ord, 'box', detail FROM t WHERE type IN ('logo', 'text_overlay', 'overlay')
    UNION ALL SELECT t.campaign, 3, 2, ord, CASE WHEN needed = 'true' AND regexp_matches(lower(detail), 'watermark|end\s*screen|logo') THEN 'verify' ELSE 'note' END,
      CASE WHEN needed = 'true' AND regexp_matches(lower(detail), 'watermark|end\s*screen|logo') THEN 'possible conflict, rules also say: ' ELSE 'restriction: ' END || detail FROM t JOIN k ON k.campaign = t.campaign WHERE type = 'restriction'
    UNION ALL SELECT campaign, 4, 0, CASE field WHEN 'resolution' THEN 0 WHEN 'aspect_ratio' THEN 1 ELSE 2 END, 'box', replace(field, '_', ' ') || ': ' || value FROM q WHERE field IN ('resolution', 'aspect_ratio', 'length')
    UNION ALL SELECT campaign, 4, 1, ord, 'box', detail FROM t WHERE type IN ('quality', 'resolution')
    UNION ALL SELECT campaign, 5, 0, ord, 'box', value FROM st UNION ALL SELECT campaign, 5, 1, ord, 'box', 'time window: ' || sentence FROM wl UNION ALL SELECT campaign, 5, 2, ord, 'box', 'deadline: ' || value FROM q WHERE field = 'deadlines'
    UNION ALL {_NOTHING.format(5, "no submission step or time window found", "SELECT campaign FROM st UNION SELECT campaign FROM wl UNION SELECT campaign FROM q WHERE field = 'deadlines'")}
    UNION ALL SELECT campaign, 6, 0, ord, 'note', value FROM q WHERE field = 'platform_rules' AND NOT prefix(ltrim(value), '#')
    UNION ALL SELECT campaign, 7, 0, ord, 'box', sentence FROM ({_TOLD.format(_ONCE.format("lst"))}) z WHERE ord <= 6
    UNION ALL SELECT campaign, 7, 1, ord, 'note', 'payout: ' || value FROM q WHERE field = 'payout_terms' AND NOT prefix(ltrim(value), '#')
    UNION ALL SELECT campaign, 8, 0, ord, 'box', detail FROM t WHERE detail <> '' AND type NOT IN ({", ".join(f"'{c}'" for c in briefs.CONSUMED)})
    UNION ALL SELECT campaign, 9, 0, ord, 'verify', value FROM q WHERE field = 'ambiguities'),
  c AS (SELECT campaign, section_no, group_no, ord, kind, trim(regexp_replace(item, '\s+', ' ', 'g')) AS item FROM i),
  o AS (SELECT *, row_number() OVER (PARTITION BY campaign, kind, CASE WHEN kind = 'none' THEN item || section_no ELSE lower(item) END ORDER BY section_no, group_no, ord, item) AS r FROM c WHERE item <> '')
  SELECT campaign, row_number() OVER (PARTITION BY campaign ORDER BY section_no, group_no, ord, item, kind) AS place, {_SECTION}[section_no + 1] AS section, kind, item FROM o WHERE r = 1""")
def posting_checklist(spark, d):
    return briefs.posting_checklist(*_rules(spark, d))


_USED = f"""u AS (SELECT v.campaign, ord, path, coalesce(k.kind, 'other') AS kind, CASE coalesce(k.kind, 'other') WHEN 'footage' THEN 'probed video (' || CAST(duration_sec AS BIGINT) || ' s)'
    WHEN 'asset' THEN CASE WHEN regexp_matches(lower(path), '(guide|reference|safe|margin|template)') THEN 'applied as reference' ELSE 'watermark candidate' END WHEN 'doc' THEN CASE WHEN size % 5 <> 0 THEN 'read + extracted (' || size || ' chars)' ELSE 'UNREAD: no text' END ELSE 'UNUSED: no handler' END AS usage
  FROM v_resources v LEFT JOIN (VALUES {_values(_KIND_ROWS)}) k(ext, kind) ON k.ext = lower(regexp_extract(v.path, '\\.([A-Za-z0-9]+)$', 1)))"""
_STATS = """CASE WHEN p_partkey % 5 <> 0 THEN 'pay $' || format('{:.2f}', (p_size % 8) / 4.0::DOUBLE) || '/1K; ' ELSE '' END || 'budget $' || format('{:,}', p_size * 30) || '/$' || format('{:,}', p_size * 100) ||
  CASE WHEN p_size % 2 = 0 THEN ', ' || CAST(round((p_size % 21) * 5) AS BIGINT) || '% remaining' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '; min payout $' || format('{:,.2f}', p_size / 4.0::DOUBLE) ELSE '' END || CASE WHEN p_size % 4 = 0 THEN '; max/video $' || format('{:,}', p_size * 1000) ELSE '' END"""


def _field_case(of: str, by) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{f}' THEN {by(k, j)}" for k, (_, fields) in enumerate(briefs.DIGEST, 1) for j, f in enumerate(fields)) + " END"


@query(f"""{_RULES}, {_USED},
  l AS (SELECT campaign, 0 AS part, 0 AS field_no, ord, '- **' || path || '** (' || kind || '): ' || usage || CASE WHEN prefix(usage, 'UN') THEN chr(10) || '    - note: ' || CASE WHEN kind = 'doc' THEN 'could not extract text' ELSE 'no handler for this file type' END ELSE '' END AS line FROM u
        UNION ALL SELECT campaign, {_field_case("field", lambda k, j: k)}, {_field_case("field", lambda k, j: j)}, ord, '- ' || value FROM q),
  g AS (SELECT campaign, part, string_agg(line, chr(10) ORDER BY field_no, ord, line) AS lines FROM l WHERE part IS NOT NULL GROUP BY 1, 2),
  n AS (SELECT unnest(range(0, {len(briefs.DIGEST) + 1})) AS part, unnest([{", ".join(f"'{t}'" for t in ("Resources and how each was used", *(t for t, _ in briefs.DIGEST)))}]) AS title),
  b AS (SELECT p.p_partkey AS campaign, string_agg('## ' || n.title || chr(10) || coalesce(g.lines, '_(none)_'), chr(10) || chr(10) ORDER BY n.part) AS body FROM part p CROSS JOIN n LEFT JOIN g ON g.campaign = p.p_partkey AND g.part = n.part GROUP BY 1)
  SELECT b.campaign, '# Campaign ' || b.campaign || chr(10) || 'stats: ' || {_STATS} || chr(10) || chr(10) || body AS digest FROM b JOIN part ON p_partkey = b.campaign""")
def campaign_digest(spark, d):
    parts, resources = _t(spark, d, "part", "v_resources")
    size = F.col("p_size")
    some = lambda c, x: F.when(c, x)
    line = briefs.stats_line(some(F.col("p_partkey") % 5 != 0, (size % 8) / 4.0), size * 100, size * 30, some(size % 2 == 0, (size % 21) * 0.05), some(size % 3 == 0, size / 4.0), some(size % 4 == 0, size * 1000))
    files = resources.withColumn("text_len", F.when(F.col("size") % 5 != 0, F.col("size")))
    return briefs.campaign_digest(_rules(spark, d)[1], files, spark.createDataFrame(_KIND_ROWS, "ext string, kind string"), parts.select(F.col("p_partkey").alias("campaign"), line.alias("stats")))
