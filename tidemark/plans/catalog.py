"""The registered queries over the driver's tables, and DuckDB SQL for each."""

from __future__ import annotations

import functools
from collections.abc import Callable
from html import _invalid_charrefs, _invalid_codepoints
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import board, captions, intervals, patterns, ranking, series, text
from tidemark.sources import views

# Term lists of the queries; parameters of the operators.
FILLER = ["it is", "on the"]
MARKERS = ["the", "and", "with"]
BANNED = [(1, "for", False), (2, "mit license", False), (3, "license", False), (4, "token", False), (5, "with", False), (6, patterns.bounded(r"\b(re)?[a-z]{3}tion(s|ed)?\b"), True)]
DEFAULT_BANNED = ["giveaway", "casino"]
GENERIC = ["the", "and", "for"]
STOP = {"en": "the and of to is with that for", "fr": "le la les des que est un une", "de": "der die das und ein ist von den", "es": "el la los que de y en del"}
KINDS = patterns.KINDS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = views.duckdb(sql)
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, *names: str):
    got = [views.table(spark, sf_dir, n) for n in names]
    return got[0] if len(got) == 1 else got


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


def _bound(words: list[str]) -> str:
    return "(^|[^a-z0-9_])(" + "|".join(words) + ")([^a-z0-9_]|$)"


def _has(pattern: str, of: str = "lower(text)") -> str:
    return f"regexp_matches({of}, '{pattern.replace(chr(39), 2 * chr(39))}')"


def _holds(words: list[str], of: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({of}, '{w.replace(chr(39), 2 * chr(39))}')" for w in words) + ")"


def _tagged(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {_holds(words, low)} THEN '{tag}'" for words, tag in patterns.REASON_TAGS) + " ELSE 'nothing usable' END"


_STOP_ROWS = [(code, rank, w) for rank, (code, ws) in enumerate(STOP.items()) for w in ws.split()]
_KIND_ROWS = [(e, k) for k, es in KINDS.items() for e in es.split()]

# -- scans -------------------------------------------------------------------------------------------------------


@query("SELECT source, seg_no, start_s, end_s, role, text FROM v_segments")
def scan_segments(spark, d):
    return _t(spark, d, "v_segments").select("source", "seg_no", "start_s", "end_s", "role", "text")


@query("SELECT id, name, round(CAST(composite AS DOUBLE), 6) AS composite, status, category, lane FROM v_board WHERE name IS NOT NULL")
def scan_board(spark, d):
    rows = _t(spark, d, "v_board").select(F.floor(F.col("id") / 50).alias("k"), F.struct("id", "name", "composite", "status", "category", "lane").alias("c"))
    boards = rows.groupBy("k").agg(F.collect_list("c").alias("campaigns"))  # documents of 50 campaigns, in both layouts
    return board.scan_board(boards.select(F.when(F.col("k") % 2 == 0, F.to_json(F.struct("campaigns"))).otherwise(F.to_json("campaigns")).alias("doc")))


@query("SELECT CAST(id AS VARCHAR) AS id FROM v_board WHERE is_done")
def scan_done_ids(spark, d):
    done = _t(spark, d, "v_board").where("is_done").select(F.when(F.col("id") % 2 == 0, F.to_json(F.struct("id"))).otherwise(F.col("id").cast("string")).alias("x"))
    return done.select(F.coalesce(F.get_json_object("x", "$.id"), "x").alias("id"))


@query("""SELECT campaign, ord, path FROM (SELECT *, bool_or(safe_margin) OVER (PARTITION BY campaign) AS anyf FROM v_resources
          WHERE regexp_matches(lower(path), '\\.(mp4|mov|mkv)$')) t WHERE safe_margin OR NOT anyf""")
def prefer_flagged_else_all(spark, d):
    return board.prefer_flagged_else_all(_t(spark, d, "v_resources"))


@query(f"""SELECT coalesce(k.kind, 'other') AS kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM v_resources r
           LEFT JOIN (VALUES {_values(_KIND_ROWS)}) k(ext, kind) ON k.ext = lower(regexp_extract(r.path, '\\.([A-Za-z0-9]+)$', 1)) GROUP BY 1""")
def route_by_extension(spark, d):
    return board.route_by_extension(_t(spark, d, "v_resources"), spark.createDataFrame(_KIND_ROWS, "ext string, kind string"))


_STRIPPED = "regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
_NAMED = ", ".join("('" + n + "', '" + c.replace("'", "''") + "')" for n, c in sorted(html5.items()))  # all names of HTML, with and without the semicolon
_NUMBERED = ", ".join(f"({n}, {'chr(%d)' % ord(c) if c != chr(0) else chr(39) * 2})" for n, c in sorted(_invalid_charrefs.items()))
_NO_TEXT = ", ".join(map(str, sorted(_invalid_codepoints)))


@query(rf"""WITH named(name, chars) AS (VALUES {_NAMED}), numbered(n, chars) AS (VALUES {_NUMBERED}),
          x AS (SELECT row_number() OVER () AS r, page_id, string_split({_STRIPPED}, '&') AS a FROM pages), p AS (SELECT r, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM x),
          k AS (SELECT *, regexp_extract(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?') AS ref, ltrim(regexp_extract(p, '^#([0-9]+)', 1), '0') AS dec, ltrim(lower(regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1)), '0') AS hex,
                  regexp_extract(p, '^[^	
 <#;]{{1,32}};?') AS s FROM p WHERE i > 1),
          c AS (SELECT r, i, p, ref, CASE WHEN length(dec) > 7 OR length(hex) > 6 THEN 1114112 WHEN dec <> '' THEN CAST(dec AS BIGINT) ELSE list_sum(list_transform(range(1, length(hex) + 1), lambda j: (instr('0123456789abcdef', substr(hex, j, 1)) - 1) * CAST(pow(16, length(hex) - j) AS BIGINT))) END AS n FROM k WHERE ref <> ''),
          d AS (SELECT r, i, CASE WHEN m.n IS NOT NULL THEN m.chars WHEN coalesce(c.n, 0) = 0 OR c.n BETWEEN 55296 AND 57343 OR c.n > 1114111 THEN chr(65533) WHEN c.n IN ({_NO_TEXT}) THEN '' ELSE chr(CAST(c.n AS INTEGER)) END || substr(p, length(ref) + 1) AS t
                FROM c LEFT JOIN numbered m ON m.n = c.n AND c.n > 0),
          g AS (SELECT r, i, p, substr(s, 1, j) AS name FROM (SELECT r, i, p, s, unnest(range(2, length(s) + 1)) AS j FROM k WHERE ref = '') z),
          l AS (SELECT r, i, arg_max(chars || substr(p, length(g.name) + 1), length(g.name)) AS t FROM g JOIN named USING (name) GROUP BY 1, 2),
          t AS (SELECT r, string_agg(CASE WHEN i = 1 THEN p ELSE coalesce(d.t, l.t, '&' || p) END, '' ORDER BY i) AS t FROM p LEFT JOIN d USING (r, i) LEFT JOIN l USING (r, i) GROUP BY r)
          SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[{patterns.BLANK}]+|[{patterns.BLANK}]+$', '', 'g') AS text FROM x LEFT JOIN t USING (r)""")
def html_to_text(spark, d):
    return text.html_to_text(_t(spark, d, "pages"))


@query("SELECT source, substr(string_agg(text, chr(10) ORDER BY doc_id), 1, 24000) AS corpus FROM documents GROUP BY source")
def corpus_build(spark, d):
    return text.corpus_build(_t(spark, d, "documents"))


_NOW = "SELECT source, campaign, ord, CASE WHEN size % 13 = 0 THEN size + 1 ELSE size END AS size FROM v_resources WHERE size % 29 <> 0"


@query(f"""WITH n AS ({_NOW}) SELECT a.source, bool_and(coalesce(a.size = n.size, false)) AS reuse,
          CAST(sum(CASE WHEN n.size <> a.size THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(sum(CASE WHEN n.size IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing
          FROM v_resources a LEFT JOIN n ON n.source = a.source AND n.campaign = a.campaign AND n.ord = a.ord GROUP BY a.source""")
def manifest_diff(spark, d):
    r = _t(spark, d, "v_resources")
    now = r.where("size % 29 <> 0").withColumn("size", F.when(F.col("size") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return board.manifest_diff(r, now)


# -- predicates --------------------------------------------------------------------------------------------------


@query(f"SELECT id, source, start_s FROM v_moments WHERE NOT (length(text) > 0 AND regexp_matches(lower(text), '{_bound(FILLER)}'))")
def filler_kill(spark, d):
    return text.filler_kill(_t(spark, d, "v_moments"), FILLER).select("id", "source", "start_s")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS t FROM documents),
          c AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS top FROM (SELECT doc_id, t, count(*) AS c FROM t GROUP BY 1, 2) u GROUP BY 1)
          SELECT d.doc_id, coalesce(n, 0) AS n_tokens, coalesce(top, 0) AS top, coalesce(n, 0) < 4 OR coalesce(top, 0) >= greatest(5, 0.5 * coalesce(n, 0)) AS junk
          FROM documents d LEFT JOIN c USING (doc_id)""")
def junk_text_flag(spark, d):
    return text.junk_text_flag(_t(spark, d, "documents"))


@query(r"""WITH g AS (SELECT *, substr(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))), 1, 200) AS key FROM v_moments
          WHERE end_s - start_s >= 3 AND (len(regexp_extract_all(text, '[A-Za-z'']+')) >= 4 OR (type = 'audio_spike' AND intensity >= 6))),
          r AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY start_s, end_s, id) AS rn FROM g)
          SELECT id, source FROM r WHERE key = '' OR rn = 1""")
def prefilter_candidates(spark, d):
    return text.prefilter_candidates(_t(spark, d, "v_moments"))


_RANKABLE = "status IN ('scraped', 'refreshed') AND NOT disqualified AND NOT rules_unreadable AND NOT excluded_prohibited AND composite > 0 AND core_known > 0"
_RULES = """CASE WHEN rules_unreadable THEN 'rules unreadable' WHEN rules_source IN ('modal', 'gdoc', 'notion') THEN '' WHEN rules_source = 'unreadable' THEN 'rules unreadable' WHEN rules_source = 'none' THEN 'no readable rules'
  WHEN length(trim(coalesce(rules_text, ''))) > 0 OR n_rule_links > 0 THEN '' ELSE 'no rules captured' END"""
_REASON = f"CASE WHEN is_done THEN 'done' WHEN {_RULES} <> '' THEN {_RULES} WHEN n_links = 0 THEN 'no footage' ELSE '' END"
_RANKED = f"SELECT id, round(CAST(composite AS DOUBLE), 6) AS composite, CAST(core_known AS BIGINT) AS core_known, CAST(pre_score AS BIGINT) AS pre_score FROM v_board WHERE {_RANKABLE}"


@query(f"SELECT id, round(CAST(composite AS DOUBLE), 6) AS composite FROM v_board WHERE {_RANKABLE}")
def rankable_filter(spark, d):
    return board.rankable_filter(_t(spark, d, "v_board"))


@query(f"SELECT id, {_REASON} AS reason FROM v_board")
def clippable_first_reason(spark, d):
    return board.clippable_first_reason(_t(spark, d, "v_board"))


@query("SELECT id, lang <> 'en' AND lang_conf <> 'low' AS skip FROM v_board")
def language_skip(spark, d):
    return board.language_skip(_t(spark, d, "v_board"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN {_has('|'.join(own), 'lower(html)')} THEN '{name}'" for name, own in patterns.BARRIERS) + " END AS barrier FROM pages")
def barrier_detect(spark, d):
    return text.barrier_detect(_t(spark, d, "pages"), patterns.BARRIERS)


_WORDS = "len(regexp_extract_all(text, '[^ ]*[A-Za-z0-9][^ ]*'))"
_ASKS, _HOOKED = _has(patterns.HOOKS["question"]), _has("|".join(patterns.HOOKS.values()))


@query(f"""WITH v AS (SELECT doc_id AS clip_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z'']+')), lambda w: length(w) > 2 AND NOT list_contains([{", ".join(f"'{g}'" for g in GENERIC)}], w))) >= 3 AS told FROM documents),
           r AS (SELECT clip_id, pos, CASE WHEN {_WORDS} > 8 THEN 'too long' WHEN contains(text, chr(10)) THEN 'several lines' WHEN {_has(patterns.DESCRIPTIVE)} THEN 'describes' WHEN {_has(patterns.BAIT)} THEN 'bait'
                 WHEN NOT {_HOOKED} THEN 'no hook' WHEN {_has(patterns.GIVEAWAY)} AND NOT {_ASKS} THEN 'giveaway' WHEN {_has(patterns.FILLER)} THEN 'filler' END AS reason FROM v_candidates)
           SELECT r.clip_id, pos, CASE WHEN reason <> 'filler' OR told THEN reason END AS reason FROM r JOIN v USING (clip_id)""")
def caption_quality_kill(spark, d):
    transcripts = _t(spark, d, "documents").select(F.col("doc_id").alias("clip_id"), "text")
    return captions.caption_quality_kill(_t(spark, d, "v_candidates"), transcripts, GENERIC)


@query(f"""WITH b(ordinal, term, is_pattern) AS (VALUES {_values(BANNED)}),
           h AS (SELECT c.clip_id, c.pos, min_by(b.term, b.ordinal) AS reason FROM v_candidates c JOIN b
                 ON CASE WHEN is_pattern THEN regexp_matches(lower(c.text), b.term) WHEN contains(b.term, ' ') THEN contains(lower(c.text), b.term) ELSE regexp_matches(lower(c.text), '(^|[^a-z0-9_])' || b.term || '([^a-z0-9_]|$)') END GROUP BY 1, 2)
           SELECT c.clip_id, c.pos, h.reason FROM v_candidates c LEFT JOIN h ON h.clip_id = c.clip_id AND h.pos = c.pos""")
def banned_gauntlet(spark, d):
    return text.banned_gauntlet(_t(spark, d, "v_candidates"), spark.createDataFrame(BANNED, "ordinal int, term string, is_pattern boolean"))


# -- joins -------------------------------------------------------------------------------------------------------


@query("""SELECT m.id, substr(coalesce(string_agg(s.text, ' ' ORDER BY s.start_s, s.seg_no), ''), 1, 300) AS context FROM v_moments m
          LEFT JOIN v_segments s ON s.source = m.source AND s.end_s >= m.start_s - 8 AND s.start_s <= m.start_s + 4 WHERE trim(m.text) = '' GROUP BY m.id""")
def interval_context(spark, d):
    return intervals.interval_context(*_t(spark, d, "v_moments", "v_segments"))


@query("SELECT id, source, start_s FROM v_moments m WHERE NOT EXISTS (SELECT 1 FROM v_posted p WHERE p.source = m.source AND m.start_s < p.end_s AND p.start_s < m.end_s)")
def overlap_anti_join(spark, d):
    return intervals.overlap_anti_join(*_t(spark, d, "v_moments", "v_posted")).select("id", "source", "start_s")


_PEAK = """SELECT s.source, s.seg_no, (SELECT e.sec FROM v_energy e WHERE e.source = s.source AND e.sec >= floor(s.start_s) AND e.sec < ceil(s.end_s) ORDER BY e.rms DESC, e.sec LIMIT 1) AS peak FROM v_segments s"""


_MOVES = "(CAST(e.rms AS BIGINT) * 7 + e.sec * 13) % 31"


@query(f"""WITH p AS (SELECT p.*, s.start_s, s.end_s FROM ({_PEAK}) p JOIN v_segments s ON s.source = p.source AND s.seg_no = p.seg_no)
           SELECT source, seg_no, peak, round(CAST(coalesce(CASE WHEN least(end_s, peak + 1) - greatest(start_s, peak - 1) >= 0.2 THEN (SELECT e.sec FROM v_energy e WHERE e.source = p.source AND e.sec >= greatest(p.start_s, p.peak - 1) AND e.sec <= least(p.end_s, p.peak + 1) ORDER BY {_MOVES} DESC, e.sec LIMIT 1) END, peak) AS DOUBLE), 2) AS opening FROM p""")
def energy_peak(spark, d):
    segments, energy = _t(spark, d, "v_segments", "v_energy")
    return intervals.energy_peak(segments, energy, energy.alias("e").select("source", F.col("sec").cast("double").alias("at"), F.expr(_MOVES).alias("score")))


_GAPS = "SELECT concat('g', CAST(source AS VARCHAR(20)), '_', CAST(seg_no AS VARCHAR(20))) AS id, source, end_s + 0.45 AS start_s, end_s + 0.55 AS end_s, 'audio_spike' AS type, CAST(length(text) % 120 AS DOUBLE) / 10 AS intensity, end_s + 0.5 AS peak, '' AS text FROM {}"


@query(f"""WITH m AS (SELECT * FROM v_moments UNION ALL {_GAPS.format("v_segments")}),
          q AS (SELECT * FROM m WHERE type = 'audio_spike' AND NOT EXISTS (SELECT 1 FROM v_segments s WHERE s.source = m.source AND trim(s.text) <> '' AND s.start_s < m.end_s + 0.4 AND s.end_s > m.start_s - 0.4)),
          r AS (SELECT c.clip_id, q.id, q.start_s AS beat_start, row_number() OVER (PARTITION BY c.clip_id ORDER BY q.intensity DESC, q.start_s, q.id) AS rn FROM v_clips c JOIN q ON q.source = c.source AND abs(q.peak - c.peak) <= 22)
          SELECT clip_id, id, beat_start FROM r WHERE rn <= 3""")
def nonspeech_beats(spark, d):
    clips, moments, segments = _t(spark, d, "v_clips", "v_moments", "v_segments")
    return intervals.nonspeech_beats(clips, moments.unionByName(spark.sql(_GAPS.format("{s}"), s=segments)), segments)  # and short spikes in the gaps


@query("""WITH c AS (SELECT c.clip_id, c.start_s, c.end_s, s.end_s AS e, regexp_matches(rtrim(s.text, ' '), '[.!?]$') AS fin FROM v_clips c LEFT JOIN v_segments s ON s.source = c.source AND s.end_s >= c.start_s AND s.end_s <= c.end_s + 4),
          p AS (SELECT clip_id, max(end_s) AS e0, bool_or(abs(e - end_s) <= 0.35) AS there,
                min(CASE WHEN e > end_s AND e < least(end_s + 4, start_s + 34) AND fin THEN e END) AS sent, min(CASE WHEN e > end_s AND e < least(end_s + 4, start_s + 34) THEN e END) AS anye,
                max(CASE WHEN e < end_s AND e - start_s >= 0.6 * (end_s - start_s) THEN e END) AS bef FROM c GROUP BY clip_id)
          SELECT clip_id, CASE WHEN coalesce(there, false) THEN e0 ELSE coalesce(sent, anye, bef, e0) END AS new_end FROM p""")
def snap_to_boundary(spark, d):
    return intervals.snap_to_boundary(*_t(spark, d, "v_clips", "v_segments"))


_QUIET = """SELECT source, CAST(min(sec) AS DOUBLE) AS start_s, CAST(max(sec) + 1 AS DOUBLE) AS end_s FROM (SELECT source, sec, sec - row_number() OVER (PARTITION BY source ORDER BY sec) AS g FROM v_energy WHERE rms < 5) t GROUP BY source, g"""


@query(f"""WITH q AS ({_QUIET}), n AS (SELECT c.clip_id, c.start_s, c.end_s, min(q.start_s) AS a FROM v_clips c LEFT JOIN q ON q.source = c.source AND q.end_s - q.start_s >= 0.4 AND q.start_s >= c.end_s - 0.25 AND q.start_s < c.start_s + 34 GROUP BY 1, 2, 3)
           SELECT clip_id, round(CASE WHEN a IS NULL THEN end_s ELSE least(a + 0.4, start_s + 34) END, 2) AS new_end FROM n""")
def snap_to_silence(spark, d):
    clips, energy = _t(spark, d, "v_clips", "v_energy")
    return series.snap_to_silence(clips, series.silence_runs(energy, 5.0, 0.4))


@query("SELECT clip_id, round(sum(CASE WHEN k <> 0 THEN b - a ELSE 0 END), 3) AS content, round(sum(CASE WHEN k <> 0 THEN b - a ELSE 0 END), 3) >= 15 AS kept FROM v_played GROUP BY clip_id")
def min_content_gate(spark, d):
    return intervals.min_content_gate(_t(spark, d, "v_played"))


@query("""WITH o AS (SELECT p.*, coalesce(sum(b - a) OVER (PARTITION BY clip_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM v_played p),
          r AS (SELECT o.*, c.peak - c.start_s AS t FROM o JOIN v_clips c USING (clip_id))
          SELECT clip_id, round(min(CASE WHEN k <> 0 AND t >= a AND t < b THEN o + t - a END) - max(CASE WHEN k = 0 THEN o + b - a END), 3) AS gap FROM r GROUP BY clip_id""")
def payoff_gap(spark, d):
    return intervals.payoff_gap(*_t(spark, d, "v_played", "v_clips"))


_GENERIC_SQL = "[" + ", ".join(f"'{g}'" for g in GENERIC) + "]"


@query(f"""WITH v AS (SELECT DISTINCT doc_id - 1 AS clip_id, trim(unnest(regexp_extract_all(lower(text), '[a-z'']+')), '''') AS token FROM documents),
           u AS (SELECT clip_id, list(token) AS words, list(DISTINCT token[1:4]) FILTER (length(token) >= 4) AS stems FROM v GROUP BY clip_id),
           t AS (SELECT clip_id, pos, list_filter(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: trim(w, ''''))), lambda w: length(w) > 2 AND NOT list_contains({_GENERIC_SQL}, w)) AS said FROM v_candidates),
           o AS (SELECT t.clip_id, t.pos, said, list_filter(said, lambda w: NOT list_contains(coalesce(words, []), w) AND NOT (length(w) >= 4 AND list_contains(coalesce(stems, []), w[1:4]))) AS odd FROM t LEFT JOIN u ON u.clip_id = t.clip_id)
           SELECT clip_id, pos, array_to_string(list_sort(odd), ',') AS unsupported, len(odd) < len(said) AS specific FROM o""")
def grounding_anti_join(spark, d):
    candidates, documents = _t(spark, d, "v_candidates", "documents")  # a document's lines, grounded on the next document
    return text.grounding_anti_join(candidates, documents.select((F.col("doc_id") - 1).alias("doc_id"), "text"), GENERIC)


@query(f"""WITH s(code, rk, word) AS (VALUES {_values(_STOP_ROWS)}),
           t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ'']+')) AS word FROM documents),
           n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
           v AS (SELECT doc_id, code, rk, count(*) AS c FROM t JOIN s USING (word) GROUP BY 1, 2, 3),
           b AS (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, rk) AS rn FROM v)
           SELECT d.doc_id, CASE WHEN n.n >= 8 THEN b.code END AS lang FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.rn = 1""")
def dictionary_language_vote(spark, d):
    return text.dictionary_language_vote(_t(spark, d, "documents"), {code: words.split() for code, words in STOP.items()})


@query("""WITH s AS (SELECT id, CAST(intensity AS BIGINT) % 101 AS score, text AS line, start_s AS pos FROM v_moments WHERE type = 'speech'
                     UNION ALL SELECT id, 7 AS score, 'again' AS line, start_s + 1 AS pos FROM v_moments),
          f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM s)
          SELECT m.id, CAST(f.score AS BIGINT) AS score, substr(f.line, 1, 200) AS line FROM v_moments m JOIN f ON f.id = m.id AND f.rn = 1""")
def score_attach(spark, d):
    m = _t(spark, d, "v_moments")
    first = m.where("type = 'speech'").select("id", (F.bround("intensity").cast("long") % 101).alias("score"), F.col("text").alias("line"), F.col("start_s").alias("pos"))
    again = m.select("id", F.lit(7).cast("long").alias("score"), F.lit("again").alias("line"), (F.col("start_s") + 1).alias("pos"))
    return board.score_attach(m, first.unionByName(again))


@query("""WITH u AS (SELECT source, id FROM v_moments), d AS (SELECT source, id FROM v_moments WHERE intensity <> 10.1)
          SELECT u.source, bool_and(d.id IS NOT NULL) AS fresh, CAST(sum(CASE WHEN d.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM u LEFT JOIN d ON d.source = u.source AND d.id = u.id GROUP BY u.source""")
def freshness_check(spark, d):
    m = _t(spark, d, "v_moments").select("source", "id", "intensity")
    return board.freshness_check(m, m.where("intensity <> 10.1"))


# -- aggregations ------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT source, sec, sum(amp) AS x FROM v_signal GROUP BY 1, 2)
          SELECT source, CAST(floor(sec / 4) AS BIGINT) AS win, round(sqrt(sum(x * x) / count(*) + 1e-9), 2) AS rms FROM m GROUP BY 1, 2 HAVING count(*) = 4""")
def track_mix_rms(spark, d):
    return series.track_mix_rms(_t(spark, d, "v_signal"), 4)


@query("""WITH s AS (SELECT source, lang, sum(n_chars) AS c FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, lang DESC) AS rn, sum(c) OVER (PARTITION BY source) AS a FROM s)
          SELECT source, lang, CAST(c AS BIGINT) AS chars, round(CAST(c AS DOUBLE) / CAST(a AS DOUBLE), 4) AS share FROM r WHERE rn = 1""")
def source_language(spark, d):
    return board.source_language(_t(spark, d, "documents"))


@query("""WITH s AS (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS c FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, lang DESC) AS rn, sum(c) OVER (PARTITION BY source) AS a FROM s),
          x AS (SELECT source, string_agg(lang || ':' || c, ',' ORDER BY lang, c) AS mix FROM s GROUP BY 1)
          SELECT r.source, CASE WHEN lang = 'en' THEN 'pass' WHEN CAST(c AS DOUBLE) / CAST(a AS DOUBLE) < 0.6 THEN 'ambiguous' ELSE 'block' END AS decision, mix FROM r JOIN x USING (source) WHERE rn = 1""")
def language_gate(spark, d):
    return board.language_gate(_t(spark, d, "documents"))


@query("""WITH g AS (SELECT source, stddev_pop(rms) AS s FROM v_energy GROUP BY 1),
          w AS (SELECT c.clip_id, count(*) AS n, max(e.rms) AS p, median(e.rms) AS m, max(g.s) AS s, arg_min(e.sec, -e.rms * 100000 + e.sec) AS ps FROM v_clips c JOIN v_energy e ON e.source = c.source AND e.sec >= floor(c.start_s) AND e.sec < CAST(round(c.end_s) AS BIGINT) JOIN g ON g.source = c.source GROUP BY 1)
          SELECT clip_id, p AS peak_rms, ps AS peak_sec, m AS median, round((p - m) / s, 2) AS z, round((p - m) / s, 2) >= 3 AS sharp FROM w WHERE n >= 3 AND s > 0""")
def window_shape(spark, d):
    return series.window_shape(*_t(spark, d, "v_clips", "v_energy"))


@query("""SELECT clip_id, round(avg(CASE WHEN n_subjects = 1 THEN 1.0 ELSE 0 END), 4) AS single, round(avg(CASE WHEN n_subjects > 1 THEN 1.0 ELSE 0 END), 4) AS multi, round(avg(CASE WHEN n_subjects = 0 THEN 1.0 ELSE 0 END), 4) AS none,
          round(median(cx), 4) AS centre, round(stddev_pop(cx), 3) AS spread,
          CASE WHEN round(avg(CASE WHEN n_subjects = 0 THEN 1.0 ELSE 0 END), 4) > 0.5 THEN 'no subject' WHEN round(avg(CASE WHEN n_subjects > 1 THEN 1.0 ELSE 0 END), 4) > 0.3 THEN 'several subjects'
               WHEN round(avg(CASE WHEN n_subjects = 1 THEN 1.0 ELSE 0 END), 4) < 0.5 THEN 'too few' ELSE 'track' END AS verdict,
          verdict = 'track' AND round(stddev_pop(cx), 3) / 1080 < 0.06 AS static FROM v_detections GROUP BY clip_id""")
def subject_share_decision(spark, d):
    return ranking.subject_share_decision(_t(spark, d, "v_detections"), still=0.06)


@query(f"""WITH h AS (SELECT category, grouping(category) AS g, count(*) AS campaigns, CAST(sum(CASE WHEN {_RANKABLE} THEN 1 ELSE 0 END) AS BIGINT) AS rankable, CAST(sum(CASE WHEN {_RANKABLE} AND {_REASON} = '' THEN 1 ELSE 0 END) AS BIGINT) AS clippable,
             max(CAST(replace(replace(generated_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS made FROM v_board GROUP BY ROLLUP (category)),
           a AS (SELECT *, round((epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(made)) / 3600, 2) AS age_h FROM h)
           SELECT CASE WHEN g = 1 THEN 'all' ELSE category END AS category, campaigns, rankable, clippable, age_h, CASE WHEN made IS NULL THEN 'unknown' WHEN age_h < 78.5 THEN 'fresh' ELSE 'stale' END AS state FROM a""")
def board_health(spark, d):
    return board.board_health(_t(spark, d, "v_board"), "2024-01-31T12:00:00+00:00", fresh=78.5)


@query(f"SELECT walk, tag, count(*) AS attempts, CAST(sum(clips) AS BIGINT) AS clips FROM (SELECT *, CASE WHEN msg IS NOT NULL THEN {_tagged('lower(msg)')} WHEN clips > 0 THEN 'clips' ELSE 'empty' END AS tag FROM v_attempts) t GROUP BY 1, 2")
def run_tally(spark, d):
    return ranking.run_tally(_t(spark, d, "v_attempts"))


_TAGS = "unnest(regexp_extract_all(text, '(^|[^A-Za-z0-9_])({}[{}]+)', 2))"
_FLOOR = f"""WITH l AS (SELECT campaign, doc_id, line_no, text, lower(text) AS low FROM v_rule_lines),
  s AS ({" UNION ALL ".join(f"SELECT campaign, '{name}' AS field, doc_id, line_no, text AS value FROM l WHERE {_holds(words, 'low')}" for name, words in patterns.SECTIONS.items())}),
  o AS (SELECT campaign, field, CAST(row_number() OVER (PARTITION BY campaign, field ORDER BY doc_id, line_no) AS BIGINT) AS ord, value FROM s),
  h AS (SELECT campaign, {_TAGS.format("#", "A-Za-z0-9_")} AS value FROM l), m AS (SELECT campaign, {_TAGS.format("@", "A-Za-z0-9_.")} AS value FROM l),
  t AS (SELECT campaign, trim(regexp_replace(x, '[^a-z0-9''+ -]', '', 'g')) AS value FROM (SELECT campaign, unnest(regexp_split_to_array(regexp_replace(low, '^[^:–-]*[:–-]', ''), '[,/;]| and | or ')) AS x FROM l WHERE {_holds(patterns.BANNED_MARKS, 'low')}) y),
  u AS (SELECT campaign, 'hashtags' AS field, value FROM h UNION SELECT campaign, 'required', 'hashtag: ' || value FROM h UNION SELECT campaign, 'mentions', value FROM m UNION SELECT campaign, 'required', 'mention: ' || value FROM m
        UNION SELECT campaign, 'required', 'watermark' FROM l WHERE contains(low, 'watermark') UNION SELECT campaign, 'required', 'disclosure' FROM l WHERE {_holds(patterns.DISCLOSURE_MARKS, 'low')}
        UNION SELECT campaign, 'banned_words', value FROM t WHERE length(value) >= 2 AND len(regexp_extract_all(value, '[^ ]+')) BETWEEN 1 AND 3 AND NOT regexp_matches(value, '^[0-9]+$')
        UNION SELECT campaign, 'banned_words', unnest([{", ".join(f"'{w}'" for w in DEFAULT_BANNED)}]) FROM l),
  floor AS (SELECT campaign, field, ord, value FROM o WHERE ord <= 40 UNION ALL SELECT campaign, field, CAST(0 AS BIGINT), value FROM u)"""


_NAMED = "SELECT source AS campaign, CASE WHEN doc_id % 40 = 7 THEN 'Our-Logo.PNG' ELSE 'x.png' END AS path FROM {}"


@query(f"""{_FLOOR} SELECT campaign, field, ord, value FROM floor
           UNION SELECT DISTINCT campaign, 'required', CAST(0 AS BIGINT), 'watermark' FROM ({_NAMED.format("documents")}) a WHERE regexp_matches(lower(path), 'watermark|logo') AND campaign IN (SELECT campaign FROM v_rule_lines)""")
def rules_floor(spark, d):
    lines, documents = _t(spark, d, "v_rule_lines", "documents")
    return board.rules_floor(lines, DEFAULT_BANNED, assets=spark.sql(_NAMED.format("{docs}"), docs=documents))


# One struct in two orders of its keys.
_STRUCT = """CASE WHEN line_no = 0 THEN concat('{"type": "tag", "detail": "', CAST(length(text) % 40 AS VARCHAR(20)), '"}') ELSE concat('{"detail":"', CAST(length(text) % 40 AS VARCHAR(20)), '","type":"tag"}') END"""


@query(f"""{_FLOOR}, e AS (SELECT campaign, doc_id * 100000 + line_no AS ord, text AS value FROM v_rule_lines WHERE line_no = 0),
           t0 AS (SELECT campaign, doc_id * 100000 + line_no AS ord, {_STRUCT} AS value FROM v_rule_lines WHERE line_no <= 1),
           b AS (SELECT campaign, 'required_elements' AS field, 1 AS origin, ord, value FROM t0 UNION ALL SELECT campaign, field, 0 AS origin, ord, value FROM floor UNION ALL SELECT campaign, 'payout_terms', 1, ord, value FROM e UNION ALL SELECT campaign, 'style_guidance', 1, ord, value FROM e),
           r AS (SELECT *, row_number() OVER (PARTITION BY campaign, field, CASE WHEN field = 'style_guidance' THEN '' WHEN field = 'required_elements' THEN concat(value->>'$.detail', '|', value->>'$.type') ELSE lower(trim(value)) END ORDER BY origin, ord, value) AS rn FROM b WHERE trim(value) <> '')
           SELECT campaign, field, origin, ord, value FROM r WHERE rn = 1""")
def rules_merge(spark, d):
    lines = _t(spark, d, "v_rule_lines")
    extra = lines.where("line_no = 0").select("campaign", F.explode(F.array(F.lit("payout_terms"), F.lit("style_guidance"))).alias("field"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("ord"), F.col("text").alias("value"))
    structs = lines.where("line_no <= 1").select("campaign", F.lit("required_elements").alias("field"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("ord"), F.expr(_STRUCT).alias("value"))
    return board.rules_merge(board.rules_floor(lines, DEFAULT_BANNED), extra.unionByName(structs), ["style_guidance"])


@query(f"""WITH r AS (SELECT v.*, coalesce(k.kind, 'other') AS kind, CASE WHEN size % 5 <> 0 THEN size END AS text_len FROM v_resources v LEFT JOIN (VALUES {_values(_KIND_ROWS)}) k(ext, kind) ON k.ext = lower(regexp_extract(v.path, '\\.([A-Za-z0-9]+)$', 1))),
           u AS (SELECT *, CASE kind WHEN 'footage' THEN 'probed video (' || CAST(duration_sec AS BIGINT) || ' s)' WHEN 'asset' THEN CASE WHEN regexp_matches(lower(path), '(guide|reference|safe|margin|template)') THEN 'applied as reference' ELSE 'watermark candidate' END
                    WHEN 'doc' THEN CASE WHEN coalesce(text_len, 0) > 0 THEN 'read + extracted (' || text_len || ' chars)' ELSE 'UNREAD: no text' END ELSE 'UNUSED: no handler' END AS usage FROM r),
           f AS (SELECT campaign, bool_or(source % 3 = 0) AS payout, bool_or(source % 4 = 0) AS submission FROM v_resources GROUP BY campaign),
           a AS (SELECT campaign, {", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for k, n in (("footage", "footage"), ("asset", "assets"), ("doc", "docs"), ("other", "other")))},
                   round(sum(CASE WHEN kind = 'footage' THEN duration_sec ELSE 0 END) / 3600, 2) AS footage_hours, CAST(sum(CASE WHEN prefix(usage, 'UNUSED') THEN 1 ELSE 0 END) AS BIGINT) AS unused, CAST(sum(CASE WHEN prefix(usage, 'UNREAD') THEN 1 ELSE 0 END) AS BIGINT) AS unread,
                   string_agg('not fully used: ' || path || ' (' || usage || ')', ' | ' ORDER BY ord) FILTER (prefix(usage, 'UN')) AS odd FROM u GROUP BY campaign)
           SELECT a.* EXCLUDE (odd), concat_ws(' | ', CASE WHEN NOT payout THEN 'no payout terms found' END, CASE WHEN NOT submission THEN 'no submission process found' END, odd) AS flags FROM a JOIN f USING (campaign)""")
def coverage_report(spark, d):
    r = _t(spark, d, "v_resources")
    found = [r.where(f"source % {k} = 0").select("campaign", F.lit(field).alias("field")) for k, field in ((3, "payout_terms"), (4, "submission_process"))]
    return board.coverage_report(r.withColumn("text_len", F.when(F.col("size") % 5 != 0, F.col("size"))), spark.createDataFrame(_KIND_ROWS, "ext string, kind string"), found[0].unionByName(found[1]))


# -- ordered analytics -------------------------------------------------------------------------------------------

_SPIKES = """SELECT source, CAST(min(sec) AS DOUBLE) AS start_s, CAST(max(sec) + 1 AS DOUBLE) AS end_s, CAST(arg_min(sec, -rms * 100000 + sec) AS DOUBLE) AS peak, round((max(rms) - max(mu)) / max(sd), 2) AS intensity
FROM (SELECT e.*, mu, sd, sec - row_number() OVER (PARTITION BY e.source ORDER BY sec) AS g FROM v_energy e JOIN (SELECT source, avg(rms) AS mu, stddev_pop(rms) AS sd FROM v_energy GROUP BY 1) s ON s.source = e.source WHERE sd > 0 AND rms > mu + 1.5 * sd) t GROUP BY source, g"""


@query(_SPIKES)
def spike_runs(spark, d):
    return series.spike_runs(_t(spark, d, "v_energy"), 1.5)


@query(f"SELECT * FROM ({_QUIET}) q WHERE end_s - start_s >= 1.5")
def silence_runs(spark, d):
    return series.silence_runs(_t(spark, d, "v_energy"), 5.0, 1.5)


@query(f"""WITH q AS (SELECT * FROM ({_QUIET}) z WHERE end_s - start_s >= 1.5),
           c AS (SELECT clip_id, source, start_s, end_s - start_s AS len FROM v_clips),
           r AS (SELECT c.clip_id, c.len, greatest(0.0, q.start_s - c.start_s) AS s, least(c.len, q.end_s - c.start_s) AS e FROM c JOIN q ON q.source = c.source AND q.start_s < c.start_s + c.len AND q.end_s > c.start_s
                 UNION ALL SELECT clip_id, len, len, len FROM c),
           g AS (SELECT clip_id, coalesce(max(e) OVER (PARTITION BY clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS a, s AS b FROM r),
           k AS (SELECT * FROM g WHERE b - a > 0.1)
           SELECT clip_id, round(a, 3) AS a, round(b, 3) AS b FROM k UNION ALL SELECT clip_id, 0.0, round(len, 3) FROM c WHERE clip_id NOT IN (SELECT clip_id FROM k)""")
def keep_intervals(spark, d):
    clips, energy = _t(spark, d, "v_clips", "v_energy")
    return intervals.keep_intervals(series.silence_runs(energy, 5.0, 1.5), clips)


@query("""WITH p AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY clip_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM v_played)
          SELECT clip_id, k, a, least(b, a + 12 - s) AS b FROM p WHERE s < 12 OR k = 0""")
def cap_cumulative(spark, d):
    return intervals.cap_cumulative(_t(spark, d, "v_played"))


@query("""WITH p AS (SELECT *, coalesce(sum(duration_sec) OVER (PARTITION BY campaign ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM v_resources)
          SELECT campaign, ord, CAST(duration_sec AS DOUBLE) AS duration_sec FROM p WHERE s < 3600""")
def budget_admit(spark, d):
    return ranking.budget_admit(_t(spark, d, "v_resources"))


@query("""WITH p AS (SELECT *, coalesce(sum(clips) OVER (PARTITION BY walk ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM v_attempts)
          SELECT walk, attempt, clips FROM p WHERE s < 10 AND attempt <= 5""")
def batch_floor_walk(spark, d):
    return ranking.batch_floor_walk(_t(spark, d, "v_attempts"))


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) t WHERE rn <= 3")
def daily_quota_admit(spark, d):
    return ranking.daily_quota_admit(_t(spark, d, "events"))


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) t WHERE rank <= 3")
def top_k_per_channel(spark, d):
    return ranking.top_k_per_channel(_t(spark, d, "events"))


@query("""SELECT id, rank, concat_ws('_', 'clip', lpad(CAST(rank AS VARCHAR), 2, '0'), lpad(CAST(CAST(round(intensity) AS BIGINT) AS VARCHAR), 3, '0'), trim(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '-')) AS name
          FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY intensity DESC, id) AS rank FROM v_moments) t""")
def rank_and_name(spark, d):
    return ranking.rank_and_name(_t(spark, d, "v_moments"))


@query("""WITH a AS (SELECT *, lag(end_s) OVER w AS pe, lag(regexp_matches(word, '[.!?]$')) OVER w AS pf FROM v_words WINDOW w AS (PARTITION BY source ORDER BY start_s, seg_no, word_no)),
          b AS (SELECT *, CAST(sum(CASE WHEN pe IS NULL OR start_s - pe > 0.35 OR pf THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start_s, seg_no, word_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a),
          c AS (SELECT *, row_number() OVER (PARTITION BY source, run ORDER BY start_s, seg_no, word_no) - 1 AS p, count(*) OVER (PARTITION BY source, run) AS n FROM b)
          SELECT source, seg_no, word_no, run, CAST(least(p // 3, (CASE WHEN n % 3 = 1 AND n >= 4 THEN n // 3 ELSE (n + 2) // 3 END) - 1) AS BIGINT) AS line FROM c""")
def speech_lines(spark, d):
    return board.speech_lines(_t(spark, d, "v_words"))


@query("""WITH s AS (SELECT source, seg_no, lead(min(start_s)) OVER (PARTITION BY source ORDER BY seg_no) AS af FROM v_words GROUP BY source, seg_no),
          w AS (SELECT v.*, lead(v.start_s) OVER (PARTITION BY v.source, v.seg_no ORDER BY word_no) AS nx, s.af FROM v_words v JOIN s ON s.source = v.source AND s.seg_no = v.seg_no)
          SELECT source, seg_no, word_no, round(greatest(start_s + 0.05, coalesce(nx, greatest(end_s, least(end_s + 0.25, coalesce(af - 0.03, end_s + 0.25))))), 4) AS shown_until FROM w""")
def event_end_times(spark, d):
    return board.event_end_times(_t(spark, d, "v_words"))


@query("""WITH a AS (SELECT *, max(end_s) OVER (PARTITION BY source ORDER BY start_s, end_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v_moments),
          b AS (SELECT *, CAST(sum(CASE WHEN r IS NULL OR start_s - r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start_s, end_s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM a)
          SELECT source, island, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM b GROUP BY 1, 2""")
def merge_islands(spark, d):
    return intervals.merge_islands(_t(spark, d, "v_moments"), 1.0)


# -- selection ---------------------------------------------------------------------------------------------------

_SCORE = "3 * least(len(regexp_extract_all(text, '[A-Za-z'']+')), 80) / 80.0 + 2 * least(len(regexp_extract_all(text, '[A-Za-z'']+')) / greatest(1.0, end_s - start_s), 4.0) / 4 + least(" + " + ".join(f"len(regexp_extract_all(lower(text), '\\b({m})\\b'))" for m in MARKERS) + " + len(regexp_extract_all(text, '\\?')), 8) + least(intensity, 12.0) / 12"


@query(f"SELECT id, round({_SCORE}, 4) AS score FROM v_moments ORDER BY score DESC, id LIMIT 400")
def content_rank_topn(spark, d):
    return ranking.content_rank_topn(_t(spark, d, "v_moments"), MARKERS)


@query("""WITH RECURSIVE o AS (SELECT id, source, start_s, round(intensity, 4) AS score, row_number() OVER (PARTITION BY source ORDER BY round(intensity, 4) DESC, id) AS rn FROM v_moments),
          r AS (SELECT source, 1::BIGINT AS rn, [start_s] AS taken, true AS ok FROM o WHERE rn = 1
                UNION ALL SELECT o.source, o.rn, CASE WHEN len(list_filter(r.taken, lambda t: abs(t - o.start_s) < 30)) = 0 THEN list_append(r.taken, o.start_s) ELSE r.taken END, len(list_filter(r.taken, lambda t: abs(t - o.start_s) < 30)) = 0
                FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1)
          SELECT o.id, o.source, o.start_s, o.score FROM o JOIN r ON r.source = o.source AND r.rn = o.rn WHERE r.ok ORDER BY score DESC, id LIMIT 50""")
def spread_topk(spark, d):
    return ranking.spread_topk(_t(spark, d, "v_moments"), 30, 50)


@query("""SELECT source, batch, count(*) AS n, count(*) - count(scored) AS open, min(id) AS first_id FROM (SELECT m.*, s.id AS scored,
          CAST((row_number() OVER (PARTITION BY source ORDER BY intensity DESC, m.id) - 1) // 3 AS BIGINT) AS batch FROM v_moments m LEFT JOIN (SELECT DISTINCT id FROM v_moments WHERE type = 'speech') s ON s.id = m.id) t
          GROUP BY 1, 2 HAVING count(*) > count(scored)""")
def score_batches(spark, d):
    moments = _t(spark, d, "v_moments")
    return ranking.score_batches(moments, 3, moments.where("type = 'speech'"))


@query("""WITH a AS (SELECT *, lower(path) AS name, CASE WHEN lower(path) = 'f92' THEN 0 WHEN contains(lower(path), 'f92') THEN 1 ELSE 2 END AS tier FROM v_resources WHERE regexp_matches(lower(path), '\\.(png|pdf)$'))
          SELECT campaign, path FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY tier, CASE WHEN tier < 2 THEN ord END, CASE WHEN contains(name, '9') THEN 0 ELSE 1 END, CASE WHEN suffix(name, '.png') THEN 0 ELSE 1 END, name, ord) AS rn
          FROM a WHERE tier < 2 OR NOT contains(name, '13')) t WHERE rn = 1""")
def priority_pick(spark, d):
    return ranking.priority_pick(_t(spark, d, "v_resources"), wanted="f92", reference=("13",))


@query("""WITH v AS (SELECT item, format_id, size, row_number() OVER (PARTITION BY item ORDER BY height DESC, tbr DESC, size DESC, format_id DESC) AS rn FROM v_formats WHERE height <= 1080 AND NOT has_audio),
          a AS (SELECT item, format_id, size, row_number() OVER (PARTITION BY item ORDER BY tbr DESC, size DESC, format_id DESC) AS rn FROM v_formats WHERE height IS NULL AND has_audio),
          c AS (SELECT item, format_id, size, row_number() OVER (PARTITION BY item ORDER BY height DESC, tbr DESC, size DESC, format_id DESC) AS rn FROM v_formats WHERE height <= 1080 AND has_audio),
          i AS (SELECT item, count(height) AS wv, sum(CASE WHEN height <= 1080 THEN 1 ELSE 0 END) AS un FROM v_formats GROUP BY item)
          SELECT i.item, CASE WHEN v.item IS NOT NULL AND a.item IS NOT NULL THEN v.format_id ELSE c.format_id END AS video, CASE WHEN v.item IS NOT NULL THEN a.format_id END AS audio,
          round(CASE WHEN v.item IS NOT NULL AND a.item IS NOT NULL THEN 2.2::DOUBLE * (v.size + a.size) ELSE 1.5::DOUBLE * c.size END, 4) AS required,
          CASE WHEN wv = 0 THEN 'no video' WHEN un = 0 THEN 'none under the cap' WHEN NOT (v.item IS NOT NULL AND a.item IS NOT NULL) AND c.item IS NULL THEN 'no audio' ELSE '' END AS reason
          FROM i LEFT JOIN v ON v.item = i.item AND v.rn = 1 LEFT JOIN a ON a.item = i.item AND a.rn = 1 LEFT JOIN c ON c.item = i.item AND c.rn = 1""")
def best_variant_pick(spark, d):
    return ranking.best_variant_pick(_t(spark, d, "v_formats"))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame ORDER BY CASE WHEN class = 'person' THEN 0 ELSE 1 END, w * h DESC, box_id) AS rn FROM v_boxes)
          SELECT clip_id, frame, round(cx, 4) AS cx, round(CASE WHEN class = 'person' THEN cy ELSE cy + 0.9::DOUBLE * sqrt(w * h) END, 4) AS cy, round(CASE WHEN class = 'person' THEN w ELSE 2.2::DOUBLE * sqrt(w * h) END, 4) AS w, round(CASE WHEN class = 'person' THEN h ELSE 3.2::DOUBLE * sqrt(w * h) END, 4) AS h FROM b WHERE rn = 1""")
def primary_per_frame(spark, d):
    return ranking.primary_per_frame(_t(spark, d, "v_boxes"))


_SIGNAL = patterns.bounded(r"\b(stream|streamer|irl|vlog)\b")


def _best(weight: str, where: str, mode: str) -> str:
    return f"""SELECT '{mode}' AS mode, * FROM (SELECT id, round(CAST(composite AS DOUBLE), 6) AS composite, CAST(core_known AS BIGINT) AS core_known, CAST(pre_score AS BIGINT) AS pre_score, round(CAST(composite AS DOUBLE) * {weight}, 6) AS effective
      FROM v_board WHERE {_RANKABLE} AND {where}) t WHERE effective IS NOT NULL ORDER BY effective DESC, core_known DESC, pre_score DESC, id LIMIT 100"""


_HAS_CATEGORY = "coalesce({0} = category OR {0} = second_category, {0} = category)"


@query(f"""SELECT * FROM ({_best("1.0::DOUBLE", "true", "all")}) UNION ALL SELECT * FROM ({_best("1.0::DOUBLE", "(upper(trim(lane)) = 'BRAND#7' OR coalesce(upper(trim(second_lane)) = 'BRAND#7', false))", "lane")})
           UNION ALL SELECT * FROM ({_best("CASE WHEN " + _HAS_CATEGORY.format("'economy'") + " THEN 1.0::DOUBLE WHEN " + _HAS_CATEGORY.format("'promo'") + " AND regexp_matches(lower(concat_ws(' ', name, rules_text)), '" + _SIGNAL + "') THEN 0.6::DOUBLE END", "true", "rescued")})""")
def board_rank(spark, d):
    b = _t(spark, d, "v_board")
    modes = {"all": board.board_rank(b), "lane": board.board_rank(b, lane="brand#7"), "rescued": board.board_rank(b, category="economy", rescued=("promo", _SIGNAL, 0.6))}
    return functools.reduce(lambda x, y: x.unionByName(y), [rows.withColumn("mode", F.lit(name)) for name, rows in modes.items()])


@query(f"""WITH k AS (SELECT id, row_number() OVER (ORDER BY composite DESC, core_known DESC, pre_score DESC, id) AS rank FROM ({_RANKED}) t QUALIFY rank <= 10),
           c AS (SELECT k.id, k.rank, CASE WHEN b.lang <> 'en' AND b.lang_conf <> 'low' THEN 'language' ELSE {_REASON} END AS reason FROM k JOIN v_board b USING (id))
           SELECT id, rank, reason FROM c WHERE rank <= coalesce((SELECT min(rank) FROM c WHERE reason = ''), 10)""")
def walk_first_pass(spark, d):
    return board.walk_first_pass(_t(spark, d, "v_board"))


# -- sets and transforms -----------------------------------------------------------------------------------------


@query(f"""WITH p AS ({_PEAK}), s AS ({_SPIKES}), u AS (SELECT source, 'audio_spike' AS type, start_s, end_s, peak FROM s UNION ALL SELECT g.source, 'speech', g.start_s, g.end_s, CAST(p.peak AS DOUBLE) FROM v_segments g JOIN p ON p.source = g.source AND p.seg_no = g.seg_no)
           SELECT 'm' || source || '_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY type, start_s, end_s) - 1 AS VARCHAR), 4, '0') AS id, source, type, start_s, end_s, peak FROM u""")
def moments_union(spark, d):
    segments, energy = _t(spark, d, "v_segments", "v_energy")
    return series.moments_union(segments, series.spike_runs(energy, 1.5), intervals.energy_peak(segments, energy))


@query("SELECT dst, min(src) AS first_src, count(*) AS n FROM v_links GROUP BY dst")
def ordered_distinct(spark, d):
    return board.ordered_distinct(_t(spark, d, "v_links"))


@query("WITH t AS (SELECT id, list_append(string_split(category, ' '), lower(trim(lane))) AS x FROM v_board), u AS (SELECT id, list_reduce(x, lambda a, y: a || ',' || y) AS tags, list_contains(x, 'economy') AS ok FROM t) SELECT id, tags FROM u WHERE ok")
def tag_membership(spark, d):
    return board.tag_membership(_t(spark, d, "v_board"), "economy")


_PLAIN = r"regexp_replace(text, '[ \t\n\r]+', ' ', 'g')"
for _of, _to in patterns.PUNCTUATION:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_of}', '{_to.replace(chr(39), 2 * chr(39))}', 'g')"


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace({_PLAIN}, ' {{2,}}', ' ', 'g'), ' ') AS x FROM documents),
          w AS (SELECT doc_id, x, list_transform(regexp_extract_all(x, '{patterns.TITLE_WORD}'), lambda w: struct_pack(w := w, h := length(regexp_extract(w, '^[^\p{{L}}\p{{N}}]*')))) AS p FROM t)
          SELECT doc_id, CASE WHEN x = '' THEN 'clip' ELSE array_to_string(list_transform(p, lambda q: CASE WHEN substr(q.w, q.h + 1, 1) = 'ß' THEN q.w
            ELSE substr(q.w, 1, q.h) || upper(substr(q.w, q.h + 1, 1)) || substr(q.w, q.h + 2) END), '') END AS title FROM w""".replace("\\\\", "\\"))
def text_normalize(spark, d):
    return text.text_normalize(_t(spark, d, "documents"))


@query(r"""WITH u AS (SELECT DISTINCT page_id, regexp_replace(url, '[.,);\]}''"]+$', '') AS url FROM v_urls)
          SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY url) - 1 AS pos, url FROM u WHERE regexp_matches(url, '^https?://')""")
def harvest_urls(spark, d):
    return text.harvest_urls(_t(spark, d, "v_urls"))


_ONE_VIDEO, _CHANNEL_PATH, _VIDEO_HOST = (_holds(x, "low") for x in (patterns.ONE_VIDEO, patterns.CHANNEL_PATHS, patterns.VIDEO_HOSTS))


@query(rf"""WITH b AS (SELECT *, lower(url) AS low, split_part(lower(url), '?', 1) AS path FROM v_urls),
          m AS (SELECT *, regexp_matches(low, '^https?:') AS web, contains(low, 'drive.google.com') AND contains(low, 'folder') AS folder, {_holds(["docs.google.com", "drive.google.com"], "low")} AS shared,
                  {_holds(patterns.CHANNEL_HOSTS, "low")} AND NOT {_ONE_VIDEO} AND ({_CHANNEL_PATH} OR regexp_matches(low, '{patterns.CHANNEL_ENDS}')) AS chan, {_VIDEO_HOST} AS video FROM b)
          SELECT page_id, url, CASE WHEN NOT web THEN 'other' WHEN folder THEN 'drive_folder' WHEN shared THEN 'gdoc' WHEN chan THEN 'channel' WHEN video THEN 'vod' WHEN regexp_matches(path, '{patterns.FILE_ENDS}') THEN 'file' ELSE 'site' END AS kind,
                 CASE WHEN NOT web THEN CASE WHEN regexp_matches(low, '{patterns.DOC_ENDS}') THEN 'local' END WHEN video OR folder THEN NULL WHEN shared THEN 'gdoc' WHEN regexp_matches(path, '{patterns.DOC_ENDS}') THEN 'web'
                      WHEN contains(low, 'whop.com') AND (contains(path, '/discover') OR contains(path, '/search')) THEN NULL WHEN {_holds(patterns.RULE_LABELS, "lower(label)")} OR {_holds(patterns.RULE_PATHS, "path")} THEN 'web' END AS rules FROM m""")
def link_kind(spark, d):
    return text.link_kind(_t(spark, d, "v_urls"))


@query("""WITH h AS (SELECT id, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) AS h FROM v_moments) SELECT id, h % 7 AS bucket, (h // 7) % 5 AS second,
          CAST((CAST('0x' || substr(md5(id), 32, 1) AS BIGINT) + 4 * list_sum(list_transform(range(1, 32), lambda i: CAST('0x' || substr(md5(id), i, 1) AS BIGINT)))) % 12 AS BIGINT) AS twelfth FROM h""")
def hash_assign(spark, d):
    return text.hash_assign(_t(spark, d, "v_moments"))


@query("""WITH m AS (SELECT id, start_s - 4 AS s, end_s + 4 AS e, coalesce(peak, (start_s + end_s) / 2) AS mid FROM v_moments),
          b AS (SELECT id, CASE WHEN e - s > 14 THEN mid - 7 WHEN e - s < 12 THEN s - (12 - (e - s)) / 2 ELSE s END AS a, CASE WHEN e - s > 14 THEN mid + 7 WHEN e - s < 12 THEN e + (12 - (e - s)) / 2 ELSE e END AS z FROM m)
          SELECT id, round(greatest(0.0, least(a, 90.0)), 2) AS clip_start, round(greatest(greatest(0.0, least(a, 90.0)) + 1, least(z, 90.0)), 2) AS clip_end FROM b""")
def clip_bounds(spark, d):
    return intervals.clip_bounds(_t(spark, d, "v_moments"), cmax=14)


_WAIT_SPAN = r"regexp_extract(low, 'try again in ([0-9hms.\s]+)', 1)"
_WAIT_PARTS = rf"regexp_extract_all({_WAIT_SPAN}, '[0-9.]+\s*[hms]')"
_UNIT = "CASE suffix(y, 'h') WHEN true THEN 3600 ELSE CASE suffix(y, 'm') WHEN true THEN 60 ELSE 1 END END"


@query(rf"""WITH e AS (SELECT event_id, lower(coalesce(msg, '')) AS low FROM v_errors),
          w AS (SELECT *, CASE WHEN len({_WAIT_PARTS}) > 0 THEN list_sum(list_transform({_WAIT_PARTS}, lambda y: coalesce(try_cast(regexp_extract(y, '^[0-9.]+') AS DOUBLE), 0) * {_UNIT}))
                  ELSE coalesce(try_cast(nullif(regexp_extract(low, 'retry_delay\s*\{{\s*seconds:\s*([0-9]+)', 1), '') AS DOUBLE), try_cast(nullif(regexp_extract(low, 'retry[\s_-]*after["''\s:]*([0-9]+)', 1), '') AS DOUBLE)) END AS wait,
                  try_cast(nullif(regexp_extract(low, 'status code[:\s]+([0-9]{{3}})', 1), '') AS INTEGER) AS code FROM e),
          m AS (SELECT *, {_holds(patterns.RATE_MARKS, "low")} AS lim, {_holds(patterns.DAY_MARKS, "low")} AS dy, {_holds(patterns.MINUTE_MARKS, "low")} AS mn FROM w)
          SELECT event_id, CASE WHEN NOT lim THEN 'error' WHEN dy AND NOT mn THEN 'daily' WHEN mn AND NOT dy THEN 'minute' WHEN wait > 90 THEN 'daily' ELSE 'minute' END AS rate, round(CASE WHEN lim THEN wait END, 4) AS wait_s,
                 {_holds(["model_not_found", "modelnotfound"], "low")} OR (contains(low, '404') AND NOT contains(low, '429')) OR (contains(low, 'model') AND {_holds(patterns.GONE_MARKS, "low")}) AS dead_model,
                 CASE WHEN code IN (401, 403, 404) THEN 'permission' WHEN code = 429 OR code BETWEEN 500 AND 599 THEN 'throttle' WHEN {_holds(patterns.SHARE_BUSY, "low")} THEN 'throttle' WHEN {_holds(patterns.SHARE_DENIED, "low")} THEN 'permission' ELSE 'unknown' END AS share,
                 {_holds(patterns.BLOCK_MARKS, "low")} AS blocked, {_tagged("low")} AS reason FROM m""")
def log_classify(spark, d):
    return text.log_classify(_t(spark, d, "v_errors"))


_PREFACED = " OR ".join("prefix(lower(line), '" + w.replace("'", "''") + "')" for w in patterns.PREFACES)


@query(rf"""WITH s AS (SELECT event_id, regexp_replace(regexp_replace(msg, '^\s*```[a-zA-Z0-9]*\s*|^\s+', ''), '\s*```\s*$|\s+$', '') AS s FROM v_errors),
          o AS (SELECT event_id, s, regexp_extract(s, '(?s)\[.*\]') AS o FROM s),
          a AS (SELECT event_id, s, CASE WHEN json_valid(o) THEN CAST(json(o) AS JSON[]) ELSE [] END AS arr FROM o),
          r AS (SELECT event_id, unnest(arr) AS r, generate_subscripts(arr, 1) AS k FROM a),
          j AS (SELECT event_id, k, CASE WHEN json_type(r) = 'OBJECT' THEN r->>'$.id' END AS id, CASE WHEN json_type(r) = 'OBJECT' AND json_type(r->'$.score') IN ('UBIGINT', 'BIGINT') THEN CAST(r->>'$.score' AS BIGINT) END AS score,
                       CASE WHEN json_type(r) <> 'OBJECT' THEN trim(r->>'$', chr(9) || chr(10) || chr(13) || ' ') END AS line FROM r),
          g AS (SELECT * FROM j WHERE line IS NULL OR line <> ''),
          x AS (SELECT event_id, unnest(string_split(s, chr(10))) AS x, generate_subscripts(string_split(s, chr(10)), 1) AS k FROM a WHERE event_id NOT IN (SELECT event_id FROM g)),
          l AS (SELECT event_id, k, trim(rtrim(trim(trim(trim(regexp_replace(trim(x), '^\s*([-*•]|[0-9]+[.)])\s*', '')), '"'), ''''), ',')) AS line FROM x),
          u AS (SELECT event_id, k, id, score, line FROM g UNION ALL SELECT event_id, k, NULL, NULL, line FROM l WHERE length(line) > 1 AND NOT ({_PREFACED}))
          SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY k) - 1 AS place, id, score, line FROM u""")
def json_array_repair(spark, d):
    return text.json_array_repair(_t(spark, d, "v_errors"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments from segments and energy, without filler, ranked by content."""
    segments = views.table(spark, sf_dir, "v_segments")
    moments = moments_union(spark, sf_dir).join(segments.select("source", "start_s", "end_s", "text"), ["source", "start_s", "end_s"], "left")
    rows = moments.select("id", "source", "type", "start_s", "end_s", F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("intensity"))
    return ranking.content_rank_topn(text.filler_kill(rows, FILLER), MARKERS)


@query()
def flagship_moments(spark, d):
    return flagship(spark, d)


def queries() -> dict[str, Query]:
    from tidemark.plans import briefs, campaigns  # noqa: F401  register their queries
    from tidemark.streaming import replays

    return _QUERIES | replays.QUERIES


def oracle_sql() -> dict[str, str]:
    from tidemark.plans import briefs, campaigns  # noqa: F401
    from tidemark.streaming import replays

    return _ORACLES | {k: views.duckdb(v) for k, v in replays.ORACLES.items()}
