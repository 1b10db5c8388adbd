"""More registered queries: campaigns, candidate lines, timelines, folds and plug points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import plugs
from tidemark.operators import campaigns, captions, folds, matcher, patterns, ranking, timeline
from tidemark.plans.catalog import GENERIC, _ASKS, _HOOKED, _WORDS, _bound, _has, _t, _values, query
from tidemark.streaming.replays import _folder

# Term lists of the queries; parameters of the operators.
DULL = ["license", "token"]
DEFAULT_TAGS = ["shorts", "clips", "the"]
LEXICON = ["licensed", "under", "released"]
ROOTS = ["licens", "releas", "permit", "report"]
SUFFIXES = ["e", "ed", "ing", "s", "es"]
ALIASES = [("promo", "promotion"), ("economy", "economy"), ("standard", "standard"), ("small", "size-s"), ("medium", "size-m"), ("large", "size-l")]
REQUIRED, NEGATED, MENTION = "licens|token", "licensed under|no token", "released|copyright"
PHRASE = "under (?:the )?([a-z]+)"


def _quoted(words):
    return ", ".join(f"'{w}'" for w in words)


def _spread(score: str, where: str, apart: float, n: int) -> str:
    return f"""WITH RECURSIVE o AS (SELECT id, source, start_s, round({score}, 4) AS score, row_number() OVER (PARTITION BY source ORDER BY round({score}, 4) DESC, id) AS rn FROM v_moments WHERE {where}),
          r AS (SELECT source, 1::BIGINT AS rn, [start_s] AS taken, true AS ok FROM o WHERE rn = 1
                UNION ALL SELECT o.source, o.rn, CASE WHEN len(list_filter(r.taken, lambda t: abs(t - o.start_s) < {apart})) = 0 THEN list_append(r.taken, o.start_s) ELSE r.taken END, len(list_filter(r.taken, lambda t: abs(t - o.start_s) < {apart})) = 0
                FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1)
          SELECT o.id, o.source, o.start_s, o.score FROM o JOIN r ON r.source = o.source AND r.rn = o.rn WHERE r.ok ORDER BY score DESC, id LIMIT {n}"""


# -- outputs and links -------------------------------------------------------------------------------------------


@query("SELECT id, type, source, start_s, end_s FROM v_moments")
def sink_outputs(spark, d):
    rows = _t(spark, d, "v_moments").select("id", "source", "start_s", "end_s", "type")
    return campaigns.sink_outputs(rows, f"{_folder(spark)}/{uuid.uuid4().hex}", "type").select("id", "type", "source", "start_s", "end_s")


@query(r"""SELECT DISTINCT source, lower(path) AS path, false AS safe_margin FROM v_resources r WHERE regexp_matches(lower(path), '\.(mp4|mov|mkv)$')
          AND NOT EXISTS (SELECT 1 FROM v_resources m WHERE m.ord % 3 <> 0 AND m.source = r.source AND lower(m.path) = lower(r.path))""")
def discover_unlisted(spark, d):
    r = _t(spark, d, "v_resources")
    return campaigns.discover_unlisted(r, r.where("ord % 3 <> 0"))


@query(r"""WITH f AS (SELECT campaign, path, min((CASE WHEN safe_margin THEN 0 ELSE 1 END) * 1000000 + ord) AS o FROM v_resources WHERE safe_margin OR regexp_matches(lower(path), '\.(mp4|mov|mkv)$') GROUP BY 1, 2)
          SELECT campaign, string_agg(path, ',' ORDER BY o) AS links FROM f GROUP BY campaign""")
def links_union(spark, d):
    return campaigns.links_union(_t(spark, d, "v_resources"))


@query("""WITH RECURSIVE w(page_id, hop) AS (SELECT page_id, 0::BIGINT FROM pages WHERE contains(html, '<html lang="de"') UNION SELECT b.src, w.hop + 1 FROM w JOIN v_links a ON a.src = w.page_id JOIN v_links b ON b.dst = a.dst WHERE w.hop < 3)
          SELECT page_id, min(hop) AS hop FROM w GROUP BY page_id""")
def link_frontier(spark, d):
    # A page leads to its links and a link to all pages with it, so that one on many pages is followed without pairing them.
    links, pages = _t(spark, d, "v_links", "pages")
    name = lambda c: F.concat(F.lit("p"), c)
    edges = links.select(name("src").alias("src"), "dst").unionByName(links.select(F.col("dst").alias("src"), name("src").alias("dst")))
    seeds = pages.where(F.col("html").contains('<html lang="de"')).select(name("page_id").alias("page_id"))
    reached = campaigns.link_frontier(edges, seeds, hops=6).where(F.col("page_id").startswith("p"))
    return reached.select(F.substring("page_id", 2, 20).cast("long").alias("page_id"), (F.col("hop") / 2).cast("long").alias("hop"))


@query(f"SELECT b.id, a.tag FROM v_board b JOIN (VALUES {_values(ALIASES)}) a(alias, tag) ON a.alias = string_split(b.category, ' ')[1]")
def alias_resolve(spark, d):
    return campaigns.alias_resolve(_t(spark, d, "v_board"), spark.createDataFrame(ALIASES, "alias string, tag string"))


_PRINTS = "SELECT src AS id, string_agg(DISTINCT CAST(dst AS VARCHAR), '|' ORDER BY CAST(dst AS VARCHAR)) AS f FROM v_links {} GROUP BY src"


@query(f"""WITH n AS ({_PRINTS.format("")}), c AS ({_PRINTS.format("WHERE (src + length(dst)) % 11 <> 0")}),
           m AS (SELECT src AS id, CASE WHEN src % 3 = 0 THEN NULL WHEN count(*) > 2 THEN 'pass' ELSE 'skip' END AS v FROM v_links GROUP BY src)
           SELECT n.id, CASE WHEN coalesce(c.f = n.f, false) THEN CASE WHEN n.id % 2 = 0 THEN 'pass' ELSE 'skip' END ELSE coalesce(m.v, 'pass') END AS verdict,
                  CASE WHEN coalesce(c.f = n.f, false) THEN 'cache' WHEN m.v IS NOT NULL THEN 'measured' ELSE 'default' END AS origin FROM n LEFT JOIN c USING (id) LEFT JOIN m USING (id)""")
def sticky_verdict(spark, d):
    links = _t(spark, d, "v_links")
    cached = campaigns.fingerprints(links.where("(src + length(dst)) % 11 <> 0")).withColumn("verdict", F.expr("CASE WHEN id % 2 = 0 THEN 'pass' ELSE 'skip' END"))
    measured = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).select("id", F.expr("CASE WHEN id % 3 = 0 THEN NULL WHEN n > 2 THEN 'pass' ELSE 'skip' END").alias("verdict"))
    return campaigns.sticky_verdict(links, cached, measured)


@query(r"""WITH v AS (SELECT *, regexp_matches(lower(path), '\.(mp4|mov|mkv)$') AS video, CASE WHEN size % 6 <> 0 THEN duration_sec END AS seconds FROM v_resources),
          r AS (SELECT *, row_number() OVER (PARTITION BY campaign, source ORDER BY CASE WHEN video THEN 0 ELSE 1 END, ord) AS rn FROM v),
          s AS (SELECT campaign, bool_or(source % 97 = 0 OR (video AND rn <= 40 AND seconds IS NOT NULL AND seconds >= 2400)) AS raw, sum(CASE WHEN video AND rn <= 40 AND seconds IS NOT NULL THEN 1 ELSE 0 END) AS m,
                sum(CASE WHEN video AND rn <= 40 AND seconds IS NULL THEN 1 ELSE 0 END) AS u, bool_and(source % 9 <> 0) AS l FROM r GROUP BY campaign)
          SELECT campaign, CASE WHEN coalesce(raw, false) THEN 'pass' WHEN m >= greatest(1, u) AND l THEN 'skip' ELSE 'unmeasurable' END AS verdict FROM s""")
def preedited_verdict(spark, d):
    r = _t(spark, d, "v_resources").withColumn("duration_sec", F.when(F.col("size") % 6 != 0, F.col("duration_sec")))
    return campaigns.preedited_verdict(r.withColumn("raw_channel", F.col("source") % 97 == 0).withColumn("listed", F.col("source") % 9 != 0), raw=2400)


# -- rules and policies ------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT doc_id, regexp_matches(lower(text), '{REQUIRED}') AS m, regexp_matches(lower(text), '{NEGATED}') AS n, regexp_matches(regexp_replace(lower(text), '{NEGATED}', ' ', 'g'), '{REQUIRED}') AS s,
                  regexp_matches(lower(text), '{MENTION}') AS b FROM documents)
           SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'on' WHEN m AND NOT n THEN 'on' ELSE 'off' END AS decision,
                  CASE WHEN doc_id % 50 = 0 THEN false WHEN m AND n THEN s WHEN NOT m AND NOT n THEN b ELSE false END AS ambiguous FROM p""")
def policy_decision(spark, d):
    docs = _t(spark, d, "documents")
    return campaigns.policy_decision(docs, docs.where("doc_id % 50 = 0").select("doc_id", F.lit("on").alias("prior")), REQUIRED, NEGATED, MENTION)


@query(f"""WITH p AS (SELECT DISTINCT campaign, unnest(regexp_extract_all(lower(text), '{PHRASE}', 1)) AS p FROM v_rule_lines),
           x AS (SELECT campaign, unnest(list_concat([p], CASE WHEN suffix(p, 'e') THEN [p || 's', p || 'd', substr(p, 1, length(p) - 1) || 'ing'] WHEN regexp_matches(p, '(s|x|z|ch|sh)$') THEN [p || 'es'] ELSE [p || 's', p || 'ed', p || 'ing'] END)) AS term FROM p)
           SELECT DISTINCT campaign, term FROM x""")
def restriction_expand(spark, d):
    return campaigns.restriction_expand(_t(spark, d, "v_rule_lines"), PHRASE)


# -- candidate lines ---------------------------------------------------------------------------------------------


_POINTS = f"""CASE WHEN regexp_matches(text, '{patterns.EMOJI}') THEN 2 ELSE 0 END + CASE WHEN {_ASKS} OR {_has(patterns.HOOKS["disbelief"])} THEN 2 ELSE 0 END - CASE WHEN {_has(patterns.DESCRIPTIVE)} THEN 6 ELSE 0 END
  - CASE WHEN {_has(patterns.GIVEAWAY)} AND NOT {_ASKS} THEN 5 ELSE 0 END {"".join(f" + CASE WHEN {_has(h)} THEN 4 ELSE 0 END" for h in patterns.HOOKS.values())}
  + CASE WHEN {_WORDS} <= 6 THEN 2 ELSE 0 END - CASE WHEN {_WORDS} > 8 THEN 8 ELSE 0 END - CASE WHEN suffix(trim(text), '.') THEN 1 ELSE 0 END
  + CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(text, '[^a-z]', '', 'g')) > 0.85::DOUBLE * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 1 ELSE 0 END"""


@query(f"""WITH s AS (SELECT clip_id, pos, array_to_string(regexp_extract_all(lower(text), '[a-z'']+')[1:2], ' ') AS o, {_POINTS} AS score FROM v_candidates),
           b AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, pos) AS rn FROM s), t AS (SELECT * FROM b WHERE rn = 1),
           v AS (SELECT b.clip_id, arg_min(b.pos, b.rn) AS pos FROM b JOIN t ON t.clip_id = b.clip_id AND t.o <> b.o GROUP BY 1)
           SELECT t.clip_id, t.pos AS best_pos, CAST(t.score AS BIGINT) AS best_score, v.pos AS variant_pos FROM t LEFT JOIN v ON v.clip_id = t.clip_id""")
def caption_score_top2(spark, d):
    return captions.caption_score_top2(_t(spark, d, "v_candidates"))


@query(f"""WITH t AS (SELECT clip_id, pos, NOT regexp_matches(lower(text), '{_bound(DULL)}') AS c, {_HOOKED} AND {_WORDS} <= 8 AS h, length(text) > 40 AS g, regexp_matches(lower(text), '[a-z]{{9,}}') AS s, {_has(patterns.FILLER)} AS x FROM v_candidates),
           r AS (SELECT clip_id, pos, CASE WHEN c AND h AND g AND s THEN 1 WHEN c AND g AND s THEN 2 WHEN c AND h AND g THEN 4 WHEN c AND h THEN 5 WHEN c THEN 6 END AS tier FROM t)
           SELECT clip_id, pos, CAST(tier AS BIGINT) AS tier FROM (SELECT *, min(tier) OVER (PARTITION BY clip_id) AS m FROM r WHERE tier IS NOT NULL) u WHERE tier = m""")
def tiered_fallback(spark, d):
    low = F.lower("text")
    clean, hooked = ~matcher.holds(low, _bound(DULL)), matcher.holds(low, "|".join(patterns.HOOKS.values())) & (captions.word_count(F.col("text")) <= 8)
    lines = _t(spark, d, "v_candidates").select(
        "clip_id", "pos", (clean & hooked).alias("kept"), clean.alias("clean"), (F.length("text") > 40).alias("grounded"), matcher.holds(low, "[a-z]{9,}").alias("specific"),
        F.lit(False).alias("made"), matcher.holds(low, patterns.FILLER).alias("generic"), F.lit(True).alias("told"),
    )
    return captions.tiered_fallback(lines)


@query(f"""WITH b AS (SELECT *, regexp_matches(lower(text), '{_bound(DULL)}') AS bad, row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS rn FROM v_candidates)
           SELECT clip_id, coalesce(string_agg(CASE WHEN NOT bad THEN text END, ' | ' ORDER BY pos), '') AS kept, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_killed,
                  max(CASE WHEN rn = 2 AND NOT bad THEN text END) AS variant, bool_and(rn > 1 OR NOT bad) AS ships FROM b GROUP BY clip_id""")
def compliance_scrub(spark, d):
    return captions.compliance_scrub(_t(spark, d, "v_candidates"), DULL)


_HIT = "regexp_matches(lower({}), '" + _bound(["the", "shorts"]) + "|of the')"


@query(f"""WITH w AS (SELECT clip_id, pos, text, list_transform(string_split(lower(text), ' ')[1:2], lambda t: '#' || t) AS own FROM v_candidates),
           u AS (SELECT *, list_concat(own, [{_quoted("#" + t for t in DEFAULT_TAGS)}]) AS t FROM w),
           k AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: list_position(t, t[i]) = i AND NOT {_HIT.format("t[i]")}) AS keep, trim(text || '  ' || array_to_string(own, ' '), ' ') AS post, trim(regexp_replace(text, '[{patterns.CLOSING} ]+$', ''), ' ') AS bare FROM u),
           f AS (SELECT *, substr(CASE WHEN bare = '' THEN text ELSE bare END, 1, 90) AS title FROM k)
           SELECT clip_id, pos, array_to_string(list_transform(keep, lambda i: t[i]), ',') AS tags, CASE WHEN {_HIT.format("post")} THEN text ELSE post END AS post, CASE WHEN {_HIT.format("title")} THEN text ELSE title END AS title FROM f""")
def tags_minus_banned(spark, d):
    own = F.transform(F.slice(F.split(F.lower("text"), " "), 1, 2), lambda t: F.concat(F.lit("#"), t))
    return captions.tags_minus_banned(_t(spark, d, "v_candidates"), own, ["#" + t for t in DEFAULT_TAGS], ["the", "shorts", "of the"])


_MADE = "[" + ", ".join("'" + t.replace("{}", "' || n || '") + "'" for t in patterns.NOUN_TEMPLATES) + "]"


@query(f"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: trim(x, '''')), lambda x: regexp_matches(x, '^[a-z]{{4,}}$') AND NOT list_contains([{_quoted(GENERIC)}], x) AND NOT regexp_matches(x, '(ed|ing|ly)$'))[1] AS n FROM documents),
           m AS (SELECT doc_id, unnest({_MADE}) AS caption, generate_subscripts({_MADE}, 1) - 1 AS pos FROM t WHERE n IS NOT NULL)
           SELECT doc_id, pos, caption FROM m WHERE NOT (regexp_matches(caption, '{_bound(["nobody", "with"])}') OR contains(caption, 'truth about a'))""")
def noun_fallback(spark, d):
    return captions.noun_fallback(_t(spark, d, "documents"), GENERIC, patterns.NOUN_TEMPLATES, ["nobody", "with", "truth about a"])


@query(f"""WITH b AS (SELECT source, seg_no, word_no, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS b FROM v_words)
           SELECT source, seg_no, word_no, CASE WHEN b IN ({_quoted(DULL)}) THEN substr(b, 1, 1) || repeat('*', length(b) - 1) WHEN b IN ({_quoted(LEXICON)}) THEN regexp_replace(b, '[aeiou]', '*', 'g') WHEN b = 'i' THEN 'I' ELSE b END AS shown FROM b""")
def token_style_mask(spark, d):
    return captions.token_style_mask(_t(spark, d, "v_words"), DULL, LEXICON)


_FORMS = " UNION ".join(
    [f"SELECT '{r}' AS root, '{r}{x}' AS form" for r in ROOTS for x in ["", *SUFFIXES]] + [f"SELECT '{r}' AS root, '{r}{r[-1]}{x}' AS form" for r in ROOTS if r[-1] not in "aeiou" for x in ["", *SUFFIXES]]
)


@query(f"""WITH f AS ({_FORMS}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM documents) SELECT doc_id, root, count(*) AS n FROM t JOIN f USING (form) GROUP BY 1, 2""")
def lexicon_prefix_match(spark, d):
    return captions.lexicon_prefix_match(_t(spark, d, "documents"), spark.createDataFrame([(r,) for r in ROOTS], "root string"), SUFFIXES)


_ANCHORS = """SELECT clip_id, coalesce(array_to_string(list_filter(a, lambda x, i: a[1:i] = b[1:i]), ' '), '') AS anchor
FROM (SELECT clip_id, string_split(min(lower(text)), ' ') AS a, string_split(max(lower(text)), ' ') AS b FROM v_candidates WHERE length(text) <= 60 GROUP BY clip_id) t"""


@query(_ANCHORS)
def udaf_common_prefix(spark, d):
    return plugs.common_prefix_twin(_t(spark, d, "v_candidates").where("length(text) <= 60"))


@query(f"""WITH p AS ({_ANCHORS}), c AS (SELECT c.clip_id, c.pos, string_split(lower(c.text), ' ') AS w, CASE WHEN p.anchor = '' THEN [] ELSE string_split(p.anchor, ' ') END AS a FROM v_candidates c JOIN p USING (clip_id))
           SELECT clip_id, pos FROM c WHERE array_to_string(w[1:len(a)], ' ') = array_to_string(a, ' ') AND len(list_filter(w[len(a) + 1:], lambda x: NOT list_contains(a, x) AND NOT list_contains([{_quoted(GENERIC)}], x))) > 0""")
def required_prefix_conformance(spark, d):
    c = _t(spark, d, "v_candidates")
    return captions.required_prefix_conformance(c, c.where("length(text) <= 60"), GENERIC)


@query(f"""WITH RECURSIVE s AS (SELECT clip_id // 250 AS batch, clip_id, pos, array_to_string(regexp_extract_all(lower(text), '[a-z'']+')[1:2], ' ') AS opening, {_POINTS} AS score FROM v_candidates),
           l AS (SELECT batch, clip_id, list(struct_pack(pos := pos, opening := opening) ORDER BY score DESC, pos) AS lines FROM s GROUP BY 1, 2),
           o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY clip_id) AS rn, greatest(3, (count(*) OVER (PARTITION BY batch) + 4) // 5) AS quota FROM l),
           r AS (SELECT DISTINCT batch, 0::BIGINT AS rn, []::VARCHAR[] AS used, 0::BIGINT AS clip_id, 0::BIGINT AS pos FROM o
             UNION ALL SELECT batch, rn, list_append(used, best.opening), clip_id, best.pos FROM (SELECT r.batch, o.rn, r.used, o.clip_id,
               coalesce(list_filter(o.lines, lambda x: len(list_filter(r.used, lambda u: u = x.opening)) < o.quota)[1],
                        o.lines[list_sort(list_transform(o.lines, lambda x, i: struct_pack(n := len(list_filter(r.used, lambda u: u = x.opening)), i := i)))[1].i]) AS best
               FROM r JOIN o ON o.batch = r.batch AND o.rn = r.rn + 1) t)
           SELECT batch, clip_id, pos, used[len(used)] AS opening FROM r WHERE rn > 0""")
def structure_quota(spark, d):
    lines = _t(spark, d, "v_candidates").withColumn("batch", F.floor(F.col("clip_id") / 250).cast("long"))
    return folds.structure_quota(lines, captions.line_score(F.col("text")))


# -- timelines and folds -----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p.clip_id, p.k, c.source, c.start_s + p.a AS f, c.start_s + p.b AS t, coalesce(sum(p.b - p.a) OVER (PARTITION BY p.clip_id ORDER BY p.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM v_played p JOIN v_clips c USING (clip_id)),
          d AS (SELECT source, seg_no, word_no, start_s, end_s FROM (SELECT *, row_number() OVER (PARTITION BY source, word, round(start_s, 3), round(end_s, 3) ORDER BY seg_no, word_no) AS r
                FROM (SELECT * FROM v_words UNION ALL SELECT source, seg_no, word_no + 1000, word, start_s, end_s FROM v_words WHERE length(word) > 6) u) z WHERE r = 1),
          h AS (SELECT clip_id, k, seg_no, word_no, o + greatest(start_s, f) - f AS s, o + least(end_s, t) - f AS e FROM p JOIN d w ON w.source = p.source AND w.start_s < t AND f < w.end_s),
          g AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY clip_id, seg_no, word_no ORDER BY s, k) <= 0.06 THEN 0 ELSE 1 END AS n FROM h),
          r AS (SELECT *, sum(n) OVER (PARTITION BY clip_id, seg_no, word_no ORDER BY s, k ROWS UNBOUNDED PRECEDING) AS run FROM g)
          SELECT clip_id, seg_no, word_no, round(min(s), 3) AS out_start, round(max(e), 3) AS out_end FROM r GROUP BY clip_id, seg_no, word_no, run""")
def timeline_remap(spark, d):
    words, played, clips = _t(spark, d, "v_words", "v_played", "v_clips")
    return timeline.timeline_remap(words.unionByName(words.where("length(word) > 6").withColumn("word_no", F.col("word_no") + 1000)), played, clips)  # long words twice


@query("""WITH g AS (SELECT source, stddev_pop(rms) AS s FROM v_energy GROUP BY 1),
          w AS (SELECT c.clip_id, count(*) AS n, max(e.rms) AS p, median(e.rms) AS m, max(g.s) AS s, arg_min(e.sec, -e.rms * 100000 + e.sec) AS ps FROM v_clips c JOIN v_energy e ON e.source = c.source AND e.sec >= floor(c.start_s) AND e.sec < CAST(round(c.end_s) AS BIGINT) JOIN g ON g.source = c.source GROUP BY 1),
          o AS (SELECT p.*, coalesce(sum(b - a) OVER (PARTITION BY clip_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM v_played p),
          y AS (SELECT clip_id, round(min(CASE WHEN k <> 0 AND c.peak - c.start_s >= a AND c.peak - c.start_s < b THEN o + c.peak - c.start_s - a END) - max(CASE WHEN k = 0 THEN o + b - a END), 3) AS gap FROM o JOIN v_clips c USING (clip_id) GROUP BY clip_id)
          SELECT c.clip_id, CASE WHEN w.clip_id IS NULL THEN 'no shape' WHEN round((p - m) / s, 2) < 1.2 THEN 'flat' WHEN ps - c.start_s < 3 THEN 'too early' WHEN c.end_s - ps < 2 THEN 'too late' WHEN gap IS NULL THEN 'peak cut' WHEN gap < 1 THEN 'too near' ELSE '' END AS reason
          FROM v_clips c LEFT JOIN w ON w.clip_id = c.clip_id AND w.n >= 3 AND w.s > 0 LEFT JOIN y ON y.clip_id = c.clip_id""")
def sharp_peak_decision(spark, d):
    clips, energy, played = _t(spark, d, "v_clips", "v_energy", "v_played")
    return timeline.sharp_peak_decision(clips, energy, played, sharp=1.2, least_gap=1)


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start_s, end_s, id) AS rn FROM v_moments),
          r AS (SELECT source, rn::BIGINT AS rn, start_s AS cs, end_s AS ce, 0::BIGINT AS g FROM o WHERE rn = 1
                UNION ALL SELECT o.source, o.rn, CASE WHEN o.start_s - ce <= 7 AND greatest(ce, o.end_s) - cs <= 60 THEN cs ELSE o.start_s END, CASE WHEN o.start_s - ce <= 7 AND greatest(ce, o.end_s) - cs <= 60 THEN greatest(ce, o.end_s) ELSE o.end_s END,
                CASE WHEN o.start_s - ce <= 7 AND greatest(ce, o.end_s) - cs <= 60 THEN g ELSE g + 1 END FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1)
          SELECT o.source, min(start_s) AS start_s, max(end_s) AS end_s, arg_min(type, -intensity * 1000000 + o.rn) AS type, count(*) AS n, substr(coalesce(string_agg(CASE WHEN text <> '' THEN text END, ' ' ORDER BY o.rn), ''), 1, 400) AS text
          FROM o JOIN r ON r.source = o.source AND r.rn = o.rn GROUP BY o.source, g""")
def merge_gap_capped(spark, d):
    return folds.merge_gap_capped(_t(spark, d, "v_moments"))


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, clip_id) AS rn FROM v_clips),
          r AS (SELECT source, rn::BIGINT AS rn, [clip_id] AS ids, [start_s] AS ss, [end_s] AS es, true AS ok FROM o WHERE rn = 1
                UNION ALL SELECT o.source, o.rn, ids, CASE WHEN x THEN list_append(ss, o.start_s) ELSE ss END, CASE WHEN x THEN list_append(es, o.end_s) ELSE es END, x
                FROM (SELECT o.source, o.rn, o.start_s, o.end_s, r.ids, r.ss, r.es, len(list_filter(range(1, len(r.ss) + 1), lambda i: o.start_s < r.es[i] AND r.ss[i] < o.end_s)) = 0 AS x FROM r JOIN o ON o.source = r.source AND o.rn = r.rn + 1) o)
          SELECT o.clip_id, o.source FROM o JOIN r ON r.source = o.source AND r.rn = o.rn WHERE r.ok""")
def window_overlap_suppress(spark, d):
    return folds.window_overlap_suppress(_t(spark, d, "v_clips"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE value IS NOT NULL),
          r AS (SELECT user_id, rn::BIGINT AS rn, event_id, value AS c FROM o WHERE rn = 1
                UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN abs(o.value - c) > 20 THEN least(1000.0::DOUBLE, greatest(0.0::DOUBLE, c + least(8.0::DOUBLE, greatest(-8.0::DOUBLE, (o.value - c) * 0.06::DOUBLE)))) ELSE c END FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
          SELECT event_id, round(c, 4) AS position FROM r""")
def deadband_follow(spark, d):
    return folds.deadband_follow(_t(spark, d, "events"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE value IS NOT NULL),
          r AS (SELECT user_id, rn::BIGINT AS rn, event_id, least(500.0::DOUBLE, value) AS c FROM o WHERE rn = 1
                UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN c >= 500 THEN least(500.0::DOUBLE, o.value) ELSE least(500.0::DOUBLE, c * 0.618034::DOUBLE + o.value) END FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
          SELECT event_id, round(c, 4) AS level FROM r""")
def fold_by_key(spark, d):
    def step(level, row):  # a load that decays with each event, and starts anew once it was full
        level = min(500.0, row.value if level is None or level >= 500 else level * 0.618034 + row.value)
        return level, level

    events = _t(spark, d, "events").where("value is not null").select("user_id", "ts", "event_id", "value")
    return folds.fold_by_key(events, ["user_id"], ["ts", "event_id"], "level", "double", lambda: None, step).select("event_id", F.round("level", 4).alias("level"))


_LOUD = "(intensity * (CASE WHEN type = 'audio_spike' THEN 10.0::DOUBLE ELSE 6.0::DOUBLE END) + least(length(text), 120) / 12.0::DOUBLE)"


def _loud():
    return F.col("intensity") * F.when(F.col("type") == "audio_spike", 10.0).otherwise(6.0) + F.least(F.length("text"), F.lit(120)) / 12.0


@query(_spread(_LOUD, "true", 60, 50))
def heuristic_select(spark, d):
    return ranking.spread_topk(_t(spark, d, "v_moments").withColumn("intensity", _loud()), 60, 50)


_ALIVE = "intensity >= 8 AND len(regexp_extract_all(text, '[A-Za-z'']+')) >= 4 AND (SELECT max(intensity) FROM v_moments) >= 10"


@query(f"""SELECT t.*, (SELECT count(*) FROM v_moments WHERE {_ALIVE} AND intensity >= 11) AS n_cleared, (SELECT count(*) FROM v_moments WHERE {_ALIVE} AND intensity < 11) AS n_filler FROM ({_spread("intensity", _ALIVE, 60, 10)}) t""")
def review_funnel(spark, d):
    words = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0)))
    return ranking.review_funnel(_t(spark, d, "v_moments").withColumn("junk", words < 4), alive=8, best=10, pool=8, clear=11)


# -- plug points -------------------------------------------------------------------------------------------------


@query(f"SELECT id, round({_LOUD}, 4) AS score FROM v_moments")
def udf_batch_scorer(spark, d):
    return plugs.batch_scores(_t(spark, d, "v_moments"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS place FROM documents),
          b AS (SELECT doc_id, place, trim(regexp_replace(x, '^[-*0-9.) ]+', ''), ' ') AS line FROM l) SELECT doc_id, place, line FROM b WHERE line <> ''""")
def udtf_candidates(spark, d):
    return plugs.candidate_lines(spark, _t(spark, d, "documents"))
