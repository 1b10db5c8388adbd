"""Campaign board, resources and rule lines."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bounds import small_or_not
from tidemark.functions.ordered import over
from tidemark.operators import patterns


def _rankable() -> Column:
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    fit = F.coalesce(F.col("status").isin("scraped", "refreshed"), F.lit(False)) & no("disqualified") & no("rules_unreadable") & no("excluded_prohibited")
    return fit & (F.coalesce("composite", F.lit(0.0)) > 0) & (F.coalesce("core_known", F.lit(0)) > 0)


def scan_board(boards: DataFrame) -> DataFrame:
    """(id, name, composite, status, category, lane): the named campaigns of board documents.

    boards: (doc), each `{"campaigns": [...]}` or a bare list. A document that isn't JSON, or holds no campaign, fails the job.
    """
    whole = F.parse_json("doc")
    bare = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    rows = boards.select(whole.alias("v")).select(F.when(bare, F.col("v").cast("array<variant>")).otherwise(F.try_variant_get("v", "$.campaigns", "array<variant>")).alias("all"))
    none = F.raise_error(F.lit("a board has no campaigns")).cast("array<variant>")
    one = rows.select(F.explode(F.when(F.coalesce(F.size("all"), F.lit(0)) > 0, F.col("all")).otherwise(none)).alias("c"))
    get = lambda name, kind: F.try_variant_get("c", f"$.{name}", kind).alias(name)
    got = one.select(get("id", "bigint"), get("name", "string"), F.round(F.try_variant_get("c", "$.composite", "double"), 6).alias("composite"), *(get(n, "string") for n in ("status", "category", "lane")))
    return got.where("name is not null")


def rankable_filter(board: DataFrame) -> DataFrame:
    """(id, composite): campaigns that may be ranked."""
    return board.where(_rankable()).select("id", F.round(F.col("composite").cast("double"), 6).alias("composite"))


def clippable_first_reason(board: DataFrame) -> DataFrame:
    """(id, reason): the first precondition that fails: done, rules that can't be read or weren't found, no footage; '' if none.

    Rules of a modal, a shared document or a page can be read; records of no known source pass if any rules, or links to
    some, were kept.
    """
    source = F.col("rules_source")
    kept = (F.length(F.trim(F.coalesce("rules_text", F.lit("")))) > 0) | (F.coalesce("n_rule_links", F.lit(0)) > 0)
    rules = (
        F.when(F.coalesce("rules_unreadable", F.lit(False)), "rules unreadable").when(source.isin("modal", "gdoc", "notion"), "").when(source == "unreadable", "rules unreadable")
        .when(source == "none", "no readable rules").when(kept, "").otherwise("no rules captured")
    )
    return board.select("id", F.when(F.col("is_done"), "done").when(rules != "", rules).when(F.coalesce("n_links", F.lit(0)) == 0, "no footage").otherwise("").alias("reason"))


def language_skip(board: DataFrame, gate: str = "en") -> DataFrame:
    """(id, skip): skip only what is surely in another language."""
    return board.select("id", F.coalesce((F.col("lang") != gate) & (F.col("lang_conf") != "low"), F.lit(False)).alias("skip"))


def board_rank(board: DataFrame, n: int = 100, lane: str | None = None, category: str | None = None, rescued: tuple[str, str, float] | None = None) -> DataFrame:
    """(id, composite, core_known, pre_score, effective): the n best rankable campaigns, by effective, then the other two.

    lane, category: only campaigns with that lane, with that category among theirs. rescued: (category, pattern,
    weight): campaigns of another category too, if their name or rules hold the pattern, at that weight. effective: the
    composite by its weight.
    """
    rows = board.where(_rankable())
    held = lambda name, one: F.array_contains(F.transform(F.array_compact(name), lambda x: F.upper(F.trim(x))), one.strip().upper())
    if lane:
        rows = rows.where(held(F.array("lane", "second_lane"), lane))
    weight = F.lit(1.0)
    if category:
        own = F.array("category", "second_category")
        weight = F.when(held(own, category), 1.0)
        if rescued:
            other, pattern, less = rescued
            weight = weight.when(held(own, other) & F.lower(F.concat_ws(" ", "name", "rules_text")).rlike(pattern), less)
    known = [F.round(F.col("composite").cast("double"), 6).alias("composite"), F.col("core_known").cast("long").alias("core_known"), F.col("pre_score").cast("long").alias("pre_score")]
    rows = rows.select("id", *known, F.round(F.col("composite").cast("double") * weight, 6).alias("effective")).where("effective is not null")
    return rows.orderBy(F.desc("effective"), F.desc("core_known"), F.desc("pre_score"), "id").limit(n)


def walk_first_pass(board: DataFrame, gate: str = "en", n: int = 10) -> DataFrame:
    """(id, rank, reason): the n best in order up to the first that passes all checks, with reasons."""
    ranked = board_rank(board, n).withColumn("rank", F.row_number().over(over(by=[F.desc("effective"), F.desc("core_known"), F.desc("pre_score"), "id"])).cast("long"))  # n rows
    checks = clippable_first_reason(board).join(language_skip(board, gate), "id").select("id", F.when(F.col("skip"), "language").otherwise(F.col("reason")).alias("reason"))
    rows = ranked.select("id", "rank").join(checks, "id")
    first = rows.where("reason = ''").agg(F.min("rank").alias("first"))
    return rows.crossJoin(F.broadcast(first)).where(F.col("first").isNull() | (F.col("rank") <= F.col("first"))).select("id", "rank", "reason")  # one row


def board_health(board: DataFrame, as_of: str, fresh: float = 72) -> DataFrame:
    """(category, campaigns, rankable, clippable, age_h, state) by category, and of the whole board as `all`.

    age_h: hours from the newest `generated_at`, an ISO time, to as_of; state: fresh below `fresh` hours, else stale,
    unknown without a time.
    """
    made = F.try_to_timestamp(F.regexp_replace("generated_at", "Z$", "+00:00"))
    rows = board.select("id", "category", _rankable().alias("ok"), made.alias("made")).join(clippable_first_reason(board), "id")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = rows.rollup("category").agg(F.grouping("category").alias("whole"), F.count("*").alias("campaigns"), one(F.col("ok")).alias("rankable"), one(F.col("ok") & (F.col("reason") == "")).alias("clippable"), F.max("made").alias("made"))
    age = F.round((F.unix_seconds(F.to_timestamp(F.lit(as_of))) - F.unix_seconds("made")) / 3600, 2)
    state = F.when(F.col("made").isNull(), "unknown").when(age < fresh, "fresh").otherwise("stale")
    return sums.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("category")).alias("category"), "campaigns", "rankable", "clippable", age.alias("age_h"), state.alias("state"))


def prefer_flagged_else_all(resources: DataFrame) -> DataFrame:
    """(campaign, ord, path): a campaign's flagged footage if it has any, else all of it."""
    footage = resources.where(F.lower("path").rlike(r"\.(mp4|mov|mkv)$"))
    rows = footage.withColumn("any", F.max("safe_margin").over(over("campaign")))
    return rows.where(F.col("safe_margin") | ~F.col("any")).select("campaign", "ord", "path")


def route_by_extension(resources: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, n, size): resources by the kind of their extension; kinds: (ext, kind), a fixed list."""
    rows = resources.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).join(small_or_not(kinds), "ext", "left")
    return rows.groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("size"))


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(source, reuse, changed, missing): a source can be reused if each file of before is there with equal size."""
    a = before.select("source", "campaign", "ord", F.col("size").alias("was"))
    b = now.select("source", "campaign", "ord", "size")
    rows = a.join(b, ["source", "campaign", "ord"], "left")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy("source").agg(F.every(F.coalesce(F.col("was") == F.col("size"), F.lit(False))).alias("reuse"), one(F.col("size") != F.col("was")).alias("changed"), one(F.col("size").isNull()).alias("missing"))


def resource_usage(resources: DataFrame, kinds: DataFrame) -> DataFrame:
    """(campaign, ord, path, kind, usage): how each resource was used; UNREAD where a document gave no text, UNUSED where nothing handles its kind.

    resources: (campaign, ord, path, duration_sec, text_len), text_len null where no text could be read.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = resources.withColumn("ext", ext).join(small_or_not(kinds), "ext", "left").withColumn("kind", F.coalesce("kind", F.lit("other")))
    purpose = F.lower("path").rlike("(guide|reference|safe|margin|template)")
    usage = (
        F.when(F.col("kind") == "footage", F.concat(F.lit("probed video ("), F.col("duration_sec").cast("long").cast("string"), F.lit(" s)")))
        .when(F.col("kind") == "asset", F.when(purpose, "applied as reference").otherwise("watermark candidate"))
        .when(F.col("kind") == "doc", F.when(F.coalesce("text_len", F.lit(0)) > 0, F.concat(F.lit("read + extracted ("), F.col("text_len").cast("string"), F.lit(" chars)"))).otherwise("UNREAD: no text"))
        .otherwise("UNUSED: no handler")
    )
    return rows.select("campaign", "ord", "path", "kind", "duration_sec", F.coalesce(usage, F.lit("probed video (unknown length)")).alias("usage"))


def coverage_report(resources: DataFrame, kinds: DataFrame, rules: DataFrame) -> DataFrame:
    """(campaign, footage, assets, docs, other, footage_hours, unused, unread, flags): what each campaign's resources cover and what is unclear.

    resources as for resource_usage; rules: (campaign, field), what rules were found. flags: the open questions in order,
    joined by bars: payout terms or a submission process not found, and each resource not fully used.
    """
    used = resource_usage(resources, kinds)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    kind = F.col("kind")
    hours = F.sum(F.when(kind == "footage", F.coalesce("duration_sec", F.lit(0.0))).otherwise(0.0)) / 3600
    odd = F.col("usage").rlike("^UN(USED|READ)")
    question = F.struct("ord", F.concat(F.lit("not fully used: "), F.col("path"), F.lit(" ("), F.col("usage"), F.lit(")")).alias("text"))
    rows = used.groupBy("campaign").agg(
        n(kind == "footage").alias("footage"), n(kind == "asset").alias("assets"), n(kind == "doc").alias("docs"), n(kind == "other").alias("other"), F.round(hours, 2).alias("footage_hours"),
        n(F.col("usage").startswith("UNUSED")).alias("unused"), n(F.col("usage").startswith("UNREAD")).alias("unread"), F.array_sort(F.collect_list(F.when(odd, question))).alias("odd"),
    )
    found = rules.groupBy("campaign").agg(F.max(F.col("field") == "payout_terms").alias("payout"), F.max(F.col("field").isin("submission_process", "deadlines")).alias("submission"))
    told = rows.join(found, "campaign", "left")
    missing = lambda c, text: F.when(F.coalesce(c, F.lit(False)), None).otherwise(F.lit(text))
    flags = F.concat(F.array_compact(F.array(missing("payout", "no payout terms found"), missing("submission", "no submission process found"))), F.transform("odd", lambda x: x["text"]))
    return told.select("campaign", "footage", "assets", "docs", "other", "footage_hours", "unused", "unread", F.array_join(flags, " | ").alias("flags"))


def source_language(documents: DataFrame) -> DataFrame:
    """(source, lang, chars, share): each source's dominant language by characters."""
    sums = documents.groupBy("source", "lang").agg(F.sum("n_chars").alias("c"))
    best = sums.groupBy("source").agg(F.max_by("lang", F.struct("c", "lang")).alias("lang"), F.max("c").cast("long").alias("chars"), F.sum("c").alias("all"))
    return best.select("source", "lang", "chars", F.round(F.col("chars") / F.col("all"), 4).alias("share"))


def language_gate(documents: DataFrame, gate: str = "en", least: float = 0.6) -> DataFrame:
    """(source, decision, mix): whether a source's language lets it pass, and its mix of languages."""
    sums = documents.groupBy("source", "lang").agg(F.sum("n_chars").cast("long").alias("c"))
    mix = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "c"))), lambda r: F.concat(r["lang"], F.lit(":"), r["c"].cast("string"))), ",")
    rows = sums.groupBy("source").agg(F.max_by("lang", F.struct("c", "lang")).alias("top"), (F.max("c") / F.sum("c")).alias("share"), mix.alias("mix"))
    decision = F.when(F.col("top") == gate, "pass").when(F.col("share") < least, "ambiguous").otherwise("block")
    return rows.select("source", decision.alias("decision"), "mix")


def rules_floor(lines: DataFrame, default_banned: list[str], cap: int = 40, assets: DataFrame | None = None) -> DataFrame:
    """(campaign, field, ord, value): what a campaign's lines rule, without a model.

    Sections hold their first `cap` lines in order (ord); hashtags, mentions, required elements and banned terms are
    sets (ord 0). Banned terms are the defaults and, from lines with a marking word, the terms of one to three words
    after the first colon or dash. lines: (campaign, doc_id, line_no, text); assets: (campaign, path), files given with a
    campaign, of which one named a watermark or logo asks for it too.
    """
    any_of = lambda words: functools.reduce(lambda x, y: x | y, [F.col("low").contains(w) for w in words])
    rows = lines.select("campaign", "doc_id", "line_no", "text", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(any_of(words), name) for name, words in patterns.SECTIONS.items()]))
    ruled = rows.select("campaign", "doc_id", "line_no", "text", held.alias("held")).where(F.size("held") > 0)
    ruled = ruled.select("campaign", F.explode("held").alias("field"), "doc_id", "line_no", F.col("text").alias("value"))
    sections = ruled.withColumn("ord", F.row_number().over(over("campaign", "field", by=["doc_id", "line_no"])).cast("long")).where(F.col("ord") <= cap).select("campaign", "field", "ord", "value")

    marked = rows.where(any_of(["#", "@", "watermark", *patterns.DISCLOSURE_MARKS, *patterns.BANNED_MARKS]))
    found = lambda mark, chars: F.when(F.col("text").contains(mark), F.regexp_extract_all("text", F.lit(f"(^|[^A-Za-z0-9_])({mark}[{chars}]+)"), F.lit(2))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    parts = F.split(F.regexp_replace("low", "^[^:–-]*[:–-]", ""), "[,/;]| and | or ")
    own = marked.select("campaign", "low", found("#", "A-Za-z0-9_").alias("tags"), found("@", "A-Za-z0-9_.").alias("handles"), F.when(any_of(patterns.BANNED_MARKS), parts).otherwise(none).alias("parts"))
    named = lambda field, of, name: F.transform(of, lambda x: F.struct(F.lit(field).alias("field"), name(x).alias("value")))
    needs = F.array_compact(F.array(*[F.when(any_of(words), F.lit(kind)) for kind, words in (("watermark", ["watermark"]), ("disclosure", patterns.DISCLOSURE_MARKS))]))
    typed = F.concat(
        named("hashtags", "tags", lambda x: x), named("required", "tags", lambda x: F.concat(F.lit("hashtag: "), x)), named("mentions", "handles", lambda x: x), named("required", "handles", lambda x: F.concat(F.lit("mention: "), x)),
        named("required", needs, lambda x: x), named("banned", "parts", lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9'+ -]", ""))),
    )
    sets = own.select("campaign", F.explode(typed).alias("r")).select("campaign", "r.field", "r.value")
    n_words = F.size(F.regexp_extract_all("value", F.lit("[^ ]+"), F.lit(0)))
    term = (F.length("value") >= 2) & n_words.between(1, 3) & ~F.col("value").rlike("^[0-9]+$")
    sets = sets.where((F.col("field") != "banned") | term).select("campaign", F.when(F.col("field") == "banned", "banned_words").otherwise(F.col("field")).alias("field"), "value")
    defaults = lines.select("campaign").distinct().select("campaign", F.lit("banned_words").alias("field"), F.explode(F.array(*map(F.lit, default_banned))).alias("value"))
    if assets is not None:
        named_so = assets.where(F.lower("path").rlike("watermark|logo")).select("campaign").distinct().join(lines.select("campaign").distinct(), "campaign", "left_semi")
        sets = sets.unionByName(named_so.select("campaign", F.lit("required").alias("field"), F.lit("watermark").alias("value")))
    sets = sets.unionByName(defaults).distinct().select("campaign", "field", F.lit(0).cast("long").alias("ord"), "value")
    return sections.unionByName(sets)


def _canonical(value: pd.Series) -> pd.Series:
    """Structs and lists in JSON with their keys in order; other text trimmed and in lower case."""

    def key(x: str) -> str:
        if x.strip()[:1] in ("{", "["):
            try:
                return json.dumps(json.loads(x), sort_keys=True)
            except ValueError:
                pass
        return x.strip().lower()

    return value.map(key, na_action="ignore")


def rules_merge(floor: DataFrame, additions: DataFrame, scalars: list[str]) -> DataFrame:
    """(campaign, field, origin, ord, value): the floor and what is added, field by field.

    List fields are ordered unions, the floor's values (origin 0) first, equal ones once: text trimmed and in lower case,
    structs (JSON objects) whatever the order of their keys. Of a scalar field the floor's value stays unless it is
    empty. Both: (campaign, field, ord, value).
    """
    both = floor.withColumn("origin", F.lit(0)).unionByName(additions.withColumn("origin", F.lit(1))).where(F.trim("value") != "")
    struct = F.pandas_udf(_canonical, "string")("value")
    key = F.when(F.col("field").isin(scalars), "").when(F.trim("value").rlike(r"^[{\[]"), struct).otherwise(F.lower(F.trim("value")))
    once = both.groupBy("campaign", "field", key.alias("key")).agg(F.min(F.struct("origin", "ord", "value")).alias("r"))
    return once.select("campaign", "field", "r.origin", "r.ord", "r.value")


def ordered_distinct(links: DataFrame) -> DataFrame:
    """(dst, first_src, n): each link target once, with where it was first seen."""
    return links.groupBy("dst").agg(F.min("src").alias("first_src"), F.count("*").alias("n"))


def tag_membership(board: DataFrame, tag: str) -> DataFrame:
    """(id, tags): campaigns whose tags, the category's words and the lane, hold the tag."""
    tags = F.array_distinct(F.concat(F.split("category", " "), F.array(F.lower(F.trim("lane")))))
    return board.withColumn("tags", tags).where(F.array_contains("tags", tag)).select("id", F.array_join("tags", ",").alias("tags"))


def score_attach(moments: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, score, line): the first score returned for each known id, its line cut at 200."""
    first = scores.withColumn("rn", F.row_number().over(over("id", by=["pos"]))).where("rn = 1")
    return moments.select("id").join(first, "id").select("id", "score", F.substring("line", 1, 200).alias("line"))


def freshness_check(upstream: DataFrame, downstream: DataFrame) -> DataFrame:
    """(source, fresh, stale): whether both sides hold the same ids in each source."""
    rows = upstream.select("source", "id").withColumn("u", F.lit(1)).join(downstream.select("source", "id").withColumn("d", F.lit(1)), ["source", "id"], "full")
    odd = F.col("u").isNull() | F.col("d").isNull()
    return rows.groupBy("source").agg(F.every(~odd).alias("fresh"), F.sum(F.when(odd, 1).otherwise(0)).cast("long").alias("stale"))


def speech_lines(words: DataFrame, gap: float = 0.35, size: int = 3) -> DataFrame:
    """(source, seg_no, word_no, run, line): words in lines of three, a last one of four rather than an orphan."""
    by = ["start_s", "seg_no", "word_no"]
    last = F.lag("end_s").over(over("source", by=by))
    ended = F.lag(F.col("word").rlike(r"[.!?]$")).over(over("source", by=by))
    rows = words.withColumn("new", F.when(last.isNull() | (F.col("start_s") - last > gap) | ended, 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(over("source", by=by).rowsBetween(-(1 << 63), 0)))
    p, n = F.row_number().over(over("source", "run", by=by)) - 1, F.count("*").over(over("source", "run"))
    chunks = F.when((n % size == 1) & (n >= size + 1), F.floor(n / size)).otherwise(F.ceil(n / size))
    return rows.select("source", "seg_no", "word_no", F.col("run").cast("long").alias("run"), F.least(F.floor(p / size), chunks - 1).cast("long").alias("line"))


def event_end_times(words: DataFrame, hold: float = 0.25, guard: float = 0.03, least: float = 0.05) -> DataFrame:
    """(source, seg_no, word_no, shown_until): a word is shown until the next of its segment starts, the last a little longer."""
    rows = words.withColumn("next", F.lead("start_s").over(over("source", "seg_no", by=["word_no"]))).join(words.groupBy("source", "seg_no").agg(F.min("start_s").alias("s0")).withColumn("after", F.lead("s0").over(over("source", by=["seg_no"]))).select("source", "seg_no", "after"), ["source", "seg_no"])
    tail = F.greatest("end_s", F.least(F.col("end_s") + hold, F.coalesce(F.col("after") - guard, F.col("end_s") + hold)))
    return rows.select("source", "seg_no", "word_no", F.round(F.greatest(F.col("start_s") + least, F.coalesce("next", tail)), 4).alias("shown_until"))
