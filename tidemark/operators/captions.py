"""Candidate lines: scores, tiers, scrubbing, term lists and masks."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, MapType, StringType

from tidemark.functions.ordered import over
from tidemark.operators import matcher, patterns


def first_words(column: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(F.lower(column), " "), 1, n), " ")


def opening(column: Column, n: int = 2) -> Column:
    """The first n words of letters, in lower case."""
    pattern = "^[^a-z']*(?P<w0>[a-z']+)" + "".join(f"(?:[^a-z']+(?P<w{i}>[a-z']+)" for i in range(1, n)) + ")?" * (n - 1)

    def opened(low: pa.Array) -> pa.Array:
        found = pc.extract_regex(low, pattern)
        words = pc.binary_join_element_wise(*(pc.cast(pc.struct_field(found, f"w{i}"), pa.string()) for i in range(n)), " ")
        return pc.if_else(pc.is_null(low), pa.scalar(None, pa.string()), pc.fill_null(pc.utf8_rtrim(words, " "), ""))

    return F.arrow_udf(opened, "string")(F.lower(column))


def word_count(column: Column) -> Column:
    """Words that hold a letter or digit."""

    def counted(texts: pa.Array) -> pa.Array:
        return pc.cast(pc.count_substring_regex(texts, "[^ ]*[A-Za-z0-9][^ ]*"), pa.int32())

    return F.arrow_udf(counted, "int")(column)


def _letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many ASCII letters each text has, and how many of them are small."""
    text = pc.cast(text, pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]

    def count(held: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(held, dtype=np.int64)))[ends - ends[0]])

    small = count((data >= 97) & (data <= 122))
    return small + count((data >= 65) & (data <= 90)), small


def line_score(text: Column) -> Column:
    """Points of a line: its hooks, emoji, case and length, less for description and giveaways."""
    longer = lambda n: f"^(?:[^A-Za-z0-9]*[A-Za-z0-9][^ ]* ){{{n}}}[^A-Za-z0-9]*[A-Za-z0-9]"  # noqa: E731  # more words than n, as word_count has them

    def points(text: pa.Array, low: pa.Array) -> pa.Array:
        one = lambda c, n: pc.if_else(pc.fill_null(c, False), n, 0)
        held = lambda pattern: pc.fill_null(pc.match_substring_regex(low, pattern), False)
        hooks = {name: held(p) for name, p in patterns.HOOKS.items()}
        asks = hooks["question"]
        letters, small = _letters(text)
        cased = pa.array((letters > 0) & (small > letters * 0.85))
        parts = [
            one(pc.match_substring_regex(text, patterns.EMOJI), 2), one(pc.or_(asks, hooks["disbelief"]), 2), one(held(patterns.DESCRIPTIVE), -6), one(pc.and_not(held(patterns.GIVEAWAY), asks), -5),
            *(one(h, 4) for h in hooks.values()), one(pc.invert(pc.match_substring_regex(text, longer(6))), 2), one(pc.match_substring_regex(text, longer(8)), -8),
            one(pc.ends_with(pc.utf8_trim(text, " "), "."), -1), one(cased, 1),
        ]
        return pc.cast(functools.reduce(pc.add, parts), pa.int64())

    return F.arrow_udf(points, "long")(text, F.lower(text))


def leading(lines: DataFrame, keys: list[str], n: int) -> DataFrame:
    """lines without those that can't be the best line of one of a key's first n openings, best line first.

    lines: the keys, `opening`, `low` and `pos`; the lower these two, the better. Told in each Arrow batch alone, ahead of any
    shuffle, so more lines than that may stay, but no other is dropped.
    """
    by = [(c, "ascending") for c in (*keys, "low", "pos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.take(pc.sort_indices(batch, by, null_placement="at_start"))
                code = {c: rows[c].dictionary_encode("encode").indices.to_numpy().astype(np.int64) for c in (*keys, "opening")}
                key = np.cumsum(np.logical_or.reduce([np.diff(code[k], prepend=code[k][:1]) != 0 for k in keys]))
                first = np.sort(np.unique(key * (code["opening"].max() + 1) + code["opening"], return_index=True)[1])  # each opening's best line
                yield rows.take(pa.array(first[np.arange(len(first)) - np.searchsorted(key[first], key[first]) < n]))

    return lines.mapInArrow(run, lines.schema)


def caption_score_top2(candidates: DataFrame) -> DataFrame:
    """(clip_id, best_pos, best_score, variant_pos): the best line, and the next best with another two-word opening."""
    rows = candidates.select("clip_id", "pos", (-line_score(F.col("text"))).alias("low"), opening(F.col("text")).alias("opening"))
    best = leading(rows, ["clip_id"], 2).groupBy("clip_id", "opening").agg(F.min(F.struct("low", "pos")).alias("rank"))
    best = best.groupBy("clip_id").agg(F.slice(F.array_sort(F.collect_list("rank")), 1, 2).alias("top"))  # a row an opening
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    return best.select("clip_id", first["pos"].alias("best_pos"), (-first["low"]).alias("best_score"), second["pos"].alias("variant_pos"))


def caption_quality_kill(candidates: DataFrame, transcripts: DataFrame, generic: list[str], most: int = 8, least: int = 3) -> DataFrame:
    """(clip_id, pos, reason): the first rule a line breaks; null if none.

    transcripts: (clip_id, text). A line that is nothing but a common filler falls where the clip's transcript has
    `least` distinct words of three letters or more that aren't generic, as then there is something to be said of it.
    """
    text, low = F.col("text"), F.lower("text")
    asks = matcher.holds(low, patterns.HOOKS["question"])
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))), lambda w: (F.length(w) > 2) & ~w.isin(generic))
    told = transcripts.select("clip_id", (F.size(words) >= least).alias("told")).groupBy("clip_id").agg(F.max("told").alias("told"))
    reason = (
        F.when(word_count(text) > most, "too long").when(text.contains("\n"), "several lines").when(matcher.holds(low, patterns.DESCRIPTIVE), "describes").when(matcher.holds(low, patterns.BAIT), "bait")
        .when(~matcher.holds(low, "|".join(patterns.HOOKS.values())), "no hook").when(matcher.holds(low, patterns.GIVEAWAY) & ~asks, "giveaway").when(matcher.holds(low, patterns.FILLER), "filler")
    )
    rows = candidates.select("clip_id", "pos", reason.alias("reason")).join(told, "clip_id", "left")
    return rows.select("clip_id", "pos", F.when((F.col("reason") != "filler") | F.coalesce("told", F.lit(False)), F.col("reason")).alias("reason"))


def tiered_fallback(lines: DataFrame) -> DataFrame:
    """(clip_id, pos, tier): the lines of each clip's first tier that has any; clips without one are left out.

    lines: (clip_id, pos, kept, clean, grounded, specific, made, generic, told), all but the first two boolean: passed
    all gates, passed the ban alone, told by the transcript, says something of its own, made from a template, a stock
    line, and whether the clip has a transcript (stock lines are only for clips without one).
    """
    k, c, g, s, m, x, t = (F.col(n) for n in ("kept", "clean", "grounded", "specific", "made", "generic", "told"))
    tier = F.when(k & g & s, 1).when(c & g & s, 2).when(m, 3).when(k & g, 4).when(k, 5).when(c, 6).when(x & ~t, 7)
    rows = lines.withColumn("tier", tier.cast("long")).where("tier is not null")
    return rows.withColumn("least", F.min("tier").over(over("clip_id"))).where("tier = least").select("clip_id", "pos", "tier")


def compliance_scrub(candidates: DataFrame, banned: list[str]) -> DataFrame:
    """(clip_id, kept, n_killed, variant, ships): clips with their clean lines; a bad second line is nulled, a bad first one stops the clip.

    Banned phrases match anywhere, single words as whole words: all of them in one pass a line.
    """
    terms = [(t.lower(), " " not in t, 1) for t in banned]
    bad = matcher.matched(candidates.select("clip_id", "pos", "text", F.lower("text").alias("low")), "low", terms, "bad", BooleanType(), lambda found: next(found, None) is not None)
    sets = bad.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bad", "text"))).alias("lines"))
    clean = F.filter("lines", lambda x: ~x["bad"])
    second = F.get("lines", F.lit(1))
    return sets.select(
        "clip_id", F.array_join(F.transform(clean, lambda x: x["text"]), " | ").alias("kept"), (F.size("lines") - F.size(clean)).cast("long").alias("n_killed"),
        F.when(~second["bad"], second["text"]).alias("variant"), (~F.get("lines", F.lit(0))["bad"]).alias("ships"),
    )


def tags_minus_banned(candidates: DataFrame, required: Column, default: list[str], banned: list[str], longest: int = 90) -> DataFrame:
    """(clip_id, pos, tags, post, title): what is posted with a line: its required and the default tags, distinct in order, without banned ones; the line with its required tags; and its title, without closing emoji.

    A post or title that holds a banned term is the bare line instead. required: an array of tags. Phrases match
    anywhere, single words as whole words.
    """
    words, phrases = [t.lower() for t in banned if " " not in t], [t.lower() for t in banned if " " in t]
    pattern = "|".join([*([r"(^|[^a-z0-9_])(" + "|".join(words) + r")([^a-z0-9_]|$)"] if words else []), *phrases]) or r"[^\s\S]"
    hit = lambda c: F.lower(c).rlike(pattern)
    own = required.cast("array<string>")
    rows = candidates.select("clip_id", "pos", "text", F.array_compact(own).alias("own"))
    tags = F.filter(F.array_distinct(F.concat("own", F.array(*map(F.lit, default)))), lambda t: ~hit(t))
    post = F.trim(F.concat("text", F.lit("  "), F.array_join("own", " ")))
    bare = F.trim(F.regexp_replace("text", f"[{patterns.CLOSING} ]+$", ""))
    title = F.substring(F.when(bare == "", F.col("text")).otherwise(bare), 1, longest)
    rows = rows.select("clip_id", "pos", "text", F.array_join(tags, ",").alias("tags"), post.alias("post"), title.alias("title"))
    return rows.select("clip_id", "pos", "tags", *(F.when(hit(F.col(c)), F.col("text")).otherwise(F.col(c)).alias(c) for c in ("post", "title")))


def noun_fallback(documents: DataFrame, generic: list[str], templates: list[str], banned: list[str] = ()) -> DataFrame:
    """(doc_id, pos, caption): each template with the text's first word of four letters that is no generic word or verb form, but for those that hold a banned term; texts without such a word give none."""
    tokens = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)), lambda t: F.trim(t, F.lit("'")))
    noun = F.get(F.filter(tokens, lambda t: t.rlike("^[a-z]{4,}$") & ~t.isin(generic) & ~t.rlike("(ed|ing|ly)$")), F.lit(0))
    rows = documents.select("doc_id", noun.alias("noun")).where("noun is not null")
    made = F.array(*(F.concat(F.lit(a), "noun", F.lit(b)) for a, b in (t.split("{}") for t in templates)))
    lines = rows.select("doc_id", F.posexplode(made).alias("pos", "caption"))
    terms = [(t.lower(), " " not in t, 1) for t in banned]
    told = matcher.matched(lines.withColumn("low", F.lower("caption")), "low", terms, "bad", BooleanType(), lambda found: next(found, None) is not None)
    return told.where("not bad").select("doc_id", F.col("pos").cast("long").alias("pos"), "caption")


def token_style_mask(words: DataFrame, terms: list[str], lexicon: list[str]) -> DataFrame:
    """(source, seg_no, word_no, shown): words in lower case without symbols; terms starred but for the first letter, lexicon words without vowels."""
    bare = F.regexp_replace(F.lower("word"), "[^a-z0-9]", "")
    starred = F.concat(F.substring("bare", 1, 1), F.repeat(F.lit("*"), F.length("bare") - 1))
    shown = F.when(F.col("bare").isin(terms), starred).when(F.col("bare").isin(lexicon), F.regexp_replace("bare", "[aeiou]", "*")).when(F.col("bare") == "i", "I").otherwise(F.col("bare"))
    return words.select("source", "seg_no", "word_no", bare.alias("bare")).select("source", "seg_no", "word_no", shown.alias("shown"))


def inflected(roots: list[str], suffixes: list[str]) -> dict[str, str]:
    """The root of each form: roots alone, with each suffix, and with the last consonant doubled, alone and before a suffix. A form of two roots is the first one's."""
    out: dict[str, str] = {}
    for root in roots:
        for middle in ["", *([root[-1]] if root[-1:] not in "aeiou" else [])]:
            for suffix in ["", *suffixes]:
                out.setdefault(root + middle + suffix, root)
    return out


def lexicon_prefix_match(documents: DataFrame, roots: DataFrame, suffixes: list[str]) -> DataFrame:
    """(doc_id, root, n): how often each text holds a form of each root, in one pass a text. roots: (root)."""
    found = documents.select("doc_id", F.lower("text").alias("low"))
    letters, kind = frozenset("abcdefghijklmnopqrstuvwxyz"), MapType(StringType(), LongType())
    out = []
    for k, rows in enumerate(matcher.shards(roots.select(F.col("root").alias("term")).distinct())):
        forms = [(form, True, root) for form, root in inflected(sorted(r.term for r in rows), suffixes).items()]
        found = matcher.matched(found, "low", forms, f"held{k}", kind, lambda values: list(Counter(values).items()), letters)
        out.append(f"held{k}")
    held = F.map_concat(*out) if len(out) > 1 else F.col(out[0])
    return found.select("doc_id", F.explode(held).alias("root", "n")).groupBy("doc_id", "root").agg(F.sum("n").alias("n"))


def common_prefix(templates: DataFrame) -> DataFrame:
    """(clip_id, anchor): the longest run of words that all template lines of a clip start with."""
    lines = templates.select("clip_id", F.split(F.lower("text"), " ").alias("w"))
    sizes = lines.groupBy("clip_id").agg(F.count("*").alias("n"))
    words = lines.select("clip_id", F.posexplode("w").alias("i", "word"))
    same = words.groupBy("clip_id", "i").agg(F.count("*").alias("c"), F.countDistinct("word").alias("kinds"), F.first("word").alias("word")).join(sizes, "clip_id")
    odd = (F.col("c") < F.col("n")) | (F.col("kinds") > 1)
    runs = same.withColumn("stop", F.min(F.when(odd, F.col("i"))).over(over("clip_id"))).where(F.col("stop").isNull() | (F.col("i") < F.col("stop")))
    anchors = runs.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("anchor"))
    return sizes.select("clip_id").join(anchors, "clip_id", "left").select("clip_id", F.coalesce("anchor", F.lit("")).alias("anchor"))


def required_prefix_conformance(candidates: DataFrame, templates: DataFrame, stop: list[str]) -> DataFrame:
    """(clip_id, pos): lines that start with their clip's anchor and go on with a word that is neither in it nor a stop word."""
    rows = candidates.join(common_prefix(templates), "clip_id")
    anchor = F.when(F.col("anchor") == "", F.array().cast("array<string>")).otherwise(F.split("anchor", " "))
    rows = rows.select("clip_id", "pos", F.split(F.lower("text"), " ").alias("w"), anchor.alias("a"))
    rest = F.filter(F.slice("w", F.size("a") + 1, F.greatest(F.size("w"), F.lit(1))), lambda x: ~F.array_contains("a", x) & ~x.isin(stop))
    return rows.where(F.slice("w", F.lit(1), F.size("a")) == F.col("a")).where(F.size(rest) > 0).select("clip_id", "pos")
