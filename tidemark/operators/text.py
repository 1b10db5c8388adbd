"""Text gates and transforms over moments, candidate lines, documents and pages."""

from __future__ import annotations

import functools
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidemark.functions.bounds import bounded_batches, small_or_not
from tidemark.functions.ordered import earlier, joined, over, words_pattern
from tidemark.functions.storage import stored
from tidemark.operators import matcher, patterns
from tidemark.operators.folds import fold_by_key


def filler_kill(moments: DataFrame, phrases: list[str]) -> DataFrame:
    """Moments whose text holds none of the dead-air phrases; moments without text stay."""
    return moments.where(~((F.length("text") > 0) & F.lower("text").rlike(words_pattern(phrases))))


def junk_text_flag(documents: DataFrame, least: int = 4, floor: int = 5, share: float = 0.5) -> DataFrame:
    """(doc_id, n_tokens, top, junk): too few tokens, or one token that makes up most of them. Counted text by text, without a shuffle."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    bounded_batches(documents.sparkSession)

    def told(text: str | None, pattern: re.Pattern) -> tuple[int, int]:  # one text's counts are held at a time
        counts = Counter(m.group() for m in pattern.finditer(text or ""))
        return counts.total(), max(counts.values(), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = re.compile("[a-z']+")
        for batch in batches:
            size, top = zip(*(told(t.as_py(), tokens) for t in batch.column("low")), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(top, pa.int64())], ["doc_id", "n_tokens", "top"])

    rows = documents.select("doc_id", F.lower("text").alias("low")).mapInArrow(run, f"doc_id {kind}, n_tokens long, top long")
    return rows.withColumn("junk", (F.col("n_tokens") < least) | (F.col("top") >= F.greatest(F.lit(float(floor)), share * F.col("n_tokens"))))


def prefilter_candidates(moments: DataFrame, shortest: float = 3.0, loud: float = 6.0, least: int = 4) -> DataFrame:
    """(id, source): moments long enough, not junk unless a loud spike, and the first of equal texts in a source."""
    words = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0)))
    good = moments.where((F.col("end_s") - F.col("start_s") >= shortest) & ((words >= least) | ((F.col("type") == "audio_spike") & (F.col("intensity") >= loud))))
    key = F.substring(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))), 1, 200)
    rows = good.withColumn("key", key).withColumn("rn", F.row_number().over(over("source", "key", by=["start_s", "end_s", "id"])))
    return rows.where((F.col("key") == "") | (F.col("rn") == 1)).select("id", "source")


def barrier_detect(pages: DataFrame, categories: list[tuple[str, list[str]]]) -> DataFrame:
    """(page_id, barrier): the first category, in order of priority, one of whose patterns the page's text holds."""
    bounded_batches(pages.sparkSession)
    low, found = F.lower("html"), F.lit(None).cast("string")
    for name, own in reversed(categories):
        found = F.when(matcher.holds(low, "|".join(own)), name).otherwise(found)
    return pages.select("page_id", found.alias("barrier"))


def decoded(text: pd.Series) -> pd.Series:
    """Character references decoded once: named ones by longest match, numbered ones, with or without the semicolon, by the rules of HTML."""
    return text.map(html.unescape, na_action="ignore")


def html_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): markup dropped, character references decoded in a single pass, blanks and blank lines collapsed. Null is empty."""
    x = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    rows = pages.select("page_id", F.regexp_replace(x, r"(?s)<[^>]+>", " ").alias("x"))
    rows = rows.select("page_id", F.when(F.contains("x", F.lit("&")), F.pandas_udf(decoded, "string")("x")).otherwise(F.col("x")).alias("x"))
    x = F.regexp_replace(F.regexp_replace("x", r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return rows.select("page_id", F.regexp_replace(x, f"^[{patterns.BLANK}]+|[{patterns.BLANK}]+$", "").alias("text"))


def corpus_build(documents: DataFrame, limit: int = 24_000, salts: int = 64) -> DataFrame:
    """(source, corpus): a source's texts in order, cut at the limit.

    Ids and lengths alone tell which texts stand before the limit, first in `salts` parts of a source, then in it; only those texts meet.
    """

    def before_limit(rows: DataFrame, *keys: str, by: list[str]) -> DataFrame:
        before = F.coalesce(F.sum("n").over(earlier(*keys, by=by)), F.lit(0))
        return rows.withColumn("before", before).where(F.col("before") < limit).drop("before")

    texts = documents.where("text is not null").select("source", "doc_id", "text")
    size = (F.length("text") + 1).cast("long").alias("n")
    narrow = texts.select("source", "doc_id", size, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    first = before_limit(before_limit(narrow, "source", "salt", by=["doc_id"]), "source", by=["doc_id"])
    chosen = small_or_not(stored(first.select(F.col("source").alias("s"), F.col("doc_id").alias("d")).distinct(), "chosen"))
    own = texts.join(chosen, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    own = before_limit(own.select("source", "doc_id", size, F.substring("text", 1, limit).alias("text")), "source", by=["doc_id", "text"])
    corpora = own.groupBy(F.col("source").alias("s")).agg(F.substring(joined(["doc_id"], "text", "\n"), 1, limit).alias("corpus"))
    sources = documents.select("source").distinct()  # one without any text too
    return sources.join(corpora, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("corpus", F.lit("")).alias("corpus"))


def dictionary_language_vote(documents: DataFrame, stop_words: dict[str, list[str]], least: int = 8) -> DataFrame:
    """(doc_id, lang): the language whose stop words make up most of the tokens; null if there are few or none.

    stop_words: a short list a language. On equal shares the earlier language wins. Counted text by text, in one pass over its tokens.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    lists = [(code, frozenset(own)) for code, own in stop_words.items()]

    def vote(text: str, pattern: re.Pattern) -> str | None:
        counts = Counter(pattern.findall(text))
        if counts.total() < least:
            return None
        votes = [sum(counts[w] for w in own) for _, own in lists]
        return lists[votes.index(max(votes))][0] if max(votes, default=0) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile("[a-zà-ÿ']+")
        for batch in batches:
            told = [vote(t or "", pattern) for t in batch.column("low").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told, pa.string())], ["doc_id", "lang"])

    return documents.select("doc_id", F.lower("text").alias("low")).mapInArrow(run, f"doc_id {kind}, lang string")


def banned_gauntlet(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """(clip_id, pos, reason): the first banned term that each candidate line holds; null for survivors.

    terms: (ordinal, term, is_pattern): phrases match anywhere, single words as whole words, in one pass a line with an
    automaton of them all; patterns are a few, each searched for.
    """
    low = candidates.select("clip_id", "pos", F.lower("text").alias("low"), F.lit(None).cast("long").alias("first"))
    for rows in matcher.shards(terms):
        plain = [(r.term, " " not in r.term, int(r.ordinal)) for r in rows if not r.is_pattern]
        own = [F.when(F.rlike("low", F.lit(r.term)), F.lit(int(r.ordinal)).cast("long")) for r in rows if r.is_pattern]
        hit = matcher.matched(low, "low", plain, "hit", LongType(), lambda found: min(found, default=None))
        low = hit.select("clip_id", "pos", "low", F.least("first", "hit", *own).alias("first"))
    named = small_or_not(terms.select(F.col("ordinal").cast("long").alias("first"), F.col("term").alias("reason")))
    return low.select("clip_id", "pos", "first").join(named, "first", "left").select("clip_id", "pos", "reason")


def grounding_anti_join(candidates: DataFrame, documents: DataFrame, generic: list[str], stem: int = 4) -> DataFrame:
    """(clip_id, pos, unsupported, specific): what a line says that its source text doesn't, and whether it says something of its own that it does.

    candidates: (clip_id, pos, text); documents: (doc_id, text), the source text of the clip of that id. Tokens of three
    characters or more that aren't generic are supported if the source holds them, or a word with the same first `stem`
    characters; unsupported: those that aren't, sorted, joined by commas. A clip's source is read before its lines, in
    one stream, so neither side's words are exploded.
    """
    source = documents.select(F.col("doc_id").alias("clip_id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.lower("text").alias("low"))
    lines = candidates.select("clip_id", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), F.lower("text").alias("low"))
    common, pattern = frozenset(generic), re.compile("[a-z']+")

    def step(known, row):
        tokens = {t.strip("'") for t in pattern.findall(row.low or "")}
        known = known or frozenset()
        if row.kind == 0:
            return known | tokens | {t[:stem] + "*" for t in tokens if len(t) >= stem}, None
        said = [t for t in tokens if len(t) > 2 and t not in common]
        odd = [t for t in said if t not in known and not (len(t) >= stem and t[:stem] + "*" in known)]
        return known, {"unsupported": ",".join(sorted(odd)), "specific": len(odd) < len(said)}

    told = fold_by_key(source.unionByName(lines), ["clip_id"], ["kind", "pos"], "told", StructType().add("unsupported", "string").add("specific", "boolean"), lambda: None, step)
    return told.where("kind = 1").select("clip_id", "pos", "told.unsupported", "told.specific")


def text_normalize(documents: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(doc_id, title): dashes and quotes in ASCII, blanks collapsed, words in title case; 'clip' if nothing is left.

    A word ends at blanks, hyphens and slashes. Its first letter goes to upper case unless a digit stands before it; the
    rest stays. ascii_only: drop all other characters.
    """
    bounded_batches(documents.sparkSession)
    bare = [(r"[ \t\n\r]+", " "), *patterns.PUNCTUATION, *([(r"[^\x00-\x7F]", "")] if ascii_only else []), (" {2,}", " ")]

    def titled(texts: pa.Array) -> pa.Array:
        word = re.compile(r"(?:^|(?<=[ /-]))((?:(?![ /-])[\W_])*)([^\W_])")
        for of, plain in bare:
            texts = pc.replace_substring_regex(texts, of, plain)
        up = lambda m: m[1] + (m[2] if m[2] == "ß" else m[2].upper())  # noqa: E731  ß has no capital of one letter
        return pa.array((None if t is None else word.sub(up, t) or "clip" for t in (x.as_py() for x in pc.utf8_trim(texts, " "))), pa.string())

    return documents.select("doc_id", F.arrow_udf(titled, "string")("text").alias("title"))


def harvest_urls(urls: DataFrame) -> DataFrame:
    """(page_id, pos, url): the distinct links of each page's text in order, without trailing punctuation."""
    text = urls.groupBy("page_id").agg(joined(["url"], "url", " and ").alias("text"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^ ]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,);\]}'\"]+$", "")))
    return text.select("page_id", F.posexplode(found).alias("pos", "url")).withColumn("pos", F.col("pos").cast("long"))


def link_kind(urls: DataFrame) -> DataFrame:
    """(page_id, url, kind, rules): what a link leads to, and the way its rules can be read, if it leads to some.

    urls: (page_id, url, label). kind, by host, path and extension: drive_folder, gdoc, channel, vod, file, site, or
    other for what is no web link. rules: gdoc for shared documents and files, local for a document's path, web for a
    document's address or a page that its label or its path, never its query, calls rules; else null.
    """
    low, label = F.lower("url"), F.lower(F.coalesce("label", F.lit("")))
    path = F.substring_index(low, "?", 1)
    any_of = _any
    web = low.rlike("^https?:")
    folder = low.contains("drive.google.com") & any_of(low, ["/folders/", "folder"])
    shared = any_of(low, ["docs.google.com", "drive.google.com"])
    channel = any_of(low, patterns.CHANNEL_HOSTS) & ~any_of(low, patterns.ONE_VIDEO) & (any_of(low, patterns.CHANNEL_PATHS) | low.rlike(patterns.CHANNEL_ENDS))
    video = any_of(low, patterns.VIDEO_HOSTS)
    kind = (
        F.when(~web, "other").when(folder, "drive_folder").when(shared, "gdoc").when(channel, "channel").when(video, "vod")
        .when(path.rlike(patterns.FILE_ENDS), "file").otherwise("site")
    )
    search = low.contains("whop.com") & any_of(path, ["/discover", "/search"])
    rules = (
        F.when(~web, F.when(low.rlike(patterns.DOC_ENDS), "local")).when(video | folder, None).when(shared, "gdoc").when(path.rlike(patterns.DOC_ENDS), "web").when(search, None)
        .when(any_of(label, patterns.RULE_LABELS) | any_of(path, patterns.RULE_PATHS), "web")
    )
    return urls.select("page_id", "url", kind.alias("kind"), rules.alias("rules"))


def hash_assign(moments: DataFrame, n: int = 7, m: int = 5) -> DataFrame:
    """(id, bucket, second, twelfth): stable buckets from the id's digest; twelfth is the whole digest modulo 12."""
    md5 = F.md5(F.col("id").cast("binary"))
    number = lambda hexed: F.conv(hexed, 16, 10).cast("long")
    h = number(F.substring(md5, 1, 8))
    digits = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: number(F.substr(md5, i, F.lit(1))))
    whole = number(F.substring(md5, 32, 1)) + 4 * F.aggregate(digits, F.lit(0).cast("long"), lambda x, y: x + y)  # powers of 16 are 4 modulo 12
    return moments.select("id", F.pmod(h, F.lit(n)).alias("bucket"), F.pmod(F.floor(h / 7).cast("long"), F.lit(m)).alias("second"), F.pmod(whole, F.lit(12)).cast("long").alias("twelfth"))


def _any(of: Column, words: list[str]) -> Column:
    return functools.reduce(lambda x, y: x | y, [of.contains(w) for w in words])


def wait_seconds(low: Column) -> Column:
    """Seconds that an error text in lower case asks to wait: a duration of hours, minutes and seconds, a retry delay, or a time to retry after."""
    span = F.regexp_extract(low, r"try again in ([0-9hms.\s]+)", 1)
    unit = lambda x: F.when(x.endswith("h"), 3600.0).when(x.endswith("m"), 60.0).otherwise(1.0)
    parts = F.regexp_extract_all(span, F.lit(r"[0-9.]+\s*[hms]"), F.lit(0))
    total = F.aggregate(parts, F.lit(0.0), lambda x, y: x + F.coalesce(F.regexp_extract(y, "^[0-9.]+", 0).try_cast("double"), F.lit(0.0)) * unit(y))
    number = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("double")
    return F.when(F.size(parts) > 0, total).otherwise(F.coalesce(number(r"retry_delay\s*\{\s*seconds:\s*([0-9]+)"), number(r"retry[\s_-]*after[\"'\s:]*([0-9]+)")))


def reason_tag(text: Column) -> Column:
    """A short label of why a run came to nothing."""
    low, out = F.lower(text), F.lit("nothing usable")
    for words, tag in reversed(patterns.REASON_TAGS):
        out = F.when(_any(low, words), tag).otherwise(out)
    return out


def log_classify(errors: DataFrame, longest: float = 90) -> DataFrame:
    """(event_id, rate, wait_s, dead_model, share, blocked, reason): what an error text says, by cascades of its marks.

    rate: daily, minute, or error for what is no limit; an unclear one is daily if it asks to wait longer than
    `longest`. dead_model: the model itself is gone. share: permission, throttle or unknown, by the status code before
    the words. blocked: the address is shut out. reason: a run's label for it.
    """
    rows = errors.select("event_id", F.lower(F.coalesce("msg", F.lit(""))).alias("low"))
    rows = rows.select("event_id", "low", wait_seconds(F.col("low")).alias("wait"), F.nullif(F.regexp_extract("low", r"status code[:\s]+([0-9]{3})", 1), F.lit("")).cast("int").alias("code"))
    low = F.col("low")
    limit, day, minute = _any(low, patterns.RATE_MARKS), _any(low, patterns.DAY_MARKS), _any(low, patterns.MINUTE_MARKS)
    rate = F.when(~limit, "error").when(day & ~minute, "daily").when(minute & ~day, "minute").when(F.col("wait") > longest, "daily").otherwise("minute")
    dead = _any(low, ["model_not_found", "modelnotfound"]) | (low.contains("404") & ~low.contains("429")) | (low.contains("model") & _any(low, patterns.GONE_MARKS))
    share = (
        F.when(F.col("code").isin(401, 403, 404), "permission").when((F.col("code") == 429) | F.col("code").between(500, 599), "throttle")
        .when(_any(low, patterns.SHARE_BUSY), "throttle").when(_any(low, patterns.SHARE_DENIED), "permission").otherwise("unknown")
    )
    return rows.select("event_id", rate.alias("rate"), F.round(F.when(limit, F.col("wait")), 4).alias("wait_s"), dead.alias("dead_model"), share.alias("share"), _any(low, patterns.BLOCK_MARKS).alias("blocked"), reason_tag(low).alias("reason"))


def balanced_arrays(text: str) -> Iterator[str]:
    """Spans of balanced brackets, by where they start; brackets in strings, with their escapes, don't count."""
    found, open_, quoted, skip = [], [], False, False
    for i, c in enumerate(text):
        if quoted:
            quoted = skip or c != '"'
            skip = c == "\\" and not skip
        elif c == '"' and open_:
            quoted, skip = True, False
        elif c == "[":
            open_.append(i)
        elif c == "]" and open_:
            found.append((open_.pop(), i + 1))
    for a, b in sorted(found):
        yield text[a:b]


def parsed_array(text: str, tolerant: bool) -> list | None:
    """The array from the first to the last bracket of a noisy text; None if that doesn't parse. tolerant: then the first balanced span that does."""
    a, b = text.find("["), text.rfind("]")
    if a < 0 or b < a:
        return None
    for span in (text[a : b + 1], *(balanced_arrays(text) if tolerant else ())):
        try:
            return json.loads(span)
        except (ValueError, RecursionError):
            continue
    return None


def plain_lines(text: str) -> list[str]:
    """Lines without bullets, numbers, quotes and trailing commas; prefaces and single characters are left out."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line.strip()).strip().strip('"').strip("'").rstrip(",").strip()
        if len(line) > 1 and not line.lower().startswith(tuple(patterns.PREFACES)):
            out.append(line)
    return out


def json_array_repair(errors: DataFrame, tolerant: bool = False) -> DataFrame:
    """(event_id, place, id, score, line): what a model's noisy answer lists.

    Fences are stripped. Of an array anywhere in the text, objects give id and score (null if it is no whole number),
    other elements a line; without one, or with an empty one, each of the text's lines, cleaned, is a line.
    """
    kind = errors.schema["event_id"].dataType.simpleString()

    def told(text: str | None) -> list[tuple]:
        bare = re.sub(r"\s*```\s*$", "", re.sub(r"^```[a-zA-Z0-9]*\s*", "", (text or "").strip())).strip()
        rows = []
        for x in parsed_array(bare, tolerant) or []:
            if isinstance(x, dict):
                score = x.get("score")
                rows.append((None if x.get("id") is None else str(x["id"]), score if isinstance(score, int) and not isinstance(score, bool) else None, None))
            elif line := (x if isinstance(x, str) else json.dumps(x)).strip():
                rows.append((None, None, line))
        return rows or [(None, None, line) for line in plain_lines(bare)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *r) for i, text in zip(batch.column("event_id").to_pylist(), batch.column("msg").to_pylist(), strict=True) for k, r in enumerate(told(text))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (batch.schema.field("event_id").type, pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["event_id", "place", "id", "score", "line"])

    return errors.select("event_id", "msg").mapInArrow(run, f"event_id {kind}, place long, id string, score long, line string")
