"""Campaign briefs: headed sections, whether rules stand elsewhere, the posting checklist and the digest.

Rules are rows (campaign, field, ord, value). Required elements are rows of the field `required` with values
`type: detail`. Reports are rows (campaign, section_no, section, group_no, ord, kind, item) until the end, so a campaign of any
number of lines is sorted by Spark; only a campaign's finished report is one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bounds import bounded_batches
from tidemark.functions.ordered import over
from tidemark.functions.storage import stored
from tidemark.operators import matcher, patterns
from tidemark.operators.board import resource_usage

HANDLE, HASHTAG = "@[A-Za-z0-9_.]+", "#[A-Za-z0-9_]+"
# What sentences about posting, times, bios, views and lengths hold, in lower case.
POSTING = patterns.bounded(r"\b(submit|submission|post|posting|upload|publish)\b")
TIME_WINDOW = patterns.bounded(r"\b\d+\s*(?:min(?:ute)?s?|hours?|hrs?|days?)\b")
LINK_IN_BIO = r"link[\s-]*in[\s-]*bio|in\s+bio"
LEAST_VIEWS = patterns.bounded(r"(?:min(?:imum)?|at least|>=|over)\s*[^.\n]*?\b[\d,]+\s*(?:k|m)?\s*views?|\b[\d,]+\s*(?:k|m)?\s*views?\s*(?:min(?:imum)?|required|to qualify)")
LEAST_SECONDS = patterns.bounded(r"(?:min(?:imum)?|at least)\s*[^.\n]*?\b\d+\s*(?:seconds?|secs?|s)\b")
# Types of required elements that have a section of their own.
CONSUMED = ["mention", "tag", "caption", "hashtag", "logo", "text_overlay", "overlay", "quality", "resolution", "restriction"]
SECTIONS = ["Caption: mentions and tags", "Hashtags", "Link in bio", "On-screen and watermark", "Quality and format", "Submission", "Platform notes", "Payout requirements", "Other requirements", "To verify"]


def heading(line: str) -> tuple[int, str]:
    """(level, title) of a line that is a heading of one to six marks; level 0 for others."""
    bare = line.lstrip("#")
    level = len(line) - len(bare)
    return (level, bare.strip()) if 0 < level < 7 and bare[:1] in ("", " ", "\t") else (0, "")


def outline(text: str) -> Iterator[tuple[int, list[str], str]]:
    """(line number, titles of the headings it stands under, line) of each line that is no heading."""
    stack: list[tuple[int, str]] = []
    for number, line in enumerate(text.split("\n")):
        level, title = heading(line)
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
        else:
            yield number, [t for _, t in stack], line


def lines_under(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, path, line): each line that is no heading, with the titles it stands under, outermost first."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True) for r in outline(t or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (batch.schema.field(key).type, pa.int64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "line_no", "path", "line"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, line_no long, path array<string>, line string")


def section(text: str, title: str, level: int = 2) -> str:
    """What stands under the first heading of that level whose title starts so, deeper headings and the title's rest included; '' without one."""
    out: list[str] | None = None
    for line in text.split("\n"):
        deep, own = heading(line)
        if out is not None:
            if 0 < deep <= level:
                break
            out.append(line)
        elif deep == level and own.startswith(title):
            out = [own[len(title) :]]
    return "\n".join(out or [])


def rules_pointer_flag(documents: DataFrame, titles: tuple[str, ...] = ("Rules text", "On-modal requirements"), pointer: str = patterns.POINTER, least: int = 160) -> DataFrame:
    """(doc_id, n_clean, pointer): whether a brief's rules only point elsewhere: short without placeholders `(none...)`, or with a pointer phrase.

    The rules are the sections of those titles, or the whole brief if they are missing or empty. documents: (doc_id, text).
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = ["\n".join(section(t or "", title) for title in titles).strip() or t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rules, pa.string())], ["doc_id", "rules"])

    rows = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rules string")
    clean = F.regexp_replace(F.regexp_replace("rules", r"(?i)\(none[^)]*\)", ""), f"^[{patterns.BLANK}]+|[{patterns.BLANK}]+$", "")
    rows = rows.select("doc_id", clean.alias("clean"))
    return rows.select("doc_id", F.length("clean").cast("long").alias("n_clean"), ((F.length("clean") < least) | matcher.holds(F.lower("clean"), pointer)).alias("pointer"))


def sentences(rows: DataFrame) -> DataFrame:
    """rows (campaign, part, a, b, text), with a row for each sentence of a text: k and `sentence`."""
    cut = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), r"\n+")
    return rows.select("campaign", "part", "a", "b", F.posexplode(cut).alias("k", "raw")).withColumn("sentence", F.trim("raw")).where("sentence <> ''").drop("raw")


def _first(rows: DataFrame, n: int, distinct: bool) -> DataFrame:
    """The first n sentences of each campaign, equal ones once if distinct: (campaign, ord, sentence)."""
    place = F.struct("part", "a", "b", "k")
    if distinct:
        rows = rows.groupBy("campaign", "sentence").agg(F.min(place).alias("place"))
    else:
        rows = rows.select("campaign", "sentence", place.alias("place"))
    return rows.withColumn("ord", F.row_number().over(over("campaign", by=["place"]))).where(F.col("ord") <= n).select("campaign", "ord", "sentence")


def posting_checklist(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(campaign, place, section, kind, item): what a person has to see to when posting, in order; equal items of a kind once.

    lines: (campaign, doc_id, line_no, text), the brief. kind: box, note, verify, or none for a section that says that
    nothing was found. Sentences of the brief and the rules that tell a bio link, a time to submit within, or least views
    or seconds are quoted, the first few; required elements of a type without a section come under `Other requirements`,
    so that none is dropped.
    """
    rules = stored(rules.select("campaign", "field", "ord", "value"), "rules")  # read by every section
    typed = rules.where("field = 'required'").select("campaign", "ord", F.lower(F.substring_index("value", ":", 1)).alias("type"), F.when(F.col("value").contains(":"), F.trim(F.regexp_replace("value", "^[^:]*:", ""))).otherwise(F.col("value")).alias("detail"))
    of = lambda *fields: rules.where(F.col("field").isin(*fields)).select("campaign", "field", "ord", "value")
    out: list[DataFrame] = []

    def put(rows: DataFrame, number: int, group: int, kind: str | Column, item: Column) -> None:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        out.append(rows.select("campaign", F.lit(number).alias("section_no"), F.lit(group).alias("group_no"), F.col("ord").cast("long").alias("ord"), kind.alias("kind"), item.alias("item")))

    def named(rows: DataFrame, pattern: str) -> DataFrame:
        """Handles or tags of rows (campaign, ord, value), each at its first place."""
        found = rows.select("campaign", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("value"), "ord")
        return found.groupBy("campaign", "value").agg(F.min("ord").alias("ord"))

    of_types = lambda *types: typed.where(F.col("type").isin(*types))
    every = stored(lines.select("campaign").distinct(), "campaigns").withColumn("ord", F.lit(0))

    def nothing(number: int, held: DataFrame, text: str) -> None:
        put(every.join(held.select("campaign").distinct(), "campaign", "left_anti"), number, 9, "none", F.lit(text))

    values = lambda *fields: of(*fields).select("campaign", "ord", "value")
    details = lambda *types: of_types(*types).select("campaign", "ord", F.col("detail").alias("value"))
    mentions, captions_ = named(values("mentions").unionByName(details("mention", "tag")), HANDLE), details("caption")
    put(mentions, 0, 0, "box", F.concat(F.lit("mention "), "value", F.lit(" in the caption")))
    put(captions_, 0, 1, "box", F.col("value"))
    nothing(0, mentions.select("campaign").unionByName(captions_.select("campaign")), "no required mention or tag found")
    tags = named(values("hashtags").unionByName(details("hashtag")), HASHTAG)
    put(tags, 1, 0, "box", F.concat(F.lit("include "), "value"))
    nothing(1, tags, "no required hashtag found")

    order = F.when(F.col("field") == "submission_process", 1).when(F.col("field") == "platform_rules", 2).when(F.col("field") == "deadlines", 3).otherwise(5)
    texts = lines.select("campaign", F.lit(0).alias("part"), F.col("doc_id").alias("a"), F.col("line_no").alias("b"), "text")
    texts = texts.unionByName(of("submission_process", "platform_rules", "deadlines", "payout_terms").select("campaign", order.alias("part"), "ord", F.lit(0).cast("long").alias("b"), F.col("value").alias("text")).withColumnRenamed("ord", "a"))
    texts = texts.unionByName(typed.select("campaign", F.lit(4).alias("part"), F.col("ord").alias("a"), F.lit(0).cast("long").alias("b"), F.col("detail").alias("text")))
    low = F.lower("sentence")
    told = sentences(texts.where(F.lower("text").rlike(r"bio|[0-9]"))).withColumn("bio", matcher.holds(low, LINK_IN_BIO))
    told = told.withColumn("window", matcher.holds(low, POSTING) & matcher.holds(low, TIME_WINDOW)).withColumn("views", matcher.holds(low, LEAST_VIEWS)).withColumn("seconds", matcher.holds(low, LEAST_SECONDS))
    told = stored(told.where("bio or window or views or seconds"), "told")
    put(_first(told.where("bio"), 4, False), 2, 0, "box", F.col("sentence"))

    mark = every.drop("ord").join(rules.where("field = 'watermark_required'").groupBy("campaign").agg(F.max(F.lower("value")).alias("needed")), "campaign", "left").withColumn("ord", F.lit(0))
    needed = F.coalesce("needed", F.lit(""))
    put(mark, 3, 0, F.when(needed.isin("true", "false"), "note").otherwise("verify"), F.when(needed == "true", "watermark: required").when(needed == "false", "watermark: not required").otherwise("watermark requirement unclear"))
    put(details("logo", "text_overlay", "overlay"), 3, 1, "box", F.col("value"))
    limits = details("restriction").join(mark.select("campaign", "needed"), "campaign", "left")
    clash = F.lower("value").rlike(r"watermark|end\s*screen|logo") & (needed == "true")
    put(limits, 3, 2, F.when(clash, "verify").otherwise("note"), F.when(clash, F.concat(F.lit("possible conflict, rules also say: "), "value")).otherwise(F.concat(F.lit("restriction: "), "value")))

    specs = rules.where(F.col("field").isin("resolution", "aspect_ratio", "length")).withColumn("at", F.when(F.col("field") == "resolution", 0).when(F.col("field") == "aspect_ratio", 1).otherwise(2))
    put(specs.select("campaign", F.col("at").alias("ord"), "field", "value"), 4, 0, "box", F.concat(F.replace("field", F.lit("_"), F.lit(" ")), F.lit(": "), "value"))
    put(details("quality", "resolution"), 4, 1, "box", F.col("value"))

    steps, ends = values("submission_process").where(~F.ltrim("value").startswith("#")), values("deadlines")
    windows = _first(told.where("window"), 4, True)
    put(steps, 5, 0, "box", F.col("value"))
    put(windows, 5, 1, "box", F.concat(F.lit("time window: "), "sentence"))
    put(ends, 5, 2, "box", F.concat(F.lit("deadline: "), "value"))
    nothing(5, steps.select("campaign").unionByName(windows.select("campaign")).unionByName(ends.select("campaign")), "no submission step or time window found")
    put(values("platform_rules").where(~F.ltrim("value").startswith("#")), 6, 0, "note", F.col("value"))
    least = told.where("views").withColumn("part", F.col("part") - 10).unionByName(told.where("seconds"))  # those of views first
    put(_first(least, 6, True), 7, 0, "box", F.col("sentence"))
    put(values("payout_terms").where(~F.ltrim("value").startswith("#")), 7, 1, "note", F.concat(F.lit("payout: "), "value"))
    other = typed.where(F.col("detail") != "").join(rules.sparkSession.createDataFrame([(t,) for t in CONSUMED], "type string"), "type", "left_anti")
    put(other, 8, 0, "box", F.col("detail"))
    put(values("ambiguities"), 9, 0, "verify", F.col("value"))

    items = out[0]
    for more in out[1:]:
        items = items.unionByName(more)
    items = items.withColumn("item", F.trim(F.regexp_replace("item", r"\s+", " "))).where("item <> ''")
    key = F.when(F.col("kind") == "none", F.concat("item", F.col("section_no").cast("string"))).otherwise(F.lower("item"))
    once = items.groupBy("campaign", "kind", key.alias("key")).agg(F.min(F.struct("section_no", "group_no", "ord", "item")).alias("r")).select("campaign", "kind", "r.*")
    place = F.row_number().over(over("campaign", by=["section_no", "group_no", "ord", "item", "kind"]))
    return once.select("campaign", place.alias("place"), F.get(F.array(*map(F.lit, SECTIONS)), F.col("section_no")).alias("section"), "kind", "item")


#: Sections of the digest: title and the fields it lists.
DIGEST = [
    ("Required elements", ["required"]), ("Banned words", ["banned_words"]), ("Platform rules", ["platform_rules"]), ("Hashtags and mentions", ["hashtags", "mentions"]), ("Submission process", ["submission_process"]),
    ("Deadlines", ["deadlines"]), ("Payout terms", ["payout_terms"]), ("Style guidance", ["style_guidance"]), ("Open questions", ["ambiguities"]),
]


def stats_line(pay: Column, total: Column, paid: Column, left: Column, least: Column, most: Column) -> Column:
    """Pay, budget, least payout and most a video, in dollars and percent; parts that aren't known are left out."""
    money = lambda c, digits: F.concat(F.lit("$"), F.format_number(c.cast("double"), digits))
    rest = F.when(left.isNotNull(), F.concat(F.lit(", "), F.bround(left * 100, 0).cast("long").cast("string"), F.lit("% remaining"))).otherwise("")
    parts = F.concat_ws(
        "; ", F.when(pay.isNotNull(), F.format_string("pay $%.2f/1K", pay.cast("double"))),
        F.when(total.isNotNull(), F.concat(F.lit("budget "), money(F.coalesce(paid, F.lit(0.0)), 0), F.lit("/"), money(total, 0), rest)),
        F.when(least.isNotNull(), F.concat(F.lit("min payout "), money(least, 2))), F.when(most.isNotNull(), F.concat(F.lit("max/video "), money(most, 0))),
    )
    return F.when(parts == "", "none captured").otherwise(parts)


def campaign_digest(rules: DataFrame, resources: DataFrame, kinds: DataFrame, stats: DataFrame) -> DataFrame:
    """(campaign, digest): one report a campaign: its stats, each resource with how it was used, and each rule field, whole, `_(none)_` where there is none.

    rules: (campaign, field, ord, value); resources and kinds as for resource_usage; stats: (campaign, stats), a line, which campaigns there are.
    """
    known = resources.join(stats.select("campaign"), "campaign", "left_semi")  # files of no campaign told of are in no report
    used = resource_usage(known, kinds)
    note = F.when(F.col("usage").startswith("UN"), F.concat(F.lit("\n    - note: "), F.when(F.col("kind") == "doc", "could not extract text").otherwise("no handler for this file type"))).otherwise("")
    body = used.select("campaign", F.lit(0).alias("part"), F.lit(0).alias("field_no"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("- **"), "path", F.lit("** ("), "kind", F.lit("): "), "usage", note).alias("line"))
    which = F.lit(None).cast("int")
    second = F.lit(0)
    for k, (_, fields) in enumerate(DIGEST, 1):
        which = F.when(F.col("field").isin(fields), k).otherwise(which)
        for j, field in enumerate(fields[1:], 1):
            second = F.when(F.col("field") == field, j).otherwise(second)
    ruled = rules.select("campaign", which.alias("part"), second.alias("field_no"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("- "), "value").alias("line")).where("part is not null")
    lines = body.unionByName(ruled).groupBy("campaign", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_no", "ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    held = lines.groupBy("campaign").agg(F.map_from_entries(F.collect_list(F.struct("part", "lines"))).alias("held"))
    told = stats.select("campaign", "stats").join(held, "campaign", "left")
    titles = ["Resources and how each was used", *(t for t, _ in DIGEST)]
    blocks = [F.concat(F.lit(f"## {t}\n"), F.coalesce(F.try_element_at("held", F.lit(k)), F.lit("_(none)_"))) for k, t in enumerate(titles)]
    return told.select("campaign", F.concat_ws("\n\n", F.concat(F.lit("# Campaign "), F.col("campaign").cast("string"), F.lit("\nstats: "), "stats"), *blocks).alias("digest"))
