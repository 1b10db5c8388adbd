"""Campaign decisions: policies, verdicts, rule mining, links and stage outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import stored
from tidemark.functions.ordered import over

VIDEO = r"\.(mp4|mov|mkv)$"


def discover_unlisted(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source, path, safe_margin): video files on disk that the source's manifest doesn't name, as not safe."""
    found = disk.where(F.lower("path").rlike(VIDEO)).select("source", F.lower("path").alias("path")).distinct()
    return found.join(manifest.select("source", F.lower("path").alias("path")), ["source", "path"], "left_anti").withColumn("safe_margin", F.lit(False))


def links_union(resources: DataFrame) -> DataFrame:
    """(campaign, links): the flagged links, then the footage among the others, each once, in order."""
    rows = resources.select("campaign", F.when(F.col("safe_margin"), 0).otherwise(1).alias("p"), "ord", "path").where((F.col("p") == 0) | F.lower("path").rlike(VIDEO))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "ord", "path"))), lambda x: x["path"])
    return rows.groupBy("campaign").agg(F.array_join(F.array_distinct(ordered), ",").alias("links"))


def alias_resolve(board: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, tag): the canonical tag of each campaign's first category word; an unknown one fails the job. aliases: (alias, tag), a fixed list."""
    rows = board.select("id", F.substring_index("category", " ", 1).alias("alias")).join(F.broadcast(aliases), "alias", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown tag: "), F.coalesce("alias", F.lit("(null)")))).cast("string")
    return rows.select("id", F.coalesce("tag", unknown).alias("tag"))


def policy_decision(documents: DataFrame, prior: DataFrame, required: str, negated: str, mention: str) -> DataFrame:
    """(doc_id, decision, ambiguous): on where the policy is required and not negated; contradictions and bare mentions are off and ambiguous; a prior decision wins."""
    low = F.lower("text")
    must, no, still = low.rlike(required), low.rlike(negated), F.regexp_replace(low, negated, " ").rlike(required)
    unsure = F.when(must & no, still).when(~must & ~no, low.rlike(mention)).otherwise(False)
    rows = documents.select("doc_id", F.when(must & ~no, "on").otherwise("off").alias("own"), unsure.alias("unsure")).join(prior, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("prior", "own").alias("decision"), (F.col("prior").isNull() & F.col("unsure")).alias("ambiguous"))


def fingerprints(links: DataFrame) -> DataFrame:
    """(id, fingerprint): each source's link targets, sorted and joined."""
    return links.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("dst").cast("string"))), "|").alias("fingerprint"))


def sticky_verdict(links: DataFrame, cached: DataFrame, measured: DataFrame) -> DataFrame:
    """(id, verdict, origin): the cached verdict while the links are the same, else the new measurement, else pass.

    cached: (id, fingerprint, verdict); measured: (id, verdict), null where it could not be measured.
    """
    rows = fingerprints(links).join(cached.select("id", F.col("fingerprint").alias("was"), F.col("verdict").alias("old")), "id", "left").join(measured.select("id", F.col("verdict").alias("new")), "id", "left")
    same = F.coalesce(F.col("was") == F.col("fingerprint"), F.lit(False))
    return rows.select("id", F.when(same, F.col("old")).otherwise(F.coalesce("new", F.lit("pass"))).alias("verdict"), F.when(same, "cache").when(F.col("new").isNotNull(), "measured").otherwise("default").alias("origin"))


def preedited_verdict(resources: DataFrame, raw: float = 120, sample: int = 40) -> DataFrame:
    """(campaign, verdict): whether a campaign's footage is cut already.

    pass if a source is a channel of raw recordings, or any of the first `sample` videos of a source is at least `raw`
    seconds long; else skip if at least one, and no fewer than couldn't be read, were measured and every source could be
    listed; else unmeasurable. resources: (campaign, source, ord, path, duration_sec, raw_channel, listed), duration_sec null
    where it couldn't be read.
    """
    video = F.lower("path").rlike(VIDEO)
    rows = resources.withColumn("rn", F.row_number().over(over("campaign", "source", by=[F.when(video, 0).otherwise(1), "ord"])))
    use = video & (F.col("rn") <= sample)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    known = F.col("duration_sec").isNotNull()
    sums = rows.groupBy("campaign").agg(
        F.max(F.coalesce("raw_channel", F.lit(False)) | (use & known & (F.col("duration_sec") >= raw))).alias("raw"), one(use & known).alias("measured"), one(use & ~known).alias("unreadable"), F.min(F.coalesce("listed", F.lit(True))).alias("listed"),
    )
    done = (F.col("measured") >= F.greatest(F.lit(1), F.col("unreadable"))) & F.col("listed")
    return sums.select("campaign", F.when(F.col("raw"), "pass").when(done, "skip").otherwise("unmeasurable").alias("verdict"))


def restriction_expand(lines: DataFrame, phrase: str) -> DataFrame:
    """(campaign, term): phrases that the pattern's first group finds, and their forms with the last word inflected."""
    found = lines.select("campaign", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(phrase), F.lit(1))).alias("p")).distinct()
    stem = F.substring("p", 1, F.length("p") - 1)
    forms = (
        F.when(F.col("p").endswith("e"), F.array(F.concat("p", F.lit("s")), F.concat("p", F.lit("d")), F.concat(stem, F.lit("ing"))))
        .when(F.col("p").rlike("(s|x|z|ch|sh)$"), F.array(F.concat("p", F.lit("es"))))
        .otherwise(F.array(*(F.concat("p", F.lit(x)) for x in ("s", "ed", "ing"))))
    )
    return found.select("campaign", F.explode(F.concat(F.array("p"), forms)).alias("term")).distinct()


def link_frontier(links: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(page_id, hop): pages within `hops` links of a seed, with the fewest links to it. links: (src, dst); seeds: (page_id).

    Each hop is written as a table, so the plan doesn't double with every one.
    """
    links = stored(links.select("src", "dst"), "links")
    seen = seeds.select("page_id").distinct().withColumn("hop", F.lit(0).cast("long"))
    edge = seen
    for hop in range(1, hops + 1):
        reached = links.join(edge, F.col("src") == F.col("page_id"), "left_semi").select(F.col("dst").alias("page_id")).distinct()
        edge = stored(reached.join(seen, "page_id", "left_anti").withColumn("hop", F.lit(hop).cast("long")), f"hop{hop}")
        seen = seen.unionByName(edge)
    return seen


def sink_outputs(rows: DataFrame, folder: str, by: str) -> DataFrame:
    """Replace the partitions of `by` that rows hold, leaving others, and read the folder back."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder).select(*rows.columns)
