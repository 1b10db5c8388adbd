"""Plug points for user code: batch scorers, a grouped aggregate and a table function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def loudness_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """(id, score) from loudness, spikes above speech, and the text's length."""
    weight = batch.type.map({"audio_spike": 10.0}).fillna(6.0)
    return pd.DataFrame({"id": batch.id, "score": batch.intensity * weight + batch.text.str.len().clip(upper=120) / 12})


def batch_scores(moments: DataFrame, scorer: Scorer = loudness_scorer) -> DataFrame:
    """(id, score): a scorer over Arrow batches of moments; ids it makes up and scores that are no numbers are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = scorer(batch)
            score = pd.to_numeric(got["score"], errors="coerce").round(4)
            known = got.assign(score=score)[got["id"].isin(batch.id) & score.notna()]
            yield known.drop_duplicates("id")[["id", "score"]]

    return moments.select("id", "type", "intensity", "text").mapInPandas(run, "id string, score double")


def prefix_of(lines: pd.Series) -> str:
    """The words that all lines start with."""
    split = [x.lower().split(" ") for x in lines if x is not None]
    out = []
    for words in zip(*split, strict=False):
        if len(set(words)) > 1:
            break
        out.append(words[0])
    return " ".join(out)


def common_prefix_twin(templates: DataFrame) -> DataFrame:
    """(clip_id, anchor) by a grouped aggregate over pandas series; the join-only form is captions.common_prefix."""
    agg = F.pandas_udf(prefix_of, "string", F.PandasUDFType.GROUPED_AGG)
    return templates.groupBy("clip_id").agg(agg("text").alias("anchor"))


class CandidateLines:
    """Table function: a text's lines without bullets and numbers, empty ones left out."""

    def eval(self, text: str):
        for place, line in enumerate((text or "").split("\n")):
            bare = re.sub(r"^[-*0-9.) ]+", "", line).strip(" ")
            if bare:
                yield place, bare


def candidate_lines(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, place, line) by the table function, joined laterally."""
    spark.udtf.register("tidemark_candidate_lines", F.udtf(CandidateLines, returnType="place: bigint, line: string"))
    return spark.sql("SELECT d.doc_id, c.place, c.line FROM {docs} d, LATERAL tidemark_candidate_lines(d.text) c", docs=documents)
