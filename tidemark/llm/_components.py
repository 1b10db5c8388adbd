"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import lean, stored


def forest(a: list[int], b: list[int]) -> dict[int, int]:
    """Least id reachable, for each id named, by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for x, y in zip(a, b, strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {x: root(x) for x in up}


@lean
def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of each batch, replaced by stars that span the same components."""
    for batch in batches:
        got = {x: r for x, r in forest(batch.a.tolist(), batch.b.tolist()).items() if x != r}
        yield pd.DataFrame({"a": list(got.keys()), "b": list(got.values())}, dtype="int64")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of each node of edges (a, b): component is the least id that is reachable.

    Batches are thinned to spanning stars first; then large-star and small-star rounds run on Spark until nothing
    changes, each round written as a table. Null ends and loops add nothing.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    e = stored(e.mapInPandas(_thin, "a long, b long").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = e.groupBy(F.col("b").alias("node")).agg(F.first("b").alias("component"))
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(tops)
