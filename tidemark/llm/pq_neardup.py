"""Embedding near-dedup with product quantisation.

Equal vectors of one label are one class. The distinct ones go into coarse inverted lists (centroids shared by all
labels of one vector size, trained on a bounded sample; lists are kept by label) and are coded by their residual's
nearest centroid in each subspace. A vector is a member of its nearest list and a query in lists that can hold a
neighbour: one within distance r of the query that lies nearer to centroid c than to the query's own centroid o must
cross the plane between c and o, so the query is at most r from that plane. Of a distance r in a random direction only
r / sqrt(size) is to be expected across a plane, so lists whose plane is within `sure` times that are probed: all that
can hold a neighbour for vectors of up to sure^2 components, all but some in ten thousand beyond (sure of sqrt(size) or
more is exact for any). Inside a list, asymmetric distances from a query's tables to the codes keep the members within
reach (the query's distance can't fall short of the table distance by more than the code's own error), and these are
ranked anew by exact cosine.

The number of lists grows with the root of the largest label's size (max_lists at most), so a query meets ever smaller
shares of its label. Large lists are cut into blocks of members, each a task's work of its own, so a hot label or list is spread; a
query is a row in each block. Blocks return link counts per vector and edges that span what they linked, never pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
with nothing and are classes of their own; rows with a null vec_id go, of rows that repeat a vec_id the least stays.
Vectors of different sizes never meet.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import keyed, lean, packed, stored
from tidemark.llm._components import components, forest


def k_means(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centroids of the points."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = nearest(points, centres)[0]
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]
    return np.sqrt(np.maximum(square, 0))


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(points, centres)
    own = d.argmin(1)
    return own, d[np.arange(len(points)), own]


class Quantiser:
    """Coarse centroids and residual subspace codebooks of one (label, size)."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int):
        dim = sample.shape[1]
        self.coarse = k_means(sample, lists)
        self.apart = distances(self.coarse, self.coarse)
        self.cuts = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
        residual = sample - self.coarse[nearest(sample, self.coarse)[0]]
        self.books = [k_means(residual[:, a:b], codes) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def probes(self, unit: np.ndarray, radius: float, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """(own list, whether each list is to be probed)."""
        d = distances(unit, self.coarse)
        own = d.argmin(1)
        to_plane = (d**2 - d.min(1)[:, None] ** 2) / np.maximum(2 * self.apart[own], 1e-9)
        return own, to_plane <= radius * min(1.0, sure / np.sqrt(unit.shape[1])) + 1e-6

    def encode(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([nearest(residual[:, a:b], book)[0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], 1).astype(np.uint8)

    def decoded(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([book[code[:, m]] for m, book in enumerate(self.books)], 1)

    def table_distances(self, residual: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Asymmetric distance of each query's residual to each code, from per-subspace tables."""
        total = np.zeros((len(residual), len(code)))
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            total += (distances(residual[:, a:b], book) ** 2)[:, code[:, m]]
        return np.sqrt(total)


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    return x / np.sqrt((x**2).sum(1))[:, None]


def _deal(models, radius: float, sure: float):
    """One row for each list a vector is of use in; its own one with code and code error."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, own in batch.groupby(batch.raw.map(len)):
                model: Quantiser = models.value[int(size)]
                unit = _units(own.raw.tolist())
                home, reach = model.probes(unit, radius, sure)
                residual = unit - model.coarse[home]
                code = model.encode(residual)
                error = np.sqrt(((residual - model.decoded(code)) ** 2).sum(1))
                row, target = np.nonzero(reach)
                mine = home[row] == target
                yield pd.DataFrame(
                    {
                        "label": own.label.to_numpy()[row], "dim": int(size), "list": target, "vec_id": own.vec_id.to_numpy()[row], "copies": own.copies.to_numpy()[row],
                        "raw": own.raw.to_numpy()[row], "member": mine, "code": [packed(code[i]) if m else None for i, m in zip(row, mine, strict=True)], "error": np.where(mine, error[row], 0.0),
                    }
                )

    return run


_DEALT = "label string, dim long, list long, vec_id long, copies long, raw binary, member boolean, code binary, error double"


def _linked(models, cosine: float, radius: float, step: int = 256):
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        members = unit[unit.role == "member"]
        if members.empty:
            return empty
        model: Quantiser = models.value[int(unit.dim.iloc[0])]
        centre = model.coarse[int(unit.list.iloc[0])]
        code = np.stack([np.frombuffer(c, np.uint8) for c in members.code])
        there, ids, copies, error = _units(members.raw.tolist()), members.vec_id.to_numpy(), members.copies.to_numpy(), members.error.to_numpy()
        queries = unit[unit.role == "query"]
        a, b, who, links = [], [], [], []
        for at in range(0, len(queries), step):
            part = queries.iloc[at : at + step]
            here, names = _units(part.raw.tolist()), part.vec_id.to_numpy()
            near = model.table_distances(here - centre, code) <= radius + error[None] + 1e-6
            row, col = np.nonzero(near)
            ok = np.einsum("ij,ij->i", here[row], there[col]) >= cosine
            row, col = row[ok], col[ok]
            other = names[row] != ids[col]
            count = np.bincount(row[other], copies[col[other]], minlength=len(part)).astype(np.int64)
            who += names[count > 0].tolist()
            links += count[count > 0].tolist()
            star = forest(names[row[other]].tolist(), ids[col[other]].tolist())
            a += [x for x, r in star.items() if x != r]
            b += [r for x, r in star.items() if x != r]
        star = {x: r for x, r in forest(a, b).items() if x != r}
        return pd.DataFrame({"a": [*star.keys(), *who], "b": [*star.values(), *([-1] * len(who))], "links": [*([0] * len(star)), *links]}, dtype="int64")

    return run


def embedding_links(embeddings: DataFrame, cosine: float = 0.93, sample: int = 16_384, per_list: int = 16, max_lists: int = 2048, subspaces: int = 16, codes: int = 64, block: int = 1024, sure: float = 4.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector; see the module.

    sample: vectors of each size that train its centroids and codebooks (a bound; every vector is indexed). per_list:
    vectors of a label that a list has at least on average.
    """
    rows = keyed(embeddings, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    good = rows.where(F.col("label").isNotNull() & sound)
    as_bytes = "vec_id long, label string, raw binary"

    @lean
    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for x in batch.column("x").to_pylist():
                v = np.array(x)
                v = v / np.abs(v).max()  # squares stay finite
                blobs.append(packed(v + 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["vec_id", "label", "raw"])

    bare = stored(good.mapInArrow(raw, as_bytes), "vectors")
    classes = bare.groupBy("label", "raw").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    order = F.xxhash64("vec_id")
    context = rows.sparkSession.sparkContext

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        model = Quantiser(_units(group.raw.tolist()), int(group.lists.iloc[0]), subspaces, codes)
        return pd.DataFrame({"dim": [len(group.raw.iloc[0])], "model": [pickle.dumps(model)]})

    dims = bare.groupBy("label", F.length("raw").alias("dim")).agg(F.count("*").alias("n")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    lists = F.greatest(F.lit(1), F.least(F.lit(max_lists), F.floor(F.col("most") / per_list), F.floor(2 * F.sqrt("most")))).cast("int")
    dims = stored(dims.select("dim", "n", lists.alias("lists")), "sizes")  # a row for each size of vectors
    sampled = bare.withColumn("dim", F.length("raw")).join(F.broadcast(dims), "dim").where(F.pmod(order, F.lit(1 << 20)) <= F.lit(float(sample << 20)) / F.col("n"))
    fitted = sampled.groupBy("dim").applyInPandas(fit, "dim long, model binary").collect()  # one model of bounded size for each size of vectors
    models = context.broadcast({r.dim: pickle.loads(r.model) for r in fitted})

    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    dealt = stored(classes.select("vec_id", "label", "raw", "copies").mapInPandas(_deal(models, radius, sure), _DEALT), "dealt")
    key = ["label", "dim", "list"]
    # A list's members in blocks and its queries in parts, each of bounded size: every pair of them is a unit of work.
    cut = lambda n, c: F.greatest(F.lit(1), F.ceil(c / n)).cast("int")
    blocks = dealt.groupBy(*key).agg(cut(block, F.sum(F.when(F.col("member"), 1).otherwise(0))).alias("blocks"), cut(8 * block, F.count("*")).alias("parts"), F.max("member").alias("any")).where("any").drop("any")
    spread = dealt.join(blocks, key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = spread.where("member").withColumn("block", F.pmod(order, F.col("blocks")).cast("int")).withColumn("part", every("parts")).withColumn("role", F.lit("member"))
    queries = spread.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int")).withColumn("block", every("blocks")).withColumn("role", F.lit("query"))
    work = members.unionByName(queries)
    found = stored(work.groupBy(*key, "block", "part").applyInPandas(_linked(models, cosine, radius), "a long, b long, links long"), "links")
    tops = components(found.where("links = 0").select("a", "b")).withColumnRenamed("node", "rep")
    counts = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    reps = classes.select("label", "raw", F.col("vec_id").alias("rep"), "copies")
    linked = bare.join(reps, ["label", "raw"]).select("vec_id", "rep", "copies").join(counts, "rep", "left").join(tops, "rep", "left")
    about = linked.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return rows.select("vec_id").join(about, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
