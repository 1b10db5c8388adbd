"""Quality by an interpolated modified Kneser-Ney model of trusted text.

Symbols are the bytes of a text in UTF-8, so texts of every script have a model of their own code points. Map tasks
count the n-grams of the highest order in trusted texts; Spark sums them, derives the continuation counts of each lower
order from the distinct n-grams above it, the discounts D1, D2, D3+ from counts of counts, and joins counts with their
contexts' totals by (language, order, context): that is the model table. A document's perplexity (for each byte) comes
from its text and its language's model. A tenth of the trusted documents (by hash) isn't trained on: a quantile of
their perplexities, each divided by what a text of its length may scatter, is their language's threshold.

Documents stay where they are while the model fits a broadcast of `broadcast_bytes` (12 for each n-gram); beyond that they
are grouped by language, in parts of about `part_bytes` of text, with a copy of the language's model for every part.

Edge cases: null or empty text has no perplexity and isn't kept; a language without trusted text (or null), or without
any among the tenth, has no threshold: its documents are kept; documents without a label are scored like others; texts
are read in pieces of a megabyte with the bytes before as context; rows with a null id go, of rows that repeat an id
the least stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import keyed, lean, stored

BITS = 8
_BEGIN = b"\xff"  # no byte of UTF-8


def grams(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of the order, offsets by part); each part starts with the order - 1 bytes before it."""
    code = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) - (order - 1) for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    n = len(code) - order + 1
    if n <= 0 or not size.sum():
        return np.zeros(0, np.int64), offsets
    packed = np.zeros(n, np.int64)
    for i in range(order):
        packed = (packed << BITS) | code[i : i + n]
    at = np.repeat(np.cumsum(size + order - 1) - size - (order - 1) - offsets[:-1], size) + np.arange(offsets[-1])
    return packed[at], offsets


def _runs(column: pa.Array, order: int, most: int = 1 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, parts) of about `most` bytes; a longer text goes on in the next run."""
    rows, held, size = [], [], 0
    for row, x in enumerate(column):
        raw = _BEGIN * (order - 1) + (x.as_py() or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) - order + 1, most):
            rows.append(row)
            held.append(raw[at : at + most + order - 1])
            size += len(held[-1])
            if size >= most:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def _counted(order: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang, parts in total.items():
                gram, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                count = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(count)], ["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                own = batch.column("text").filter(pa.array(langs == lang))
                for _, parts in _runs(own, order):
                    gram, count = np.unique(grams(parts, order)[0], return_counts=True)
                    total.setdefault(lang, []).append((gram, count))
                    size += len(gram)
                    if size > 4_000_000:
                        yield from told()
                        total, size = {}, 0
        yield from told()

    return run


def fit(trusted: DataFrame, order: int = 6) -> DataFrame:
    """(lang, order, gram, kind, value): of kind 0 an n-gram's discounted share, of kind 1 a context's weight for the order below."""
    top = trusted.where("text is not null and lang is not null").select("lang", "text").mapInArrow(_counted(order), "lang string, gram long, n long")
    level = stored(top.groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"grams{order}")
    levels = [level.withColumn("order", F.lit(order))]
    for k in range(order - 1, 0, -1):
        level = level.groupBy("lang", F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram")).agg(F.count("*").alias("n"))
        levels.append(level.withColumn("order", F.lit(k)))
    counts = levels[0]
    for x in levels[1:]:
        counts = counts.unionByName(x)
    counts = stored(counts.withColumn("context", F.shiftright("gram", BITS)), "counts")
    of = [F.sum((F.col("n") == k).cast("double")) for k in (1, 2, 3, 4)]
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y = n1 / F.greatest(n1 + 2 * n2, F.lit(1.0))
    ratio = lambda a, b: a / F.greatest(b, F.lit(1.0))
    within = lambda x, k: F.greatest(F.lit(0.05), F.least(x, F.lit(k - 0.05)))
    discounts = (
        counts.groupBy("lang", "order").agg(*[c.alias(f"n{k}") for k, c in enumerate(of, 1)])
        .select("lang", "order", within(1 - 2 * y * ratio(n2, n1), 1).alias("d1"), within(2 - 3 * y * ratio(n3, n2), 2).alias("d2"), within(3 - 4 * y * ratio(n4, n3), 3).alias("d3"))
    )
    counts = counts.join(F.broadcast(discounts), ["lang", "order"])  # a row for each language and order
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    contexts = counts.groupBy("lang", "order", "context").agg(F.sum("n").alias("total"), (F.sum(less) / F.sum("n")).alias("weight"))
    shares = counts.withColumn("less", less).join(contexts, ["lang", "order", "context"]).select("lang", "order", "gram", F.lit(0).alias("kind"), ((F.col("n") - F.col("less")) / F.col("total")).alias("value"))
    return stored(shares.unionByName(contexts.select("lang", "order", F.col("context").alias("gram"), F.lit(1).alias("kind"), F.col("weight").alias("value"))), "model")


class Model:
    """One language's tables, looked up by bisection."""

    def __init__(self, tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], order: int):
        self.order = order
        self.tables = {}
        for key, (gram, value) in tables.items():
            at = np.argsort(gram, kind="stable")
            self.tables[key] = gram[at], value[at]
        self.symbols = max(2, len(self.tables.get((1, 0), [[]])[0]) + 1)

    @classmethod
    def of_rows(cls, rows: pd.DataFrame, order: int) -> Model:
        return cls({(int(k), int(kind)): (own.gram.to_numpy(), own.value.to_numpy()) for (k, kind), own in rows.groupby(["order", "kind"])}, order)

    def _value(self, k: int, kind: int, gram: np.ndarray, other: float) -> np.ndarray:
        keys, values = self.tables.get((k, kind), (np.zeros(0, np.int64), np.zeros(0)))
        if not len(keys):
            return np.full(len(gram), other)
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        return np.where(keys[at] == gram, values[at], other)

    def probability(self, gram: np.ndarray) -> np.ndarray:
        """P(last symbol | those before) of packed n-grams of the highest order."""
        p = np.full(len(gram), 1.0 / self.symbols)
        for k in range(1, self.order + 1):
            own = gram & ((1 << (BITS * k)) - 1)
            p = self._value(k, 0, own, 0.0) + self._value(k, 1, own >> BITS, 1.0) * p
        return p

    def log_sums(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities in units of 1 / UNITS, number of symbols) of each part: whole numbers, so that no sum depends on what else is summed."""
        gram, offsets = grams(parts, self.order)
        kinds, back = np.unique(gram, return_inverse=True)
        logs = np.rint(np.log(self.probability(kinds)) * UNITS).astype(np.int64)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(logs[back])])
        return total[offsets[1:]] - total[offsets[:-1]], np.diff(offsets)


PACKED_BYTES = 16  # an n-gram's row in a packed table: 64 bits and a 64-bit value
UNITS = 1 << 28


def packed_models(model: DataFrame, order: int) -> dict[str, Model]:
    """Each language's model, brought to the driver as packed tables: PACKED_BYTES a row, so only where few rows are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            got = [(lang, int(k), int(kind), own.gram.to_numpy(np.int64).tobytes(), own.value.to_numpy(np.float64).tobytes()) for (lang, k, kind), own in rows.groupby(["lang", "order", "kind"])]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got, strict=True)], ["lang", "order", "kind", "grams", "values"])

    parts: dict[str, dict] = {}
    table = model.mapInArrow(run, "lang string, order long, kind long, grams binary, values binary").toArrow()
    for lang, k, kind, gram, value in zip(*(c.to_pylist() for c in table.columns), strict=True):
        parts.setdefault(lang, {}).setdefault((k, kind), []).append((np.frombuffer(gram, np.int64), np.frombuffer(value, np.float64)))
    return {lang: Model({key: tuple(np.concatenate(x) for x in zip(*own, strict=True)) for key, own in tables.items()}, order) for lang, tables in parts.items()}


def perplexities(docs: DataFrame, model: DataFrame, order: int = 6, broadcast_bytes: int = 96 << 20, part_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, lang, perplexity, size) of each document; size is that of its text in bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "lang", "perplexity", "size"]
    out = f"doc_id {kind}, lang string, perplexity double, size long"

    def scored(ids: pa.Array, langs: list, column: pa.Array, models: dict) -> pa.RecordBatch:
        told = np.array([x if x in models else "" for x in langs], object)
        logs, size = np.zeros(len(ids), np.int64), np.array([len((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in column], np.int64)
        for lang in sorted(set(told) - {""}):
            at = np.flatnonzero(told == lang)
            for rows, parts in _runs(column.take(pa.array(at)), order):
                np.add.at(logs, at[rows], models[lang].log_sums(parts)[0])
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(told != "", np.exp(-logs / UNITS / size), np.nan)
        return pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(value, from_pandas=True), pa.array(size)], names)

    if model.count() * PACKED_BYTES <= broadcast_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(packed_models(model, order))

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield scored(batch.column("doc_id"), batch.column("lang").to_pylist(), batch.column("text"), shared.value)

        return docs.select("doc_id", "lang", "text").mapInArrow(run, out)

    def grouped(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        models = {left.column("lang")[0].as_py(): Model.of_rows(right.to_pandas(), order)} if len(right) and len(left) else {}
        return pa.Table.from_batches([scored(left.column("doc_id").combine_chunks(), left.column("lang").to_pylist(), left.column("text").combine_chunks(), models)])

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = max(1, -(-total // part_bytes))
    dealt = docs.select("doc_id", "lang", "text").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    copies = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return dealt.groupBy("lang", "salt").cogroup(copies.groupBy("lang", "salt")).applyInArrow(grouped, out)


def quality(documents: DataFrame, labels: DataFrame, order: int = 6, quantile: float = 0.99, allowance: float = 2.0, small: int = 2_000_000) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of each document.

    Trusted are documents with label quality 1. A short text's perplexity scatters by about exp(allowance / sqrt(size
    in bytes)): the threshold of a language is the quantile, over its held-out trusted texts, of perplexities divided
    by that, and times it again for the text that is judged. small: trusted ids up to which they are broadcast; more
    are joined by shuffle.
    """
    docs = keyed(documents, "doc_id", "text", "lang")
    good = keyed(labels, "doc_id", "quality").where("quality = 1").select("doc_id")
    good = F.broadcast(good) if good.count() <= small else good
    trusted = docs.join(good, "doc_id", "left_semi")
    tenth = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scatter = F.when(F.col("size") > 0, F.exp(allowance / F.sqrt("size")))
    scored = stored(perplexities(docs, fit(trusted.where(~tenth), order), order), "perplexity").withColumn("scatter", scatter)
    judged = scored.where(tenth & F.col("perplexity").isNotNull()).join(good, "doc_id", "left_semi")
    limits = judged.groupBy("lang").agg(F.percentile_approx(F.col("perplexity") / F.col("scatter"), quantile, 10_000).alias("limit"))
    threshold = F.col("limit") * F.col("scatter")
    within = F.col("perplexity") / F.col("scatter") <= F.col("limit")  # the very values that the limit was chosen from
    return (
        scored.join(F.broadcast(limits), "lang", "left").withColumn("threshold", threshold)  # a row for each language
        .select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), ((F.col("size") > 0) & F.coalesce(within, F.lit(True))).alias("keep"))
    )
