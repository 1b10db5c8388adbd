"""Ranked lexical search against plain scoring, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.test_llm import LONG, empty_documents, odd_documents

from tidemark.llm import lexical_dag

ITEMS = "item_id long, text string, Text string"


def plain(docs, items, k=10):
    """Each item against each document."""
    cut = lambda t: re.findall(lexical_dag.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = {i: Counter(cut(t)) for i, t in docs}
    total, length = sum(1 for w in words.values() if w), sum(sum(w.values()) for w in words.values())
    df = Counter(t for w in words.values() for t in w)
    out = set()
    for item, text in items:
        scored = []
        for doc, w in words.items():
            m = 10 + 90 * sum(w.values()) * total // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t in set(cut(text)) if w[t])
            if s > 0:
                scored.append((-s, doc))
        out |= {(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_shared_sums_add_up_to_the_items():
    rng = random.Random(3)
    items = [rng.sample(range(40), rng.randrange(1, 25)) for _ in range(30)] + [[1, 2, 3]] * 4
    nodes, left = lexical_dag.shared_sums(items, 40)

    def leaves(x):
        return [x] if x < 40 else leaves(nodes[x - 40][0]) + leaves(nodes[x - 40][1])

    assert [sorted(t for x in one for t in leaves(x)) for one in left] == [sorted(x) for x in items]
    assert len(nodes) + sum(len(x) - 1 for x in left) < 0.8 * sum(len(x) - 1 for x in items)  # additions
    assert left[-1] == left[-4] and len(left[-1]) == 1
    wide = [[*range(k, k + 300)] for k in (0, 0, 100)]
    nodes, left = lexical_dag.shared_sums(wide, 400)
    assert [sorted(t for x in one for t in (lambda f: f(f, x))(lambda f, x: [x] if x < 400 else f(f, nodes[x - 400][0]) + f(f, nodes[x - 400][1]))) for one in left] == wide


@pytest.mark.parametrize(("shard", "cells"), [(200_000, 1 << 22), (60, 2000)])
def test_search_equals_plain_scoring(spark, shard, cells, monkeypatch):
    monkeypatch.setattr(lexical_dag, "CELLS", cells)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "日本", "x1", "X1", "🙂"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)] + [(200 + i, "same words here w1") for i in range(25)] + [(300, None)]
    items = [(i, text(rng.randrange(1, 20))) for i in range(30)] + [(50, "same words"), (51, "nowhere"), (52, None), (53, "!?")]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in lexical_dag.search(*frames, shard_terms=shard).collect()}
    assert got == plain(docs, items)
    assert {r[2] for r in got if r[0] == 50} == set(range(200, 210))


def test_search_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical_dag, "PIECE", 4000)
    items = spark.createDataFrame([(1, "lazy DOG", "x"), (1, "lazy DOG", "x"), (2, None, "y"), (None, "dog", "z"), (3, "", None), (4, LONG, None), (5, "é 🙂🙂", None)], ITEMS)
    docs = odd_documents(spark)
    rows = {r[0]: r[1] for r in docs.collect() if r[0] is not None}
    assert {tuple(r) for r in lexical_dag.search(docs, items).collect()} == plain(rows.items(), [(1, "lazy DOG"), (4, LONG), (5, "é 🙂🙂")])
    assert lexical_dag.search(empty_documents(spark), items).count() == 0
    assert lexical_dag.search(docs, items.where("false")).count() == 0
    named = spark.createDataFrame([("b", "dog"), ("a", "dog"), ("c", "cat")], "doc_id string, text string")
    assert [r.doc_id for r in lexical_dag.search(named, spark.createDataFrame([("q", "dog")], "item_id string, text string")).orderBy("rank").collect()] == ["a", "b"]


def test_pieces_end_between_terms():
    data = np.frombuffer(("ab " * 900_000).encode(), np.uint8)
    assert sum(len(lexical_dag._terms(p, np.array([0, len(p)]))[1]) for p in lexical_dag._cut(data)) == 900_000
