"""The byte-level BPE operator against the library, and on odd rows."""

import hashlib
import random
import struct

import numpy as np
import pytest
from tests.llm.test_llm import LONG, empty_documents, odd_documents

from tidemark.llm import bpe_transducer
from tidemark.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.fixture(scope="module")
def model():
    return bpe_transducer.read_model(PATH)


def ids_of(codec, texts):
    raw = [x.encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, bounds = codec.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


def test_ids_equal_the_library(model, library, monkeypatch):
    merger = bpe_transducer.Merger(model)
    codec = bpe_transducer.Codec(model, bpe_transducer.Transducer.compiled([b" the", b"the", b" then", b" other", b" bother", b"!", b"a", b"'s"], merger), cache=500)
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'ve", "'t", "s", "l", "re", "a", "B", "é", "1", "٣", "!", "…", " ", " ", "　", "日本", "🙂", "<|endoftext|>", "<|endof", "’s", " the", " other", "\r\n", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(20_000)]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}x" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(1, 200))) for _ in range(1000)] + ["a" * n for n in range(1, 200)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(codec, texts) == want
    monkeypatch.setattr(bpe_transducer, "HEAPED", 20)
    codec._reset()
    assert ids_of(codec, texts[-1400:]) == want[-1400:]


def test_automaton_is_least_and_holds_its_words(model):
    rng = random.Random(6)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(2000)} | {b"x" * 64, b"\xff\x00"})
    steps, final = bpe_transducer.minimal(words)
    reachable, todo = {0}, [0]
    while todo:
        for t in steps[todo.pop()].values():
            if t not in reachable:
                reachable.add(t)
                todo.append(t)
    kinds = {s: final[s] for s in reachable}
    while True:  # refined until equal states alone are together
        new = {s: (kinds[s], tuple(sorted((c, kinds[t]) for c, t in steps[s].items()))) for s in reachable}
        number = {k: i for i, k in enumerate(dict.fromkeys(new.values()))}
        new = {s: number[k] for s, k in new.items()}
        if len(set(new.values())) == len(set(kinds.values())):
            break
        kinds = new
    assert len(set(kinds.values())) == len(reachable)
    told = bpe_transducer.Transducer(bpe_transducer.Transducer.compiled(words, bpe_transducer.Merger(model)))
    probes = words + [w + b"q" for w in words[:50]] + [w[:-1] for w in words] + [b"z", b"x" * 65]
    data = np.frombuffer(b"".join(probes), np.uint8)
    size = np.array([len(w) for w in probes], np.int64)
    place = {w: i for i, w in enumerate(words)}
    assert told.places(data, np.cumsum(size) - size, size).tolist() == [place.get(w, -1) if w else -1 for w in probes]


def test_round_trip_equals_the_library_on_odd_rows(spark, library, monkeypatch):
    for docs in (odd_documents(spark), spark.createDataFrame([(1, LONG * 90 + "it's <|endoftext|> " + "日本語" * 9), (2, " \n" * 9), (3, "x<|endoftext|>'s")], "doc_id long, text string")):
        got = {r.doc_id: r for r in bpe_transducer.round_trip(docs, PATH, share=1e-3).collect()}
        texts = {r[0]: r[1] or "" for r in docs.collect() if r[0] is not None}
        assert got.keys() == texts.keys()
        for i, text in texts.items():
            ids = library.encode(text, add_special_tokens=False).ids
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
            assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        back = {r.doc_id: r.text for r in bpe_transducer.decode(bpe_transducer.encode(docs, PATH), PATH).collect()}
        assert back == texts
    assert bpe_transducer.round_trip(empty_documents(spark), PATH).count() == 0
    broken = spark.createDataFrame([(1, [20543, 95]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe_transducer.decode(broken, PATH).collect()} == {1: library.decode([20543, 95], skip_special_tokens=False), 2: "", 3: ""}


def test_documents_equal_the_library(spark, library):
    from tidemark.llm import queries

    got = {r.doc_id: r for r in queries.op12_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(e.ids), hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
