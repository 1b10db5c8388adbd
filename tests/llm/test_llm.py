"""The numbered operators against brute force, round trips, held-out accuracy, and odd rows."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from tidemark.llm import _common, decontam, html_paths, kn_quality, lang_parse, ngram_jaccard, pq_neardup, queries, rindex_dedup, sentencepiece_bpe, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string"
LONG = "The quick brown fox jumps over the lazy dog and then runs back to where it came from. " * 400


def odd_documents(spark):
    """Nulls, empty and very long texts, repeats of a row and of an id, a null id, and a column that clashes by case."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "   \n\t", "en", "s", 5, "x"), (4, base, "en", "s", 1, "x"), (5, base.upper(), "en", "s", 1, "x"),
        (6, LONG, "en", None, 1, None), (7, LONG + "tail", "en", "s", 1, "x"), (8, "two words", "fr", "s", 1, "x"), (9, "🙂🙂 é ▁ \u0000", "fr", "s", 1, "x"), (4, base, "en", "s", 1, "x"), (None, "no id", "en", "s", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def brute_repeats(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[doc] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_jaccard_on_odd_rows(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(odd_documents(spark)).collect()}
    assert set(got) == set(range(1, 10))
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[8][0] == 1
    assert got[5] == (9, 4) and got[7][1] == 6
    assert ngram_jaccard.ngram_jaccard_join(empty_documents(spark)).count() == 0


def test_overlap_bound_never_falls_short():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 70), (64, 65), (200, 230), (1000, 1100)):
        pool = rng.integers(0, 1 << 63, 2 * max(n, m), dtype=np.uint64)
        p, q = (np.unique(rng.choice(pool, k, replace=False)) for k in (n, m))
        told = ngram_jaccard.overlap_bound(ngram_jaccard.bitmap(p), len(p), ngram_jaccard.bitmap(q), len(q))
        assert len(np.intersect1d(p, q)) <= told <= min(len(p), len(q))


@pytest.mark.parametrize("short_list,block", [(48, 16), (1, 16), (48, 2), (1, 2), (2, 512)])
def test_jaccard_paths_agree_with_brute_force(spark, short_list, block):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = base[:]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(57)} for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_jaccard.ngram_jaccard_join(docs, short_list=short_list, block=block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {i: (len(s), top(i)) for i, s in sets.items()}


def test_warc_round_trip_and_odd_rows(spark):
    rows = [(1, "u", "same"), (5, None, "same"), (3, "u v\nw", None), (4, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 9000), (6, "z", "other"), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert set(got) == {1, 3, 4, 5, 6}
    assert (got[1].record_type, got[1].refers_to, got[5].record_type) == ("revisit", 5, "response") and got[3].refers_to == 4 and got[4].payload_bytes == 0
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode() and got[1].payload_bytes == 4
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"])))


def test_run_length_index_against_sorting():
    rng = random.Random(5)
    for _ in range(150):
        text = b"".join(rng.choice([b"ab", b"aba" * 4, bytes([rng.choice(b"abc")]) * rng.randint(1, 9)]) for _ in range(rng.randint(1, 14)))
        n, raw = len(text), np.frombuffer(text, np.uint8)
        order = sorted(range(n), key=lambda i: text[i:])
        assert rindex_dedup.RunLengthIndex._suffixes(raw).tolist() == order
        index = rindex_dedup.RunLengthIndex(raw)
        source, agree = index.matching_statistics()
        for place, i in enumerate(order):
            before = order[place - 1] if place else -1
            common = 0
            while before >= 0 and max(i, before) + common < n and text[i + common] == text[before + common]:
                common += 1
            assert (source[i], agree[i]) == (before, common)
        seen, marked = set(), rindex_dedup.RunLengthIndex(raw, 5).repeats(5)
        for i in range(n - 4):
            assert marked[i] == (text[i : i + 5] in seen)
            seen.add(text[i : i + 5])


@pytest.mark.parametrize("kinds", [240, 1])
def test_suffix_dedup_against_brute_force(spark, kinds):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:5] for r in rindex_dedup.suffix_dedup(docs, frequent_kinds=kinds).collect()}
    assert got == brute_repeats(rows, 100)


def test_suffix_dedup_on_odd_rows(spark):
    odd = odd_documents(spark)
    rows = {r.doc_id: r[1] for r in odd.collect() if r.doc_id is not None}
    got = {r[0]: tuple(r)[1:5] for r in rindex_dedup.suffix_dedup(odd).collect()}
    assert got == brute_repeats(list(rows.items()), 100) and rindex_dedup.suffix_dedup(empty_documents(spark)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    text = b"Some words of\tmany letters; " * 40 + b"x" * 300 + b" and more  \n of them" * 30
    data = np.frombuffer(text, np.uint8)
    whole = _common.word_hashes(data, np.array([0, len(data)]))
    monkeypatch.setattr(_common, "_PIECE", 50)
    pieces = _common.word_hashes(data, np.array([0, len(data)]))
    assert all((x == y).all() for x, y in zip(whole, pieces, strict=True)) and len(whole[0]) == len(text.split())
    windows = [(k, bytes(d[i : i + 9])) for _, k, d, _ in _common.window_slices(pa.array([text.decode()]), 9, 64) for i in range(len(d) - 8)]
    assert [w for _, w in windows] == [text[i : i + 9] for i in range(len(text) - 8)]


def test_unlike_words_have_unlike_hashes():
    """Polynomials modulo a power of two can't tell Thue-Morse words from their complements."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other} a b ab ba {word[:8]} {other[:8]} {word[:9]} {word[:64]} {other[:64]}".encode(), np.uint8)
    hashes = _common.word_hashes(data, np.array([0, len(data)]))[0]
    assert len(set(hashes.tolist())) == len(hashes) == 11


def test_codec_equals_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path()
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Codec(sentencepiece_bpe.read_model(path))
    rng = random.Random(6)
    texts = [None, "", " ", "  ", "▁", "a\x00b", "<s></s>", "日本 🙂", "ab" * 700 + " " * 50, "in" * 2000 + "g" * 999, "".join(rng.choice("abehtrsin") for _ in range(5000)), *("".join(rng.choice("ab ther\n▁é日🙂<0x") for _ in range(rng.randrange(70))) for _ in range(800))]
    ids, offsets = codec.encode(texts)
    decoded = codec.decode(ids, offsets)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want and decoded[i].decode() == library.decode(want)
    odd = odd_documents(spark)
    encoded = sentencepiece_bpe.encode(odd, path)
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decode(encoded, path).collect()}
    assert back[1] == "" and back[8] == "two words" and len(back) == 9
    assert sentencepiece_bpe.round_trip(empty_documents(spark), path).count() == 0


def test_decontamination_finds_planted_items(spark):
    item = "Which river runs through the old town of the northern province? The river is called the Silver Eel by all who live there."
    near = item.replace("Which", "What")  # one of twenty shingles
    rows = [(1, "Some words first. " * 50 + item + " more text" * 90), (2, "Some words first. " * 60), (3, near), (4, None), (5, ""), (6, item.split("?")[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "The quick one is gone and will not come back at all today")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: (True, [10]), 2: (False, []), 3: (True, [10]), 4: (False, []), 5: (False, []), 6: (False, [])}
    shards = decontam.decontaminate(docs, items, shard_items=1)
    assert {r.doc_id: (r.contaminated, r.item_ids) for r in shards.collect()} == got
    assert decontam.decontaminate(odd_documents(spark), items.limit(0)).where("contaminated").count() == 0


def test_decontamination_finds_items_of_any_length(spark):
    around = "Some words stand before. " * 40
    items = {n: " ".join(f"item{n}word{k}" for k in range(n)) for n in (*range(1, 13), 15, 20, 28)}
    rows = [(n, f"{around}{t}, {around}") for n, t in items.items()] + [(100 + n, f"{around}{' '.join(t.split()[: n // 2])} {around}") for n, t in items.items()]
    rows += [(200 + n, around + t.replace(f"item{n}word{n // 2 - 2} ", "changed ") + " " + around) for n, t in items.items() if n >= 15]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontam.decontaminate(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == {i: [] if 100 < i < 200 else [i % 100] for i, _ in rows}


def test_item_search_equals_full_scoring():
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice(["the", "of", "and", *(f"t{k}" for k in range(80))]) for _ in range(rng.randint(6, 25)))) for i in range(60)]
    index = decontam.ItemIndex(items, 0.5)
    words = np.concatenate([decontam.words_of(t) for _, t in items[::3]])
    start = np.arange(0, len(words), 11)
    size = np.minimum(40, len(words) - start)
    got = {(p, i): s for p, i, s in index.search(words, start, size)}
    for p in range(len(start)):
        own = set(words[start[p] : start[p] + size[p]].tolist())
        for i in range(len(items)):
            score = sum(float(index.impact[k]) for t, term in enumerate(index.terms.tolist()) if term in own for k in range(index.start[t], index.start[t + 1]) if index.item[k] == i)
            assert ((p, i) in got) == (score >= 0.5 - 1e-9)


def test_html_extraction(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies, please agree to them.</div><article><h1>A title</h1><p><b>First &amp; best paragraph, with some words in it.<br>And a second line.<p>Another paragraph, of
    several   words; it goes on.</p><aside>Related things</aside><div class="comments"><p>A reader's comment, quite long, which is not wanted here.</p></div></article>
    <form><p>Sign up now for more, it is free of charge.</p></form><script>var x = "<p>no</p>";</script><footer>&copy; 2024</footer></body></html>"""
    want = "A title\n\nFirst & best paragraph, with some words in it. And a second line.\n\nAnother paragraph, of several words; it goes on."
    assert html_paths.extract(page) == want
    assert html_paths.extract(None) == html_paths.extract("") == html_paths.extract("<div></div>") == ""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<p>" * 3000), (None, "u", page)], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in html_paths.extract_pages(pages).collect()} == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


def test_html_extraction_keeps_all_parts_of_an_article():
    long, short = "A long paragraph, with many words in it; and it goes on. " * 20, "A short one, at the end."
    item = "An item of a list, which is rather long; as items go, it is. "
    for inside, want in (
        (f"<section><p>{long}</p></section><section><p>{short}</p></section>", [long, short]),
        (f"<h1>Headline</h1><div class=content><p>{long}</p><p>{short}</p></div>", ["Headline", long, short]),
        (f"<p>{short}</p><ul>{f'<li>{item}</li>' * 30}</ul><p>{short}</p>", [short, *[item] * 30, short]),
        (f"<h2>Headline</h2><p>{short}</p><blockquote><p>{long}</p></blockquote><p>{short}</p>", ["Headline", short, long, short]),
    ):
        for around in ("<article>{}</article>", "<main><div>{}</div></main>", "<div><div>{}</div></div>", "{}"):
            page = f"<html><body><nav><a href=/>Menu</a></nav>{around.format(inside)}<footer>Legal notes</footer></body></html>"
            assert html_paths.extract(page) == "\n\n".join(w.strip() for w in want)
    two = f"<body><main><article><p>{long}</p></article><article><h2>Second</h2><p>{short}</p></article></main></body>"
    assert html_paths.extract(two) == "\n\n".join((long.strip(), "Second", short))


def test_html_titles_stay_and_plain_clutter_goes():
    one, two = "A first paragraph, with several words in it; and then it goes on for a while. " * 3, "A second one, which is about as long, and has a few more commas, too. " * 3
    page = f'<article><div class="entry-header"><h1>The real title</h1></div><div class="share-buttons">Share it</div><p>{one}</p><p>{two}</p><article class="comment"><p>{one}</p></article></article>'
    assert html_paths.extract(page) == "\n\n".join(("The real title", one.strip(), two.strip()))
    page = f"<body><div>Welcome to our site</div><div><h1>Title</h1><p>{one}</p><p>{two}</p></div><ul><li>Home</li><li>About us</li></ul><div>© 2024 Some House</div></body>"
    assert html_paths.extract(page) == "\n\n".join(("Title", one.strip(), two.strip()))
    page = f"<form id=all><div class='topbar'>x</div><div><p>{one}<math><mi>x</mi>=2</math></p><x-note>and {two}</x-note></div></form>"
    assert html_paths.extract(page) == f"{one.strip()} x=2\n\nand {two}".strip()


def test_html_articles_lose_no_text():
    prose = [f"Paragraph {k} tells of things, at some length; and of others, too, as it goes on for a while." for k in range(4)]
    body = "".join(f"<p>{x}</p>" for x in prose)
    whole = "\n\n".join(prose)
    for inside, want in (
        (f"<h1><a href=/x>Title</a></h1>{body}", f"Title\n\n{whole}"), (f"{body}<h2><a id=s1 href=#s1>Section</a></h2><p>{prose[0]}</p>", f"{whole}\n\nSection\n\n{prose[0]}"),
        (f"{body}<ul><li><a href=/1>Source one</a></li><li><a href=/2>Source two</a></li></ul>", f"{whole}\n\nSource one\n\nSource two"),
        (f"<section class='market-share'>{body}</section><p>{prose[0]}</p>", f"{whole}\n\n{prose[0]}"), (f"{body}<p class='social-history'>Of history.</p>", f"{whole}\n\nOf history."),
        (f"{body}<p>All <span class='related'>related</span> words.</p>", f"{whole}\n\nAll related words."), (f"{body}<noscript><p>Shown without scripts.</p></noscript>", f"{whole}\n\nShown without scripts."),
        (f"{body}<div class='share-buttons'>Share it</div><div id='social-links'><p>Follow us, please.</p></div><div class='related-posts'><p>Others.</p></div><ol class='comment-list'><li>Mine, too.</li></ol><p>{prose[1]}</p>", f"{whole}\n\n{prose[1]}"),
    ):
        assert html_paths.extract(f"<body><nav><a href=/>Menu</a></nav><article>{inside}</article><noscript>Please enable scripts.</noscript><footer>© 2024</footer></body>") == want
    law = "Copyright law has changed, and quite a lot; many have told of it, at some length."
    page = f"<body><div class=top>Welcome</div><div><h1>Title</h1><div class=byline>By A. Writer</div><p>{prose[0]}</p><p>{law}</p><p>{prose[1]}</p><div>The end.</div></div><div>© 2024 Some House</div></body>"
    assert html_paths.extract(page) == "\n\n".join(("Title", "By A. Writer", prose[0], law, prose[1], "The end."))
    assert html_paths.extract(f"<body><p>{prose[0]}</p><p>{prose[1]}</p><p>Copyright 2024 by us</p></body>") == "\n\n".join(prose[:2])


def test_html_time_is_linear():
    import time

    for page in ("<div>word, text." * 100_000, "<a \"x " * 100_000, "<a b='x " * 100_000, "<li><b><p>" * 60_000, "<div>" * 60_000 + "</p></b></section>" * 60_000, "<!-- " * 100_000, "<script>" * 50_000, "<p>x<table><tr><td>" * 20_000):
        at = time.process_time()
        html_paths.extract(page)
        assert time.process_time() - at < 8, page[:30]
    deep = html_paths.extract("<div>" * 2000 + "<p>Some words, at the bottom.</p>" + "</div>" * 2000 + "<p>After it, some more.</p>")
    assert "at the bottom" in deep and "After it" in deep


def test_html_extraction_against_plain_splitting(spark):
    """The given pages hold a flat article: split at its block tags by another way."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_paths.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id] == (r.url, want, len(want))
    odd = pages.limit(3).unionByName(pages.limit(3)).selectExpr("*", "1 as HTML", "2 as Page_Id")
    assert html_paths.extract_pages(odd).count() == 3 and html_paths.extract_pages(pages.limit(0)).count() == 0


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    vectors = [*(centres[i % 12] + rng.normal(scale=0.14, size=16) for i in range(160)), centres[0], centres[0] * 3]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (904, [], 1), (905, [1.0, None], 1), (0, [float(x) for x in vectors[0]], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in pq_neardup.embedding_links(table, per_list=8, block=16).collect()}
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    near = (unit @ unit.T >= 0.93) & (np.arange(len(unit))[:, None] % 2 == np.arange(len(unit)) % 2)
    np.fill_diagonal(near, False)
    assert len(got) == len(vectors) + 6 and [got[i].n_links for i in range(len(unit))] == near.sum(1).tolist()
    reach = np.linalg.matrix_power(near.astype(float) + np.eye(len(unit)), 64) > 0
    assert [got[i].component_id for i in range(len(unit))] == reach.argmax(1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))
    assert pq_neardup.embedding_links(table.limit(0)).count() == 0


def test_embedding_recall_in_many_dimensions(spark):
    """Against brute force where the probes are not exact; labels may be words."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(900, 64))
    near = base[:600] + rng.normal(scale=0.36, size=(600, 64))
    unit = np.concatenate([base, near])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist(), "xy"[i % 2 if i < 900 else (i - 900) % 2]) for i, v in enumerate(unit)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r.n_links for r in pq_neardup.embedding_links(table).collect()}
    kind = np.array([i % 2 if i < 900 else (i - 900) % 2 for i in range(1500)])
    linked = (unit @ unit.T >= 0.93) & (kind[:, None] == kind)
    np.fill_diagonal(linked, False)
    assert linked.sum() > 500 and sum(got.values()) >= 0.99 * linked.sum() and all(got[i] <= linked[i].sum() for i in range(1500))


def test_language_id(spark):
    rng = random.Random(9)
    learned = [[0, 1, 0, 1, 1, 0, 2], [2, 2, 1], [0, 1, 2, 0, 1, 2, 4, 4]]
    joined = lang_parse.Joined([lang_parse.SuffixAutomaton(x, n) for x, n in zip(learned, (4, 3, 5), strict=True)], [np.array([0, 1, 2, 3], np.int16), np.array([0, 1, 2, 0], np.int16), np.array([0, 1, 2, 4], np.int16)])
    texts = [[rng.randrange(4) for _ in range(rng.randint(1, 20))] for _ in range(100)]
    size = np.array([len(t) for t in texts])
    counts = joined.phrases(np.array([c for t in texts for c in t]), np.cumsum(size) - size, size)
    for text, told in zip(texts, counts.tolist(), strict=True):
        for n, symbols, table in zip(told, learned, ([0, 1, 2, 3], [0, 1, 2, 0], [0, 1, 2, 4]), strict=True):
            own, i = [table[c] for c in text], 0
            while i < len(own):
                k = 1
                while i + k < len(own) and any(symbols[j : j + k + 1] == own[i : i + k + 1] for j in range(len(symbols))):
                    k += 1
                n, i = n - 1, i + k
            assert n == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in lang_parse.language_id(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    model = lang_parse.train(docs.where(~lang_parse.held_out()))
    odd = {r.doc_id: (r.lang_pred, r.score) for r in lang_parse.identify(odd_documents(spark), model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and odd[6][0] == "en" and len(odd) == 9
    assert lang_parse.language_id(empty_documents(spark)).count() == 0


def test_language_id_learns_texts_of_every_length_and_script(spark):
    rng = random.Random(11)
    scripts = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "hy": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտր", "ka": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხ"}
    stock = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 9))) for _ in range(60)] for k, v in scripts.items()}
    size = {"en": 60, "ru": 60, "el": 6, "hy": 60, "ka": 3000}  # words a text: el always short, ka always long

    def told(own):
        rows = [(i, lang, " ".join(rng.choice(stock[lang]) for _ in range(size[lang]))) for i, lang in enumerate(own)]
        return spark.createDataFrame(rows, "doc_id long, lang string, text string"), {i: lang for i, lang, _ in rows}

    docs, truth = told([lang for lang in scripts for _ in range(30)])
    assert {r.doc_id: r.lang_pred for r in lang_parse.language_id(docs).collect()} == truth
    few, truth = told([lang for lang in ("en", "ru", "hy") for _ in range(30)])
    model = lang_parse.train(few, alphabet=20)
    assert {r.doc_id: r.lang_pred for r in lang_parse.identify(few, model).collect()} == truth


def test_pipeline_drops_short_foreign_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", *corpus_pipeline.COLUMNS)
    odd = ["привет как дела", "добрый", "καλημέρα σε όλους", "the house", "and the", "le jour est", "12 34"]
    short = spark.createDataFrame([(-i, t, None, "s", len(t)) for i, t in enumerate(odd, 1)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(short), None).select("doc_id").collect()}
    assert [i for i in range(1, 8) if -i in kept] == [4, 5, 6]


def test_quality_keeps_clean_text(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r.keep for r in kn_quality.quality(docs, marks).collect()}
    good = [r.doc_id for r in marks.where("quality = 1").collect()]
    bad = [r.doc_id for r in marks.where("quality = 0").collect()]
    assert sum(got[i] for i in good) >= 0.97 * len(good) and sum(not got[i] for i in bad) >= 0.7 * len(bad)
    odd = {r.doc_id: r.keep for r in kn_quality.quality(odd_documents(spark), labels(spark, [(4, 1, 0), (6, None, None), (None, 1, 1)])).collect()}
    assert len(odd) == 9 and not odd[1] and not odd[2]
    assert kn_quality.quality(empty_documents(spark), labels(spark)).count() == 0


def brute_kneser_ney(texts, order):
    """P(last symbol | those before) from counts in dictionaries."""
    tables = {order: {}}
    for t in texts:
        raw = b"\xff" * (order - 1) + t.encode()
        for i in range(len(raw) - order + 1):
            g = raw[i : i + order]
            tables[order][g] = tables[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
    cuts = {}
    for k, own in tables.items():
        n = [sum(c == j for c in own.values()) for j in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        cuts[k] = [0] + [max(0.05, min(j - (j + 1) * y * n[j + 1] / max(1, n[j]), j - 0.05)) for j in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / max(2, len(tables[1]) + 1)
        own, cut = tables[len(g)], cuts[len(g)]
        after = {h: c for h, c in own.items() if h[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        total = sum(after.values())
        less = sum(cut[min(c, 3)] for c in after.values())
        return (max(0, own.get(g, 0) - cut[min(own.get(g, 0), 3)]) + less * p(g[1:])) / total

    return p


def test_quality_model_equals_brute_force(spark):
    texts = ["abcab cab abba", "abd abd", "日本語の日本", "", "é"]
    rows = spark.createDataFrame([Row(lang="x", text=t) for t in texts])
    model, p = kn_quality.Model.of_rows(kn_quality.fit(rows, 3).toPandas(), 3), brute_kneser_ney(texts, 3)
    symbols = sorted({b for t in texts for b in t.encode()})
    for context in (b"ab", b"zz", b"\xffa", b"\xff\xff", "日本".encode()[-2:]):
        got = model.probability(np.array([int.from_bytes(context + bytes([c])) for c in symbols]))
        assert np.allclose(got, [p(context + bytes([c])) for c in symbols], atol=1e-9, rtol=0)
        assert 0.7 < got.sum() <= 1 + 1e-9


def test_quality_paths_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = kn_quality.fit(docs, 3)
    one, two = ({r.doc_id: r.perplexity for r in kn_quality.perplexities(docs, model, 3, broadcast_bytes=n, part_bytes=200_000).collect()} for n in (10**9, 0))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-5 for k in one)
    whole = kn_quality.grams([b"\xff\xff" + LONG.encode()], 3)[0]
    pieces = [kn_quality.grams(parts, 3)[0] for _, parts in kn_quality._runs(pa.array([LONG]), 3, 1000)]
    assert len(pieces) > 20 and (np.concatenate(pieces) == whole).all()


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_quality_of_short_and_far_scripts(spark, parts):
    """A language of short texts has a threshold too, far scripts a model of their own, and equal texts one answer however they are dealt."""
    docs = [(i, "日本語の文です" if i % 2 else "日本の言葉です", "ja") for i in range(80)] + [(100, "Құшаққа", "ja")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(parts)
    got = {r.doc_id: r for r in kn_quality.quality(rows, labels(spark, [(i, 1, 0) for i in range(80)])).collect()}
    assert all(got[i].keep and got[i].threshold is not None for i in range(80)) and not got[100].keep
    assert len({(got[i].perplexity, got[i].threshold) for i in range(80)}) == 2


def test_quality_keeps_by_the_quantile_of_held_out_texts(spark):
    """keep from the perplexities alone, in plain Python; documents of equal text agree."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    marks = [(r.doc_id, int(r.doc_id % 3 > 0), 0) for r in docs.select("doc_id").collect()]
    got = kn_quality.quality(docs, labels(spark, marks), quantile=0.6).collect()
    size = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    good = {i for i, q, _ in marks if q}
    model = kn_quality.fit(docs.where("doc_id % 3 > 0").where("crc32(cast(doc_id as string)) % 10 <> 0"), 6)
    told = {r.doc_id: (r.lang, r.perplexity) for r in kn_quality.perplexities(docs, model).collect()}
    ratio = {i: p / np.exp(2.0 / np.sqrt(size[i])) for i, (_, p) in told.items() if p is not None and size[i]}
    limit = {}
    for lang in {x for x, _ in told.values()}:
        held = sorted(ratio[i] for i in ratio if told[i][0] == lang and i in good and zlib.crc32(str(i).encode()) % 10 == 0)
        limit[lang] = held[max(0, -(-len(held) * 6 // 10) - 1)] if held else None
    assert {r.doc_id: r.keep for r in got} == {i: size[i] > 0 and (i not in ratio or limit[told[i][0]] is None or ratio[i] <= limit[told[i][0]] * (1 + 1e-12)) for i in told}


def test_toxicity(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, marks).collect()}
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    assert sum(got[k] for k, v in truth.items() if v) >= 0.9 * sum(truth.values()) and sum(got[k] for k, v in truth.items() if not v) <= 3
    assert toxicity.toxicity(odd_documents(spark), labels(spark, [(4, 1, None), (6, 1, 0)])).where("not toxic").count() == 9
    assert toxicity.toxicity(empty_documents(spark), labels(spark)).count() == 0


def test_toxicity_chain_against_fits_one_by_one(spark):
    """The chain's tasks give what plain loops over folds and categories give; text ids work."""
    rng = np.random.default_rng(3)
    rows = [(f"d{i}", " ".join(rng.choice(["sun", "rain", "mud", "oaf", "tea"], 6))) for i in range(120)]
    marks = [(i, int("mud" not in t), int("oaf" in t)) for i, t in rows]
    docs, told = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(marks, "doc_id string, quality int, toxic int")
    chain = toxicity.train(docs, told)
    sets = list(toxicity._word_sets(pa.array([t for _, t in rows])))
    hashes = dict(docs.selectExpr("doc_id", "xxhash64(doc_id)").collect())
    order = sorted(range(len(rows)), key=lambda i: hashes[rows[i][0]])
    own, fold = [sets[i] for i in order], np.array([hashes[rows[i][0]] % toxicity.FOLDS for i in order])
    extra, want = np.zeros((len(rows), 0)), np.zeros((len(rows), 0))
    for y in (np.array([1.0 - marks[i][1] for i in order]), np.array([float(marks[i][2]) for i in order])):
        out = np.zeros(len(rows))
        for k in range(toxicity.FOLDS):
            model = toxicity.Linear([own[i] for i in np.flatnonzero(fold != k)], extra[fold != k], y[fold != k], 2000)
            for i in np.flatnonzero(fold == k):
                out[i] = model.predict(own[i], np.zeros(len(own[i]), int), extra[i : i + 1])[0]
        full = toxicity.Linear(own, extra, y, 2000)
        want = np.column_stack([want, full.predict(*toxicity.Chain._pairs(own), want)])
        extra = np.column_stack([extra, out])
    assert chain.names == ["low_quality", "toxic"] and np.allclose(chain.predict(own), want)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, told).collect()}
    assert all(abs(got[rows[i][0]].p_low_quality - want[j, 0]) < 1e-6 for j, i in enumerate(order)) and sum(r.toxic == bool(m) for (i, _, m) in marks for r in [got[i]]) >= 115


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[1:5]]
    assert all(f.columns == docs.columns for f in frames[1:5])
    assert texts[0].items() <= start.items() and texts[1].items() <= texts[0].items()
    spans = brute_repeats(list(texts[1].items()), 100)
    assert {k: len(texts[1][k].encode()) - v[1] for k, v in spans.items()} .keys() == texts[2].keys()
    for k, v in texts[2].items():
        assert abs(len(v.encode()) - (spans[k][0] - spans[k][1])) <= 6 * (spans[k][2] + 1)
    assert texts[3].items() <= texts[2].items()
    assert {r.doc_id for r in frames[5].collect()} == texts[3].keys()
