"""Briefs, boards, links and noisy texts by examples."""

import html
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import board, briefs, captions, matcher, patterns, text


def told(frame, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in frame.collect()}


def test_outline_keeps_a_stack_of_headings():
    brief = "top\n# A\none\n## B\ntwo\n#### D\nthree\n## C\nfour\n#no heading\n####### nor this\n# E\nfive"
    assert [(p, x) for _, p, x in briefs.outline(brief)] == [
        ([], "top"), (["A"], "one"), (["A", "B"], "two"), (["A", "B", "D"], "three"), (["A", "C"], "four"), (["A", "C"], "#no heading"), (["A", "C"], "####### nor this"), (["E"], "five"),
    ]
    assert briefs.section(brief, "B") == "\ntwo\n#### D\nthree" and briefs.section(brief, "Z") == "" and briefs.section("## Rules text (x)\ny\n# Z\nq", "Rules text") == " (x)\ny"


def test_lines_under_headings(spark):
    rows = spark.createDataFrame([(1, "# A\nx\n## B\ny"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in briefs.lines_under(rows).collect()) == [(1, 1, ["A"], "x"), (1, 3, ["A", "B"], "y"), (2, 0, [], ""), (3, 0, [], "")]


def test_pointers(spark):
    long = "Keep every clip vertical and bright. " * 6
    rows = [(1, long), (2, "short"), (3, f"## Rules text\n{long}\n## Other\nsee the doc"), (4, f"## Rules text\n{long} In the resources you find more."), (5, f"## Rules text\n(none here)\n## Other\n{long}"), (6, f"## Rules text\n\n## Other\n{long}"), (7, None), (8, f"## On-modal requirements\n### Deep\n{long}\n## Rules text\n(None)")]
    got = told(briefs.rules_pointer_flag(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "pointer")
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: False}


def test_checklist_drops_no_rule(spark):
    lines = ["Tag @Home.tv and use #Go.", "Submit within 30 min of posting! Minimum 1,000 views to qualify.", "At least 10 seconds. Put the link in   bio.", "submit within 30 min of posting!"]
    brief = spark.createDataFrame([("c", 0, i, x) for i, x in enumerate(lines)] + [("d", 0, 0, "Be nice")], "campaign string, doc_id long, line_no long, text string")
    rules = [
        ("mentions", 0, "@Home.tv"), ("required", 1, "tag: @two and @Home.tv"), ("hashtags", 0, "#Go"), ("required", 2, "hashtag: #go"), ("required", 3, "account_setup: Open an  account"), ("required", 4, "restriction: No logo at the end"),
        ("required", 5, "disclosure"), ("required", 6, "quality: 1080p"), ("watermark_required", 0, "True"), ("submission_process", 1, lines[1]), ("submission_process", 2, "# heading"), ("payout_terms", 1, "$1 per 1k"), ("ambiguities", 1, "Which day?"),
    ]
    frame = spark.createDataFrame([("c", *r) for r in rules], "campaign string, field string, ord long, value string")
    got = {}
    for r in briefs.posting_checklist(brief, frame).orderBy("campaign", "place").collect():
        got.setdefault((r.campaign, r.section), []).append((r.kind, r["item"]))
    c = {k[1]: v for k, v in got.items() if k[0] == "c"}
    assert c["Caption: mentions and tags"] == [("box", "mention @Home.tv in the caption"), ("box", "mention @two in the caption")]
    assert c["Hashtags"] == [("box", "include #Go")] and c["Link in bio"] == [("box", "Put the link in bio.")]
    assert c["On-screen and watermark"] == [("note", "watermark: required"), ("verify", "possible conflict, rules also say: No logo at the end")]
    assert c["Submission"] == [("box", lines[1]), ("box", "time window: Submit within 30 min of posting!")]
    assert c["Payout requirements"] == [("box", "Minimum 1,000 views to qualify."), ("box", "At least 10 seconds."), ("note", "payout: $1 per 1k")]
    assert c["Other requirements"] == [("box", "Open an account"), ("box", "disclosure")] and c["Quality and format"] == [("box", "1080p")] and c["To verify"] == [("verify", "Which day?")]
    assert got["d", "Submission"] == [("none", "no submission step or time window found")] and got["d", "On-screen and watermark"] == [("verify", "watermark requirement unclear")]
    assert briefs.posting_checklist(brief.where("false"), frame.where("false")).count() == 0


def test_digest_tells_everything(spark):
    files = spark.createDataFrame([(1, 1, "a.MP4", 90.0, None), (1, 2, "rules.pdf", None, None), (1, 3, "x.bin", None, None), (1, 4, "safe guide.png", None, None), (1, 5, "b.pdf", None, 7)], "campaign long, ord long, path string, duration_sec double, text_len long")
    kinds = spark.createDataFrame([(e, k) for k, es in patterns.KINDS.items() for e in es.split()], "ext string, kind string")
    rules = spark.createDataFrame([(1, "mentions", 0, "@m"), (1, "hashtags", 0, "#h"), *((1, "payout_terms", k, f"line {k} " + "x" * 100) for k in range(50))], "campaign long, field string, ord long, value string")
    stats = spark.createDataFrame([(1, 1.5, 12345, 0.255, None), (2, None, None, None, None)], "campaign long, pay double, total long, rest double, most long")
    line = briefs.stats_line(F.col("pay"), F.col("total"), F.lit(None).cast("double"), F.col("rest"), F.lit(2.5), F.col("most"))
    got = told(briefs.campaign_digest(rules, files, kinds, stats.select("campaign", line.alias("stats"))), "campaign", "digest")
    assert "pay $1.50/1K; budget $0/$12,345, 26% remaining; min payout $2.50" in got[1] and "- **rules.pdf** (doc): UNREAD: no text\n    - note: could not extract text" in got[1]
    assert "- **x.bin** (other): UNUSED: no handler" in got[1] and "applied as reference" in got[1] and got[1].count("x" * 100) == 50 and "- #h\n- @m" in got[1]
    assert got[2].count("_(none)_") == 1 + len(briefs.DIGEST) and "stats: min payout $2.50" in got[2]


def test_boards_in_both_layouts(spark):
    one = {"id": 1, "name": "a", "composite": 0.5, "status": "new", "category": "c", "lane": "l"}
    docs = [(json.dumps({"campaigns": [one, {"id": 2}]}),), (json.dumps([{**one, "id": 3, "composite": "0.25", "extra": [1]}]),)]
    frame = spark.createDataFrame(docs, "doc string")
    assert told(board.scan_board(frame), "id", "name", "composite") == {1: ("a", 0.5), 3: ("a", 0.25)}
    for bad in ("[]", '{"campaigns": []}', "{}", '{"campaigns": 5}', "not json"):
        with pytest.raises(Exception, match="no campaigns|MALFORMED|JSON"):
            board.scan_board(spark.createDataFrame([(bad,)], "doc string")).collect()


def test_character_references_decode_once(spark):
    rng = random.Random(8)
    refs = ["&amp;lt;", "&lt;", "&notit;", "&not", "&#38;lt;", "&#x41;", "&#65", "&#0;", "&#128;", "&nbsp;", "&hellip", "&unknown;", "&", "&;", "&#;", "&AMP", "&CounterClockwiseContourIntegral;", "&#xD800;", "&#1114112;"]
    pages = [(i, "x" + "".join(rng.choice([*refs, " ", "\n", "a"]) for _ in range(9)) + "y") for i in range(200)] + [(900, None), (901, " \n "), (902, "<script>a<b</script><STYLE x>c</style><p>d</p>")]
    got = told(text.html_to_text(spark.createDataFrame(pages, "page_id long, html string")), "page_id", "text")
    for i, t in pages[:200]:
        plain = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", html.unescape(re.sub(r"(?s)<[^>]+>", " ", t)))).strip()
        assert got[i] == plain
    assert got[900] == "" and got[901] == "" and got[902] == "d"


def test_noisy_answers(spark):
    answers = [
        '```json\n["a", " b ", "", 3]\n```', 'x [{"id": 1, "score": 5}, {"id": "z", "score": 2.5}] y', "Here are some\n1. one two\n- \"quoted\",\n* x\n\nplain", "[broken", 'see [1] or {"a": ["x]", "y\\"]"]} and ]', None, "[]\nline left",
    ]
    frame = spark.createDataFrame(list(enumerate(answers)), "event_id long, msg string")
    strict, tolerant = ({i: [tuple(r)[2:] for r in sorted(rows, key=lambda r: r.place)] for i, rows in grouped(text.json_array_repair(frame, t).collect())} for t in (False, True))
    assert strict[0] == [(None, None, "a"), (None, None, "b"), (None, None, "3")] and strict[1] == [("1", 5, None), ("z", None, None)]
    assert [r[2] for r in strict[2]] == ["one two", 'quoted"', "plain"] and [r[2] for r in strict[3]] == ["[broken"] and [r[2] for r in strict[6]] == ["[]", "line left"] and 5 not in strict
    assert [r[2] for r in strict[4]] == [answers[4]] and [r[2] for r in tolerant[4]] == ["1"]
    assert list(text.balanced_arrays('a] [x "]" [y] z] [')) == ['[x "]" [y] z]', '[y]']


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.event_id, []).append(r)
    return out.items()


def test_error_cascade(spark):
    rows = {
        "429 rate limit per day, try again in 1h5m2.5s": ("daily", 3902.5, False, "throttle", "nothing usable"), "quota, try again in 80s": ("minute", 80.0, False, "unknown", "nothing usable"), "quota: retry-after: 95": ("daily", 95.0, False, "unknown", "nothing usable"),
        "Model x is deprecated": ("error", None, True, "unknown", "nothing usable"), "404": ("error", None, True, "unknown", "nothing usable"), "status code: 503 access denied": ("error", None, False, "throttle", "nothing usable"),
        "Permission denied": ("error", None, False, "permission", "nothing usable"), "status code 404 too many requests": ("error", None, True, "permission", "retryable throttle"), "LANGUAGE no footage": ("error", None, False, "unknown", "language gate"),
        "no moments at all": ("error", None, False, "unknown", "no moments"),
    }
    frame = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "event_id long, msg string")
    got = told(text.log_classify(frame), "event_id", "rate", "wait_s", "dead_model", "share", "reason")
    assert got == dict(enumerate(rows.values()))


def test_links(spark):
    urls = {
        "https://drive.google.com/drive/folders/x": ("drive_folder", None), "https://drive.google.com/file/d/x": ("gdoc", "gdoc"), "https://youtube.com/@me": ("channel", None), "https://youtu.be/x?list=1": ("vod", None), "https://youtube.com/": ("channel", None),
        "https://kick.com/v": ("vod", None), "https://a.com/x.MP4?y=1": ("file", None), "https://a.com/x.pdf?y": ("file", "web"), "https://a.com/rules": ("site", "web"), "https://a.com/x?q=rules": ("site", None), "notes.md": ("other", "local"), "x.mp4": ("other", None),
        "https://whop.com/discover/rules": ("site", None),
    }
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(99, "https://b.com/p", "FAQ here")], "page_id long, url string, label string")
    assert told(text.link_kind(frame), "url", "kind", "rules") == urls | {"https://b.com/p": ("site", "web")}


def test_many_terms_in_one_pass(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    terms = [(i, t, False) for i, t in enumerate(sorted({word() for _ in range(9000)} | {f"{word()} {word()}" for _ in range(1000)}))] + [(20_000, "q+z", True), (20_001, "can't", False)]
    lines = [(i, 0, rng.choice(["", "É", "x"]) + rng.choice([" ", "-", "_", "é"]).join(word() + rng.choice(["", "s", "zz"]) for _ in range(rng.randrange(4)))) for i in range(400)] + [(900, 0, None), (901, 0, "xqqz"), (902, 0, "I can't"), (903, 0, "cant")]
    frame = text.banned_gauntlet(spark.createDataFrame(lines, "clip_id long, pos long, text string"), spark.createDataFrame(terms, "ordinal int, term string, is_pattern boolean"))
    assert "NestedLoop" not in frame._jdf.queryExecution().toString()
    pieces = lambda low: {low[a:b] for a in range(len(low)) for b in range(a + 1, len(low) + 1)}
    whole = lambda low: {low[a:b] for a in range(len(low)) for b in range(a + 1, len(low) + 1) if not (a and low[a - 1] in matcher.WORD or b < len(low) and low[b] in matcher.WORD)}

    def hit(low):
        inside, alone = pieces(low), whole(low)
        return next((t for _, t, pattern in terms if (re.search(t, low) if pattern else t in inside if " " in t else t in alone)), None)

    assert told(frame, "clip_id", "reason") == {i: hit((t or "").lower()) for i, _, t in lines}
    assert sum(len(x) for x in matcher.shards(spark.createDataFrame(terms, "ordinal int, term string, is_pattern boolean"), 50_000)) == len(terms)


def test_lexicon_forms(spark):
    docs = spark.createDataFrame([(1, "Shitt shitty, ass asses assess assault. shits"), (2, None)], "doc_id long, text string")
    got = captions.lexicon_prefix_match(docs, spark.createDataFrame([("shit",), ("ass",)], "root string"), ["s", "es", "y"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "ass", 2), (1, "shit", 3)]


def test_grounding_by_words_and_stems(spark):
    lines = spark.createDataFrame([(1, 0, "The diamonds of Paris 'rolex'"), (1, 1, "the of it"), (2, 0, "cat nap"), (3, 0, None)], "clip_id long, pos long, text string")
    docs = spark.createDataFrame([(1, "a diamond rolexes pari"), (2, "cats naps"), (9, "unused")], "doc_id long, text string")
    got = {(r.clip_id, r.pos): (r.unsupported, r.specific) for r in text.grounding_anti_join(lines, docs, ["the"]).collect()}
    assert got == {(1, 0): ("", True), (1, 1): ("", False), (2, 0): ("cat,nap", False), (3, 0): ("", False)}


def test_pointer_sql_ends_rules_at_empty_headings(spark):
    import duckdb

    from tidemark.plans import catalog
    from tidemark.sources import views

    text = "a" * 90 + "##\n" + "more words " * 40
    rows = [(2, text, "web"), (6, "a" * 90 + "#\n" + "b" * 300, "web"), (3, "a\n#\t" + "c" * 300, "web"), (4, None, "web"), (5, None, None), (7, "see the doc", None), (8, "\t", "x"), (12, "##  Rules text  \nx\n##", "x"), (1, "x" * 400, "y")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(con.sql("SELECT doc_id, n_clean, pointer FROM (" + catalog.oracle_sql()["rules_pointer_flag"] + ") t").fetchall())
    spark.createDataFrame(rows, "doc_id long, text string, source string").createOrReplaceTempView("odd_documents")
    made = spark.sql(views.VIEWS["v_briefs"]["spark"].replace("FROM documents", "FROM odd_documents"))
    assert sorted(map(tuple, briefs.rules_pointer_flag(made).collect())) == want


def test_digest_leaves_out_files_of_no_campaign_before_it_gathers(spark):
    kinds = spark.createDataFrame([("mp4", "footage")], "ext string, kind string")
    files = spark.createDataFrame([(1, 1, "a.mp4", 60.0, 5), (9, 1, "b.mp4", 60.0, 5)], "campaign long, ord long, path string, duration_sec double, text_len long")
    rules = spark.createDataFrame([(1, "deadlines", 0, "soon")], "campaign long, field string, ord long, value string")
    got = briefs.campaign_digest(rules, files, kinds, spark.createDataFrame([(1, "x")], "campaign long, stats string"))
    assert "LEFTSEMI" in got._jdf.queryExecution().toString().upper()
    assert [(r.campaign, "a.mp4" in r.digest, "- soon" in r.digest) for r in got.collect()] == [(1, True, True)]


def test_sentences_are_told_by_arrow(spark, monkeypatch):
    asked = []
    plain = briefs.matcher.holds
    monkeypatch.setattr(briefs.matcher, "holds", lambda text, pattern: asked.append(pattern) or plain(text, pattern))
    lines = spark.createDataFrame([(1, 0, 0, "Submit within 5 min. Link in bio! At least 20 seconds.")], "campaign long, doc_id long, line_no long, text string")
    rules = spark.createDataFrame([(1, "ambiguities", 0, "when?")], "campaign long, field string, ord long, value string")
    items = {r.item for r in briefs.posting_checklist(lines, rules).collect()}
    assert {"time window: Submit within 5 min.", "Link in bio!", "At least 20 seconds.", "when?"} <= items
    assert {briefs.LINK_IN_BIO, briefs.POSTING, briefs.TIME_WINDOW, briefs.LEAST_VIEWS, briefs.LEAST_SECONDS} <= set(asked)
