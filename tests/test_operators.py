"""Invariants and folds against plain Python."""

import random

from pyspark.sql import functions as F

from tidemark.operators import board, captions, intervals, patterns, ranking, series, text


def test_bucketed_join_equals_nested_loops(spark):
    rng = random.Random(1)
    left = [(f"m{i}", rng.randrange(3), s := rng.uniform(-50, 200), s + rng.uniform(0, 60)) for i in range(80)]
    right = [(rng.randrange(3), s := rng.uniform(-50, 200), s + rng.uniform(0, 60)) for i in range(40)]
    a = spark.createDataFrame(left, "id string, source int, start_s double, end_s double")
    b = spark.createDataFrame(right, "source int, start_s double, end_s double")
    want = sorted(i for i, k, s, e in left if not any(k == q and s < y and x < e for q, x, y in right))
    assert sorted(r.id for r in intervals.overlap_anti_join(a, b).collect()) == want


def test_spread_topk_equals_global_greedy(spark):
    rng = random.Random(2)
    rows = [(f"m{i:03}", rng.randrange(4), float(rng.randrange(600)), float(rng.randrange(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, source int, start_s double, intensity double")
    taken = []
    for i, k, s, z in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(taken) < 15 and all(k != q or abs(s - t) >= 60 for _, q, t in taken):
            taken.append((i, k, s))
    assert sorted(r.id for r in ranking.spread_topk(df, 60, 15).collect()) == sorted(t[0] for t in taken)


def test_planted_bursts_are_found(spark):
    rows = [(1, s, 60.0 if s in (10, 25, 40) else 1.0) for s in range(60)] + [(2, s, 5.0) for s in range(9)]
    df = spark.createDataFrame(rows, "source int, sec long, rms double")
    assert sorted((r.source, r.start_s, r.end_s) for r in series.spike_runs(df).collect()) == [(1, 10.0, 11.0), (1, 25.0, 26.0), (1, 40.0, 41.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "source int, sec long, rms double")
    assert series.spike_runs(none).count() == series.silence_runs(none).count() == 0


def test_corpus_joins_only_texts_before_the_limit(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice(["", None, "x" * rng.randrange(40)])) for i in range(400)]
    rows += [(None, "a", "no id"), (7, "b", "twice"), (7, "b", "again"), (900, "c", "y" * 500), (901, "d", None)] + [(1000 + i, "hot", f"{i:04}" * 5) for i in range(3000)]
    rng.shuffle(rows)
    want = {}
    for i, k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] or "")):
        want.setdefault(k, []).extend([] if t is None else [t])
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.source: r.corpus for r in text.corpus_build(docs, 100, 4).collect()} == {k: "\n".join(v)[:100] for k, v in want.items()}
    monkeypatch.setattr(text, "joined", lambda *_: F.count("*").cast("string"))  # how many texts meet in a source's group
    assert text.corpus_build(docs, 100, 4).where("source = 'hot'").first().corpus == "5"


def test_barriers_by_priority(spark):
    pages = [(1, "Please log in, or sign up"), (2, "Sign-up is free"), (3, "Start your free trial"), (4, "DM us"), (5, "signal, cosign inside blogin"), (6, None), (7, "")]
    got = text.barrier_detect(spark.createDataFrame(pages, "page_id long, html string"), patterns.BARRIERS)
    assert {r.page_id: r.barrier for r in got.collect()} == {1: "login", 2: "signup", 3: "payment", 4: "manual", 5: None, 6: None, 7: None}


def test_line_rules_in_order(spark):
    lines = [
        "one two three four five six seven eight nine", "is it?\nyes", "here is what he said?", "you won't believe this", "a plain line", "he won the game, no way", "did he say he won", "this is crazy?", "no way", "wait for the quiet part", "étis the end",
    ]
    candidates = spark.createDataFrame([(c, i, x) for c in (1, 2) for i, x in enumerate(lines)], "clip_id long, pos long, text string")
    transcripts = spark.createDataFrame([(1, "some words were said here"), (2, "the and")], "clip_id long, text string")
    got = {(r.clip_id, r.pos): r.reason for r in captions.caption_quality_kill(candidates, transcripts, ["the", "and"]).collect()}
    want = ["too long", "several lines", "describes", "bait", "no hook", "giveaway", None, "filler", "filler", None, "no hook"]
    assert [got[1, i] for i in range(11)] == want and [got[2, i] for i in range(11)] == [None if x == "filler" else x for x in want]
    best = captions.caption_score_top2(candidates.where("clip_id = 1")).first()
    assert (best.best_pos, best.best_score) == (1, 9)


def test_rules_of_a_brief(spark):
    lines = ["Length 20 seconds, use #Clip and #ad.", "Mention @house.", "Banned: casino, free money/bets or 77 and this one is far too long", "Submit by the deadline", "#Clip again"]
    rows = spark.createDataFrame([("c", 1, i, x) for i, x in enumerate(lines)], "campaign string, doc_id long, line_no long, text string")
    floor = board.rules_floor(rows, ["spam"])
    got = {}
    for r in floor.collect():
        got.setdefault(r.field, set()).add(r.value)
    assert got["hashtags"] == {"#Clip", "#ad"} and got["mentions"] == {"@house."} and got["banned_words"] == {"spam", "casino", "free money", "bets"}
    assert got["required"] == {"hashtag: #Clip", "hashtag: #ad", "mention: @house.", "disclosure"} and got["platform_rules"] == {lines[0]} and got["deadlines"] == got["submission_process"] == {lines[3]}
    more = spark.createDataFrame([("c", "hashtags", 1, " #CLIP"), ("c", "hashtags", 2, "#new"), ("c", "style", 1, " "), ("c", "style", 2, "calm"), ("c", "style", 3, "loud")], "campaign string, field string, ord long, value string")
    merged = {(r.field, r.value) for r in board.rules_merge(floor, more, ["style"]).collect()}
    assert {v for f, v in merged if f == "hashtags"} == {"#Clip", "#ad", "#new"} and [v for f, v in merged if f == "style"] == ["calm"]


def test_titles_keep_words_apart(spark):
    rows = [(1, "80% left—what’s  it"), (2, "night-and-day / mr beast"), (3, "10v1 don't"), (4, " \n"), (5, None), (6, "é ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.title for r in text.text_normalize(docs).collect()}
    assert got == {1: "80% Left - What's It", 2: "Night-And-Day / Mr Beast", 3: "10v1 Don't", 4: "clip", 5: None, 6: "É Ok"}
    assert {r.doc_id: r.title for r in text.text_normalize(docs, ascii_only=True).collect()}[6] == "Ok"


def test_wanted_files_and_open_batches(spark):
    rows = [("c", 1, "logo guide.png"), ("c", 2, "b9.pdf"), ("c", 3, "a.png"), ("c", 4, "my.png.png"), ("d", 1, "guide.png")]
    files = spark.createDataFrame(rows, "campaign string, ord long, path string")
    pick = lambda **k: {r.campaign: r.path for r in ranking.priority_pick(files, **k).collect()}
    assert pick(reference=("guide",)) == {"c": "b9.pdf"} and pick(wanted="A.png", reference=("guide",))["c"] == "a.png"
    assert pick(wanted="logo", reference=("guide",))["c"] == "logo guide.png"
    moments = spark.createDataFrame([("s", f"m{i}", float(9 - i)) for i in range(5)], "source string, id string, intensity double")
    done = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "id string")
    assert [tuple(r) for r in ranking.score_batches(moments, 2, done).orderBy("batch").collect()] == [("s", 1, 2, 1, "m2"), ("s", 2, 1, 1, "m4")]


def test_sql_of_html_to_text_knows_all_references(spark):
    import duckdb

    from tidemark.plans import catalog

    pages = ["a &amp b &ampx &notit; &notin; &#65;&#x41 &#0; &#x80;&#128 &#xD800; &#99999999999; &#1; &#xb; & &; &&amp;&amp lt&lt&gt>x &copy2", "&fjlig;&amp;lt; <b>&hellip</b>\n\n\n\nx&apos;", "", None, "&", "&#x;&#12.5;&CounterClockwiseContourIntegral;"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(pages)))
    got = text.html_to_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.oracle_sql()["html_to_text"]).fetchall())


def test_barriers_are_told_without_the_jvms_matcher(spark):
    pages = spark.createDataFrame([(1, "Please LOG IN"), (2, None), (3, "x" * 100_000 + " checkout "), (4, "nothing")], "page_id long, html string")
    got = text.barrier_detect(pages, patterns.BARRIERS)
    assert {r.page_id: r.barrier for r in got.collect()} == {1: "login", 2: None, 3: "payment", 4: None}
    assert "RLIKE" not in got._jdf.queryExecution().toString().upper()


def plan(df):
    return df._jdf.queryExecution().toString().upper()


LINES = [(1, 0, "No way he crashed."), (1, 1, "why did he\u000bcrash"), (1, 2, "wait for it 😳"), (1, 3, "here is a footage of nine long words that say all of it"), (2, 0, "!!! 12"), (2, 1, None), (3, 0, "It's $ 5, it's fine")]


def test_line_scores_are_told_by_arrow(spark):
    lines = spark.createDataFrame(LINES, "clip_id long, pos long, text string")
    got = captions.caption_score_top2(lines)
    assert "RLIKE" not in plan(got)
    scores = {(r.clip_id, r.pos): (r.score, r.opening) for r in lines.select("clip_id", "pos", captions.line_score(F.col("text")).alias("score"), captions.opening(F.col("text")).alias("opening")).collect()}
    assert scores == {(1, 0): (2 + 4 - 5 + 2 - 1 + 1, "no way"), (1, 1): (2 + 4 + 2 + 1, "why did"), (1, 2): (2 + 4 + 2 + 1, "wait for"), (1, 3): (-6 - 8 + 1, "here is"), (2, 0): (2, ""), (2, 1): (0, None), (3, 0): (4 + 2 + 1, "it's $ 5, it's"[:4] + " it's")}


def test_top2_leaves_lines_out_before_the_shuffle(spark):
    rows = [(c, p, f"{'abc'[p * 5 % 3]} {'xy'[p % 2]} {'no way' if p * (c + 7) % 5 == 0 else 'it is'}") for p in range(30) for c in range(9)]
    got = captions.caption_score_top2(spark.createDataFrame(rows, "clip_id long, pos long, text string"))
    shuffled = plan(got).split("EXCHANGE ")[-1]  # what stands before the first shuffle
    assert "MAPINARROW" in shuffled
    scores = {0: (2 + 1), 1: (2 + 4 + 2 + 1)}
    for r in got.collect():
        ranked = sorted((-scores["no way" in t], p, t[:3]) for c, p, t in rows if c == r.clip_id)
        other = next(x for x in ranked if x[2] != ranked[0][2])
        assert (r.best_pos, r.best_score, r.variant_pos) == (ranked[0][1], -ranked[0][0], other[1])


def test_quota_and_tiers_match_without_the_jvm(spark, tmp_path):
    from tidemark.plans import catalog

    rows = [(i, "No way he crashed. Wait for the outcome of everything.\nwhy did it happen?") for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, n in (("structure_quota", 4), ("tiered_fallback", 4)):
        got = catalog.queries()[name](spark, str(tmp_path))
        assert "RLIKE" not in plan(got) and got.select("clip_id").distinct().count() == n


def test_junk_counts_hold_one_text_at_a_time(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = text.junk_text_flag(spark.createDataFrame([(1, "no no no no no yes"), (2, None), (3, "one two three four five")], "doc_id long, text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
    assert {r.doc_id: (r.n_tokens, r.top, r.junk) for r in got.collect()} == {1: (6, 5, True), 2: (0, 0, True), 3: (5, 1, False)}


def test_titles_are_made_without_the_jvms_matcher(spark):
    docs = spark.createDataFrame([(1, "ßa “ﬁne” — 3rd_x/élan"), (2, None), (3, " \n"), (4, "__a-b ...  c")], "doc_id long, text string")
    got = text.text_normalize(docs)
    assert "REGEXP" not in plan(got)
    assert {r.doc_id: r.title for r in got.collect()} == {1: 'ßa "FIne" - 3rd_x/Élan', 2: None, 3: "clip", 4: "__A-B ... C"}
