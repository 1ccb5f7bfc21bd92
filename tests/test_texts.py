import pytest
from pyspark.sql import functions as F

from corvane.operators import chunk, clean
from corvane.operators import profile_text as P


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first()["x"]


def test_garbled_ratio(spark):
    assert one(spark, "", P.garbled_ratio("t")) == 1.0
    assert one(spark, None, P.garbled_ratio("t")) == 1.0
    assert one(spark, "ab\n\t", P.garbled_ratio("t")) == 0.0
    assert one(spark, "a�\r ", P.garbled_ratio("t")) == 0.75


def test_language_needs_three_markers_and_breaks_ties_in_order(spark):
    assert one(spark, "The cat is on the mat", P.language("t")) == "en"
    assert one(spark, "le la x", P.language("t")) == "unknown"
    assert one(spark, "le la les the a an", P.language("t")) == "fr"
    assert one(spark, "في من على", P.language("t")) == "ar"
    assert one(spark, None, P.language("t")) == "unknown"


def test_sentences_and_suitability(spark):
    assert one(spark, " One two three.  Four!  ok. Five six? ", P.sentences("t")) == ["One two three.", "Five six?"]
    rows = [(1, "short"), (2, "A b c d e f g h. " * 6), (3, None)]
    p = {r["doc_id"]: r for r in P.text_profile(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert p[1]["suitability"] == 0.0 and p[1]["suitability_warnings"] == ["text_too_short"]
    assert p[2]["sentence_count"] == 6 and p[2]["avg_sentence_length"] == 8.0
    assert p[2]["suitability"] == 0.7  # 8 different words among 48
    assert p[3]["suspected_noise"] == ["empty_text"] and "empty_extraction" in p[3]["risk_flags"]


def test_boilerplate_counts_repeated_lines(spark):
    docs = spark.createDataFrame([(1, "a\n a \nb\n\n"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["line_count"], r["boilerplate_ratio"]) for r in P.boilerplate_ratio(docs, "doc_id").collect()}
    assert got == {1: (3, 2 / 3), 2: (0, 0.0)}


def test_structure_hints(spark):
    text = "INTRODUCTION\n1.2 Scope of it\nWhat follows:\nTable of Contents"
    assert one(spark, text, P.structure_hints("t")) == ["contains_heading_like_structure", "possible_table_of_contents"]
    assert one(spark, "plain", P.structure_hints("t")) == ["unstructured_or_light_structure"]


def test_normalise_uses_compatibility_forms(spark):
    assert one(spark, " ﬁne \r\n ①  x ", P.normalise("t")) == "fine 1 x"


def test_artefacts_and_pre_clean(spark):
    dirty = "! [x](_p.png)\n[](_p_1.jpeg)\n<span id=\"a\">z</span>[Docker](#page-5)<sup>2</sup>\n\n\n\nend"
    assert one(spark, dirty, clean.strip_artefacts("t")) == "Docker\n\nend"
    assert one(spark, "﻿a\x0cb\x00\r\nco-\nop", clean.pre_clean("t")) == "ab\ncoop"


def test_noise_lines_and_squeeze(spark):
    assert one(spark, "- 12 -\nPage 3 of 9\n***\n\nkeep  me\t now \n12345678", clean.drop_noise_lines("t")) == "\nkeep  me\t now \n12345678"
    assert one(spark, "a  b\t c \n\n\n\nd", clean.squeeze("t")) == "a b c\n\nd"


def test_repeated_lines_go_only_in_long_documents(spark):
    lines = [f"line number {i}" for i in range(8)]
    long = "\n".join([*lines, "footer", "footer", " footer "])
    docs = spark.createDataFrame([(1, long), (2, "footer\nfooter\nfooter")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in clean.drop_repeated_lines(docs, "doc_id", "text").collect()}
    assert got == {1: "\n".join(lines), 2: "footer\nfooter\nfooter"}


def test_sanitise_answer(spark):
    assert one(spark, "According to the text, it works", clean.sanitise_answer("t")) == "It works"
    assert one(spark, "Selon le document, élan", clean.sanitise_answer("t")) == "Élan"
    assert one(spark, "", clean.sanitise_answer("t")) == ""


def test_packing_counts_spaces_as_stated(spark):
    lengths = F.array(*[F.lit(x) for x in (4, 4, 4, 4)])
    # 4+1, +4+1 = 10, then 10+4 > 12: opens with 4; 4+4 = 8 <= 12 and 9+... stays
    assert spark.range(1).select(chunk.pack(lengths, 12).alias("s")).first()["s"] == [0, 2]
    assert spark.range(1).select(chunk.pack(F.array().cast("array<int>"), 12).alias("s")).first()["s"] == []


def test_chunks_and_context(spark):
    text = "Aaaa bbbb. Cccc dddd. Eeee ffff."
    got = chunk.sentence_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), size=19, context=4).orderBy("chunk_id").collect()
    assert [r["text"] for r in got] == ["Aaaa bbbb.", "Cccc dddd.", "Eeee ffff."]
    assert [(r["prev_context"], r["next_context"]) for r in got] == [("", "Cccc"), ("bbb.", "Eeee"), ("ddd.", "")]


def test_fixed_chunks_always_advance(spark):
    text = " ".join(f"{c * 30}." for c in "abcdef")
    got = chunk.fixed_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=40, overlap=200).orderBy("chunk_id").collect()
    assert [(r["start"], r["end"]) for r in got] == [(i, i + 1) for i in range(6)]
    two = chunk.fixed_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=70, overlap=31).orderBy("chunk_id").collect()
    assert [(r["start"], r["end"], r["overlap_size"]) for r in two][:3] == [(0, 2, 0), (1, 3, 32), (2, 4, 32)]


def test_row_windows(spark):
    for n, want in ((0, []), (50, [(0, 50)]), (51, [(0, 50), (40, 51)]), (1001, [(0, 200), (160, 380), (340, 560), (520, 740), (700, 920), (880, 1001)])):
        plan = spark.range(1).select(chunk.row_chunk_plan(F.lit(n).cast("bigint")).alias("p")).first()["p"]
        assert [(p["start"], p["end"]) for p in plan] == want
        rows = chunk.row_chunks(spark.range(n).withColumnRenamed("id", "i"), "i").groupBy("chunk_id").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi")).orderBy("chunk_id").collect()
        assert [(r["lo"], r["hi"]) for r in rows] == want


def test_boilerplate_rules(spark):
    rule = lambda t: one(spark, t, chunk.boilerplate_rule("t"))
    prose = "this is a sentence of quite ordinary words that runs on for a while without any heading at all in it"
    assert rule("") == "empty" and rule(prose) is None
    assert rule("\n".join(f"part .... {i}" for i in range(4))) == "contents"
    assert rule("\n".join(f"{i}. Author" for i in range(3))) == "references"
    assert rule(prose + " all rights reserved, no representations") == "legal"
    assert rule("a b\nc d\ne f") == "cover"


def test_semantic_chunks_follow_boundaries(spark):
    split = spark.createDataFrame([(1, ["x" * 150, "y" * 150, "z" * 150], [1, 2])], "doc_id long, s array<string>, breaks array<int>")
    got = chunk.boundary_chunks(split, "doc_id", size=600).orderBy("chunk_id").collect()
    assert [len(r["text"]) for r in got] == [301, 150]  # the first break comes under 200 characters


def test_rows_are_numbered_over_range_partitions(spark):
    rows = [((i * 37) % 500, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = chunk.numbered(df, F.desc("k"))
    assert sorted((499 - r["k"], r["i"]) for r in got.collect()) == [(i, i) for i in range(500)] and got.columns == ["k", "v", "i"]
    assert chunk.numbered(df.limit(0), "k").collect() == []


def test_repeated_lines_within_a_row(spark):
    texts = ["a\nb\na\n\n b \nc", "", None, "one", "\n".join(["long line"] * 3 + [f"line {i}" for i in range(9)]), "\n".join(["long line"] * 2 + [f"line {i}" for i in range(9)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["line_count"], round(r["boilerplate_ratio"], 6)) for r in P.boilerplate_ratio(df, "doc_id").collect()}
    assert got == {0: (5, 0.8), 1: (0, 0.0), 2: (0, 0.0), 3: (1, 0.0), 4: (12, 0.25), 5: (11, 0.181818)}
    kept = {r["doc_id"]: r["text"] for r in clean.drop_repeated_lines(df, "doc_id", "text").collect()}
    assert kept[4] == "\n".join(f"line {i}" for i in range(9)) and all(kept[i] == texts[i] for i in (0, 1, 2, 3, 5))


def test_intermediate_tables_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from corvane.operators import dedup

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="share"):
        dedup.written(SimpleNamespace(sparkSession=cluster), "x")


def test_numbers_are_printed_as_printf_does(spark):
    import random

    rng = random.Random(5)
    xs = [i / 200 for i in range(1, 400, 2)] + [i / 40 for i in range(200)] + [0.145, 0.155, 0.025, 62.5, 63.5, 0.125, 2.675, 0.0] + [rng.random() * 100 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    got = df.select("x", *[P.printed(F.col("x"), d).alias(f"p{d}") for d in (0, 1, 2)]).collect()
    assert [(r["p0"], r["p1"], r["p2"]) for r in got] == [(f"{r['x']:.0f}", f"{r['x']:.1f}", f"{r['x']:.2f}") for r in got]
