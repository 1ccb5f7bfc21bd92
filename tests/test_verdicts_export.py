import json
import math
import random

from pyspark.sql import functions as F

from corvane.operators import export as X
from corvane.operators import registry as R
from corvane.operators import retrieval, verdicts

PROFILE = "file string, file_kind string, row_count long, word_count long, n_columns int, mostly_null_columns int, near_constant_columns int, duplicate_ratio double, garbled_ratio double, boilerplate_ratio double, risk_flags array<string>"


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def verdict(spark, *rows):
    return verdicts.merge_verdict(verdicts.feasibility_findings(spark.createDataFrame(list(rows), PROFILE))).first()


def test_feasibility_thresholds(spark):
    table = lambda **k: ("f", "csv", *[k.get(n) for n in ("rows", "words", "columns", "nulls", "constant", "dup", "bad", "same", "flags")])
    assert verdict(spark, table(rows=51, columns=4, nulls=2, constant=2, dup=0.5)).status == "GO"
    assert verdict(spark, table(rows=50)).blocking_reasons == ["few_rows: 50 rows, 51 needed"]
    assert verdict(spark, table(rows=0)).blocking_reasons == ["empty_table: no rows", "few_rows: 0 rows, 51 needed"]
    assert verdict(spark, table(rows=60, dup=0.51)).status == "WARNING" and verdict(spark, table(rows=60, dup=0.81)).status == "BLOCKED"
    text = lambda **k: ("f", "txt", *[k.get(n) for n in ("rows", "words", "columns", "nulls", "constant", "dup", "bad", "same", "flags")])
    assert verdict(spark, text(words=9, bad=0.2, same=0.5)).status == "GO"
    assert verdict(spark, text(words=9, bad=0.3)).status == "WARNING" and verdict(spark, text(words=9, bad=0.31)).status == "BLOCKED"
    timed = verdict(spark, text(words=0, flags=["profile_extraction_timed_out", "high_garbled_text"]))
    assert timed.status == "BLOCKED" and timed.blocking_reasons == ["timeout: profile_extraction_timed_out"] and timed.warnings == []
    assert verdict(spark).status == "GO"


def test_vague_prompt_blocks(spark):
    got = verdicts.assess(spark.createDataFrame([], PROFILE), " do it ").first()
    assert got.status == "BLOCKED" and verdicts.assess(spark.createDataFrame([], PROFILE), "do it now").first().status == "GO"


def test_readiness(spark):
    assert [value(spark, verdicts.volume_score(F.lit(n), F.lit(10), F.lit(20), F.lit(40))) for n in (5, 10, 20, 40)] == [0.35, 0.70, 0.85, 1.0]
    assert value(spark, verdicts.alignment(F.lit("maybe 0.8 or so"))) == 0.8 and value(spark, verdicts.alignment(F.lit("good"))) == 0.7
    pairs = spark.createDataFrame([("q", "w " * 80, s) for s in "abc"], "question string, answer string, source_file string")
    got = verdicts.readiness(pairs, 1, 2, 3, "1.0").first()
    assert got.verdict == "READY" and abs(got.score - 1.0) < 1e-9
    none = verdicts.readiness(pairs.limit(0), 1, 2, 3).first()
    assert none.verdict == "NOT_READY" and none.score == 0.0


def test_record_formats(spark):
    fmt = lambda task, model="": value(spark, X.record_format(F.lit(task), F.lit(model)))
    assert fmt("chatbot") == "alpaca" and fmt("conversational-qa") == "sharegpt" and fmt("summarization", "led-chat-mistral") == "seq2seq"
    assert fmt("summarization", "Qwen") == "chat" and fmt("summarization", "x") == "alpaca" and fmt("classification") == "alpaca_label"
    pairs = spark.createDataFrame([(5, "doc", 'a "quoted"\nline'), (2, None, None)], "pair_id long, question string, answer string")
    records = {r["pair_id"]: json.loads(r["record"]) for r in X.export_records(pairs, "summarization", "mistral").collect()}
    assert records[5]["messages"][0]["content"] == X.SUMMARY_INSTRUCTIONS[1] + "\n\ndoc" and records[5]["messages"][1]["content"] == 'a "quoted"\nline'
    assert records[2]["messages"][1]["content"] == ""


def test_splits_are_disjoint_complete_and_stable(spark):
    for n, want in ((0, {}), (2, {"train": 2}), (3, {"val": 1, "test": 1, "train": 1}), (20, {"val": 2, "test": 2, "train": 16})):
        counts = {r["split"]: r["n"] for r in X.split_counts(X.assign_splits(spark.range(n), "id")).collect()}
        assert counts == want
    a, b = ({(r["id"], r["split"]) for r in X.assign_splits(spark.range(500).repartition(k), "id").collect()} for k in (1, 9))
    assert a == b


def test_write_splits(spark, tmp_path):
    records = X.assign_splits(X.export_records(spark.createDataFrame([(i, "q", "a") for i in range(10)], "pair_id long, question string, answer string")), "pair_id")
    counts = {r["split"]: r["n"] for r in X.write_splits(records, str(tmp_path)).collect()}
    assert counts == {"train": 8, "val": 1, "test": 1}
    assert spark.read.json(str(tmp_path / "splits" / "split=train")).count() == 8 and spark.read.json(str(tmp_path / "dataset")).count() == 10


def test_preview_and_report(spark):
    shown = X.dataset_preview(spark.createDataFrame([(1, '{"instruction": "x"}'), (2, '{"conversations": []}')], "i int, record string"), "i")
    assert {r["format"] for r in shown.collect()} == {"sharegpt"}
    jobs = spark.createDataFrame([(1,), (2,)], "job_id int")
    got = X.merged_report(jobs, spark.createDataFrame([(1, 0.5)], "job_id int, loss double"), jobs.limit(0).withColumn("m", F.lit(1)), jobs.limit(0).withColumn("j", F.lit(1))).orderBy("job_id").collect()
    assert got[0]["training"]["loss"] == 0.5 and got[1]["training"] is None


def test_registry(spark):
    size = lambda name: value(spark, R.model_size(F.lit(name)))
    assert [size(n) for n in ("a/Qwen2.5-0.5B-Instruct", "m_7b-x", "tiny", "mini", "medium", "large", "extra-large", "xl", "?")] == [0.5, 7.0, 0.1, 0.5, 3.0, 13.0, 30.0, 30.0, 7.0]
    need = R.data_requirements(spark.createDataFrame([("x-3B", "full", "sentiment-analysis"), ("x-0.3B", "lora", "?")], "model string, peft string, task string")).collect()
    assert (need[0]["min_viable"], need[0]["target"]) == (1400, 4000) and (need[1]["min_viable"], need[1]["saturate"]) == (50, 600)
    assert value(spark, R.memory_needed(F.lit(7.0), F.lit("qlora"))) == 5.8
    assert [value(spark, R.memory_budget(F.lit(x))) for x in (1.0, 4.0, 24.0)] == [1, 3, 21]
    assert [value(spark, R.device_policy(F.lit(x))) for x in (1.1, 1.2, 1.5, 2.5)] == ["cpu", "gpu_4bit", "gpu_8bit", "gpu_half"]
    assert [value(spark, R.trial_count(F.lit(o), F.lit(n))) for o, n in (("speed", 9), ("quality", 1), ("x", 9), ("x", None))] == [3, 2, 4, 3]
    base = F.create_map(F.lit("lora_rank"), F.lit(8.0), F.lit("batch"), F.lit(1.0))
    full = F.create_map(*[F.lit(x) for k in ("lora_rank", "lora_alpha", "lora_dropout", "learning_rate", "num_train_epochs", "warmup_ratio", "weight_decay") for x in (k, "2")])
    assert value(spark, R.advised_parameters(full, base))["lora_rank"] == 2.0
    assert value(spark, R.advised_parameters(F.create_map(F.lit("lora_rank"), F.lit("2")), base))["lora_rank"] == 8.0
    assert value(spark, R.public_config(F.create_map(F.lit("_a"), F.lit(1), F.lit("b"), F.lit(2)))) == {"b": 2}


def test_adaptive_length(spark):
    length = lambda chars, task="x": R.adaptive_length(spark.createDataFrame([(c,) for c in chars], "c int"), "c", task).first()["max_length"]
    assert length([]) == 2048 and length([10]) == 256 and length([1000] * 20) == 512 and length([10**6]) == 2048 and length([1], "code-generation") == 4096


def test_retrieval(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "k int, v array<double>")
    got = retrieval.top_k(items, "v", [1.0, 0.0], 3, "k").orderBy("rank").collect()
    assert [(r["k"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "model_id string, rank int")
    tried, cached = spark.createDataFrame([("a",)], "model_id string"), spark.createDataFrame([("d", True)], "model_id string, cached boolean")
    assert [r["model_id"] for r in retrieval.candidates(ranked, tried, cached).collect()] == ["d", "b", "c"]
    assert [r["model_id"] for r in retrieval.candidates(ranked, tried, cached, only_cached=True).collect()] == ["d"]
    assert retrieval.picked(retrieval.candidates(ranked, tried, cached), "c").first()["model_id"] == "c"
    assert retrieval.picked(retrieval.candidates(ranked, tried, cached), "zzz").first()["model_id"] == "d"


def test_each_query_searches_all_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(230)] + [(300 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(12)] + [(400, [0.0] * 4), (450, None), (500, [1.0, 2.0])]
    items = spark.createDataFrame(rows, "k long, v array<double>")
    unit = {k: [x / math.hypot(*v) for x in v] for k, v in rows if v and any(v)}
    score = lambda a, b: round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 9)
    want = {q: sorted(((-score(q, k), k) for k in unit if k != q and len(unit[k]) == len(unit[q])))[:6] for q in unit if q % 50 == 0}
    for block in (16, 1024):
        got = retrieval.top_k_each(items, items.where("k % 50 = 0"), "v", 6, "k", block).collect()
        found = {q: [(-round(r["score"], 9) + 0.0, r["k"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
        assert found == {q: [(s + 0.0, k) for s, k in v] for q, v in want.items()} and len(got) == sum(map(len, want.values()))


def test_records_leave_spark_one_by_one(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "k int, record string").repartition(3)
    assert sorted(X.iter_records(df)) == sorted(f"r{i}" for i in range(20))


def test_eligible_cards(spark):
    rows = [("x/m-7b", 7.0, "text-generation", ["chat"]), ("x/m-70b", 70.0, "text-generation", ["chat"]), ("x/none", None, "text-generation", ["chat"]), ("x/m-7b-awq", 7.0, "text-generation", ["chat"]), ("x/m-1b", 1.0, "fill-mask", [])]
    cards = spark.createDataFrame([(m, "", "", False, p, t, b) for m, b, p, t in rows], "model_id string, swift_model_type string, swift_task_type string, is_reward boolean, pipeline_tag string, tags array<string>, parameters_b double")
    assert [r["model_id"] for r in retrieval.eligible_cards(cards, 8.0).collect()] == ["x/m-7b"]


def test_verdict_counts_agree_with_the_merged_verdict(spark):
    rows = [("a", 1, "garbled", 1, "m"), ("a", 2, "empty_text", 2, "n"), ("b", 1, "garbled", 1, "o")]
    findings = spark.createDataFrame(rows, "file string, at int, rule string, severity int, message string")
    merged, counts = verdicts.merge_verdict(findings).first(), verdicts.verdict_counts(findings).first()
    assert (merged["status"], len(merged["blocking_reasons"]), len(merged["warnings"])) == tuple(counts) == ("BLOCKED", 1, 2)
    assert tuple(verdicts.verdict_counts(findings.where("false")).first()) == ("GO", 0, 0)
