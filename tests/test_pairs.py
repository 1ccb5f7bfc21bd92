import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import dedup
from corvane.operators import qa_rules as Q


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_rules(spark):
    assert value(spark, Q.is_vague(F.lit("It depends!"))) and value(spark, Q.is_vague(F.lit(None).cast("string")))
    assert not value(spark, Q.is_vague(F.lit("one two three four five")))
    assert value(spark, Q.is_paraphrase(F.lit("red boats sail quickly"), F.lit("boats sail quickly")))
    assert not value(spark, Q.is_paraphrase(F.lit("what sails"), F.lit("boats with engines")))
    assert value(spark, Q.is_metadata_question(F.lit("Who wrote this?"))) and not value(spark, Q.is_metadata_question(F.lit("Why?")))
    assert value(spark, Q.refers_to_document(F.lit("What happens in the document?")))
    assert value(spark, F.array_sort(Q.signature_words(F.lit("The Étés boats, boats and 2024!")))) == ["2024", "boats", "étés"]


def test_reason_order(spark):
    assert value(spark, Q.filter_reason(F.lit("Who wrote it?"), F.lit("yes"))) == "metadata"
    assert value(spark, Q.filter_reason(F.lit("Why?"), F.lit("yes"))) == "vague"
    assert value(spark, Q.filter_reason(F.lit("Why?"), F.lit("because water flows downhill always"))) is None


def test_grounding(spark):
    claims = value(spark, F.array_sort(Q.claims(F.lit("NASA used 1234 and McDonald X-Ray, However"))))
    assert claims == ["1234", "mcdonald", "nasa", "x-ray"] or claims == ["1234", "mcdonald", "nasa"]
    assert value(spark, Q.is_ungrounded(F.lit("NASA IBM 1234"), F.lit("nothing here")))
    assert not value(spark, Q.is_ungrounded(F.lit("NASA IBM"), F.lit("nothing here")))
    assert not value(spark, Q.is_ungrounded(F.lit("NASA IBM 1234"), F.lit("nasa and ibm")))


def test_tolerant_parsing(spark):
    ask = lambda raw: [(r["question"], r["answer"]) for r in value(spark, Q.parse_pairs(F.lit(raw)))]
    assert ask('```json\n[{"question": "q", "answer": "a"}]\n``` bye') == [("q", "a")]
    assert ask('[{"question": "q", "answer": "a\nb"}]') == [("q", "a b")]
    assert ask("[{'question': 'q', 'answer': 'a'}]") == [("q", "a")]
    assert ask("no list") == [] and ask(None) == []


def test_last_tool_call(spark):
    df = spark.createDataFrame([('x {"tool": 1} {"tool": {"a": 2}} {"b": 3}',), (None,), ("{",)], "t string")
    assert [r["x"] for r in df.select(Q.last_tool_call("t").alias("x")).collect()] == ['{"tool": {"a": 2}}', None, None]


def test_score_boundaries(spark):
    got = [value(spark, Q.score_decision(F.lit(x).cast("double"))) for x in (0.62, 0.6199, 0.35, 0.3499, None)]
    assert got == ["keep", "refine", "refine", "drop", "refine"]


def greedy(items):
    import re

    kept, out = [], {}
    for key, text in items:
        norm = re.sub(r"\s+", " ", text or "").strip().lower()
        sig = {w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 3 and w not in Q.STOP_WORDS}
        rules = []
        for n, s in kept:
            if norm and n == norm:
                rules.append(1)
            elif len(norm) >= 30 and len(n) >= 30 and n[:60] == norm[:60]:
                rules.append(2)
            elif sig and s and 2 * len(sig & s) > len(sig | s):
                rules.append(3)
        out[key] = min(rules) if rules else None
        if not rules:
            kept.append((norm, sig))
    return out


def test_lexical_dedup_is_greedy(spark):
    rng = random.Random(3)
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotels"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(150)]
    items += [(200, None), (201, ""), (202, "x" * 70 + "a"), (203, "x" * 70 + "b"), (204, "X" * 70 + "A"), (205, "y" * 29 + "1"), (206, "y" * 29)]
    got = {r["pair_id"]: r["drop_rule"] for r in dedup.lexical_dedup(spark.createDataFrame(items, "pair_id long, question string")).collect()}
    assert got == greedy(items)


def test_registered_lexical_dedup_reads_whole_texts(spark):
    from corvane.plans import catalog

    sf = "/root/testdata/sf0.001"
    items = sorted((r["doc_id"], r["text"]) for r in catalog.table(spark, sf, "documents").collect())
    want = greedy(items)
    assert {r["pair_id"]: r["drop_rule"] for r in catalog.QUERIES["dedup_lexical"](spark, sf).collect()} == want
    assert want != greedy([(i, t.split("\n")[0]) for i, t in items]) and set(want.values()) > {None}


def test_copies_of_a_set_are_compared_once(spark):
    items = [(i, f"alpha bravo charlie {'!' * (i % 3)}") for i in range(60)] + [(100 + i, "alpha bravo charlie deltas") for i in range(60)]
    sets = spark.createDataFrame(items, "id long, t string").select("id", Q.signature_words("t").alias("sig"))
    assert dedup.jaccard_cliques(sets).count() == 60 + 60 + 120


def test_chain_keeps_both_ends(spark):
    # a ~ b ~ c but not a ~ c: b goes, c stays
    items = [(1, "alpha bravo charlie"), (2, "alpha bravo charlie deltas echoes"), (3, "charlie deltas echoes bravo foxtrot")]
    got = {r["pair_id"]: r["drop_rule"] for r in dedup.lexical_dedup(spark.createDataFrame(items, "pair_id long, question string")).collect()}
    assert got == greedy(items) and got[3] is None


def test_semantic_dedup(spark):
    v = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [0.99, 0.1], [0.0, 1.0]), (3, [0.0, 1.0], [1.0, 0.01]), (4, [0.0, 0.0], [0.5, 0.5]), (5, None, [-1.0, 0.0])]
    items = spark.createDataFrame(v, "pair_id long, q array<double>, a array<double>")
    got = {r["pair_id"]: r["fate"] for r in dedup.semantic_dedup(items, "pair_id", "q", "a").collect()}
    assert got == {1: "kept", 2: "eval_pool", 3: "dropped", 4: "kept", 5: "kept"}


def test_cosine_blocks_agree_with_one_block(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    a, b = ({(r["i"], r["j"]) for r in dedup.cosine_pairs(df, "id", "v", 0.8, block).collect()} for block in (16, 1024))
    assert a == b and a


def test_first_independent_of_clique_and_path(spark):
    cliques = [("k", i) for i in range(5)] + [("p1", 4), ("p1", 9), ("p2", 9), ("p2", 10)]
    got = {r["id"]: r["dropped"] for r in dedup.first_independent(spark.createDataFrame(cliques, "g string, id long")).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: True, 9: False, 10: True}


def test_cosine_pairs_match_all_pairs(spark, monkeypatch):
    """Clustered, repeated, zero and short vectors; small blocks and few lists."""
    import numpy as np

    from corvane.operators import dedup

    monkeypatch.setattr(dedup, "PIVOTS", 9)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).tolist()) for i in range(120)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(30)] + [(300, [0.0] * 8), (301, None), (302, [1.0, 2.0]), (303, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    good = [(i, np.array(v)) for i, v in rows if v and any(v)]
    cos = lambda x, y: float(x @ y / np.sqrt((x @ x) * (y @ y)))
    want = {(i, j) for i, x in good for j, y in good if i < j and len(x) == len(y) and cos(x, y) >= 0.9}
    assert {tuple(r) for r in dedup.cosine_pairs(df, "id", "v", 0.9, block=16).collect()} == want
    kept = []
    for i, x in sorted(good, key=lambda r: r[0]):
        if not any(len(x) == len(y) and cos(x, y) >= 0.9 for _, y in kept):
            kept.append((i, x))
    fates = {r["id"]: r["fate"] for r in dedup.semantic_dedup(df, "id", "v", least_question=0.9).collect()}
    assert {i for i, f in fates.items() if f == "kept"} == {i for i, _ in kept} | {300, 301}


def test_copies_cost_no_pairs(spark):
    from corvane.operators import dedup

    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)], "id long, v array<double>")
    assert dedup.cosine_cliques(df, "id", "v", 0.9).count() == 3000
    text = spark.createDataFrame([(i, f"question {i} about gardens weather kitchens") for i in range(3000)], "pair_id long, question string")
    assert dedup.jaccard_cliques(text.selectExpr("pair_id AS id", "array('gardens', 'weather') AS sig")).count() == 3000


def first_come(cliques):
    """In order, an id goes if it shares a set with a kept earlier one."""
    sets = {}
    for g, i in cliques:
        sets.setdefault(i, set()).add(g)
    kept, out = set(), {}
    for i in sorted(sets):
        out[i] = bool(sets[i] & kept)
        if not out[i]:
            kept |= sets[i]
    return out


@pytest.mark.parametrize("at_once", [0, 8, 10**6])
def test_components_of_any_size_are_settled_alike(spark, at_once):
    rng = random.Random(at_once)
    cliques = [(f"c{k // 3}", rng.randrange(90)) for k in range(150)] + [(f"p{i}", i + d) for i in range(100, 112) for d in (0, 1)] + [("lone", 500)]
    cliques = list(dict.fromkeys(cliques))
    got = {r["id"]: r["dropped"] for r in dedup.first_independent(spark.createDataFrame(cliques, "g string, id long"), at_once).collect()}
    assert got == first_come(cliques)


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"e{k}", x) for k in range(60) for x in rng.sample(range(100), 2)] + [("one", 200)]
    parent = {i: i for _, i in edges}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for k in range(60):
        a, b = (find(i) for g, i in edges if g == f"e{k}")
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["comp"] for r in dedup.components(spark.createDataFrame(edges, "g string, id long")).collect()}
    assert got == {i: find(i) for i in parent}


def test_a_long_chain_takes_a_handful_of_jobs(spark):
    chain = spark.range(100_000).selectExpr("concat('e', id) AS g", "explode(array(id, id + 1)) AS id")
    tracker, group = spark.sparkContext.statusTracker(), "chain"
    spark.sparkContext.setJobGroup(group, "")
    state = dedup.first_independent(chain)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "")
    assert state.where("dropped <> (id % 2 = 1)").isEmpty() and state.count() == 100_001
    assert jobs <= 12


@pytest.mark.parametrize("percent", [50, 80])
def test_jaccard_candidates_lose_no_pair(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(400)]
    sets = []
    for k in range(160):
        if k % 4 == 0 or not sets:
            words = rng.sample(vocabulary, rng.randint(1, 120))
        else:  # a set like an earlier one, up to and over the threshold
            words = list(rng.choice(sets))
            for _ in range(rng.randint(0, max(1, len(words) // 2))):
                rng.choice([lambda: words.append(rng.choice(vocabulary)), lambda: words and words.pop(rng.randrange(len(words)))])()
        sets.append(set(words))
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, sig array<string>")
    want = {(i, j) for i in range(160) for j in range(i + 1, 160) if sets[i] | sets[j] and 100 * len(sets[i] & sets[j]) > percent * len(sets[i] | sets[j]) and sets[i] and sets[j]}
    assert {tuple(r) for r in dedup.jaccard_pairs(df, percent).collect()} == want and len(want) > 50
    assert {tuple(sorted(r)) for r in dedup.jaccard_candidates(df, percent).collect()} >= want


def test_hashed_cosine_pairs_find_nearly_all(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((150, 48))
    v = np.concatenate([c + 0.3 * rng.standard_normal((8, 48)) for c in centres])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(cos >= 0.90, 1)), strict=True)}
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 48), (9002, [1.0, 2.0]), (9003, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    exact = {tuple(r) for r in dedup.cosine_pairs(df, "id", "v", 0.90).collect()}
    hashed = {tuple(r) for r in dedup.cosine_pairs_hashed(df, "id", "v", 0.90).collect()}
    assert exact == want | {(9002, 9003)} and hashed <= exact
    assert len(hashed) >= 0.95 * len(exact) and len(want) > 300


@pytest.mark.parametrize("least", [0.2, 0.9])
def test_vectors_in_order_make_no_pairs(spark, tmp_path, monkeypatch, least):
    """Blocks of 16: what goes is near a kept earlier one, and nothing on disk grows with the pairs."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 6))
    rows = [(int(i), (centres[i % 5] + rng.normal(size=6) * 0.3).tolist()) for i in rng.permutation(200)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)] + [(300, [0.0] * 6), (301, None), (302, [1.0, 2.0]), (303, [2.0, 4.0]), (304, [float("nan")] * 2), (305, [None, 1.0]), (306, [1e200, 2e200])]
    kept = []
    for i, v in sorted(rows):
        x = np.array(v, float) if v and None not in v and any(v) else np.full(1, np.nan)
        x = x / np.abs(x).max()
        if not any(len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least for _, y in kept):
            kept.append((i, x))
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    got = sorted(r["id"] for r in dedup.near_kept(df, "id", "v", least, block=16).collect())
    assert got == sorted({i for i, _ in rows} - {i for i, _ in kept}) and {303, 306} <= set(got)
    monkeypatch.setattr(dedup, "_fresh", lambda _, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    copies = spark.range(4000).selectExpr("id", "array(1.0D, id / 1e6) AS v")
    monkeypatch.setattr(dedup, "discard", lambda _: None)
    assert dedup.semantic_dedup(copies, "id", "v").where("fate = 'kept'").count() == 1
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 300_000


def test_blocks_of_sets_of_any_size_find_the_same_candidates(spark, monkeypatch):
    """Blocks of 100 words in several rounds, sizes that are dealt to several blocks, and groups of near copies cut to blocks of 4."""
    monkeypatch.setattr(dedup, "AT_A_TIME", 1)
    monkeypatch.setattr(dedup, "BLOCK", 4)
    monkeypatch.setattr(dedup, "VERIFIED", 60)
    rng = random.Random(5)
    sets = [set(rng.sample([f"w{i}" for i in range(60)], rng.randint(1, 40))) for _ in range(60)] + [{f"c{i}" for i in range(20)} - {f"c{k}"} for k in range(20)]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, sig array<string>")
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if 2 * len(sets[i] & sets[j]) > len(sets[i] | sets[j])}
    hashed = dedup.written(df.select("id", *dedup._hashed("sig")), "t")
    pairs = dedup._candidates(hashed, 50, block=100)
    assert {tuple(sorted(r)) for r in pairs.collect()} >= want and len(want) >= 190
    assert {tuple(r) for r in dedup._verified(pairs, hashed, lambda ids: df.join(ids, "id", "left_semi"), 50).collect()} == want


def test_lexical_dedup_leaves_no_shuffles(spark):
    """What stays in Spark's own folders is a small part of what its steps shuffled."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()))

    rng, before = random.Random(6), held()
    texts = [" ".join(f"word{rng.randrange(5000)}" for _ in range(80)) for _ in range(600)]
    texts += [t + " more" for t in texts[:50]]
    got = dedup.lexical_dedup(spark.createDataFrame(list(enumerate(texts)), "pair_id long, question string"))
    assert got.where("drop_rule IS NOT NULL").count() == 50
    assert held() - before < sum(map(len, texts)) / 2
