"""Operators on whole texts against brute force on small tables with nulls, empty texts, ties, repeats and extra columns."""

import hashlib
import math
import pathlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate, langid, lm, neardup, queries, store, substring, tokens, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, score double"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(rows, rng=None):
    return [(i, t, "en", "s", 0.0) for i, t in rows]


def random_texts(n, seed, vocab=40, longest=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocab)] + ["É", "x.y", "The"]
    return [rng.choice([" ", "\n", "  ", "\t"]).join(rng.choices(pool, k=rng.randint(0, longest))) for _ in range(n)]


def test_words_are_whitespace_runs_whatever_the_piece_size(monkeypatch):
    texts = [*random_texts(30, 1), None, "", " \t\n", "a" * 500, "é" * 300 + " b"]
    monkeypatch.setattr(words, "PIECE_BYTES", 64)
    found = {}
    for lo, hi, hashes, offsets in words.hashed_texts(pa.array(texts), lower=True):
        for i in range(hi - lo):
            mine = hashes[offsets[i] : offsets[i + 1]].tolist()
            said = WORD.findall(lower(texts[lo + i]))
            assert len(mine) == len(said)
            for w, h in zip(said, mine, strict=True):
                assert found.setdefault(w, h) == h
    assert len(set(found.values())) == len(found)


def test_intermediate_tables_can_be_deleted(spark):
    from pathlib import Path

    tables = lambda: {p.name for p in Path(store.shared_dir(spark).removeprefix("file://")).iterdir()}
    docs, before = spark.createDataFrame(corpus(near_copies(3)), DOCS), None
    store.materialise(docs, "first")
    before = tables()
    with store.workspace(spark) as keep:
        result = keep(neardup.keep_one_of_each(docs, k=2), "result")
        inside = tables() - before
    left = tables() - before
    assert len(inside) > 5 and len(left) == 1 and next(iter(left)).startswith("result-")
    assert 0 < result.count() < docs.count()
    store.discard(result)
    assert tables() == before


def jaccard_sets(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components_by_hand(rows, k, percent):
    sets = [(i, jaccard_sets(t, k)) for i, t in rows if i is not None]
    best = {i: i for i, _ in sets}

    def root(x):
        while best[x] != x:
            x = best[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                best[q] = p
    return {i: root(i) for i, _ in sets}


def near_copies(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = [f"v{rng.randint(0, 300)}" for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"n{rng.randint(0, 999)}"
            rows.append((n, " ".join(t)))
            n += 1
    rng.shuffle(rows)
    return rows + [(1000, None), (1001, ""), (1002, "Solo"), (1003, "solo"), (1004, "a b"), (1005, "A  b"), (1006, "a b")]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rows = near_copies(k)
    got = neardup.near_duplicates(spark.createDataFrame(corpus(rows), DOCS), k=k).collect()
    want = components_by_hand(rows, k, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    sizes = dict((i, len(jaccard_sets(t, k))) for i, t in rows)
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)


def test_links_across_components_of_a_bucket_are_found(spark, monkeypatch):
    """Without any component, all links of a bucket but those to its first set come from the second round."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = near_copies(9)
    docs = spark.createDataFrame(corpus(rows), DOCS)
    signed = store.materialise(neardup.signatures(docs, 2, "doc_id", "text").where("n_shingles > 0"), "signed")
    sets = signed.dropDuplicates(["h1", "h2"]).select(F.col("id").alias("node"), "id", "version", "n_shingles", "sig", "bands")
    shared = sets.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    n = shared.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n"))
    nothing = spark.createDataFrame([], "node long, comp long")
    found = {(min(r), max(r)) for r in neardup._across(shared.join(n, "bucket"), nothing, sets, docs, 2, 80, 1e-6, "doc_id", "text").collect()}
    full = {r["node"] for r in sets.collect()}
    want = components_by_hand([x for x in rows if x[0] in full], 2, 80)
    assert found and all(want[a] == want[b] for a, b in found)


def test_overlaps_are_those_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    overlaps = neardup.Overlaps(sets)
    for x in range(30):
        others = rng.permutation(30)[:11]
        assert overlaps.similar(x, others, 40).tolist() == [neardup.similar(sets[x], sets[y], 40) for y in others]


def test_rows_that_share_an_id_follow_their_own_text(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, one), (2, one + " x"), (2, two), (3, two + " y"), (4, two + " y")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(corpus(rows), DOCS)).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 2, False)]
    kept = neardup.keep_one_of_each(spark.createDataFrame(corpus([*rows, (2, two), (5, None), (5, None), (6, ""), (7, one.upper()), (7, two.upper())]), DOCS))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(1, one), (2, two)]
    same = neardup.keep_one_of_each(spark.createDataFrame(corpus([(1, one), (1, one.upper()), (1, "else")]), DOCS)).collect()
    assert sorted(r["text"].lower() for r in same) == sorted([one, "else"])


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert neardup.near_duplicates(empty).collect() == []
    rows = [(None, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None)]
    got = sorted(neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in got] == [(3, 3, True), (3, 3, True), (None, None, True), (None, None, True)]
    kept = neardup.keep_one_of_each(spark.createDataFrame(rows[2:], DOCS))
    assert kept.count() == 1 and kept.columns == [x.split()[0] for x in DOCS.split(", ")]


def test_pruning_bound_is_a_posterior_tail():
    least = neardup.least_matches(0.8, 1e-6)
    assert len(least) == 4 and list(least) == sorted(least) and least[-1] < 0.8 * 128
    same = np.zeros((1, 128), np.uint32)
    other = same.copy()
    other[0, : 128 - least[-1] + 1] = 1
    assert neardup.survives(same, same, 0.8, 1e-6)[0] and not neardup.survives(same, other, 0.8, 1e-6)[0]


def repeats_by_hand(rows, k):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(20, 70))] for _ in range(5)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            w += rng.choice([p, p[a:], p[: len(p) - a], [rng.choice(pool) for _ in range(30)], ["same"] * 45])
        rows.append((i, rng.choice([" ", "\n "]).join(w)))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (503, "É é"), (-4, rows[7][1])]
    got = substring.remove_repeats(spark.createDataFrame(corpus(rows), DOCS).repartition(5), k=20).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == repeats_by_hand(rows, 20)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_substring_dedup_of_odd_tables(spark, monkeypatch):
    assert substring.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, None, None, None)]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 0), (1, 30), (1, 30)]  # the null id counts as the smallest
    monkeypatch.setattr(substring, "HELD", 3)
    again = substring.remove_repeats(spark.createDataFrame(corpus([(i, text) for i in range(4)]), DOCS)).collect()
    assert sorted(r["n_removed"] for r in again) == [0, 30, 30, 30]


def test_a_minimiser_in_many_contexts_is_spread(spark):
    """One phrase in 20000 contexts: its pieces differ, and no task gets more than its share of them."""
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(5000)]
    phrase = "the very common words of all"
    texts = [" ".join(rng.choices(pool, k=18)) + f" {phrase} " + " ".join(rng.choices(pool, k=18)) for _ in range(20000)]
    docs = spark.createDataFrame(corpus(list(enumerate(texts))), DOCS).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text").repartition(8)
    dealt = substring._dealt(substring._emit(docs, 20).where("kind = 0")).withColumn("p", F.spark_partition_id())
    hot = dealt.groupBy("m").count().orderBy(F.desc("count")).first()
    assert hot["count"] > 300
    parts = [r["count"] for r in dealt.where(F.col("m") == hot["m"]).groupBy("p").count().collect()]
    assert len(parts) > 1 and max(parts) < 2 * hot["count"] / len(parts)
    assert substring.remove_repeats(docs.withColumnRenamed("id", "doc_id")).where("n_removed > 0").count() == 0


def test_repeats_compact_to_paths_and_are_verified(spark):
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(300)]
    one, two = ([rng.choice(pool) for _ in range(200)] for _ in range(2))
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(["x", *one[20:160], "y", *two])), (4, " ".join(one))]
    docs = spark.createDataFrame(corpus(rows), DOCS).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version"), "text").repartition(3)
    paths = substring.repeated_paths(docs, 20)
    found = sorted((r["id"], r["start"], r["n"], r["fid"], r["fstart"]) for r in paths.collect())
    assert (3, 142, 181, 2, 0) in found and len(found) <= 6
    assert sum(n for i, _, n, _, _ in found if i == 3) == 121 + 181 and sum(n for i, _, n, _, _ in found if i == 4) == 181
    # A path whose source holds other words is not removed.
    wrong = paths.where("id = 3").withColumn("fstart", F.col("fstart") + 1).where("n < 150")
    digests = substring.with_source_digests(docs, wrong, 20).collect()
    texts = dict(rows)
    for r in digests:
        words_ = texts[3].split()[r["start"] : r["start"] + r["n"] + 19]
        source = texts[r["fid"]].split()[r["fstart"] : r["fstart"] + r["n"] + 19]
        assert substring._digest(" ".join(source).encode()) == r["digest"] != substring._digest(" ".join(words_).encode())


def test_substring_dedup_leaves_one_table_and_no_shuffle_behind(spark):
    """What a step has shuffled or written goes when no later step reads it, whenever the driver collects its garbage."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(300)]
    passage = [rng.choice(pool) for _ in range(60)]
    rows = [(i, " ".join([*rng.choices(pool, k=30), *passage[i % 7 :], *rng.choices(pool, k=30)])) for i in range(40)]
    docs = spark.createDataFrame(corpus(rows), DOCS).repartition(3)
    top = pathlib.Path(store.shared_dir(spark).removeprefix("file:"))
    local = [pathlib.Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    tables = lambda: {p.name for p in top.iterdir()}
    shuffles = lambda: {p.name for d in local for p in d.rglob("shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, old_tables, old_shuffles = spark.conf.get(name), tables(), shuffles()
    done = substring.remove_repeats(docs)
    until = time.time() + 10  # block managers delete in the background
    while (left := shuffles() - old_shuffles) and time.time() < until:
        time.sleep(0.2)
    assert not left and [n.rsplit("-", 1)[0] for n in tables() - old_tables] == ["repeated-spans"] and spark.conf.get(name) == was
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in done.collect()} == repeats_by_hand(rows, 20)


def tiles_by_hand(item, doc, least):
    """Longest common runs of unmarked words, marked greedily."""
    mi, mj, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (least - 1, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not mj[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        mi[i : i + n], mj[j : j + n] = [True] * n, [True] * n
        total += n


def leak_rows(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    items = [[rng.choice(pool) for _ in range(rng.randint(5, 30))] for _ in range(8)]
    docs = []
    for _ in range(60):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 20))]
        p = list(rng.choice(items))
        cut = rng.randint(0, len(p))
        w += rng.choice([p, p[cut:] + ["zz"] + p[:cut], p[: len(p) // 2], [], p + p])
        docs.append(w + [rng.choice(pool) for _ in range(rng.randint(0, 10))])
    return items, docs


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination_matches_brute_force(spark, broadcast):
    items, docs = leak_rows(4)
    bench = spark.createDataFrame([(i, ", ".join(x).upper()) for i, x in enumerate(items)] + [(90, None), (91, "too few words"), (92, ""), (93, "One")], "item_id long, text string")
    rows = [(i, " ".join(x)) for i, x in enumerate(docs)] + [(200, None), (201, ""), (202, "one of too-few \u201cwords\u201d")]
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontaminate.contaminated(spark.createDataFrame(corpus(rows), DOCS), bench, broadcast_seeds=broadcast).collect()}
    want = {(d, i): n for d, w in enumerate(docs) for i, x in enumerate(items) if 100 * (n := tiles_by_hand(x, w, 5)) >= 80 * len(x)}
    assert got == want | {(202, 91): 3} and want


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_phrases_of_many_items_ask_no_document(spark, broadcast):
    """Items begin with one prompt, documents repeat it; only the document with an item's own words leaks."""
    prompt = "please answer the next question now"
    items = [(i, f"{prompt} " + " ".join(f"q{i}x{j}" for j in range(12))) for i in range(300)]
    held = decontaminate.items_of(items, 5)
    shared = {x: sum(x in item.seeds for item in held) for x in held[0].seeds}
    kept = decontaminate.indexed_seeds(held[0], shared, 5, 80)
    assert len(kept) < len(held[0].seeds) and all(shared[x] == 1 for x in kept)
    rows = [(i, f"{prompt} " * 200) for i in range(20)] + [(50, f"x {prompt} " * 30 + items[7][1])]
    docs = spark.createDataFrame(corpus(rows), DOCS).withColumnRenamed("doc_id", "key")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), id_col="key", broadcast_seeds=broadcast).collect()
    assert [(r["key"], r["item_id"], r["matched_words"]) for r in got] == [(50, 7, 18)]


def test_decontamination_keeps_clean_documents_and_columns(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = corpus([(1, "clean text that is long enough to be read by someone"), (2, "x " + passage), (3, "six seven eight nine ten and one two three four five"), (None, passage), (5, None)])
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaks", F.lit("mine"))
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    left = decontaminate.decontaminate(docs.drop("leaks"), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 5] and left.columns == docs.columns[:-1]
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 5
    assert decontaminate.contaminated(spark.createDataFrame([], DOCS), bench).collect() == []


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1]
    to = langid.suffix_automaton(text)

    def walk(s):
        at = 0
        for c in s:
            at = to[at].get(c)
            if at is None:
                return False
        return True

    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    rng = random.Random(0)
    for _ in range(500):
        s = tuple(rng.choices([1, 2, 3], k=rng.randint(0, 5)))
        assert walk(s) == (s in subs)


def phrases_by_hand(sample, text):
    n, at = 0, 0
    while at < len(text):
        m = 1
        while at + m < len(text) and text[at : at + m + 1] in sample:
            m += 1
        n, at = n + 1, at + m
    return n


def test_phrase_counts_match_greedy_parsing():
    rng = random.Random(2)
    sample = {"aa": ["".join(rng.choices("abc", k=200))], "bb": ["".join(rng.choices("bcd", k=200))]}
    model = langid.fit(sample)
    texts = ["".join(rng.choices("abcd", k=rng.randint(1, 80))) for _ in range(40)]
    lut = langid.char_classes(model)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    got = langid.phrases(model, lut, codes, ends - [len(t) for t in texts], ends)
    for k, lang in enumerate(model.languages):
        assert got[k].tolist() == [phrases_by_hand(sample[lang][0], t) for t in texts]


def test_many_languages_of_many_letters():
    """100 languages of 3000 letters each: a table of bounded size, and phrase counts as by hand."""
    rng = random.Random(8)
    pool = [chr(c) for c in range(0x4E00, 0x4E00 + 9000)]
    sample = {f"l{i}": ["".join(rng.sample(pool, 3000))] for i in range(100)}
    model = langid.fit(sample)
    assert model.nbytes < 100 << 20 and len(model.languages) == 100
    texts = [sample["l3"][0][50:90], sample["l99"][0][7:50] + sample["l4"][0][:9], "".join(rng.sample(pool, 30)), "Xyz é"]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    got = langid.phrases(model, langid.char_classes(model), codes, ends - [len(t) for t in texts], ends)
    for k in (0, 3, 4, 42, 99):
        name = model.languages[k]
        assert got[k].tolist() == [phrases_by_hand(sample[name][0], t) for t in texts]


def test_predictions_match_a_parser_by_hand(spark):
    """The whole result: language, and score from the two least normalised phrase counts."""
    rng = random.Random(12)
    samples = {"aa": ["".join(rng.choices("abc ", k=300)), "cab"], "bb": ["".join(rng.choices("bcd ", k=5000))], "cc": ["".join(rng.choices("ef", k=40))]}
    texts = ["".join(rng.choices(rng.choice(["abc", "bcd", "abcd", "ef", "abcdef"]), k=rng.randint(1, 60))) for _ in range(60)]
    squeezed = {k: re.sub(" +", " ", " ".join(v)) for k, v in samples.items()}
    got = langid.identify_languages(spark.createDataFrame(corpus(list(enumerate(texts))), DOCS), langid.fit(samples)).collect()
    for r in got:
        costs = sorted((phrases_by_hand(squeezed[k], texts[r["doc_id"]]) * math.log2(max(len(" ".join(samples[k])), langid.LEAST_SAMPLE)), k) for k in samples)
        assert r["lang_pred"] == costs[0][1] and math.isclose(r["score"], 1 - costs[0][0] / costs[1][0], abs_tol=1e-12)


def test_held_out_accuracy(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", F.length("text").alias("n"))
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").where("n >= 50")
    right, every = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert every > 150 and right / every > 0.95


def test_language_id_on_odd_rows(spark):
    rng = random.Random(7)
    say = lambda syllables: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(20))
    langs = {"xx": ["ka", "lo", "mi"], "yy": ["thr", "ing", "ould"]}
    rows = [(i, say(langs[k]), k, "s", 9.0) for i, k in enumerate(["xx", "yy"] * 60)] + [(500, None, "xx", None, None), (501, "", "yy", None, None), (502, "12 . !", None, None, None), (503, "KALOMI", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(langid.sample_labelled(docs.where("doc_id % 4 <> 2")))
    got = {r["doc_id"]: r for r in langid.identify_languages(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _, _ in rows[:120])
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503)] == ["und", "und", "und", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[500]["score"] == 0.0
    nothing = langid.identify_languages(docs, langid.fit({})).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.identify_languages(spark.createDataFrame([], DOCS), model).collect() == []


def test_language_sample_is_whole_for_many_copies(spark):
    texts = [(f"kalomi {i}", "xx") for i in range(20)] * 500 + [(f"thring {i % 300}", "yy") for i in range(3000)] + [("once", "zz"), (None, "xx"), ("none", None)]
    labelled = spark.createDataFrame(texts, "text string, lang string")
    hashes = {k: sorted((r["h"], r["text"]) for r in labelled.where(F.col("lang") == k).dropna().distinct().select("text", F.xxhash64(F.lit(9), "text").alias("h")).collect()) for k in ("xx", "yy", "zz")}
    got = langid.sample_labelled(labelled)
    assert got == {k: [t for _, t in v[: langid.SAMPLE_ROWS]] for k, v in hashes.items()}
    assert {k: len(v) for k, v in got.items()} == {"xx": 20, "yy": 64, "zz": 1}
    # Whole texts, as many as the characters allow; a longer one only where there is no other.
    long = spark.createDataFrame([("a" * 900, "xx"), ("b" * 40, "xx"), ("c" * 50, "xx"), ("d" * 60, "xx"), ("e" * 700, "yy"), ("f" * 600, "yy")], "text string, lang string")
    some = langid.sample_labelled(long, chars=100)
    assert some["yy"] == ["f" * 600] and "a" * 900 not in some["xx"] and 0 < sum(map(len, some["xx"])) <= 100


@pytest.fixture(scope="module")
def encoder():
    with open(queries.token_vocabulary(), encoding="utf-8") as f:
        return tokens.Encoder(f.read())


def test_encoder_gives_the_tokenizers_ids(encoder, monkeypatch):
    rng = random.Random(1)
    parts = ["a", "B", "é", "1", " ", "  ", "\n", ".", ",", "'s", "\t", "\n\n", "don't", "<|endoftext|>", "日", "_", "x.y", "?!", "Foo.\nBar", " \n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(800)]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, np.uint16).tolist() for x in encoder.encode_all(texts)] == want
    monkeypatch.setattr(encoder, "most", 8)  # far fewer words than the texts have
    for _ in range(2):
        assert [np.frombuffer(x, np.uint16).tolist() for at in range(0, 800, 50) for x in encoder.encode_all(texts[at : at + 50])] == want
        assert len(encoder.older) < 400
    monkeypatch.setattr(tokens, "SEGMENT_CHARS", 3)
    assert [np.frombuffer(b"".join(encoder.encode(t)), np.uint16).tolist() for t in texts] == want


def test_encoder_shares_the_parts_of_words():
    with open(queries.token_vocabulary(), encoding="utf-8") as f:
        enc = tokens.Encoder(f.read())
    rng = random.Random(2)
    marks = ["", ",", ".", "?!", "$$$", "'", "'s", "-", "\n", ".\n", "'\n", "\n\n", "\n.", "\t", "1", "_", "\u00b2", "\u0301", "\u00a0", "\u4e00", "\u00d7"]
    texts = [" ".join("".join(rng.choice(["Foo", "barlo", "\u00e9t\u00e9", "s", "t", ""]) + rng.choice(marks) for _ in range(rng.randint(1, 3))) for _ in range(30)) for _ in range(300)]
    for at in range(0, 300, 100):
        some = texts[at : at + 100]
        assert [np.frombuffer(x, np.uint16).tolist() for x in enc.encode_all(some)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    sent, whole = [], enc._spaced
    enc._spaced = lambda new: sent.extend(new) or whole(new)
    said = "x " + " ".join(f"kalomi{m}" for m in (",", ".", "!!", ".\nkalomi", ".\nkalomi,", "\nkalomi"))
    for _ in range(2):
        assert np.frombuffer(enc.encode_all([said])[0], np.uint16).tolist() == enc.tokenizer.encode(said, add_special_tokens=False).ids
    assert sent == ["kalomi"]  # six words, one of them new to the tokenizer
    enc.tokenizer.add_tokens(["kalomi:"])
    other = tokens.Encoder(enc.tokenizer.to_str())
    assert enc.parts and not other.parts
    assert np.frombuffer(other.encode_all(["a kalomi: b"])[0], np.uint16).tolist() == other.tokenizer.encode("a kalomi: b", add_special_tokens=False).ids


def test_perfect_hash_is_minimal_and_refuses_foreign_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000)).astype(np.uint64)
    mph = tokens.PerfectHash.build(keys)
    assert sorted(mph.lookup(keys)) == list(range(len(keys)))
    index = (mph, {"fingerprint": words.mix(keys)[np.argsort(mph.lookup(keys))]})
    assert (tokens.find(index, keys) >= 0).all() and (tokens.find(index, keys + np.uint64(1)) == -1).mean() > 0.999
    assert tokens.PerfectHash.build(keys[:0]).lookup(keys[:3]).tolist() == [-1, -1, -1]


def test_token_files_round_trip(spark, encoder):
    rows = [(i, t) for i, t in enumerate(random_texts(50, 3))] + [(7, "again"), (7, "again"), (None, "no id"), (99, None), (-5, "")]
    docs = spark.createDataFrame(corpus(rows), DOCS)
    got = tokens.write_and_digest(docs, store.fresh_dir(spark, "t"), queries.token_vocabulary()).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in order:
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.write_and_digest(docs.limit(0), store.fresh_dir(spark, "t"), queries.token_vocabulary()).collect() == []


def test_lattice_sums_over_all_segmentations():
    pieces = [("▁", -1.0), ("▁a", -2.0), ("a", -3.0), ("b", -4.0), ("ab", -5.0), ("▁ab", -6.0)]
    lattice = lm.Lattice(pieces)
    p = {t: lattice.log_p[i] for i, t in enumerate(lattice.texts)}

    def total(text):
        if not text:
            return 1.0
        spelled = np.exp(sum(p[f"<0x{b:02X}>"] for b in text[0].encode()))
        return spelled * total(text[1:]) + sum(np.exp(p[t]) * total(text[len(t) :]) for t, _ in pieces if text.startswith(t))

    said = ["ab", "a", "bbab", "é", "aé日b"]
    got = lattice.log_probabilities(said)
    assert np.allclose(got, [np.log(total("▁" + w)) + lattice.log_end for w in said])
    assert np.isclose(np.exp(lattice.log_p).sum() + np.exp(lattice.log_end), 1)
    counts = lattice.expected(said, np.ones(len(said)))
    length = sum(counts[i] * (len(t) if lm._byte_of(t) is None else 0) for i, t in enumerate(lattice.texts))
    assert length <= sum(len(w) + 1 for w in said) + 1e-9
    before = lattice.log_probabilities(said).sum()
    lattice.set_weights(counts + 1e-9, len(said))
    assert lattice.log_probabilities(said).sum() > before  # expectation-maximisation never lowers it


def test_lattice_has_every_piece_however_long():
    long = "▁characteristics"
    lattice = lm.Lattice([("▁", -1.0), (long, -2.0), ("a", -3.0), ("b" * 30, -4.0)])
    p = {t: lattice.log_p[i] for i, t in enumerate(lattice.texts)}
    spelled = lambda t: sum(p[f"<0x{b:02X}>"] for c in t for b in c.encode())
    got = lattice.log_probabilities([long[1:], "b" * 30])
    assert long in lattice.texts and got[0] >= p[long] + lattice.log_end > spelled("characteristics")
    assert np.isclose(got[1], np.logaddexp(p["▁"], spelled("▁")) + np.logaddexp(p["b" * 30], spelled("b" * 30)) + lattice.log_end)
    vocabulary = lm.read_vocabulary(queries.subword_vocabulary())
    assert set(lm.Lattice(vocabulary).texts) >= {t for t, _ in vocabulary}


def test_piece_weights_are_fitted_to_the_distinct_words(spark):
    vocabulary = [("▁", -1.0), ("▁aa", -2.0), ("▁bb", -2.0), ("a", -3.0), ("b", -3.0)]
    words = spark.createDataFrame([("aa", 90), ("aab", 1), ("bb", 10), ("unseen", 0)], "word string, c long").repartition(3)
    weight, end = lm.fit_weights(words, vocabulary)
    lattice = lm.Lattice(vocabulary)
    for _ in range(lm.EM_ROUNDS):
        want = lattice.expected(["aa", "aab", "bb"], np.ones(3)) + lm.ALPHA
        lattice.set_weights(want, 3.0)
    assert np.allclose(weight, want) and end == 3.0


@pytest.mark.parametrize("grouped", [4096, 2])
def test_lm_score_is_the_sum_over_all_segmentations(spark, monkeypatch, grouped):
    """Against plain recursion over all segmentations: seen and unseen words, pieces over 12 characters, letters in no piece."""
    monkeypatch.setattr(lm, "GROUPED", grouped)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 16)
    rows = [(1, "the characteristics the"), (2, "the Relationship 日x"), (3, "characteristicsé zq zq"), (4, ""), (0, "responsibilities zq the unseen"), (9, "zq")]
    learned = {1, 2, 9}
    vocabulary = lm.read_vocabulary(queries.subword_vocabulary())
    counts = {}
    for i, t in rows:
        for w in WORD.findall(lower(t)) if i in learned else ():
            counts[w] = counts.get(w, 0) + 1
    weights = lm.fit_weights(spark.createDataFrame(list(counts.items()), "word string, c long"), vocabulary)
    lattice = lm.Lattice(vocabulary)
    lattice.set_weights(*weights)
    p = {t: np.exp(x) for t, x in zip(lattice.texts, lattice.log_p, strict=True)}
    assert any(len(t) > 12 and "▁characteristics".startswith(t) for t in p)

    def spelled(text):
        best = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            best[j] = best[j - 1] * math.prod(p[f"<0x{b:02X}>"] for b in text[j - 1].encode()) + sum(best[i] * p[text[i:j]] for i in range(j) if text[i:j] in p)
        return best[-1] * np.exp(lattice.log_end)

    ends, once, twice = len(learned), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    n, d = sum(counts.values()) + ends, min(0.9, once / (once + 2 * twice))
    want = {i: math.log10(ends / n) + sum(math.log10((max(counts.get(w, 0) - d, 0) + d * len(counts) * spelled("▁" + w)) / n) for w in WORD.findall(lower(t))) for i, t in rows}
    got = lm.score_documents(spark.createDataFrame(corpus(rows), DOCS), queries.subword_vocabulary(), F.col("doc_id").isin(*learned)).collect()
    assert {r["doc_id"]: round(r["score"], 8) for r in got} == {i: round(x, 8) for i, x in want.items()}


def test_lm_scores_base_and_folds(spark):
    rows = [(i, t) for i, t in enumerate(random_texts(120, 5))] + [(200, None), (201, ""), (None, "w1 w2"), (5, "w1 unseenword")]
    docs = spark.createDataFrame(corpus(rows), DOCS)
    got = lm.score_documents(docs, queries.subword_vocabulary(), queries.remainder("doc_id", 7) != 2).collect()
    learn = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for _, t in learn:
        for w in [*WORD.findall(lower(t)), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(w), sum(x in counts for x in w), round(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for w in ([*WORD.findall(lower(t)), None] for _, t in rows))
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] <= r["class_score"] + 1e-9 < 0 for r in got)
    nothing = lm.score_documents(docs, queries.subword_vocabulary(), F.lit(False)).collect()
    assert len(nothing) == len(rows) and {r["n_known"] for r in nothing} == {0}
    assert lm.score_documents(docs.limit(0), queries.subword_vocabulary(), F.lit(True)).collect() == []


def test_lm_on_held_out_documents(spark):
    """Over classes of unseen words, as the base has one, the model beats it; as strings, unseen words cost more than a class does."""
    scored = queries.op7_lattice_scores(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("class_score").alias("k")).first()
    assert scored["k"] > scored["b"] and scored["s"] < scored["k"]


def test_long_repetitions_take_bounded_memory_and_mark_the_same(monkeypatch):
    rng = random.Random(31)
    as_words = lambda t: np.array([hash(w) & 0xFFFFFFFF for w in t], np.uint64)
    for case in range(60):
        p = rng.randint(1, 4)
        period = [f"w{rng.randint(0, 2)}" for _ in range(p)]
        item = (period * 20)[: rng.randint(5, 25)] + [f"x{rng.randint(0, 3)}" for _ in range(rng.randint(0, 6))]
        doc = [f"x{rng.randint(0, 3)}" for _ in range(rng.randint(0, 8))] + period * rng.randint(1, 300) + item[-rng.randint(1, 8) :] + period * rng.randint(0, 300)
        found = []
        for most in (1 << 40, 0):
            monkeypatch.setattr(decontaminate, "MOST_MET", most)
            x, words_ = decontaminate.item_of(1, as_words(item), 5), as_words(doc)
            grams = words.rolled(words_, 5, decontaminate._SEED + 10)
            order = np.argsort(grams, kind="stable")
            found.append(decontaminate.judge(x, words_, grams[order], order, 5, 80))
        assert found[0] == found[1], (item, doc[:40])
    monkeypatch.undo()
    large = pa.array(["same " * 1_000_000 + "end"])
    items = decontaminate.items_of([(1, "same " * 100), (2, "ab cd " * 30)], 5)
    index = np.unique(np.concatenate([x.seeds for x in items[:1]])), np.zeros(1, np.int64)
    leaks = decontaminate.leaks_of(large, items, index, 5, 80)
    assert leaks[0][0]["matched_words"] == 100


def test_long_words_are_summed_as_short_ones_are(monkeypatch):
    lattice = lm.Lattice(lm.read_vocabulary(queries.subword_vocabulary()))
    rng = random.Random(8)
    words_ = ["".join(rng.choices("theandingé日x1", k=k)) for k in (1, 3, 40, 40, 200)]
    counts = np.array([1.0, 2.0, 3.0, 1.0, 5.0])
    short = lattice.log_probabilities(words_), lattice.expected(words_, counts)
    monkeypatch.setattr(lm, "LONG_WORD", 0)
    assert np.allclose(lattice.log_probabilities(words_), short[0], rtol=1e-10) and np.allclose(lattice.expected(words_, counts), short[1], rtol=1e-9, atol=1e-12)
    monkeypatch.undo()
    import time

    word, start = "".join(rng.choices("theanding", k=200_000)), time.process_time()
    assert np.isfinite(lattice.log_probabilities([word])[0]) and lattice.expected([word], np.ones(1)).sum() > 40_000
    assert time.process_time() - start < 40
