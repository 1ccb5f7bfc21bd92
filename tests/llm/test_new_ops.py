"""Spelling variants, tokenizer alignment and toxicity against brute force, on small tables with nulls, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import align, queries, spelling, toxicity

DOCS = "doc_id long, text string, lang string, word string, n double"
SF = "/root/testdata/sf0.001"


def shown(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def against_sql(spark, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    assert shown(queries.QUERIES[name](spark, SF).select(*want.columns).collect()) == shown(want.fetchall())


def edits(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variants_by_hand(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if edits(w, x)] for w in words}
    form = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: x if words[x] >= 10 * words[w] else None for w, x in form.items()}
    out = []
    for w, n in words.items():
        root = w
        while form.get(root):
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if form.get(w) else None))
    return out


def misspelt(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeéÉxÿ", k=rng.randint(6, 12))) for _ in range(12)]
    words = []
    for s in stems:
        words += [s] * rng.choice([1, 2, 30, 400])
        for _ in range(6):
            i, c = rng.randrange(len(s)), rng.choice("abcdeéÉxÿ")
            v = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
            words += [v] * rng.choice([1, 2, 3, 40])
    rng.shuffle(words)
    rows = [(rng.choice([None, 3, i]), rng.choice([" ", "\n", "-", "1"]).join(w.capitalize() if rng.random() < 0.2 else w for w in words[i : i + 20])) for i in range(0, len(words), 20)]
    return [*rows, (9, None), (10, ""), (11, "a b"), *rows[:3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants_are_those_of_brute_force(spark, seed):
    rows = misspelt(seed)
    docs = spark.createDataFrame([(i, t, "en", "mine", 0.5) for i, t in rows], DOCS)
    found = spelling.spelling_variants(spelling.word_counts(spelling.with_slips(spelling.letter_runs(docs, 7))))
    want = variants_by_hand(rows)
    assert sum(f is not None for _, f, *_ in want) > 3
    assert shown(found.select("word", "form", "root", "n", "n_near", "form_n").collect()) == shown(want)


def test_chains_of_forms_are_followed_to_the_end_and_ties_go_to_the_smaller_word(spark):
    words = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20000), ("baaaaab", 20), ("zzzzzzz", 5), ("aaaaaaaa", 19)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.spelling_variants(words).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaabbbb", 2, 20)
    assert got["aaaabbb"] == ("aaabbbb", "aaabbbb", 2, 20000)
    assert got["zzzzzzz"] == (None, "zzzzzzz", 0, None)
    ties = spark.createDataFrame([("aaaaaaa", 2), ("aaaaaac", 20), ("aaaaaab", 20)], "word string, n long")
    assert {r.word: r.form for r in spelling.spelling_variants(ties).collect()}["aaaaaaa"] == "aaaaaab"
    assert spelling.spelling_variants(ties.where("false")).count() == 0


def test_spelling_query_is_its_sql(spark):
    against_sql(spark, "op11_spelling_variants", ["documents"])


def test_unchanged_parts_cover_every_edit(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(150)}
    got = spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).select("word", "near")
    assert shown(got.collect()) == shown((a, b) for a in words for b in words if edits(a, b))
    assert got.where(F.col("word") == F.col("near")).isEmpty()


def aligned_by_hand(rows):
    """Token bytes and overlaps of each text by themselves, from the tokenizers' own outputs."""
    pair = align.Pair(queries.token_vocabulary(), queries.subword_vocabulary())
    groups, links = [], []
    for _, text in rows:
        whole = (" " + text).encode() if text else b""
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        if not whole or b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
            groups.append(([], [], []))
            links.append(Counter())
            continue
        spans = []
        for ids, spelt in ((a, pair.a_bytes), (b, pair.b_bytes)):
            ends = np.cumsum([len(spelt[i]) for i in ids]).tolist()
            spans.append([(s, e, i) for s, e, i in zip([0, *ends], ends, ids, strict=False)])
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        shown = [tuple([i for s, e, i in side if lo <= s and e <= hi] for side in spans) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        groups.append((a, b, shown))
        links.append(Counter((x, y) for (s, e, x), (t, f, y) in product(*spans) if s < f and t < e))
    docs = Counter(p for each in links for p in each)
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc, _), (a, b, shown), each in zip(rows, groups, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in shown)
        out.append((doc, len(a), len(b), len(shown), sum(each.values()), sum(n for p, n in each.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in each.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


ODD_TEXTS = [
    None, "", " ", "  two  spaces ", "line\n\n  indented\ttab\r\nend \n", "<|endoftext|> and </s> <unk> <s>", "\u2581 lower block", "naïve café ﬁ \u00a0nbsp\u2003em 日本語 🙂🙂", "a\x00b", "x" * 300, "don't we'll  I'M 12345 3.14",
    "\u001c sep\u0085next  \u3000wide", "ends with space ", "\nstarts", "ß ẞ É", "same words same words", "same words same words",
]


def test_alignment_is_that_of_whole_texts(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [*enumerate([*ODD_TEXTS, *[t[:1500] for t in texts]]), (None, "same words again"), (3, "same words same words")]
    docs = spark.createDataFrame([(i, t, "en", "w", 0.5) for i, t in rows], DOCS)
    found = align.align_documents(docs, queries.token_vocabulary(), queries.subword_vocabulary(), groups_as=queries.groups_digest)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = aligned_by_hand(rows)
    assert sum(1 for r in want if r[1] == 0) >= 3
    assert shown(found.collect()) == shown(want)
    assert align.align_documents(docs.where("false"), queries.token_vocabulary(), queries.subword_vocabulary()).count() == 0


def test_blocks_of_any_size_align_alike(spark, monkeypatch):
    pair = align.Pair(queries.token_vocabulary(), queries.subword_vocabulary())
    texts = [t for t in ODD_TEXTS if t] * 2
    whole, pairs, docs = align.aligned_block(duckdb.connect(), pair, texts)
    each = [align.aligned_block(duckdb.connect(), pair, [t])[0][0] for t in texts]
    for x, y in zip(whole, each, strict=True):
        assert all(list(x[c]) == list(y[c]) if c in ("pairs", "times") else x[c] == y[c] for c in x)
    assert dict(zip(pairs.tolist(), docs.tolist(), strict=True)) == Counter(p for x in each for p in x["pairs"].tolist())


def test_pieces_of_other_blocks_are_not_encoded_again(monkeypatch):
    pair = align.Pair(queries.token_vocabulary(), queries.subword_vocabulary())
    keys = ["kalomi", "kalomi,", "kalomi.", "kalomi!!", "don't", "\u65e5\u672c", "<|endoftext|>", "", "a\u2003b", "two  spaces"]
    a, b, whole = pair.encode(keys, 7)
    assert [x.tolist() for x in np.split(a.ids, a.ends[1:-1])] == [pair.a.encode(" " + k, add_special_tokens=False).ids for k in keys]
    assert [x.tolist() for x in np.split(b.ids, b.ends[1:-1])] == [pair.b.encode(k) if k else pair.space for k in keys]
    assert whole.tolist() == [b"".join(pair.b_bytes[i] for i in pair.b.encode(k)) == (" " + k).encode() if k else True for k in keys]
    sent, spaced = [], pair.coder._spaced
    monkeypatch.setattr(pair.coder, "_spaced", lambda new: sent.extend(new) or spaced(new))
    pair.encode(["kalomi;", "kalomi", "thring", "thring."], 4)
    assert sent == ["thring"]  # of four pieces, two of them new, one is new to the tokenizer


def test_restored_text_is_the_most_probable_path():
    rng = np.random.RandomState(3)
    model = toxicity.language_model(rng.randint(0, 4, toxicity.SYMBOLS**toxicity.ORDER))
    assert np.allclose(np.exp(model).reshape(-1, toxicity.SYMBOLS).sum(1), 1, atol=1e-4)
    for token, spaced in (("1d10t", False), ("a.b-c", False), ("m o o n", True), ("$tuup1d", False), ("aaabbc0", False)):
        ways = toxicity.lattice(token, spaced)
        scores = {}
        for path in product(*ways):
            text, state = "".join(t for t, _ in path), 0
            p = sum(c for _, c in path)
            for c in text + " ":
                gram = state * toxicity.SYMBOLS + toxicity._symbol(c)
                p, state = p + model[gram], gram % toxicity.SYMBOLS ** (toxicity.ORDER - 1)
            scores[text] = max(scores.get(text, -1e9), p)
        assert scores[toxicity.viterbi(ways, model.tolist()).removesuffix(" ")] == pytest.approx(max(scores.values()))


INSULTS = "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split()


def disguised(word, kind):
    return {"plain": word, "leet": word.translate(str.maketrans("ioseat", "10534@"))[:-1] + word[-1], "spaced": " ".join(word), "dotted": ".".join(word), "again": "".join(c * (3 if c in "aeiou" else 1) for c in word)}[kind]


def test_planted_toxic_texts_are_caught_behind_each_disguise_and_clean_ones_left(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chosen = queries.remainder("doc_id", 3) != 1
    model = toxicity.fit_language_model(docs)
    classifier = toxicity.fit_classifier(toxicity.labelled_words(docs, labels, model, chosen))
    held = docs.join(labels, "doc_id").where(~chosen & F.col("text").isNotNull()).select("doc_id", "text", "toxic").collect()
    clean = [r for r in held if not r.toxic]
    rows = [(i, r.text, 0, "") for i, r in enumerate(clean)]
    for kind in ("plain", "leet", "spaced", "dotted", "again"):
        for i, r in enumerate(clean[:60]):
            words = r.text.split(" ")
            for k in range(3):
                words.insert(len(words) * k // 3, disguised(INSULTS[(i + k) % 10], kind))
            rows.append((i, " ".join(words), 1, kind))
    scored = toxicity.score_texts(spark.createDataFrame(rows, "doc_id long, text string, want int, kind string"), model, classifier)
    got = {r.kind: r.share for r in scored.groupBy("kind").agg(F.avg("predicted").alias("share")).collect()}
    assert got.pop("") <= 0.02
    assert all(share >= 0.9 for share in got.values()), got


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None, "a", "b", 1.0), (None, "", "a", "b", 1.0), (2, "stupid", "a", "b", 1.0), (2, "stupid", "a", "b", 1.0), (3, "\u200b \x00 %%% 1 2 3 4", None, None, None), (4, "s" * 5000 + " " + "1!" * 3000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, predicted string, score double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (4, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.words in ("a", None) for r in found)
    none = toxicity.score_toxicity(docs, labels.where("false"), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_toxicity(docs.where("false"), labels, F.lit(True)).count() == 0
