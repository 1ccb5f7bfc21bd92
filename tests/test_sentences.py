"""The sentence splitter that learns: counts and decisions against plain definitions, and generated texts with known ends."""

import math
import random
import re
from collections import Counter

import pytest

from corvane.operators import chunk, sentences

NAMES = "Smith Jones Miller Brown Taylor Wilson Young Clark".split()
DID = ["went home early", "spoke to the council", "read the long report", "closed the old shop", "paid for the boats", "met the others"]


def sentence(rng):
    title, name, did = rng.choice(["Dr.", "Mr.", "Prof.", "Mrs."]), rng.choice(NAMES), rng.choice(DID)
    return rng.choice([
        f"{title} {name} {did}.", f"The man {did} with {title} {name}.", f"However, the company {did}.", f"They lived, e.g. in spring, at No. {rng.randint(1, 9)} and {did}.",
        f"J. {name} {did}.", f"On the 3. of May they {did}.", "It rained!", "Was it late?", f"All of them, with the others, {did}.", f'"She {did}." That was all.', f"The price was 3.5 pounds, approx. the same as the boats.",
    ])


def corpus(n, seed):
    rng = random.Random(seed)
    return [[x for _ in range(12) for x in re.split(r"(?<=\.\") ", sentence(rng))] for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(x)) for i, x in enumerate(corpus(250, 1))]
    return sentences.fit_sentences(spark.createDataFrame([*rows, (-1, None), (-2, "")], "doc_id long, text string"))


def test_abbreviations_are_learned(model):
    assert {"dr", "mr", "prof", "mrs", "e.g", "approx"} <= model.abbreviations
    assert not model.abbreviations & {"shop", "home", "council", "early", "others", "boats", "report"}
    assert "however" in model.starters


def test_ends_of_generated_texts(model):
    right = wrong = missed = by_rule = 0
    for parts in corpus(120, 2):
        text = " ".join(parts)
        ends = lambda pieces: {sum(len(p) + 1 for p in pieces[: k + 1]) for k in range(len(pieces) - 1)}
        want, got, plain = ends(parts), ends(sentences.split(text, model)), ends(re.split(r"(?<=[.!?])\s+", text))
        right, wrong, missed, by_rule = right + len(want & got), wrong + len(got - want), missed + len(want - got), by_rule + len(plain - want)
    assert wrong + missed < 0.02 * right and by_rule > 0.3 * right


def test_decisions(model):
    cut = lambda t: sentences.split(t, model)
    assert cut("We saw Dr. Smith. He waved.") == ["We saw Dr. Smith.", "He waved."]
    assert cut("Some, e.g. the cat, slept. However, all ate.") == ["Some, e.g. the cat, slept.", "However, all ate."]
    assert cut("J. Brown left! Why? No.") == ["J. Brown left!", "Why?", "No."]
    assert cut("It cost 3.5 pounds... and more. (Really.) Yes.") == ["It cost 3.5 pounds... and more.", "(Really.)", "Yes."]
    assert cut(None) == cut("") == cut("  ") == [] and cut("no end") == ["no end"]
    assert sentences.split("Dr. Smith left. He ran.") == ["Dr.", "Smith left.", "He ran."]


def test_counts_and_scores_are_the_definitions(spark):
    texts = [" ".join(x) for x in corpus(30, 5)]
    pairs = sentences.token_pairs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    n, stops, small = Counter(), Counter(), Counter()
    for t in texts:
        w = [x for x in (re.sub(r"^[^\w.]+|[^\w.]+$", "", x) for x in t.split()) if re.search(r"\w", x)]
        for x, y in zip(w, [*w[1:], None], strict=True):
            k = x.rstrip(".").lower()
            n[k] += 1
            stops[k] += x.endswith(".")
            small[k] += x.endswith(".") and y is not None and not y[0].isupper()
    found = sentences.word_stops(pairs)
    assert {r.word: (r.n, r.stops, r.before_small) for r in found.collect()} == {k: (n[k], stops[k], small[k]) for k in n}
    share = sum(stops.values()) / sum(n.values())
    want = {}
    for k in n:
        like = lambda p, k=k: stops[k] * math.log(p) + (n[k] - stops[k]) * math.log(1 - p)
        letters = len(k.replace(".", ""))
        score = 2 * (like(0.99) - like(share)) * math.exp(-letters) * (k.count(".") + 1) * letters ** -(n[k] - stops[k]) * (1 + small[k])
        if stops[k] and score >= 0.3 and re.search("[a-z]", k):
            want[k] = pytest.approx(score, abs=1e-5)
    assert {r.word: r.score for r in sentences.abbreviations(found).collect()} == want and want


def test_chunks_by_a_trained_model(spark, model):
    docs = spark.createDataFrame([(1, "We saw Dr. Smith. He waved. " * 30), (2, None), (3, "")], "doc_id long, text string")
    by_rule, trained = (chunk.sentence_chunks(docs, size=20, context=0, model=m) for m in (None, model))
    assert trained.where("text LIKE '%Dr.'").isEmpty() and not by_rule.where("text LIKE '%Dr.'").isEmpty()
    assert {r.doc_id for r in trained.collect()} == {1}


def test_nothing_is_learned_from_nothing(spark):
    assert sentences.fit_sentences(spark.createDataFrame([], "doc_id long, text string")) == sentences.NOTHING_LEARNED
