"""Rules over question-answer pairs, as column expressions.

Null questions and answers count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import col, literal_set, ratio, word_count, word_tokens, ws_strip

# Answers that say nothing, stop words, question patterns about a document and not its subject, words that
# are no claim.
VAGUE_ANSWERS = ["oui", "non", "peut-être", "je ne sais pas", "ça dépend", "yes", "no", "maybe", "i don't know", "it depends", "not mentioned", "the text does not specify", "le texte ne précise pas"]
STOP_WORDS = "le la les de du des un une et en est sont que qui ce il elle ils elles the a an is are was were of in on at to for with this that it its".split()
DOCUMENT_REFERENCE = [
    r"in the (rapport|document|text|chunk|passage|source|context)",
    r"according to (the )?(rapport|document|text|source)",
    r"the (rapport|document|text) (says|states|mentions|explains|describes)",
    r"dans (le |la )?(rapport|document|texte|source)",
    r"selon (le |la )?(rapport|document|texte)",
]
METADATA_QUESTIONS = [
    r"\btitle of (the |this )?(document|article|paper|pdf|text|book|whitepaper|report)\b",
    r"\btitre (du|de la|de ce|de cet) (document|article|rapport|texte|livre)\b",
    r"\bwho (is|are) (identified as|listed as|credited|the author|the authors)\b",
    r"\bwho wrote\b",
    r"\bwho authored\b",
    r"\bqui (a écrit|a rédigé|est l'auteur|sont les auteurs)\b",
    r"\b(what|which) (page|section|chapter) (number )?(is|comes|appears|shows)",
    r"\bpage (number|numéro)\b",
    r"\bnuméro de page\b",
    r"\btable of contents\b",
    r"\btable des matières\b",
    r"\b(copyright|©|all rights reserved)\b",
    r"\bwhat (year|date) (of )?(copyright|publication|publish)",
    r"\bwhat (organization|company|publisher|firm) (is associated|published|produced)",
    r"\bwhat (job|position|role|title) (does|do) \w+ (hold|have|occupy)",
    r"\bquel (poste|rôle|titre) (occupe|a)\b",
    r"\b(affiliation|university|employer) of\b",
    r"\bphrase\b.*\b(appears|shows|is mentioned)\b",
    r"\baccording to the (text|document|author|article|passage|paper)\b",
    r"\b(selon|d'après) (le texte|le document|l'auteur|l'article)\b",
    r"\bwhat does the (text|document|article|passage) (say|state|describe|explain|mention)\b",
    r"\bque (dit|précise|mentionne|explique) le (texte|document|paragraphe|passage)\b",
    r"\bwhich section (comes|appears|is|follows)\b",
    r"\bimmediately (after|before) [\"']",
    r"\blast visible topic\b",
    r"\btopic (comes|visible) (immediately )?(after|before|in the)",
    r"\bfinal topic\b",
    r"\bheader\b",
    r"\bwebsite (mentioned|listed|referenced|shown|is listed|for learning)\b",
    r"\bcertification (path|program|levels?) (validate|offer|include|mentioned|are listed)\b",
    r"\bwhat (academic|professional) affiliation is listed\b",
    r"\bwhat job (title|role) (and company )?(are|is) associated\b",
    r"\bwhich certification levels? (are )?(mentioned|listed)\b",
    r"\bwhat year (is )?(referenced|associated|mentioned) in (the|this) (document|text)\b",
    r"\bwhat heading introduces\b",
    r"\bwho is (the )?intended audience\b",
    r"\bwhat phrase is used to describe\b",
    r"\baccording to the (abstract|timeline|figure)\b",
    r"\bwhat does the (abstract|timeline|figure) (show|state|indicate|describe)\b",
]
NO_CLAIM = (
    "approach approaches practice practices process processes system systems method methods concept concepts example examples team teams "
    "user users solution solutions result results value values benefit benefits feature features overall various different several "
    "including typically generally usually often cela cette ceux celui celle celles ces cet parce pourquoi comment quand ainsi alors donc "
    "mais car puis aussi cependant néanmoins toutefois pourtant selon après avant pendant depuis malgré comme lors lorsque tandis voici "
    "voilà ici nous vous ils elles leur leurs elle quelques plusieurs tous tout toute toutes tel telle tels telles dans pour sur sous par "
    "sans vers avec entre chez hors this that these those because therefore thus however moreover furthermore while when where why "
    "although despite indeed instead also there here they their them such some many most each every"
).split()
CLAIM_PATTERNS = [r"\b\d{3,}(?:[.,]\d+)?%?\b", r"\b[A-Z]{2,}[A-Z0-9]*\b", r"\b[A-Za-z]+[A-Z][A-Za-z]+\b", r"\b[A-Z][a-z]+-[A-Za-z]+\b"]
LEAST_ANSWER_WORDS, NEW_SHARE, KEEP_SCORE, REFINE_SCORE = 10, 0.20, 0.62, 0.35


def _text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def shape_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with answers of ten words or more; a confidence outside [0, 1], or none, is 0.5."""
    c = F.col("confidence")
    return pairs.where(word_count(_text("answer")) >= LEAST_ANSWER_WORDS).withColumn("confidence", F.when(c.between(0, 1), c).otherwise(0.5))


def signature_words(c: Column | str) -> Column:
    """Distinct lower-case words of over three characters that are no stop words."""
    return F.filter(F.array_distinct(word_tokens(_text(c))), lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))


def is_vague(answer: Column | str) -> Column:
    s = F.lower(F.regexp_replace(ws_strip(_text(answer)), r"[.!?]+$", ""))
    return (word_count(s) < 5) | s.isin(VAGUE_ANSWERS)


def is_paraphrase(question: Column | str, answer: Column | str) -> Column:
    """The answer has no signature words, or under a fifth of them are new."""
    words = signature_words(answer)
    return (F.size(words) == 0) | (ratio(F.size(F.array_except(words, signature_words(question))), F.size(words)) < NEW_SHARE)


def is_metadata_question(question: Column | str) -> Column:
    return _text(question).rlike("(?iU)" + "|".join(METADATA_QUESTIONS))


def refers_to_document(question: Column | str) -> Column:
    return _text(question).rlike(r"(?iU)\b(" + "|".join(DOCUMENT_REFERENCE) + r")\b")


def filter_reason(question: Column | str = "question", answer: Column | str = "answer") -> Column:
    """Why a pair goes (metadata, vague, paraphrase, document_reference), or null."""
    return F.when(is_metadata_question(question), "metadata").when(is_vague(answer), "vague").when(is_paraphrase(question, answer), "paraphrase").when(refers_to_document(question), "document_reference")


def claims(c: Column | str) -> Column:
    """Distinct lower-case numbers of three digits and more, acronyms, camel-case and hyphenated names."""
    found = [F.regexp_extract_all(_text(c), F.lit("(?U)" + p), F.lit(0)) for p in CLAIM_PATTERNS]
    return F.filter(F.array_distinct(F.transform(F.flatten(F.array(*found)), F.lower)), lambda t: (F.length(t) > 1) & ~t.isin(NO_CLAIM))


def is_ungrounded(answer: Column | str, source: Column | str) -> Column:
    """Three claims or more, over half of which are neither among the source's claims nor in its text."""
    stated, lower = claims(answer), F.lower(_text(source))
    absent = F.filter(F.array_except(stated, claims(source)), lambda t: ~F.contains(lower, t))
    return (F.size(stated) >= 3) & (F.size(absent) / F.greatest(F.size(stated), F.lit(1)) > 0.5)


def drop_ungrounded(pairs: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """pairs (…, key, answer) whose answers are grounded in sources (key, text); pairs without a source stay."""
    joined = pairs.join(sources.select(key, F.col("text").alias("__source")), key, "left")
    return joined.where(F.col("__source").isNull() | ~is_ungrounded("answer", "__source")).drop("__source")


def parse_pairs(reply: Column | str) -> Column:
    """array<struct<question,answer,confidence>> of a model's reply: fences go, the outermost list is read; bare line breaks inside strings and single quotes are mended; else empty."""
    kind = "array<struct<question:string,answer:string,confidence:double>>"
    listed = F.regexp_extract(F.regexp_replace(_text(reply), r"```(?:json)?", ""), r"(?s)\[.*\]", 0)
    flat = F.regexp_replace(listed, r"[\x00-\x1F]+", " ")
    tries = [listed, flat, F.replace(flat, F.lit("'"), F.lit('"'))]
    whole = lambda x: F.from_json(x, kind, {"mode": "PERMISSIVE"})
    usable = lambda a: F.filter(a, lambda p: p.isNotNull() & p["question"].isNotNull() & p["answer"].isNotNull())
    got = [usable(whole(x)) for x in tries]
    return F.coalesce(*[F.when(F.size(g) > 0, g) for g in got], F.array().cast(kind))


@F.pandas_udf(T.StringType())
def last_tool_call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The last balanced {…} of a text that holds the word `tool`; null if there is none."""

    def find(text: str | None) -> str | None:
        best, opened = None, []
        for i, c in enumerate(text or ""):
            if c == "{":
                opened.append(i)
            elif c == "}" and opened:
                start = opened.pop()
                if not opened and "tool" in text[start : i + 1]:
                    best = text[start : i + 1]
        return best

    for s in batches:
        yield s.map(find)


def parse_scores(batches: DataFrame) -> DataFrame:
    """(pair_id, score) from (pair_ids array, reply): the numbers of a reply in order; what is missing or no number is 0.5."""
    listed = F.from_json(F.regexp_extract(_text("reply"), r"(?s)\[.*\]", 0), "array<string>")
    each = batches.select(F.posexplode("pair_ids").alias("i", "pair_id"), listed.alias("scores"))
    return each.select("pair_id", F.coalesce(F.get("scores", "i").try_cast("double"), F.lit(0.5)).alias("score"))


def score_decision(score: Column | str) -> Column:
    """keep, refine or drop; a missing score is 0.5."""
    s = F.coalesce(col(score), F.lit(0.5))
    return F.when(s >= KEEP_SCORE, "keep").when(s >= REFINE_SCORE, "refine").otherwise("drop")


def refinement_accepted(question: Column | str, refined: Column | str, original: Column | str) -> Column:
    """Half of the refined answer's new signature words come from the original, and neither it nor the question is refused by the rules."""
    new = F.array_except(signature_words(refined), signature_words(question))
    known = F.size(F.array_intersect(new, signature_words(original)))
    return (ratio(known, F.size(new)) >= 0.5) & ~is_metadata_question(question) & ~is_vague(refined) & ~is_paraphrase(question, refined)


def apply_scores(pairs: DataFrame, scores: DataFrame, refined: DataFrame | None = None) -> DataFrame:
    """pairs kept after scoring, joined by pair_id; refined: (pair_id, refined) for pairs to refine, whose confidence rises by 0.15."""
    judged = pairs.join(scores, "pair_id", "left").withColumn("decision", score_decision("score"))
    kept = judged.where("decision = 'keep'")
    if refined is None:
        return kept
    fixed = judged.where("decision = 'refine'").join(refined, "pair_id").where(refinement_accepted("question", "refined", "answer"))
    fixed = fixed.withColumn("answer", F.col("refined")).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + 0.15)).withColumn("source_file", F.concat(F.coalesce("source_file", F.lit("")), F.lit("[refined]")))
    return kept.unionByName(fixed.drop("refined"))


def sample_pairs(pairs: DataFrame, k: int, key: str = "pair_id", seed: str = "0") -> DataFrame:
    """k pairs, by md5 of key and seed."""
    return pairs.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(k)


def fill_target(requested: Column, current: Column) -> Column:
    """How many pairs an automatic fill aims at."""
    return F.greatest(requested, F.lit(2000), current + 500)


def fill_quota(batches: DataFrame, needed: int) -> DataFrame:
    """Of generated batches (round, file, n) in order, those that are still needed and how many of each: `take`."""
    from pyspark.sql.window import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("round", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return batches.withColumn("take", F.least(F.col("n"), F.greatest(F.lit(0), F.lit(needed) - before))).where("take > 0")


def triage_pages(pages: DataFrame, relevance: DataFrame | None = None) -> DataFrame:
    """pages (page_num, text) with `verdict`: under 20 words is rejected; else by relevance (page_num, relevant), relevant if unknown."""
    if relevance is None:
        judged = pages.withColumn("relevant", F.lit(True))
    else:
        judged = pages.join(relevance, "page_num", "left").withColumn("relevant", F.coalesce("relevant", F.lit(True)))
    return judged.withColumn("verdict", F.when(word_count(_text("text")) < 20, "too_short").when(F.col("relevant"), "kept").otherwise("irrelevant")).drop("relevant")


def verdict_excerpt(summaries: DataFrame) -> DataFrame:
    """One row: the excerpt on which a domain verdict is asked, from (filename, summary, text): the first three files' summaries, or the text's first 600 characters where a summary has under 20 words, 3000 characters in all."""
    first = summaries.orderBy("filename").limit(3)
    part = F.when(word_count(_text("summary")) < 20, F.left(_text("text"), F.lit(600))).otherwise(F.col("summary"))
    packed = first.agg(F.array_sort(F.collect_list(F.struct("filename", part.alias("p")))).alias("parts"))
    return packed.select(F.left(F.array_join(F.transform("parts", lambda x: x["p"]), "\n\n"), F.lit(3000)).alias("excerpt"))
