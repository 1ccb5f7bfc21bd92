"""Chunks of documents and tables. Order within a document is kept in chunk_id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import bound, col, count_contained, count_matches, ratio, spread, stripped_lines, word_count, words
from corvane.operators.dedup import written
from corvane.operators.profile_text import sentences
from corvane.operators.sentences import SentenceModel, trained_sentences

# Phrases of legal notices and of front matter.
LEGAL_PHRASES = ["all rights reserved", "no representations", "warranties of any kind", "fitness for a particular", "applicable software license", "specifically disclaims", "subject to change without notice"]
FRONT_MATTER = ["all rights reserved", "table of contents", "table des matières", "©", "disclaimer:", "trademarks are trademarks", "this publication is provided", "knowledge sharing article"]
CHUNK, CONTEXT, SUMMARY_CHUNK, SUMMARY_WORDS = 500, 200, 2000, 50


def pack(lengths: Column, size: int) -> Column:
    """Where greedy chunks start (0-based) in an array of sentence lengths.

    A chunk ends before a sentence that would take its count over `size`; a sentence counts one more for its space, unless
    it opens a later chunk.
    """
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, n: Column) -> Column:
        opens = (acc["at"] == 0) | (acc["used"] + n > size)
        used = F.when(acc["at"] == 0, n + 1).when(opens, n).otherwise(acc["used"] + n + 1)
        return F.struct((acc["at"] + 1).alias("at"), used.alias("used"), F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"))

    return F.aggregate(lengths, empty, step, lambda acc: acc["starts"])


def _joined(pieces: Column, starts: Column) -> Column:
    """The pieces from each start to the next, joined by a space."""
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(pieces))
    return F.transform(starts, lambda s, i: F.array_join(F.slice(pieces, s + 1, end(i) - s), " "))


def sentence_chunks(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = CHUNK, context: int = CONTEXT, least_words: int = 0, model: SentenceModel | None = None) -> DataFrame:
    """(key, chunk_id, text, prev_context, next_context, char_count, sentence_count): whole sentences packed to about `size` characters.

    Sentences end by rule, or as a trained model says (`sentences.fit_sentences`).
    """
    split = spread(docs, key).select(key, sentences(text_col, least=1).alias("s")) if model is None else trained_sentences(docs.select(key, text_col), model, text_col, "s").select(key, "s")
    packed = split.select(key, F.posexplode(_joined(F.col("s"), pack(F.transform("s", F.length), size))).alias("chunk_id", "text"))
    order = Window.partitionBy(key).orderBy("chunk_id")
    near = lambda c, take: F.coalesce(take(c, F.lit(context)), F.lit("")) if context else F.lit("")
    out = packed.select(key, "chunk_id", "text", near(F.lag("text").over(order), F.right).alias("prev_context"), near(F.lead("text").over(order), F.left).alias("next_context"), F.length("text").alias("char_count"), count_matches("text", r"\.").alias("sentence_count"))
    return out.where(word_count("text") >= least_words) if least_words else out


def summary_chunks(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of about 2000 characters without context, of 50 words or more."""
    return sentence_chunks(docs, key, text_col, SUMMARY_CHUNK, 0, SUMMARY_WORDS)


def fixed_chunks(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 1500, overlap: int = 200) -> DataFrame:
    """(key, chunk_id, start, end, text, overlap_size): chunks that repeat up to `overlap` characters of whole sentences of the one before (one sentence at least, unless that is the whole chunk)."""
    kind = "array<struct<start:int,end:int,overlap_size:int>>"

    def spans(lengths: list[int]) -> list[tuple[int, int, int]]:
        out, start, again = [], 0, 0
        while start < len(lengths):
            end, used = start, 0
            while end < len(lengths) and (end == start or used + lengths[end] <= size):
                used += lengths[end] + 1
                end += 1
            out.append((start, end, again))
            back, again = end, 0
            while back > start and (back == end or again + lengths[back - 1] <= overlap):
                back -= 1
                again += lengths[back] + 1
            start = end if end == len(lengths) else max(back, start + 1)
        return out

    @F.pandas_udf(kind)
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: [{"start": a, "end": b, "overlap_size": c} for a, b, c in spans(list(x))])

    split = docs.select(key, sentences(text_col, least=1).alias("s"))
    placed = split.select(key, "s", F.posexplode(place(F.transform("s", F.length))).alias("chunk_id", "p"))
    return placed.select(key, "chunk_id", "p.start", "p.end", F.array_join(F.slice("s", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")), " ").alias("text"), "p.overlap_size")


def adjacent_distances(sentence_vectors: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, order, distance): 1 - cosine of each vector and the next one of its document."""
    following = F.lead(vector).over(Window.partitionBy(key).orderBy(order))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    pairs = sentence_vectors.select(key, order, F.col(vector).alias("a"), following.alias("b")).where("b IS NOT NULL")
    unit = lambda x: F.when(x == 0, 1.0).otherwise(x)
    return pairs.select(key, order, (1 - dot(F.col("a"), F.col("b")) / (unit(norm(F.col("a"))) * unit(norm(F.col("b"))))).alias("distance"))


def semantic_boundaries(distances: DataFrame, sizes: DataFrame, key: str, order: str, target_chars: int = 1500) -> DataFrame:
    """(key, order, distance, threshold): the sentences behind which a chunk may end.

    sizes: (key, n_sentences, n_chars). The threshold is the linear percentile of a document's distances that leaves about
    as many breaks as chunks of `target_chars`; documents under five sentences have none.
    """
    mean = F.greatest(F.lit(1), F.floor(F.col("n_chars") / F.col("n_sentences")))
    breaks = F.greatest(F.lit(1), F.floor(F.col("n_sentences") / F.greatest(F.lit(3), F.floor(F.lit(target_chars) / mean))))
    share = F.greatest(F.lit(0.5), 1 - breaks / F.greatest(F.lit(1), F.col("n_sentences") - 1))
    long = sizes.where("n_sentences >= 5").select(key, share.alias("share"))
    sorted_ = distances.join(long, key).groupBy(key, "share").agg(F.array_sort(F.collect_list("distance")).alias("d"))
    at = F.col("share") * (F.size("d") - 1)
    low = F.floor(at).cast("int")
    value = F.element_at("d", low + 1) + (at - low) * (F.coalesce(F.get("d", low + 1), F.element_at("d", low + 1)) - F.element_at("d", low + 1))
    return distances.join(sorted_.select(key, value.alias("threshold")), key).where("distance >= threshold").select(key, order, "distance", "threshold")


def boundary_chunks(split: DataFrame, key: str, size: int = 1500) -> DataFrame:
    """(key, chunk_id, text) from (key, s: array of sentences, breaks: array of 0-based starts where a chunk may begin).

    A chunk ends at a break once it has a third of `size`, or before it would outgrow twice of it.
    """
    least, most = max(200, size // 3), max(2 * size, size + 400)
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("met"), F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<int>").alias("starts"))
    # The breaks in order, so that a step looks at the next one only.
    split = split.select(key, "s", F.array_sort(F.array_distinct(F.filter("breaks", lambda b: b >= 0))).alias("breaks"))

    def step(acc: Column, n: Column) -> Column:
        grown = acc["used"] + n + 1
        here = F.coalesce(F.get("breaks", acc["met"]) == acc["at"], F.lit(False))
        may = here | (grown > most)
        opens = (acc["at"] == 0) | acc["full"] | (may & (acc["used"] >= least))
        used = F.when(opens, n).otherwise(grown)
        return F.struct((acc["at"] + 1).alias("at"), (acc["met"] + here.cast("int")).alias("met"), used.alias("used"), (~opens & (grown > most)).alias("full"), F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"))

    starts = F.aggregate(F.transform("s", F.length), empty, step, lambda acc: acc["starts"])
    return split.select(key, F.posexplode(_joined(F.col("s"), starts)).alias("chunk_id", "text"))


def numbered(df: DataFrame, *order: Column | str, name: str = "i") -> DataFrame:
    """`df` with its rows numbered from 0 in this order, without a sort in one task: each range partition numbers its own rows, and gets the count of those before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(ranged, "numbered")
    part = F.shiftright("__at", 33)  # the upper bits are the partition, the lower ones the place in it
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row a partition
    joined = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before", "__at")


def row_chunk_plan(n_rows: Column) -> Column:
    """array<struct<chunk_id,start,end>> over n rows: windows whose size and overlap grow with n."""
    size = F.when(n_rows <= 50, n_rows).when(n_rows <= 200, 50).when(n_rows <= 1000, 100).otherwise(200)
    lap = F.when(n_rows <= 50, 0).when(n_rows <= 200, 5).when(n_rows <= 1000, 10).otherwise(20)
    begins = F.sequence(F.lit(0).cast("bigint"), n_rows - 1, F.greatest(F.lit(1), size - lap).cast("bigint"))
    spans = F.transform(begins, lambda b, i: F.struct(i.alias("chunk_id"), F.when(i > 0, F.greatest(F.lit(0), b - lap)).otherwise(b).cast("bigint").alias("start"), F.least(n_rows, b + size).cast("bigint").alias("end")))
    return F.when(n_rows > 0, spans).otherwise(F.array().cast("array<struct<chunk_id:int,start:bigint,end:bigint>>"))


def row_chunks(rows: DataFrame, index: str) -> DataFrame:
    """The rows of a table (numbered from 0 by `index`) with the chunk_id of every window that holds them.

    A row lies in few windows, which follow from its number, so it is exploded to these and no range join is needed.
    """
    n = rows.count()
    size, lap = (n, 0) if n <= 50 else (50, 5) if n <= 200 else (100, 10) if n <= 1000 else (200, 20)
    step = max(1, size - lap)
    i = F.col(index)
    last = F.floor((i + lap) / step)
    first = F.greatest(F.lit(0), F.floor((i - size) / step) + 1)
    held = F.filter(F.sequence(first, F.least(last, F.lit((n - 1) // step if n else 0))), lambda c: (i < c * step + size) & (i >= F.when(c > 0, c * step - lap).otherwise(0)))
    return rows.select("*", F.explode(F.transform(held, lambda c: c.cast("int"))).alias("chunk_id"))


def table_richness(chunks: DataFrame, columns: list[str], chunk: str = "chunk_id") -> DataFrame:
    """(chunk_id, row_count, richness, min_pairs) of chunks of rows: width, distinct values, length and filled cells."""
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    values = chunks.select(chunk, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(text[c], F.lit("None")).alias("v"), (text[c].isNull() | (F.trim(text[c]) == "")).alias("blank")) for c in columns])).alias("x")).select(chunk, "x.*")
    per_value = values.groupBy(chunk, "c", "v").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blank").cast("int")).alias("blank"))
    per_column = per_value.groupBy(chunk, "c").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"), F.sum("blank").alias("blank"))
    sums = per_column.groupBy(chunk).agg(F.avg(F.col("distinct") / F.col("rows")).alias("diversity"), F.max("rows").alias("row_count"), (F.sum("blank") / F.sum("rows")).alias("empty"))
    richness = 0.3 * min(1.0, len(columns) / 8) + 0.3 * F.col("diversity") + 0.2 * F.least(F.lit(1.0), F.col("row_count") / 100) + 0.2 * (1 - F.col("empty"))
    return sums.select(chunk, "row_count", richness.alias("richness"), F.when(richness < 0.05, 1).otherwise(F.greatest(F.lit(3), F.floor(8 * richness))).cast("int").alias("min_pairs"))


def text_richness(c: Column | str) -> Column:
    """Length, sentences, distinct words and paragraphs of a text, each as a share of a full one; 0 for empty text."""
    c = F.coalesce(col(c), F.lit(""))
    lower = words(F.lower(c))
    filled = lambda pattern: F.size(F.filter(F.split(c, pattern), lambda p: F.trim(F.regexp_replace(p, r"\s", " ")) != ""))
    score = F.least(F.lit(1.0), F.length(c) / 3000) * 0.25 + F.least(F.lit(1.0), filled(r"\.") / 50) * 0.25 + ratio(F.size(F.array_distinct(lower)), F.size(lower)) * 0.2 + F.least(F.lit(1.0), filled("\n\n") / 10) * 0.15
    return F.when(c == "", 0.0).otherwise(score)


def boilerplate_rule(c: Column | str) -> Column:
    """Which rule makes a chunk boilerplate (empty, contents, references, legal, cover, headings, links, signs), or null."""
    c = F.coalesce(col(c), F.lit(""))
    return bound(F.struct(c.alias("c"), word_count(c).alias("n"), stripped_lines(c).alias("rows")), lambda x: _rule(x["c"], x["n"], x["rows"]))


def _rule(c: Column, n: Column, rows: Column) -> Column:
    short = F.size(F.filter(rows, lambda x: word_count(x) < 6))
    capital = lambda w: (F.upper(F.left(w, F.lit(1))) == F.left(w, F.lit(1))) & (F.lower(F.left(w, F.lit(1))) != F.left(w, F.lit(1)))
    capitals = F.size(F.filter(words(c), capital))
    return (
        F.when(c == "", "empty")
        .when((count_matches(c, r"\.{4,}\s*\d+") >= 4) & (n < 300), "contents")
        .when(count_matches(c, "(?m)^\\s*[-•]?\\s*\\d+\\.\\s+[\"'“]?[A-Z]") >= 3, "references")
        .when(count_contained(c, LEGAL_PHRASES) >= 2, "legal")
        .when((F.size(rows) > 0) & (ratio(short, F.size(rows)) > 0.60) & (n < 150), "cover")
        .when((n < 60) & (ratio(capitals, F.greatest(n, F.lit(1))) > 0.45), "headings")
        .when((count_matches(c, r"\b\d{1,2}\.\s+[A-Z][^.\n]{0,80}(?:https?://|www\.)") >= 4) & (n < 500), "links")
        .when((count_contained(c, FRONT_MATTER) >= 3) & (n < 250), "signs")
    )
