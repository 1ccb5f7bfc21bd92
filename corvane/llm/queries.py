"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, chat, decontaminate, html, langid, lm, mixing, neardup, spelling, store, substring, tokens, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, of: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = chat.canonical_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    said = "</s>[INST] ok [/INST]"
    record = F.to_json(F.struct(F.array(*[F.struct(F.lit(who).alias("from"), F.lit(said).alias("value")) for who in ("human", "gpt")]).alias("conversations")))
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), record.alias("record"))
    done = chat.format_turns(typed.unionByName(chat.canonical_turns_of_json(extra, "conv_id", "record").drop("layout")))
    back = done.withColumn("turns", chat.parse_formatted(F.col("formatted")))
    digest = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_replicate(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), k=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def token_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.write_and_digest(docs, store.fresh_dir(spark, "tokens"), token_vocabulary())


def subword_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(table(spark, sf_dir, "documents"), subword_vocabulary(), remainder("doc_id", 7) != 2)
    return scored.withColumn("held_out", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample_labelled(docs.where(remainder("doc_id", 4) != 2)))
    found = langid.identify_languages(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"), least=7)
    return spelling.spelling_variants(spelling.word_counts(spelling.with_slips(runs, every=31), least=7, occurrences=2), times=10)


def groups_digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align_documents(table(spark, sf_dir, "documents"), token_vocabulary(), subword_vocabulary(), groups_as=groups_digest)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), chosen=remainder("doc_id", 3) != 1)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_extract_html": op2_extract_html,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_output": op6_token_output,
    "op7_lattice_scores": op7_lattice_scores,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_language_id": op9_language_id,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    # A CRC is the exclusive or of what each byte gives by its distance from the end; words meet on what is left without one code point.
    "op11_spelling_variants": r"""
        WITH RECURSIVE runs AS (
            SELECT key, len, run, count(*) AS times FROM (
                SELECT doc_id::VARCHAR || ':' || run AS key, length(run) AS len, run FROM (
                    SELECT coalesce(doc_id::VARCHAR, 'null') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
                )
            ) GROUP BY ALL
        ), steps AS (
            SELECT b, b AS v, 0 AS i FROM range(256) t(b)
            UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8
        ), once AS (
            SELECT b, v FROM steps WHERE i = 8
        ), far AS (
            SELECT b, v, 0 AS d FROM once
            UNION ALL SELECT f.b, xor(f.v >> 8, o.v), f.d + 1 FROM far f JOIN once o ON o.b = f.v & 255 WHERE f.d < (SELECT max(strlen(key)) FROM runs)
        ), bytes AS (
            SELECT key, strlen(key) AS n, unnest(range(1, strlen(key) + 1)) AS i, hex(encode(key)) AS h FROM (SELECT DISTINCT key FROM runs)
        ), hashes AS (
            SELECT key, xor(bit_xor(f.v), 4294967295) AS h
            FROM (SELECT key, n - i AS d, xor(('0x' || substr(h, (2 * i - 1)::BIGINT, 2))::BIGINT, CASE WHEN i <= 4 THEN 255 ELSE 0 END) AS b FROM bytes) x JOIN far f USING (d, b)
            GROUP BY key
        ), words AS (
            SELECT word, sum(times)::BIGINT AS n FROM (
                SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len)::BIGINT) || substr(run, (h % len)::BIGINT + 2) ELSE run END AS word FROM runs JOIN hashes USING (key)
            ) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
        ), cuts AS (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
            UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
        ), best AS (
            SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word
        ), formed AS (
            SELECT w.word, CASE WHEN form_n >= 10 * w.n THEN form END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word
        ), walk AS (
            SELECT word, word AS root FROM formed
            UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL
        ), ends AS (
            SELECT k.word, k.root FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NULL
        )
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word""",
    "op10_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) / (q.norm * c.norm) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 5""",
    "op8_near_duplicates": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
        ), grams AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
        ), frequency AS (
            SELECT g, count(*) AS f FROM grams GROUP BY g
        ), ranked AS (
            SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS r FROM grams JOIN frequency USING (g)
        ), prefix AS (
            SELECT doc_id, n, g FROM ranked WHERE r <= n - ceil(0.8 * n) + 1
        ), candidates AS (
            SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        ), links AS (
            SELECT c.a, c.b FROM candidates c JOIN sets x ON x.doc_id = c.a JOIN sets y ON y.doc_id = c.b
            WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
        ), edges AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT a AS doc_id, a AS other FROM edges
            UNION
            SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
        ), smallest AS (
            SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(m.component_id, s.doc_id) = s.doc_id AS kept
        FROM sets s LEFT JOIN smallest m ON m.doc_id = s.doc_id""",
    "op1_chat_format": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, length(role) + length(text) + 17 + (
                SELECT sum((length(role) - length(replace(role, c, '')) + length(text) - length(replace(text, c, ''))) // length(c))
                FROM (VALUES ('<|'), ('<s>'), ('</s>'), ('[INST]'), ('[/INST]'), ('<<SYS>>'), ('<</SYS>>'), ('<bos>'), ('<eos>'), ('<start_of_turn>'), ('<end_of_turn>')) v(c)
            ) * 2 + length(role) - length(replace(role, chr(10), '')) + length(role) - length(replace(role, chr(92), '')) + length(text) - length(replace(text, chr(92), '')) AS shown
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(shown)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op4_mix_sources": """
        WITH RECURSIVE sizes AS (
            SELECT source, count(*) AS n FROM documents GROUP BY source
        ), rates AS (
            SELECT source, (SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM sizes) / n AS rate FROM sizes
        ), pmf AS (
            SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 200) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)
        ), cdf AS (
            SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
        ), drawn AS (
            SELECT doc_id, source, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents
        ), times AS (
            SELECT doc_id, count(*) AS n FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u GROUP BY doc_id
        )
        SELECT d.*, c.copy::INT AS copy, ('0x' || substr(md5('mix:place:' || d.doc_id || ':' || c.copy), 1, 15))::BIGINT AS place
        FROM documents d JOIN times t ON d.doc_id = t.doc_id, unnest(range(0, t.n)) c(copy)""",
}
