"""Registered queries over the driver's tables, one per operator or family, with the SQL that gives the same rows.

The SQL is written from the operators' definitions, not from their plans. Doubles are rounded on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import spread
from corvane.operators import chunk, clean, curves, dedup, export, history, metrics, profile_state, profile_table, profile_text, qa_rules, registry, retrieval, sentences, verdicts
from corvane.plans import prepare
from corvane.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt to all cores if they come in few files: for columns of costly text expressions."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    """Doubles rounded as SQL's round(x, to) does it: the product decides. Spark's own goes by the shortest decimal, which may be a half where the product is less."""
    p = 10.0**to
    return df.withColumns({n: F.round(F.col(n) * p) / p for n in names})


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# Fixed values for SQL: white space as Python and Java see it, and a strip.
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def split_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sentence_list(x: str, least: int) -> str:
    marked = f"regexp_replace({strip(x)}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: length(s) >= {least})"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn behind it, as a question-answer pair."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(order)).withColumn("next_role", F.lead("role").over(order))
    return turns.where("role = 'user' AND next_role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("question"), "answer", F.concat(F.lit("conv"), (F.col("conv_id") % 5).cast("string")).alias("source_file"), ((F.col("conv_id") % 13) / 10.0).cast("double").alias("confidence"))


PAIRS = """pairs AS (
    SELECT conv_id * 1000 + turn AS pair_id, text AS question, answer, 'conv' || (conv_id % 5) AS source_file, ((conv_id % 13) / 10.0)::DOUBLE AS confidence
    FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant'
)"""

# ---------------------------------------------------------------- tables

LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_STRINGS = ["l_returnflag", "l_linestatus"]


def _number_sql(c: str) -> str:
    q = lambda x: f"list_sort(list({c}::DOUBLE))[(floor({x} * (count({c}) - 1) + 0.5))::INT + 1]"
    return f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS unique_count,
        min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, {q(0.25)} AS q25, {q(0.5)} AS q50, {q(0.75)} AS q75,
        (SELECT count(*) FROM lineitem x, (SELECT avg({c}::DOUBLE) m, stddev_samp({c}::DOUBLE) s FROM lineitem) WHERE s > 0 AND abs(x.{c} - m) > 3 * s) AS outlier_count,
        NULL::BIGINT AS sentinel_count, NULL::BOOLEAN AS has_whitespace_issues, NULL::BOOLEAN AS has_case_inconsistency, NULL::DOUBLE AS avg_word_count FROM lineitem"""


def _string_sql(c: str) -> str:
    return f"""SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}) + max(({c} IS NULL)::INT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        count(*) FILTER (lower({strip(c)}) IN ('n/a', 'na', 'null', 'none', 'unknown', '-', '--', '?', 'nan', '')), bool_or({c} <> {strip(c)}), count(DISTINCT {strip(c)}) > count(DISTINCT lower({strip(c)})), round(avg(len(string_split({c}, ' '))), 6) FROM lineitem"""


@query("SELECT * FROM (" + " UNION ALL ".join([_number_sql(c) for c in LINEITEM_NUMBERS] + [_string_sql(c) for c in LINEITEM_STRINGS]) + ")")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_table.column_profile(table(spark, sf_dir, "lineitem").select(*LINEITEM_NUMBERS, *LINEITEM_STRINGS))
    keep = ["column", "row_count", "null_count", "unique_count", "min", "max", "mean", "std", "q25", "q50", "q75", "outlier_count", "sentinel_count", "has_whitespace_issues", "has_case_inconsistency", "avg_word_count"]
    return rounded(rounded(p.select(*keep), "mean", "std", to=4), "avg_word_count")


@query("""
    WITH c AS (
        SELECT 'o_orderkey' AS "column", 'bigint' AS t, count(DISTINCT o_orderkey) u, count(*) n FROM orders UNION ALL
        SELECT 'o_custkey', 'bigint', count(DISTINCT o_custkey), count(*) FROM orders UNION ALL
        SELECT 'o_orderstatus', 'string', count(DISTINCT o_orderstatus), count(*) FROM orders UNION ALL
        SELECT 'o_totalprice', 'double', count(DISTINCT o_totalprice), count(*) FROM orders UNION ALL
        SELECT 'o_orderpriority', 'string', count(DISTINCT o_orderpriority), count(*) FROM orders
    )
    SELECT "column", "column" IN ('o_orderstatus', 'o_orderpriority') AS is_short_text, u / n >= 0.98 AND (contains("column", 'id') OR t IN ('bigint', 'string')) AS is_likely_id,
        u > 1 AND u <= greatest(20, floor(0.2 * n)) AS is_target_candidate, false AS is_high_null, u / n <= 0.01 AND n >= 30 AS is_near_constant FROM c""")
def profile_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return profile_table.column_roles(profile_table.column_profile(orders)).select("column", "is_short_text", "is_likely_id", "is_target_candidate", "is_high_null", "is_near_constant")


@query("""
    WITH d AS (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)
    SELECT sum(n)::BIGINT AS row_count, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS duplicate_ratio, 0::BIGINT AS missing FROM d""")
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return rounded(profile_table.duplicate_rows(some), "duplicate_ratio").crossJoin(some.agg(profile_table.total_missing(some).cast("bigint").alias("missing")))


@query("""
    WITH rows AS (SELECT count(*) AS n FROM customer), d AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment),
    dup AS (SELECT coalesce(sum(k) FILTER (k > 1), 0) / sum(k) AS r FROM d),
    w AS (SELECT 'duplicate_rows_detected:' || printf('%.4f', r) AS x FROM dup WHERE r > 0 UNION ALL SELECT 'low_variance_column:c_mktsegment' FROM rows WHERE n >= 500 UNION ALL SELECT 'low_variance_column:c_nationkey' FROM rows WHERE n >= 2500),
    f AS (SELECT 'high_duplicate_row_ratio' AS x FROM dup WHERE r >= 0.1 UNION ALL SELECT 'near_constant_column:c_mktsegment' FROM rows WHERE n >= 500 UNION ALL SELECT 'near_constant_column:c_nationkey' FROM rows WHERE n >= 2500)
    SELECT (SELECT string_agg(x, '|' ORDER BY x) FROM w) AS warnings, (SELECT string_agg(x, '|' ORDER BY x) FROM f) AS risk_flags""")
def profile_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    return profile_table.table_warnings(profile_table.column_profile(some), profile_table.duplicate_rows(some)).select(joined("warnings").alias("warnings"), joined("risk_flags").alias("risk_flags"))


@query("""
    WITH d AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment), r AS (SELECT sum(k) AS n, coalesce(sum(k) FILTER (k > 1), 0) / sum(k) AS r, count(*) AS m FROM d),
    w AS (SELECT 'duplicate_rows:' || printf('%.4f', r) AS x FROM r WHERE r >= 0.1 UNION ALL SELECT 'low_variance_column:c_mktsegment' FROM r WHERE n >= 500 UNION ALL SELECT 'low_variance_column:c_nationkey' FROM r WHERE n >= 2500),
    f AS (SELECT 'high_duplicate_row_ratio' AS x FROM r WHERE r >= 0.1 UNION ALL SELECT 'near_constant_column:c_mktsegment' FROM r WHERE n >= 500 UNION ALL SELECT 'near_constant_column:c_nationkey' FROM r WHERE n >= 2500)
    SELECT 'sheet' AS sheet, (SELECT string_agg(x, '|' ORDER BY x) FROM w) AS warnings, (SELECT string_agg(x, '|' ORDER BY x) FROM f) AS risk_flags
    UNION ALL SELECT 'empty', 'sheet_empty|small_dataset_rows:0', 'empty_sheet'""")
def profile_sheet_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbook variant: a sheet with rows, and one without."""
    some = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    each = [profile_table.table_warnings(profile_table.column_profile(t, sheet=True), profile_table.duplicate_rows(t), sheet=True).select(F.lit(name).alias("sheet"), joined("warnings").alias("warnings"), joined("risk_flags").alias("risk_flags")) for name, t in (("sheet", some), ("empty", some.where("false")))]
    return each[0].unionByName(each[1])


@query("""
    WITH v AS (
        SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL
        SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
    )
    SELECT *, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value))::INT AS rank FROM v QUALIFY rank <= 5""")
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table.top_values(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


@query("""
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE o_orderpriority END AS priority FROM orders""")
def profile_clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey") % 5, F.col("o_orderpriority")
    dirty = F.when(k == 0, F.lit(" N/A\t")).when(k == 1, F.lit("Unknown")).when(k == 2, F.concat(F.lit("\n "), p, F.lit("  "))).otherwise(p)
    return profile_table.clean_rows(table(spark, sf_dir, "orders").select("o_orderkey", dirty.alias("priority")))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 300")
def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table.sample_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@query(f"SELECT count(DISTINCT source) AS n_files, count(*) AS n_rows, sum(len({split_words('text')}))::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars FROM documents")
def dataset_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_table.dataset_size(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- texts

MARKERS_SQL = "CASE " + " ".join(f"WHEN 'L' = '{k}' THEN ['" + "', '".join(v) + "']" for k, v in profile_text.LANGUAGE_MARKERS.items()) + " END"


def _votes(k: str) -> str:
    return "len(list_filter(list_distinct(t), lambda w: list_contains(['" + "', '".join(profile_text.LANGUAGE_MARKERS[k]) + "'], w)))"


LANGUAGE_SQL = f"""languages AS (
    SELECT doc_id, CASE WHEN greatest(fr, en, ar) < 3 THEN 'unknown' WHEN fr >= en AND fr >= ar THEN 'fr' WHEN en >= ar THEN 'en' ELSE 'ar' END AS language
    FROM (SELECT doc_id, {_votes('fr')} AS fr, {_votes('en')} AS en, {_votes('ar')} AS ar FROM (SELECT doc_id, regexp_extract_all(lower(left(text, 3000)), '[\\p{{L}}\\p{{N}}_]+') AS t FROM documents))
)"""


@query(f"""
    WITH {LANGUAGE_SQL}, s AS (
        SELECT doc_id, text, list_transform({sentence_list('text', 6)}, lambda x: len({split_words('x')})) AS per, {split_words('lower(text)')}[1:500] AS lw, length({strip('text')}) < 50 AS short FROM documents
    ), li AS (
        SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, {strip('part')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM documents)) WHERE line <> '' GROUP BY ALL
    ), bo AS (
        SELECT doc_id, sum(n)::BIGINT AS line_count, coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS b FROM li GROUP BY doc_id
    ), m AS (
        SELECT s.doc_id, length(text)::INT AS char_count, len({split_words('text')})::INT AS word_count, coalesce(line_count, 0)::INT AS line_count, short,
            (length(text) - length(regexp_replace(text, '[\\p{{C}}\\p{{Z}}]', '', 'g')) - (length(text) - length(regexp_replace(text, '[\\n\\t ]', '', 'g'))) + length(text) - length(replace(text, chr(65533), ''))) / length(text) AS g,
            CASE WHEN short THEN 'unknown' ELSE language END AS language, CASE WHEN short THEN 0 ELSE len(per) END AS n, CASE WHEN short OR len(per) = 0 THEN 0 ELSE list_sum(per) / len(per) END AS mean,
            CASE WHEN short OR len(per) = 0 THEN 0 ELSE len(list_filter(per, lambda x: x < 5)) / len(per) END AS few, CASE WHEN short OR len(per) = 0 THEN 0 ELSE len(list_filter(per, lambda x: x > 60)) / len(per) END AS many,
            CASE WHEN short THEN 0 ELSE len(list_distinct(lw)) / len(lw) END AS d, coalesce(b, 0) AS b
        FROM s JOIN languages USING (doc_id) LEFT JOIN bo USING (doc_id)
    ), noted AS (
        SELECT *, CASE WHEN short THEN ['text_too_short'] ELSE list_filter([CASE WHEN d < 0.3 THEN 'low_lexical_diversity:' || printf('%.2f', d::DOUBLE) END, CASE WHEN few > 0.5 THEN 'many_short_fragments:' || printf('%.0f%%', few::DOUBLE * 100) END, CASE WHEN mean < 5 THEN 'very_short_avg_sentence:' || printf('%.1f', mean::DOUBLE) || '_words' END,
            CASE WHEN n < 5 THEN 'very_few_sentences:' || n END, CASE WHEN language = 'unknown' THEN 'language_not_detected' END], lambda x: x IS NOT NULL) END AS notes, list_filter([CASE WHEN g > 0.1 THEN 'high_garbled_ratio' END, CASE WHEN b > 0.3 THEN 'high_boilerplate' END], lambda x: x IS NOT NULL) AS noise FROM m
    ), sc AS (
        SELECT *, CASE WHEN short THEN 0 ELSE round(1 - CASE WHEN d < 0.3 THEN 0.3 ELSE 0 END - CASE WHEN few > 0.5 THEN 0.2 ELSE 0 END - CASE WHEN mean < 5 THEN 0.2 ELSE 0 END - CASE WHEN n < 5 THEN 0.2 ELSE 0 END, 6) END AS score FROM noted
    )
    SELECT doc_id, char_count, word_count, line_count, round(g, 6) AS garbled_ratio, round(b, 6) AS boilerplate_ratio, language, n::INT AS sentence_count, round(mean, 6) AS avg_sentence_length, round(few, 6) AS short_sentence_ratio,
        round(many, 6) AS long_sentence_ratio, round(d, 6) AS lexical_diversity, round(score, 6)::DOUBLE AS suitability,
        array_to_string(noise, '|') AS suspected_noise, array_to_string(notes, '|') AS suitability_warnings, array_to_string(list_sort(list_distinct(list_concat(list_transform(noise, lambda x: 'text_noise:' || x), list_transform(notes, lambda x: 'training:' || x)))), '|') AS warnings,
        array_to_string(list_filter([CASE WHEN b > 0.3 THEN 'high_boilerplate_text' END, CASE WHEN g > 0.2 THEN 'high_garbled_text' END, CASE WHEN score < 0.4 THEN 'low_training_suitability' END], lambda x: x IS NOT NULL), '|') AS risk_flags
    FROM sc""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_text.text_profile(table(spark, sf_dir, "documents"))
    p = rounded(p, "garbled_ratio", "boilerplate_ratio", "avg_sentence_length", "short_sentence_ratio", "long_sentence_ratio", "lexical_diversity", "suitability")
    return p.withColumns({c: joined(c) for c in ("suspected_noise", "risk_flags", "warnings", "suitability_warnings")})


@query(f"WITH {LANGUAGE_SQL} SELECT lang, language, count(*) AS n FROM documents JOIN languages USING (doc_id) GROUP BY ALL")
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return docs.groupBy("lang", profile_text.language("text").alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS rows FROM documents),
    h AS (SELECT *, len(list_filter(rows[1:300], lambda x: length(x) < 120 AND ((upper(x) = x AND lower(x) <> x) OR regexp_matches(x, '^\\d+(\\.\\d+)*\\s+') OR suffix(x, ':')))) >= 3 AS heads,
        len(list_filter(rows[1:60], lambda x: contains(lower(x), 'table of contents'))) > 0 AS toc, length(text) // 2 AS half FROM l)
    SELECT doc_id, CASE WHEN heads AND toc THEN 'contains_heading_like_structure|possible_table_of_contents' WHEN heads THEN 'contains_heading_like_structure' WHEN toc THEN 'possible_table_of_contents' ELSE 'unstructured_or_light_structure' END AS hints,
        left(text, 400) AS head, substr(text, greatest(half - 200, 0) + 1, half + 200 - greatest(half - 200, 0)) AS middle, right(text, 400) AS tail FROM h""")
def text_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", joined(profile_text.structure_hints("text")).alias("hints"), profile_text.snippets("text").alias("s")).select("doc_id", "hints", "s.*")


@query(f"SELECT doc_id, {strip(f'''regexp_replace(text, '{WS}+', ' ', 'g')''')} AS text FROM documents")
def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", profile_text.normalise("text").alias("text"))


# ---------------------------------------------------------------- cleaning

ARTEFACT_SQL = strip(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)!\s*\[[^\]]*\]\([^)]*\.(jpeg|jpg|png|gif|webp|svg|figure)[^)]*\)', '', 'g'), '(?im)^\s*\[\]\([^)]*\.(jpeg|jpg|png|gif|webp|svg|figure)[^)]*\)\s*$', '', 'g'), '(?is)<span[^>]*>.*?</span>', '', 'g'), '\[([^\]]*)\]\(#[^)]+\)', '\1', 'g'), '(?i)<sup>\d+</sup>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')""")
DIRTY_SQL = "'![x](a.png) <span id=\"p\">q</span>' || chr(10) || text || chr(10) || '[see ' || doc_id || '](#p1)<sup>' || (doc_id % 9) || '</sup>' || chr(10) || chr(10) || chr(10) || 'Page ' || doc_id || ' of 9' || chr(10) || '---' || chr(10) || (doc_id % 1000)"


def dirty(c: str = "text") -> Column:
    """Documents with what converters leave, so that the cleaning rules fire."""
    k = F.col("doc_id").cast("string")
    return F.concat(F.lit('![x](a.png) <span id="p">q</span>\n'), F.col(c), F.lit("\n[see "), k, F.lit("](#p1)<sup>"), (F.col("doc_id") % 9).cast("string"), F.lit("</sup>\n\n\nPage "), k, F.lit(" of 9\n---\n"), (F.col("doc_id") % 1000).cast("string"))


@query("SELECT doc_id, " + ARTEFACT_SQL.replace("{x}", DIRTY_SQL) + " AS text FROM documents")
def clean_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", clean.strip_artefacts(dirty()).alias("text"))


@query(f"""
    WITH a AS (SELECT doc_id, {DIRTY_SQL} AS raw FROM documents), b AS (SELECT doc_id, raw, {ARTEFACT_SQL.replace('{x}', 'raw')} AS t FROM a),
    pre AS (SELECT doc_id, length(raw) AS original_chars, regexp_replace(regexp_replace(regexp_replace(replace(t, chr(65279), ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\r\\n?', chr(10), 'g'), '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS t FROM b),
    li AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM pre),
    kept AS (SELECT doc_id, i, line, {strip('line')} AS s FROM li WHERE NOT (regexp_matches({strip('line')}, '^[-\\s]*\\d{{1,4}}[-\\s]*$') AND length({strip('line')}) <= 8) AND NOT regexp_matches({strip('line')}, '(?i)^page\\s+\\d+(\\s+of\\s+\\d+)?$') AND ({strip('line')} = '' OR regexp_matches(line, '[a-zA-Z0-9\\x{{0600}}-\\x{{06FF}}]'))),
    long AS (SELECT doc_id, count(*) AS total FROM kept WHERE length(s) > 3 GROUP BY doc_id),
    rep AS (SELECT k.doc_id, s FROM kept k JOIN long USING (doc_id) WHERE length(s) > 3 AND total >= 10 GROUP BY k.doc_id, s, total HAVING count(*) >= greatest(3, floor(total * 0.02))),
    done AS (SELECT doc_id, string_agg({strip('''regexp_replace(line, '[ \\t]+', ' ', 'g')''')}, chr(10) ORDER BY i) AS t FROM kept k WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.doc_id = k.doc_id AND r.s = k.s) GROUP BY doc_id),
    fin AS (SELECT doc_id, original_chars, regexp_replace(coalesce(done.t, ''), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM pre LEFT JOIN done USING (doc_id))
    SELECT doc_id, original_chars::INT AS original_chars, text, length(text)::INT AS cleaned_chars, round(100 * (1 - length(text) / original_chars), 1) AS removed_percent FROM fin""")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_documents(table(spark, sf_dir, "documents").select("doc_id", dirty().alias("text")))


@query(f"""
    WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM t),
    q AS (SELECT conv_id, i, {strip(f'''regexp_replace(regexp_replace(p, '<[^>]+>|https?://[^\\s]+', '', 'g'), '{WS}+', ' ', 'g')''')} AS p FROM p WHERE {strip('p')} <> ''),
    k AS (SELECT conv_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS kept FROM q WHERE len({split_words('p')}) BETWEEN 5 AND 50000 AND (len(list_distinct({split_words('lower(p)')})) / len({split_words('p')})) >= 0.05 GROUP BY conv_id)
    SELECT conv_id, CASE WHEN coalesce(length(kept), 0) < 0.1 * length(text) THEN text ELSE kept END AS text FROM t LEFT JOIN k USING (conv_id)""")
def clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return packed.select("conv_id", clean.filter_paragraphs(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")).alias("text"))


@query(f"""WITH {PAIRS} SELECT pair_id, upper(left(a, 1)) || substr(a, 2) AS answer FROM (SELECT pair_id, {strip("answer")} AS a FROM pairs)""")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("pair_id") % 2 == 0, F.lit("According to the text, ")).otherwise(F.lit("Selon le document : "))
    return pairs(spark, sf_dir).select("pair_id", clean.sanitise_answer(F.concat(lead, "answer")).alias("answer"))


# ---------------------------------------------------------------- chunks


def _chunk_sql(size: int, context: int, tail: str = "") -> str:
    return f"""
    WITH RECURSIVE s AS (SELECT doc_id, {sentence_list('text', 1)} AS s FROM documents),
    step AS (
        SELECT doc_id, 1 AS i, 0 AS chunk, length(s[1]) + 1 AS used FROM s WHERE len(s) > 0
        UNION ALL
        SELECT step.doc_id, i + 1, CASE WHEN used + length(s[i + 1]) > {size} THEN chunk + 1 ELSE chunk END, CASE WHEN used + length(s[i + 1]) > {size} THEN length(s[i + 1]) ELSE used + length(s[i + 1]) + 1 END
        FROM step JOIN s USING (doc_id) WHERE i < len(s)
    ), c AS (SELECT doc_id, chunk AS chunk_id, string_agg(s[i], ' ' ORDER BY i) AS text FROM step JOIN s USING (doc_id) GROUP BY doc_id, chunk),
    chunks AS (SELECT doc_id, chunk_id, text, {"coalesce(right(lag(text) OVER w, " + str(context) + "), '')" if context else "''"} AS prev_context, {"coalesce(left(lead(text) OVER w, " + str(context) + "), '')" if context else "''"} AS next_context, length(text)::INT AS char_count, (length(text) - length(replace(text, '.', '')))::INT AS sentence_count FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id))
    {tail or 'SELECT * FROM chunks'}"""


@query(_chunk_sql(500, 200))
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.sentence_chunks(table(spark, sf_dir, "documents"))


@query(f"""
    WITH t AS (SELECT doc_id, list_filter(list_transform({split_words('text')}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}.]+|[^\\p{{L}}\\p{{N}}.]+$', '', 'g')), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')) AS w FROM documents),
    p AS (SELECT w[i] AS x, w[i + 1] AS y FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM t)),
    c AS (SELECT lower(regexp_replace(x, '\\.+$', '')) AS word, count(*) AS n, count(*) FILTER (x LIKE '%.') AS stops, count(*) FILTER (x LIKE '%.' AND y IS NOT NULL AND NOT regexp_matches(y, '^\\p{{Lu}}')) AS before_small FROM p GROUP BY 1),
    q AS (SELECT *, length(word) - length(replace(word, '.', '')) AS inside, sum(stops) OVER () / sum(n) OVER () AS share FROM c),
    s AS (SELECT *, 2 * (stops * ln(0.99) + (n - stops) * ln(0.01) - stops * ln(share) - (n - stops) * ln(1 - share)) * exp(-(length(word) - inside)) * (inside + 1) * pow((length(word) - inside)::DOUBLE, -(n - stops)::DOUBLE) * (1 + before_small) AS score FROM q)
    SELECT word, n, stops, before_small, stops > 0 AND round(score, 6) >= 0.3 AND regexp_matches(word, '\\p{{L}}') AS abbreviation FROM s""")
def sentence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sentence splitter learns of each word of the documents."""
    stops = sentences.word_stops(sentences.token_pairs(table(spark, sf_dir, "documents")))
    short = sentences.abbreviations(stops).select("word", F.lit(True).alias("abbreviation"))
    return stops.join(short, "word", "left").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)))


@query(_chunk_sql(2000, 0, f"SELECT * FROM chunks WHERE len({split_words('text')}) >= 50"))
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.summary_chunks(table(spark, sf_dir, "documents"))


@query(f"""
    WITH RECURSIVE x AS (SELECT doc_id, {sentence_list('text', 1)} AS s FROM documents),
    s AS (SELECT doc_id, s, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda y: length(y) + 1)), 0)::BIGINT) AS p, len(s) AS n FROM x WHERE len(s) > 0),
    step AS (
        SELECT doc_id, 0 AS chunk_id, 0::BIGINT AS lo, greatest(1, len(list_filter(p[2:], lambda y: y - 1 <= 1500))) AS hi, 0::BIGINT AS again FROM s
        UNION ALL
        SELECT z.doc_id, chunk_id + 1, z.next, greatest(z.next + 1, len(list_filter(z.p[2:], lambda y: y - z.p[z.next + 1] - 1 <= 1500))), z.again FROM (
            SELECT s.doc_id, s.p, chunk_id, s.p[hi + 1] - s.p[back + 1] AS again, greatest(back, lo + 1) AS next
            FROM (SELECT step.*, greatest(lo, least(hi - 1, len(list_filter(s.p[1:hi], lambda y: s.p[hi + 1] - y - 1 > 200)))) AS back FROM step JOIN s USING (doc_id) WHERE hi < s.n) b JOIN s USING (doc_id)) z
    )
    SELECT doc_id, chunk_id, lo::INT AS start, hi::INT AS "end", array_to_string(s[lo + 1:hi], ' ') AS text, again::INT AS overlap_size FROM step JOIN s USING (doc_id)""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fixed_chunks(table(spark, sf_dir, "documents"))


@query(f"""
    WITH RECURSIVE x AS (SELECT doc_id, {sentence_list('text', 1)} AS s FROM documents),
    step AS (
        SELECT doc_id, 1 AS i, 0 AS chunk_id, length(s[1]) AS used, false AS full_ FROM x WHERE len(s) > 0
        UNION ALL
        SELECT doc_id, i, chunk_id + opens::INT, CASE WHEN opens THEN n ELSE used + n + 1 END, NOT opens AND used + n + 1 > 3000 FROM (
            SELECT step.doc_id, step.i + 1 AS i, chunk_id, used, length(s[step.i + 1]) AS n, full_ OR ((step.i % 3 = 0 OR used + length(s[step.i + 1]) + 1 > 3000) AND used >= 500) AS opens FROM step JOIN x USING (doc_id) WHERE step.i < len(s))
    )
    SELECT doc_id, chunk_id, string_agg(s[i], ' ' ORDER BY i) AS text FROM step JOIN x USING (doc_id) GROUP BY doc_id, chunk_id""")
def chunk_by_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boundary before every third sentence."""
    split = table(spark, sf_dir, "documents").select("doc_id", profile_text.sentences("text", 1).alias("s"))
    breaks = F.filter(F.sequence(F.lit(0), F.size("s")), lambda i: (i > 0) & (i % 3 == 0))
    return chunk.boundary_chunks(split.withColumn("breaks", breaks), "doc_id")


@query("""
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
    p AS (SELECT n, CASE WHEN n <= 50 THEN n WHEN n <= 200 THEN 50 WHEN n <= 1000 THEN 100 ELSE 200 END AS size, CASE WHEN n <= 50 THEN 0 WHEN n <= 200 THEN 5 WHEN n <= 1000 THEN 10 ELSE 20 END AS lap FROM (SELECT count(*) AS n FROM orders)),
    c AS (SELECT k AS chunk_id, CASE WHEN k = 0 THEN 0 ELSE k * greatest(1, size - lap) - lap END AS lo, k * greatest(1, size - lap) + size AS hi FROM p, range(0, (SELECT (n - 1) // greatest(1, size - lap) + 1 FROM p)) t(k))
    SELECT chunk_id::INT AS chunk_id, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM r JOIN c ON i >= lo AND i < hi GROUP BY chunk_id""")
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = chunk.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return chunk.row_chunks(orders, "i").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""
    WITH c AS (SELECT (c_custkey % 40)::INT AS chunk_id, c_name::VARCHAR AS a, c_nationkey::VARCHAR AS b, c_mktsegment AS c FROM customer),
    d AS (SELECT chunk_id, count(*) AS n, (count(DISTINCT a) + count(DISTINCT b) + count(DISTINCT c)) / count(*) / 3 AS diversity FROM c GROUP BY chunk_id),
    r AS (SELECT chunk_id, n AS row_count, 0.3 * 3 / 8 + 0.3 * diversity + 0.2 * least(1, n / 100) + 0.2 AS x FROM d)
    SELECT chunk_id, row_count, round(x, 6) AS richness, greatest(3, floor(8 * x))::INT AS min_pairs FROM r""")
def chunk_table_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).cast("int").alias("chunk_id"), "c_name", "c_nationkey", "c_mktsegment")
    return rounded(chunk.table_richness(c, ["c_name", "c_nationkey", "c_mktsegment"]), "richness")


@query(f"""
    SELECT doc_id, round(least(1, length(text) / 3000) * 0.25 + least(1, len(list_filter(string_split(text, '.'), lambda x: {strip('x')} <> '')) / 50) * 0.25 + len(list_distinct({split_words('lower(text)')})) / len({split_words('lower(text)')}) * 0.2
        + least(1, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')} <> '')) / 10) * 0.15, 6) AS richness FROM documents""")
def chunk_text_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texts(spark, sf_dir).select("doc_id", chunk.text_richness("text").alias("richness")), "richness")


@query(f"""
    WITH x AS (SELECT doc_id, text, lower(text) AS low, {split_words('text')} AS w, list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> '') AS rows FROM documents)
    SELECT doc_id, CASE WHEN text = '' THEN 'empty'
        WHEN len(regexp_extract_all(text, '\\.{{4,}}\\s*\\d+')) >= 4 AND len(w) < 300 THEN 'contents'
        WHEN len(regexp_extract_all(text, '(?m)^\\s*[-•]?\\s*\\d+\\.\\s+["''“]?[A-Z]')) >= 3 THEN 'references'
        WHEN len(list_filter(['all rights reserved', 'no representations', 'warranties of any kind', 'fitness for a particular', 'applicable software license', 'specifically disclaims', 'subject to change without notice'], lambda p: contains(low, p))) >= 2 THEN 'legal'
        WHEN len(rows) > 0 AND len(list_filter(rows, lambda r: len({split_words('r')}) < 6)) / len(rows) > 0.6 AND len(w) < 150 THEN 'cover'
        WHEN len(w) < 60 AND len(list_filter(w, lambda y: upper(y[1]) = y[1] AND lower(y[1]) <> y[1])) / greatest(len(w), 1) > 0.45 THEN 'headings'
        WHEN len(regexp_extract_all(text, '\\b\\d{{1,2}}\\.\\s+[A-Z][^.\\n]{{0,80}}(?:https?://|www\\.)')) >= 4 AND len(w) < 500 THEN 'links'
        WHEN len(list_filter(['all rights reserved', 'table of contents', 'table des matières', '©', 'disclaimer:', 'trademarks are trademarks', 'this publication is provided', 'knowledge sharing article'], lambda p: contains(low, p))) >= 3 AND len(w) < 250 THEN 'signs' END AS rule FROM x""")
def chunk_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", chunk.boilerplate_rule("text").alias("rule"))


@query("""
    WITH v AS (SELECT vec_id // 25 AS doc, vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 25 ORDER BY vec_id) AS f FROM embeddings),
    d AS (SELECT doc, vec_id, 1 - list_cosine_similarity(e, f) AS distance FROM v WHERE f IS NOT NULL),
    n AS (SELECT vec_id // 25 AS doc, count(*) AS n, count(*) * 400 AS chars FROM embeddings GROUP BY 1),
    p AS (SELECT d.doc, list_sort(list(distance)) AS l, greatest(0.5, 1 - greatest(1, n // greatest(3, 1500 // (chars // n))) / (n - 1)) * (count(*) - 1) AS place FROM d JOIN n USING (doc) WHERE n >= 5 GROUP BY d.doc, n, chars),
    t AS (SELECT doc, l[floor(place)::INT + 1] + (place - floor(place)) * (coalesce(l[floor(place)::INT + 2], l[floor(place)::INT + 1]) - l[floor(place)::INT + 1]) AS threshold FROM p)
    SELECT doc, vec_id, round(distance, 6) AS distance, round(threshold, 6) AS threshold FROM d JOIN t USING (doc) WHERE distance >= threshold""")
def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 25))
    sizes = v.groupBy("doc").agg(F.count(F.lit(1)).alias("n_sentences"), (F.count(F.lit(1)) * 400).alias("n_chars"))
    return rounded(chunk.semantic_boundaries(chunk.adjacent_distances(v, "doc", "vec_id", "embedding"), sizes, "doc", "vec_id"), "distance", "threshold")


# ---------------------------------------------------------------- pairs

SIGNATURE = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) > 3 AND NOT list_contains(['" + "', '".join(qa_rules.STOP_WORDS) + "'], w))"


def signature_sql(x: str) -> str:
    return SIGNATURE.format(x=x)


VAGUE_SQL = "len({words}) < 5 OR list_contains(['" + "', '".join(v.replace("'", "''") for v in qa_rules.VAGUE_ANSWERS) + "'], {norm})"


def vague_sql(x: str) -> str:
    norm = f"lower(regexp_replace({strip(x)}, '[.!?]+$', ''))"
    return "(" + VAGUE_SQL.format(words=split_words(norm), norm=norm) + ")"


def paraphrase_sql(q: str, a: str) -> str:
    sq, sa = signature_sql(q), signature_sql(a)
    return f"(len({sa}) = 0 OR len(list_filter({sa}, lambda w: NOT list_contains({sq}, w))) / len({sa}) < 0.2)"


def sql_pattern(patterns: list[str]) -> str:
    return "'(?i)" + "|".join(patterns).replace("'", "''") + "'"


MARKED = "CASE pair_id % 11 WHEN 0 THEN 'Who wrote this? ' WHEN 1 THEN 'In the document, ' WHEN 2 THEN 'What is the page number? ' WHEN 3 THEN 'Dans le rapport, ' ELSE '' END || question"
ANSWERED = "CASE pair_id % 7 WHEN 0 THEN 'It depends.' WHEN 1 THEN left(answer, 30) WHEN 2 THEN question ELSE answer END"


def marked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs altered by number so that every rule fires."""
    k, m = F.col("pair_id") % 11, F.col("pair_id") % 7
    opening = F.when(k == 0, "Who wrote this? ").when(k == 1, "In the document, ").when(k == 2, "What is the page number? ").when(k == 3, "Dans le rapport, ").otherwise("")
    answer = F.when(m == 0, F.lit("It depends.")).when(m == 1, F.left("answer", F.lit(30))).when(m == 2, F.col("question")).otherwise(F.col("answer"))
    return pairs(spark, sf_dir).select("pair_id", F.concat(opening, "question").alias("question"), answer.alias("answer"), "source_file", "confidence")


MARKED_SQL = PAIRS + f", marked AS (SELECT pair_id, {MARKED} AS question, {ANSWERED} AS answer, source_file, confidence FROM pairs)"


@query(f"WITH {MARKED_SQL} SELECT pair_id, question, answer, source_file, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.5 END::DOUBLE AS confidence FROM marked WHERE len({split_words('answer')}) >= 10")
def qa_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_rules.shape_pairs(marked_pairs(spark, sf_dir))


@query(f"""
    WITH {MARKED_SQL}
    SELECT pair_id, array_to_string(list_sort({signature_sql('question')}), '|') AS signature, CASE WHEN regexp_matches(question, {sql_pattern(qa_rules.METADATA_QUESTIONS)}) THEN 'metadata' WHEN {vague_sql('answer')} THEN 'vague' WHEN {paraphrase_sql('question', 'answer')} THEN 'paraphrase'
        WHEN regexp_matches(question, '(?i)\\b({"|".join(qa_rules.DOCUMENT_REFERENCE)})\\b') THEN 'document_reference' END AS reason FROM marked""")
def qa_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_pairs(spark, sf_dir).select("pair_id", joined(F.array_sort(qa_rules.signature_words("question"))).alias("signature"), qa_rules.filter_reason().alias("reason"))


CLAIM_SQL = "list_filter(list_distinct(list_transform(list_concat(" + ", ".join("regexp_extract_all({x}, '" + p + "')" for p in qa_rules.CLAIM_PATTERNS) + "), lambda t: lower(t))), lambda t: length(t) > 1 AND NOT list_contains(['" + "', '".join(qa_rules.NO_CLAIM) + "'], t))"


@query("""
    WITH d AS (SELECT p_partkey, p_brand || ' costs ' || (floor(p_retailprice)::INT + 1000) || ' as NASA and McDonald said in ' || p_type || ' X-ray-' || p_name AS answer, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' NASA ' || (floor(p_retailprice)::INT + 1000) || ' mcdonald' ELSE p_type END AS source FROM part)
    SELECT p_partkey, array_to_string(list_sort(""" + CLAIM_SQL.replace("{x}", "answer") + "), '|') AS claims, len(" + CLAIM_SQL.replace("{x}", "answer") + ") >= 3 AND len(list_filter(" + CLAIM_SQL.replace("{x}", "answer") + ", lambda t: NOT list_contains(" + CLAIM_SQL.replace("{x}", "source") + ", t) AND NOT contains(lower(source), t))) / len(" + CLAIM_SQL.replace("{x}", "answer") + ") > 0.5 AS ungrounded FROM d")
def qa_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = (F.floor("p_retailprice").cast("int") + 1000).cast("string")
    answer = F.concat("p_brand", F.lit(" costs "), price, F.lit(" as NASA and McDonald said in "), "p_type", F.lit(" X-ray-"), "p_name")
    source = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" NASA "), price, F.lit(" mcdonald"))).otherwise(F.col("p_type"))
    d = table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"), source.alias("source"))
    return d.select("p_partkey", joined(F.array_sort(qa_rules.claims("answer"))).alias("claims"), qa_rules.is_ungrounded("answer", "source").alias("ungrounded"))


@query(f"""
    WITH RECURSIVE q AS (SELECT doc_id AS id, lower({strip("regexp_replace(text, '" + WS + "+', ' ', 'g')")}) AS n, {signature_sql("text")} AS s FROM documents),
    e AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.n = b.n AND a.n <> '' THEN 1 WHEN length(a.n) >= 30 AND length(b.n) >= 30 AND left(a.n, 60) = left(b.n, 60) THEN 2 ELSE 3 END AS rule FROM q a JOIN q b ON a.id < b.id
        WHERE (a.n = b.n AND a.n <> '') OR (length(a.n) >= 30 AND length(b.n) >= 30 AND left(a.n, 60) = left(b.n, 60)) OR (len(a.s) > 0 AND len(b.s) > 0 AND 2 * greatest(len(a.s), len(b.s)) < 4 * least(len(a.s), len(b.s)) AND 2 * len(list_intersect(a.s, b.s)) > len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
    ids AS (SELECT j AS id, list(i) AS earlier, row_number() OVER (ORDER BY j) AS r FROM e GROUP BY j),
    walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS dropped UNION ALL SELECT ids.r, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, id) ELSE dropped END FROM walk JOIN ids ON ids.r = walk.r + 1),
    fin AS (SELECT dropped FROM walk ORDER BY r DESC LIMIT 1),
    rules AS (SELECT j AS id, min(rule) AS drop_rule FROM e, fin WHERE list_contains(dropped, j) AND NOT list_contains(dropped, i) GROUP BY j)
    SELECT q.id AS pair_id, drop_rule::INT AS drop_rule FROM q LEFT JOIN rules USING (id)""")
def dedup_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("question"))
    return dedup.lexical_dedup(items).select("pair_id", "drop_rule")


def _fates_sql(vectors: str, least: float) -> str:
    """In order, a vector goes if it is so near to a kept earlier one of the view (vec_id, e)."""
    return f"""
    WITH RECURSIVE v AS ({vectors}), e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= {least}),
    ids AS (SELECT j AS id, list(i) AS earlier, row_number() OVER (ORDER BY j) AS r FROM e GROUP BY j),
    walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS dropped UNION ALL SELECT ids.r, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, id) ELSE dropped END FROM walk JOIN ids ON ids.r = walk.r + 1),
    fin AS (SELECT dropped FROM walk ORDER BY r DESC LIMIT 1)
    SELECT vec_id, CASE WHEN list_contains(dropped, vec_id) THEN 'eval_pool' ELSE 'kept' END AS fate FROM v, fin"""


@query(_fates_sql("SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings", 0.35))
def dedup_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.semantic_dedup(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least_question=0.35).select("vec_id", "fate")


# Every fifth vector has a copy whose first number is pushed by a share of the length: 0.3 leaves it nearer than 0.90, 0.6 does not.
COPIES_SQL = """
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    UNION ALL SELECT vec_id + 1000000, list_prepend(x[1] + push * sqrt(list_sum(list_transform(x, lambda y: y * y))), x[2:]) FROM (SELECT vec_id, embedding::DOUBLE[] AS x, CASE WHEN vec_id % 10 = 0 THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS push FROM embeddings WHERE vec_id % 5 = 0)"""


def with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    push = F.when(F.col("vec_id") % 10 == 0, 0.3).otherwise(0.6) * length
    return e.unionByName(e.where("vec_id % 5 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i == 0, x + push).otherwise(x)).alias("embedding")))


@query(_fates_sql(COPIES_SQL, 0.9))
def dedup_semantic_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.semantic_dedup(with_copies(spark, sf_dir), "vec_id", "embedding").select("vec_id", "fate")


@query(f"""
    WITH {PAIRS}, s AS (SELECT pair_id, CASE pair_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.62 WHEN 2 THEN 0.35 WHEN 3 THEN 0.34 ELSE (pair_id % 100) / 100 END AS score FROM pairs)
    SELECT pair_id, CASE WHEN coalesce(score, 0.5) >= 0.62 THEN 'keep' WHEN coalesce(score, 0.5) >= 0.35 THEN 'refine' ELSE 'drop' END AS decision FROM s""")
def qa_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair_id") % 6
    score = F.when(k == 0, None).when(k == 1, 0.62).when(k == 2, 0.35).when(k == 3, 0.34).otherwise((F.col("pair_id") % 100) / 100)
    return pairs(spark, sf_dir).select("pair_id", qa_rules.score_decision(score).alias("decision"))


@query("""
    WITH b AS (SELECT conv_id, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY conv_id)
    SELECT conv_id * 1000 + unnest(ids) AS pair_id, coalesce(CASE generate_subscripts(ids, 1) WHEN 1 THEN 0.9 WHEN 2 THEN NULL WHEN 3 THEN 0.25 END, 0.5)::DOUBLE AS score FROM b""")
def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("conv_id") * 1000 + F.col("turn"))).alias("pair_ids"))
    return qa_rules.parse_scores(grouped.select("pair_ids", F.lit('scores: [0.9, "none", 0.25]').alias("reply")))


@query(f"""
    WITH {PAIRS}, x AS (SELECT pair_id, question, answer, left(answer, 200) || ' ' || left(question, (pair_id % 100)::INT) AS refined FROM pairs),
    n AS (SELECT *, list_filter({signature_sql('refined')}, lambda w: NOT list_contains({signature_sql('question')}, w)) AS new FROM x)
    SELECT pair_id, CASE WHEN len(new) = 0 THEN 0 ELSE len(list_filter(new, lambda w: list_contains({signature_sql('answer')}, w))) / len(new) END >= 0.5 AND NOT regexp_matches(question, {sql_pattern(qa_rules.METADATA_QUESTIONS)}) AND NOT {vague_sql('refined')} AND NOT {paraphrase_sql('question', 'refined')} AS accepted FROM n""")
def qa_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    refined = F.concat(F.left("answer", F.lit(200)), F.lit(" "), F.left("question", (F.col("pair_id") % 100).cast("int")))
    return pairs(spark, sf_dir).withColumn("refined", refined).select("pair_id", qa_rules.refinement_accepted("question", "refined", "answer").alias("accepted"))


@query(f"WITH {PAIRS} SELECT pair_id, question FROM pairs ORDER BY md5(pair_id || '0'), pair_id LIMIT 50")
def qa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_rules.sample_pairs(pairs(spark, sf_dir), 50).select("pair_id", "question")


@query("""
    WITH b AS (SELECT n_nationkey % 4 AS round, n_name AS file, n_nationkey + 3 AS n FROM nation), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY round, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
    SELECT round, file, least(n, greatest(0, greatest(120, 2000, 1500 + 500) - 1900 - before))::INT AS take FROM c WHERE least(n, greatest(0, greatest(120, 2000, 1500 + 500) - 1900 - before)) > 0""")
def qa_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.range(1).select(qa_rules.fill_target(F.lit(120), F.lit(1500)).alias("t")).first()["t"]
    batches = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 4).alias("round"), F.col("n_name").alias("file"), (F.col("n_nationkey") + 3).alias("n"))
    return qa_rules.fill_quota(batches, target - 1900).select("round", "file", F.col("take").cast("int").alias("take"))


@query(f"SELECT CASE WHEN len({split_words('text')}) < 20 THEN 'too_short' WHEN item_id % 3 = 0 THEN 'irrelevant' ELSE 'kept' END AS verdict, count(*) AS n FROM benchmark GROUP BY 1")
def qa_page_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_num"), "text")
    judged = pages.where("page_num % 3 = 0").select("page_num", F.lit(False).alias("relevant"))
    return qa_rules.triage_pages(pages, judged).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 3 THEN '' ELSE 'q ' || n_name END AS question, CASE n_nationkey % 4 WHEN 3 THEN '' ELSE 'a' END AS answer,
        CASE n_nationkey % 4 WHEN 3 THEN 'no tool' ELSE '{"tool": {"name": "' || n_name || '"}}' END AS call FROM nation""")
def qa_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with fences, bare line breaks in strings, single quotes or nothing; and the last call of a tool in a text."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    record = lambda gap, q: F.concat(F.lit(f"[{{{q}question{q}: {q}q{gap}"), name, F.lit(f"{q}, {q}answer{q}: {q}a{q}, {q}confidence{q}: 0.5}}]"))
    reply = F.when(k % 4 == 0, F.concat(F.lit("Sure:\n```json\n"), record(" ", '"'), F.lit("\n```"))).when(k % 4 == 1, record("\n", '"')).when(k % 4 == 2, record(" ", "'")).otherwise("nothing here")
    text = F.when(k % 4 == 3, "{no} call").otherwise(F.concat(F.lit('{"tool": 1} then {"tool": {"name": "'), name, F.lit('"}} and {"other": 2}')))
    first = F.get(qa_rules.parse_pairs(reply), 0)
    return table(spark, sf_dir, "nation").select(k.alias("k"), F.coalesce(first["question"], F.lit("")).alias("question"), F.coalesce(first["answer"], F.lit("")).alias("answer"), F.coalesce(qa_rules.last_tool_call(text), F.lit("no tool")).alias("call"))


@query(f"""
    SELECT vec_id AS pair_id, fate FROM ({_fates_sql(f"SELECT * FROM ({COPIES_SQL}) WHERE NOT vec_id BETWEEN 400 AND 999999", 0.9)})
    UNION ALL SELECT vec_id, 'lexical' FROM embeddings WHERE vec_id >= 400""")
def dedup_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that repeat from the 400th on, and near copies of vectors, some of whose originals are gone by then."""
    h = F.md5(F.when(F.col("vec_id") < 1000000, F.col("vec_id") % 400).otherwise(F.col("vec_id")).cast("string"))
    question = F.concat_ws(" ", *[F.substring(h, 1 + 8 * i, 8) for i in range(4)])
    items = with_copies(spark, sf_dir).select(F.col("vec_id").alias("pair_id"), question.alias("question"), "embedding")
    return dedup.two_stage_dedup(items, question_vector="embedding").select("pair_id", "fate")


@query(f"""
    WITH {PAIRS}, f AS (SELECT pair_id, question, source_file FROM pairs ORDER BY pair_id LIMIT 100)
    SELECT pair_id, 'Say: ' || {strip('question')} AS question, source_file || '[eval]' AS source_file FROM f WHERE pair_id % 3 = 0""")
def dedup_eval_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rephrased, unchanged and empty questions in turn."""
    near, k = pairs(spark, sf_dir), F.col("pair_id") % 3
    rephrased = near.select("pair_id", F.when(k == 0, F.concat(F.lit(" Say: "), F.col("question"))).when(k == 1, F.col("question")).otherwise(" ").alias("rephrased"))
    return dedup.eval_pool(near, rephrased).select("pair_id", "question", "source_file")


@query("""
    WITH f AS (SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN left(repeat('text of ' || n_name || ' ', 60), 600) ELSE repeat('word ', 20) || n_name END AS p FROM nation ORDER BY n_name LIMIT 3)
    SELECT left(string_agg(p, chr(10) || chr(10) ORDER BY n_name), 3000) AS excerpt FROM f""")
def qa_verdict_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    summary = F.when(F.col("n_nationkey") % 2 == 0, name).otherwise(F.concat(F.lit("word " * 20), name))
    files_ = table(spark, sf_dir, "nation").select(name.alias("filename"), summary.alias("summary"), F.repeat(F.concat(F.lit("text of "), name, F.lit(" ")), F.lit(60)).alias("text"))
    return qa_rules.verdict_excerpt(files_)


# ---------------------------------------------------------------- verdicts, export


@query(f"""
    WITH w AS (SELECT doc_id, len({split_words('text')}) AS n, CASE WHEN doc_id % 50 = 0 THEN 0.35 WHEN doc_id % 50 = 1 THEN 0.25 ELSE 0 END AS g, CASE WHEN doc_id % 40 = 0 THEN 0.6 ELSE 0.1 END AS b FROM documents),
    f AS (SELECT doc_id, 1 AS o, 'BLOCKED' AS s FROM w WHERE n = 0 UNION ALL SELECT doc_id, 2, CASE WHEN g > 0.3 THEN 'BLOCKED' ELSE 'WARNING' END FROM w WHERE g > 0.2 UNION ALL SELECT doc_id, 3, 'WARNING' FROM w WHERE b > 0.5)
    SELECT CASE WHEN count(*) FILTER (s = 'BLOCKED') > 0 THEN 'BLOCKED' WHEN count(*) > 0 THEN 'WARNING' ELSE 'GO' END AS status, count(*) FILTER (s = 'BLOCKED')::INT AS n_blocking, count(*) FILTER (s = 'WARNING')::INT AS n_warnings FROM f""")
def verdict_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    profiles = texts(spark, sf_dir).select(
        k.cast("string").alias("file"), F.lit("txt").alias("file_kind"), F.lit(None).cast("bigint").alias("row_count"), F.size(profile_text.words("text")).alias("word_count"), F.lit(None).cast("int").alias("n_columns"), F.lit(None).cast("int").alias("mostly_null_columns"), F.lit(None).cast("int").alias("near_constant_columns"),
        F.lit(None).cast("double").alias("duplicate_ratio"), F.when(k % 50 == 0, 0.35).when(k % 50 == 1, 0.25).otherwise(0.0).alias("garbled_ratio"), F.when(k % 40 == 0, 0.6).otherwise(0.1).alias("boilerplate_ratio"), F.array().cast("array<string>").alias("risk_flags"),
    )
    return verdicts.verdict_counts(verdicts.feasibility_findings(profiles))


@query(f"""
    WITH {PAIRS}, d AS (SELECT count(*) AS n, count(DISTINCT source_file) AS k, avg(len({split_words('answer')})) AS w FROM pairs),
    a AS (SELECT *, CASE WHEN n >= 2000 THEN 1 WHEN n >= 600 THEN 0.85 WHEN n >= 200 THEN 0.7 ELSE 0.7 * n / 200 END AS volume, 0.4 * least(1, k / 3) + 0.6 * least(1, w / 80) AS diversity, 0.9 AS alignment FROM d)
    SELECT n AS n_pairs, round(volume, 6)::DOUBLE AS volume, round(diversity, 6) AS diversity, alignment::DOUBLE AS alignment, round((volume + diversity + alignment) / 3, 6) AS score, CASE WHEN n < 200 OR (volume + diversity + alignment) / 3 < 0.65 THEN 'NOT_READY' WHEN (volume + diversity + alignment) / 3 >= 0.8 THEN 'READY' ELSE 'READY_WITH_WARNINGS' END AS verdict FROM a""")
def verdict_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts.readiness(pairs(spark, sf_dir), 200, 600, 2000, "about 0.9, I think")
    return rounded(out.select("n_pairs", "volume", "diversity", "alignment", "score", "verdict"), "volume", "diversity", "score")


@query("SELECT * FROM (VALUES ('two words', 'BLOCKED', 'prompt: too short', 0), ('a request of five words', 'BLOCKED', 'empty_text: no words', 1), ('', 'BLOCKED', 'prompt: too short', 0)) v(prompt, status, reason, n_warnings)")
def verdict_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request over the same profiles with prompts vague and not."""
    k = F.col("r_regionkey")
    none = lambda t: F.lit(None).cast(t)
    profiles = table(spark, sf_dir, "region").where("r_regionkey < 2").select(k.cast("string").alias("file"), F.lit("txt").alias("file_kind"), none("bigint").alias("row_count"), (k * 50).alias("word_count"), none("int").alias("n_columns"), none("int").alias("mostly_null_columns"), none("int").alias("near_constant_columns"), none("double").alias("duplicate_ratio"), F.lit(0.0).alias("garbled_ratio"), (k * 0.6).alias("boilerplate_ratio"), F.array().cast("array<string>").alias("risk_flags"))
    each = [verdicts.assess(profiles, p).select(F.lit(p).alias("prompt"), "status", F.get("blocking_reasons", 0).alias("reason"), F.size("warnings").alias("n_warnings")) for p in ("two words", "a request of five words", "")]
    return each[0].unionByName(each[1]).unionByName(each[2])


#: A goal for each order, in SQL that Spark and DuckDB share.
GOAL = """CASE o_orderkey % 8 WHEN 0 THEN 'Chat about ' || lower(o_orderpriority) WHEN 1 THEN 'résumé my reports, summarise ' || o_orderpriority WHEN 2 THEN 'label the ' || o_orderstatus || ' tickets' WHEN 3 THEN 'write code'
    WHEN 4 THEN 'answer questions on ' || o_orderpriority WHEN 5 THEN 'TL;DR please' WHEN 6 THEN '' ELSE o_orderpriority END"""


@query(f"""SELECT o_orderkey, CASE WHEN regexp_matches(lower(goal), 'chat|conv|dialogue') THEN 'conversational-qa' WHEN regexp_matches(lower(goal), 'summar|resume|tl;dr') THEN 'summarization' WHEN regexp_matches(lower(goal), 'classif|label|sentiment|categor') THEN 'classification'
    WHEN regexp_matches(lower(goal), 'code|program') THEN 'code-generation' ELSE 'question-answering' END AS task, len(list_filter(string_split(goal, ' '), lambda w: w <> '')) <= 2 AS vague FROM (SELECT o_orderkey, {GOAL} AS goal FROM orders)""")
def verdict_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(GOAL).alias("goal"))
    return goals.select("o_orderkey", verdicts.intent_task("goal").alias("task"), verdicts.prompt_is_vague("goal").alias("vague"))


@query(f"""
    WITH {PAIRS}
    SELECT pair_id, 'alpaca' AS format, question AS a, answer AS b FROM pairs
    UNION ALL SELECT pair_id, 'sharegpt', question, answer FROM pairs
    UNION ALL SELECT pair_id, 'seq2seq', question, answer FROM pairs
    UNION ALL SELECT pair_id, 'chat', list_extract(['Résume ce texte en quelques phrases claires et concises.', 'Donne un résumé concis de ce passage en 3 à 5 phrases.', 'En quelques phrases, résume les idées principales de ce texte.', 'Fournis un résumé synthétique de ce passage.'], (pair_id % 4)::INT + 1) || chr(10) || chr(10) || question, answer FROM pairs""")
def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four formats, read back as prompt and reference."""
    p = pairs(spark, sf_dir)
    kinds = [("question-answering", ""), ("conversational-qa", ""), ("summarization", "google/t5-small"), ("summarization", "mistral-7b")]
    parts = [export.export_records(p, task, model) for task, model in kinds]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.select("pair_id", "format", export.evaluation_pair("record").alias("e")).select("pair_id", "format", F.col("e.prompt").alias("a"), F.col("e.reference").alias("b"))


@query("""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('split:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 3 THEN 'train' WHEN place <= greatest(1, n // 10) THEN 'val' WHEN place <= 2 * greatest(1, n // 10) THEN 'test' ELSE 'train' END AS split FROM r""")
def export_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.assign_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""
    WITH s AS (SELECT n_name AS filename, CASE n_nationkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN n_name END AS cleaned, CASE WHEN n_nationkey % 4 = 2 THEN 'raw ' || n_name END AS raw, CASE WHEN n_nationkey % 8 < 4 THEN 'full' END AS full_ FROM nation),
    t AS (SELECT filename, coalesce(CASE WHEN trim(cleaned) <> '' THEN cleaned END, CASE WHEN trim(raw) <> '' THEN raw END, full_) AS text FROM s)
    SELECT filename, length(text)::INT AS chars, repeat('=', 60) || chr(10) || '=== SOURCE : ' || filename || ' ===' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || text AS section FROM t WHERE text IS NOT NULL""")
def export_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    files_ = table(spark, sf_dir, "nation").select(F.col("n_name").alias("filename"), F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.col("n_name")).alias("cleaned"), F.when(k % 4 == 2, F.concat(F.lit("raw "), "n_name")).alias("raw"), F.when(k % 8 < 4, "full").alias("full"), F.lit(None).cast("string").alias("rows"))
    return export.merged_corpus(files_)


@query("SELECT r_regionkey::BIGINT AS job_id, r_regionkey % 2 = 0 AS has_training, r_regionkey > 2 AS has_evaluation, false AS has_journal FROM region")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("job_id"), "r_name")
    out = export.merged_report(jobs.select("job_id"), jobs.where("job_id % 2 = 0"), jobs.where("job_id > 2"), jobs.where("false"))
    return out.select("job_id", F.col("training").isNotNull().alias("has_training"), F.col("evaluation").isNotNull().alias("has_evaluation"), F.col("journal").isNotNull().alias("has_journal"))


# ---------------------------------------------------------------- models

@query("""
    WITH o AS (SELECT o_totalprice AS p, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS s, o_custkey AS c FROM orders), n AS (SELECT count(*) AS rows FROM o)
    SELECT 'o_totalprice' AS "column", rows AS row_count, 0 AS null_count, round(min(p), 6) AS min, round(max(p), 6) AS max, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std, NULL::BIGINT AS sentinel_count, NULL::DOUBLE AS avg_word_count FROM o, n GROUP BY rows
    UNION ALL SELECT 'o_custkey', rows, 0, min(c)::DOUBLE, max(c)::DOUBLE, round(avg(c), 4), round(stddev_samp(c), 4), NULL, NULL FROM o, n GROUP BY rows
    UNION ALL SELECT 'priority', rows, count(*) FILTER (s IS NULL), NULL, NULL, NULL, NULL, count(*) FILTER (lower(s) IN ('n/a', 'na', 'null', 'none', 'unknown', '-', '--', '?', 'nan', '')), round(avg(len(string_split(s, ' '))), 6) FROM o, n GROUP BY rows""")
def profile_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as four files, of each of which only the state is kept."""
    o = table(spark, sf_dir, "orders")
    columns = ["o_totalprice", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority")]
    states = [profile_state.profile_state(o.where(F.col("o_orderkey") % 4 == k).select(*columns)) for k in range(4)]
    found = profile_state.profile_of_states(states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3]))
    return rounded(rounded(found, "mean", "std", to=4), "min", "max", "avg_word_count").select("column", "row_count", "null_count", "min", "max", "mean", "std", "sentinel_count", "avg_word_count")


MODELS = [("org/model-7B-chat", "qlora", "question-answering"), ("tiny-net", "full", "translation"), ("x-0.5B", "lora", "code-generation"), ("big_70b-base", "auto", "sentiment-analysis"), ("net-large", "dora", "other"), ("extra-large-net", "none", "classification"), ("medium one", "lora_int8", "summarization"), ("plain", "qlora", "chatbot"), ("m-13B", "full", "conversational-qa")]
#: A model for each part, in SQL that Spark and DuckDB share: names in turn, with the part's size where a name has one over one.
MODEL_COLUMNS = {c: "CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN " + re.sub("(70|13|7)(?=[bB])", "' || p_size || '", f"'{m[k]}'") for i, m in enumerate(MODELS)) + " END" for k, c in enumerate(("model", "peft", "task"))}
MODEL_COLUMNS["model"] = f"'p' || p_partkey || '/' || {MODEL_COLUMNS['model']}"
MODEL_COLUMNS["pairs"] = "p_partkey * 7 % 22000"
MODEL_COLUMNS["gb"] = "CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 16 ELSE 24 END"
MODEL_SQL = f"""m AS (SELECT *, coalesce(nullif(regexp_extract(model, '[-_/](\\d+\\.?\\d*)[Bb](?:\\b|[-_])', 1), '')::DOUBLE, nullif(regexp_extract(model, '(\\d+\\.?\\d*)[Bb][-_]', 1), '')::DOUBLE, nullif(regexp_extract(model, '\\b(\\d+\\.?\\d*)[Bb]\\b', 1), '')::DOUBLE,
    CASE WHEN regexp_matches(model, 'nano|pico|tiny') THEN 0.1 WHEN regexp_matches(model, 'mini|small|0\\.5') THEN 0.5 WHEN contains(model, 'medium') THEN 3 WHEN contains(model, 'large') AND NOT contains(model, 'extra') THEN 13 WHEN regexp_matches(model, 'xl|extra-large') THEN 30 ELSE 7 END)::DOUBLE AS size_b FROM (SELECT {", ".join(f"{x} AS {c}" for c, x in MODEL_COLUMNS.items())} FROM part))"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*[F.expr(x).alias(c) for c, x in MODEL_COLUMNS.items()])


@query(f"""
    WITH {MODEL_SQL}, n AS (SELECT * FROM (VALUES (0.3, 50, 150, 600), (0.7, 100, 300, 1000), (1.5, 200, 600, 2000), (3.5, 350, 1000, 3500), (8, 500, 1500, 5000), (15, 800, 2500, 8000), (40, 1200, 4000, 12000), (1e9, 2000, 6000, 20000)) v(cap, lo, mid, hi)),
    s AS (SELECT *, CASE WHEN peft = 'full' THEN 8.0 ELSE 1.0 END * CASE task WHEN 'conversational-qa' THEN 1.2 WHEN 'instruction-following' THEN 1.5 WHEN 'summarization' THEN 0.8 WHEN 'classification' THEN 0.6 WHEN 'sentiment-analysis' THEN 0.5 WHEN 'code-generation' THEN 2.0 WHEN 'translation' THEN 0.7 ELSE 1 END AS f, (SELECT min(cap) FROM n WHERE size_b <= cap) AS cap FROM m)
    SELECT model, size_b, round(f, 6)::DOUBLE AS multiplier, round_even(lo * f, 0)::BIGINT AS min_viable, round_even(mid * f, 0)::BIGINT AS target, round_even(hi * f, 0)::BIGINT AS saturate FROM s JOIN n USING (cap)""")
def model_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(registry.data_requirements(models(spark, sf_dir)).select("model", "size_b", "multiplier", "min_viable", "target", "saturate"), "multiplier")


@query(f"""
    WITH {MODEL_SQL}, x AS (SELECT * FROM m)
    SELECT model, pairs, CASE WHEN size_b <= 0.5 THEN 4 WHEN size_b <= 1.5 THEN 8 WHEN size_b <= 7 THEN 16 WHEN size_b <= 15 THEN 32 ELSE 64 END AS lora_rank, 2 * CASE WHEN size_b <= 0.5 THEN 4 WHEN size_b <= 1.5 THEN 8 WHEN size_b <= 7 THEN 16 WHEN size_b <= 15 THEN 32 ELSE 64 END AS lora_alpha,
        (CASE WHEN peft IN ('lora', 'lora_int8', 'dora') THEN 1e-4 WHEN peft = 'full' THEN 2e-5 ELSE 2e-4 END)::DOUBLE AS learning_rate, CASE WHEN pairs <= 300 THEN 10 WHEN pairs <= 700 THEN 7 WHEN pairs <= 1500 THEN 5 WHEN pairs <= 3000 THEN 3 WHEN pairs <= 8000 THEN 2 ELSE 1 END AS num_train_epochs,
        CASE WHEN gb >= 16 THEN 4 WHEN gb >= 8 THEN 2 ELSE 1 END AS batch_size, 16 // CASE WHEN gb >= 16 THEN 4 WHEN gb >= 8 THEN 2 ELSE 1 END AS accumulation, CASE WHEN task = 'code-generation' THEN 4096 ELSE 2048 END AS max_length,
        (CASE WHEN peft = 'full' THEN 5e-6 ELSE 1e-5 END)::DOUBLE AS rate_low, (CASE WHEN peft = 'full' THEN 1e-4 ELSE 5e-4 END)::DOUBLE AS rate_high, CASE WHEN pairs < 300 THEN 5 WHEN pairs < 700 THEN 4 WHEN pairs < 2000 THEN 2 ELSE 1 END AS epochs_low, CASE WHEN pairs < 300 THEN 12 WHEN pairs < 700 THEN 8 WHEN pairs < 2000 THEN 6 ELSE 3 END AS epochs_high FROM x""")
def model_hyper_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = models(spark, sf_dir)
    return x.select("model", "pairs", registry.hyper_parameters(registry.model_size("model"), "peft", F.col("pairs"), F.col("gb"), "task").alias("h"), registry.search_bounds("peft", F.col("pairs")).alias("b")).select("model", "pairs", "h.*", "b.*")


@query("""
    WITH l AS (SELECT length(text) AS c FROM documents), s AS (SELECT list_sort(list(c)) AS c FROM l)
    SELECT least(2048, pow(2, ceil(log2(greatest(256, floor((c[floor(0.95 * len(c))::INT + 1] / 4 + 50) * 1.2))))))::INT AS max_length FROM s""")
def model_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.adaptive_length(table(spark, sf_dir, "documents").select(F.length("text").alias("chars")), "chars")


@query(f"""
    WITH {MODEL_SQL}, k AS (SELECT * FROM (VALUES (1, 'qlora', 0.5, 0.01), (2, 'lora_int8', 1.0, 0.01), (3, 'lora', 2.0, 0.01), (4, 'full', 2.0, 1.0)) v(i, method, b, f)),
    need AS (SELECT model, m.gb AS have, i, method, round(size_b * b + 3 * (size_b * f * 4) + 1.5, 1) AS gb FROM m, k),
    fit AS (SELECT model, have, list(method ORDER BY i) FILTER (gb <= have - least(3, greatest(0.5, have * 0.2))) AS f, list(method ORDER BY gb, i) FILTER (gb <= have - least(3, greatest(0.5, have * 0.2))) AS least_first FROM need GROUP BY model, have)
    SELECT model, have, floor(have - least(3, greatest(0.5, have * 0.2)))::INT AS budget, coalesce(array_to_string(f, '|'), '') AS fits, CASE WHEN f IS NULL THEN 'qlora' ELSE least_first[1] END AS speed,
        CASE WHEN f IS NULL THEN 'qlora' WHEN list_contains(f, 'lora') THEN 'lora' WHEN list_contains(f, 'lora_int8') THEN 'lora_int8' WHEN list_contains(f, 'qlora') THEN 'qlora' ELSE f[-1] END AS performance,
        CASE WHEN f IS NULL THEN 'qlora' WHEN list_contains(f, 'lora_int8') THEN 'lora_int8' WHEN list_contains(f, 'qlora') THEN 'qlora' WHEN list_contains(f, 'lora') THEN 'lora' ELSE f[1] END AS balanced FROM fit""")
def model_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = models(spark, sf_dir).withColumnRenamed("gb", "have").withColumn("parameters_b", registry.model_size("model"))
    have = F.col("have")
    fit = registry.methods_that_fit(x, have - F.least(F.lit(3.0), F.greatest(F.lit(0.5), have * 0.2)))
    pick = lambda o: registry.choose_method(F.lit(o), F.col("feasible"), F.col("need_gb")).alias(o)
    return fit.select("model", "have", registry.memory_budget(have).alias("budget"), joined("feasible").alias("fits"), pick("speed"), pick("performance"), pick("balanced"))


@query("""
    WITH c AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'tencent/' || p_name WHEN 1 THEN 'x/hunyuan-' || p_size WHEN 2 THEN 'x/mamba-' || p_size WHEN 3 THEN 'x/m-' || p_size || 'b-awq' ELSE 'x/m-' || p_size || 'b' END AS id, p_partkey % 8 = 4 AS reward, CASE WHEN p_partkey % 8 = 5 THEN 'fill-mask' ELSE 'text-generation' END AS pipe, CASE WHEN p_partkey % 8 = 6 THEN ['embeddings', 'code'] ELSE ['chat'] END AS tags FROM part)
    SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'organisation:tencent/' WHEN 1 THEN 'architecture:hunyuan' WHEN 2 THEN 'no_transformer:mamba' WHEN 3 THEN 'quantised:-awq' WHEN 4 THEN 'reward' WHEN 5 THEN 'pipeline:fill-mask' WHEN 6 THEN 'tag:embeddings' END AS reason,
        CASE p_partkey % 8 WHEN 5 THEN 'fill-mask|instruction-following' WHEN 6 THEN 'code-generation|text-generation' WHEN 4 THEN 'instruction-following|reward-modeling|text-generation' ELSE 'instruction-following|text-generation' END AS tasks FROM c""")
def model_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("tencent/"), "p_name")).when(k == 1, F.concat(F.lit("x/hunyuan-"), size)).when(k == 2, F.concat(F.lit("x/mamba-"), size)).when(k == 3, F.concat(F.lit("x/m-"), size, F.lit("b-awq"))).otherwise(F.concat(F.lit("x/m-"), size, F.lit("b")))
    cards = table(spark, sf_dir, "part").select("p_partkey", name.alias("model_id"), F.lit(None).cast("string").alias("swift_model_type"), F.lit("").alias("swift_task_type"), (k == 4).alias("is_reward"), F.when(k == 5, "fill-mask").otherwise("text-generation").alias("pipeline_tag"), F.when(k == 6, F.array(F.lit("embeddings"), F.lit("code"))).otherwise(F.array(F.lit("chat"))).alias("tags"))
    return cards.select("p_partkey", registry.incompatibility().alias("reason"), joined(registry.model_tasks()).alias("tasks"))


@query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
    SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 6""")
def retrieval_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50, against all rows but itself."""
    v = table(spark, sf_dir, "embeddings")
    return rounded(retrieval.top_k_each(v, v.where("vec_id % 50 = 0"), "embedding", 6, "vec_id"), "score")


@query("""
    WITH r AS (SELECT 's' || s_suppkey AS model_id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank, s_suppkey % 3 = 0 AS cached, s_suppkey % 5 = 0 AS tried FROM supplier)
    SELECT model_id, cached FROM r WHERE NOT tried ORDER BY cached DESC, rank LIMIT 3""")
def retrieval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("model_id", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    ranked = chunk.numbered(s, F.desc("s_acctbal"), F.col("s_suppkey"), name="rank").select("model_id", "rank")
    return retrieval.candidates(ranked, s.where("s_suppkey % 5 = 0"), s.select("model_id", (F.col("s_suppkey") % 3 == 0).alias("cached"))).select("model_id", "cached")


@query("""
    WITH x AS (SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey * 3000 END AS words FROM nation)
    SELECT k, CASE WHEN k % 5 = 0 THEN 'very small dataset' WHEN words < 5000 THEN 'small dataset' WHEN words < 50000 THEN 'medium dataset' ELSE 'large dataset' END AS size,
        'Task: qa. ' || CASE WHEN k % 2 = 0 THEN 'Domain: ' || name || '. ' ELSE '' END || 'Data language: en. Modality: text. Dataset: d. Objective: speed. Hardware: ' || k || 'GB VRAM available. Select a model that fits within VRAM and performs well on the task.' AS query,
        'Model: ' || name || '. Parameters: ' || k || '.0B. Supported tasks: ' || CASE WHEN k % 2 = 0 THEN 'a, b' ELSE 'text-generation' END || '. Supported languages: en. Tags: ' || CASE WHEN k % 3 = 0 THEN 'x' ELSE '' END || '.' AS card FROM x""")
def retrieval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    empty = F.array().cast("array<string>")
    n = table(spark, sf_dir, "nation").withColumns({"model_id": name, "parameters_b": k.cast("double"), "supported_tasks": F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(empty), "supported_languages": empty, "tags": F.when(k % 3 == 0, F.array(F.lit("x")))})
    size = retrieval.size_class(F.when(k % 5 != 0, k * 3000), F.when(k % 5 == 0, k))
    query_ = retrieval.query_text(F.lit("qa"), F.when(k % 2 == 0, name), F.lit(""), F.lit("en"), F.lit("text"), F.lit("d"), F.lit("speed"), k)
    return n.select(k.alias("k"), size.alias("size"), query_.alias("query"), retrieval.card_text().alias("card"))


@query("""
    SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 6 THEN 3 ELSE greatest(2, least(CASE n_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 4 END, n_nationkey % 7)) END::INT AS trials, 1 AS single,
        CASE WHEN n_nationkey % 3 = 2 THEN 8.0 WHEN n_nationkey % 3 = 1 THEN 4.0 ELSE n_nationkey END::DOUBLE AS rank, CASE WHEN n_nationkey % 3 = 0 THEN 0.1 ELSE 0.3 END::DOUBLE AS decay,
        CASE WHEN n_nationkey / 10 < 1.2 THEN 'cpu' WHEN n_nationkey / 10 < 1.5 THEN 'gpu_4bit' WHEN n_nationkey / 10 < 2.5 THEN 'gpu_8bit' ELSE 'gpu_half' END AS device, 'a|c' AS shown, '--a 1 --c 3' AS preview FROM nation""")
def model_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice complete, with a value that is no number, and overridden; trial counts; devices; configurations without private keys."""
    k = F.col("n_nationkey")
    keys = ["lora_rank", "lora_alpha", "lora_dropout", "learning_rate", "num_train_epochs", "warmup_ratio", "weight_decay"]
    said = F.create_map(*[x for n in keys for x in (F.lit(n), F.when((k % 3 == 1) & F.lit(n == "lora_alpha"), "none").otherwise(k.cast("string") if n == "lora_rank" else F.lit("0.1")))])
    base = F.create_map(*[x for n in keys for x in (F.lit(n), F.lit(4.0 if n == "lora_rank" else 0.3))])
    over = F.when(k % 3 == 2, F.create_map(F.lit("lora_rank"), F.lit(8.0), F.lit("weight_decay"), F.lit(0.3)))
    got = registry.advised_parameters(said, base, over)
    objective = F.element_at(F.array(*[F.lit(x) for x in ("speed", "balanced", "quality", "other")]), (k % 4 + 1).cast("int"))
    advised = F.when(k % 7 != 6, (k % 7).cast("int"))
    config = F.create_map(F.lit("c"), F.lit("3"), F.lit("a"), F.lit("1"), F.lit("_b"), F.lit("2"))
    return table(spark, sf_dir, "nation").select(k.alias("k"), registry.trial_count(objective, advised).cast("int").alias("trials"), registry.trial_count(objective, advised, single=True).alias("single"), got["lora_rank"].alias("rank"), got["weight_decay"].alias("decay"), registry.device_policy(k / 10).alias("device"), joined(F.array_sort(F.map_keys(registry.public_config(config)))).alias("shown"), registry.config_preview(config).alias("preview"))


@query("SELECT p_size::VARCHAR AS model_id, sum(p_partkey * 2000) >= 104857600 AS cached FROM part GROUP BY p_size")
def model_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.is_cached(table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("model_id"), (F.col("p_partkey") * 2000).alias("length")))


# ---------------------------------------------------------------- metrics

SCORED = PAIRS + ", scored AS (SELECT pair_id, answer AS r, CASE pair_id % 4 WHEN 0 THEN answer WHEN 1 THEN left(answer, 200) || ' ' || question WHEN 2 THEN question ELSE '' END AS g FROM pairs)"


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pair_id") % 4
    generated = F.when(k == 0, F.col("answer")).when(k == 1, F.concat(F.left("answer", F.lit(200)), F.lit(" "), "question")).when(k == 2, F.col("question")).otherwise("")
    return pairs(spark, sf_dir).select("pair_id", F.col("answer").alias("reference"), generated.alias("generated"))


def _gram_sql(name: str, source: str, n: int) -> str:
    return f"{name} AS (SELECT pair_id, list_filter(list_transform(range(1, len({source}) + 1), lambda i: CASE WHEN i + {n - 1} <= len({source}) THEN array_to_string({source}[i:i + {n - 1}], ' ') END), lambda x: x IS NOT NULL) AS l FROM tok)"


def _overlap_sql(n: int) -> str:
    return f"""{_gram_sql(f'r{n}', 'tr', n)}, {_gram_sql(f'g{n}', 'tg', n)}, o{n} AS (SELECT pair_id, sum(least(a, b)) AS o FROM (SELECT pair_id, x, count(*) AS a FROM (SELECT pair_id, unnest(l) AS x FROM r{n}) GROUP BY ALL) JOIN (SELECT pair_id, x, count(*) AS b FROM (SELECT pair_id, unnest(l) AS x FROM g{n}) GROUP BY ALL) USING (pair_id, x) GROUP BY pair_id)"""


@query(f"""
    WITH {SCORED}, tok AS (SELECT pair_id, regexp_extract_all(lower(r), '[a-z0-9]+') AS tr, regexp_extract_all(lower(g), '[a-z0-9]+') AS tg FROM scored), {_overlap_sql(1)}, {_overlap_sql(2)}
    SELECT pair_id, round(CASE WHEN len(tr) + len(tg) = 0 THEN 0 ELSE 2 * coalesce(o1.o, 0) / (len(tr) + len(tg)) END, 6)::DOUBLE AS rouge1, round(coalesce(2 * coalesce(o2.o, 0) / nullif(greatest(len(tr) - 1, 0) + greatest(len(tg) - 1, 0), 0), 0), 6)::DOUBLE AS rouge2
    FROM tok LEFT JOIN o1 USING (pair_id) LEFT JOIN o2 USING (pair_id)""")
def metric_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rouge(scored_pairs(spark, sf_dir), "pair_id", with_l=False), "rouge1", "rouge2")


@query(f"""
    WITH RECURSIVE {SCORED}, tok AS (SELECT pair_id, regexp_extract_all(lower(r), '[a-z0-9]+') AS tr, regexp_extract_all(lower(g), '[a-z0-9]+') AS tg FROM scored),
    walk AS (
        SELECT pair_id, 0 AS i, list_transform(range(0, len(tg) + 1), lambda j: 0) AS row FROM tok
        UNION ALL
        SELECT pair_id, i + 1, list_reduce(list_transform(range(1, len(tg) + 1), lambda j: CASE WHEN tr[i + 1] = tg[j] THEN row[j] + 1 ELSE row[j + 1] END), lambda acc, x: list_append(acc, greatest(acc[-1], x)), [0])
        FROM walk JOIN tok USING (pair_id) WHERE i < len(tr) AND len(tg) > 0
    ), last AS (SELECT pair_id, max(row[-1]) AS l FROM walk GROUP BY pair_id)
    SELECT pair_id, round(CASE WHEN len(tr) + len(tg) = 0 THEN 0 ELSE 2 * l / (len(tr) + len(tg)) END, 6)::DOUBLE AS "rougeL" FROM tok JOIN last USING (pair_id)""")
def metric_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rouge(scored_pairs(spark, sf_dir), "pair_id").select("pair_id", "rougeL"), "rougeL")


@query(f"""
    WITH {SCORED}, tok AS (SELECT pair_id, {split_words('lower(r)')} AS tr, {split_words('lower(g)')} AS tg FROM scored), {_overlap_sql(1)}, {_overlap_sql(2)}, {_overlap_sql(3)}, {_overlap_sql(4)}
    SELECT pair_id, round(CASE WHEN len(tg) = 0 OR coalesce(o1.o, 0) = 0 THEN 0 ELSE CASE WHEN len(tg) > len(tr) THEN 1 ELSE exp(1 - len(tr) / len(tg)) END * exp((ln(o1.o / len(tg))
        + ln(CASE WHEN coalesce(o2.o, 0) = 0 THEN 0.1 ELSE o2.o END / greatest(len(tg) - 1, 1)) + ln(CASE WHEN coalesce(o3.o, 0) = 0 THEN 0.1 ELSE o3.o END / greatest(len(tg) - 2, 1)) + ln(CASE WHEN coalesce(o4.o, 0) = 0 THEN 0.1 ELSE o4.o END / greatest(len(tg) - 3, 1))) / 4) END, 6)::DOUBLE AS bleu4
    FROM tok LEFT JOIN o1 USING (pair_id) LEFT JOIN o2 USING (pair_id) LEFT JOIN o3 USING (pair_id) LEFT JOIN o4 USING (pair_id)""")
def metric_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.bleu4(scored_pairs(spark, sf_dir), "pair_id"), "bleu4")


@query(f"""
    WITH {SCORED}, tok AS (SELECT pair_id, r, g, {split_words('lower(r)')} AS tr, {split_words('lower(g)')} AS tg FROM scored), f AS (SELECT CASE WHEN len(tr) + len(tg) = 0 THEN 0 ELSE 2 * len(list_intersect(tr, tg)) / (len(tr) + len(tg)) END AS f1, ({strip('lower(r)')} = {strip('lower(g)')})::INT AS em FROM tok)
    SELECT round(avg(f1), 4) AS f1_token, round(avg(em), 4)::DOUBLE AS exact_match FROM f""")
def metric_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_pairs(spark, sf_dir).select(metrics.token_f1("reference", "generated").alias("f1_token"), metrics.exact_match("reference", "generated").alias("exact_match"))
    return metrics.metric_means(s, ["f1_token", "exact_match"])


@query("""
    WITH l AS (SELECT unnest([0, 1]) AS y), s AS (SELECT y, count(*) FILTER (quality = y AND toxic = y) AS tp, count(*) FILTER (quality = y) AS r, count(*) FILTER (toxic = y) AS p FROM labels, l GROUP BY y)
    SELECT round(sum(tp) / sum(r), 6) AS accuracy, round(avg(coalesce(tp / nullif(p, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(r, 0), 0)), 6) AS recall, round(avg(coalesce(2 * tp / nullif(p + r, 0), 0)), 6) AS f1_macro FROM s""")
def metric_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select(metrics.label_of(F.concat(F.lit("  "), F.col("quality").cast("string"), F.lit(". yes\nno"))).alias("reference"), F.col("toxic").cast("string").alias("predicted"))
    return rounded(metrics.classification(l), "accuracy", "precision", "recall", "f1_macro")


@query("""
    WITH e AS (SELECT n_nationkey, ['A:' || lower(n_name), 'B:x' || (n_regionkey)] AS r, CASE WHEN n_nationkey % 2 = 0 THEN ['A:' || lower(n_name), 'B:x' || (n_regionkey + 1)] ELSE ['B:x' || n_regionkey] END AS g FROM nation),
    s AS (SELECT sum(len(list_intersect(r, g))) AS tp, sum(len(r)) AS r, sum(len(g)) AS g FROM e), p AS (SELECT round(tp / g, 4) AS p, round(tp / r, 4) AS q FROM s)
    SELECT p AS entity_precision, q AS entity_recall, round(2 * p * q / (p + q), 4) AS entity_f1 FROM p""")
def metric_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    a = F.concat(F.lit("a: "), "n_name")
    reference = F.concat(a, F.lit(" | b :X"), r.cast("string"), F.lit("| junk |b:x"), r.cast("string"))
    generated = F.when(k % 2 == 0, F.concat(a, F.lit("|B:x"), (r + 1).cast("string"))).otherwise(F.concat(F.lit("B:x"), r.cast("string")))
    return metrics.entity_scores(table(spark, sf_dir, "nation").select(reference.alias("reference"), generated.alias("generated")))


@query("""
    WITH r AS (SELECT n_nationkey AS k FROM nation), d AS (SELECT 'accuracy' AS dimension, least(5, greatest(1, k % 8))::DOUBLE AS v FROM r WHERE k % 5 <> 0 UNION ALL SELECT 'style', least(5, greatest(1, k % 3)) FROM r WHERE k % 5 <> 0)
    SELECT dimension, count(*) AS n, round(avg(v) / 5, 4) AS score FROM d GROUP BY 1""")
def metric_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    reply = F.when(k % 5 == 0, F.lit("no idea")).otherwise(F.concat(F.lit('Sure: {"g_accuracy": '), (k % 8).cast("string"), F.lit(', "style": "'), (k % 3).cast("string"), F.lit('"} done')))
    return metrics.judged_dimensions(table(spark, sf_dir, "nation").select(reply.alias("reply")), ["accuracy", "style"])


@query("SELECT round(avg(least(1, greatest(0, CASE WHEN n_nationkey % 4 = 0 THEN 0.5 ELSE n_nationkey / 10 - 0.5 END))), 4) AS faithfulness FROM nation WHERE n_nationkey % 5 <> 0")
def metric_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    reply = F.when(k % 5 == 0, "none").when(k % 4 == 0, '{"reason": "x"}').otherwise(F.concat(F.lit('{"faithfulness": '), (k / 10 - 0.5).cast("string"), F.lit("}")))
    return metrics.faithfulness(table(spark, sf_dir, "nation").select(reply.alias("reply")))


@query("""
    WITH x AS (SELECT p_partkey AS k, (p_partkey % 100) / 100.0 AS v, p_size * 60 AS n FROM part)
    SELECT k, CASE WHEN v >= 0.45 THEN 'good' WHEN v >= 0.28 THEN 'acceptable' ELSE 'poor' END AS tier, v > 0.45 * 1.9 AS suspicious, CASE WHEN v >= 0.45 AND n >= 2000 THEN 'good' WHEN v >= 0.28 * 0.9 THEN 'acceptable' ELSE 'poor' END AS banded,
        CASE WHEN v > 0.45 * 1.9 THEN 'check_leakage' WHEN v >= 0.45 AND n >= 2000 THEN 'export' WHEN v >= 0.28 * 0.9 AND v < 0.28 THEN 'accept_borderline' WHEN v >= 0.28 AND k % 2 = 0 THEN 'stop_stagnation' WHEN n < 2000 OR v < 0.14 THEN 'generate_pairs' WHEN v < 0.28 THEN 'adjust_hyper_parameters' WHEN v < 0.45 THEN 'continue_lower_rate' ELSE 'review' END AS advice FROM x""")
def metric_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = (F.col("p_partkey") % 100) / 100.0, F.col("p_size") * 60
    good, ok = F.lit(0.45), F.lit(0.28)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), metrics.tier(v, good, ok).alias("tier"), metrics.is_suspicious(v, good).alias("suspicious"), metrics.tier_with_tolerance(v, good, ok, n).alias("banded"), metrics.recommendation(v, good, ok, n, F.col("p_partkey") % 2 == 0).alias("advice"))


@query("""
    WITH e AS (SELECT vec_id // 8 AS id, vec_id, label, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS u FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)),
    w AS (SELECT label, ln(((SELECT count(DISTINCT id) FROM e) + 1) / (count(DISTINCT id) + 1)) AS w FROM e GROUP BY label),
    c AS (SELECT r.id, r.vec_id AS a, h.vec_id AS b, r.label AS la, h.label AS lb, list_sum(list_transform(list_zip(r.u, h.u), lambda p: p[1] * p[2])) AS cos FROM e r JOIN e h ON r.id = h.id AND r.vec_id % 8 < 4 AND h.vec_id % 8 >= 4),
    r AS (SELECT id, sum(w * m) / sum(w) AS recall FROM (SELECT id, a, la, max(cos) AS m FROM c GROUP BY ALL) JOIN w ON la = label GROUP BY id),
    p AS (SELECT id, sum(w * m) / sum(w) AS precision FROM (SELECT id, b, lb, max(cos) AS m FROM c GROUP BY ALL) JOIN w ON lb = label GROUP BY id)
    SELECT i.id, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1
    FROM (SELECT DISTINCT id FROM e) i LEFT JOIN r ON i.id = r.id LEFT JOIN p ON i.id = p.id""")
def metric_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of eight vectors: the first four as a reference's tokens, the others as a generated text's, weighted by label."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("id"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    weighted = e.join(F.broadcast(metrics.inverse_document_weights(e, "id", "label")), "label")
    side = lambda test: F.array_sort(F.collect_list(F.when(test, F.struct("vec_id", "v", "weight"))))
    items = weighted.groupBy("id").agg(side(F.col("vec_id") % 8 < 4).alias("r"), side(F.col("vec_id") % 8 >= 4).alias("g"))
    scored = metrics.matched_scores(items.select("id", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "rg" for c in ("v", "weight")]), "r_v", "g_v", "r_weight", "g_weight")
    return rounded(scored.select("id", "precision", "recall", "f1"), "precision", "recall", "f1")


@query(f"WITH {PAIRS} SELECT pair_id, {strip('left(answer, 20)')} AS text FROM pairs")
def metric_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("pair_id", metrics.strip_generation(F.concat("question", F.left("answer", F.lit(20)), F.lit("<|im_end|>\nmore")), "question").alias("text"))


@query("""
    SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 < 2 THEN least(1, n_nationkey / 10) END::DOUBLE AS good, CASE WHEN n_nationkey % 3 < 2 THEN greatest(0, n_nationkey / 20 - 0.3) END::DOUBLE AS acceptable, length(n_name) AS scored FROM nation""")
def metric_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of replies, some out of range or missing; and the column of a scorer that is given."""
    k = F.col("n_nationkey")
    both = F.concat(F.lit('So {"good_threshold": '), (k / 10).cast("string"), F.lit(', "acceptable_threshold": "'), (k / 20 - 0.3).cast("string"), F.lit('"} it is'))
    reply = F.when(k % 3 < 2, both).otherwise('{"good_threshold": 0.5}')
    n = metrics.optional_score(table(spark, sf_dir, "nation"), lambda df, of: df.withColumn("scored", F.length(of).cast("bigint")), of="n_name")
    return metrics.optional_score(n).select(k.alias("k"), metrics.parse_thresholds(reply).alias("t"), "scored").select("k", F.round("t.good", 9).alias("good"), F.round("t.acceptable", 9).alias("acceptable"), "scored")


# ---------------------------------------------------------------- curves and trials

LOG_SQL = """log AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, value / 500 AS v, CASE WHEN event_id % 7 <> 0 THEN value / 100 END AS t, CASE WHEN event_id % 5 <> 0 THEN value / 90 + (event_id % 3) END AS e, event_type AS o FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an improvement log: a run per user, an entry per event."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("iteration", n)
    return e.select(F.col("user_id").alias("run_id"), "iteration", (F.col("value") / 500).alias("primary_metric_value"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 100).alias("train_loss"), F.when(F.col("event_id") % 5 != 0, F.col("value") / 90 + F.col("event_id") % 3).alias("eval_loss"), F.create_map(F.lit("kind"), F.col("event_type")).alias("hparam_overrides"))


@query(f"""
    WITH {LOG_SQL}, r AS (SELECT DISTINCT run_id FROM log),
    s AS (SELECT run_id, count(*) AS n, list(v ORDER BY iteration) AS v, count(DISTINCT o) AS kinds FROM log GROUP BY run_id),
    b AS (SELECT run_id, list(t ORDER BY iteration) AS t, list(e ORDER BY iteration) AS e FROM log WHERE t IS NOT NULL AND e IS NOT NULL GROUP BY run_id)
    SELECT run_id, n >= 2 AND coalesce(v[-1] - v[-2] < 0.02, false) AS stagnates,
        coalesce(CASE WHEN len(t) = 1 THEN e[1] > 2.5 * t[1] ELSE (e[-1] > e[-2] AND t[-1] < t[-2]) OR (e[-2] - t[-2] > 0 AND e[-1] - t[-1] > 1.3 * (e[-2] - t[-2])) END, false) AS overfits,
        coalesce(t[-1] > 2.5 AND e[-1] > 2.5, false) AS underfits, n >= 2 AND kinds >= 2 AND v[-1] < 0.5 * 0.28 AS mismatched, CASE WHEN run_id % 3000 < 50 AND run_id % 3000 > 0 THEN true WHEN run_id % 3000 BETWEEN 50 AND 1999 THEN v[-1] < 0.28 ELSE false END AS insufficient
    FROM s LEFT JOIN b USING (run_id)""")
def curve_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = log(spark, sf_dir)
    last = l.groupBy("run_id").agg(F.max_by("primary_metric_value", "iteration").alias("last"))
    out = curves.stagnation(l).join(curves.overfitting(l), "run_id").join(curves.underfitting(l), "run_id").join(curves.model_mismatch(l, F.lit(0.28)), "run_id").join(last, "run_id")
    return out.withColumn("insufficient", curves.insufficient_data(F.col("run_id") % 3000, F.col("last"), F.lit(0.28))).drop("last")


HISTORY_SQL = """h AS (SELECT user_id % 50 AS run_id, 'checkpoint-' || (event_id % 4 + 1) * 10 AS checkpoint, event_id % 4 + 1 AS no, event_id AS step, value / 100 AS loss, CASE WHEN event_type IN ('click', 'purchase') THEN round(value / 10) / 10 END AS eval_loss FROM events)"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4 + 1
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run_id"), F.concat(F.lit("checkpoint-"), (k * 10).cast("string")).alias("checkpoint"), F.col("event_id").cast("double").alias("step"), F.lit(None).cast("double").alias("epoch"), (F.col("value") / 100).alias("loss"), F.when(F.col("event_type").isin("click", "purchase"), F.round(F.col("value") / 10) / 10).alias("eval_loss"))


@query(f"WITH {HISTORY_SQL} SELECT run_id, coalesce((list(checkpoint ORDER BY eval_loss, no, step) FILTER (eval_loss IS NOT NULL))[1], max(checkpoint)) AS checkpoint FROM h GROUP BY run_id")
def curve_best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.best_checkpoint(checkpoints(spark, sf_dir))


@query(f"""
    WITH {HISTORY_SQL}, l AS (SELECT run_id, max(no) AS no FROM h GROUP BY run_id), p AS (SELECT run_id, loss, eval_loss FROM h JOIN l USING (run_id, no))
    SELECT run_id, count(*) AS points, round(sum(round(loss, 4)), 2) AS total, round(least(min(loss), coalesce(min(eval_loss), min(loss))) * 0.9, 4) AS low FROM p GROUP BY run_id HAVING count(*) >= 2""")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = curves.loss_curve(checkpoints(spark, sf_dir))
    sums = points.groupBy("run_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("train_loss"), 2).alias("total"))
    return sums.join(history.chart_scale(points).select("run_id", F.round("low", 4).alias("low")), "run_id")


LINES_SQL = """p AS (SELECT user_id % 40 AS trial, event_id AS seq, CASE WHEN event_id % 3 <> 0 THEN round(value) / 100 END AS loss, CASE WHEN event_id % 2 = 0 THEN (round(value) % 60) / 100 END AS eval_loss FROM events)"""


def trainer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainer output: JSON lines, Python dicts and noise."""
    k = F.col("event_id")
    loss = F.when(k % 3 != 0, F.concat(F.lit("'loss': "), (F.round("value") / 100).cast("string"), F.lit(", ")))
    eval_ = F.when(k % 2 == 0, F.concat(F.lit("'eval_loss': "), (F.round("value") % 60 / 100).cast("string"), F.lit(", ")))
    body = F.concat(F.lit("{"), F.coalesce(loss, F.lit("")), F.coalesce(eval_, F.lit("")), F.lit("'step': 1}"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("trial"), k.alias("seq"), F.when(k % 4 == 0, F.replace(body, F.lit("'"), F.lit('"'))).when(loss.isNull() & eval_.isNull(), "warming up").otherwise(body).alias("line"))


EVALS_SQL = LINES_SQL + """, f AS (SELECT *, last_value(loss IGNORE NULLS) OVER (PARTITION BY trial ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM p),
    e AS (SELECT *, lag(eval_loss) OVER (PARTITION BY trial ORDER BY seq) AS was FROM f WHERE eval_loss IS NOT NULL),
    n AS (SELECT *, row_number() OVER w AS no, min(eval_loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best, eval_loss - t AS gap FROM e WHERE was IS NULL OR was <> eval_loss WINDOW w AS (PARTITION BY trial ORDER BY seq)),
    g AS (SELECT *, lag(gap) OVER w AS pg, first_value(gap IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fg FROM n WINDOW w AS (PARTITION BY trial ORDER BY seq)),
    r AS (SELECT trial, seq, best, CASE WHEN no >= 2 AND gap > pg AND gap > fg THEN 'divergence' WHEN best > 0.3 THEN 'cross_trial' END AS rule FROM g)"""


@query(f"WITH {EVALS_SQL} SELECT trial, seq, rule, best FROM r WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trial ORDER BY seq) = 1")
def curve_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.early_stops(curves.parse_metric_lines(trainer_lines(spark, sf_dir)), 0.3)


@query(f"WITH {LINES_SQL} SELECT trial, last(loss ORDER BY seq) FILTER (loss IS NOT NULL) AS loss, last(eval_loss ORDER BY seq) FILTER (eval_loss IS NOT NULL) AS eval_loss, min(eval_loss) AS best_eval FROM p GROUP BY trial")
def curve_last_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.last_metrics(curves.parse_metric_lines(trainer_lines(spark, sf_dir)))


TRIALS_SQL = "t AS (SELECT s_nationkey AS study, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS number, CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS value FROM supplier)"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("study"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("number"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal")).alias("value"))


@query(f"""
    WITH {TRIALS_SQL}, c AS (SELECT *, min(value) OVER (PARTITION BY study ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t), x AS (SELECT *, coalesce(value < coalesce(b, 'inf'::DOUBLE), false) AS better FROM c),
    y AS (SELECT *, lag(better) OVER (PARTITION BY study ORDER BY number) AS pb FROM x), s AS (SELECT study, min(number) FILTER (NOT better AND pb IS NOT NULL AND NOT pb) AS stopped_at FROM y GROUP BY study)
    SELECT study, stopped_at::INT AS stopped_at, (arg_min(number, value) FILTER (number <= coalesce(stopped_at, 1000000)))::INT AS best_number FROM x JOIN s USING (study) GROUP BY study, stopped_at""")
def curve_study_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.study_stop(trials(spark, sf_dir))


@query(f"WITH {TRIALS_SQL} SELECT study, number::INT AS number, value, min(value) OVER (PARTITION BY study ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cross_trial_best FROM t")
def curve_cross_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.cross_trial_best(trials(spark, sf_dir))


@query(f"WITH {LOG_SQL}, d AS (SELECT run_id, iteration, v - lag(v) OVER (PARTITION BY run_id ORDER BY iteration) AS delta FROM log) SELECT run_id, iteration::INT AS iteration, round(delta, 6) AS delta, CASE WHEN delta > 0.001 THEN 'up' WHEN delta < -0.001 THEN 'down' WHEN delta IS NOT NULL THEN 'flat' END AS direction FROM d")
def curve_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.deltas(log(spark, sf_dir)).select("run_id", "iteration", "delta", "direction"), "delta")


@query("""
    WITH a AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation)
    SELECT k, (CASE WHEN abs(1 - greatest(1, round_even((k + 1) / (r + 1), 0))) <= least(abs(2 - greatest(1, round_even((k + 1) / (r + 1), 0))), abs(4 - greatest(1, round_even((k + 1) / (r + 1), 0)))) THEN 1 WHEN abs(2 - greatest(1, round_even((k + 1) / (r + 1), 0))) <= abs(4 - greatest(1, round_even((k + 1) / (r + 1), 0))) THEN 2 ELSE 4 END)::INT AS ratio,
        CASE WHEN k % 2 = 0 THEN 'default → ' || k ELSE r || ' → ' || k END AS diff FROM a""")
def curve_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    before = F.when(k % 2 == 0, F.create_map(F.lit("other"), F.lit("x"))).otherwise(F.create_map(F.lit("rank"), r.cast("string")))
    return table(spark, sf_dir, "nation").select(k.alias("k"), curves.seed_alpha_ratio(k + 1, r + 1).alias("ratio"), F.element_at(curves.override_diff(F.create_map(F.lit("rank"), k.cast("string")), before), "rank").alias("diff"))


@query("SELECT trial, seq FROM (SELECT user_id % 40 AS trial, event_id AS seq FROM events) QUALIFY row_number() OVER (PARTITION BY trial ORDER BY seq DESC) <= 15")
def curve_line_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.line_tail(trainer_lines(spark, sf_dir)).select("trial", "seq")


@query("SELECT n_regionkey AS run_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY part, title))::INT AS step, title, status FROM (SELECT n_regionkey, 1 AS part, n_name AS title, 'ok' AS status FROM nation UNION ALL SELECT r_regionkey, 2, r_name, 'warn' FROM region)")
def curve_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda df, key, name, part, status: df.select(F.col(key).alias("run_id"), F.lit(part).alias("part"), F.col(name).alias("title"), F.lit("").alias("decision"), F.lit("").alias("reason"), F.lit(status).alias("status"))
    steps = curves.journal(shape(table(spark, sf_dir, "nation"), "n_regionkey", "n_name", 1, "ok"), shape(table(spark, sf_dir, "region"), "r_regionkey", "r_name", 2, "warn"))
    return steps.select("run_id", "step", "title", "status")


# ---------------------------------------------------------------- history, logs, files

RUNS_SQL = """runs AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Ann@X.org ' WHEN 2 THEN 'ann@x.org' ELSE 'bob@x.org' END AS owner, CASE o_orderstatus WHEN 'F' THEN 'trained' WHEN 'O' THEN 'trained_low_quality' ELSE 'error' END AS status, o_orderpriority AS task, CASE WHEN o_orderkey % 3 = 0 THEN 'bleu4' END AS pm, o_totalprice AS price, o_orderdate AS at FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    owner = F.when(k % 4 == 0, None).when(k % 4 == 1, " Ann@X.org ").when(k % 4 == 2, "ann@x.org").otherwise("bob@x.org")
    metrics_ = F.create_map(F.lit("rouge1"), F.col("o_totalprice"), F.lit("bleu4"), F.col("o_totalprice") / 2)
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("job_id"), owner.alias("owner_email"), F.when(s == "F", "trained").when(s == "O", "trained_low_quality").otherwise("error").alias("status"), F.col("o_orderpriority").alias("task"), F.lit(None).cast("string").alias("domain"), F.lit("m").alias("model_id"), F.when(k % 3 == 0, "bleu4").alias("primary_metric"), metrics_.alias("metrics"), F.col("o_orderdate").alias("created_at"))


@query(f"WITH {RUNS_SQL} SELECT job_id::VARCHAR AS job_id, lower(trim(owner)) AS owner_email, coalesce(pm, 'rouge1') AS primary_metric, round(CASE WHEN pm = 'bleu4' THEN price / 2 ELSE price END, 4) AS primary_metric_value FROM runs WHERE lower(trim(owner)) = 'ann@x.org'")
def history_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.run_list(runs(spark, sf_dir), "ANN@x.org").select("job_id", "owner_email", "primary_metric", "primary_metric_value"), "primary_metric_value", to=4)


@query(f"WITH {RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'trained') AS succeeded, count(*) FILTER (status = 'trained_low_quality') AS limited, count(*) FILTER (status IN ('blocked', 'error')) AS failed FROM runs WHERE contains(job_id::VARCHAR, 'urgent') OR contains(lower(task), 'urgent')")
def history_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.run_counters(history.search_runs(runs(spark, sf_dir), "URGENT"))


@query("SELECT o_orderkey::VARCHAR AS job_id, CASE o_orderkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'unknown' END AS outcome FROM orders")
def history_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "orders").where("o_orderkey % 3 < 2").select(F.col("o_orderkey").cast("string").alias("job_id"), (F.col("o_orderkey") % 3 == 0).alias("success"))
    return history.run_outcome(runs(spark, sf_dir).select("job_id"), reports)


@query("""
    WITH l AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{"__confirm__": true}' WHEN 1 THEN '{"__decision__": {"a": 1}}' WHEN 2 THEN '{"__confirm__": false}' WHEN 3 THEN '{broken __confirm__' WHEN 4 THEN '__run_done__' WHEN 5 THEN 'Task FAILED' WHEN 6 THEN 'warning: done' WHEN 7 THEN 'Entraînement terminé ✓' ELSE '12:00:00 ERROR x' END AS line FROM events)
    SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'confirm' WHEN event_id % 9 = 1 THEN 'decision' WHEN event_id % 9 = 4 THEN 'done' ELSE 'log' END AS route, CASE WHEN regexp_matches(lower(line), 'error|failed|exception') THEN 'error' WHEN contains(lower(line), 'warn') THEN 'warn' WHEN regexp_matches(lower(line), 'done|finish|success|✓') THEN 'success' ELSE 'info' END AS level,
        CASE WHEN event_id % 9 = 7 THEN 'Entraînement terminé' ELSE 'Étape pipeline' END AS title, event_id % 9 = 8 AS in_summary FROM l""")
def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 9
    shown = ['{"__confirm__": true}', '{"__decision__": {"a": 1}}', '{"__confirm__": false}', "{broken __confirm__", "__run_done__", "Task FAILED", "warning: done", "Entraînement terminé ✓", "12:00:00 ERROR x"]
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in shown]), (k + 1).cast("int")).alias("line"))
    return e.select("event_id", history.route_event("line").alias("route"), history.log_level("line").alias("level"), history.step_title("line").alias("title"), history.log_filter("line", "summary").alias("in_summary"))


@query("SELECT count(*) FILTER (event_type = 'click') AS ok, count(*) FILTER (event_type = 'purchase') AS warn, count(*) FILTER (event_type = 'view') AS err, count(*) FILTER (event_type NOT IN ('click', 'purchase', 'view')) AS info FROM events")
def history_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return history.status_counts(table(spark, sf_dir, "events").select(F.when(t == "click", "ok").when(t == "purchase", "warn").when(t == "view", "err").otherwise("info").alias("status")))


@query("""
    SELECT p_partkey, 'BLEU-4 = ' || printf('%.3f', (p_size / 50)::DOUBLE) || CASE WHEN p_partkey % 2 = 1 THEN ' | ROUGE-L = 0.500' ELSE '' END || ' | F1-token = 0.250' AS line, CASE WHEN p_size / 50 >= 0.14 THEN 'ok' WHEN p_size / 50 >= 0.05 THEN 'warn' ELSE 'err' END AS colour, round(least(100, p_size / 50 / 0.35 * 100), 1) AS fill, 40.0::DOUBLE AS good_fill FROM part""")
def history_metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_size") / 50
    m = F.create_map(F.lit("bleu4"), v, F.lit("rougeL"), F.when(F.col("p_partkey") % 2 == 1, 0.5).otherwise(0.0), F.lit("f1_token"), F.lit(0.25))
    return table(spark, sf_dir, "part").select("p_partkey", history.metric_line(m, F.lit("bleu4")).alias("line"), history.metric_bar(F.lit("bleu4"), v).alias("b")).select("p_partkey", "line", "b.*")


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS fatal FROM orders")
def history_fatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, "main: Unrecognized Arguments: --x").when(F.col("o_orderkey") % 3 == 1, "out of memory")
    return table(spark, sf_dir, "orders").select("o_orderkey", history.is_fatal(text).alias("fatal"))


@query("""SELECT '{"o_orderkey":' || o_orderkey || ',"x":{"d":"' || o_orderstatus || '"},"l":[{"d":1}]}' AS result FROM orders""")
def history_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with messages on every level."""
    said = F.lit("m").alias("messages")
    return history.sanitised(table(spark, sf_dir, "orders").select("o_orderkey", said, F.struct(said, F.col("o_orderstatus").alias("d")).alias("x"), F.array(F.struct(F.lit(1).alias("d"), said)).alias("l")))


KIND_ENDINGS = ["CSV", "pdf", "txt", "xlsx", "xlsm", "docx"]


@query("""
    WITH f AS (SELECT doc_id, url, text FROM (SELECT doc_id, 'dir.v' || doc_id || '/' || source || CASE doc_id % 7 WHEN 0 THEN '.CSV' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.xlsm' WHEN 5 THEN '.docx' ELSE '' END AS url, text FROM documents)),
    k AS (SELECT doc_id, text, lower(split_part(url, '.', -1)) AS e, contains(split_part(url, '/', -1), '.') AS named FROM f)
    SELECT doc_id, CASE WHEN NOT named THEN NULL WHEN e = 'csv' THEN 'csv' WHEN e = 'pdf' THEN 'pdf' WHEN e = 'txt' THEN 'txt' WHEN e IN ('xlsx', 'xls', 'xlsm') THEN 'excel' END AS kind, least(7200, greatest(1800, length(text) * 10000 / 5000))::DOUBLE AS timeout FROM k""")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file that is named by its source, with endings in turn."""
    k = (F.col("doc_id") % 7).cast("int")
    ending = F.when(k < len(KIND_ENDINGS), F.concat(F.lit("."), F.get(F.array(*map(F.lit, KIND_ENDINGS)), k))).otherwise("")
    path = F.concat(F.lit("dir.v"), F.col("doc_id").cast("string"), F.lit("/"), "source", ending)
    return table(spark, sf_dir, "documents").select("doc_id", files.file_kind_or_null(path).alias("kind"), files.extraction_timeout(F.length("text") * 10000).alias("timeout"))


@query("""
    WITH f AS (SELECT doc_id // 20 AS file, string_agg(text, chr(10) ORDER BY doc_id, text) AS text FROM documents GROUP BY 1),
    k AS (SELECT *, regexp_matches(text, '[^\\x00-\\x7F]') AS high, regexp_matches(text, '[^\\x00-\\x{FF}]') AS wide FROM f)
    SELECT file, CASE WHEN file % 3 = 0 THEN 'UTF-16' WHEN file % 3 = 1 AND high AND NOT wide THEN 'windows-1252' ELSE 'UTF-8' END AS charset, md5(text) AS text_md5 FROM k""")
def source_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of twenty documents each in three character sets, found and decoded again."""
    joined_texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n")
    each = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("file")).agg(joined_texts.alias("text"))
    wide = F.col("text").rlike(r"[^\x00-\xFF]")
    content = F.when(F.col("file") % 3 == 0, F.encode("text", "UTF-16")).when((F.col("file") % 3 == 1) & ~wide, F.encode(F.when(~wide, F.col("text")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    written = each.select("file", content.alias("content"))
    return written.select("file", files.charset_name("content").alias("charset"), F.md5(F.encode(files.decode_text("content"), "UTF-8")).alias("text_md5"))


@query("""
    WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'nul_bytes' WHEN 2 THEN 'executable' WHEN 3 THEN 'ok' WHEN 4 THEN 'no_pdf_mark' ELSE 'no_zip_mark' END AS p FROM documents)
    SELECT doc_id, nullif(p, 'ok') AS problem FROM f""")
def source_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    ending = F.when(k <= 2, "x.txt").when(k <= 4, "x.pdf").otherwise("x.docx")
    start = F.when(k == 1, F.unhex(F.lit("4100"))).when(k == 2, F.unhex(F.lit("4D5A"))).when(k == 3, F.encode(F.lit("..%PDF-1.4"), "UTF-8")).otherwise(F.encode(F.lit("A"), "UTF-8"))
    f = table(spark, sf_dir, "documents").select("doc_id", ending.alias("path"), F.concat(start, F.encode("text", "UTF-8")).alias("content"))
    return f.select("doc_id", files.signature_problem("path", "content").alias("problem"))


@query("SELECT count(*) FILTER (event_id % 4 < 2) AS valid, count(*) FILTER (event_id % 4 = 2) AS malformed, count(*) FILTER (event_id % 4 = 3) AS blank FROM events")
def source_json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    return files.count_rejects(table(spark, sf_dir, "events").select(F.when(k < 2, F.col("props")).when(k == 2, F.concat(F.lit("{"), "props")).otherwise(F.lit("  ")).alias("value")))


@query(f"""
    WITH w AS (SELECT doc_id, lang, text, len({split_words('text')}) AS n, (length(text) - length(regexp_replace(text, '[\\p{{C}}\\p{{Z}}]', '', 'g')) - (length(text) - length(regexp_replace(text, '[\\n\\t ]', '', 'g')))) / length(text) AS g FROM documents),
    b AS (SELECT doc_id, coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS b FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, {strip('part')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM documents)) WHERE line <> '' GROUP BY ALL) GROUP BY doc_id),
    s AS (SELECT doc_id, {sentence_list('text', 6)} AS s, {split_words('lower(text)')}[1:500] AS lw, length({strip('text')}) < 50 AS short FROM documents),
    q AS (SELECT doc_id, CASE WHEN short THEN 0 ELSE 1 - CASE WHEN len(list_distinct(lw)) / len(lw) < 0.3 THEN 0.3 ELSE 0 END - CASE WHEN len(s) > 0 AND len(list_filter(s, lambda x: len({split_words('x')}) < 5)) / len(s) > 0.5 THEN 0.2 ELSE 0 END
        - CASE WHEN len(s) = 0 OR list_sum(list_transform(s, lambda x: len({split_words('x')}))) / len(s) < 5 THEN 0.2 ELSE 0 END - CASE WHEN len(s) < 5 THEN 0.2 ELSE 0 END END AS score FROM s)
    SELECT lang, count(*) AS documents, round(avg(score), 6)::DOUBLE AS mean_suitability, count(*) FILTER (n = 0 OR g > 0.3) AS blocked, count(*) FILTER (n > 0 AND g <= 0.3 AND (g > 0.2 OR coalesce(b, 0) > 0.5)) AS warned FROM w JOIN q USING (doc_id) LEFT JOIN b USING (doc_id) GROUP BY lang""")
def prepare_quality_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.quality_by(table(spark, sf_dir, "documents"), "lang")
