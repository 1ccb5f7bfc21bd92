"""Training records, splits and reports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import col, ws_strip

BATCH_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
# Record formats by task, parts of model names, instructions of summaries.
TASK_FORMATS = {
    "question-answering": "alpaca",
    "conversational-qa": "sharegpt",
    "classification": "alpaca_label",
    "text-classification": "alpaca_label",
    "sentiment-analysis": "alpaca_label",
    "instruction-following": "alpaca",
    "translation": "alpaca",
    "code-generation": "alpaca",
}
SEQ2SEQ_NAMES = "t5 bart pegasus flan mt5 mbart opus led".split()
CHAT_NAMES = "mistral llama qwen phi gemma chatglm deepseek solar falcon vicuna intern yi baichuan".split()
SUMMARY_INSTRUCTIONS = [
    "Résume ce texte en quelques phrases claires et concises.",
    "Donne un résumé concis de ce passage en 3 à 5 phrases.",
    "En quelques phrases, résume les idées principales de ce texte.",
    "Fournis un résumé synthétique de ce passage.",
]
SYSTEM_PROMPT = "You are a helpful assistant."


def record_format(task: Column | str, model: Column | str) -> Column:
    """seq2seq, chat or alpaca for summaries, by the model's name; else the task's format; alpaca if unknown."""
    name = F.lower(F.coalesce(col(model), F.lit("")))
    summary = F.when(name.rlike("|".join(SEQ2SEQ_NAMES)), "seq2seq").when(name.rlike("|".join(CHAT_NAMES)), "chat").otherwise("alpaca")
    known = reduce(lambda acc, kv: acc.when(col(task) == kv[0], F.lit(kv[1])), TASK_FORMATS.items(), F.when(col(task) == "summarization", summary))
    return known.otherwise(F.lit("alpaca"))


def export_records(pairs: DataFrame, task: str = "question-answering", model: str = "", order: str = "pair_id", system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """(order, format, record): each pair as a JSON record. Instructions of summaries rotate by the pair's number."""
    q, a = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))
    fmt = record_format(F.lit(task), F.lit(model))
    turn = F.element_at(F.array(*[F.lit(x) for x in SUMMARY_INSTRUCTIONS]), (F.pmod(F.col(order), F.lit(len(SUMMARY_INSTRUCTIONS))) + 1).cast("int"))
    message = lambda who, text, k1, k2: F.struct(who.alias(k1), text.alias(k2))
    shapes = {
        "seq2seq": F.struct(q.alias("document"), a.alias("summary")),
        "chat": F.struct(F.array(message(F.lit("user"), F.concat(turn, F.lit("\n\n"), q), "role", "content"), message(F.lit("assistant"), a, "role", "content")).alias("messages")),
        "sharegpt": F.struct(F.array(*[message(F.lit(who), text, "from", "value") for who, text in (("system", F.lit(system_prompt)), ("human", q), ("gpt", a))]).alias("conversations")),
        "plain": F.struct((turn if task == "summarization" else q).alias("instruction"), (q if task == "summarization" else F.lit("")).alias("input"), a.alias("output")),
    }
    record = reduce(lambda acc, k: acc.when(fmt == k, F.to_json(shapes[k])), ("seq2seq", "chat", "sharegpt"), F.when(F.lit(False), F.lit(""))).otherwise(F.to_json(shapes["plain"]))
    return pairs.select(order, fmt.alias("format"), record.alias("record"))


def evaluation_pair(record: Column | str) -> Column:
    """struct<prompt,reference> of a JSON record in any of the formats."""
    r = lambda path: F.get_json_object(col(record), path)
    prompt = F.coalesce(r("$.document"), r("$.messages[0].content"), r("$.conversations[1].value"), F.when(F.coalesce(r("$.input"), F.lit("")) == "", r("$.instruction")).otherwise(F.concat_ws("\n\n", r("$.instruction"), r("$.input"))))
    return F.struct(prompt.alias("prompt"), F.coalesce(r("$.summary"), r("$.messages[1].content"), r("$.conversations[2].value"), r("$.output")).alias("reference"))


def assign_splits(df: DataFrame, key: str, seed: str = "split") -> DataFrame:
    """`df` with `split`: a tenth (one row at least) each for val and test, by md5 order; all train under three rows.

    Rows are numbered in md5 order without a sort in one task: by counts of the hash's first digits, then within each.
    """
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))
    hashed = df.withColumn("__h", h).withColumn("__g", F.left("__h", F.lit(3)))
    sizes = hashed.groupBy("__g").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__g", (F.sum("n").over(Window.orderBy("__g")) - F.col("n")).alias("__before"))
    total = sizes.agg(F.sum("n").alias("__n"))
    inside = F.row_number().over(Window.partitionBy("__g").orderBy("__h", key))
    placed = hashed.join(F.broadcast(before), "__g").crossJoin(F.broadcast(total)).withColumn("__at", F.col("__before") + inside)
    part = F.greatest(F.lit(1), F.floor(F.col("__n") / 10))
    split = F.when(F.col("__n") < 3, "train").when(F.col("__at") <= part, "val").when(F.col("__at") <= 2 * part, "test").otherwise("train")
    return placed.withColumn("split", split).drop("__h", "__g", "__before", "__n", "__at")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def write_splits(records: DataFrame, folder: str) -> DataFrame:
    """Write records (record, split) as JSON lines in a folder per split, and all of them as the dataset; returns the counts."""
    records.select("record").write.mode("overwrite").text(f"{folder}/dataset")
    records.select("record", "split").write.mode("overwrite").partitionBy("split").text(f"{folder}/splits")
    return split_counts(records)


def append_json_lines(df: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append rows as JSON lines: plainly, or as one batch that is there once and whole or not at all (`append_batch`)."""
    if batch is None:
        df.write.mode("append").option("ignoreNullFields", "false").json(folder)
    else:
        append_batch(df, folder, batch)


def append_batch(df: DataFrame, folder: str, batch: str) -> bool:
    """Append `df` to a table of batches; False if this batch is there already.

    The rows are staged as files of this attempt, which no reader looks at. One rename then puts the batch's manifest in
    place, which names them; that of another attempt that was quicker stays. So a job that is killed at any point
    leaves no rows, and one that is repeated leaves each row once.
    """
    if not BATCH_NAME.fullmatch(batch):
        raise ValueError(f"a batch is named by letters, digits, dots, underscores and dashes: {batch!r}")
    spark = df.sparkSession
    manifest = f"{folder}/commits/{batch}.json"
    if _exists(spark, manifest):
        return False
    data = f"batches/{batch}-{uuid.uuid4().hex}"
    df.write.option("ignoreNullFields", "false").json(f"{folder}/{data}")
    return _commit(spark, f"{folder}/commits", manifest, json.dumps({"batch": batch, "data": data}))


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def _commit(spark: SparkSession, folder: str, manifest: str, body: str) -> bool:
    """Put the manifest in place by a rename that never replaces one; False if there is one."""
    own = f"{folder}/.{uuid.uuid4().hex}"
    files, at = _files(spark, own)
    out = files.create(at, False)
    out.write(bytearray(body.encode() + b"\n"))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    target = files.makeQualified(hadoop.Path(manifest))
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(at), target, none)
        return True
    except Py4JJavaError:
        if not _exists(spark, manifest):
            raise
        files.delete(at, False)
        return False


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, data) of the batches that are committed."""
    if not _exists(spark, f"{folder}/commits"):
        return spark.createDataFrame([], "batch string, data string")
    return spark.read.schema("batch string, data string").json(f"{folder}/commits")


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all committed batches, and of nothing else."""
    paths = [f"{folder}/{r['data']}" for r in batches(spark, folder).collect()]  # one a batch
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def clear_attempts(spark: SparkSession, folder: str) -> int:
    """Delete the files of attempts that were not committed, when no job is appending; returns how many attempts there were."""
    files, at = _files(spark, f"{folder}/batches")
    if not files.exists(at):
        return 0
    known = {r["data"].rsplit("/", 1)[-1] for r in batches(spark, folder).collect()}
    left = [x.getPath() for x in files.listStatus(at) if x.getPath().getName() not in known]
    for path in left:
        files.delete(path, True)
    return len(left)


def write_json_document(df: DataFrame, path: str) -> None:
    """The one row of `df` as one JSON file in a folder."""
    df.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def corpus_text(cleaned: Column, raw: Column, full: Column, rows: Column) -> Column:
    """The first of a file's texts that is not blank."""
    filled = lambda c: F.when(ws_strip(c) != "", c)
    return F.coalesce(filled(cleaned), filled(raw), filled(full), filled(rows))


def merged_corpus(files: DataFrame) -> DataFrame:
    """(filename, chars, section): each file's text under its header, in the order in which they are joined; files without text are left out."""
    text = corpus_text(F.col("cleaned"), F.col("raw"), F.col("full"), F.col("rows"))
    rule = "=" * 60
    head = F.concat(F.lit(rule + "\n=== SOURCE : "), F.col("filename"), F.lit(" ===\n" + rule + "\n\n"))
    return files.withColumn("text", text).where("text IS NOT NULL").select("filename", F.length("text").alias("chars"), F.concat(head, F.col("text")).alias("section"))


def write_corpus(files: DataFrame, folder: str) -> DataFrame:
    """The sections as text files in filename order; returns the characters per source."""
    sections = merged_corpus(files)
    sections.repartitionByRange("filename").sortWithinPartitions("filename").select("section").write.mode("overwrite").option("lineSep", "\n\n").text(folder)
    return sections.select("filename", "chars")


def dataset_preview(records: DataFrame, order: str, k: int = 5) -> DataFrame:
    """The first rows of a dataset (order, record) with its format: sharegpt if any has `conversations`."""
    first = records.orderBy(order).limit(k)
    fmt = F.when(F.bool_or(F.get_json_object("record", "$.conversations").isNotNull()).over(Window.partitionBy(F.lit(1))), "sharegpt").otherwise("alpaca")
    return first.withColumn("format", fmt)


def merged_report(jobs: DataFrame, training: DataFrame, evaluation: DataFrame, journal: DataFrame) -> DataFrame:
    """One row per job with its three optional reports, each a struct or null."""
    out = jobs.select("job_id")
    for name, df in (("training", training), ("evaluation", evaluation), ("journal", journal)):
        packed = df.select("job_id", F.struct(*[c for c in df.columns if c != "job_id"]).alias(name))
        out = out.join(packed, "job_id", "left")
    return out


def iter_records(records: DataFrame) -> Iterator[str]:
    """Records one by one, a partition at a time on the driver, for a consumer outside Spark."""
    return (r["record"] for r in records.select("record").toLocalIterator())
