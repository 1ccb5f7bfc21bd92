"""Files: kinds, signatures, texts, tables, JSON lines, run folders."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import charsets
from corvane.functions.text import col

# File kinds by ending, delimiters in the order in which they are tried, first bytes of formats.
KINDS = {"csv": "csv", "pdf": "pdf", "txt": "txt", "xlsx": "excel", "xls": "excel", "xlsm": "excel"}
DELIMITERS = [",", ";", "\t", "|"]
ZIP_STARTS = ["504B0304", "504B0506", "504B0708"]
PDF_MARK, EXE_START, ELF_START = "%PDF-", "4D5A", "7F454C46"


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./\\]+)$", 1))


def file_kind(path: Column | str) -> Column:
    """csv, pdf, txt or excel; raises for other endings."""
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.raise_error(F.concat(F.lit("unsupported file type: "), col(path))).cast("string"))


def file_kind_or_null(path: Column | str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), extension(path))


def signature_problem(path: Column | str, content: Column | str) -> Column:
    """Why a file's first bytes do not fit its ending, or null."""
    ext, head = extension(path), F.substring(col(content), 1, 512)
    digits = F.hex(head)
    nul = digits.rlike("^(..)*?00")
    starts = lambda x: F.startswith(digits, F.lit(x))
    pdf = F.hex(F.substring(col(content), 1, 1024)).rlike("^(..)*?" + PDF_MARK.encode().hex().upper())
    zipped = F.exists(F.array(*[F.lit(z) for z in ZIP_STARTS]), lambda z: F.startswith(digits, z))
    # The 512 bytes may end inside a character, so up to three may be missing.
    utf8 = F.exists(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.is_valid_utf8(F.substring(head, F.lit(1), F.length(head) - F.when(F.length(head) == 512, i).otherwise(0)).cast("string")))
    return (
        F.when((ext == "pdf") & ~pdf, "no_pdf_mark")
        .when((ext == "docx") & ~zipped, "no_zip_mark")
        .when(ext.isin("txt", "csv") & nul, "nul_bytes")
        .when((ext == "txt") & starts(EXE_START), "executable")
        .when((ext == "txt") & starts(ELF_START), "executable")
        .when((ext == "txt") & ~utf8, "not_utf8")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, modificationTime of the files under a path."""
    return spark.read.format("binaryFile").load(path)


def encoding_of(start: bytes, cut: bool = True) -> str:
    """The character set of a file's bytes (`charsets.detect`); UTF-8 and UTF-16 by their usual names."""
    found = charsets.detect(start, cut)
    return found.upper() if found.startswith("utf") else found


@F.pandas_udf(T.StringType())
def decode_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as text, by the character set of the whole."""
    for s in batches:
        yield s.map(lambda b: None if b is None else charsets.decode(bytes(b)))


@F.pandas_udf(T.StringType())
def charset_name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The character set of bytes."""
    for s in batches:
        yield s.map(lambda b: None if b is None else encoding_of(bytes(b), cut=False))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of whole text files."""
    return read_files(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), decode_text("content").alias("text"))


HEAD_LINES, HEAD_BYTES = 200, 1 << 16
#: Sets that Spark reads itself; files in others are read byte for byte and decoded by column.
READ_BY_SPARK = {"UTF-8", "UTF-16", "UTF-16-LE", "UTF-16-BE", "UTF-32", "ISO-8859-1"}


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def _bytes_of(lines: DataFrame) -> bytes:
    found = lines.limit(HEAD_LINES).select(F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES).alias("value")).collect()  # bounded
    return b"\n".join(bytes(r["value"]) for r in found)[:HEAD_BYTES]


def file_head(spark: SparkSession, path: str) -> bytes:
    """The bytes of a file's first lines; nothing else of it reaches the driver."""
    return _bytes_of(file_lines(spark, path))


def file_evidence(spark: SparkSession, path: str) -> bytes:
    """The bytes of the first lines, and of lines anywhere that hold bytes beyond ASCII, where the first ones don't."""
    head = file_head(spark, path)
    return head if not head.isascii() else head + b"\n" + _bytes_of(file_lines(spark, path).where(F.col("value").rlike(r"[^\x00-\x7F]")))


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell spans lines: then some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not file_lines(spark, path).where(quotes % 2 == 1).isEmpty()


def decoded(c: Column, charset: str) -> Column:
    """Text that was read byte for byte, as ISO-8859-1, in its own character set: by single bytes inside Spark, else in Arrow batches."""
    if charset in charsets.MULTI_BYTE:

        @F.pandas_udf(T.StringType())
        def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda x: x if x is None or x.isascii() else x.encode("latin-1", "replace").decode(charsets.codec(charset), "replace"))

        return whole(c)
    return F.translate(c, *_single_bytes(charset))


def _single_bytes(charset: str) -> tuple[str, str]:
    other = {chr(b): bytes([b]).decode(charsets.codec(charset), "ignore") for b in range(0x80, 0x100)}
    old, new = ("".join(x) for x in zip(*[(a, b) for a, b in other.items() if b], strict=True))
    return old, new


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, infer: bool = True) -> DataFrame:
    """A delimited table by the delimiter that gives its header most columns (two at least; the first tried wins ties); bad cells are null, long rows cut.

    Without a given encoding, the file's first lines tell it, or those anywhere that are no ASCII. A quoted header may span
    lines; a file is read as one part only if it has cells that do, or two or four bytes a character. In a multi-byte set
    `|` and a character's second byte can be one and the same: other delimiters are safe.
    """
    head = file_head(spark, path)
    encoding = encoding or encoding_of(file_evidence(spark, path))
    wide = encoding.upper().startswith(("UTF-16", "UTF-32"))
    header = charsets.decode(head, encoding.lower())
    if not header.strip():
        raise ValueError(f"no delimiter fits {path}: it is empty")
    widths = {d: len(next(csv.reader(io.StringIO(header), delimiter=d))) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: widths[d])
    if widths[best] < 2:
        raise ValueError(f"no delimiter fits {path}")
    own = encoding.upper() not in READ_BY_SPARK
    spark_name = "ISO-8859-1" if own else {"UTF-16-LE": "UTF-16LE", "UTF-16-BE": "UTF-16BE"}.get(encoding.upper(), encoding)
    found = spark.read.csv(path, sep=best, header=True, inferSchema=infer, encoding=spark_name, mode="PERMISSIVE", quote='"', escape='"', multiLine=wide or has_quoted_breaks(spark, path), samplingRatio=None)
    if not own:
        return found
    charset = encoding.lower()
    name = lambda c: c.encode("latin-1", "replace").decode(charsets.codec(charset), "replace")
    return found.select(*[(decoded(F.col(f"`{f.name}`"), charset) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(name(f.name)) for f in found.schema.fields])


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank and malformed ones are left out."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def count_rejects(lines: DataFrame, line: str = "value") -> DataFrame:
    """One row: lines that are valid JSON, malformed, and blank."""
    blank = F.trim(F.col(line)) == ""
    ok = F.try_parse_json(line).isNotNull()
    return lines.agg(F.count_if(~blank & ok).alias("valid"), F.count_if(~blank & ~ok).alias("malformed"), F.count_if(blank).alias("blank"))


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document of a folder, corrupt ones left out, with its filename; order by it."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path).withColumn("filename", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def read_trainer_states(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, checkpoint, pos, step, epoch, loss, eval_loss) of every trainer_state.json below root, at any depth; corrupt files are left out."""
    schema = "log_history array<struct<step:double,epoch:double,loss:double,eval_loss:double>>"
    found = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "trainer_state.json").json(root)
    path = F.col("_metadata.file_path")
    named = found.select(F.regexp_extract(path, r"([^/]+)/(?:[^/]+/)*checkpoint-\d+/trainer_state\.json$", 1).alias("run_id"), F.regexp_extract(path, r"(checkpoint-\d+)/", 1).alias("checkpoint"), F.posexplode("log_history").alias("pos", "e"))
    return named.where("checkpoint <> ''").select("run_id", "checkpoint", "pos", "e.*")


def read_run_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Final outputs of all runs below root with created_at, for run_list."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "final_output.json").json(root).withColumn("created_at", F.col("_metadata.file_modification_time"))


def extraction_timeout(size_bytes: Column, most: int = 7200) -> Column:
    """Seconds for extracting a document of so many bytes."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(1800.0), size_bytes / 5000))


def extract_documents(files: DataFrame, extractor: Callable[[bytes], str] | None, fallback: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text, flags) by an injected extractor, which runs in the tasks; a failure takes the fallback, then an empty text with a flag."""
    if extractor is None:
        raise ValueError("an extractor must be given: none is built in")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                text, flags = None, []
                for f, flag in ((extractor, None), (fallback, "fallback_extractor")):
                    if text is None and f is not None:
                        try:
                            text = f(content)
                            flags = [flag] if flag else []
                        except Exception as e:
                            flags = [f"extraction_failed:{type(e).__name__}"]
                rows.append((path, text or "", flags if text is not None else [*flags, "empty_extraction"]))
            yield pd.DataFrame(rows, columns=["path", "text", "flags"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, flags array<string>")


def reuse(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if all of it can be read, else (absent or damaged) made, written there and read."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        found = spark.read.parquet(path)
        found.write.format("noop").mode("overwrite").save()
        return found
    except (PySparkException, Py4JJavaError):
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """The model cards kept as a JSON table; they are not fetched."""
    return spark.read.option("multiLine", "true").json(path)
