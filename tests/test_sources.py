import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.operators import export
from corvane.plans import prepare
from corvane.sources import files, workbook


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_kinds(spark):
    assert [value(spark, files.file_kind(F.lit(p))) for p in ("/a/b.CSV", "x.pdf", "x.txt", "x.xlsm")] == ["csv", "pdf", "txt", "excel"]
    with pytest.raises(Exception, match="unsupported file type"):
        value(spark, files.file_kind(F.lit("a.docx")))


def test_signatures(spark):
    rows = [("a.pdf", b"..%PDF-1"), ("a.pdf", b"%PD"), ("a.docx", b"PK\x03\x04x"), ("a.docx", b"x"), ("a.txt", b"MZx"), ("a.txt", b"\x7fELF"), ("a.txt", b"a\x00"), ("a.txt", b"\xff\xfe"), ("a.txt", ("a" * 511 + "é").encode()), ("a.csv", b"\x00"), ("a.csv", b"MZ"), ("a.bin", b"\x00")]
    got = [r["p"] for r in spark.createDataFrame(rows, "path string, content binary").select(files.signature_problem("path", "content").alias("p")).collect()]
    assert got == [None, "no_pdf_mark", None, "no_zip_mark", "executable", "executable", "nul_bytes", "not_utf8", None, "nul_bytes", None, None]


def test_decoding(spark, tmp_path):
    for name, data in (("a.txt", "é".encode()), ("b.txt", b"\xe9"), ("c.txt", "é".encode("utf-16")), ("d.txt", b"\xef\xbb\xbfx"), ("e.txt", b"\x81\xff")):
        (tmp_path / name).write_bytes(data)
    got = {r["filename"]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "é", "b.txt": "é", "c.txt": "é", "d.txt": "x", "e.txt": "��"}


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text("\n".join([sep.join(["a", "b", "c"]), sep.join(["1", "x", "2.5"]), sep.join(["2", '"q"', "3.5", "extra"]), sep.join(["3"])]) + "\n")
    got = files.read_csv(spark, str(path))
    assert dict(got.dtypes) == {"a": "int", "b": "string", "c": "double"}
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, "x", 2.5), (2, "q", 3.5), (3, None, None)]


def test_one_column_is_refused(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="no delimiter"):
        files.read_csv(spark, str(tmp_path / "t.csv"))


def test_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    counts = files.count_rejects(spark.read.text(str(tmp_path / "x.jsonl"))).first()
    assert (counts.valid, counts.malformed, counts.blank) == (2, 1, 1)


def test_trainer_states_at_any_depth(spark, tmp_path):
    for run, depth, n, body in (("r1", "", 10, '{"log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval_loss": 0.4}]}'), ("r2", "hpo/trial_0/", 20, '{"log_history": [{"epoch": 1.0, "eval_loss": 0.3}]}'), ("r1", "", 11, "{corrupt")):
        d = tmp_path / run / depth / f"checkpoint-{n}"
        d.mkdir(parents=True)
        (d / "trainer_state.json").write_text(body)
    got = {(r["checkpoint"], r["pos"], r["loss"], r["eval_loss"]) for r in files.read_trainer_states(spark, str(tmp_path)).collect()}
    assert got == {("checkpoint-10", 0, 0.5, None), ("checkpoint-10", 1, None, 0.4), ("checkpoint-20", 0, None, 0.3)}


def test_run_results(spark, tmp_path):
    (tmp_path / "job1").mkdir()
    (tmp_path / "job1" / "final_output.json").write_text('{"job_id": "job1", "status": "trained"}')
    got = files.read_run_results(spark, str(tmp_path), "job_id string, status string").first()
    assert got["status"] == "trained" and got["created_at"] is not None


def test_extraction(spark):
    def fail(content):
        raise ValueError

    df = spark.createDataFrame([("a", b"x")], "path string, content binary")
    assert tuple(files.extract_documents(df, lambda b: b.decode()).first()) == ("a", "x", [])
    assert tuple(files.extract_documents(df, fail, lambda b: "y").first()) == ("a", "y", ["fallback_extractor"])
    assert tuple(files.extract_documents(df, fail).first()) == ("a", "", ["extraction_failed:ValueError", "empty_extraction"])
    with pytest.raises(ValueError, match="extractor"):
        files.extract_documents(df, None)
    assert [value(spark, files.extraction_timeout(F.lit(n))) for n in (1, 10**7, 10**9)] == [1800.0, 2000.0, 7200.0]


def test_reuse(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.reuse(spark, str(tmp_path / "p"), make).count() == 3
    assert len(calls) == 1


def book():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    row = lambda cells: "<row>" + "".join(f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{r}"><v>{v}</v></c>' for r, v in cells) + "</row>"
    one = "<row/>" + row([("A2", "name"), ("C2", "name")]) + row([("A3", "x"), ("B3", 1.5), ("C3", "y"), ("D3", "cut")]) + "<row/>" + row([("A5", "z"), ("B5", 2)])
    shared = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="S1" r:id="r1"/><sheet name="S2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{one}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>only</t></si></sst>")
    return out.getvalue()


def test_workbook(spark):
    rows = workbook.read_sheet_rows(spark.createDataFrame([("b.xlsx", book())], "path string, content binary"))
    tables, longest = workbook.workbook_tables(rows, "b.xlsx")
    assert list(tables) == ["S1"] and longest == "S1"  # one row is no table
    t = tables["S1"]
    assert t.columns == ["row_no", "name", "col_1", "name_1"] and dict(t.dtypes)["col_1"] == "double"
    assert [tuple(r)[1:] for r in t.orderBy("row_no").collect()] == [("x", 1.5, "y"), ("z", 2.0, None)]
    assert workbook.workbook_sample(tables).columns == ["_sheet", "name", "col_1", "name_1"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    for _ in range(2):
        export.append_json_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    export.write_json_document(df, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).first()["b"] == "é"
    corpus = spark.createDataFrame([("b", None, "raw", None, None), ("a", " ", None, "full", None), ("c", None, None, None, None)], "filename string, cleaned string, raw string, full string, rows string")
    assert {tuple(r) for r in export.write_corpus(corpus, str(tmp_path / "corpus")).collect()} == {("b", 3), ("a", 4)}


def test_prepare_end_to_end(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    with pytest.raises(ValueError, match="generate"):
        prepare.prepare(docs, None)

    def generate(chunks):
        return chunks.select(F.xxhash64("doc_id", "chunk_id").alias("pair_id"), F.left("text", F.lit(80)).alias("question"), F.right("text", F.lit(300)).alias("answer"), F.col("doc_id").cast("string").alias("source_file"), F.lit(0.9).alias("confidence"))

    out = prepare.prepare(docs, generate)
    assert out.verdict.first()["status"] in ("GO", "WARNING", "BLOCKED")
    n = out.records.count()
    assert 0 < n <= out.chunks.count() and {r["split"] for r in out.records.select("split").distinct().collect()} == {"train", "val", "test"}


@pytest.mark.parametrize("encoding", ["utf-8", "cp1252", "utf-8-sig", "utf-16"])
def test_csv_encoding_is_found(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes('"né\nle";"prix"\nété;3\nœuf;4\n'.encode(encoding))
    got = files.read_csv(spark, str(path))
    assert got.columns == ["né\nle", "prix"] and [tuple(r) for r in got.collect()] == [("été", 3), ("œuf", 4)]


def test_encodings_of_first_bytes():
    assert files.encoding_of(b"caf\xe9", cut=False) == "windows-1252"
    assert [files.encoding_of(x) for x in (b"", b"abc", "aé".encode()[:2], b"caf\xe9 au lait", b"\x81\xff\xff\x81", b"\xff\xfea\x00")] == ["UTF-8", "UTF-8", "UTF-8", "windows-1252", "UTF-8", "UTF-16"]


def test_a_damaged_table_is_made_again(spark, tmp_path):
    make = lambda: spark.range(5)
    folder = tmp_path / "p"
    assert files.reuse(spark, str(folder), make).count() == 5
    for f in folder.glob("*.parquet"):
        f.write_bytes(b"PAR1 broken")
    for f in folder.glob(".*.crc"):
        f.unlink()
    assert files.reuse(spark, str(folder), make).count() == 5


def test_folders_of_json_and_cards(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "b.json").write_text('{"a": 2}')
    (tmp_path / "j" / "a.json").write_text('{"a":\n 1}')
    (tmp_path / "j" / "c.json").write_text("{broken")
    assert [(r["a"], r["filename"]) for r in files.read_json_folder(spark, str(tmp_path / "j"), "a int").orderBy("filename").collect() if r["a"] is not None] == [(1, "a.json"), (2, "b.json")]
    (tmp_path / "cards.json").write_text('[{"model_id": "m", "tags": ["x"]}, {"model_id": "n"}]')
    assert sorted(r["model_id"] for r in files.read_cards(spark, str(tmp_path / "cards.json")).collect()) == ["m", "n"]


def test_warnings_of_sheets_are_united(spark):
    one = spark.createDataFrame([(i, "same", float(i)) for i in range(200)], "row_no int, a string, b double")
    two = spark.createDataFrame([(1, "x")] * 5, "row_no int, c string")
    got = workbook.workbook_warnings({"one": one, "two": two}).first()
    assert "low_variance_column:a" in got["warnings"] and "small_dataset_rows:5" in got["warnings"] and "duplicate_rows:1.0000" in got["warnings"]
    assert "high_duplicate_row_ratio" in got["risk_flags"]
    sample = workbook.workbook_sample({"one": one.repartition(4), "two": two}, 202).collect()
    assert [r["_sheet"] for r in sample] == ["one"] * 200 + ["two"] * 2 and [r["b"] for r in sample[:3]] == ["0.0", "1.0", "2.0"]
