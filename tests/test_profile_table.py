from corvane.operators import profile_table as P


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_column_profile_of_nulls_ties_and_strings(spark):
    rows = [(1.0, " a "), (2.0, "A"), (2.0, "N/A"), (100.0, None), (None, "b  c ")]
    p = by_column(P.column_profile(spark.createDataFrame(rows, "x double, s string")))
    x, s = p["x"], p["s"]
    assert (x["row_count"], x["null_count"], x["unique_count"]) == (5, 1, 4)  # null counts as a value
    assert (x["min"], x["max"], x["mean"]) == (1.0, 100.0, 26.25)
    assert (x["q25"], x["q50"], x["q75"]) == (2.0, 2.0, 2.0)  # index round(q * 3)
    assert x["outlier_count"] == 0
    assert s["sentinel_count"] == 1 and s["has_whitespace_issues"] and s["has_case_inconsistency"]
    assert s["avg_word_count"] == (3 + 1 + 1 + 4) / 4  # split on single spaces
    assert s["mean"] is None


def test_quantiles_are_order_statistics(spark):
    rows = [(float(v),) for v in [5, 1, 4, 2, 3, 9, 8, 7, 6, 10, 11]]
    q = P.nearest_quantiles(spark.createDataFrame(rows, "x double"), ["x"]).first()
    assert (q["q25"], q["q50"], q["q75"]) == (4.0, 6.0, 9.0)  # round(2.5) is 3, half up


def test_outliers_need_four_values_and_spread(spark):
    few = P.column_profile(spark.createDataFrame([(1.0,), (2.0,), (900.0,)], "x double"))
    assert few.first()["outlier_count"] == 0
    assert P.column_profile(spark.createDataFrame([(1.0,), (2.0,), (900.0,)], "x double"), sheet=True).first()["outlier_count"] is None
    many = P.column_profile(spark.createDataFrame([(1.0,)] * 30 + [(50.0,)], "x double"))
    assert many.first()["outlier_count"] == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "x double, s string")
    p = by_column(P.column_profile(empty))
    assert p["x"]["row_count"] == 0 and p["x"]["null_ratio"] == 0.0
    d = P.duplicate_rows(empty)
    assert d.first().asDict() == {"row_count": 0, "duplicate_rows": 0, "duplicate_ratio": 0.0}
    w = P.table_warnings(P.column_profile(empty), d).first()
    assert w["warnings"] == ["csv_empty_dataset"] and w["risk_flags"] == ["empty_dataset"]


def test_duplicates_count_every_member_and_match_nulls(spark):
    d = P.duplicate_rows(spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a")], "a int, b string")).first()
    assert (d["duplicate_rows"], d["duplicate_ratio"]) == (2, 0.5)


def test_warning_thresholds(spark):
    rows = [(i, None if i < 3 else "x") for i in range(10)]
    df = spark.createDataFrame(rows, "k int, s string")
    w = P.table_warnings(P.column_profile(df), P.duplicate_rows(df)).first()
    assert w["warnings"] == ["missing_values:s:0.3000", "small_dataset_rows:10"]
    assert w["risk_flags"] == ["high_missing_ratio:s"]


def test_roles_differ_between_table_and_sheet(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(40)], "row_id int, amount double, flag int")
    table, sheet = (by_column(P.column_roles(P.column_profile(df), s)) for s in (False, True))
    assert table["row_id"]["is_likely_id"] and not table["amount"]["is_likely_id"] and sheet["amount"]["is_likely_id"]
    assert table["flag"]["is_target_candidate"] and not table["amount"]["is_target_candidate"]


def test_clean_rows_strip_and_sentinels(spark):
    got = P.clean_rows(spark.createDataFrame([(1, "\t Unknown \n"), (2, "  x y "), (3, None), (4, "")], "k int, s string")).orderBy("k").collect()
    assert [r["s"] for r in got] == [None, "x y", None, None]


def test_top_values_break_ties_by_value(spark):
    got = P.top_values(spark.createDataFrame([(c,) for c in "bbaacdefg"], "s string"), 3).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in got] == [("a", 2), ("b", 2), ("c", 1)]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = ({r["k"] for r in P.sample_rows(df.repartition(n), "k", 50).collect()} for n in (1, 7))
    assert a == b and len(a) == 50


def test_summary(spark):
    s = {r["column"]: r["summary"] for r in P.column_summary(spark.createDataFrame([(1, "a"), (3, "a")], "x int, s string")).collect()}
    assert s == {"x": "range=1.00..3.00, mean=2.00, std=1.41", "s": "a (2)"}


def test_estimated_distinct_counts_are_near(spark):
    from corvane.operators import profile_table

    df = spark.range(20000).selectExpr("id AS a", "id % 7 AS b", "IF(id % 3 = 0, NULL, 's' || id % 500) AS c")
    exact = {r["column"]: r for r in profile_table.distinct_counts(df).collect()}
    near = {r["column"]: r for r in profile_table.approximate_counts(df).collect()}
    assert {c: r["unique_count"] for c, r in exact.items()} == {"a": 20000, "b": 7, "c": 501}
    for c, r in exact.items():
        assert near[c]["row_count"] == r["row_count"] and near[c]["null_count"] == r["null_count"] and abs(near[c]["unique_count"] / r["unique_count"] - 1) < 0.05
    assert profile_table.column_profile(df, approximate=True).count() == 3
