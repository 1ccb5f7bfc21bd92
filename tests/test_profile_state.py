"""Stored states of files give the profile of all their rows."""

import random
import statistics

from corvane.operators import profile_state as P


def rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, rng.gauss(50, 20)]) if i % 5 == 0 else rng.gauss(50, 20), rng.choice([None, "a", "b  c", " d", "N/A", f"u{rng.randrange(5000)}"]), rng.randrange(100)) for i in range(n)]


SCHEMA = "x double, s string, k int"


def test_states_of_files_are_united(spark, tmp_path):
    folder, parts = str(tmp_path / "states"), {"a": rows(4000, 1), "b": rows(6000, 2), "c": []}
    for name in ("a", "b"):
        P.write_state(spark.createDataFrame(parts[name], SCHEMA), folder, name)
    assert P.sources_without_state(spark, folder, ["a", "b", "c"]) == ["c"]
    P.write_state(spark.createDataFrame(parts["c"], SCHEMA), folder, "c")
    P.write_state(spark.createDataFrame(parts["a"], SCHEMA), folder, "a")  # a repeated job
    assert P.read_states(spark, folder).count() == 9
    got = {r["column"]: r for r in P.profile_of_states(P.read_states(spark, folder)).collect()}
    every = parts["a"] + parts["b"]
    once = {r["column"]: r for r in P.profile_of_states(P.profile_state(spark.createDataFrame(every, SCHEMA))).collect()}
    for c, r in got.items():
        for f in ("row_count", "null_count", "min", "max", "sentinel_count", "has_whitespace_issues", "avg_word_count", "inferred_type"):
            assert r[f] == once[c][f]
        assert abs(r["unique_count"] - once[c]["unique_count"]) <= 0.03 * once[c]["unique_count"]
    x = sorted(v for v, _, _ in every if v is not None)
    assert abs(got["x"]["mean"] - statistics.fmean(x)) < 1e-9 and abs(got["x"]["std"] - statistics.stdev(x)) < 1e-9
    for q, c in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        assert abs(sum(v <= got["x"][c] for v in x) / len(x) - q) < 0.015
    true = {c: len({r[i] for r in every}) for i, c in enumerate(("x", "s", "k"))}
    assert all(abs(got[c]["unique_count"] - n) <= 0.06 * n for c, n in true.items())


def test_states_of_odd_files(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    got = {r["column"]: r for r in P.profile_of_states(P.profile_state(nothing)).collect()}
    assert got["x"]["row_count"] == 0 and got["x"]["mean"] is None and got["x"]["q50"] is None and got["s"]["avg_word_count"] is None
    one = P.profile_state(spark.createDataFrame([(1.0, None, 3)], SCHEMA))
    other = P.profile_state(spark.createDataFrame([(True, 2.0)], "flag boolean, x double"))
    both = {r["column"]: r for r in P.profile_of_states(one.unionByName(other)).collect()}
    assert both["x"]["row_count"] == 2 and both["x"]["mean"] == 1.5 and both["flag"]["row_count"] == 1 and both["s"]["null_count"] == 1 and both["s"]["unique_count"] == 1
