"""Diagnoses over improvement logs, loss curves and trials, as windows.

A log has run_id and iteration; a curve has run_id, checkpoint, step and losses; trial lines have trial and seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_GAIN, GAP_GROWTH, EXTREME_GAP, HIGH_LOSS, DEAD_BAND = 0.02, 1.3, 2.5, 2.5, 0.001


def _last_two(log: DataFrame, columns: list[str]) -> DataFrame:
    """One row per run: n entries, each column of the last entry and, as prev_…, of the one before."""
    kept = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("iteration", *columns)))), 1, 2).alias("e"))
    return kept.select("run_id", "n", *[F.get("e", 0)[c].alias(c) for c in columns], *[F.get("e", 1)[c].alias(f"prev_{c}") for c in columns])


def stagnation(log: DataFrame, value: str = "primary_metric_value") -> DataFrame:
    """(run_id, stagnates): the last two entries differ by less than 0.02; false under two entries."""
    two = _last_two(log, [value])
    return two.select("run_id", ((F.col("n") >= 2) & (F.coalesce(value, F.lit(0.0)) - F.coalesce(f"prev_{value}", F.lit(0.0)) < LEAST_GAIN)).alias("stagnates"))


def _with_losses(log: DataFrame) -> DataFrame:
    return _last_two(log.where("train_loss IS NOT NULL AND eval_loss IS NOT NULL"), ["train_loss", "eval_loss"])


def overfitting(log: DataFrame) -> DataFrame:
    """(run_id, overfits) over entries with both losses: one entry with an extreme gap; else evaluation up while training goes down, or a gap grown by 30 %."""
    t, e, pt, pe = (F.col(c) for c in ("train_loss", "eval_loss", "prev_train_loss", "prev_eval_loss"))
    apart = (e > pe) & (t < pt)
    wider = (pe - pt > 0) & (e - t > (pe - pt) * GAP_GROWTH)
    runs = log.select("run_id").distinct()
    found = _with_losses(log).select("run_id", F.when(F.col("n") == 1, e > t * EXTREME_GAP).otherwise(apart | wider).alias("overfits"))
    return runs.join(found, "run_id", "left").na.fill(False, ["overfits"])


def underfitting(log: DataFrame) -> DataFrame:
    """(run_id, underfits): both losses of the last entry that has them are high."""
    runs = log.select("run_id").distinct()
    found = _with_losses(log).select("run_id", ((F.col("train_loss") > HIGH_LOSS) & (F.col("eval_loss") > HIGH_LOSS)).alias("underfits"))
    return runs.join(found, "run_id", "left").na.fill(False, ["underfits"])


def insufficient_data(n_pairs: Column, last_value: Column, acceptable: Column) -> Column:
    """Under 50 pairs; or under 2000 with a last value (if any) under acceptable; never for 0 or null."""
    n = F.coalesce(n_pairs, F.lit(0))
    return (n > 0) & ((n < 50) | ((n < 2000) & F.coalesce(last_value < acceptable, F.lit(False))))


def model_mismatch(log: DataFrame, acceptable: Column, value: str = "primary_metric_value") -> DataFrame:
    """(run_id, mismatched): two entries or more with different overrides, and a last value under half of acceptable."""
    settings = F.to_json(F.array_sort(F.map_entries(F.coalesce("hparam_overrides", F.create_map().cast("map<string,string>")))))
    sums = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(settings).alias("kinds"), F.max_by(F.coalesce(value, F.lit(0.0)), "iteration").alias("last"))
    return sums.select("run_id", ((F.col("n") >= 2) & (F.col("kinds") >= 2) & (F.col("last") < acceptable * 0.5)).alias("mismatched"))


def best_checkpoint(history: DataFrame) -> DataFrame:
    """(run_id, checkpoint): the earliest with the least eval_loss, the last one if none has any; `best_model`, if there, wins."""
    number = F.regexp_extract("checkpoint", r"-(\d+)$", 1).try_cast("bigint")
    sums = history.groupBy("run_id").agg(
        F.max(F.when(F.col("checkpoint") == "best_model", F.col("checkpoint"))).alias("linked"),
        F.min_by("checkpoint", F.when(F.col("eval_loss").isNotNull(), F.struct("eval_loss", number.alias("n"), "step"))).alias("best"),
        F.max_by("checkpoint", number).alias("last"),
    )
    return sums.select("run_id", F.coalesce("linked", "best", "last").alias("checkpoint"))


def loss_curve(history: DataFrame) -> DataFrame:
    """(run_id, step, epoch, train_loss, eval_loss): the points of the last checkpoint that has any; losses to 4 decimals, epochs to 3."""
    number = F.regexp_extract("checkpoint", r"-(\d+)$", 1).try_cast("bigint")
    step = F.coalesce(F.when(F.col("step") != 0, F.col("step").cast("double")), F.col("epoch"), F.col("step").cast("double"))
    points = history.withColumn("at", step).withColumn("number", number).where("at IS NOT NULL AND (loss IS NOT NULL OR eval_loss IS NOT NULL OR epoch IS NOT NULL)")
    last = points.groupBy("run_id").agg(F.max("number").alias("number"))
    return points.join(last, ["run_id", "number"]).select("run_id", F.col("at").alias("step"), F.round("epoch", 3).alias("epoch"), F.round("loss", 4).alias("train_loss"), F.round("eval_loss", 4).alias("eval_loss"))


def parse_metric_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """(trial, seq, loss, eval_loss) and the columns in `keep` of log lines that are JSON or Python dicts; other lines have nulls."""
    number = r"\s*:\s*([-+0-9.eE]+)"
    value = lambda key: F.nullif(F.regexp_extract("line", f"['\"]{key}['\"]{number}", 1), F.lit("")).try_cast("double")
    shown = F.startswith(F.col("line"), F.lit("{"))
    return lines.select("trial", "seq", *keep, F.when(shown, value("loss")).alias("loss"), F.coalesce(F.when(shown, value("eval_loss")), F.nullif(F.regexp_extract("line", r"'eval_loss':\s*([\d.eE+\-]+)", 1), F.lit("")).try_cast("double")).alias("eval_loss"))


def last_metrics(parsed: DataFrame) -> DataFrame:
    """(trial, loss, eval_loss, best_eval): the last value of each, and the least evaluation loss."""
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return parsed.groupBy("trial").agg(at("loss"), at("eval_loss"), F.min("eval_loss").alias("best_eval"))


def evaluations(parsed: DataFrame) -> DataFrame:
    """(trial, seq, eval_no, eval_loss, train_loss, best, gap, previous_gap, first_gap): one row per new evaluation loss; no gap before the first training loss."""
    by = Window.partitionBy("trial").orderBy("seq")
    before = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = parsed.withColumn("train_loss", F.last("loss", ignorenulls=True).over(before)).where("eval_loss IS NOT NULL")
    new = filled.withColumn("was", F.lag("eval_loss").over(by)).where("was IS NULL OR was <> eval_loss")
    out = new.withColumn("eval_no", F.row_number().over(by)).withColumn("best", F.min("eval_loss").over(before)).withColumn("gap", F.col("eval_loss") - F.col("train_loss"))
    return out.withColumn("previous_gap", F.lag("gap").over(by)).withColumn("first_gap", F.first("gap", ignorenulls=True).over(before)).drop("was", "loss")


def early_stops(parsed: DataFrame, cross_trial_best: float | None = None) -> DataFrame:
    """(trial, seq, rule, best): where each trial stops: its gap over the previous and the first one (divergence), or its best over that of other trials (cross_trial); the first such evaluation counts."""
    e = evaluations(parsed)
    diverges = (F.col("eval_no") >= 2) & (F.col("gap") > F.col("previous_gap")) & (F.col("gap") > F.col("first_gap"))
    behind = F.col("best") > F.lit(cross_trial_best) if cross_trial_best is not None else F.lit(False)
    rule = F.when(diverges, "divergence").when(behind, "cross_trial")
    return e.withColumn("rule", rule).where("rule IS NOT NULL").groupBy("trial").agg(F.min_by(F.struct("seq", "rule", "best"), "seq").alias("x")).select("trial", "x.*")


def cross_trial_best(trials: DataFrame) -> DataFrame:
    """`trials` (study, number, value) with the least finite value of earlier ones; null if there is none."""
    before = Window.partitionBy("study").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    finite = F.when(F.abs("value") < F.lit(float("inf")), F.col("value"))
    return trials.withColumn("cross_trial_best", F.min(finite).over(before))


def study_stop(trials: DataFrame, patience: int = 2) -> DataFrame:
    """(study, stopped_at, best_number): the first trial that ends `patience` trials in a row without a new best, and the best until then."""
    c = cross_trial_best(trials)
    better = F.coalesce((F.abs("value") < F.lit(float("inf"))) & (F.col("cross_trial_best").isNull() | (F.col("value") < F.col("cross_trial_best"))), F.lit(False))
    by = Window.partitionBy("study").orderBy("number")
    runs = c.withColumn("better", better).withColumn("island", F.sum(F.col("better").cast("int")).over(by))
    streak = runs.withColumn("streak", F.sum((~F.col("better")).cast("int")).over(Window.partitionBy("study", "island").orderBy("number")))
    stops = streak.groupBy("study").agg(F.min(F.when((F.col("streak") >= patience), F.col("number"))).alias("stopped_at"))
    ran = streak.join(stops, "study").where("stopped_at IS NULL OR number <= stopped_at")
    return ran.groupBy("study").agg(F.max("stopped_at").alias("stopped_at"), F.min_by("number", F.when(F.col("better"), F.struct("value", "number"))).alias("best_number"))


def seed_alpha_ratio(alpha: Column, rank: Column) -> Column:
    """The nearest of 1, 2 and 4 to alpha over rank (the smaller if two are as near)."""
    stated = F.greatest(F.lit(1), F.bround(F.coalesce(F.try_divide(alpha.cast("double"), rank), F.lit(2.0)), 0))
    return F.array_sort(F.transform(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda x: F.struct(F.abs(x - stated).alias("d"), x.alias("x"))))[0]["x"]


def override_diff(new: Column, previous: Column) -> Column:
    """map of the new overrides to `before → after`; `default` where there was none."""
    both = F.map_zip_with(new, F.coalesce(previous, F.create_map().cast("map<string,string>")), lambda _, a, b: F.when(a.isNotNull(), F.concat(F.coalesce(b, F.lit("default")), F.lit(" → "), a)))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def deltas(log: DataFrame, value: str = "primary_metric_value") -> DataFrame:
    """`log` with delta to the previous entry and its direction (up, down, flat within 0.001; null for the first)."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy("run_id").orderBy("iteration"))
    return log.withColumn("delta", d).withColumn("direction", F.when(F.col("delta") > DEAD_BAND, "up").when(F.col("delta") < -DEAD_BAND, "down").when(F.col("delta").isNotNull(), "flat"))


def line_tail(lines: DataFrame, k: int = 15) -> DataFrame:
    """The last k lines of each trial."""
    order = Window.partitionBy("trial").orderBy(F.desc("seq"))
    return lines.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def journal(*steps: DataFrame) -> DataFrame:
    """Decision steps (run_id, part, title, decision, reason, status) from several tables, numbered per run."""
    from functools import reduce

    return reduce(DataFrame.unionByName, steps).withColumn("step", F.row_number().over(Window.partitionBy("run_id").orderBy("part", "title")))
