"""Run lists, logs, events and what a report shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import col, contains_any

# Words of log lines and errors, labels and order of metrics, thresholds of bars.
FATAL_PARTS = ["remaining_argv", "unrecognized argument", "unrecognized arguments", "error: argument", "valueerror", "no such option"]
LOG_LEVELS = {"error": ["error", "failed", "exception"], "warn": ["warn"], "success": ["done", "finish", "success", "✓"]}
METRIC_LABELS = {"rouge1": "ROUGE-1", "rouge2": "ROUGE-2", "rougeL": "ROUGE-L", "bleu4": "BLEU-4", "f1_token": "F1-token", "exact_match": "Exact-Match", "bertscore_f1": "BERTScore-F1", "g_eval_overall": "G-Eval", "faithfulness": "Faithfulness", "f1_macro": "F1-macro", "accuracy": "Accuracy", "entity_f1": "Entity-F1"}
SECONDARY_METRICS = ["bertscore_f1", "g_eval_overall", "faithfulness", "rougeL", "bleu4", "f1_token"]
BAR_THRESHOLDS = {"bleu4": (0.14, 0.05), "rouge2": (0.22, 0.12), "rougeL": (0.42, 0.25)}
#: A step's title and the word sets of which all must occur, first match first.
STEP_TITLES = [
    ("Analyse des fichiers", ["profil", "terminé"]),
    ("Analyse des fichiers", ["profil", "analysé"]),
    ("Compatibilité des domaines", ["compatib"]),
    ("Stratégie d'évaluation détectée", ["stratégie d'évaluation"]),
    ("Extraction de l'intention", ["intention"]),
    ("Extraction de l'intention", ["tâche", ":"]),
    ("Vérification de faisabilité", ["faisabilité"]),
    ("Resélection du modèle", ["nouveau modèle sélectionné"]),
    ("Sélection du modèle", ["sélectionné", "modèle"]),
    ("Préparation des données", ["données prêtes"]),
    ("Préparation des données", ["paires qa"]),
    ("Diagnostic & action corrective", ["diagnostic itération"]),
    ("Augmentation du dataset", ["dataset insuffisant"]),
    ("Augmentation du dataset", ["générer automatiquement"]),
    ("Lancement de l'entraînement", ["entraînem", "lancement"]),
    ("Entraînement terminé", ["entraînem", "terminé"]),
    ("Entraînement", ["entraînem"]),
    ("Évaluation du modèle", ["évaluation itération"]),
    ("Blocage — domaines incompatibles", ["incompatibil"]),
    ("Blocage — domaines incompatibles", ["bloqué"]),
]
OTHER_STEP, END_MARK = "Étape pipeline", "__run_done__"


def run_list(runs: DataFrame, owner: str | None = None) -> DataFrame:
    """Runs newest first, with the value of each one's primary metric; with an owner (any case) only theirs, ownerless runs hidden."""
    mine = F.nullif(F.lower(F.trim(F.coalesce("owner_email", F.lit("")))), F.lit(""))
    primary = F.coalesce("primary_metric", F.lit("rouge1"))
    out = runs.withColumn("owner_email", mine).withColumn("primary_metric", primary).withColumn("primary_metric_value", F.try_element_at("metrics", primary))
    if owner and owner.strip():
        out = out.where(F.col("owner_email") == owner.strip().lower())
    return out.orderBy(F.desc("created_at"), "job_id")


def run_counters(runs: DataFrame) -> DataFrame:
    s = F.col("status")
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "trained").alias("succeeded"), F.count_if(s == "trained_low_quality").alias("limited"), F.count_if(s.isin("blocked", "error")).alias("failed"))


def search_runs(runs: DataFrame, query: str) -> DataFrame:
    """Runs where id, model, task, domain or status holds the query (any case); all for a blank one."""
    if not query.strip():
        return runs
    hit = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
    return runs.where(reduce(lambda a, b: a | b, [hit(c) for c in ("job_id", "model_id", "task", "domain", "status")]))


def log_level(line: Column | str) -> Column:
    return reduce(lambda acc, kv: acc.when(contains_any(line, kv[1]), F.lit(kv[0])), LOG_LEVELS.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit("info"))


def step_title(line: Column | str) -> Column:
    low = F.lower(col(line))
    all_in = lambda parts: reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in parts])
    return reduce(lambda acc, kv: acc.when(all_in(kv[1]), F.lit(kv[0])), STEP_TITLES, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(OTHER_STEP))


def log_filter(line: Column | str, mode: str = "full", only: str | None = None) -> Column:
    """Whether a line is shown: pipeline and error lines in the summary, else those of a level."""
    line = col(line)
    if mode == "summary":
        return F.startswith(line, F.lit("[PIPELINE]")) | line.rlike(r"^\d{2}:\d{2}:\d{2}\s+(ERROR|CRITICAL)\b")
    if only in ("warn", "error"):
        return line.rlike("(?i)" + "|".join(LOG_LEVELS[only]))
    return F.lit(True)


def status_counts(journal: DataFrame) -> DataFrame:
    """One row: how many journal entries are ok, warn, err and info."""
    return journal.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "err", "info")])


def chart_scale(points: DataFrame) -> DataFrame:
    """(run_id, low, high, ticks): five ticks from 0.9 of the least loss to 1.05 of the largest; runs under two points are left out."""
    least = F.min(F.least("train_loss", "eval_loss")) * 0.9
    most = F.max(F.greatest("train_loss", "eval_loss")) * 1.05
    sums = points.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), least.alias("low"), most.alias("high")).where("n >= 2")
    return sums.select("run_id", "low", "high", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("low") + i / 4 * (F.col("high") - F.col("low"))).alias("ticks"))


def is_fatal(error: Column | str) -> Column:
    return F.coalesce(contains_any(error, FATAL_PARTS), F.lit(False))


def metric_line(metrics: Column, primary: Column) -> Column:
    """`Label = value` of the primary metric and up to three others that are not 0, joined by ` | `."""
    labels = F.create_map(*[F.lit(x) for kv in METRIC_LABELS.items() for x in kv])
    shown = lambda m, v: F.concat(F.coalesce(F.try_element_at(labels, m), m), F.lit(" = "), F.format_string("%.3f", v))
    first = shown(primary, F.coalesce(F.try_element_at(metrics, primary), F.try_element_at(metrics, F.lit("rouge1")), F.lit(0.0)))
    more = F.filter(F.array(*[F.lit(m) for m in SECONDARY_METRICS]), lambda m: (m != primary) & (F.coalesce(F.try_element_at(metrics, m), F.lit(0.0)) != 0))
    return F.array_join(F.concat(F.array(first), F.transform(F.slice(more, 1, 3), lambda m: shown(m, F.element_at(metrics, m)))), " | ")


def route_event(line: Column | str) -> Column:
    """done, confirm, decision or log."""
    line = col(line)
    object_ = F.startswith(F.ltrim(line), F.lit("{")) & F.try_parse_json(line).isNotNull()
    true = lambda key: F.coalesce(~F.get_json_object(line, f"$.{key}").isin("false", "null", "0", "", "{}", "[]"), F.lit(False))
    return F.when(line == END_MARK, "done").when(object_ & true("__confirm__"), "confirm").when(object_ & true("__decision__"), "decision").otherwise("log")


def run_outcome(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """`runs` with outcome success or failed by their report's `success`; unknown without one."""
    known = F.when(F.col("success").isNull(), "unknown").when(F.col("success"), "success").otherwise("failed")
    return runs.join(reports.select("job_id", "success"), "job_id", "left").withColumn("outcome", known).drop("success")


def metric_bar(metric: Column | str, value: Column, good: Column | None = None, acceptable: Column | None = None) -> Column:
    """struct<colour,fill,good_fill>: colour by thresholds, fill in percent of the scale (1 decimal)."""
    metric = col(metric)
    pick = lambda i, default: reduce(lambda acc, kv: acc.when(metric == kv[0], F.lit(kv[1][i])), BAR_THRESHOLDS.items(), F.when(F.lit(False), F.lit(default))).otherwise(F.lit(default))
    g = pick(0, 0.45) if good is None else F.coalesce(good, pick(0, 0.45))
    ok = pick(1, 0.28) if acceptable is None else F.coalesce(acceptable, pick(1, 0.28))
    most = F.when(metric == "bleu4", 0.35).otherwise(1.0)
    fill = lambda v: F.round(F.least(F.lit(100.0), v / most * 100), 1)
    return F.struct(F.when(value >= g, "ok").when(value >= ok, "warn").otherwise("err").alias("colour"), fill(value).alias("fill"), fill(g).alias("good_fill"))


def sanitised(df: DataFrame, drop: str = "messages") -> DataFrame:
    """One JSON string per row (`result`), without fields named `drop` at any depth."""

    def rebuilt(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if f.name != drop]
            return F.struct(*[rebuilt(f.dataType, c[f.name]).alias(f.name) for f in kept]) if kept else F.lit(None).cast("string")
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: rebuilt(kind.elementType, x))
        if isinstance(kind, T.MapType):
            return F.map_filter(c, lambda k, _: k != drop) if isinstance(kind.keyType, T.StringType) else c
        return c.cast("string") if isinstance(kind, (T.BinaryType, T.TimestampType, T.DateType)) else c

    kept = [f for f in df.schema.fields if f.name != drop]
    return df.select(F.to_json(F.struct(*[rebuilt(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in kept])).alias("result"))
