"""Model sizes, data requirements, hyper-parameters and memory, from small fixed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import col, literal_set

# Requirement tables (upper bound of billions of parameters or of pairs first) and name lists.
DATA_NEEDS = [
    (0.3, 50, 150, 600),
    (0.7, 100, 300, 1000),
    (1.5, 200, 600, 2000),
    (3.5, 350, 1000, 3500),
    (8.0, 500, 1500, 5000),
    (15.0, 800, 2500, 8000),
    (40.0, 1200, 4000, 12000),
    (float("inf"), 2000, 6000, 20000),
]
METHOD_SCALE = {"qlora": 1.0, "lora": 1.0, "lora_int8": 1.0, "dora": 1.0, "full": 8.0, "auto": 1.0}
TASK_SCALE = {"chatbot": 1.0, "question-answering": 1.0, "conversational-qa": 1.2, "instruction-following": 1.5, "summarization": 0.8, "classification": 0.6, "text-classification": 0.6, "sentiment-analysis": 0.5, "code-generation": 2.0, "translation": 0.7}
RANK_BY_SIZE = [(0.5, 4), (1.5, 8), (7.0, 16), (15.0, 32), (float("inf"), 64)]
RATE_BY_METHOD = {"qlora": 2e-4, "lora": 1e-4, "lora_int8": 1e-4, "dora": 1e-4, "full": 2e-5, "auto": 2e-4}
EPOCHS_BY_PAIRS = [(300, 10), (700, 7), (1500, 5), (3000, 3), (8000, 2), (999999, 1)]
SIZE_PATTERNS = [r"[-_/](\d+\.?\d*)[Bb](?:\b|[-_])", r"(\d+\.?\d*)[Bb][-_]", r"\b(\d+\.?\d*)[Bb]\b"]
BYTES_PER_PARAMETER = {"qlora": 0.5, "lora_int8": 1.0, "lora": 2.0, "full": 2.0}
TRAINABLE_SHARE = {"qlora": 0.01, "lora_int8": 0.01, "lora": 0.01, "full": 1.00}
OVERHEAD_GB, EFFECTIVE_BATCH, DEFAULT_SIZE = 1.5, 16, 7.0
REFUSED_ORGANISATIONS = ["tencent/", "baidu/", "ERNIE", "WisdomShell/"]
REFUSED_ARCHITECTURES = ["youtu", "hunyuan", "ernie", "pangu", "chatglm"]
NO_TRANSFORMERS = ["mamba", "rwkv", "ssm", "state-space", "state_space", "retnet", "rnn", "lstm"]
QUANTISED_PARTS = ["-awq", "-gptq", "-gguf", "-fp8", "-int8", "-int4", "-w4a16", "-w8a16", "-w4", "-w8", "-nf4", "-bnb-4bit", "-bnb-8bit", "-4bit", "-8bit", "-compressed", "-marlin"]
REFUSED_PIPELINES = ["feature-extraction", "sentence-similarity", "fill-mask"]
REFUSED_TAGS = ["sentence-similarity", "sentence-transformers", "feature-extraction", "embeddings"]
TASK_OF_TAG = {
    "text-generation": "text-generation",
    "text2text-generation": "text2text-generation",
    "text-classification": "classification",
    "token-classification": "token-classification",
    "question-answering": "question-answering",
    "summarization": "summarization",
    "translation": "translation",
    "fill-mask": "fill-mask",
    "feature-extraction": "feature-extraction",
    "sentence-similarity": "sentence-similarity",
    "conversational": "instruction-following",
    "chat": "instruction-following",
    "code": "code-generation",
    "coding": "code-generation",
}
SPECIAL_KINDS = {"reranker": "reranking", "prm": "process-reward"}
PRECISION_FIRST = {"performance": ["lora", "lora_int8", "qlora"], "balanced": ["lora_int8", "qlora", "lora"]}
TRIALS = {"speed": 3, "balanced": 4, "quality": 6}


def lookup(key: Column | str, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col(key)), F.lit(default))


def up_to(value: Column, table: list[tuple], at: int = 1) -> Column:
    """The table's entry in the first row whose bound is not below the value."""
    return reduce(lambda acc, row: acc.when(value <= row[0], F.lit(row[at])), table, F.when(F.lit(False), F.lit(table[0][at])))


def model_size(name: Column | str) -> Column:
    """Billions of parameters that a model's name states or hints at; 7 by default."""
    name = col(name)
    stated = F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")).try_cast("double") for p in SIZE_PATTERNS])
    low = F.lower(name)
    has = lambda *parts: low.rlike("|".join(p.replace(".", r"\.") for p in parts))
    hinted = F.when(has("nano", "pico", "tiny"), 0.1).when(has("mini", "small", "0.5"), 0.5).when(has("medium"), 3.0).when(has("large") & ~has("extra"), 13.0).when(has("xl", "extra-large"), 30.0).otherwise(DEFAULT_SIZE)
    return F.coalesce(stated, hinted)


def data_requirements(models: DataFrame, name: str = "model", method: str = "peft", task: str = "task") -> DataFrame:
    """`models` with size_b, multiplier, min_viable, target and saturate (rounded half to even)."""
    size, m = F.col("size_b"), F.col("multiplier")
    out = models.withColumn("size_b", model_size(name)).withColumn("multiplier", lookup(method, METHOD_SCALE, 1.0) * lookup(task, TASK_SCALE, 1.0))
    for i, c in enumerate(("min_viable", "target", "saturate"), 1):
        out = out.withColumn(c, F.bround(up_to(size, DATA_NEEDS, i) * m, 0).cast("bigint"))
    return out


def hyper_parameters(size: Column, method: Column | str, pairs: Column, memory_gb: Column, task: Column | str) -> Column:
    """struct of rank, alpha, learning rate, epochs, batch, accumulation and length."""
    rank = up_to(size, RANK_BY_SIZE)
    batch = F.when(memory_gb >= 16, 4).when(memory_gb >= 8, 2).otherwise(1)
    return F.struct(
        rank.alias("lora_rank"),
        (rank * 2).alias("lora_alpha"),
        lookup(method, RATE_BY_METHOD, 2e-4).alias("learning_rate"),
        up_to(pairs, EPOCHS_BY_PAIRS).alias("num_train_epochs"),
        batch.alias("batch_size"),
        F.floor(EFFECTIVE_BATCH / batch).cast("int").alias("accumulation"),
        F.when(col(task) == "code-generation", 4096).otherwise(2048).alias("max_length"),
    )


def search_bounds(method: Column | str, pairs: Column) -> Column:
    """struct of the bounds of learning rate and epochs."""
    full = col(method) == "full"
    low = F.when(pairs < 300, 5).when(pairs < 700, 4).when(pairs < 2000, 2).otherwise(1)
    high = F.when(pairs < 300, 12).when(pairs < 700, 8).when(pairs < 2000, 6).otherwise(3)
    return F.struct(F.when(full, 5e-6).otherwise(1e-5).alias("rate_low"), F.when(full, 1e-4).otherwise(5e-4).alias("rate_high"), low.alias("epochs_low"), high.alias("epochs_high"))


def adaptive_length(samples: DataFrame, chars: str, task: str = "question-answering") -> DataFrame:
    """One row, max_length: a power of two over the tokens of the 95th percentile sample, in [256, 2048]; 4096 for code; 2048 without samples.

    The percentile is the sample at index floor(0.95 n); it is found from counts of lengths, which are few.
    """
    from pyspark.sql.window import Window

    spark = samples.sparkSession
    if task == "code-generation":
        return spark.range(1).select(F.lit(4096).alias("max_length"))
    counts = samples.groupBy(F.col(chars).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("c"))).crossJoin(F.broadcast(total))
    p95 = upto.where(F.col("upto") > F.floor(F.col("all") * 0.95)).agg(F.min("c").alias("p"))
    estimate = F.greatest(F.lit(256), F.floor((F.col("p") / 4 + 50) * 1.2))
    return p95.select(F.when(F.col("p").isNull(), 2048).otherwise(F.least(F.lit(2048), F.pow(F.lit(2), F.ceil(F.log2(estimate))).cast("int"))).alias("max_length"))


def memory_needed(size: Column, method: Column | str) -> Column:
    """GB to fine-tune: weights, adapter, its two optimiser states, overhead; one decimal."""
    return F.round(size * lookup(method, BYTES_PER_PARAMETER, 2.0) + 3 * (size * lookup(method, TRAINABLE_SHARE, 0.01) * 4.0) + OVERHEAD_GB, 1)


def methods_that_fit(models: DataFrame, memory_gb: Column, size: str = "parameters_b", methods: list[str] | None = None) -> DataFrame:
    """`models` with `feasible`: the methods that fit, in their order, and `need_gb` by method."""
    names = methods or list(BYTES_PER_PARAMETER)
    need = F.create_map(*[x for m in names for x in (F.lit(m), memory_needed(F.col(size), F.lit(m)))])
    fits = F.filter(literal_set(names), lambda m: F.element_at(F.col("need_gb"), m) <= memory_gb)
    return models.withColumn("need_gb", need).withColumn("feasible", fits)


def choose_method(objective: Column | str, feasible: Column, need: Column) -> Column:
    """Least memory for speed; else the first feasible method of the objective's order; qlora if none fits."""
    least = F.array_sort(F.transform(feasible, lambda m: F.struct(F.element_at(need, m).alias("n"), F.array_position(feasible, m).alias("i"), m.alias("m"))))[0]["m"]
    first = lambda order, rest: F.coalesce(F.get(F.filter(literal_set(order), lambda m: F.array_contains(feasible, m)), 0), rest)
    return F.when(F.size(feasible) == 0, "qlora").when(col(objective) == "speed", least).when(col(objective) == "performance", first(PRECISION_FIRST["performance"], F.element_at(feasible, -1))).otherwise(first(PRECISION_FIRST["balanced"], F.get(feasible, 0)))


def incompatibility(card: DataFrame | None = None) -> Column:
    """Why a model card cannot be fine-tuned (the first reason), or null: over model_id, swift_model_type, is_reward, pipeline_tag, tags."""
    raw = F.coalesce(F.col("model_id"), F.lit(""))
    both = [F.lower(raw), F.lower(F.coalesce(F.col("swift_model_type"), F.lit("")))]
    first = lambda names, test: F.get(F.filter(literal_set(names), test), 0)
    inside = lambda p: F.contains(both[0], p) | F.contains(both[1], p)
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    pipeline = F.lower(F.coalesce("pipeline_tag", F.lit("")))
    reasons = [
        F.concat(F.lit("organisation:"), first(REFUSED_ORGANISATIONS, lambda p: F.startswith(raw, p))),
        F.concat(F.lit("architecture:"), first(REFUSED_ARCHITECTURES, inside)),
        F.concat(F.lit("no_transformer:"), first(NO_TRANSFORMERS, inside)),
        F.concat(F.lit("quantised:"), first(QUANTISED_PARTS, lambda p: F.contains(both[0], p))),
        F.when(F.coalesce("is_reward", F.lit(False)), F.lit("reward")),
        F.when(pipeline.isin(REFUSED_PIPELINES), F.concat(F.lit("pipeline:"), pipeline)),
        F.concat(F.lit("tag:"), first(REFUSED_TAGS, lambda p: F.array_contains(tags, p))),
    ]
    return F.coalesce(*reasons)


def model_tasks() -> Column:
    """Sorted tasks from pipeline_tag, tags, swift_task_type and is_reward; text-generation if none."""
    of = F.create_map(*[F.lit(x) for kv in TASK_OF_TAG.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for kv in SPECIAL_KINDS.items() for x in kv])
    own = F.when(~F.coalesce("pipeline_tag", F.lit("")).isin("conversational", "chat", "code", "coding"), F.try_element_at(of, F.coalesce("pipeline_tag", F.lit(""))))
    some = F.concat(F.array(own, F.try_element_at(kind, F.coalesce("swift_task_type", F.lit(""))), F.when(F.coalesce("is_reward", F.lit(False)), F.lit("reward-modeling"))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.try_element_at(of, t)))
    found = F.array_sort(F.array_distinct(F.filter(some, lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("text-generation")))


def memory_budget(available_gb: Column) -> Column:
    """What is left after a reserve of a fifth (half a GB to three), at least 1."""
    reserve = F.least(F.lit(3.0), F.greatest(F.lit(0.5), available_gb * 0.2))
    return F.greatest(F.lit(1), F.floor(available_gb - reserve)).cast("int")


def trial_count(objective: Column | str, advised: Column, single: bool = False) -> Column:
    """The advised number of trials within the objective's bounds; 3 if there is no advice, 1 if only one is allowed."""
    if single:
        return F.lit(1)
    most = lookup(objective, TRIALS, 4).cast("int")
    return F.when(advised.isNull(), 3).otherwise(F.greatest(F.lit(2), F.least(most, advised)))


def advised_parameters(advice: Column, baseline: Column, overrides: Column | None = None) -> Column:
    """map<string,double>: all seven advised values if each is there and a number, else the baseline; overrides win."""
    keys = ["lora_rank", "lora_alpha", "lora_dropout", "learning_rate", "num_train_epochs", "warmup_ratio", "weight_decay"]
    cast = {k: F.try_element_at(advice, F.lit(k)).try_cast("double") for k in keys}
    complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in cast.values()])
    taken = F.create_map(*[x for k in keys for x in (F.lit(k), cast[k])])
    merge = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
    out = F.when(complete, merge(baseline, taken)).otherwise(baseline)
    return out if overrides is None else merge(out, F.coalesce(overrides, F.create_map().cast("map<string,double>")))


def device_policy(free_gb: Column) -> Column:
    return F.when(free_gb < 1.2, "cpu").when(free_gb < 1.5, "gpu_4bit").when(free_gb < 2.5, "gpu_8bit").otherwise("gpu_half")


def is_cached(files: DataFrame) -> DataFrame:
    """(model_id, cached): a model whose files (model_id, length) hold 100 MB or more."""
    return files.groupBy("model_id").agg((F.sum("length") >= 100 * 1024 * 1024).alias("cached"))


def public_config(config: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(config, lambda k, _: ~F.startswith(k, F.lit("_")))


def config_preview(config: Column) -> Column:
    """The public settings of a configuration as `--key value`, in the order of keys."""
    kept = F.array_sort(F.map_entries(public_config(config)))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.lit("--"), e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("")))), " ")
