"""Pipeline state as a fold over events: stages, retries, idempotency, configs, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STAGES = ["cleaning", "chunking", "vectorizing", "sparse_vectorizing", "pretokenizing", "es_indexing"]


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def fold_stages(events: DataFrame) -> DataFrame:
    """Each task's stages from events (task_id, stage, status, ts, seq): last status, duration of the last run in ms.

    A stage that succeeded stays so.
    """
    per = events.groupBy("task_id", "stage").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("last"),
        F.max(F.when(F.col("status") == "SUCCESS", F.struct("ts", "seq"))).alias("done"),
        F.max(F.when(F.col("status") == "PROCESSING", F.struct("ts", "seq"))).alias("begun"),
        F.max(F.struct("ts", "seq")).alias("ended"),
    )
    status = F.when(F.col("done").isNotNull(), "SUCCESS").otherwise(F.col("last"))
    end = F.coalesce(F.col("done.ts"), F.col("ended.ts"))
    return per.select("task_id", "stage", status.alias("status"), F.when(F.col("begun").isNotNull(), F.timestamp_diff("MILLISECOND", F.col("begun.ts"), end)).alias("duration_ms"))


def task_row(stages: DataFrame, names: list[str] = STAGES) -> DataFrame:
    """One row a task: each stage's status (PENDING if it has none), the failed stage, and where to recover from."""
    wide = stages.groupBy("task_id").agg(*[F.coalesce(F.max(F.when(F.col("stage") == s, F.col("status"))), F.lit("PENDING")).alias(s) for s in names])
    failed = F.coalesce(*[F.when(F.col(s) == "FAILED", s) for s in names])
    recover = F.coalesce(*[F.when(F.col(s) != "SUCCESS", s) for s in names])
    return wide.withColumns({"failed_stage": failed, "recover_from_stage": recover, "complete": recover.isNull()})


def retried(tasks: DataFrame, retries: DataFrame, names: list[str] = STAGES) -> DataFrame:
    """Rows of retry tasks (task_id, retry_of_task_id, seq): the first of each parent supersedes it and inherits its SUCCESS stages."""
    first = latest(retries, ["retry_of_task_id"], [F.col("seq"), F.col("task_id")])
    parent = tasks.select(F.col("task_id").alias("retry_of_task_id"), *names)
    joined = first.join(parent, "retry_of_task_id")
    return joined.select(
        "task_id", "retry_of_task_id", *[F.when(F.col(s) == "SUCCESS", "SUCCESS").otherwise("PENDING").alias(s) for s in names],
        F.coalesce(*[F.when(F.col(s) != "SUCCESS", s) for s in names]).alias("recover_from_stage"),
    )


def retry_errors(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Why a retry request (task_id, retry_of_task_id, user_id, dataset_id, file_id) can't run; null if it can."""
    old = tasks.select(F.col("task_id").alias("retry_of_task_id"), *[F.col(c).alias(f"_{c}") for c in ("user_id", "dataset_id", "file_id", "superseded_by", "complete")], F.lit(True).alias("_known"))
    joined = requests.join(old, "retry_of_task_id", "left")
    error = (
        F.when(F.col("retry_of_task_id").isNull(), "missing_parent")
        .when(F.col("retry_of_task_id") == F.col("task_id"), "self_retry")
        .when(F.col("_known").isNull(), "unknown_parent")
        .when(~F.col("user_id").eqNullSafe(F.col("_user_id")), "user_mismatch")
        .when(~F.col("dataset_id").eqNullSafe(F.col("_dataset_id")), "dataset_mismatch")
        .when(~F.col("file_id").eqNullSafe(F.col("_file_id")), "file_mismatch")
        .when(F.col("_superseded_by").isNotNull() & (F.col("_superseded_by") != F.col("task_id")), "superseded")
        .when(F.col("_complete"), "already_complete")
    )
    return joined.select("task_id", "retry_of_task_id", error.alias("error"))


def new_tasks(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """Of arrived messages (task_id, seq) the first of each task that isn't known yet."""
    return latest(arrived, ["task_id"], [F.col("seq")]).join(known.select("task_id"), "task_id", "left_anti")


def usage_summary(log: DataFrame, user_id: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Calls and token sums of a usage log; days `start` to `end`, both in."""
    log = _between(log if user_id is None else log.where(F.col("user_id") == user_id), start, end)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return log.agg(F.count("*").alias("calls"), zero("prompt_tokens"), zero("completion_tokens"), zero("total_tokens"))


def usage_by_day(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Calls and tokens of each user and day."""
    day = F.to_date("created_at").alias("day")
    return _between(log, start, end).groupBy("user_id", day).agg(F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))


def usage_listing(log: DataFrame, user_id: int | None = None, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
    """Rows of a usage log, newest first, 1,000 at most."""
    return _between(log if user_id is None else log.where(F.col("user_id") == user_id), start, end).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(min(limit, 1000))


def usage_rows(calls: DataFrame) -> DataFrame:
    """Calls as rows to append to a usage log, tokens that aren't known as 0."""
    return calls.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("prompt_tokens", "completion_tokens", "total_tokens")})


def _between(log: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        log = log.where(F.col("created_at") >= F.lit(start).cast("date").cast("timestamp"))
    return log if end is None else log.where(F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))


def resolved_models(requests: DataFrame, configs: DataFrame, system: DataFrame) -> DataFrame:
    """The config of each request (request_id, user_id, capability, config_id): the one named, the user's newest default, the system's; else an error."""
    live = configs.where("active")
    named = live.select(F.col("id").alias("config_id"), "user_id", F.col("id").alias("_named"))
    default = latest(live.where("is_default"), ["user_id", "capability"], [F.col("id").desc()]).select("user_id", "capability", F.col("id").alias("_default"))
    fallback = system.groupBy("capability").agg(F.max("id").alias("_system"))
    joined = requests.join(named, ["config_id", "user_id"], "left").join(default, ["user_id", "capability"], "left").join(F.broadcast(fallback), "capability", "left")
    found = F.coalesce("_named", "_default", "_system")
    source = F.when(F.col("_named").isNotNull(), "explicit").when(F.col("_default").isNotNull(), "default").when(F.col("_system").isNotNull(), "system")
    return joined.select("request_id", found.alias("resolved_id"), source.alias("resolved_by"), F.when(found.isNull(), "no_model").alias("error"))


def merged_config(rows: DataFrame, column: str, schema: str, defaults: dict) -> DataFrame:
    """Rows with their JSON config laid over the defaults field by field; what can't be read counts as missing."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return rows.withColumns({k: F.coalesce(parsed[k], F.lit(v)) for k, v in defaults.items()})


def providers(provider: DataFrame, model: DataFrame) -> DataFrame:
    """Active providers with the capabilities of each active model, by falling priority."""
    caps = model.where("active").groupBy("provider_id", "model_name").agg(F.sort_array(F.collect_set("capability")).alias("capabilities"))
    grouped = caps.groupBy("provider_id").agg(F.array_sort(F.collect_list(F.struct("model_name", "capabilities"))).alias("models"))
    return provider.where("active").join(grouped, F.col("id") == F.col("provider_id"), "left").select("id", "name", "priority", "models")
