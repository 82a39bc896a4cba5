"""Documents, write results and hits of the lexical index; spans, reading order and image budgets of parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T

#: Fields of an index document, in order.
FIELDS = ["chunk_id", "user_id", "dataset_id", "doc_id", "task_id", "chunk_index", "coarse_tokens", "fine_tokens"]
#: Blanks that a spaced JSON has after its colons and commas: 12 and 7 of an operation and a document.
SPACES = 19


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (T.strip(F.col(c)) == "")


def index_documents(chunks: DataFrame, max_bytes: int = 131072) -> DataFrame:
    """Bulk actions of chunks (FIELDS): index_id, routing, document (JSON), bytes of operation and document, and error.

    error is the first rule that a chunk breaks, else null; broken chunks stay as rows, so nothing is lost. Null ids count
    as empty in index_id; the row then has an error if it is chunk_id. Further columns stay.
    """
    key = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("user_id", "dataset_id", "doc_id", "chunk_id")])
    kept = {"ignoreNullFields": "false"}
    document = F.to_json(F.struct(*FIELDS), kept)
    operation = F.to_json(F.struct(F.struct(key.alias("_id"), F.col("dataset_id").cast("string").alias("routing")).alias("index")), kept)
    made = chunks.withColumns({"index_id": key, "routing": F.col("dataset_id").cast("string"), "document": document, "bytes": (F.octet_length(operation) + F.octet_length(document) + SPACES).cast("long")})
    error = (
        F.when(_blank("chunk_id"), "chunk_id is required")
        .when(F.col("chunk_index").isNull() | (F.col("chunk_index") < 0), "chunk_index must be non-negative")
        .when(_blank("coarse_tokens"), "coarse_tokens must be non-empty text")
        .when(_blank("fine_tokens"), "fine_tokens must be non-empty text")
        .when(F.col("bytes") > max_bytes, F.concat(F.lit("document too large: "), F.col("bytes"), F.lit(" bytes")))
    )
    return made.withColumn("error", error)


def write_results(actions: DataFrame, responses: DataFrame) -> DataFrame:
    """What became of each bulk action (batch, position, chunk_id) by its response (batch, position, status, reason).

    error is null for a status of 200 or 201. An action without a response failed, as did one whose status is null. Of
    several responses to one action the highest status counts.
    """
    answer = F.max(F.struct(F.coalesce("status", F.lit(0)).alias("status"), "reason")).alias("told")
    told = responses.groupBy("batch", "position").agg(answer).select("batch", "position", "told.status", "told.reason")
    why = F.when(F.col("status").isNull(), "bulk response missing item result").otherwise(F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown error")))
    error = F.when(F.col("status").isin(200, 201), None).otherwise(F.concat(F.lit("es_bulk: "), why))
    return actions.join(told, ["batch", "position"], "left").select("batch", "position", "chunk_id", error.alias("error"))


def failures_by_reason(results: DataFrame) -> DataFrame:
    """Failed actions by reason: error, chunks, and a first and last chunk_id. The ids themselves stay rows of `results`."""
    return results.where("error is not null").groupBy("error").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


def read_hits(raw: DataFrame) -> DataFrame:
    """Hits (query, chunk_id, doc_id, score) of a backend: those without ids left out, a null score 0."""
    return raw.where("chunk_id is not null and chunk_id <> '' and doc_id is not null").withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))


def replace_index(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with all entries of the fresh rows' (user_id, dataset_id, doc_id) replaced by them."""
    keys = ["user_id", "dataset_id", "doc_id"]
    return index.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def view_spans(elements: DataFrame, by: str, order: str, text: str, joint: str = "\n\n") -> DataFrame:
    """Elements with where each lies in the text that they make when joined: char_start, char_end (exclusive), char_count.

    Null text counts as empty. Spans of one `by` are a running sum, streamed and never gathered.
    """
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    before = F.coalesce(F.sum(size + len(joint)).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return elements.withColumns({"char_start": before, "char_end": before + size, "char_count": size})


def reading_order(boxes: DataFrame, page: str) -> DataFrame:
    """Boxes (y0, x0, x1 and an id) of each page numbered from 0 from top to bottom, then from left to right, by tenths."""
    keys = [F.round(c, 1) for c in ("y0", "x0", "x1")]
    return boxes.withColumn("place", (F.row_number().over(W.partitionBy(page).orderBy(*keys, "id")) - 1).cast("long"))


def within_budget(assets: DataFrame, by: str, order: str, size: str, images: int = 20, most: int = 50 << 20) -> DataFrame:
    """The first assets of each `by` that are at most `images` and `most` bytes together; the first beyond ends the list."""
    upto = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    counted = assets.withColumns({"nth": F.count(F.lit(1)).over(upto), "total_bytes": F.sum(F.coalesce(F.col(size), F.lit(0))).over(upto)})
    return counted.where((F.col("nth") <= images) & (F.col("total_bytes") <= most))


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each value of `key` once, with its first position to order by; null is left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(position).alias("first_position"))


def backfilled(pipelines: DataFrame, logs: DataFrame) -> DataFrame:
    """Pipeline rows with the end states of their logs (log_id, task_status, log_reason, duration_ms) filled in.

    Only logs that ended in success or failed change a row: cleaning_status and its duration come from them, and what is
    still pending or not named takes the failure. All other rows stay as they are.
    """
    ended = logs.where(F.col("task_status").isin("success", "failed")).select("log_id", "task_status", "log_reason", "duration_ms")
    both = pipelines.join(ended, "log_id", "left")
    done, failed = F.col("task_status").isNotNull(), F.coalesce(F.col("task_status") == "failed", F.lit(False))
    return both.withColumns(
        {
            "cleaning_status": F.when(failed, "FAILED").when(done, "SUCCESS").otherwise(F.col("cleaning_status")),
            "cleaning_duration_ms": F.when(done, F.col("duration_ms")).otherwise(F.col("cleaning_duration_ms")),
            "pipeline_status": F.when(failed & (F.col("pipeline_status") == "PENDING"), "FAILED").otherwise(F.col("pipeline_status")),
            "failure_reason": F.when(failed & F.col("failure_reason").isNull(), F.col("log_reason")).otherwise(F.col("failure_reason")),
            "failed_stage": F.when(failed & F.col("failed_stage").isNull(), "CLEANING").otherwise(F.col("failed_stage")),
        }
    ).drop("task_status", "log_reason", "duration_ms")


def restored_chunks(rows: DataFrame) -> DataFrame:
    """Stored rows as chunks to encode again: start_line and end_line without nulls, char_count and line_count."""
    start = F.coalesce("start_line", F.lit(0))
    end = F.coalesce(F.nullif("end_line", F.lit(0)), F.nullif("start_line", F.lit(0)), F.lit(0))
    made = rows.withColumns({"start_line": start, "end_line": end})
    return made.withColumns({"char_count": F.length(F.coalesce("content", F.lit(""))).cast("long"), "line_count": F.col("end_line") - F.col("start_line") + 1})


def appended_usage(log: DataFrame, calls: DataFrame) -> DataFrame:
    """The usage log with more calls: null tokens count as 0."""
    counts = ["prompt_tokens", "completion_tokens", "total_tokens"]
    return log.unionByName(calls.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts}))
