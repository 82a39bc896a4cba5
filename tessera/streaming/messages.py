"""Envelopes of parse tasks, a bounded retry and dead letters, for batches and for Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fields of a task, with other names that they may come under; the first eight must be there.
FIELDS = {
    "task_id": (), "original_file_id": (), "user_id": (), "dataset_id": (), "file_type": (), "source_bucket": (), "source_object_key": (), "source_filename": (),
    "document_parse_task_id": ("document_parse_file_id",), "md_bucket": (), "md_object_key": (), "trigger_mode": (), "pdf_parser_backend": ("parser_backend",), "is_retry": (), "previous_task_id": (),
}
REQUIRED = 8
NUMBERS = ("user_id", "dataset_id")
DEFAULTS = {"trigger_mode": "upload_auto", "pdf_parser_backend": "mineru", "is_retry": "false"}
#: Bytes of an error's message that a dead letter keeps; times that a task is tried again, and seconds between.
MESSAGE_BYTES, RETRIES, BACKOFF_S = 1024, 3, 1.0


def parsed(messages: DataFrame, value: str = "value") -> DataFrame:
    """`messages` with the column `task`, a struct of FIELDS, and `error`, null for a good one.

    The payload may stand by itself or under "payload". A value that is no JSON object, a field that is missing or blank,
    and an id that is no number are errors: such a message is kept, with its error. Null value: invalid_json.
    """
    outer = F.from_json(F.col(value), "map<string,string>")
    inner = F.from_json(F.element_at(outer, "payload"), "map<string,string>")
    wrapped = F.map_contains_key(outer, F.lit("payload"))
    fields = F.when(wrapped, inner).otherwise(outer)
    get = lambda n: F.coalesce(*[F.element_at(F.col("_f"), x) for x in (n, *FIELDS[n])], F.lit(DEFAULTS.get(n)))
    needed = list(FIELDS)[:REQUIRED]
    missing = F.filter(F.array(*[F.when(F.coalesce(F.trim(get(n)), F.lit("")) == "", n) for n in needed]), lambda x: x.isNotNull())
    wrong = F.filter(F.array(*[F.when(get(n).try_cast("long").isNull(), n) for n in NUMBERS]), lambda x: x.isNotNull())
    error = (
        F.when(outer.isNull(), "invalid_json")
        .when(F.col("_f").isNull(), "invalid_payload")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(F.size(wrong) > 0, F.concat(F.lit("not a number: "), F.array_join(wrong, ", ")))
    )
    task = F.struct(*[(get(n).try_cast("long") if n in NUMBERS else get(n)).alias(n) for n in FIELDS])
    return messages.withColumn("_f", fields).withColumns({"task": task, "error": error}).drop("_f")


def cut_message(message: Column, most: int = MESSAGE_BYTES) -> Column:
    """An error's message, cut to `most` bytes of UTF-8."""
    whole = F.encode(message, "UTF-8")
    head = F.decode(F.substring(whole, 1, most), "UTF-8")
    return F.when(F.octet_length(whole) > most, F.concat(head, F.lit("...(truncated)"))).otherwise(message)


def dead_letters(failed: DataFrame, at: Column) -> DataFrame:
    """(key, value, headers) of failed messages (topic, key, value, headers, error_class, error, retry_count).

    The value goes on as it came; what is known of the failure is added to the headers it had.
    """
    none = F.lit("")
    added = F.create_map(
        F.lit("x-original-topic"), F.coalesce("topic", none), F.lit("x-exception-class"), F.coalesce("error_class", none), F.lit("x-exception-message"), F.coalesce(cut_message(F.col("error")), none),
        F.lit("x-retry-count"), F.col("retry_count").cast("string"), F.lit("x-original-key"), F.coalesce(F.col("key").cast("string"), none), F.lit("x-failed-at"), at.cast("string"),
    )
    old = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(added), k))
    return failed.select("key", "value", F.map_concat(old, added).alias("headers"))


def dispatched(messages: DataFrame, work: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame], retries: int = RETRIES, backoff_s: float = BACKOFF_S, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """(done, failed): what came of `messages` (topic, key, value, headers) under `work`.

    `work` takes good messages, parsed, and gives them back with error_class, error (null: done) and retriable. What is
    retriable is tried again, all of it at once, `retries` times at most with `backoff_s` between; other failures, and
    messages that can't be parsed, aren't. `settle` writes a table and reads it again, so that each try runs once.
    `failed` has error_class, error and retry_count, as `dead_letters` takes them.
    """
    read = settle(parsed(messages))
    columns = messages.columns
    failed = read.where("error is not null").select(*columns, F.lit("InvalidMessage").alias("error_class"), "error", F.lit(0).alias("retry_count"))
    left, done = read.where("error is null").drop("error"), None
    for attempt in range(retries + 1):
        tried = settle(work(left))
        good = tried.where("error is null").select(*columns, "task")
        done = good if done is None else done.unionByName(good)
        again = (F.col("error").isNotNull()) & F.coalesce("retriable", F.lit(False))
        end = tried.where(F.col("error").isNotNull() & (~again if attempt < retries else F.lit(True)))
        failed = failed.unionByName(end.select(*columns, "error_class", "error", F.when(F.coalesce("retriable", F.lit(False)), attempt).otherwise(0).alias("retry_count")))
        left = tried.where(again).select(*columns, "task")
        if attempt == retries or left.limit(1).count() == 0:
            break
        sleep(backoff_s)
    return done, failed


def consume(stream: DataFrame, work: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame], folder: str, at: Column | None = None, **options) -> StreamingQuery:
    """A stream of messages (topic, key, value, headers), worked on batch by batch: done and dead letters as tables.

    Offsets are committed after a batch's tables are written. Each batch has a folder of its own, which a batch that is
    run again overwrites, so that a crash doubles nothing.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        done, failed = dispatched(df, work, settle, **options)
        done.write.mode("overwrite").parquet(f"{folder}/done/batch_id={batch_id}")
        dead_letters(failed, F.current_timestamp() if at is None else at).write.mode("overwrite").parquet(f"{folder}/dead/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
