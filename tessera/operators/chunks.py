"""The chunk truth table: writes, lookups, status changes, repair and deletion as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE, REMOVED = "ACTIVE", "REMOVED"
PENDING, SUCCESS, FAILED = "PENDING", "SUCCESS", "FAILED"
TRUTH = ["content_hash", "chunk_type", "start_line", "end_line", "chunk_index"]


def chunk_type(types: Column) -> Column:
    """A chunk's type: its elements' if it is one, mixed if several, else text."""
    kinds = F.array_distinct(types)
    return F.when(F.size(kinds) == 1, kinds[0]).when(F.size(kinds) > 1, "mixed").otherwise("text")


def drafts(chunks: DataFrame) -> DataFrame:
    """Rows to insert from chunks (doc_id, set_id, user_id, chunk_index, content, element_types, start_line, end_line).

    The id is a hash of document, index and content, so that a repeated task makes the same one.
    """
    digest = F.sha2("content", 256)
    return chunks.select(
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), digest), 256).alias("chunk_id"),
        "doc_id", "set_id", "user_id", "content", digest.alias("content_hash"), chunk_type(F.col("element_types")).alias("chunk_type"), "start_line", "end_line", "chunk_index",
        *[F.lit(PENDING).alias(c) for c in ("dense_vector_status", "sparse_vector_status", "es_status")], F.lit(ACTIVE).alias("lifecycle_status"),
    )


def replace_documents(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table with all rows of the fresh rows' documents replaced by them."""
    return table.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def active(table: DataFrame) -> DataFrame:
    """Rows that aren't removed."""
    return table.where(F.col("lifecycle_status") == ACTIVE)


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids (position, chunk_id), with the position they were asked for in; unknown ids are left out."""
    return ids.join(table, "chunk_id")


def contents(table: DataFrame, ids: DataFrame, user_id: int) -> DataFrame:
    """(chunk_id, content) of a user's active chunks among `ids`, blank ones left out."""
    return active(table).where((F.col("user_id") == user_id) & (F.trim("content") != "")).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "content")


def candidates(table: DataFrame, kind: str) -> DataFrame:
    """Active chunks that a stage still has to do: pretokenize, vector, sparse or bm25."""
    rule = {
        "pretokenize": F.col("dense_vector_status") == SUCCESS,
        "vector": F.col("dense_vector_status").isin(PENDING, FAILED) | F.col("sparse_vector_status").isin(PENDING, FAILED),
        "sparse": F.col("sparse_vector_status").isin(PENDING, FAILED),
        "bm25": F.col("es_status").isin(PENDING, FAILED),
    }[kind]
    return active(table).where(rule)


def stale(table: DataFrame, now: Column, seconds: int = 900, limit: int = 100) -> DataFrame:
    """The oldest active chunks whose dense index has been pending for `seconds`."""
    old = active(table).where((F.col("dense_vector_status") == PENDING) & (F.col("update_time") <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))))
    return old.orderBy("update_time", "chunk_id").limit(min(limit, 1000))


#: What each mark sets. A dense result sends the chunk back to the BM25 stage.
MARKS = {
    "indexing": {"dense_vector_status": PENDING},
    "indexed": {"dense_vector_status": SUCCESS, "es_status": PENDING},
    "failed": {"dense_vector_status": FAILED, "es_status": PENDING},
    "sparse_indexing": {"sparse_vector_status": PENDING},
    "sparse_indexed": {"sparse_vector_status": SUCCESS},
    "sparse_failed": {"sparse_vector_status": FAILED},
    "es_success": {"es_status": SUCCESS},
    "es_failed": {"es_status": FAILED},
    "es_retrying": {"es_status": PENDING},
    "removed": {"lifecycle_status": REMOVED},
    "claim_failed": {"dense_vector_status": PENDING},
}


def mark(table: DataFrame, ids: DataFrame, what: str, now: Column, only: Column | None = None) -> DataFrame:
    """The table with a mark set on the active chunks among `ids` for which `only` holds, and `changed` on every row."""
    hit = table.join(ids.select("chunk_id", F.lit(True).alias("_hit")).distinct(), "chunk_id", "left")
    change = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("lifecycle_status") == ACTIVE) & (F.lit(True) if only is None else only)
    hit = hit.withColumn("changed", change)
    sets = {c: F.when(F.col("changed"), v).otherwise(F.col(c)) for c, v in MARKS[what].items()}
    return hit.withColumns(sets | {"update_time": F.when(F.col("changed"), now).otherwise(F.col("update_time"))}).drop("_hit")


def update_actions(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """For each fresh row: insert, reindex (other content), metadata (another truth field) or noop."""
    old = active(table).select("chunk_id", *[F.col(c).alias(f"_{c}") for c in TRUTH])
    joined = fresh.join(old, "chunk_id", "left")
    same = F.lit(True)
    for c in TRUTH[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(F.col("_content_hash").isNull(), "insert").when(F.col("content_hash") != F.col("_content_hash"), "reindex").when(~same, "metadata").otherwise("noop")
    return joined.withColumn("action", action).drop(*[f"_{c}" for c in TRUTH])


def post_status() -> Column:
    """Where a chunk stands after processing."""
    return (
        F.when(F.col("lifecycle_status") != ACTIVE, "REMOVED")
        .when((F.col("dense_vector_status") == FAILED) | (F.col("sparse_vector_status") == FAILED), "VECTOR_FAILED")
        .when(F.col("es_status") == FAILED, "ES_FAILED")
        .when((F.col("dense_vector_status") == SUCCESS) & (F.col("sparse_vector_status") == SUCCESS) & (F.col("es_status") == SUCCESS), "COMPLETED")
        .otherwise("PROCESSING")
    )


def repairs(table: DataFrame, index: DataFrame) -> DataFrame:
    """What compensation does with each chunk that isn't settled, by whether its point is in the index."""
    joined = active(table).join(index.select("chunk_id", F.lit(True).alias("exists")).distinct(), "chunk_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    pending, failed = F.col("dense_vector_status") == PENDING, F.col("dense_vector_status") == FAILED
    action = F.when(pending & F.col("exists"), "mark_indexed").when(pending, "mark_failed").when(failed, "reindex").when(~F.col("exists"), "mark_failed").otherwise("none")
    return joined.withColumn("repair", action)


def delete(table: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The table with the chunks soft-deleted, and the points to drop by bucket."""
    marked = mark(table, ids, "removed", now)
    return marked, marked.where("changed").groupBy("bucket_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def validation(table: DataFrame) -> DataFrame:
    """Documents whose active chunks break the rules: indexes continuous from 0, ids unique, contents not blank."""
    per = active(table).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.countDistinct("chunk_index").alias("indexes"),
        F.countDistinct("chunk_id").alias("ids"), F.count_if(F.trim("content") == "").alias("blank"),
    )
    return per.withColumn("valid", (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("indexes") == F.col("n")) & (F.col("ids") == F.col("n")) & (F.col("blank") == 0))
