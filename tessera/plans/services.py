"""Queries over marks, usage lists, model resolution, retry checks, scoped retrieval and encoder output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunks as C
from tessera.operators import retrieval
from tessera.operators import state as S
from tessera.plans import retrieval as R
from tessera.plans import tables as T
from tessera.session import table

STATUSES = ("dense_vector_status", "sparse_vector_status", "es_status", "lifecycle_status")
SCOPE = [0, 1, 2]


def chunk_all_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mark makes of every second active chunk's statuses."""
    t = T._settled(spark, sf_dir)
    ids, both = t.where("chunk_index % 2 = 1").select("chunk_id"), None
    for what in C.MARKS:
        marked = C.mark(t, ids, what, F.timestamp_seconds(F.lit(T.NOW))).where("changed").groupBy(F.lit(what).alias("mark"), *STATUSES).agg(F.count("*").alias("chunks"))
        both = marked if both is None else both.unionByName(marked)
    return both


def usage_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of the usage log: 1,000 at most, however many are asked for."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("long").alias("total_tokens"))
    rows = S.usage_rows(e.withColumns({"prompt_tokens": F.lit(None).cast("long"), "completion_tokens": F.col("total_tokens")}))
    return S.usage_listing(rows, limit=5000).select("id", "user_id", "prompt_tokens", "total_tokens")


def scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every 20th vector of three datasets over the vectors of those datasets."""
    index = retrieval.in_scope(R._vectors(spark, sf_dir), dataset_ids=SCOPE)
    return R._rounded(retrieval.dense(index.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector"), index, R.TOP_K))


def _either(key: str) -> Column:
    return F.when(F.col(key) % 2 == 0, "chat").otherwise("embed")


def resolved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of every customer's request among suppliers as configs and regions as the system's."""
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("user_id"), _either("c_custkey").alias("capability"), (F.col("c_custkey") % 40).alias("config_id"))
    configs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("user_id"), _either("s_suppkey").alias("capability"), (F.col("s_suppkey") % 3 != 0).alias("active"), (F.col("s_suppkey") % 5 == 0).alias("is_default"))
    system = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit("chat").alias("capability"))
    return S.resolved_models(requests, configs, system)


def retry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every order, as a retry of another one, may run, or why not."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 2).alias("user_id"), (F.col("o_orderkey") % 4).alias("dataset_id"), F.lit(1).alias("file_id"))
    parent = F.when(F.col("task_id") % 7 == 0, F.lit(None)).when(F.col("task_id") % 11 == 0, F.col("task_id")).otherwise(F.col("task_id") + 4)
    tasks = o.withColumns({"superseded_by": F.when(F.col("task_id") % 13 == 0, F.col("task_id") + 1), "complete": F.col("task_id") % 3 == 0})
    return S.retry_errors(o.withColumn("retry_of_task_id", parent), tasks)


def encoder_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding read as a sparse encoder's output: the 8 heaviest of its positive weights, in the order of tokens."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("token", "weight"))
    made = retrieval.normalised(e, 8)
    return made.select("key", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "error")


QUERIES = {f.__name__: f for f in (chunk_all_marks, usage_listing, scoped_topk, resolved_models, retry_checks, encoder_vectors)}

_OWN = {"dense_vector_status": "dense", "sparse_vector_status": "sparse", "es_status": "es", "lifecycle_status": "'ACTIVE'"}
_MARKED = " UNION ALL ".join(
    f"SELECT '{m}' AS mark, {', '.join((repr(sets[c]) if c in sets else own) + f' AS {c}' for c, own in _OWN.items())}, count(*) AS chunks FROM t WHERE act AND chunk_index % 2 = 1 GROUP BY ALL" for m, sets in C.MARKS.items()
)
_EITHER = "CASE WHEN {0} % 2 = 0 THEN 'chat' ELSE 'embed' END AS capability"

ORACLES = {
    "chunk_all_marks": f"WITH {T._CH} {_MARKED}",
    "usage_listing": "SELECT event_id AS id, user_id, CAST(0 AS BIGINT) AS prompt_tokens, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS total_tokens FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
    "scoped_topk": f"WITH {R._VECTORS[:-1]} WHERE label IN (0, 1, 2)), {R._dense_sql(R._EVERY)} {R._LIST} dense",
    "resolved_models": f"""WITH c AS (SELECT s_suppkey AS id, s_nationkey AS user_id, {_EITHER.format("s_suppkey")}, s_suppkey % 5 = 0 AS is_default FROM supplier WHERE s_suppkey % 3 <> 0),
        q AS (SELECT c_custkey AS request_id, c_nationkey AS user_id, {_EITHER.format("c_custkey")}, c_custkey % 40 AS config_id FROM customer),
        n AS (SELECT request_id, max(id) AS named FROM q JOIN c ON id = config_id AND c.user_id = q.user_id GROUP BY ALL),
        d AS (SELECT user_id, capability, max(id) AS def FROM c WHERE is_default GROUP BY ALL),
        j AS (SELECT request_id, named, def, CASE WHEN capability = 'chat' THEN (SELECT max(r_regionkey) + 1000 FROM region) END AS sys FROM q LEFT JOIN n USING (request_id) LEFT JOIN d USING (user_id, capability))
        SELECT request_id, coalesce(named, def, sys) AS resolved_id, CASE WHEN named IS NOT NULL THEN 'explicit' WHEN def IS NOT NULL THEN 'default' WHEN sys IS NOT NULL THEN 'system' END AS resolved_by,
            CASE WHEN coalesce(named, def, sys) IS NULL THEN 'no_model' END AS error FROM j""",
    "retry_checks": """WITH o AS (SELECT o_orderkey AS task_id, o_custkey % 2 AS user_id, o_orderkey % 4 AS dataset_id FROM orders),
        q AS (SELECT *, CASE WHEN task_id % 7 = 0 THEN NULL WHEN task_id % 11 = 0 THEN task_id ELSE task_id + 4 END AS parent FROM o)
        SELECT q.task_id, parent AS retry_of_task_id, CASE WHEN parent IS NULL THEN 'missing_parent' WHEN parent = q.task_id THEN 'self_retry' WHEN p.task_id IS NULL THEN 'unknown_parent'
            WHEN q.user_id <> p.user_id THEN 'user_mismatch' WHEN q.dataset_id <> p.dataset_id THEN 'dataset_mismatch' WHEN p.task_id % 13 = 0 AND p.task_id + 1 <> q.task_id THEN 'superseded'
            WHEN p.task_id % 3 = 0 THEN 'already_complete' END AS error FROM q LEFT JOIN o p ON p.task_id = parent""",
    "encoder_vectors": """WITH e AS (SELECT vec_id AS key, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings),
        k AS (SELECT * FROM e WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY w DESC, i) <= 8)
        SELECT key, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS indices, round(sum(w ORDER BY i), 6) AS total, CAST(NULL AS VARCHAR) AS error FROM k GROUP BY key""",
}
