"""Queries over text functions, the chunk table, pipeline state and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T
from tessera.operators import chunks as C
from tessera.operators import semantic
from tessera.operators import state as S
from tessera.session import table

#: The moment that the chunk queries take as now, in seconds.
NOW = 1_700_000_000


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimate of every document, its length cut to 100 tokens, and what a window of 4000 leaves."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = T.estimate_tokens(F.col("text"))
    return d.select("doc_id", n.alias("tokens"), F.length(T.truncate_tokens(F.col("text"), F.lit(100))).cast("long").alias("cut_chars"), T.available_tokens(F.lit(4000), n, F.lit(100), F.lit(500)).cast("long").alias("left_tokens"))


def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and normal forms of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha1("text"), 1, 12).alias("sha1_12"), F.sha2(T.squeeze(F.col("text")), 256).alias("squeezed"),
        F.sha2(T.clean_markdown(F.col("text")), 256).alias("cleaned"), F.sha2(T.escape_cell(F.col("text")), 256).alias("cell"), F.length(T.compact_value(F.col("text"))).cast("long").alias("compact_chars"),
    )


def user_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the event log by tenant bucket."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.groupBy(T.bucket_of(F.col("user_id")).alias("bucket")).agg(F.count("*").alias("users"))


def kgram_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each document's 12-grams by its own first half."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.substr(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return d.select("doc_id", F.round(T.kgram_coverage(F.col("text"), half), 9).alias("coverage"))


def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and cells of every document read as a pipe table."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", *[c.cast("long").alias(n) for c, n in zip(T.table_shape(F.col("text")), ("table_rows", "table_cols"), strict=True)])


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("user_id", F.col("ts").alias("created_at"), k.alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"), (k + 1).alias("total_tokens"))


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens of the whole log."""
    return S.usage_summary(_log(spark, sf_dir))


def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens of each user and day."""
    return S.usage_by_day(_log(spark, sf_dir))


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event."""
    return S.latest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's JSON properties laid over defaults."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return S.merged_config(e, "props", "k long, mode string", {"k": 0, "mode": "auto"}).select("event_id", "k", "mode")


def _stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("PROCESSING")
    stage = F.element_at(F.array(*[F.lit(s) for s in S.STAGES]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("user_id").alias("task_id"), stage.alias("stage"), status.alias("status"), "ts", F.col("event_id").alias("seq"))


def stage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's stages, folded from the event log."""
    return S.fold_stages(_stage_events(spark, sf_dir)).select("task_id", "stage", "status")


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's stages in a row, with where it failed and recovers."""
    return S.task_row(S.fold_stages(_stage_events(spark, sf_dir)))


def retry_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first retry of each task inherits its finished stages."""
    tasks = task_rows(spark, sf_dir)
    retries = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("event_id") + 1_000_000).alias("task_id"), F.col("user_id").alias("retry_of_task_id"), F.col("event_id").alias("seq"))
    return S.retried(tasks, retries)


def new_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signup of each user without a large purchase: arrivals that aren't known yet."""
    e = table(spark, sf_dir, "events")
    return S.new_tasks(e.where("event_type = 'signup'").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq")), e.where("event_type = 'purchase' and value > 98").select(F.col("user_id").alias("task_id")))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return C.drafts(
        c.select(
            F.col("conv_id").alias("doc_id"), (F.col("conv_id") % 10).alias("set_id"), (F.col("conv_id") % 100).alias("user_id"), F.col("turn").alias("chunk_index"),
            F.coalesce("text", F.lit("")).alias("content"), F.array("role").alias("element_types"), F.lit(0).alias("start_line"), F.col("turn").cast("int").alias("end_line"),
        )
    )


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda m: F.element_at(F.array(*[F.lit(x) for x in ("PENDING", "SUCCESS", "FAILED")]), ((F.col("doc_id") + F.col("chunk_index") * m) % 3 + 1).cast("int"))
    t = _chunks(spark, sf_dir).withColumns({"dense_vector_status": by(1), "sparse_vector_status": by(2), "es_status": by(4)})
    life = F.when((F.col("doc_id") + F.col("chunk_index")) % 11 == 0, "REMOVED").otherwise("ACTIVE")
    return t.withColumns({"lifecycle_status": life, "bucket_id": T.bucket_of(F.col("user_id")), "update_time": F.timestamp_seconds(F.lit(1_699_990_000) + F.col("doc_id") % 20000)})


def chunk_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft rows of all chunks, with ids that repeat when a task does."""
    return _chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "content_hash", "chunk_type", "dense_vector_status", "lifecycle_status")


def chunk_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an update does with each chunk: a third has new content, a third other lines, of the rest half is new."""
    t = _settled(spark, sf_dir)
    fresh = _chunks(spark, sf_dir).withColumns({
        "content_hash": F.when(F.col("chunk_index") % 3 == 0, F.sha2(F.upper("content"), 256)).otherwise(F.col("content_hash")),
        "end_line": F.when(F.col("chunk_index") % 3 == 1, F.col("end_line") + 1).otherwise(F.col("end_line")),
    })
    return C.update_actions(t, fresh).groupBy("doc_id", "action").agg(F.count("*").alias("chunks"))


def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document by where they stand, with how many still miss an index."""
    t = _settled(spark, sf_dir).withColumn("post_status", C.post_status())
    return t.groupBy("doc_id", "post_status").agg(F.count("*").alias("chunks"), F.count_if(F.col("es_status") != "SUCCESS").alias("es_missing"), F.count_if(F.col("sparse_vector_status") != "SUCCESS").alias("sparse_missing"))


def chunk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of each document each stage still has to do."""
    t = _settled(spark, sf_dir)
    parts = [C.candidates(t, k).select("doc_id", F.lit(k).alias("stage")) for k in ("pretokenize", "vector", "sparse", "bm25")]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("doc_id", "stage").agg(F.count("*").alias("chunks"))


def chunk_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred chunks that have been pending longest."""
    return C.stale(_settled(spark, sf_dir), F.timestamp_seconds(F.lit(NOW))).select("chunk_id", "doc_id", "chunk_index")


def chunk_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compensation does with each document's chunks; every second one's point exists."""
    t = _settled(spark, sf_dir)
    return C.repairs(t, t.where("chunk_index % 2 = 0").select("chunk_id")).groupBy("doc_id", "repair").agg(F.count("*").alias("chunks"))


def chunk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to drop by bucket when every user's first chunks are deleted."""
    t = _settled(spark, sf_dir)
    _, points = C.delete(t, t.where("chunk_index = 0").select("chunk_id"), F.timestamp_seconds(F.lit(NOW)))
    return points.select("bucket_id", F.size("chunk_ids").alias("chunks"))


def chunk_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after failed chunks are claimed: statuses and how many changed."""
    t = _settled(spark, sf_dir)
    marked = C.mark(t, t.where("chunk_index % 2 = 1").select("chunk_id"), "indexed", F.timestamp_seconds(F.lit(NOW)), F.col("dense_vector_status") == "FAILED")
    return marked.groupBy("dense_vector_status", "es_status", "changed").agg(F.count("*").alias("chunks"))


def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chunks held against the rules."""
    return C.validation(_settled(spark, sf_dir)).select("doc_id", "n", "indexes", "blank", "valid")


def adjacent_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance of each vector to the one before it in its label, and the label's 95th percentile."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    d = semantic.distances(e)
    edge = d.groupBy("doc_id").agg(F.percentile("distance", F.lit(0.95)).alias("threshold"))
    return d.join(edge, "doc_id").select("doc_id", "position", F.round("distance", 9).alias("distance"), F.round("threshold", 9).alias("threshold"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector as atoms of their label, in groups of like meaning."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), F.col("label").alias("doc_id"), F.col("embedding").alias("vector"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "text")
    found = semantic.chunks(e.join(d, "position").select("doc_id", "position", "text", "vector"), 0.8, 0.25, 200, 2000)
    return found.select("doc_id", "chunk", "atoms", F.sha2("content", 256).alias("content_sha256"))


def provider_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as providers, nations as models with capabilities."""
    p = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("priority"), F.lit(True).alias("active"))
    m = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("provider_id"), F.col("n_name").alias("model_name"), F.when(F.col("n_nationkey") % 2 == 0, "chat").otherwise("embed").alias("capability"), (F.col("n_nationkey") % 5 != 0).alias("active"))
    return S.providers(p, m).select("id", "name", F.array_join(F.transform("models", lambda x: F.concat_ws(":", x["model_name"], F.array_join(x["capabilities"], "+"))), ",").alias("models"))


def tenant_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue of each nation: the star join as a tenant roll-up."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    li, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "nation")
    per = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = o.join(per, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("revenue"), 2).alias("revenue"))


QUERIES = {
    f.__name__: f
    for f in (
        token_estimate, text_digests, user_buckets, kgram_coverage, table_shapes, usage_summary, usage_by_day, latest_event, config_merge, stage_fold, task_rows, retry_lineage, new_tasks,
        chunk_drafts, chunk_actions, chunk_status, chunk_candidates, chunk_stale, chunk_repairs, chunk_delete, chunk_marks, chunk_validation,
        adjacent_distances, semantic_chunks, provider_models, tenant_join,
    )
}

_ASCII = r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))"
_TOK = f"CAST(floor(2.0 * {_ASCII} + 0.25 * (length(text) - {_ASCII})) AS BIGINT)"
_D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_LOG = "log AS (SELECT user_id, ts AS created_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_STAGES = """ev AS (SELECT user_id AS task_id, ['cleaning', 'chunking', 'vectorizing', 'sparse_vectorizing', 'pretokenizing', 'es_indexing'][event_id % 6 + 1] AS stage,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' ELSE 'PROCESSING' END AS status, ts, event_id AS seq FROM events),
    fold AS (SELECT task_id, stage, CASE WHEN bool_or(status = 'SUCCESS') THEN 'SUCCESS' ELSE arg_max(status, (ts, seq)) END AS status FROM ev GROUP BY ALL)"""
_NAMES = S.STAGES
_WIDE = ", ".join(f"coalesce(max(status) FILTER (stage = '{s}'), 'PENDING') AS {s}" for s in _NAMES)
_FAILED = "CASE " + " ".join(f"WHEN {s} = 'FAILED' THEN '{s}'" for s in _NAMES) + " END"
_RECOVER = "CASE " + " ".join(f"WHEN {s} <> 'SUCCESS' THEN '{s}'" for s in _NAMES) + " END"
_TASKS = f"{_STAGES}, wide AS (SELECT task_id, {_WIDE} FROM fold GROUP BY task_id)"
_CH = """c AS (SELECT *, sha256(doc_id || '|' || chunk_index || '|' || content_hash) AS chunk_id FROM (SELECT conv_id AS doc_id, conv_id % 10 AS set_id, conv_id % 100 AS user_id, turn AS chunk_index,
    coalesce(text, '') AS content, sha256(coalesce(text, '')) AS content_hash, coalesce(role, 'text') AS chunk_type, turn AS end_line FROM conversations)),
    t AS (SELECT *, ['PENDING', 'SUCCESS', 'FAILED'][(doc_id + chunk_index) % 3 + 1] AS dense, ['PENDING', 'SUCCESS', 'FAILED'][(doc_id + chunk_index * 2) % 3 + 1] AS sparse,
    ['PENDING', 'SUCCESS', 'FAILED'][(doc_id + chunk_index * 4) % 3 + 1] AS es, (doc_id + chunk_index) % 11 <> 0 AS act, 1699990000 + doc_id % 20000 AS upd FROM c)"""

ORACLES = {
    "token_estimate": f"""WITH {_D}, n AS (SELECT *, {_TOK} AS tokens FROM d) SELECT doc_id, tokens,
        CASE WHEN tokens <= 100 THEN length(text) ELSE CAST(floor(length(text) * 100 / greatest(tokens, 1)) AS BIGINT) END AS cut_chars, greatest(0, 4000 - tokens - 100 - 500) AS left_tokens FROM n""",
    "text_digests": rf"""WITH {_D}, s AS (SELECT *, trim(regexp_replace(text, '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS q FROM d)
        SELECT doc_id, sha256(text) AS sha256, substr(sha1(text), 1, 12) AS sha1_12, sha256(q) AS squeezed,
        sha256(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')) AS cleaned,
        sha256(trim(regexp_replace(replace(text, '|', '\|'), '[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))) AS cell, CASE WHEN length(text) > 512 THEN 515 ELSE length(text) END AS compact_chars FROM s""",
    "table_shapes": rf"""WITH {_D}, r AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS rows FROM d)
        SELECT doc_id, len(rows) AS table_rows, coalesce(list_max(list_transform(rows, lambda x: len(string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|')))), 0) AS table_cols FROM r""",
    "usage_summary": f"WITH {_LOG} SELECT count(*) AS calls, CAST(coalesce(sum(k), 0) AS BIGINT) AS prompt_tokens, CAST(count(*) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(k + 1), 0) AS BIGINT) AS total_tokens FROM log",
    "usage_by_day": f"WITH {_LOG} SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS calls, CAST(coalesce(sum(k + 1), 0) AS BIGINT) AS total_tokens FROM log GROUP BY ALL",
    "latest_event": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "config_merge": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.mode'), 'auto') AS mode FROM events",
    "stage_fold": f"WITH {_STAGES} SELECT * FROM fold",
    "task_rows": f"WITH {_TASKS} SELECT *, {_FAILED} AS failed_stage, {_RECOVER} AS recover_from_stage, {_RECOVER} IS NULL AS complete FROM wide",
    "retry_lineage": f"""WITH {_TASKS}, r AS (SELECT event_id + 1000000 AS task_id, user_id AS retry_of_task_id FROM events WHERE event_type = 'error'
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
        SELECT r.task_id, retry_of_task_id, {", ".join(f"CASE WHEN {s} = 'SUCCESS' THEN 'SUCCESS' ELSE 'PENDING' END AS {s}" for s in _NAMES)}, {_RECOVER} AS recover_from_stage
        FROM r JOIN wide ON wide.task_id = retry_of_task_id""",
    "new_tasks": "SELECT user_id AS task_id, min(event_id) AS seq FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 98) GROUP BY user_id",
    "chunk_drafts": f"WITH {_CH} SELECT chunk_id, doc_id, chunk_index, content_hash, chunk_type, 'PENDING' AS dense_vector_status, 'ACTIVE' AS lifecycle_status FROM c",
    "chunk_actions": f"""WITH {_CH}, j AS (SELECT c.doc_id, CASE WHEN NOT act THEN 'insert' WHEN c.chunk_index % 3 = 0 AND sha256(upper(c.content)) <> c.content_hash THEN 'reindex'
        WHEN c.chunk_index % 3 = 1 THEN 'metadata' ELSE 'noop' END AS action FROM c JOIN t USING (chunk_id)) SELECT doc_id, action, count(*) AS chunks FROM j GROUP BY ALL""",
    "chunk_status": f"""WITH {_CH} SELECT doc_id, CASE WHEN NOT act THEN 'REMOVED' WHEN dense = 'FAILED' OR sparse = 'FAILED' THEN 'VECTOR_FAILED' WHEN es = 'FAILED' THEN 'ES_FAILED'
        WHEN dense = 'SUCCESS' AND sparse = 'SUCCESS' AND es = 'SUCCESS' THEN 'COMPLETED' ELSE 'PROCESSING' END AS post_status, count(*) AS chunks,
        count(*) FILTER (es <> 'SUCCESS') AS es_missing, count(*) FILTER (sparse <> 'SUCCESS') AS sparse_missing FROM t GROUP BY ALL""",
    "chunk_candidates": f"""WITH {_CH}, a AS (SELECT doc_id, 'pretokenize' AS stage FROM t WHERE act AND dense = 'SUCCESS' UNION ALL SELECT doc_id, 'vector' FROM t WHERE act AND (dense <> 'SUCCESS' OR sparse <> 'SUCCESS')
        UNION ALL SELECT doc_id, 'sparse' FROM t WHERE act AND sparse <> 'SUCCESS' UNION ALL SELECT doc_id, 'bm25' FROM t WHERE act AND es <> 'SUCCESS') SELECT doc_id, stage, count(*) AS chunks FROM a GROUP BY ALL""",
    "chunk_stale": f"WITH {_CH} SELECT chunk_id, doc_id, chunk_index FROM t WHERE act AND dense = 'PENDING' AND upd <= 1700000000 - 900 ORDER BY upd, chunk_id LIMIT 100",
    "chunk_repairs": f"""WITH {_CH} SELECT doc_id, CASE WHEN dense = 'PENDING' AND chunk_index % 2 = 0 THEN 'mark_indexed' WHEN dense = 'PENDING' THEN 'mark_failed' WHEN dense = 'FAILED' THEN 'reindex'
        WHEN chunk_index % 2 = 1 THEN 'mark_failed' ELSE 'none' END AS repair, count(*) AS chunks FROM t WHERE act GROUP BY ALL""",
    "chunk_marks": f"""WITH {_CH}, m AS (SELECT *, act AND chunk_index % 2 = 1 AND dense = 'FAILED' AS changed FROM t) SELECT CASE WHEN changed THEN 'SUCCESS' ELSE dense END AS dense_vector_status,
        CASE WHEN changed THEN 'PENDING' ELSE es END AS es_status, changed, count(*) AS chunks FROM m GROUP BY ALL""",
    "chunk_validation": f"""WITH {_CH} SELECT doc_id, count(*) AS n, count(DISTINCT chunk_index) AS indexes, count(*) FILTER (trim(content) = '') AS blank,
        min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AND count(DISTINCT chunk_index) = count(*) AND count(DISTINCT chunk_id) = count(*) AND count(*) FILTER (trim(content) = '') = 0 AS valid
        FROM t WHERE act GROUP BY doc_id""",
    "adjacent_distances": """WITH v AS (SELECT label AS doc_id, vec_id AS position, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
        d AS (SELECT doc_id, position, 1 - list_cosine_similarity(e, p) AS distance FROM v WHERE p IS NOT NULL), q AS (SELECT doc_id, quantile_cont(distance, 0.95) AS threshold FROM d GROUP BY ALL)
        SELECT doc_id, position, round(distance, 9) AS distance, round(threshold, 9) AS threshold FROM d JOIN q USING (doc_id)""",
    "semantic_chunks": f"""WITH RECURSIVE a AS (SELECT label AS doc_id, vec_id AS position, coalesce(text, '') AS text, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN documents ON vec_id = documents.doc_id),
        g AS (SELECT *, {_TOK} AS cost, row_number() OVER w AS k, 1 - list_cosine_similarity(e, lag(e) OVER w) AS gap FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
        q AS (SELECT doc_id, quantile_cont(gap, 0.8) AS threshold FROM g GROUP BY doc_id),
        s AS (SELECT g.doc_id, k, position, text, cost, coalesce(gap > threshold AND gap > 0.25, false) AS far FROM g JOIN q USING (doc_id)),
        r AS (SELECT doc_id, k, CAST(0 AS BIGINT) AS chunk, cost AS size FROM s WHERE k = 1 UNION ALL
            SELECT s.doc_id, s.k, CASE WHEN r.size + s.cost > 2000 OR (s.far AND r.size >= 200) THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + s.cost > 2000 OR (s.far AND r.size >= 200) THEN s.cost ELSE r.size + s.cost END
            FROM r JOIN s ON s.doc_id = r.doc_id AND s.k = r.k + 1)
        SELECT doc_id, chunk, count(*) AS atoms, sha256(string_agg(text, chr(10) || chr(10) ORDER BY position)) AS content_sha256 FROM r JOIN s USING (doc_id, k) GROUP BY doc_id, chunk""",
    "provider_models": """WITH m AS (SELECT n_regionkey AS id, n_name, n_name || ':' || CASE WHEN n_nationkey % 2 = 0 THEN 'chat' ELSE 'embed' END AS m FROM nation WHERE n_nationkey % 5 <> 0)
        SELECT r_regionkey AS id, r_name AS name, string_agg(m, ',' ORDER BY n_name) AS models FROM region LEFT JOIN m ON id = r_regionkey GROUP BY ALL""",
    "tenant_join": """SELECT n_name, count(*) AS orders, round(sum(revenue), 2) AS revenue FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY ALL)
        JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
}
