"""Queries over index documents and results, spans, budgets, back-filled states and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import indexing as I
from tessera.session import table


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a chunk with tokens, the assistants' as they are and others' in lower case."""
    c = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), (F.col("conv_id") % 100).alias("user_id"), (F.col("conv_id") % 10).alias("dataset_id"), F.col("conv_id").alias("doc_id"), F.lit(None).cast("string").alias("task_id"),
        (F.col("turn") - F.when(F.col("role") == "system", 1).otherwise(0)).alias("chunk_index"), F.lower(text).alias("coarse_tokens"), text.alias("fine_tokens"),
    )


def index_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk actions of all turns, of 400 bytes at most."""
    return I.index_documents(_tokens(spark, sf_dir), 400).select("index_id", "routing", "bytes", "error")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"batch": F.col("o_custkey"), "position": F.col("o_orderkey")})
    status = F.when(F.col("o_orderkey") % 4 == 0, 429).when(F.col("o_orderstatus") == "F", 200).otherwise(201)
    told = o.where("o_orderstatus <> 'P'").select("batch", "position", status.alias("status"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("reason"))
    return I.write_results(o.select("batch", "position", F.concat_ws("-", "batch", "position").alias("chunk_id")), told)


def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a bulk write, item by item."""
    return _results(spark, sf_dir).select("chunk_id", "error")


def write_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed items by reason."""
    return I.failures_by_reason(_results(spark, sf_dir))


def read_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw hits."""
    e = table(spark, sf_dir, "events")
    raw = e.select(
        F.col("event_id").alias("query"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("chunk_id"),
        F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("doc_id"), F.when(F.col("event_type") != "click", F.col("value")).alias("score"),
    )
    return I.read_hits(raw)


def replaced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all turns after the conversations of the first ten users were written again, blank turns aside."""
    keys = ["user_id", "dataset_id", "doc_id", "chunk_id", "fine_tokens"]
    old = _tokens(spark, sf_dir).select(*keys)
    fresh = old.where((F.col("user_id") < 10) & (F.col("fine_tokens") != "")).withColumn("fine_tokens", F.concat(F.lit("new "), "fine_tokens"))
    return I.replace_index(old, fresh).select("doc_id", "chunk_id", F.sha2("fine_tokens", 256).alias("tokens_sha256"))


def view_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn lies in its conversation's joined text."""
    return I.view_spans(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "char_start", "char_end", "char_count")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as boxes of a page."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("y0"), F.col("l_discount").alias("x0"), F.col("l_tax").alias("x1"))
    return I.reading_order(b, "page").select("page", "id", "place")


def image_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as images: the first five, up to a total of 800000."""
    return I.within_budget(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 5, 800_000).select("o_custkey", "o_orderkey", "nth")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url once, with the first page that has it."""
    return I.ordered_distinct(table(spark, sf_dir, "pages"), "url", "page_id")


def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pipeline rows, customers as logs."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    p = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("log_id"), F.lit("PENDING").alias("cleaning_status"), F.lit(None).cast("long").alias("cleaning_duration_ms"),
        F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("SUCCESS").alias("pipeline_status"), F.when(F.col("o_orderstatus") == "F", "earlier").alias("failure_reason"), F.when(F.col("o_orderstatus") == "P", "CHUNKING").alias("failed_stage"),
    )
    state = F.when(F.col("c_custkey") % 3 == 0, "success").when(F.col("c_custkey") % 3 == 1, "failed").otherwise("running")
    return I.backfilled(p, c.select(F.col("c_custkey").alias("log_id"), state.alias("task_status"), F.col("c_mktsegment").alias("log_reason"), F.col("c_nationkey").cast("long").alias("duration_ms")))


def restored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a stored row, some without lines."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.col("text").alias("content"), F.when(F.col("turn") % 3 != 2, F.col("turn")).cast("long").alias("start_line"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 2).cast("long").alias("end_line"))
    return I.restored_chunks(rows).drop("content")


def appended_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by user after calls without token counts were added: errors have none, of others the value."""
    e = table(spark, sf_dir, "events")
    n = F.floor("value").cast("long")
    counts = ["prompt_tokens", "completion_tokens", "total_tokens"]
    log = e.where("event_type <> 'error'").select("user_id", *[n.alias(c) for c in counts])
    calls = e.where("event_type = 'error'").select("user_id", *[F.lit(None).cast("long").alias(c) for c in counts[:2]], n.alias(counts[2]))
    return I.appended_usage(log, calls).groupBy("user_id").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in counts])


def text_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last 64 tokens of every document, as hashes, and its first line."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(T.first_tokens(F.col("text"), F.lit(64)), 256).alias("first_sha256"), F.sha2(T.last_tokens(F.col("text"), 64), 256).alias("last_sha256"), F.sha2(T.first_line(F.col("text")), 256).alias("line_sha256"))


def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as keys, masked and through a cipher, segments by alias, and where images are stored."""
    c = table(spark, sf_dir, "customer")
    cipher = F.lit("0123456789abcdef")
    return c.select(
        "c_custkey", T.masked_key(F.col("c_name")).alias("masked"), T.opened(T.sealed(F.col("c_name"), cipher), cipher).alias("opened"),
        T.canonical_name(F.col("c_mktsegment"), {"machinery": "machines", "building": "houses"}, "other").alias("segment"),
        T.image_key(F.concat(F.lit("files/"), F.col("c_name"), F.lit(".v1.pdf")), F.lit("image_001.png")).alias("image"),
    )


QUERIES = {
    f.__name__: f
    for f in (index_actions, write_results, write_failures, read_hits, replaced_index, view_spans, reading_order, image_budget, ordered_distinct, backfilled, restored_chunks, appended_usage, text_ends, names_and_keys)
}

_SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ENDS = f"'^{_SPACE}|{_SPACE}$', '', 'g'"
_TURNS = """t AS (SELECT conv_id || '-' || turn AS chunk_id, conv_id % 100 AS user_id, conv_id % 10 AS dataset_id, conv_id AS doc_id, CAST(NULL AS VARCHAR) AS task_id,
    turn - CASE WHEN role = 'system' THEN 1 ELSE 0 END AS chunk_index, lower(coalesce(text, '')) AS coarse_tokens, coalesce(text, '') AS fine_tokens FROM conversations)"""
_RESULTS = """r AS (SELECT o_custkey || '-' || o_orderkey AS chunk_id, CASE WHEN o_orderstatus = 'P' THEN 'es_bulk: bulk response missing item result' WHEN o_orderkey % 4 <> 0 THEN NULL
    WHEN o_orderstatus = 'F' THEN 'es_bulk: ' || o_orderpriority ELSE 'es_bulk: unknown error' END AS error FROM orders)"""

ORACLES = {
    "index_actions": f"""WITH {_TURNS}, a AS (SELECT *, user_id || '-' || dataset_id || '-' || doc_id || '-' || chunk_id AS index_id FROM t),
        b AS (SELECT *, strlen(CAST(to_json({{'index': {{'_id': index_id, 'routing': CAST(dataset_id AS VARCHAR)}}}}) AS VARCHAR)) + strlen(CAST(to_json({{'chunk_id': chunk_id, 'user_id': user_id, 'dataset_id': dataset_id, 'doc_id': doc_id,
            'task_id': task_id, 'chunk_index': chunk_index, 'coarse_tokens': coarse_tokens, 'fine_tokens': fine_tokens}}) AS VARCHAR)) + 19 AS bytes FROM a)
        SELECT index_id, CAST(dataset_id AS VARCHAR) AS routing, bytes, CASE WHEN chunk_index < 0 THEN 'chunk_index must be non-negative' WHEN trim(regexp_replace(coarse_tokens, '{_SPACE}', ' ', 'g')) = '' THEN 'coarse_tokens must be non-empty text'
            WHEN bytes > 400 THEN 'document too large: ' || bytes || ' bytes' END AS error FROM b""",
    "write_results": f"WITH {_RESULTS} SELECT chunk_id, error FROM r",
    "write_failures": f"WITH {_RESULTS} SELECT error, count(*) AS chunks, min(chunk_id) AS first_id, max(chunk_id) AS last_id FROM r WHERE error IS NOT NULL GROUP BY error",
    "read_hits": "SELECT event_id AS query, event_type AS chunk_id, user_id AS doc_id, CASE WHEN event_type <> 'click' THEN coalesce(value, 0) ELSE 0 END AS score FROM events WHERE event_type <> 'error' AND user_id % 5 <> 0",
    "replaced_index": f"WITH {_TURNS}, f AS (SELECT * FROM t WHERE user_id < 10 AND fine_tokens <> '') SELECT doc_id, chunk_id, sha256('new ' || fine_tokens) AS tokens_sha256 FROM f "
    "UNION ALL SELECT doc_id, chunk_id, sha256(fine_tokens) FROM t WHERE (user_id, dataset_id, doc_id) NOT IN (SELECT (user_id, dataset_id, doc_id) FROM f)",
    "view_spans": """WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations), s AS (SELECT *, CAST(coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM c)
        SELECT conv_id, turn, b AS char_start, b + n AS char_end, n AS char_count FROM s""",
    "reading_order": "SELECT l_orderkey AS page, l_linenumber AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_quantity, 1), round(l_discount, 1), round(l_tax, 1), l_linenumber) - 1 AS place FROM lineitem",
    "image_budget": """SELECT o_custkey, o_orderkey, row_number() OVER w AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)
        QUALIFY row_number() OVER w <= 5 AND sum(o_totalprice) OVER w <= 800000""",
    "ordered_distinct": "SELECT url, min(page_id) AS first_position FROM pages WHERE url IS NOT NULL GROUP BY url",
    "backfilled": """WITH l AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_custkey % 3 = 1 AS failed FROM customer WHERE c_custkey % 3 <> 2)
        SELECT o_custkey AS log_id, o_orderkey AS id, CASE WHEN failed THEN 'FAILED' WHEN failed = false THEN 'SUCCESS' ELSE 'PENDING' END AS cleaning_status, CAST(c_nationkey AS BIGINT) AS cleaning_duration_ms,
            CASE WHEN o_orderstatus <> 'O' THEN 'SUCCESS' WHEN failed THEN 'FAILED' ELSE 'PENDING' END AS pipeline_status, CASE WHEN o_orderstatus = 'F' THEN 'earlier' WHEN failed THEN c_mktsegment END AS failure_reason,
            CASE WHEN o_orderstatus = 'P' THEN 'CHUNKING' WHEN failed THEN 'CLEANING' END AS failed_stage FROM orders LEFT JOIN l ON c_custkey = o_custkey""",
    "restored_chunks": """WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS char_count, CASE WHEN turn % 3 <> 2 THEN turn ELSE 0 END AS s, CASE WHEN turn % 2 = 0 THEN turn * 2 ELSE 0 END AS e FROM conversations)
        SELECT conv_id, turn, char_count, CAST(s AS BIGINT) AS start_line, CAST(CASE WHEN e <> 0 THEN e ELSE s END AS BIGINT) AS end_line, CAST(CASE WHEN e <> 0 THEN e ELSE s END - s + 1 AS BIGINT) AS line_count FROM c""",
    "appended_usage": """SELECT user_id, count(*) AS calls, CAST(coalesce(sum(floor(value)) FILTER (event_type <> 'error'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(floor(value)) FILTER (event_type <> 'error'), 0) AS BIGINT) AS completion_tokens,
        CAST(sum(floor(value)) AS BIGINT) AS total_tokens FROM events GROUP BY user_id""",
    "text_ends": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), {_ENDS}) AS bare FROM documents),
        n AS (SELECT *, CAST(floor(0.25 * length(x) + 1.75 * length(regexp_replace(x, '[\x00-\x7F]', '', 'g'))) AS BIGINT) AS whole, floor(0.25 * length(bare) + 1.75 * length(regexp_replace(bare, '[\x00-\x7F]', '', 'g'))) AS n FROM d),
        p AS (SELECT doc_id, length(bare) AS size, unnest(range(greatest(1, length(bare) - 259), length(bare) + 1)) AS i, bare FROM n),
        w AS (SELECT doc_id, i, sum(CASE WHEN ord(substr(bare, i, 1)) < 128 THEN 1 ELSE 8 END) OVER (PARTITION BY doc_id ORDER BY i DESC) AS weight, size FROM p),
        f AS (SELECT doc_id, min(i) AS begins FROM w WHERE weight < 260 GROUP BY doc_id)
        SELECT doc_id, sha256(regexp_replace(CASE WHEN whole <= 64 THEN x ELSE substr(x, 1, CAST(floor(length(x) * 64 / greatest(whole, 1)) AS BIGINT)) END, {_ENDS})) AS first_sha256,
            sha256(CASE WHEN n <= 64 THEN bare ELSE regexp_replace(substr(bare, begins), {_ENDS}) END) AS last_sha256,
            sha256(coalesce(list_filter(list_transform(regexp_split_to_array(x, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: regexp_replace(l, {_ENDS})), lambda l: l <> '')[1], '')) AS line_sha256
        FROM n LEFT JOIN f USING (doc_id)""",
    "names_and_keys": """SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '****' ELSE c_name[:4] || '****....****' || right(c_name, 4) END AS masked, c_name AS opened,
        CASE lower(c_mktsegment) WHEN 'machinery' THEN 'machines' WHEN 'building' THEN 'houses' ELSE lower(c_mktsegment) END AS segment, 'files/image/' || c_name || '.v1/image_001.png' AS image FROM customer""",
}
