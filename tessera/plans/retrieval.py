"""Queries over retrieval, fusion, reranking, context and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluate, rerank, retrieval
from tessera.session import table, written

TOP_K = 20


def coarse(text: Column) -> Column:
    """Search tokens as white space parts them, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\r\\f]+", -1), lambda w: w != "")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.substring("source", 4, 10).cast("long").alias("dataset_id"), "doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    queries = _asked(spark, sf_dir).select("query_id", coarse(F.col("text")).alias("terms"))
    fields = {"coarse": coarse(F.col("text")), "fine": T.lexical_terms(F.coalesce("text", F.lit("")))}
    return retrieval.bm25(queries, _chunks(spark, sf_dir), fields, {"coarse": 2.0, "fine": 1.0}, TOP_K, by)


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = retrieval.lexical_vectors(_asked(spark, sf_dir), "query_id")
    index = retrieval.lexical_vectors(_chunks(spark, sf_dir), "chunk_id", carry=("doc_id", "dataset_id"), only=asked)
    return retrieval.sparse(asked, index, TOP_K)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("dataset_id"), F.col("embedding").alias("vector"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _vectors(spark, sf_dir)
    queries = index.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.dense(queries, index, TOP_K)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", "doc_id", "dataset_id", F.round("score", 6).alias("score"), F.col("source_rank").cast("long").alias("source_rank"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of every benchmark item over all documents: best field of two, per dataset, then global."""
    return _rounded(_bm25(spark, sf_dir))


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner product of lexical vectors, every benchmark item over all documents."""
    return _rounded(_sparse(spark, sf_dir))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every 20th vector over all vectors, per dataset, then global."""
    return _rounded(_dense(spark, sf_dir))


def _item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").join(_vectors(spark, sf_dir), F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("query_id"), "vector")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {
        "bm25": lambda: _bm25(spark, sf_dir),
        "sparse": lambda: _sparse(spark, sf_dir),
        "dense": lambda: retrieval.dense(_item_vectors(spark, sf_dir), _vectors(spark, sf_dir), TOP_K),
    }
    return retrieval.recall(sources, list(sources), TOP_K, "strict", settle=written)[0]


def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three retrievers for every benchmark item, fused by reciprocal rank; if one of them fails, so does the query."""
    hits = _fused(spark, sf_dir)
    scores = [F.round(F.col("scores")[s], 6).alias(f"score_{s}") for s in ("bm25", "sparse", "dense")]
    return hits.select("query_id", "chunk_id", F.round("fused_score", 9).alias("fused_score"), *scores, F.col("rrf_rank").cast("long").alias("rrf_rank"))


def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits each source gave each query, zeros filled in."""
    hits = _rounded(_bm25(spark, sf_dir)).select("query_id", F.lit("bm25").alias("source")).unionByName(_rounded(_sparse(spark, sf_dir)).select("query_id", F.lit("sparse").alias("source")))
    grid = _asked(spark, sf_dir).select("query_id").crossJoin(F.broadcast(spark.createDataFrame([("bm25",), ("sparse",), ("dense",)], "source string")))
    counted = hits.groupBy("query_id", "source").agg(F.count("*").alias("hits"))
    return grid.join(counted, ["query_id", "source"], "left").select("query_id", "source", F.coalesce("hits", F.lit(0)).alias("hits"))


def rerank_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits reranked by a scorer that knows every other hit: by the length of the text, falling."""
    hits = _bm25(spark, sf_dir).select("query_id", "chunk_id", F.col("source_rank").alias("rrf_rank"))
    texts = _chunks(spark, sf_dir).select("chunk_id", F.coalesce("text", F.lit("")).alias("content"))
    scored = rerank.with_contents(hits, texts)
    model = scored.where("rrf_rank % 2 = 1").select("query_id", (F.col("rrf_rank") - 1).alias("doc_index"), F.col("rrf_rank").alias("position"), F.length("content").cast("double").alias("score"))
    out = rerank.map_results(scored.drop("content"), model, 8)
    return out.select("query_id", "chunk_id", F.col("rrf_rank").cast("long").alias("rrf_rank"), "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token-budgeted context of every benchmark item from its BM25 hits."""
    hits = _bm25(spark, sf_dir).select("query_id", "chunk_id", F.col("source_rank").alias("rank"))
    texts = _chunks(spark, sf_dir).select("chunk_id", F.col("text").alias("content"))
    packed = rerank.context(hits, texts, 1500)
    return packed.select("query_id", F.col("blocks").cast("long").alias("blocks"), "tokens", F.sha2("context", 256).alias("context_sha256"))


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of dense retrieval where vectors of the query's label are relevant."""
    ranked = _dense(spark, sf_dir).select("query_id", "chunk_id", F.col("source_rank").alias("rank"))
    v = _vectors(spark, sf_dir)
    label = F.col("dataset_id").alias("label")
    asked = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), label)
    m = evaluate.means(evaluate.per_label(ranked, asked, v.select("chunk_id", label), 10))
    return m.select("queries", *[F.round(c, 9).alias(c) for c in ("top1", "recall", "mrr", "ndcg")])


def sparse_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical vectors of all documents, the 32 heaviest terms each, ties by term."""
    from pyspark.sql import Window as W

    v = retrieval.lexical_vectors(table(spark, sf_dir, "documents"), "doc_id", top=32)
    w = v.withColumn("weight", F.round("weight", 9))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("weight").desc(), "token_id"))
    return w.withColumn("_r", rank).where("_r <= 32").drop("_r")


QUERIES = {
    "bm25_topk": bm25_topk,
    "sparse_topk": sparse_topk,
    "dense_topk": dense_topk,
    "hybrid_recall": hybrid_recall,
    "hit_counts": hit_counts,
    "rerank_map": rerank_map,
    "context_pack": context_pack,
    "retrieval_quality": retrieval_quality,
    "sparse_normalised": sparse_normalised,
}

_TOP = """SELECT query_id, chunk_id, doc_id, dataset_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS source_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, dataset_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM {scored}) WHERE r <= 20
    QUALIFY source_rank <= 20"""
_CHUNKS = """chunks AS (SELECT try_cast(substr(source, 4, 10) AS BIGINT) AS dataset_id, doc_id, CAST(doc_id AS VARCHAR) AS chunk_id, coalesce(text, '') AS text FROM documents)"""
_BM25 = (
    _CHUNKS
    + r""", fields AS (
        SELECT dataset_id, doc_id, chunk_id, 'coarse' AS field, 2.0 AS boost, regexp_extract_all(lower(text), '[^ \t\n\r\f]+') AS terms FROM chunks
        UNION ALL SELECT dataset_id, doc_id, chunk_id, 'fine', 1.0, regexp_extract_all(lower(text), '[a-z0-9]+') FROM chunks),
    lens AS (SELECT *, len(terms) AS len FROM fields WHERE len(terms) > 0),
    stats AS (SELECT field, count(*) AS n, avg(len) AS mean FROM lens GROUP BY field),
    post AS (SELECT dataset_id, doc_id, chunk_id, field, boost, len, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM lens) GROUP BY ALL),
    dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
    asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[^ \t\n\r\f]+')) AS term FROM benchmark) GROUP BY ALL),
    part AS (SELECT query_id, dataset_id, doc_id, chunk_id, field,
        sum(times * boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
        FROM asked JOIN post USING (term) JOIN dfs USING (field, term) JOIN stats USING (field) GROUP BY ALL),
    bscored AS (SELECT query_id, dataset_id, doc_id, chunk_id, max(score) AS score FROM part GROUP BY ALL),
    bm25 AS ("""
    + _TOP.format(scored="bscored")
    + ")"
)
_SPARSE = (
    r"""dterms AS (SELECT chunk_id, doc_id, dataset_id, token, count(*) AS n FROM (SELECT *, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM chunks) GROUP BY ALL),
    dvec AS (SELECT chunk_id, doc_id, dataset_id, token, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS w FROM dterms),
    qterms AS (SELECT query_id, token, count(*) AS n FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL),
    qvec AS (SELECT query_id, token, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w FROM qterms),
    sscored AS (SELECT query_id, chunk_id, doc_id, dataset_id, sum(q.w * d.w) AS score FROM qvec q JOIN dvec d USING (token) GROUP BY ALL),
    sparse AS ("""
    + _TOP.format(scored="sscored")
    + ")"
)
_VECTORS = "vectors AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, vec_id AS doc_id, CAST(label AS BIGINT) AS dataset_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _dense_sql(asked: str) -> str:
    return f"""dscored AS (SELECT q.query_id, v.chunk_id, v.doc_id, v.dataset_id, list_cosine_similarity(q.v, v.v) AS score FROM ({asked}) q, vectors v WHERE list_cosine_similarity(q.v, v.v) >= 0),
    dense AS ({_TOP.format(scored="dscored")})"""


_EVERY = "SELECT doc_id AS query_id, v FROM vectors WHERE doc_id % 20 = 0"
_ITEMS = "SELECT item_id AS query_id, v FROM benchmark JOIN vectors ON item_id = doc_id"
_LIST = "SELECT query_id, chunk_id, doc_id, dataset_id, round(score, 6) AS score, source_rank FROM "
_COST = r"CAST(floor(2.0 * length(regexp_replace(content, '[\x00-\x7F]', '', 'g')) + 0.25 * (length(content) - length(regexp_replace(content, '[\x00-\x7F]', '', 'g')))) AS BIGINT)"

ORACLES = {
    "bm25_topk": f"WITH {_BM25} {_LIST} bm25",
    "sparse_topk": f"WITH {_CHUNKS}, {_SPARSE} {_LIST} sparse",
    "dense_topk": f"WITH {_VECTORS}, {_dense_sql(_EVERY)} {_LIST} dense",
    "hybrid_recall": f"""WITH {_BM25}, {_SPARSE}, {_VECTORS}, {_dense_sql(_ITEMS)},
        hits AS (SELECT *, 1 AS p, 'bm25' AS source FROM bm25 UNION ALL SELECT *, 2, 'sparse' FROM sparse UNION ALL SELECT *, 3, 'dense' FROM dense),
        fused AS (SELECT query_id, chunk_id, sum(1.0 / (60 + source_rank)) AS fused_score, min(p * 1000 + source_rank) AS first,
            max(score) FILTER (source = 'bm25') AS b, max(score) FILTER (source = 'sparse') AS s, max(score) FILTER (source = 'dense') AS d FROM hits GROUP BY ALL)
        SELECT query_id, chunk_id, round(fused_score, 9) AS fused_score, round(b, 6) AS score_bm25, round(s, 6) AS score_sparse, round(d, 6) AS score_dense,
            row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, first, chunk_id) AS rrf_rank FROM fused QUALIFY rrf_rank <= 20""",
    "hit_counts": f"""WITH {_BM25}, {_SPARSE}, hits AS (SELECT query_id, 'bm25' AS source FROM bm25 UNION ALL SELECT query_id, 'sparse' FROM sparse)
        SELECT item_id AS query_id, s.source, count(h.query_id) AS hits FROM benchmark CROSS JOIN (VALUES ('bm25'), ('sparse'), ('dense')) s(source)
        LEFT JOIN hits h ON h.query_id = item_id AND h.source = s.source GROUP BY ALL""",
    "rerank_map": f"""WITH {_BM25}, h AS (SELECT query_id, chunk_id, source_rank AS rrf_rank, CASE WHEN source_rank % 2 = 1 THEN CAST(length(text) AS DOUBLE) END AS rerank_score
            FROM bm25 JOIN chunks USING (chunk_id) WHERE trim(text) <> '')
        SELECT query_id, chunk_id, rrf_rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rrf_rank) AS rerank_rank
        FROM h QUALIFY rerank_rank <= 8""",
    "context_pack": f"""WITH RECURSIVE {_BM25}, h AS (SELECT query_id, text AS content, {_COST.replace("content", "text")} AS cost, row_number() OVER (PARTITION BY query_id ORDER BY source_rank) AS k
            FROM bm25 JOIN chunks USING (chunk_id) WHERE trim(text) <> ''),
        pack AS (SELECT query_id, k, cost AS tokens, 1 AS blocks, '[片段1]' || chr(10) || content AS context FROM h WHERE k = 1
            UNION ALL SELECT p.query_id, h.k, CASE WHEN p.tokens + h.cost <= 1500 THEN p.tokens + h.cost ELSE p.tokens END, CASE WHEN p.tokens + h.cost <= 1500 THEN p.blocks + 1 ELSE p.blocks END,
                CASE WHEN p.tokens + h.cost <= 1500 THEN p.context || chr(10) || chr(10) || '[片段' || (p.blocks + 1) || ']' || chr(10) || h.content ELSE p.context END
            FROM pack p JOIN h ON h.query_id = p.query_id AND h.k = p.k + 1)
        SELECT query_id, CAST(blocks AS BIGINT) AS blocks, tokens, sha256(context) AS context_sha256 FROM pack QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1""",
    "retrieval_quality": f"""WITH {_VECTORS}, {_dense_sql(_EVERY)},
        gold AS (SELECT q.doc_id AS query_id, v.chunk_id FROM vectors q JOIN vectors v USING (dataset_id) WHERE q.doc_id % 20 = 0),
        sizes AS (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL),
        j AS (SELECT d.query_id, d.source_rank AS rank, g.chunk_id IS NOT NULL AS hit FROM dense d LEFT JOIN gold g USING (query_id, chunk_id) WHERE d.source_rank <= 10),
        q AS (SELECT query_id, max(CASE WHEN rank = 1 AND hit THEN 1.0 ELSE 0.0 END) AS top1, count(*) FILTER (hit) / any_value(n) AS recall,
            coalesce(1.0 / min(rank) FILTER (hit), 0.0) AS mrr,
            coalesce(sum(1.0 / log2(rank + 1)) FILTER (hit), 0.0) / list_sum(list_transform(range(1, least(any_value(n), 10) + 1), lambda r: 1.0 / log2(r + 1))) AS ndcg
            FROM j JOIN sizes USING (query_id) GROUP BY query_id)
        SELECT count(*) AS queries, round(CAST(avg(top1) AS DOUBLE), 9) AS top1, round(avg(recall), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM q""",
    "sparse_normalised": r"""WITH t AS (SELECT doc_id, token_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token_id FROM documents) GROUP BY ALL)
        , w AS (SELECT doc_id, token_id, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM t)
        SELECT doc_id, token_id, weight FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token_id) <= 32""",
}
