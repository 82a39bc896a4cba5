"""Target-distribution importance resampling on hashed word runs, from a kept sparse count matrix."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm.common import cut_lineage
from tessera.llm.tokens import lists, pieces

#: Buckets of features; words in the longest run; words that a document needs to be drawn; percent drawn; seed; smoothing.
BUCKETS, RUN, WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Rows and stored numbers of the matrix that are worked on at once, at most (a row holds at most as many numbers as there are buckets).
BLOCK_ROWS, BLOCK_COUNTS = 1024, 1 << 17
#: Bytes of a row group of the kept matrix: what a task holds when it reads or writes one, however large its files are.
GROUP = 4 << 20
#: Bytes of a text whose words are held at once.
STRETCH = 1 << 20
#: Lower case for A-Z; a space for every other ASCII character that is no digit or letter.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of letters and digits of ASCII and of all characters beyond."""
    return text.encode().translate(_PLAIN).split()


def hashes(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and of all pairs of neighbours joined by a space. A pair's checksum goes on from its first word's."""
    ones = list(map(zlib.crc32, words))
    spaced = [zlib.crc32(b" ", c) for c in ones[:-1]]
    return (np.array(ones + list(map(zlib.crc32, words[1:], spaced)), np.int64) % buckets).astype(np.int32)


def row_of(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """One row of the matrix: buckets in order, their counts, and the number of words. A long text is counted by stretches."""
    data = (text or "").encode().translate(_PLAIN)
    if len(data) <= STRETCH:
        words = data.split()
        at, n = np.unique(hashes(words, buckets), return_counts=True)
        return at, n.astype(np.int64), len(words)
    total, n_words, start, last = np.zeros(buckets, np.int64), 0, 0, []
    while start < len(data):
        stop = data.find(b" ", start + STRETCH)
        stop = len(data) if stop < 0 else stop
        words = data[start:stop].split()
        total += np.bincount(hashes(last + words, buckets), minlength=buckets)
        if last:  # the word carried over for its pair was counted before
            total[zlib.crc32(last[0]) % buckets] -= 1
        n_words, start, last = n_words + len(words), stop, words[-1:] or last
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at], n_words


def matrix(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), buckets: int = BUCKETS) -> DataFrame:
    """The document-by-bucket counts, a row a document: `keep`, words, buckets, counts (arrays); Arrow's lists are CSR blocks.

    Null and empty texts are rows without counts. They are made where the documents lie, so nothing is shuffled, and handed
    on in blocks that are bounded in rows and numbers. A reader holds rows by the thousand, so that a row is no block.
    """
    docs = docs.select(*keep, F.col(text).alias("_text"))
    at = len(keep)
    numbers = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*docs.schema.fields[:at], T.StructField("words", T.IntegerType()), *numbers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces(whole, at)):
            start, rows, held = 0, [], 0
            for k, s in enumerate(batch.column(at)):
                rows.append(row_of(s.as_py(), buckets))
                held += len(rows[-1][0])
                if len(rows) == BLOCK_ROWS or held > BLOCK_COUNTS - buckets or k + 1 == batch.num_rows:
                    columns = [*[c.slice(start, len(rows)) for c in batch.columns[:at]], pa.array([r[2] for r in rows], pa.int32()), lists([r[0] for r in rows]), lists([r[1].astype(np.int32) for r in rows])]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
                    start, rows, held = k + 1, [], 0

    return docs.mapInArrow(run, schema)


def blocks(batch: pa.RecordBatch, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch of rows of the matrix by blocks of BLOCK_ROWS."""
    rows = rows or BLOCK_ROWS
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def column_sums(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Sums of the matrix by bucket. Each task sums its rows; what comes to the driver has `buckets` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in (b for whole in batches for b in blocks(whole)):
            at, n = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            total += np.bincount(at, n, buckets).astype(np.int64)  # of a block, exact in doubles
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket speaks for the target: a thousand times the logarithm of its smoothed share there over that in the source, floored."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), float(len(source))
    ratio = (t + 1.0) * (s.sum() + k) / ((s + 1.0) * (t.sum() + k))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(counted: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, n_features, weight (long) of every row of the matrix: its product with the gains, over its features, floored."""
    shared, at = counted.sparkSession.sparkContext.broadcast(gain), len(keep)  # a number a bucket
    schema = T.StructType([*[counted.schema[n] for n in keep], *[T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole)):
            ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column(at + 1)).to_numpy(zero_copy_only=False).astype(np.int64))]
            n = batch.column(at + 2).flatten().to_numpy().astype(np.int64)
            features, products = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * shared.value[batch.column(at + 1).flatten().to_numpy()])]
            n_features, product = np.diff(features[ends]), np.diff(products[ends])
            weight = np.where(n_features > 0, product // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], batch.column(at).cast(pa.int64()), pa.array(n_features), pa.array(weight)], schema.names)

    return counted.select(*keep, "words", "buckets", "counts").mapInArrow(run, schema)


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", percent: int = PERCENT, least: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs`: rank 1, 2, 3 ... where drawn, else null.

    Of rows with at least `least` words the `percent` hundredths of highest score are drawn without repeats: the weight plus
    Gumbel noise from a hash of seed and doc_id, so that each is drawn in proportion to exp(weight / 1000). Ties go to the
    smaller doc_id, null last, then to the row that comes first. Null text: no words, weight 0. Null doc_ids are hashed as
    an empty string. Repeated doc_ids are rows of their own. Empty `docs`: empty result; empty `target`: gains of the
    smoothing alone. Further columns of `docs` are ignored.

    The matrix is written once and read for its sums and for the product. Ranks need no sort of the whole: scores are
    whole numbers in a narrow range (noise and gains are logarithms of 64-bit numbers at most), so that the rows of each
    score are counted and those above summed. Of one score, runs of one doc_id in one partition are counted and summed
    alike, and only the rows of a run are numbered by sorting, so that many equal rows never meet in one task.
    """
    counted = cut_lineage(matrix(docs, text, buckets=buckets), {"parquet.block.size": GROUP})
    gain = gains(column_sums(counted, buckets), column_sums(matrix(target, text, (), buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(counted, gain).withColumn("score", F.col("weight") + noise)
    scored = cut_lineage(scored.select("doc_id", "n_features", "weight", F.col("score").cast("long").alias("score"), (F.col("n_words") >= least).alias("able"), F.monotonically_increasing_id().alias("_row")))
    tallies = scored.where("able").groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    tallies = tallies.select("score", "n", above.alias("above"), (F.floor(F.sum("n").over(W.partitionBy()) * percent / 100)).cast("long").alias("drawn"))
    ranked = scored.join(F.broadcast(tallies.where("above < drawn").withColumnRenamed("score", "_score")), F.col("able") & (F.col("score") == F.col("_score")), "left")
    drawn = ranked.where("above is not null").withColumn("_part", F.shiftright("_row", 33))
    runs = drawn.groupBy("score", "doc_id", "_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    runs = runs.select(F.col("score").alias("_of"), F.col("doc_id").alias("_id"), F.col("_part").alias("_in"), ahead.alias("ahead"))
    drawn = drawn.join(runs, (F.col("score") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_part") == F.col("_in")))
    inside = F.row_number().over(W.partitionBy("score", "doc_id", "_part").orderBy("_row"))
    drawn = drawn.withColumn("rank", F.col("above") + F.col("ahead") + inside).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    others = ranked.where("above is null").withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*out).unionByName(others.select(*out))
