"""Cross-tokenizer alignment: byte-owner arrays of two vocabularies' tokens, and how widely linked ids are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.llm.common import cut_lineage
from tessera.llm.tokens import Bpe, byte_bpe, lists, loaded, pieces, vocabulary

#: A table of at most so many id pairs, of 24 bytes each, is broadcast; a larger one is joined by a shuffle.
BROADCAST_PAIRS = 500_000
#: Bytes of text laid out in owner arrays at once; where a longer text has no common token end, the stretch grows.
STRETCH = 1 << 20
_EMPTY = np.zeros(0, np.int32)


class Pieces:
    """A sentencepiece vocabulary with byte fallback."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int32)


def owners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From token lengths in bytes, of the same sum: (links of a, links of b, tokens of a, of b before each common end).

    Each byte is owned by one token of either side. Where the pair of owners changes, a new link begins; where both change
    at once, a group ends. Owner arrays are laid out a stretch at a time, from common end to common end.
    """
    la, lb, ga, gb = [], [], [], []
    end_a, end_b = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
    i = j = done = 0
    total, reach = int(end_a[-1]) if len(a) else 0, STRETCH
    while done < total:
        p, q = np.searchsorted(end_a, done + reach, "right"), np.searchsorted(end_b, done + reach, "right")
        if done + reach < total:  # up to the last common end in reach
            common = np.intersect1d(end_a[i:p], end_b[j:q], assume_unique=True)
            if not len(common):
                reach *= 2
                continue
            p, q = np.searchsorted(end_a, common[-1], "right"), np.searchsorted(end_b, common[-1], "right")
        own_a = np.repeat(np.arange(i, p, dtype=np.int32), a[i:p])
        own_b = np.repeat(np.arange(j, q, dtype=np.int32), b[j:q])
        turn_a, turn_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        starts = np.r_[0, np.flatnonzero(turn_a | turn_b) + 1]
        cuts = np.flatnonzero(turn_a & turn_b) + 1
        la.append(own_a[starts])
        lb.append(own_b[starts])
        ga += [own_a[cuts], [p]]
        gb += [own_b[cuts], [q]]
        done, i, j, reach = int(end_a[p - 1]), p, q, STRETCH
    if not la:
        return _EMPTY, _EMPTY, _EMPTY, _EMPTY
    return np.concatenate(la), np.concatenate(lb), np.concatenate(ga).astype(np.int32), np.concatenate(gb).astype(np.int32)


def spelled(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, commas: np.ndarray, bars: np.ndarray, semicolons: np.ndarray) -> str:
    """Groups as `a1,a2|b1;a3|b2,b3`, ids of a before the bar; the last three hold each id's text with what follows it."""
    if not len(ga):
        return ""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[ga - 1] = last_b[gb - 1] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(a) + len(b), object)
    words_a, words_b = commas[a], commas[b]
    words_a[ga - 1] = bars[a[ga - 1]]
    words_b[gb - 1] = semicolons[b[gb - 1]]
    out[np.arange(len(a)) + np.r_[0, gb][group_a]] = words_a
    out[np.arange(len(b)) + ga[group_b]] = words_b
    return "".join(out.tolist())[:-1]


def aligned(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """`docs` with n_a, n_b, n_groups, n_links (long), groups (string) and pair_a, pair_b, pair_n (arrays of int).

    A encodes space and text by the byte-level vocabulary at `path_a`, special strings as plain text; B encodes the text by
    the sentencepiece model at `path_b`, which adds the space. groups spells the ids of both between common token ends;
    the pairs are the distinct linked ids and how often each is linked.

    Null and empty texts, and texts that either side doesn't give back byte by byte, have no tokens: zeros, '' and empty
    arrays. Columns of `docs` with these names are replaced, all others stay. No shuffle: each row by itself; owner
    arrays are laid out in stretches of a megabyte.
    """
    added = ["n_a", "n_b", "n_groups", "n_links", "groups", "pair_a", "pair_b", "pair_n"]
    docs = docs.drop(*added)
    at, names = docs.columns.index(text), [*docs.columns, *added]
    shared_a, shared_b = vocabulary(docs, path_a or byte_bpe()), vocabulary(docs, path_b or public_tokenizers.path("piece_bpe_32k.model"))
    kinds = [*[T.LongType()] * 4, T.StringType(), *[T.ArrayType(T.IntegerType())] * 3]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = loaded(Bpe, shared_a.value), loaded(Pieces, shared_b.value)
        ids = [str(k) for k in range(max(len(side_a.bytes_of), len(side_b.bytes_of)))]
        tables = [np.array([k + mark for k in ids], object) for mark in (",", "|", ";")]
        for whole in batches:
            for batch in pieces(whole, at):
                numbers, groups, linked = np.zeros((4, batch.num_rows), np.int64), [], ([], [], [])
                texts = [x or "" for x in batch.column(at).to_pylist()]
                for k, (x, ids_b) in enumerate(zip(texts, side_b.model.encode(texts, num_threads=1), strict=True)):
                    plain = (" " + x).encode()
                    if not x or b"".join(map(side_b.bytes_of.__getitem__, ids_b)) != plain:  # A's tokens are cut from these bytes
                        groups.append("")
                        for side in linked:
                            side.append(_EMPTY)
                        continue
                    a, b = np.array(side_a.encode(" " + x, specials=False), np.int32), np.array(ids_b, np.int32)
                    la, lb, ga, gb = owners(side_a.lengths[a], side_b.lengths[b])
                    numbers[:, k] = len(a), len(b), len(ga), len(la)
                    groups.append(spelled(a, b, ga, gb, *tables))
                    pair, times = np.unique(a[la].astype(np.int64) << 32 | b[lb], return_counts=True)
                    for side, found in zip(linked, (pair >> 32, pair & 0xFFFFFFFF, times), strict=True):
                        side.append(found.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, numbers), pa.array(groups, pa.string()), *map(lists, linked)], names)

    return docs.mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best) from `links` (pair_a, pair_b), a row for each document: in how many it is linked; whether most often of its a.

    Counted in the task before the shuffle. An a has no more partners than the other vocabulary has ids.
    """
    each = links.select(F.explode(F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"))).alias("p"))
    counts = each.groupBy("p.a", "p.b").agg(F.count("*").alias("count"))
    return cut_lineage(counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("a"))))


def alignment(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, keep: tuple[str, ...] = ("doc_id",), most: int = BROADCAST_PAIRS) -> DataFrame:
    """`keep`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`.

    What `aligned` finds is written once, as the corpus-wide counts and the sums over links both need it. The table of
    counts is broadcast up to `most` pairs; a larger one is joined by a shuffle on the pair, whose frequent keys are dealt
    out by AQE. Sums are taken in the task before they are shuffled. Null and repeated doc_ids are rows of their own.
    Empty input: empty result.
    """
    links = aligned(docs.select(*keep, F.col(text).alias("_text")), "_text", path_a, path_b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    links = cut_lineage(links.select(F.monotonically_increasing_id().alias("_row"), *keep, *numbers, digest, "pair_a", "pair_b", "pair_n"))
    counts = pair_counts(links)
    if counts.count() <= most:
        counts = F.broadcast(counts)
    each = links.select("_row", F.explode(F.arrays_zip(F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), F.col("pair_n").alias("n"))).alias("p")).select("_row", "p.*")
    sums = each.join(counts, ["a", "b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("count")).cast("long").alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    rows = links.drop("pair_a", "pair_b", "pair_n").join(sums, "_row", "left")
    return rows.select(*keep, *numbers, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
