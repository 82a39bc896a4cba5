"""Improbable-feature digests: rare byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a feature; neighbouring features of which the rarest is picked; how often a feature must be picked.
WINDOW, AROUND, PICKED = 64, 64, 16
#: Bits of a Bloom filter, bits that a feature sets, features in a filter before the next one is chained on.
BITS, SET, FULL = 2048, 5, 160
#: Of the room between chance and complete overlap, what counts as none.
CUTOFF = 0.3
#: Steps of entropy (of at most 6 bits); the step at which most windows of prose lie; below LEAST a window repeats itself.
STEPS, MODE, LEAST = 1000, 680, 170
#: Documents in a range of doc_ids, and most ranges.
RANGE_DOCS, RANGES = 4096, 65_536
#: Bytes that are handled at once; a longer text by itself.
CHUNK = 1 << 18
#: n * log2(n) in units of 1 / ONE, as whole numbers, so that sums are exact whatever stands before a text.
ONE = 1 << 32
_PLUS = np.r_[0, np.rint(np.arange(1, 66) * np.log2(np.arange(1, 66)) * ONE)].astype(np.int64)
_GAIN = np.diff(_PLUS)
_INVALID = 1 << 30
_ODD = np.random.RandomState(97).randint(0, 2**63, 8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def ranks(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rank of the window at each byte of several texts laid end to end, low where its entropy is improbable.

    Where the window would leave the text, or is too uniform, the rank is -1. Entropy moves from one window to the next
    by the byte that leaves and the byte that comes, each by how often it stands in the window.
    """
    n = len(data)
    out = np.full(n, -1, np.int16)
    if n < WINDOW:
        return out
    order = np.argsort(data, kind="stable").astype(np.int32)
    place = order + data[order].astype(np.int32) * (n + WINDOW)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for t in range(1, WINDOW):
        near = place[t:] - place[:-t] < WINDOW
        if not near.any():
            break
        ahead[:-t] += near
        behind[t:] += near
    count_ahead, count_behind = np.empty(n, np.uint8), np.empty(n, np.uint8)
    count_ahead[order], count_behind[order] = ahead, behind
    start = np.bincount(data[:WINDOW], minlength=256)
    # a byte that comes stands among the 63 before it and itself; one that leaves, among itself and the 63 after it
    moves = _GAIN[count_behind[WINDOW:] - 1] - _GAIN[count_ahead[: n - WINDOW] - 1]
    sums = _PLUS[start].sum() + np.r_[0, np.cumsum(moves)]
    most = WINDOW * (WINDOW.bit_length() - 1) * ONE  # of a window without a repeated byte
    step = ((2 * STEPS * (most - sums) + most) // (2 * most)).astype(np.int32)
    rank = np.where(step < LEAST, -1, np.maximum(0, 999 - np.abs(step - MODE))).astype(np.int16)
    out[: len(rank)] = rank
    ends = np.cumsum(sizes)
    for e in ends:  # the windows that leave a text
        out[max(0, e - WINDOW + 1) : e] = -1
    return out


def picked(rank: np.ndarray) -> np.ndarray:
    """Places that are the first rarest of at least PICKED of the AROUND-wide neighbourhoods that hold them.

    Texts follow each other with WINDOW - 1 places of rank -1 between, so that no neighbourhood holds two texts.
    """
    n = len(rank) + AROUND - 1
    keys = np.full(n, _INVALID, np.int64 if n >= 1 << 20 else np.int32)
    shift = 40 if n >= 1 << 20 else 20
    invalid = np.int64(1) << 60 if shift == 40 else _INVALID
    keys[:] = invalid
    at = np.flatnonzero(rank >= 0)
    keys[at + AROUND - 1] = (rank[at].astype(keys.dtype) << shift) | at.astype(keys.dtype)
    width = 1
    while width < AROUND:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    best = keys[keys < invalid] & ((1 << shift) - 1)
    times = np.bincount(best, minlength=len(rank))
    return np.flatnonzero(times >= PICKED)


def hashed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the WINDOW bytes at each place."""
    if not len(at):
        return np.zeros(0, np.uint64)
    words = data[at[:, None] + np.arange(WINDOW)].view(np.uint64)
    h = (words * _ODD).sum(1, dtype=np.uint64)
    words = (words ^ (words >> np.uint64(29))) * _ODD[::-1]
    h ^= words.sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def filters(features: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, one row of 64-bit words each; features count once, in their order."""
    if len(features) > 1:
        _, first = np.unique(features, return_index=True)
        features = features[np.sort(first)]
    rows = -(-len(features) // FULL)
    flags = np.zeros(rows * BITS, bool)
    base = np.arange(len(features)) // FULL * BITS
    for k in range(SET):
        flags[base + ((features >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.uint64).reshape(rows, BITS // 64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised bit overlap, 0 to 1: of each filter of the shorter chain with its best one in the other, averaged.

    Overlap that chance explains, and CUTOFF of what lies above, counts as none. Two empty chains are alike.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    ones_a, ones_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    scores = []
    for row, n in zip(a, ones_a, strict=True):
        common = np.bitwise_count(b & row).sum(1, dtype=np.int64)
        most = np.minimum(ones_b, n)
        chance = n * ones_b / BITS
        low = chance + CUTOFF * (most - chance)
        scores.append(float(np.clip((common - low) / np.maximum(most - low, 1e-9), 0, 1).max()))
    return sum(scores) / len(scores)


def written(chain: np.ndarray) -> str:
    """A chain of filters as text: their number and their bits."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def chains(pieces: list[np.ndarray], rank: list[np.ndarray]) -> list[np.ndarray]:
    """The filters of several texts, given as bytes with the ranks of their windows.

    A text without any feature (short, or too uniform) has one: all of it.
    """
    out: list[np.ndarray] = []
    k = 0
    while k < len(pieces):
        stop, total = k, 0
        while stop < len(pieces) and (stop == k or total + len(pieces[stop]) <= CHUNK):
            total += len(pieces[stop])
            stop += 1
        data, sizes = np.concatenate(pieces[k:stop]), [len(p) for p in pieces[k:stop]]
        places = picked(np.concatenate(rank[k:stop]))
        features = hashed(data, places)
        bounds = np.searchsorted(places, np.r_[0, np.cumsum(sizes)])
        for j, p in enumerate(pieces[k:stop]):
            own = features[bounds[j] : bounds[j + 1]]
            if not len(own) and len(p):
                own = np.frombuffer(hashlib.sha256(p.tobytes()).digest()[:8], np.uint64)
            out.append(filters(own))
        k = stop
    return out


def all_ranks(pieces: list[np.ndarray]) -> list[np.ndarray]:
    """`ranks` of several texts, in chunks."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(pieces):
        stop, total = k, 0
        while stop < len(pieces) and (stop == k or total + len(pieces[stop]) <= CHUNK):
            total += len(pieces[stop])
            stop += 1
        sizes = np.array([len(p) for p in pieces[k:stop]])
        out += np.split(ranks(np.concatenate(pieces[k:stop]), sizes), np.cumsum(sizes)[:-1])
        k = stop
    return out


def as_bytes(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def spliced(text: str, data: np.ndarray, rank: np.ndarray, after: str, after_data: np.ndarray, after_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edited text and its ranks: the last half of `text` gives way to as many characters of `after`.

    Windows that lie in one of the two parts keep their ranks; those across the seam are marked by -2.
    """
    half = len(text) // 2
    head = len(as_bytes(text[: len(text) - half])) if len(data) != len(text) else len(text) - half
    tail = len(as_bytes(after[:half])) if len(after_data) != len(after) else min(half, len(after))
    edited = np.concatenate([data[:head], after_data[:tail]])
    out = np.full(len(edited), -1, np.int16)
    last = len(edited) - WINDOW + 1
    if last > 0:
        whole = max(0, min(head - WINDOW + 1, last))
        out[:whole] = rank[:whole]
        if last > head:
            out[head:last] = after_rank[: last - head]
        out[whole : min(head, last)] = -2
    return edited, out


def fill_seams(pieces: list[np.ndarray], rank: list[np.ndarray]) -> None:
    """Ranks of the windows across the seams, worked out together."""
    snippets, where = [], []
    for p, r in zip(pieces, rank, strict=True):
        at = np.flatnonzero(r == -2)
        if len(at):
            snippets.append(p[at[0] : at[-1] + WINDOW])
            where.append((r, at[0], len(at)))
    for (r, first, n), got in zip(where, all_ranks(snippets), strict=True):
        r[first : first + n] = got[:n]


class Row:
    """A document on its way: its text, bytes, ranks and filters."""

    __slots__ = ("chain", "data", "doc_id", "rank", "text")

    def __init__(self, doc_id: int | None, text: str, data: np.ndarray, rank: np.ndarray, chain: np.ndarray) -> None:
        self.doc_id, self.text, self.data, self.rank, self.chain = doc_id, text, data, rank, chain


def prepared(ids: list, texts: list[str]) -> list[Row]:
    """Rows with all that a document gives by itself."""
    data = [as_bytes(t) for t in texts]
    rank = all_ranks(data)
    return [Row(*x) for x in zip(ids, texts, data, rank, chains(data, rank), strict=True)]


def results(rows: list[Row], nexts: list[Row]) -> list[tuple]:
    """The result for each row with the document after it."""
    pairs = [spliced(r.text, r.data, r.rank, s.text, s.data, s.rank) for r, s in zip(rows, nexts, strict=True)]
    edited, rank = [p for p, _ in pairs], [q for _, q in pairs]
    fill_seams(edited, rank)
    made = chains(edited, rank)
    return [
        (r.doc_id, len(r.text), hashlib.sha256(e.tobytes()).hexdigest(), written(r.chain), written(c), likeness(r.chain, c), likeness(r.chain, s.chain))
        for r, s, e, c in zip(rows, nexts, edited, made, strict=True)
    ]


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _range_of(cuts: list[int]) -> Column:
    """In which range of descending doc_ids a row lies: first among every 256th cut, then among those between."""
    coarse = cuts[::256]
    above = lambda xs: F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in xs]), lambda c: c > F.col("doc_id")))
    if len(cuts) <= 256:
        return F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(above(cuts) if cuts else F.lit(0))
    first = above(coarse)
    inner = F.array(*[F.array(*[F.lit(c).cast("long") for c in cuts[k : k + 256]]) for k in range(0, len(cuts), 256)])
    mine = F.element_at(inner, F.greatest(first, F.lit(1)))
    return F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(
        F.when(first == 0, 0).otherwise((first - 1) * 256 + F.size(F.filter(mine, lambda c: c > F.col("doc_id"))))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of `docs` (doc_id, text) with its digest, its edited text's, and how alike they and the next one's are.

    The next document is the one with the next lower doc_id; after the last comes the first. The edited text has the last
    floor(n_chars / 2) characters replaced by the next document's first as many, or all. Rows are dealt into ranges of
    doc_ids at quantiles, one shuffle of the texts; the first row of each range is copied to the range before, so each
    task has all neighbours and goes through its rows once.

    Features are WINDOW-byte windows ranked by how improbable their entropy is; one that is the rarest of enough of its
    neighbourhoods goes into the chain of Bloom filters. Equal texts have equal fingerprints, whatever lies beside them.

    Null text counts as empty: no filter; two such are alike, one and a text aren't. Null doc_ids come last. Repeated
    doc_ids are ordered by a hash of the text. A single row is its own next one. Empty input: empty result. Further
    columns are ignored.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    ranges = max(1, min(RANGES, math.ceil(n / RANGE_DOCS)))
    fractions = [k / ranges for k in range(1, ranges)]
    cuts = ids.agg(F.percentile_approx("doc_id", fractions, max(10_000, 4 * ranges))).first()[0] if fractions else []
    cuts = sorted(set(cuts or []), reverse=True)
    place = _range_of(cuts)
    heads = ids.select("doc_id", place.alias("range")).groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()  # at most RANGES + 1
    before = [(r.range, r.head, heads[k - 1].range) for k, r in enumerate(heads)]
    known = F.broadcast(spark.createDataFrame(before, "range int, head long, before int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("range", place.cast("int")).join(known, "range")
    here, copy = F.struct("range", F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(here, copy)).otherwise(F.array(here))).alias("to"))
    ordered = (
        dealt.select("to.range", "to.copy", "doc_id", F.xxhash64("text").alias("tie"), "text")
        .repartition("range")
        .sortWithinPartitions("range", "copy", F.col("doc_id").desc_nulls_last(), "tie")
        .select("range", "copy", "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Row | None = None
        held_range, held_copy = None, False
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans, copies = part.column(0).to_pylist(), part.column(1).to_pylist()
                made = prepared(part.column(2).to_pylist(), part.column(3).to_pylist())
                rows, nexts = [], []
                for span, copied, row in zip(spans, copies, made, strict=True):
                    # what follows a copy in its range are further copies: rows of the same doc_id
                    if held is not None and held_range == span and not held_copy:
                        rows.append(held)
                        nexts.append(row)
                    held, held_range, held_copy = row, span, copied
                done = results(rows, nexts)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), SCHEMA, strict=True)] if done else [pa.array([], f.type) for f in SCHEMA], schema=SCHEMA)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
