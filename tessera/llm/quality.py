"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, by whole code points."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, shielded

#: Code points of an n-gram, so that it reaches over the border of most words; what stands before a text, and for U+0000.
ORDER = 5
START, NUL = 0xFDD0, 0xFDD1
#: Code points that are laid end to end at once, and of the texts that ask the model together.
PIECE, CHUNK = 1_000_000, 32_000_000
#: Different n-grams that a counting task holds before it sends them.
HELD = 2_000_000
#: One trusted text in so many isn't counted: thresholds come from those.
PARTS = 3
#: Code points of a window that counts as repeated where its text has held it before; a power of two.
WINDOW = 16
#: So many ids or keys at most are broadcast (under 100 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
BROADCAST_LANGUAGES = 100_000
_FACTORS = np.random.RandomState(20240611).randint(0, 2**63, ORDER, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def pieces(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, at, owner): code points of texts laid end to end, where the windows of ORDER begin, and whose each is.

    A long text goes on in the next piece, so memory is bounded by PIECE.
    """
    held, owners, total = [], [], 0

    def laid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in held])
        line = np.concatenate(held)
        line = np.where(line == 0, np.uint32(NUL), line)
        inside = np.ones(len(line), bool)
        for k in range(1, ORDER):
            inside[np.cumsum(sizes) - k] = False
        return line, np.flatnonzero(inside), np.repeat(owners, sizes - ORDER + 1)

    for k, t in enumerate(texts):
        units = np.frombuffer((chr(START) * (ORDER - 1) + (t or "")).encode("utf-32-le", "surrogatepass"), np.uint32)
        for low in range(0, len(units) - ORDER + 1, PIECE):
            part = units[low : low + PIECE + ORDER - 1]
            held.append(part)
            owners.append(k)
            total += len(part)
            if total >= PIECE:
                yield laid()
                held, owners, total = [], [], 0
    if held:
        yield laid()


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams of up to ORDER code points, given by place; the last place has the last factor."""
    total = np.zeros(len(columns[0]) if columns else 1, np.uint64)
    for c, f in zip(columns, _FACTORS[ORDER - len(columns) :], strict=True):
        total += c.astype(np.uint64) * f
    return total


class Grams:
    """The different windows of some texts, with their counts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.least = 0

    def add(self, line: np.ndarray, at: np.ndarray) -> None:
        key = hashed([line[at + k] for k in range(ORDER)])
        code, unique = pd.factorize(key)
        first = np.empty(len(unique), np.int64)
        first[code[::-1]] = at[::-1]
        self.parts.append((unique, np.bincount(code, minlength=len(unique)), line[first[:, None] + np.arange(ORDER)]))
        self.size += len(unique)
        if self.size > 2 * self.least + PIECE // 2:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """(points, counts), each window once."""
        if not self.parts:
            return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
        key, count, points = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        code, unique = pd.factorize(key)
        first = np.empty(len(unique), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        self.parts = [(unique, np.bincount(code, count, len(unique)).astype(np.int64), points[first])]
        self.size = self.least = len(unique)
        return self.parts[0][2], self.parts[0][1]


def repeats(texts: list[str | None]) -> np.ndarray:
    """For each text, how many of its windows of WINDOW code points stand in it further ahead as well."""
    units = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    key = np.concatenate(units).astype(np.uint64) if units else np.zeros(0, np.uint64)
    if len(key) < WINDOW:
        return np.zeros(len(texts), np.int64)
    step = 1
    while step < WINDOW:
        key = key[: len(key) - step] * _FACTORS[step % ORDER] + (key[step:] ^ (key[step:] >> np.uint64(29)))
        step *= 2
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(np.arange(len(owner)) + WINDOW <= np.cumsum(sizes)[owner])
    owner = owner[inside]
    again = pd.Series(key[inside] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).duplicated().to_numpy()
    return np.bincount(owner[again], minlength=len(texts))


def strings(points: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    n, k = points.shape
    return np.ascontiguousarray(points).view(f"<U{k}").ravel().tolist() if k else [""] * n


def by_context(points: np.ndarray, counts: np.ndarray | None = None) -> tuple[list[str], list[str], list[np.ndarray]]:
    """n-grams (each once) by what stands before the last code point: contexts, all that follow each, and their counts."""
    key = hashed(list(points[:, :-1].T)) if points.shape[1] > 1 else np.zeros(len(points), np.uint64)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(key)] if len(key) else starts
    following = np.ascontiguousarray(points[order, -1]).tobytes().decode("utf-32-le", "surrogatepass")
    sliced = [following[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return strings(points[order[starts], :-1]), sliced, [] if counts is None else np.split(counts[order], starts[1:])


def count_grams(texts: DataFrame) -> DataFrame:
    """(ctx, next, c): how often `next` follows the ORDER - 1 code points of `ctx` in the column `text`.

    Each task sends a context once, with all that follows it, for HELD different n-grams it has met.
    """

    def sent(found: Grams) -> Iterator[pa.RecordBatch]:
        points, counts = found.merged()
        ctx, following, each = by_context(points, counts)
        for k in range(0, len(ctx), 50_000):
            lists = [pa.array(each[k : k + 50_000], pa.list_(pa.int64())), pa.array([list(x) for x in following[k : k + 50_000]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(ctx[k : k + 50_000]), *lists], ["ctx", "cs", "nexts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Grams()
        for b in batches:
            for line, at, _ in pieces(b.column(0).to_pylist()):
                found.add(line, at)
                if found.least > HELD:
                    yield from sent(found)
                    found = Grams()
        yield from sent(found)

    sent_once = texts.select("text").mapInArrow(run, "ctx string, cs array<long>, nexts array<string>").repartition("ctx")
    each = sent_once.select("ctx", F.explode(F.arrays_zip("nexts", "cs")).alias("e"))
    return each.groupBy("ctx", F.col("e.nexts").alias("next")).agg(F.sum("e.cs").alias("c"))


def discounts(counts: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of grams with counts 1 to 4 (Chen and Goodman 1998); where one is 0, it is taken as 1."""
    n = [max(1, x) for x in counts]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


@dataclass
class Model:
    """One row for each context of 0 to ORDER - 1 code points: ctx, its back-off weight, what follows it and with what probability.

    The table grows with the trusted text; `unknown` is the probability of a code point that it hasn't, before back-off, and 1 if it has none at all.
    """

    table: DataFrame
    unknown: float


def fit(trusted: DataFrame) -> Model:
    """The model of the column `text` of `trusted`.

    Counts are sharded by context. Lower orders count the different code points before a gram. Each order's counts are
    joined with the next lower order's probabilities of the same code point after the shorter context.
    """
    top = cut_lineage(count_grams(trusted))
    counts = [top]
    for _ in range(ORDER - 1):
        counts.insert(0, counts[0].groupBy(F.substring("ctx", 2, ORDER).alias("ctx"), "next").agg(F.count("*").alias("c")))
    shorter = counts[0]
    for t in counts[1:-1]:
        shorter = shorter.unionByName(t)
    shorter = cut_lineage(shorter)
    few = shorter.unionByName(top).groupBy(F.length("ctx").alias("k")).agg(F.count("*").alias("n"), *[F.sum((F.col("c") == c).cast("long")).alias(f"n{c}") for c in (1, 2, 3, 4)])
    of = {r.k: r for r in few.collect()}  # one row for each order
    unknown = 1 / (of[0].n + 1) if of else 1.0
    lower, rows = None, []
    for k in range(ORDER):
        table = top if k == ORDER - 1 else shorter.where(F.length("ctx") == k)
        d = discounts([of[k][f"n{c}"] for c in (1, 2, 3, 4)] if k in of else [0, 0, 0, 0])
        if lower is None:
            joined = table.withColumn("below", F.lit(unknown))
        else:
            joined = table.withColumn("short", F.substring("ctx", 2, ORDER)).join(lower, ["short", "next"])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        many = [F.sum((F.least("c", F.lit(3)) == k).cast("long")) * d[k - 1] for k in (1, 2, 3)]
        grouped = joined.groupBy("ctx").agg(
            F.sum("c").alias("all"), (many[0] + many[1] + many[2]).alias("mass"), F.collect_list(F.struct("next", (F.col("c") - cut).alias("own"), "below")).alias("e")
        )  # no more follow a context than there are code points
        weight = F.col("mass") / F.col("all")
        packed = grouped.select(
            "ctx", weight.alias("weight"), F.col("e.next").alias("nexts"), F.transform("e", lambda x: x["own"] / F.col("all") + weight * x["below"]).alias("ps")
        )
        rows.append(cut_lineage(packed))
        lower = rows[-1].select(F.col("ctx").alias("short"), F.explode(F.arrays_zip("nexts", "ps")).alias("x")).select("short", F.col("x.nexts").alias("next"), F.col("x.ps").alias("below"))
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    return Model(table, unknown)


def _chunked(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The task's rows with the number of their chunk: texts of CHUNK code points or so, and a longer one by itself."""
    first, chunk, held = TaskContext.get().partitionId() << 32, 0, 0
    for b in batches:
        sizes = [len(t or "") for t in b.column(at).to_pylist()]
        low, part = 0, 0
        for k, n in enumerate(sizes):
            if held and held + n > CHUNK or part > PIECE:
                if k > low:
                    yield first + chunk, b.slice(low, k - low)
                low, part = k, 0
                if held + n > CHUNK:
                    chunk, held = chunk + 1, 0
            held, part = held + n, part + n
        if len(sizes) > low:
            yield first + chunk, b.slice(low)


class Asked:
    """What the model answered to a chunk: log probabilities of n-grams and back-off weights of contexts, by hash."""

    def __init__(self, answers: pa.Table, unknown: float) -> None:
        ctx, nexts = answers.column("ctx").to_pylist(), answers.column("nexts").to_pylist()
        logw = answers.column("logw").to_numpy()
        lists = answers.column("logps").combine_chunks()
        offsets, logp = lists.offsets.to_numpy(), lists.values.to_numpy()
        length = np.array([len(c) for c in ctx])
        self.unknown, self.grams, self.weights = math.log(unknown), [], []
        for k in range(ORDER):
            rows = np.flatnonzero(length == k)
            points = np.array([ctx[r] for r in rows], f"<U{k}").view(np.uint32).reshape(len(rows), k) if k and len(rows) else np.zeros((len(rows), k), np.uint32)
            own = hashed(list(points.T)) if k else np.zeros(len(rows), np.uint64)
            self.weights.append(_sorted(own, logw[rows]))
            many = np.array([len(nexts[r]) for r in rows], np.int64)
            after = np.frombuffer("".join([nexts[r] for r in rows]).encode("utf-32-le", "surrogatepass"), np.uint32)
            spread = np.repeat(points, many, 0)
            values = np.concatenate([logp[offsets[r] : offsets[r + 1]] for r in rows]) if len(rows) else np.zeros(0)
            self.grams.append(_sorted(hashed([*spread.T, after]), values))

    def logs(self, points: np.ndarray) -> np.ndarray:
        """Log probability of the last code point of each window after the others."""
        total, left = np.zeros(len(points)), np.arange(len(points))
        for k in range(ORDER - 1, -1, -1):
            seen, value = _found(self.grams[k], hashed(list(points[left, ORDER - 1 - k :].T)))
            total[left[seen]] += value[seen]
            left = left[~seen]
            if len(left) == 0:
                return total
            known, weight = _found(self.weights[k], hashed(list(points[left, ORDER - 1 - k : ORDER - 1].T)) if k else np.zeros(len(left), np.uint64))
            total[left[known]] += weight[known]
        total[left] += self.unknown
        return total


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], np.asarray(values, np.float64)[order]


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(table[0]) == 0:
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][at] == keys, table[1][at]


def log_perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with _n (code points), _nll (sum of negative log probabilities) and _again (`repeats`) of the text, which goes.

    Texts of a task form chunks of CHUNK code points. A chunk asks the model once for each different context of its
    texts; the answers come by a join on the context, and the chunk's rows, packed, meet them by a cogroup on the chunk.
    So what is shuffled is each text once, compressed, and the different n-grams of each chunk, never those of each text,
    and no part of the model is gathered. `docs` is read twice and must give the same rows in the same tasks, as a table
    does; a chunk without answers ends the job.
    """
    names, at = docs.columns, docs.columns.index("text")
    rest = [n for n in names if n != "text"]
    unknown, told = model.unknown, [*rest, "_n", "_nll", "_again"]

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(chunk: int, found: Grams) -> Iterator[pa.RecordBatch]:
            points, _ = found.merged()
            for k in range(ORDER):
                _, first = np.unique(hashed(list(points[:, k:].T)), return_index=True)
                ctx, following, _ = by_context(points[first, k:])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ctx), chunk)), pa.array(ctx, pa.string()), pa.array(following, pa.string())], ["chunk", "ctx", "asked"])

        before, found = None, Grams()
        for chunk, b in _chunked(batches, 0):
            if before is not None and chunk != before:
                yield from sent(before, found)
                found = Grams()
            before = chunk
            for line, where, _ in pieces(b.column(0).to_pylist()):
                found.add(line, where)
        if before is not None and found.parts:
            yield from sent(before, found)

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for chunk, b in _chunked(batches, at):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = [pa.ipc.open_stream(r).read_all() for r in left.column("rows").to_pylist()]
        sizes = [[len(t or "") for t in p.column(at).to_pylist()] for p in packed]
        if right.num_rows == 0 and unknown < 1 and any(map(any, sizes)):
            raise ValueError("a chunk found no answers: the documents were not the same when read again")
        found, asked = Grams(), Asked(right, unknown)
        for p in packed:
            for line, where, _ in pieces(p.column(at).to_pylist()):
                found.add(line, where)
        points, _ = found.merged()
        values = asked.logs(points)
        index = pd.Index(found.parts[0][0]) if found.parts else None
        out = []
        for p, n in zip(packed, sizes, strict=True):
            cost = np.zeros(p.num_rows)
            for line, where, owner in pieces(p.column(at).to_pylist()):
                which = index.get_indexer(hashed([line[where + k] for k in range(ORDER)]))
                cost -= np.bincount(owner, values[which], p.num_rows)
            out.append(pa.table([*[p.column(c) for c in rest], pa.array(n, pa.int64()), pa.array(cost), pa.array(repeats(p.column(at).to_pylist()), pa.int64())], told))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in kinds_of], told)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds_of = [*[to_arrow_type(docs.schema[c].dataType) for c in rest], pa.int64(), pa.float64(), pa.int64()]
    wanted = docs.select("text").mapInArrow(asks, "chunk long, ctx string, asked string")
    kept = F.filter(F.arrays_zip("nexts", "ps"), lambda e: F.contains(F.col("asked"), e["nexts"]))
    answers = wanted.join(model.table, "ctx").select(
        "chunk", "ctx", F.log("weight").cast("float").alias("logw"), F.array_join(F.transform(kept, lambda e: e["nexts"]), "").alias("nexts"), F.transform(kept, lambda e: F.log(e["ps"]).cast("float")).alias("logps")
    )
    packed = docs.mapInArrow(packs, "chunk long, rows binary")
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, f"{kinds}_n long, _nll double, _again long")


def _small(df: DataFrame, most: int) -> DataFrame:
    """Marked for a broadcast, if it has no more rows than `most`."""
    return F.broadcast(df) if df.count() <= most else df


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(_id): the documents that a label calls good."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()


class Limits:
    """The languages' means and thresholds of costs for each code point, found on rows (lang, _n, costs) of trusted texts."""

    def __init__(self, scored: DataFrame, costs: list[str], quantile: float, slack: float, prior: int) -> None:
        self.costs, self.slack, self.prior = costs, math.log(slack), prior
        sums = cut_lineage(scored.groupBy("lang").agg(F.sum("_n").alias("m"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(costs)]))
        self.means = list(sums.agg(*[F.sum(f"s{k}") / F.sum("m") for k in range(len(costs))]).first())
        if self.means[0] is None:
            return
        self.own = _small(sums.select(F.col("lang").alias("_of"), *[(F.col(f"s{k}") / F.col("m")).alias(f"_mean{k}") for k in range(len(costs))]), BROADCAST_LANGUAGES)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.ceil(F.col(f"_level{k}") * 1000).alias("step")) for k in range(len(costs))]))
        steps = cut_lineage(self._levels(scored).select("lang", each.alias("e")).groupBy("lang", "e.kind", "e.step").count())
        self.limits = {r.kind: r.limit for r in _at_quantile(steps.groupBy("kind", "step").agg(F.sum("count").alias("count")), ["kind"], quantile).collect()}
        found = _at_quantile(steps, ["lang", "kind"], quantile).groupBy(F.col("lang").alias("_in"))
        self.found = _small(cut_lineage(found.agg(*[F.max(F.when(F.col("kind") == k, F.col("limit"))).alias(f"_limit{k}") for k in range(len(costs))])), BROADCAST_LANGUAGES)

    def _levels(self, scored: DataFrame) -> DataFrame:
        """With the mean of each cost, `prior` times the language's mean counted in."""
        rows = scored.join(self.own, F.col("lang").eqNullSafe(F.col("_of")), "left")
        level = lambda k, c: (F.col(c) + self.prior * F.coalesce(f"_mean{k}", F.lit(self.means[k]))) / (F.col("_n") + self.prior)
        return rows.withColumns({f"_level{k}": F.when(F.col("_n") > 0, level(k, c)) for k, c in enumerate(self.costs)})

    def decide(self, scored: DataFrame) -> DataFrame:
        """`scored` with _level, _most of each cost, by number, and _accepted. Without trusted text all are accepted."""
        kinds = range(len(self.costs))
        if self.means[0] is None:
            return scored.withColumns({f"_level{k}": F.col(c) / F.when(F.col("_n") > 0, F.col("_n")) for k, c in enumerate(self.costs)} | {f"_most{k}": F.lit(None).cast("double") for k in kinds} | {"_accepted": F.lit(True)})
        rows = self._levels(scored).join(self.found, F.col("lang").eqNullSafe(F.col("_in")), "left")
        rows = rows.withColumns({f"_most{k}": F.coalesce(f"_limit{k}", F.lit(self.limits[k])) + self.slack for k in kinds})
        within = F.lit(True)
        for k in kinds:
            within = within & (F.col(f"_level{k}") <= F.col(f"_most{k}"))
        return rows.withColumn("_accepted", F.coalesce(within, F.lit(False)))


def _key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def judged(docs: DataFrame, labels: DataFrame, quantile: float, slack: float, prior_chars: int) -> DataFrame:
    """doc_id, lang, _key of each row of `docs` with _n, _perplexity, _threshold, _repeated, _most and _accepted."""
    docs = docs.select("doc_id", "lang", "text")
    ids = cut_lineage(trusted_ids(labels))
    known = docs.join(_small(ids, BROADCAST_IDS), docs["doc_id"] == F.col("_id"), "left_semi")
    held = F.pmod(F.xxhash64(F.lit("held"), F.col("_key")), F.lit(PARTS)) == 0
    model = fit(known.withColumn("_key", _key()).where(~held))
    scored = cut_lineage(log_perplexity(docs.withColumn("_key", _key()), model))
    good = scored.where("_n > 0").join(_small(ids, BROADCAST_IDS), scored["doc_id"] == F.col("_id"), "left_semi")
    calm = good.where(held)
    calm = cut_lineage(calm if calm.limit(1).count() else good)
    rows = Limits(calm, ["_nll", "_again"], quantile, slack, prior_chars).decide(scored)
    told = [F.exp("_level0").alias("_perplexity"), F.exp("_most0").alias("_threshold"), F.col("_level1").alias("_repeated"), F.col("_most1").alias("_most")]
    return rows.select("doc_id", "lang", "_key", "_n", *told, "_accepted")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.3, prior_chars: int = 50) -> DataFrame:
    """Every row of `docs` (doc_id, text, lang) with n_units, perplexity, threshold, repeated, most_repeated, accepted.

    The model is fitted to the texts that `labels` (doc_id, quality) calls good, all but one in PARTS, drawn by a hash of
    the text, from which the thresholds are found. It is of whole code points, in n-grams of ORDER, and a table that grows
    with the trusted text. Perplexity is for each code point; a text takes prior_chars more of its language's mean with
    it, so that a few words don't decide. A language's threshold is slack times the `quantile` of the perplexity of its
    trusted documents, found on totals of steps of 0.001 in its logarithm; a language without trusted documents takes that
    of all. Without any trusted document all are accepted.

    Such a model finds a text easy that says the same again and again. So the share of its windows of WINDOW code points
    that it has held before, `repeated`, has a threshold of its own, found in the same way (log(slack) above the quantile).

    Null and empty text: n_units 0, perplexity null, not accepted if there is any trusted text. Null lang is a language of its own. A document that is
    labelled twice is trusted if one label says so. Repeated rows are judged alike. Empty input: empty result. Further
    columns of `docs` are ignored. `docs` must be a table or give the same rows each time that it is read.
    """
    told = [F.col(f"_{c}").alias(c) for c in ("perplexity", "threshold", "repeated")]
    rows = judged(docs, labels, quantile, slack, prior_chars)
    return rows.select("doc_id", "lang", F.col("_n").alias("n_units"), *told, F.col("_most").alias("most_repeated"), F.col("_accepted").alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.3, prior_chars: int = 50) -> DataFrame:
    """The rows of `docs` that `quality` accepts, all columns as they were: those refused are taken out by their keys."""
    docs, restored = shielded(docs, "doc_id", "lang", "text")
    refused = judged(docs, labels, quantile, slack, prior_chars).where("not _accepted").select(F.col("lang").alias("_its"), F.col("_key").alias("_text")).distinct()
    refused = _small(cut_lineage(refused), BROADCAST_IDS)
    rows = docs.withColumn("_key", _key())
    return restored(rows.join(refused, (F.col("_key") == F.col("_text")) & F.col("lang").eqNullSafe(F.col("_its")), "left_anti"))


def _at_quantile(steps: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """For each group, the lowest step that has `quantile` of the counts at or below it."""
    sums = steps.withColumn("upto", F.sum("count").over(W.partitionBy(*by).orderBy("step"))).withColumn("all", F.sum("count").over(W.partitionBy(*by)))
    return sums.where(F.col("upto") >= F.lit(quantile) * F.col("all")).groupBy(*by).agg((F.min("step") / 1000).alias("limit"))
