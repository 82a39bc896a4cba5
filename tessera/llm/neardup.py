"""Near duplicates by Order MinHash, verified by banded alignment of words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, shielded, text_key

#: Words of a k-mer, sketches of a text, k-mers in a sketch.
K, SKETCHES, TAKEN = 5, 48, 2
SIMILARITY = 0.8
#: How many turns lie between the two sketches by which texts are paired again, round by round.
STEPS = (5, 11)
#: Texts and words, at most about, in a block of those that share a sketch; texts of a sketch that aren't parted by length.
BLOCK, BLOCK_WORDS, WHOLE = 4000, 2_000_000, 1000
#: So many tasks share the texts of one class when they are told its head.
SALTS = 16
KEY = ["key_hash", "key_crc", "key_bytes"]
_RANDOM = np.random.RandomState(20240607)
_SEEDS = _RANDOM.randint(0, 2**63, SKETCHES, dtype=np.int64).astype(np.uint64)
_ODD = _RANDOM.randint(0, 2**63, SKETCHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = _RANDOM.randint(0, 2**63, K, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[str]:
    """Words of a text in lower case, as white space parts them."""
    return (text or "").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_kmers(hashed: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-mers of a sequence of words, told apart by which occurrence in the text each is.

    A text of fewer than k words is one k-mer.
    """
    n = max(1, len(hashed) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, len(hashed))):
        total += hashed[j : j + n] * _POWERS[j]
    kmers = mixed(total)
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        which = np.empty(n, np.uint64)
        which[order] = (np.arange(n) - first).astype(np.uint64)
        kmers = np.where(which > 0, mixed(kmers + which * np.uint64(0x9E3779B97F4A7C15)), kmers)
    return kmers


def order_minhash(kmers: np.ndarray) -> np.ndarray:
    """For each hash function the TAKEN smallest k-mers, put back in the order of the text, as one key."""
    ranks = (kmers[None, :] ^ _SEEDS[:, None]) * _ODD[:, None]
    rows = np.arange(SKETCHES)
    chosen = []
    for _ in range(min(TAKEN, len(kmers))):
        at = ranks.argmin(1)
        chosen.append(at)
        ranks[rows, at] = np.uint64(2**64 - 1)
    keys = _SEEDS.copy()
    for at in np.sort(np.array(chosen), 0):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + kmers[at])
    return keys.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, the text's key, and the array `sketches`; for a text without words the array is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            keys = []
            for t in b.column(4).to_pylist():
                hashed = np.array([known[w] for w in words(t)], np.uint64)
                keys.append(order_minhash(labelled_kmers(hashed)) if len(hashed) else np.zeros(0, np.int64))
            offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", *KEY, "sketches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *text_key("text"), "text").mapInArrow(run, f"doc_id {kind}, key_hash long, key_crc long, key_bytes long, sketches array<long>")


def similarity(a: list[str], b: list[str], least: float = SIMILARITY) -> float:
    """Words aligned as a part of the longer text, by longest common subsequence in a band; 0 if below `least`.

    An alignment of that quality leaves at most (1 - least) of the longer text unmatched and so never leaves a band of
    that half-width around the diagonal. Common ends are aligned first, then bit-parallel rows.
    """
    if len(a) > len(b):
        a, b = b, a
    n = len(b)
    if n == 0:
        return 1.0
    need = least * n - 1e-9
    if len(a) < need:
        return 0.0
    lead = 0
    while lead < len(a) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < len(a) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : n - tail]
    if lead + tail + len(x) < need or lead + tail + sum((Counter(x) & Counter(y)).values()) < need:
        return 0.0
    width = n - int(np.ceil(need))
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    band = (1 << 2 * width + 1) - 1
    v = full
    for j, w in enumerate(y):
        m = places.get(w)
        if m:
            m &= band << j - width if j >= width else band >> width - j
            u = v & m
            v = ((v + u) | (v - u)) & full
    aligned = (lead + tail + len(x) - v.bit_count()) / n
    return aligned if aligned * n >= need else 0.0


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """`pairs` (a, b) whose texts, by `texts` (tid, text), are alike: a, b, similarity."""
    both = pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(words(x), words(y), least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])
            yield out.filter(pa.array([s > 0 for s in found], pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(v, label): for each end of `links` (a, b), one end that stands for all it is connected with.

    Each round maps every end to its least neighbour's least neighbour and draws the links between what they are mapped
    to. A group around one text, however large, is gone after one round. The maps are then applied one after another.
    The driver sees one flag a round.
    """
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    maps = []
    while True:
        parent = cut_lineage(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")))
        above = parent.select(F.col("v").alias("p"), F.col("p").alias("label"))
        maps.append(cut_lineage(parent.join(above, "p").select("v", "label")))
        to = maps[-1]
        moved = edges.join(to.select(F.col("v").alias("a"), F.col("label").alias("x")), "a").select("x", "b").distinct()
        moved = moved.join(to.select(F.col("v").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        edges = cut_lineage(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if edges.limit(1).count() == 0:
            break
    labels = maps.pop()
    while maps:
        labels = _after(maps.pop(), labels)
    return labels


def _after(first: DataFrame, then: DataFrame) -> DataFrame:
    """The map (v, label) that applies `first` and then `then`, which leaves what it doesn't know."""
    both = first.join(then.select(F.col("v").alias("label"), F.col("label").alias("further")), "label", "left")
    return cut_lineage(both.select("v", F.coalesce("further", "label").alias("label")))


def _apart(distinct: DataFrame, labels: DataFrame, step: int) -> DataFrame:
    """Pairs (a, b) of texts with two common sketches, `step` turns apart, that aren't connected yet.

    Two sketches at once are seldom common to texts that share but a passage. Each text is paired with one that is drawn
    from those with its two sketches, so there are no more pairs than texts times SKETCHES, however many share them.
    """
    known = distinct.join(labels.withColumnRenamed("v", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    turns = F.array(*[F.xxhash64(F.lit(t), F.col("sketches")[t], F.col("sketches")[(t + step) % SKETCHES]) for t in range(0, SKETCHES, 2)])
    entries = known.where(F.size("sketches") > 0).select("tid", "label", F.explode(turns).alias("both"))
    hubs = entries.groupBy("both").agg(F.min(F.struct(F.xxhash64("both", "tid").alias("draw"), F.col("tid").alias("hub"), F.col("label").alias("its"))).alias("h"), F.min("label").alias("low"), F.max("label").alias("high"))
    apart = entries.join(hubs.where("low <> high").select("both", "h.hub", "h.its"), "both").where("label <> its")
    return apart.select(F.least("tid", "hub").alias("a"), F.greatest("tid", "hub").alias("b")).distinct()


def worded(texts: DataFrame) -> DataFrame:
    """(tid, n, held): the number of words of each text of `texts` (tid, text) with any, and 16 bits of each word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            hashed = [np.array([known[w] for w in words(t)], np.uint64).astype(np.uint16) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in hashed], pa.int64()), pa.array([h.tobytes() for h in hashed], pa.binary())], ["tid", "n", "held"])

    return texts.select("tid", "text").mapInArrow(run, "tid long, n long, held binary")


def possible(sketch: int, rows: list[list], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of ids of one group that could be alike. A row is tid, label, n, late, part, held, shared.

    Pairs have different labels, are not both early, are of different parts if the group has two, and have `sketch` as the
    least of those that they share, so that no other group tries them. If L words of two texts align, at least 3 L - 1 less
    both lengths are followed by the next aligned word in both, so the texts have as many word pairs in common, and L words;
    those that have are aligned. Words of equal hash only let more through.
    """
    rows = sorted(rows, key=lambda r: r[2])
    tid, label, n, late, part = (np.array(x) for x in list(zip(*rows, strict=True))[:5])
    spelt = [np.frombuffer(r[5], np.uint16) for r in rows]
    shared = [set(r[6]) for r in rows]
    runs = []  # of one word and of two: each text's, all in one array, and where each begins
    for size in (1, 2):
        own = [labelled_kmers(w.astype(np.uint64), size).astype(np.uint16) for w in spelt]
        runs.append((own, np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])]))
    two = part.min() != part.max()
    upto = np.searchsorted(n, n / least + 1e-6, "right") if least > 0 else np.full(len(n), len(n))
    first_late = len(n) - int(late.sum())  # the late ones are the longer ones
    has = np.zeros(1 << 16, np.uint8)
    for k in range(len(n) - 1):
        low = max(k + 1, 0 if late[k] else first_late)
        differs = label[low : upto[k]] != label[k]
        rest = np.flatnonzero(differs & (part[low : upto[k]] != part[k]) if two else differs) + low
        if len(rest) == 0:
            continue
        low, high = rest[0], rest[-1] + 1
        aligned = np.ceil(least * n[rest] - 1e-9)
        could = np.ones(len(rest), bool)
        for (own, flat, at), need in zip(runs, (aligned, 3 * aligned - 1 - n[rest] - n[k]), strict=True):
            has[own[k]] = 1
            common = np.add.reduceat(has[flat[at[low] : at[high]]], at[low:high] - at[low], dtype=np.int64)
            has[own[k]] = 0
            could &= common[rest - low] >= need
        own = spelt[k].tolist()
        for r in rest[could]:
            if min(shared[k] & shared[r]) == sketch and (least <= 0 or similarity(own, spelt[r].tolist(), least) > 0):
                yield min(tid[k], tid[r]), max(tid[k], tid[r])


def _untried(distinct: DataFrame, labels: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of texts that have a sketch in common, aren't connected yet and could be alike.

    Only sketches with several components are looked at. Nothing that could be alike is left out: of two alike texts the
    shorter has `least` of the longer's words, and hashes of their words align as well (see `possible`). A sketch of up to
    WHOLE texts is one block, each text in it once. Those of more are parted by length, where both texts stand in one of two
    neighbouring bands, and the texts of a band dealt to blocks of BLOCK texts or BLOCK_WORDS words or so, each pair of
    blocks by itself. So no group is gathered, no pair is a row before it passes, and a text's words are joined to its rows
    once, when it is known where they go.
    """
    known = distinct.join(labels.withColumnRenamed("v", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    entries = known.select("tid", "label", F.explode(F.array_distinct("sketches")).alias("sketch"))
    several = entries.groupBy("sketch").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("sketch")
    left = entries.join(several, "sketch")
    shared = cut_lineage(left.groupBy("tid").agg(F.first("label").alias("label"), F.collect_list("sketch").alias("shared")))  # SKETCHES at most
    sized = cut_lineage(worded(texts.join(shared, "tid", "left_semi")).join(shared, "tid"))
    band = F.floor(F.log("n") / F.lit(-np.log(min(least, 0.99)))) if least > 0 else F.lit(0).cast("long")
    members = sized.select("tid", "label", "n", band.alias("at"), F.explode("shared").alias("sketch"))
    groups = cut_lineage(members.groupBy("sketch").agg(((F.count("*") <= WHOLE) & (F.sum("n") <= BLOCK_WORDS)).alias("whole")))
    keys = ["sketch", "band", "i", "j"]
    zero = F.lit(0).cast("long")
    once = members.join(groups.where("whole"), "sketch", "left_semi").select("sketch", F.lit(-1).cast("long").alias("band"), zero.alias("i"), zero.alias("j"), zero.alias("own"), F.lit(True).alias("late"), "tid")
    banded = members.join(groups.where("not whole"), "sketch", "left_semi").withColumn("band", F.explode(F.array("at", F.col("at") + 1)))
    needed = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_WORDS))
    late = F.col("at") == F.col("band")
    counts = banded.groupBy("sketch", "band").agg(needed.alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.when(late, F.col("n"))).alias("least_late"))
    # a band without texts that are late in it has no pair of its own: they meet in the band before; nor has a text that
    # is too short for the shortest of the late ones
    blocked = banded.join(counts.where("low <> high").select("sketch", "band", "blocks", "least_late"), ["sketch", "band"]).where(late | (F.col("n") >= F.floor(least * F.col("least_late"))))
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("tid"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = once.unionByName(blocked.select("sketch", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", late.alias("late"), "tid"))
    dealt = placed.join(sized.select("tid", "label", "n", "held", "shared"), "tid").select(*keys, "tid", "label", "n", "late", "own", "held", "shared").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in _with_end(batches):
            whole = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if whole is None or whole.num_rows == 0:
                continue
            key = np.stack([whole.column(c).to_numpy() for c in range(4)], 1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            stop = len(key) if b is None else starts[-1]  # the last group may go on in the next batch
            if stop:
                done = whole.slice(0, stop)
                rows = list(zip(*[done.column(c).to_pylist() for c in range(4, 11)], strict=True))
                found = [p for lo, hi in zip(starts[starts < stop], np.r_[starts[1:], len(key)], strict=False) for p in possible(int(key[lo, 0]), rows[lo:hi], least)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
            held = whole.slice(stop)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Every row of `docs` (doc_id, text) with its class: doc_id, class_id, n_links, and the text's key and its class's.

    Equal texts are one text. Each text has SKETCHES Order MinHash sketches over occurrence-labelled K-word k-mers. Texts
    with a common sketch are linked with one of them, by turns of the sketch the first, the last or one of two drawn by
    lot, so that a sketch with m texts gives m - 1 pairs and no group is gathered. Pairs are verified by banded alignment:
    `least` of the longer text's words must align. Texts that have two sketches in common but still lie in different
    components are then paired again, once for each of STEPS. What still lies in different components of one sketch is
    compared pair by pair, unless lengths or word pairs show that it can't be alike, so that no text hides a link of others. Classes are connected components; class_id is the least doc_id in the class, n_links the number of verified
    pairs of the text. class_doc and class_key_* name one row of the class to keep.

    Texts of 100 to 1,000 words that differ in words drawn by lot were found (tests/llm) in all cases where 0.9 of the
    words align, in 0.97 where 0.85 do, 0.91 where 0.83 do and 0.82 where 0.81 do. Texts without any run of K common words are never compared, be they alike
    otherwise (every fifth word changed leaves 0.8): K words in a row is what near means here.
    Null text counts as empty; all texts without words that are equal are one class, others their own. Repeated rows and
    repeated doc_ids are ordinary rows. Null doc_id: class_id is null only if all in the class are. Empty input: empty
    result. Further columns are ignored.
    """
    base = cut_lineage(sketched(docs))
    distinct = base.groupBy(*KEY).agg(F.min("doc_id").alias("first_doc"), F.first("sketches").alias("sketches"))
    distinct = cut_lineage(distinct.withColumn("tid", F.monotonically_increasing_id()))
    entries = distinct.select("tid", F.posexplode("sketches").alias("turn", "sketch"))
    drawn = entries.withColumn("draw", F.xxhash64("tid"))
    hubs = drawn.groupBy("sketch").agg(
        F.min("tid").alias("low"), F.max("tid").alias("high"), F.min_by("tid", "draw").alias("one"), F.max_by("tid", "draw").alias("other")
    ).where("low <> high")
    hub = F.element_at(F.array("low", "high", "one", "other"), F.col("turn") % 4 + 1)
    met = cut_lineage(entries.join(hubs, "sketch").select("tid", hub.alias("hub")).distinct())
    tried = cut_lineage(met.where("tid <> hub").select(F.least("tid", "hub").alias("a"), F.greatest("tid", "hub").alias("b")).distinct())
    needed = met.select("tid").distinct().join(distinct.drop("sketches"), "tid")
    keyed = docs.select("doc_id", "text", *text_key("text"))
    same = (keyed["doc_id"].eqNullSafe(needed["first_doc"])) & (keyed["key_hash"] == needed["key_hash"]) & (keyed["key_crc"] == needed["key_crc"]) & (keyed["key_bytes"] == needed["key_bytes"])
    texts = cut_lineage(keyed.join(needed, same).select("tid", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["tid"]))
    links = cut_lineage(verified(tried, texts, least))
    labels = components(links)
    sharing = distinct.select("tid", "sketches").join(texts.select("tid"), "tid", "left_semi")
    for step in (*STEPS, None):
        found = _untried(sharing, labels, texts, least) if step is None else _apart(sharing, labels, step)
        pairs = cut_lineage(found.join(tried, ["a", "b"], "left_anti"))
        more = cut_lineage(verified(pairs, texts, least))
        if more.limit(1).count() == 0:
            continue
        tried, links = tried.union(pairs), links.union(more)
        known = labels.select("v", "label")
        ends = more.join(known.toDF("a", "x"), "a", "left").join(known.toDF("b", "y"), "b", "left")
        merged = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
        fresh = merged.join(known, "v", "left_anti")  # texts that had no link so far
        labels = cut_lineage(_after(labels, merged).unionByName(fresh))
    degrees = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("n_links"))
    classed = cut_lineage(distinct.drop("sketches").join(labels.withColumnRenamed("v", "tid"), "tid", "left").join(degrees, "tid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    head = F.struct(F.col("first_doc").isNull().alias("none"), F.col("first_doc").alias("class_doc"), *[F.col(k).alias(f"class_{k}") for k in KEY])
    members = classed.where("label is not null").withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(SALTS)).cast("int"))
    heads = members.groupBy("label").agg(F.min(head).alias("head")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = [*KEY, "n_links", "head.class_doc", *[f"head.class_{k}" for k in KEY]]
    final = members.join(heads, ["label", "salt"]).select(*told).unionByName(classed.where("label is null").withColumn("head", head).select(*told))
    return base.select("doc_id", *KEY).join(final, KEY).select("doc_id", F.col("class_doc").alias("class_id"), "n_links", *KEY, "class_doc", *[f"class_{k}" for k in KEY])


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class of near duplicates, all columns as they were."""
    docs, restored = shielded(docs, "doc_id", "text")
    classes = near_duplicates(docs, least)
    heads = classes.select("class_doc", *[F.col(f"class_{k}") for k in KEY]).distinct()
    keyed = docs.withColumns(dict(zip([f"_{k}" for k in KEY], text_key("text"), strict=True)))
    same = keyed["doc_id"].eqNullSafe(heads["class_doc"])
    for k in KEY:
        same = same & (keyed[f"_{k}"] == heads[f"class_{k}"])
    kept = keyed.join(heads, same, "left_semi").dropDuplicates(["doc_id", *[f"_{k}" for k in KEY]])
    return restored(kept)
