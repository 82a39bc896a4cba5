"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_lineage, shielded

#: What parts words: ASCII other than letters and digits, and the blocks of Latin, general and CJK punctuation.
GAPS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")
K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach to be retrieved.
THRESHOLD = 0.6
#: Share of the trigrams of the question, and of the answer, that a retrieved passage must hold.
OVERLAP = 0.5
#: Items in one index; a larger benchmark is searched in several passes over blocks of so many.
ITEMS = 50_000
#: Blocks that the first bound of a passage tells apart.
COARSE = 32


def terms(text: str | None) -> list[bytes]:
    """Words in lower case, without punctuation, as UTF-8."""
    lowered = (text or "").lower()
    return (lowered if lowered.isascii() else MARKS.sub(" ", lowered)).encode().translate(GAPS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's last sentence is its answer; where one of the two is but a few words, the last third of all words is."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if terms(p)]
    if len(parts) > 1 and len(terms(parts[-1])) >= 3 and sum(len(terms(p)) for p in parts[:-1]) >= 5:
        return [w for p in parts[:-1] for w in terms(p)], terms(parts[-1])
    words = terms(text)
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


def trigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct trigrams; of fewer words, one gram."""
    return grams(words, min(3, len(words)))


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Distinct n-grams."""
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def share(part: set[tuple[bytes, ...]], passage: list[bytes], held: dict[int, set]) -> float:
    """How much of the grams of a question or answer stands in a passage, whose grams by length are kept in `held`."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    if n not in held:
        held[n] = grams(passage, n)
    return len(part & held[n]) / len(part)


@dataclass
class Whole:
    """What BM25 and the passages take from all items: their number, words, longest, and the items of each term asked for."""

    items: int
    words: int
    longest: int
    df: dict[bytes, int]


class Index:
    """Postings of the items' terms with BM25 impacts as a share of the item's own score, in blocks with their maxima."""

    def __init__(self, items: list[tuple[int, str]], block: int = 16, whole: Whole | None = None) -> None:
        self.items = [(i, t) for i, t in items if terms(t)]
        bags = [Counter(terms(t)) for _, t in self.items]
        lengths = [sum(b.values()) for b in bags]
        if whole is None:
            whole = Whole(len(bags), sum(lengths), max(lengths, default=0), Counter(t for b in bags for t in b))
        count, self.longest, df = whole.items, whole.longest, whole.df
        mean = whole.words / max(1, count)
        idf = {t: math.log(1 + (count - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.ids = {t: k for k, t in enumerate(sorted(df))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for d, (bag, n) in enumerate(zip(bags, lengths, strict=True)):
            scores = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for t, f in bag.items()}
            own = sum(scores.values())
            for t, s in scores.items():
                self.postings[self.ids[t]].append((d, s / own))
        self.blocks = [[(p[min(k + block, len(p)) - 1][0], max(s for _, s in p[k : k + block])) for k in range(0, len(p), block)] for p in self.postings]
        self.block = block
        self.span = max(1, math.ceil(len(self.items) / COARSE))
        self.coarse = np.zeros((len(self.ids), COARSE), np.float32)
        for t, p in enumerate(self.postings):
            for d, s in p:
                self.coarse[t, d // self.span] = max(self.coarse[t, d // self.span], np.nextafter(np.float32(s), np.float32(2)))
        self.tops = self.coarse.tolist()
        self.first: list[dict[int, int]] = [{} for _ in self.ids]
        for t, p in enumerate(self.postings):
            for k, (d, _) in enumerate(p):
                self.first[t].setdefault(d // self.span, k)
        self.answers = [tuple(map(trigrams, question_and_answer(t))) for _, t in self.items]

    def above(self, query: list[int], least: float, coarse: int) -> list[tuple[int, float]]:
        """All items of a coarse block whose impacts over the distinct terms of `query` sum to `least` or more.

        Block-max WAND: the pivot is the first item that the terms' maxima in the coarse block allow; if the maxima of
        the small blocks around it don't, all move behind the nearest end of a small block.
        """
        end, found, cursors = (coarse + 1) * self.span, [], []
        for t in query:
            at = self.first[t].get(coarse)
            if at is not None:
                cursors.append([self.postings[t][at][0], t, at])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                bound += self.tops[c[1]][coarse]
                if bound >= least:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            allowed, edge = 0.0, end
            for c in cursors[: pivot + 1]:
                blocks, k = self.blocks[c[1]], c[2] // self.block
                k = bisect_left(blocks, (item,), k)
                if k < len(blocks):
                    allowed += blocks[k][1]
                    edge = min(edge, blocks[k][0] + 1)
            if allowed < least:
                target = max(item + 1, min(edge, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
                cursors = self._advance(cursors, pivot + 1, target, end)
            elif cursors[0][0] == item:
                score = sum(self.postings[c[1]][c[2]][1] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                cursors = self._advance(cursors, pivot + 1, item + 1, end)
            else:
                cursors = self._advance(cursors, pivot + 1, item, end)
        return found

    def _advance(self, cursors: list, n: int, target: int, end: int) -> list:
        """The first n cursors moved to their first posting at or behind `target`; those that come to `end` go."""
        kept = []
        for c in cursors[:n]:
            p = self.postings[c[1]]
            k = bisect_left(p, (target,), c[2])
            if k < len(p) and p[k][0] < end:
                kept.append([p[k][0], c[1], k])
        return kept + cursors[n:]

    def search(self, texts: list[str | None], least: float, overlap: float) -> list[list[tuple]]:
        """For each text, (item, score, question overlap, answer overlap, first word of the passage), one for each item.

        A passage is twice as long as the longest item and the next begins half a passage later, so that each item's
        place lies whole in one. Both halves' distinct terms bound what a passage can score in each coarse block of
        items; what passes goes to `above`.
        """
        half = max(16, self.longest)
        found: list[list[tuple]] = [[] for _ in texts]
        lists = [terms(t) for t in texts]
        get = self.ids.get
        codes, owners = [], []
        base, starts = 0, []
        for words in lists:
            ids = np.array([get(w, -1) for w in words], np.int64)
            at = np.flatnonzero(ids >= 0)
            codes.append((base + at // half) * len(self.ids) + ids[at])
            starts.append(base)
            base += max(1, math.ceil(len(words) / half))
        if not self.ids or not base:
            return found
        held = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        if not len(held):
            return found
        block, term = held // len(self.ids), held % len(self.ids)
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sums = np.zeros((base + 1, COARSE), np.float32)
        sums[block[first]] = np.add.reduceat(self.coarse[term], first, axis=0)
        owner = np.repeat(np.arange(len(lists)), np.diff([*starts, base]))
        follows = np.r_[owner[1:] == owner[:-1], False]
        bound = sums[:-1] + np.where(follows[:, None], sums[1:], 0)
        bounds = np.searchsorted(block, np.arange(base + 2))
        for k in np.flatnonzero((bound >= least - 1e-4).any(1)):
            d, stop = owner[k], bounds[k + (2 if follows[k] else 1)]
            query = sorted(set(term[bounds[k] : stop].tolist()))
            at = int(k - starts[d]) * half
            passage, held_grams = lists[d][at : at + 2 * half], {}
            for c in np.flatnonzero(bound[k] >= least - 1e-4):
                for item, score in self.above(query, least, int(c)):
                    q, a = (share(part, passage, held_grams) for part in self.answers[item])
                    if q >= overlap and a >= overlap:
                        found[d].append((self.items[item][0], score, q, a, at))
        best: list[list[tuple]] = []
        for hits in found:
            one: dict[int, tuple] = {}
            for h in hits:
                if h[0] not in one or (h[2] + h[3], h[1]) > (one[h[0]][2] + one[h[0]][3], one[h[0]][1]):
                    one[h[0]] = h
            best.append(sorted(one.values(), key=lambda h: (h[0] is None, h[0] or 0)))
        return best


HITS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,word:long>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("word", pa.int64())]))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))


def _counted(items: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(term, n, words, longest), n items of each term, with null as the term for all items; and (block, term) that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for block, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = terms(text)
                if found:
                    rows += [(block, None, 1, len(found), len(found)), *((block, t, 1, 0, 0) for t in set(found))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "term", "n", "words", "longest"])

    each = items.select(_block(blocks).alias("block"), "text").mapInArrow(run, "block long, term binary, n long, words long, longest long")
    counted = cut_lineage(each.groupBy("block", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")))
    return counted, counted.where("term is not null").select("block", "term")


def _merged(before: list[dict], more: list[dict]) -> list[dict]:
    """Hits of several blocks, the best passage for each item."""
    if not before:
        return more
    best = {h["item_id"]: h for h in before}
    for h in more:
        old = best.get(h["item_id"])
        rank = lambda x: (x["question_overlap"] + x["answer_overlap"], x["score"])
        if old is None or rank(h) > rank(old):
            best[h["item_id"]] = h
    return sorted(best.values(), key=lambda h: (h["item_id"] is None, h["item_id"] or 0))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, into: str = "hits") -> DataFrame:
    """All columns of `docs` with a further one, `into`: the items of `items` (item_id, text) that the text holds.

    Every passage of every text queries the index. Items that reach `threshold` of their own BM25 score are verified:
    the passage must hold `overlap` of the trigrams of the item's question and of its answer. The best passage for each
    item is told. The index is broadcast; it holds ITEMS items at most, and a larger benchmark is searched block by
    block, each a pass over `docs` without any shuffle. Frequencies and lengths are those of all items, so blocks change no
    hit.

    Null and empty texts hold nothing; items without words aren't searched. Repeated items and documents are each
    answered. A column of `docs` with the name `into` is replaced. Empty inputs: no hits.
    """
    context = docs.sparkSession.sparkContext
    rest = docs.drop(into)
    names, kinds = rest.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    listed = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    blocks = max(1, math.ceil(listed.count() / ITEMS))
    if blocks > 1:
        counted, used = _counted(listed, blocks)
        total = counted.where("term is null").agg(F.sum("n"), F.sum("words"), F.max("longest")).first()
        df = counted.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
        used = cut_lineage(used.join(df, "term"))
    out = rest.withColumn(into, F.array().cast(HITS))
    for k in range(blocks):
        mine = listed if blocks == 1 else listed.where(_block(blocks) == k)
        whole = None if blocks == 1 else Whole(total[0] or 0, total[1] or 0, total[2] or 0, {bytes(r.term): r.n for r in used.where(F.col("block") == k).collect()})
        rows = sorted(((r.item_id, r.text) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # ITEMS or so at most
        index = context.broadcast((rows, whole))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = Index(index.value[0], whole=index.value[1])
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = own.search(part.column(names.index("text")).to_pylist(), threshold, overlap)
                    before = part.column(len(names)).to_pylist()
                    hits = [_merged(b, [{"item_id": i, "score": s, "question_overlap": q, "answer_overlap": a, "word": w} for i, s, q, a, w in f]) for b, f in zip(before, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hits, _HITS)], [*names, into])

        out = out.mapInArrow(run, f"{kinds}, `{into}` {HITS}")
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of `docs` that hold none of `items`, all columns as they were."""
    docs, restored = shielded(docs, "text")
    return restored(leaks(docs, items, threshold, overlap).where("size(hits) = 0"))
