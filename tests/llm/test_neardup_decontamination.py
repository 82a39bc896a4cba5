"""Near duplicates and leaks against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from conftest import CLASHING, rows_of

from tessera.llm import decontamination, neardup


def prose(rnd: random.Random, n: int, of: int = 3000) -> list[str]:
    return [f"w{rnd.randrange(of)}" for _ in range(n)]


def edited(rnd: random.Random, words: list[str], share: float) -> list[str]:
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10_000)}"
    return out


def planted() -> list[tuple[int, str]]:
    rnd = random.Random(5)
    texts = []
    for _ in range(60):
        base = prose(rnd, rnd.choice([12, 60, 200, 600]))
        texts += [base, edited(rnd, base, 0.02), edited(rnd, base, 0.05), list(base), edited(rnd, base, 0.6)]
    hub = prose(rnd, 100)
    texts += [edited(rnd, hub, 0.03) for _ in range(150)]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_alignment_against_the_full_table():
    rnd = random.Random(2)
    for _ in range(150):
        a = prose(rnd, rnd.randrange(0, 40), 30)
        b = edited(rnd, a, rnd.choice([0, 0.1, 0.3])) if rnd.random() < 0.7 else prose(rnd, rnd.randrange(0, 40), 30)
        if rnd.random() < 0.4 and b:
            del b[rnd.randrange(len(b))]
        want = lcs(a, b) / max(len(a), len(b)) if a or b else 1.0
        assert neardup.similarity(a, b) == (want if want >= 0.8 - 1e-9 else 0.0)


def test_possible_loses_no_alike_pair():
    rnd = random.Random(11)
    known = neardup._Hashes()
    base = prose(rnd, 120)
    texts = [edited(rnd, base, s) for s in (0.0, 0.04, 0.08, 0.12, 0.16, 0.2, 0.3, 0.5)] + [base[:96], base[:95], base * 2, base[:1], ["x"], prose(rnd, 118)]
    rows = [[k, k, len(t), True, 0, np.array([known[w] for w in t], np.uint64).astype(np.uint16).tobytes(), [7, 9]] for k, t in enumerate(texts)]
    alike = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if lcs(texts[a], texts[b]) >= 0.8 * max(len(texts[a]), len(texts[b])) - 1e-9}
    found = list(neardup.possible(7, rows, 0.8))
    assert len(found) == len(set(found)) and {(int(a), int(b)) for a, b in found} == alike and alike
    assert not list(neardup.possible(9, rows, 0.8))  # the lesser sketch of both tries them
    parts = [[*r[:4], r[0] % 2, *r[5:]] for r in rows]
    assert {(int(a), int(b)) for a, b in neardup.possible(7, parts, 0.8)} == {(a, b) for a, b in alike if a % 2 != b % 2}


def test_classes_against_all_pairs(make):
    rows = planted()
    got = {r.doc_id: r for r in neardup.near_duplicates(make(rows)).collect()}
    assert len(got) == len(rows)
    words = [t.split() for _, t in rows]
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    parent = list(range(len(rows)))

    def top(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            shared = len(grams[i] & grams[j])
            if shared >= 0.5 * max(len(grams[i]), len(grams[j])) and neardup.similarity(words[i], words[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    assert [got[k].class_id for k in range(len(rows))] == [top(k) for k in range(len(rows))]


def test_a_shared_passage_hides_no_near_copies(make):
    rnd = random.Random(31)
    passage, rows = prose(rnd, 50), []
    for k in range(400):
        own = [f"t{k}x{i}" for i in range(60)]
        rows.append((2 * k, " ".join(passage + own)))
        if k % 10 == 0:  # no five words of its own part are left together
            rows.append((2 * k + 1, " ".join(passage + [w if i % 5 else f"n{k}x{i}" for i, w in enumerate(own)])))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(rows)).collect()}
    texts, hashes = dict(rows), neardup._Hashes()
    sketches = lambda k: set(neardup.order_minhash(neardup.labelled_kmers(np.array([hashes[w] for w in texts[k].split()], np.uint64))))
    planted = [k for k in texts if k % 2 and sketches(k) & sketches(k - 1)]
    assert len(planted) > 25 and [got[k] for k in planted] == [k - 1 for k in planted]
    assert all(got[k] == k for k in texts if k % 2 == 0)


def test_a_text_is_dealt_once_for_a_sketch(spark, monkeypatch):
    """Texts with a passage in common: a row for each text and sketch, where it was a row for each of two bands of lengths."""
    rnd = random.Random(11)
    passage = prose(rnd, 60)
    rows = [passage + prose(rnd, rnd.randrange(5, 90)) for _ in range(80)]
    rows += [edited(rnd, rows[k], 0.05) for k in range(0, 80, 4)]
    hashed = [np.array([neardup.xxhash.xxh64_intdigest(w) for w in r], np.uint64) for r in rows]
    keys = [neardup.order_minhash(neardup.labelled_kmers(h)).tolist() for h in hashed]
    sharing = spark.createDataFrame([(k, key) for k, key in enumerate(keys)], "tid long, sketches array<long>")
    texts = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "tid long, text string")
    labels = spark.createDataFrame([], "v long, label long")
    plain, dealt = type(texts).mapInArrow, []
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, *a, **k: ("held" in self.columns and dealt.append(self.count())) or plain(self, *a, **k))
    met = Counter(s for key in keys for s in set(key))
    alike = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if set(keys[a]) & set(keys[b]) and neardup.similarity(rows[a], rows[b])}
    found = {(r.a, r.b) for r in neardup._untried(sharing, labels, texts, 0.8).collect()}
    assert dealt == [sum(n for n in met.values() if n > 1)] and alike <= found
    monkeypatch.setattr(neardup, "WHOLE", 3)
    monkeypatch.setattr(neardup, "BLOCK", 10)
    assert {(r.a, r.b) for r in neardup._untried(sharing, labels, texts, 0.8).collect()} == found


def test_recall_of_aligned_pairs(make):
    """All pairs of which 0.8 or more of the words align are the truth, without any condition on k-mers."""
    rnd, pairs = random.Random(77), []
    for n in (100, 300, 1000):
        for share in (0.05, 0.1, 0.15, 0.17, 0.19):
            for _ in range(30):
                base = prose(rnd, n, 50_000)
                other = list(base)
                for i in rnd.sample(range(n), int(n * share)):
                    other[i] = f"e{rnd.randrange(1_000_000)}"
                pairs.append((n, share, base, other))
    rows = [(2 * k + j, " ".join(t)) for k, p in enumerate(pairs) for j, t in enumerate(p[2:])]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(rows)).collect()}
    caught, every = Counter(), Counter()
    for k, (_, share, a, b) in enumerate(pairs):
        if neardup.similarity(a, b):
            every[share] += 1
            caught[share] += got[2 * k] == got[2 * k + 1]
    recall = {s: caught[s] / every[s] for s in every}
    print("recall by share of changed words:", recall)
    assert sum(every.values()) > 400 and sum(caught.values()) >= 0.9 * sum(every.values())
    assert recall[0.05] == 1 and recall[0.1] >= 0.98 and recall[0.19] >= 0.8
    assert all(got[2 * k] in (2 * k, 2 * k + 1) and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(len(pairs)))


def test_keep_first_keeps_one_of_each_class(make, clash):
    rows = planted()
    docs = clash(make(rows))
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == sorted(set(classes.values()))
    assert all(r[c] == f"extra {c}" for r in got for c in CLASHING)


def test_neardup_bears_odd_rows(odd, clash, make):
    got = neardup.near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[5] == by[6] == {5} and by[1] == by[2] == {1} and by[3] == {3}
    assert neardup.near_duplicates(odd.limit(0)).count() == 0
    assert neardup.keep_first(odd.limit(0)).count() == 0
    texts = [r.text for r in neardup.keep_first(odd).collect()]
    assert texts.count("one two three four five six seven") == 1
    assert neardup.keep_first(make([(None, "a b c d e f"), (None, "a b c d e f")])).count() == 1


def items_and_docs() -> tuple[list[tuple], list[tuple]]:
    rnd = random.Random(8)
    items = [(k, f"What is {' '.join(prose(rnd, 14))}? The answer is {' '.join(prose(rnd, 6))}.") for k in range(60)]
    docs = []
    for k in range(300):
        words = prose(rnd, rnd.choice([5, 80, 700]))
        if k % 3 == 0:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = items[rnd.randrange(60)][1].split()
        elif k % 3 == 1:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = items[rnd.randrange(60)][1].split()[:7]
        docs.append((k, " ".join(words)))
    return items, docs


def brute(items: list[tuple], text: str, threshold: float, overlap: float) -> set[int]:
    """All passages scored against all items, without any index."""
    index = decontamination.Index(items)
    impact = defaultdict(dict)
    for t, k in index.ids.items():
        for d, s in index.postings[k]:
            impact[d][t] = s
    words, half, hits = decontamination.terms(text), max(16, index.longest), set()
    for at in range(0, max(1, len(words)), half):
        passage = words[at : at + 2 * half]
        held = set(passage)
        share = lambda part: sum(any(passage[k : k + len(g)] == list(g) for k in range(len(passage))) for g in part) / max(1, len(part))
        for d in range(len(index.items)):
            if sum(s for t, s in impact[d].items() if t in held) >= threshold:
                q, a = index.answers[d]
                if (not q or share(q) >= overlap) and share(a) >= overlap:
                    hits.add(index.items[d][0])
    return hits


def test_leaks_against_brute_force(spark, make):
    items, docs = items_and_docs()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {h.item_id for h in r.hits} for r in decontamination.leaks(make(docs), table).collect()}
    want = {k: brute(items, t, decontamination.THRESHOLD, decontamination.OVERLAP) for k, t in docs}
    assert got == want
    assert all(got[k] for k, _ in docs if k % 3 == 0) and not any(got[k] for k, _ in docs if k % 3)


def test_leaks_in_blocks_are_the_same(spark, make, monkeypatch):
    items, docs = items_and_docs()
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: {h.item_id for h in r.hits} for r in decontamination.leaks(make(docs), table, 0.8).collect()}
    monkeypatch.setattr(decontamination, "ITEMS", 25)
    parts = {r.doc_id: {h.item_id for h in r.hits} for r in decontamination.leaks(make(docs), table, 0.8).collect()}
    found = sum(bool(v) for v in parts.values())
    assert found == sum(bool(v) for v in whole.values()) == 100


def test_blocks_change_no_hit(spark, make, monkeypatch):
    items, docs = items_and_docs()
    items += [(100 + k, f"Which {items[k][1].split()[3]} is {' '.join(prose(random.Random(k), 4 + k, 40))}? It is {items[k][1].split()[-1]}") for k in range(40)]
    docs += [(1000 + k, " ".join(t.split()[k % 3 : -1 - k % 4])) for k, (_, t) in enumerate(items)]
    table = spark.createDataFrame(items, "item_id long, text string")
    hits = lambda: {r.doc_id: r.hits for r in decontamination.leaks(make(docs), table).collect()}
    whole = hits()
    monkeypatch.setattr(decontamination, "ITEMS", 9)
    assert hits() == whole and sum(map(bool, whole.values())) > 120


def test_leaks_bear_odd_rows(spark, odd, clash):
    table = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (None, "null source")], "item_id long, text string")
    wide = clash(odd)
    out = decontamination.leaks(wide, table)
    assert sorted(out.columns) == sorted(wide.columns) and out.count() == odd.count()
    assert {r.doc_id for r in out.where("size(hits) > 0").collect()} == {5, 6, 8}
    assert decontamination.leaks(odd, table.limit(0)).where("size(hits) > 0").count() == 0
    assert rows_of(decontamination.leaks(odd.limit(0), table)) == []
