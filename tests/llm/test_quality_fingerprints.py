"""The n-gram model against a plain one, and digests against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import CLASHING, rows_of

from tessera.llm import fingerprints, quality


def plain_model(texts: list[str]):
    """Interpolated modified Kneser-Ney of code points with dictionaries."""
    top = quality.ORDER
    counts = [Counter() for _ in range(top)]
    for t in texts:
        line = [None] * (top - 1) + list(t)
        for k in range(top - 1, len(line)):
            counts[-1][tuple(line[k - top + 1 : k + 1])] += 1
    for k in range(top - 2, -1, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    totals, weights, cut = [], [], []
    for table in counts:
        n = [max(1, sum(c == k for c in table.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
        total, mass = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3) - 1]
        totals.append(total)
        weights.append(mass)
        cut.append(d)

    def p(g: tuple) -> float:
        below = p(g[1:]) if len(g) > 1 else 1 / (len(counts[0]) + 1)
        k, ctx = len(g) - 1, g[:-1]
        if not totals[k].get(ctx):
            return below
        c = counts[k].get(g, 0)
        own = (c - cut[k][min(c, 3) - 1]) / totals[k][ctx] if c else 0.0
        return own + weights[k][ctx] / totals[k][ctx] * below

    return p


TRUSTED = ["the quick brown fox jumps over the lazy dog. " * 3, "a quiet evening, and the river runs slow under the bridge.", "Numbers 12 and 34 stand here; they're few."]


def test_model_against_plain_kneser_ney(spark, make, monkeypatch):
    trusted = [*TRUSTED, "Привет, мир. Добрый день, мир.", "天地玄黃，宇宙洪荒。天地日月。", "\U0001f600 and \U0001f600 or \x00 or none"]
    p = plain_model(trusted)
    asked = [*trusted, "the river runs слово wholly unknown 荒天地 words", "", None, "x", "tête-à-tête " * 40, "дней мирных"]
    rows = make(list(enumerate(asked)))
    model = quality.fit(make(list(enumerate(trusted))).select("text"))
    for r in model.table.collect():
        assert len(r.ctx) < quality.ORDER and sum(r.ps) < 1 + 1e-9 and len(set(r.nexts)) == len(r.nexts)

    def scores():
        return {r.doc_id: r for r in quality.log_perplexity(rows.select("doc_id", "text"), model).collect()}

    got = scores()
    for k, t in enumerate(asked):
        line = [None] * (quality.ORDER - 1) + list(t or "")
        want = -sum(math.log(p(tuple(line[i : i + quality.ORDER]))) for i in range(len(t or "")))
        assert got[k]._n == len(t or "") and got[k]._nll == pytest.approx(want, rel=1e-5, abs=1e-9)
    monkeypatch.setattr(quality, "PIECE", 37)
    monkeypatch.setattr(quality, "CHUNK", 150)
    pieces = scores()
    assert all(pieces[k]._nll == pytest.approx(got[k]._nll, rel=1e-9) and pieces[k]._again == got[k]._again for k in got)


def test_probabilities_sum_to_one(make):
    model = quality.fit(make(list(enumerate(TRUSTED))).select("text"))
    rows = {r.ctx: r for r in model.table.collect()}
    symbols = rows[""].nexts
    full = {"": dict.fromkeys([*symbols, "?"], 0.0)}
    for s in full[""]:
        full[""][s] = dict(zip(rows[""].nexts, rows[""].ps)).get(s, rows[""].weight * model.unknown)
    assert sum(full[""].values()) == pytest.approx(1)
    for ctx in sorted(rows, key=len)[1:200]:
        own = dict(zip(rows[ctx].nexts, rows[ctx].ps))
        full[ctx] = {s: own.get(s, rows[ctx].weight * full[ctx[1:]][s]) for s in full[""]}
        assert sum(full[ctx].values()) == pytest.approx(1)


def test_repeats_against_plain_python(monkeypatch):
    rnd = random.Random(9)
    texts = [None, "", "short", "x" * 40, "да " * 30, *["".join(rnd.choice("ab") for _ in range(rnd.randrange(900))) for _ in range(40)]]
    want = []
    for t in texts:
        seen, again = set(), 0
        for k in range(len(t or "") - quality.WINDOW + 1):
            w = t[k : k + quality.WINDOW]
            again += w in seen
            seen.add(w)
        want.append(again)
    assert quality.repeats(texts).tolist() == want and quality.repeats([]).tolist() == []


def test_clean_stays_and_junk_goes(spark, make):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice(["ba", "ne", "li", "to", "ra", "su"]) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)).capitalize() + "."
    rows = [(k, prose(rnd.randrange(5, 200)), "en") for k in range(400)] + [(1000 + k, "".join(chr(rnd.randrange(33, 126)) for _ in range(400)), "en") for k in range(40)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 200)] + [(k, 0, 0) for k in range(1000, 1010)] + [(3, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(make(rows), labels).collect()}
    assert sum(got[k].accepted for k in range(400)) >= 396 and not any(got[k].accepted for k in range(1000, 1040))
    scored = [got[k].perplexity for k in (0, 1)]
    again = {r.doc_id: r.perplexity for r in quality.quality(make(rows[::-1]), labels).collect()}
    assert scored == pytest.approx([again[0], again[1]], rel=1e-9)


def test_known_words_repeated_or_shuffled_go(spark, make):
    rnd = random.Random(16)
    letters = "αβγδεζηθικλμνξοπρστυφχψω"
    rows = []
    for lang, sounds in (("en", ["ba", "ne", "li", "to", "ra", "su"]), ("el", ["αν", "το", "κα", "ρι", "με", "σο"])):
        words = sorted({"".join(rnd.choice(sounds) for _ in range(rnd.randrange(2, 5))) for _ in range(300)})
        after = {w: rnd.sample([x for x in words if x != w], 6) for w in words}
        for k in range(400):
            text = [rnd.choice(words)]
            while len(text) < 80:
                text.append(rnd.choice(after[text[-1]]))
            if k >= 350:
                text = [rnd.choice(words)] * 80 if k % 2 else ["".join(rnd.choice(letters) for _ in w) for w in text]
            rows.append(((0 if lang == "en" else 1000) + k, " ".join(text), lang))
    labels = spark.createDataFrame([(b + k, 1) for b in (0, 1000) for k in range(200)], "doc_id long, quality int")
    docs = make(rows)
    got = {r.doc_id: r.accepted for r in quality.quality(docs, labels).collect()}
    assert sum(got[b + k] for b in (0, 1000) for k in range(200, 350)) >= 297
    assert not any(got[b + k] for b in (0, 1000) for k in range(350, 400))
    assert sorted(r.doc_id for r in quality.accepted(docs, labels).collect()) == sorted(k for k in got if got[k])
    copies = {r.doc_id: r.perplexity for r in quality.quality(make([*rows, (9999, *rows[250][1:])]), labels).collect()}
    assert copies[9999] == copies[250]


def test_quality_bears_odd_rows(spark, odd, clash):
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(odd, labels)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert all(r.perplexity is None and not r.accepted for r in rows if r.n_units == 0)
    wide = clash(odd)
    kept = quality.accepted(wide, labels)
    assert kept.columns == wide.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.accepted)
    assert all(r[c] == f"extra {c}" for r in kept.collect() for c in CLASHING)
    assert quality.quality(odd.limit(0), labels).count() == 0
    assert all(r.accepted for r in quality.quality(odd, labels.limit(0)).collect())


def test_fingerprints_against_plain_python(make, odd, clash):
    rnd = random.Random(7)
    rows = [(k * 3, " ".join(f"term{rnd.randrange(400)}" for _ in range(rnd.choice([3, 40, 900])))) for k in range(80)] + [(500, None), (501, ""), (502, "café \U0001f600 " * 60), (503, "z" * 9000)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(make(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        one, two, three = (fingerprints.prepared([0], [x])[0].chain for x in (t, e, n))
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.written(one), fingerprints.written(two))
        assert r.near_edited == pytest.approx(fingerprints.likeness(one, two)) and r.near_next == pytest.approx(fingerprints.likeness(one, three))
        assert 0 <= r.near_edited <= 1
    plain = fingerprints.fingerprints(odd)
    assert plain.count() == odd.count()
    assert rows_of(fingerprints.fingerprints(clash(odd))) == rows_of(plain)
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0


def test_entropy_ranks_against_plain_counts():
    rnd = random.Random(1)
    data = np.array([rnd.choice([65, 66, 67, 200]) if rnd.random() < 0.5 else rnd.randrange(256) for _ in range(700)], np.uint8)
    got = fingerprints.ranks(data, np.array([700]))
    for k in range(0, 700 - fingerprints.WINDOW):
        counts = Counter(data[k : k + fingerprints.WINDOW].tolist())
        entropy = -sum(c / fingerprints.WINDOW * math.log2(c / fingerprints.WINDOW) for c in counts.values())
        step = entropy * fingerprints.STEPS / 6
        want = max(0, 999 - abs(round(step) - fingerprints.MODE))
        assert abs(int(got[k]) - want) <= 1


def test_a_text_has_its_ranks_in_any_company():
    rnd = random.Random(41)
    texts = [np.array([rnd.choice([65, 66, 67, 68, 69]) if rnd.random() < 0.6 else rnd.randrange(256) for _ in range(rnd.randrange(64, 400))], np.uint8) for _ in range(200)]
    line, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    got = np.split(fingerprints.ranks(line, sizes), np.cumsum(sizes)[:-1])
    for t, r in zip(texts, got, strict=True):
        assert (fingerprints.ranks(t, np.array([len(t)])) == r).all()


def test_likeness_follows_common_text(make):
    rnd = random.Random(12)
    words = [f"word{rnd.randrange(5000)}" for _ in range(2000)]
    chain = lambda ws: fingerprints.prepared([0], [" ".join(ws)])[0].chain
    whole = chain(words)
    near = [fingerprints.likeness(whole, chain(words[: len(words) - n] + [f"other{rnd.randrange(5000)}" for _ in range(n)])) for n in (0, 200, 1000, 2000)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[-1] < 0.1 and near[1] > 0.6
