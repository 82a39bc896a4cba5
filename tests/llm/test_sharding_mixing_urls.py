"""Sharding, mixing and URL rules against their laws and brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import CLASHING, rows_of

from tessera.llm import mixing, queries, sharding, urls


def test_shards_are_even_gapless_and_keep_copies_together(spark, make):
    rows = [(k, f"text {k % 700} " * (1 + k % 37)) for k in range(3000)] + [(5000 + k, "a copy that many hold") for k in range(300)]
    got = sharding.shard_by_bytes(make(rows), 24).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(sizes.values()) / 24
    assert set(sizes) == set(range(24)) and max(abs(s - mean) for s in sizes.values()) < 0.02 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = dict(rows)
    homes = defaultdict(set)
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes"
        homes[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())


def line_of(docs, shards: int, cells: int) -> dict:
    """Shards computed from all rows at once."""
    from pyspark.sql import functions as F

    named = docs.select(F.monotonically_increasing_id().alias("r"), F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    groups = defaultdict(list)
    for x in sorted(named, key=lambda x: x.r):
        groups[x.t].append(x)
    size = lambda t: len(t.encode()) + 8
    many = {t: len(g) * size(t) for t, g in groups.items()}
    target = max(1, sum(many.values())) / shards
    line = sorted(groups, key=lambda t: (many[t] <= target, groups[t][0].h % cells, groups[t][0].h, zlib.crc32(t.encode()), size(t)))
    lows, at = {}, 0
    for t in line:
        lows[t], at = at, at + many[t]
    middles = {t: lows[t] + many[t] / 2 for t in line}
    for t in line:
        low, n = lows[t], many[t]
        cut = -(-low // target) * target
        if n <= target and low < cut < low + n:
            for u in line:
                if low + n <= lows[u] + many[u] / 2 < low + n + cut - low:
                    middles[u] = lows[u] + many[u] / 2 - n
            middles[t] = low + n / 2 + cut - low
    shard = lambda x: min(int(x // target), shards - 1)
    return {x.r: shard(middles[t] if many[t] <= target else lows[t] + (k + 0.5) * size(t)) for t in line for k, x in enumerate(groups[t])}


@pytest.mark.parametrize("table", ["small", "copies", "sf0.01"])
def test_places_are_those_of_one_line(spark, make, table):
    rnd = random.Random(23)
    if table.startswith("sf"):
        docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    elif table == "small":
        docs = make([(k, "x" * rnd.randrange(50)) for k in range(30)])
    else:  # a third of all rows are one text, far more than a shard holds
        docs = make([(k, "one text that very many hold" if k % 3 == 0 else f"text {k % 600} " * (1 + k % 17)) for k in range(3000)] + [(None, "one text that very many hold")] * 50)
    docs = docs.select("doc_id", "text").repartition(7, "doc_id")
    docs = sharding.cut_lineage(docs)
    got = {r._row: (r.shard, r.slot) for r in sharding.placed(docs, 24).collect()}
    assert {k: s for k, (s, _) in got.items()} == line_of(docs, 24, sharding.CELLS)
    slots = defaultdict(list)
    for shard, slot in got.values():
        slots[shard].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    whole = sharding.sharded(docs, 24)
    assert Counter(whole.select("shard", "slot").collect()) == Counter(got.values()) and whole.columns == ["doc_id", "text", "shard", "slot"]
    assert Counter(whole.select("doc_id", "text").collect()) == Counter(docs.collect())
    if table == "copies":
        sizes = Counter()
        for r in sharding.shard_by_bytes(docs, 24).collect():
            sizes[r.shard] += r["size"]
        mean = sum(sizes.values()) / 24
        assert max(abs(s - mean) for s in sizes.values()) < 0.04 * mean


def test_shards_bear_odd_rows(spark, odd, clash):
    plain = sharding.shard_by_bytes(odd, 24)
    got = plain.collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < 24 and sorted(v) == list(range(len(v))) for s, v in slots.items())
    assert {r["size"] for r in got if r.doc_id in (1, 2)} == {8}
    assert rows_of(sharding.shard_by_bytes(clash(odd), 24).drop("slot")) == rows_of(plain.drop("slot"))
    assert sharding.shard_by_bytes(odd.limit(0), 24).count() == 0


def water(sizes: dict, weights: list[int], epochs: float) -> dict:
    """Clamping round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > epochs * sizes[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_meets_targets(make):
    rows = [(k, "w " * (1 + k % 50), "en", f"s{min(k % 40, 6)}") for k in range(6000)] + [(9000 + k, "w " * 40, "en", None) for k in range(60)] + [(9500, "w " * 9000, "en", "s1")]
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.taken == r.times * r["size"]
    want = water(dict(sizes), [1, 2, 3], 3.0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(60, 0.005 * want[s]), s
    assert rows_of(mixing.mix(make(rows))) == rows_of(mixing.mix(make(rows[::-1])))


def test_mix_counts_words_like_the_pattern(odd, clash):
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    text = [(r.doc_id, len(pattern.findall(r.text or ""))) for r in odd.collect()]
    got = mixing.mix(odd)
    assert Counter((r.doc_id, r["size"]) for r in got.collect()) == Counter(text)
    assert rows_of(mixing.mix(clash(odd))) == rows_of(got)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixed_repeats_whole_rows(odd, clash):
    wide = clash(odd)
    times = Counter()
    for r in mixing.mix(odd).collect():
        times[r.doc_id] += r.times
    got = mixing.mixed(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter({k: v for k, v in times.items() if v})
    assert all(r[c] == f"extra {c}" for r in rows for c in CLASHING if c in got.columns)


def judged(url: str | None, rules: list[tuple], default: str) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


def test_urls_against_brute_force(spark):
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "x.net", "net", "example.org", "com", "examplecom", "", "..", "a..com", "ex\u00c4mple.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/y/z", "/fr/", "//en/", "/EN/"]
    made = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#x")] + [None, "", "no scheme", "://", "http://", "a://b://c.com/en/", "http://u\n.com/en/\n"]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(made)], "page_id long, url string, html string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(pages, rules).collect()}
    assert got == {k: judged(u, queries.URL_RULES, "allow") for k, u in enumerate(made)}
    none = spark.createDataFrame([], rules.schema)
    assert {tuple(r)[3:] for r in urls.judge_urls(pages, none, "block").collect()} == {(None, "block")}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    doubled = pages.union(pages).withColumn("host", pages["url"]).withColumn("rule", pages["url"]).withColumn("short", pages["url"])
    assert urls.judge_urls(doubled, rules).count() == 2 * len(made)


def test_equal_rows_are_taken_as_often_as_the_target_asks(make):
    rows = [(None, "one two three four", "en", "a")] * 1000 + [(k, f"w{k} two three four", "en", "b") for k in range(1000)]
    got = mixing.mix(make(rows)).collect()
    for source, target in (("a", 8000 / 3), ("b", 16_000 / 3)):
        mine = [r for r in got if r.source == source]
        assert abs(mine[0].target - target) < 1e-6
        assert abs(sum(r.taken for r in mine) - target) <= 4
        assert max(r.taken for r in mine) <= 12
    assert mixing.mixed(make(rows)).count() == sum(r.times for r in got)


def test_equal_large_documents_are_drawn_one_by_one(make):
    rows = [(7, " ".join("x" * 1 for _ in range(50)), "en", "a")] * 10 + [(k, "y " * 40, "en", "b") for k in range(10)]
    got = mixing.mix(make(rows)).collect()
    mine = [r for r in got if r.source == "a"]
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 50


def test_urls_without_a_host_stay_out_of_the_join(spark):
    pages = spark.createDataFrame([(k, None if k % 3 == 0 else "no scheme" if k % 3 == 1 else "http:///en/x" if k % 2 else "https://www.example.com/en/") for k in range(600)], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert len(got) == 600
    for k in range(600):
        want = ("", "", None, "allow") if k % 3 < 2 else ("", "/en/x", None, "allow") if k % 2 else ("www.example.com", "/en/", "www.example.com/en/", "allow")
        assert got[k] == want
