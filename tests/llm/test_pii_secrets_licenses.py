"""Personal data against the base patterns, secrets and licences on planted and clean texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from conftest import rows_of
from pyspark.sql import functions as F

from tessera.llm import licenses, pii, secrets

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple]:
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def texts() -> list[str | None]:
    rnd = random.Random(3)
    parts = ["a@b.c", "..x@y-.z.w.", "a@b", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1 2", "+49 30 123456789", "555-123-4567", "00.00.00.000",
             "9", " ", "-", ".", "+", "x", "\U0001f600", "", "", "\n", "call me", "card", "0000000000000000", "1 1 1 1 1 1 1 1 1 1 1 1", "a.b+c%d@e.f.g-h", "@b.c", "a@@b.c"]
    made: list[str | None] = ["".join(rnd.choice(parts) + rnd.choice(["", "", " "]) for _ in range(rnd.randrange(1, 30))) for _ in range(400)]
    return [*made, None, "", "7" * 3000, "a." * 4000 + "@", "1." * 4000, "word " * 50_000 + "me@example.org", "+" + "1-" * 3000 + "1"]


def test_base_spans_are_those_of_the_patterns(make):
    rows = list(enumerate(texts()))
    names = list(BASE)
    got = pii.personal_data(make(rows)).select("doc_id", "base", pii.digest(F.col("base")).alias("digest"), "added").collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(rows[r.doc_id][1])
        assert sorted((s.start, s.kind, s.stop) for s in r.base) == want, rows[r.doc_id]
        assert r.digest == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert not {(s.start, s.kind, s.stop) for s in r.added} & set(want)


def test_pii_bears_odd_rows(odd, clash):
    got = pii.personal_data(odd)
    assert got.count() == odd.count()
    assert rows_of(pii.personal_data(clash(odd))) == rows_of(got)
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_em_finds_the_reliable_labelers():
    rnd = random.Random(1)
    counts, truth = Counter(), Counter()
    for _ in range(20_000):
        y = rnd.random() < 0.4
        votes = tuple((2 if y == (rnd.random() < right) else 0) if rnd.random() < 0.8 else 1 for right in (0.95, 0.9, 0.8, 0.55))
        counts[(0, *votes)] += 1
        truth[(0, *votes)] += y
    posterior, reliability = pii.estimate([(*k, n) for k, n in counts.items()])
    right = sum(max(n - truth[k], 0) if posterior[k] < 0.5 else truth[k] for k, n in counts.items())
    assert right / 20_000 > 0.9
    yes = reliability[0][:, 1, 2]
    assert yes[0] > yes[2] > yes[3]


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_secrets_held_out(make):
    rnd = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n, of=letters: "".join(rnd.choice(of) for _ in range(n))
    real, fake, rows = set(), set(), []
    for k in range(200):
        s = [draw(40), "AKIA" + draw(16, letters[:26] + "0123456789"), "sk_live_" + draw(24), draw(32, "0123456789abcdef")][k % 4]
        rows.append((k, f'some words before api_key = "{s}" and more words'))
        real.add(digest(s))
    for k in range(200, 400):
        s = [f"src/module/report{k}/index/page", f"chapter-number-{k}-section", f"your_token_here_{k}", draw(40, "0123456789abcdef")][k % 4]
        rows.append((k, f"some words before commit {s} and more words"))
        fake.add(digest(s))
    told = {r.digest for r in secrets.secrets(make(rows)).collect()}
    assert len(told & real) > 0.9 * len(real) and len(told & fake) < 0.1 * len(fake)


def test_secrets_without_digits_quotes_or_bounds(make):
    rnd = random.Random(19)
    upper, letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    rows, real = [], {}
    for k in range(160):
        s = ["AKIA" + draw(16, upper), draw(16, letters), draw(9, letters + digits), draw(240, letters + digits + "!.")][k % 4]
        rows.append((k, [f'key = "{s}" and', f'token = "{s}" and', f"DB_PASSWORD: {s}\nnext: 1", f'secret = "{s}" and'][k % 4]))
        real[k] = digest(s)
    rows += [(200, "password=Hunter2abc\n"), (201, "DB_PASSWORD: s3cr3t\n")]
    real |= {200: digest("Hunter2abc"), 201: digest("s3cr3t")}
    rows += [(300 + k, t) for k, t in enumerate(["=" * 60, "the internationalizationofproducts is done", "Your password: please change it.", "forgot the token: ask the user", "see content/section/product/view here"])]
    found = {(r.doc_id, r.digest) for r in secrets.secrets(make(rows)).collect()}
    for kind in range(4):
        assert sum((k, real[k]) in found for k in range(kind, 160, 4)) >= 36
    assert all((k, real[k]) in found for k in (200, 201))
    assert not [k for k, _ in found if k >= 300]


def test_secrets_place_and_odd_rows(make, odd, clash):
    text = "\U0001f600  token = \"Zk83hQpX0vTn2LwYc7RbDfGm5JsA9eUi4HqN1xBo\" end"
    (r,) = secrets.secrets(make([(4, text)])).collect()
    body = text[r.start : r.stop]
    assert body.startswith("Zk83") and body.endswith("xBo") and r.digest == digest(body)
    got = rows_of(secrets.secrets(odd))
    assert rows_of(secrets.secrets(clash(odd))) == got
    assert secrets.secrets(odd.limit(0)).count() == 0
    twice = make([(4, text), (4, text), (None, text)])
    assert sorted((r.doc_id or -1) for r in secrets.secrets(twice).collect()) == [-1, 4, 4]


def test_licences(make, odd, clash):
    rows = [(k, f"Some prose first.\n{t}\nAnd prose after.") for k, t in enumerate(t for ts in licenses.TEMPLATES.values() for t in ts)]
    want = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    got = {r.doc_id: r.licences for r in licenses.licences(make(rows)).collect()}
    right = [any(x.family == want[k] and rows[k][1][x.start : x.stop] == rows[k][1].split("\n")[1] for x in got[k]) for k in got]
    assert sum(right) >= 0.9 * len(rows)
    clean = make(list(enumerate(licenses.PLAIN)))
    assert all(not r.licences for r in licenses.licences(clean).collect())
    wide = clash(odd)
    out = licenses.licences(wide)
    assert sorted(out.columns) == sorted(wide.columns) and out.count() == odd.count()
    assert licenses.licences(odd.limit(0)).count() == 0


def test_licences_over_several_lines():
    model = licenses.fit()
    text = "Some \U0001f600 prose first.\n\nLicensed under the\nApache License, Version 2.0.\n\nMore prose."
    (one,) = licenses.scan(text, model)
    assert one["family"] == "apache-2.0" and text[one["start"] : one["stop"]] == "Licensed under the\nApache License, Version 2.0."
    wanted = right = 0
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            ws = t.split()
            if len(ws) < 8:
                continue
            body = "\n".join(" ".join(ws[k : k + 4]) for k in range(0, len(ws), 4))
            wanted += 1
            right += family in {f["family"] for f in licenses.scan(f"Prose.\n\n{body}\n\nProse.", model)}
    assert right >= 0.9 * wanted
    assert not any(licenses.scan("\n".join(t.split()), model) for t in licenses.PLAIN)


def test_one_text_of_many_matches_takes_time_in_proportion(spark):
    """A hundred thousand figures in one text; a fold that carried them all would take minutes."""
    import time

    from pyspark.sql import functions as F

    from tessera.llm import spans

    text = " ".join(str(1000 + k % 9000) for k in range(100_000))
    start = time.time()
    found = spark.createDataFrame([(1, text)], "doc_id long, text string").select(spans.matches(F.col("text"), "[0-9]+", 3).alias("m")).first().m
    assert time.time() - start < 60
    assert [m.start for m in found] == list(range(0, 500_000, 5)) and found[-1].body == text[-4:] and found[1].before == text[:5]


def test_licence_stretches_grow_with_the_lines():
    lines = [(k, 30 * k, 30 * k + 29, licenses.words("the terms of the house in the")) for k in range(20_000)]
    found = licenses.wrapped(lines)
    assert len(found) < 20 * len(lines)
    assert [len(x) for x in licenses.wrapped(lines[:2])] == [2]
