"""Token ids against the tokenizers library, alignments and resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import alignment as A
from tessera.llm import queries, resampling, tokens
from tessera.llm.common import read

from conftest import rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = ["<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "  <|endoftext|>\n\n x", "<|endoftext", "<s>x</s><unk>", "▁a ▁ b", "a\u0000b", "tabs\t\tand\r\nlines\n\n\n", "'s 's'll I'LL ’s", "１２ 三 Ⅻ ½", "é‍ 　x", " ", "   ", "\x1c \x1d x", "日本語のテキスト。", "a" * 30_000, "-=" * 9000, " " * 20_000, "😀" * 999]


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, "rb") as f:
        return tokens.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def piece_model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", SPECIAL, ids=range(len(SPECIAL)))
def test_ids_of_special_texts(bpe, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == want
    assert bpe.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcde tionsgh \n'-=é<|>endoftx"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_of_any_text(text):
    bpe, library = _pair()
    assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


_PAIR: list = []


def _pair():
    if not _PAIR:
        with open(PATH, "rb") as f:
            _PAIR[:] = [tokens.Bpe(f.read()), Tokenizer.from_file(PATH)]
    return _PAIR


def test_words_part_alike_at_every_code_point(bpe, library):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}." for c in points[lo : lo + 20_000]]
        for x, h in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert bpe.encode(x) == h.ids, hex(ord(x[1]))


def test_every_token_is_its_own_encoding_or_is_left_out(bpe):
    assert all(bpe.word(bpe.bytes_of[k]) == [k] for k in range(0, 50_256, 7))


def test_known_words_are_bounded(bpe, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)
    words = tokens.Words(bpe)
    for k in range(500):
        assert words[f"w{k}"] == tuple(bpe.word(f" w{k}".encode()) if len(tokens.WORDS.findall(f" w{k}")) == 1 else bpe.encode(f" w{k}", False))
        assert len(words) <= 51 and len(words.older) <= 51


def test_op12_is_the_library(spark, data, library):
    got = {r.doc_id: r for r in queries.op12_bpe(spark, data).collect()}
    docs = read(spark, data, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_of_odd_tables(spark, odd, clash, library):
    got = tokens.decoded(tokens.encoded(clash(odd)))
    assert set(clash(odd).columns) < set(got.columns)
    for r in got.collect():
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert tokens.decoded(tokens.encoded(odd.limit(0))).collect() == []


def brute_alignment(texts: dict, library, model) -> dict:
    """Overlaps of all token pairs by their byte ranges, and groups by common ends."""
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    letters = tokens.byte_letters()
    bytes_of = {k: bytes(letters[c] for c in s) for s, k in plain.get_vocab().items() if k != 50256}
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    piece_bytes = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
    out, held = {}, Counter()
    for key, text in texts.items():
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(map(piece_bytes.__getitem__, b)) != whole or b"".join(map(bytes_of.__getitem__, a)) != whole:
            out[key] = (0, 0, 0, 0, [], "")
            continue
        ends_a, ends_b = np.cumsum([len(bytes_of[k]) for k in a]).tolist(), np.cumsum([len(piece_bytes[k]) for k in b]).tolist()
        links, j = [], 0
        for i, e in enumerate(ends_a):
            s = ends_a[i - 1] if i else 0
            while ends_b[j] <= s:
                j += 1
            m = j
            while m < len(b) and (ends_b[m - 1] if m else 0) < e:
                links.append((a[i], b[m]))
                m += 1
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            x, y = p, q
        out[key] = (len(a), len(b), len(groups), len(links), links, ";".join(groups))
        held.update(set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return {
        k: (na, nb, ng, nl, sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for k, (na, nb, ng, nl, links, g) in out.items()
    }


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [A.BROADCAST_PAIRS, 0])
def test_alignment_against_brute_force(spark, data, make, library, piece_model, most):
    docs = read(spark, data, "documents").limit(120).collect()
    texts = {d.doc_id: d.text for d in docs} | {10**6 + k: t for k, t in enumerate(SPECIAL) if len(t) < 1000} | {-1: None, -2: ""}
    want = brute_alignment(texts, library, piece_model)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in A.alignment(make(list(texts.items())), most=most).collect()}
    assert got == want


def test_alignment_by_stretches(monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.integers(1, 7, 4000), r.integers(1, 9, 9000)
    b = b[: np.searchsorted(np.cumsum(b), a.sum())]
    b = np.r_[b, a.sum() - b.sum()]
    whole = [x.tolist() for x in A.owners(a, b)]
    monkeypatch.setattr(A, "STRETCH", 64)
    assert [x.tolist() for x in A.owners(a, b)] == whole
    assert [len(x) for x in A.owners(a[:0], b[:0])] == [0, 0, 0, 0]


def test_alignment_of_odd_tables(odd, clash):
    got = A.aligned(clash(odd)).select(clash(odd).columns)
    assert rows_of(got) == rows_of(clash(odd))
    rows = A.alignment(clash(odd)).collect()
    assert len(rows) == odd.count() and all(r.n_a == 0 and r.groups_sha256 == "" for r in rows if r.doc_id in (1, 2))
    assert A.alignment(odd.limit(0)).collect() == []


def brute_resampling(docs: list[tuple], target: list[str], percent: int = 25) -> list[tuple]:
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2) for k in range(len(words) - n + 1)]

    mine = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in mine for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (key, _), (n, f) in zip(docs, mine, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resampling_against_brute_force(spark, data):
    docs = read(spark, data, "documents")
    want = brute_resampling([(d.doc_id, d.text) for d in docs.collect()], [r.text for r in read(spark, data, "benchmark").collect()])
    assert rows_of(queries.op13_resampling(spark, data)) == want
    assert sum(r[4] is not None for r in want) > 20


def test_resampling_of_odd_tables(odd, clash, make, monkeypatch):
    target = make([(1, "word1 of2 word3"), (2, None), (3, "")])
    want = brute_resampling([(r.doc_id, r.text) for r in odd.collect()], ["word1 of2 word3", "", ""])
    assert rows_of(resampling.resampled(clash(odd), clash(target))) == want
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 2)
    monkeypatch.setattr(resampling, "STRETCH", 100)
    assert resampling.row_of("a b " * 400)[1].tolist() == [*sorted([400, 400, 400, 399])] or sum(resampling.row_of("a b " * 400)[1]) == 1599
    assert resampling.resampled(odd.limit(0), target).collect() == []
    assert len(resampling.resampled(odd, target.limit(0)).collect()) == odd.count()


def test_long_texts_are_counted_by_stretches(monkeypatch):
    text = " ".join(f"w{k % 97}  " for k in range(3000))
    whole = resampling.row_of(text)
    monkeypatch.setattr(resampling, "STRETCH", 50)
    parts = resampling.row_of(text)
    assert [x.tolist() for x in whole[:2]] == [x.tolist() for x in parts[:2]] and whole[2] == parts[2]


def test_equal_rows_get_ranks_of_their_own(make):
    text = " ".join(f"w{k}" for k in range(30))
    rows = resampling.resampled(make([(None, text)] * 60 + [(k, text) for k in range(40)]), make([(1, text)])).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 26))


def test_kept_matrix_is_read_in_bounded_groups(spark, make, monkeypatch, tmp_path):
    """A task holds a row group of the matrix and no more: rows are documents, and groups have a size of their own."""
    texts = [(k, " ".join(f"w{(k * 7919 + j * 104729) % 1000003}" for j in range(400))) for k in range(3000)]
    kept = []
    monkeypatch.setattr(resampling, "GROUP", 1 << 16)
    plain = resampling.cut_lineage
    monkeypatch.setattr(resampling, "cut_lineage", lambda df, *a: kept.append(plain(df, *a)) or kept[-1])
    docs = make(texts).coalesce(1)
    assert rows_of(resampling.resampled(docs, make([(1, texts[0][1])]))) == brute_resampling(texts, [texts[0][1]])
    groups = [m.row_group(g) for f in kept[0].inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://").replace("file:", "")).metadata] for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 3000 and len(groups) > 3 and max(sum(g.column(c).total_uncompressed_size for c in range(g.num_columns)) for g in groups) < 4 << 20
