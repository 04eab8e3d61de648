"""Operator 2 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tessella.llm import suffix_dedup

from .cases import awkward, by_id, empty, rows, texts, with_clashes


def brute(docs):
    named = [(i if i is not None else 2**63 - 1, i, (t or "").encode()) for i, t in docs]
    least = {}
    for k, _, b in named:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, k), k)
    out = []
    for k, i, b in named:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append({"doc_id": i, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": spans, "kept_sha256": hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()})
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 20_000])
def test_awkward(spark, block_bytes):
    docs = awkward(spark)
    assert by_id(rows(suffix_dedup.dedup(with_clashes(docs), block_bytes))) == by_id(brute(texts(docs)))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert by_id(rows(suffix_dedup.dedup(docs, 100_000))) == by_id(brute(texts(docs)))


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
def test_repetitive(spark, alphabet):
    rng = random.Random(len(alphabet))
    passages = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (49, 50, 51, 80, 200)]
    docs = [(k % 37, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(5))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(rows(suffix_dedup.dedup(df, 3_000))) == by_id(brute(docs))


def test_empty(spark):
    assert suffix_dedup.dedup(empty(spark)).collect() == []


def test_anchor_of_each_window():
    rng = random.Random(3)
    for trial in range(60):
        docs = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 10, 49, 50, 51, 120, 300]))) for _ in range(4)] + [b"a" * 200] * (trial % 3 == 0)
        buf, off = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0] + [len(d) for d in docs])
        place, _, first, count = suffix_dedup.anchors(buf, off)
        h = suffix_dedup.gram_hashes(buf) if len(buf) >= 50 else []
        want = [(w, min(range(w, w + suffix_dedup.SPREAD), key=lambda q: (int(h[q]), q))) for a, b in zip(off[:-1], off[1:], strict=True) for w in range(a, b - 49)]
        assert [(f + k, p) for p, f, c in zip(place.tolist(), first.tolist(), count.tolist(), strict=True) for k in range(c)] == want


def test_groups_of_equal_windows():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 2, (500, 9)).astype(np.uint8)
    group = rng.integers(0, 3, 500)
    got = suffix_dedup.msd_groups(windows, group)
    keys = [(g, bytes(w)) for g, w in zip(group, windows, strict=True)]
    for i in range(500):
        assert (got[i] == -1) == (keys.count(keys[i]) == 1)
    met = {}
    assert all(met.setdefault(g, k) == k for g, k in zip(got, keys, strict=True) if g >= 0)


def test_long_texts_in_steps():
    """A text that is gone through in steps has the anchors and word hashes that it has as a whole."""
    import numpy as np

    from tessella.llm import suffix_dedup, texthash

    rng = np.random.default_rng(5)
    text = rng.integers(97, 101, 30_000).astype(np.uint8)
    text[rng.random(len(text)) < 0.15] = 32
    text[5000:9000] = text[:4000]
    offsets = np.array([0, len(text)])

    def each_window(found):
        place, h, first, count = found
        return {int(f) + k: (int(p), int(x)) for p, x, f, n in zip(place, h, first, count, strict=True) for k in range(n)}

    whole = each_window(suffix_dedup.anchors(text, offsets))
    for step in (60, 999, 7000):
        assert each_window(suffix_dedup.anchors_in_steps(text, offsets, step)) == whole
    starts, ends, _ = texthash.words(text, offsets, texthash.NOT_SPACE)
    hashes = texthash.span_hashes(text, starts, ends)
    for step in (50, 4096):
        assert (texthash.span_hashes(text, starts, ends, step) == hashes).all()
    long = np.full(200_000, 97, np.uint8)  # one word
    assert texthash.span_hashes(long, np.array([0]), np.array([200_000])) == texthash.span_hashes(np.append(long, np.uint8(32)), np.array([0]), np.array([200_000]), 100)


def test_a_text_of_many_megabytes(spark):
    """One text of 12 MB and a copy of it beside short ones, in the operators that hash words or bytes."""
    from tessella.llm import ngram_join, suffix_dedup

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(1_700_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "short " * 5), (4, long[:400])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.report(df).collect()}
    assert got == {1: (len(long), 0, 0), 2: (len(long), len(long), 1), 3: (30, 0, 0), 4: (400, 400, 1)}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.report(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
