"""The pipeline against brute force, stage by stage on what brute force kept, and as a whole."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm.common import table

from .cases import awkward, empty, with_clashes
from .test_native import WORD, brute_lines, em, quality
from .test_others import brute_components, brute_hits


def votes(text):
    f, t = quality(text), text or ""
    ws = WORD.findall(t)
    n, lines = len(ws), sum(bool(WORD.search(x)) for x in t.split("\n"))

    def vote(value, bad, good):
        return None if value is None else 0 if bad(value) else 1 if good(value) else None

    share = lambda a, b: a / b if b else None
    fresh, doubled = share(len(set(ws)), n), share(f["n_dup_lines"], lines)
    return (
        vote(n, lambda x: x < 20, lambda x: x >= 50),
        vote(share(f["word_chars"], n), lambda x: x < 2.5 or x > 15, lambda x: 3.5 <= x <= 11),
        vote(share(f["n_symbols"], n), lambda x: x > 0.1, lambda x: x < 0.02),
        vote(share(sum(c in "0123456789" for c in t), f["word_chars"]), lambda x: x > 0.15, lambda x: x < 0.05),
        vote(share(f["n_repeat_words"], n), lambda x: 100 * f["n_repeat_words"] > 30 * n, lambda x: x < 0.1),
        vote(doubled, lambda x: x > 0.3, lambda x: x < 0.1 and lines >= 3),
        vote(fresh, lambda x: 50 <= n <= 2000 and x < 0.2, lambda x: x > 0.35),
        vote(share(len(regex.findall(r"\p{L}[#*$%&|<>]", t)), n), lambda x: x > 0.1, lambda x: x < 0.02),
        vote(share(sum(set(w) <= set("#*$%&|<>") for w in ws), n), lambda x: x > 0.1, lambda x: x < 0.02),
    )


def brute(docs, benchmark):
    """What each stage keeps of (doc_id, text)."""
    seen = [votes(t) for _, t in docs]
    failed = [quality(t)["base_failed"] for _, t in docs]
    posterior, _ = em(Counter(v for v, f in zip(seen, failed, strict=True) if not f))
    docs = [d for d, v, f in zip(docs, seen, failed, strict=True) if not f and posterior(v) >= 0.5]
    yield docs
    gone = brute_lines(docs)
    cut = [(i, "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone.get(k, ())) if k in gone else t) for k, (i, t) in enumerate(docs)]
    docs = [d for k, d in enumerate(cut) if k not in gone or WORD.search(d[1])]
    yield docs
    docs = [d for d, c in zip(docs, brute_components(docs, 5, 80), strict=True) if c["component_id"] == d[0]]
    yield docs
    docs = [d for d, h in zip(docs, brute_hits(docs, benchmark), strict=True) if not h["contaminated"]]
    yield docs


def packed(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    out = Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            out[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    return out


@pytest.mark.parametrize("which", ["awkward", "sf0.001"])
def test_stages(spark, sf, which):
    docs = with_clashes(awkward(spark)) if which == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda d: (d[0] is None, d[0] or 0, d[1] or "")
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(rows, benchmark), strict=False):
        columns = docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        got = docs.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(want, key=key), name
        assert all(r["text"] is None or r["n_chars"] in (None, len(r["text"])) for r in got), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == packed(want)


def test_run(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    benchmark = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    *_, want = brute(rows, benchmark)
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == packed(want)


def test_empty(spark, sf):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
