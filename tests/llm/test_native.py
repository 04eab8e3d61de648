"""Operators 1, 5 and 7 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import line_dedup, quality_rules, secret_scan

from .cases import awkward, by_id, empty, rows, texts, with_clashes

WORD = re.compile("[^\x20\x09-\x0d]+")


def quality(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": len(ws) < 20 or 100 * len(hit) > 30 * len(ws)}


@pytest.fixture(scope="module", params=["awkward", "sf0.001"])
def docs(request, spark, sf):
    return awkward(spark) if request.param == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")


def test_quality_base_columns(docs):
    got = rows(quality_rules.report(with_clashes(docs)))
    want = [{"doc_id": i, **quality(t)} for i, t in texts(docs)]
    assert by_id([{k: r[k] for k in want[0]} for r in got]) == by_id(want)
    assert not any(r["kept"] for r in got if r["base_failed"])


def em(patterns):
    """Expectation-maximisation written apart from the operator's: (a function from votes to the posterior, the share of good documents), from {votes: count}.

    The weak priors are those that the operator documents: a rule has cast 1 vote, 0.02 of it bad, on good documents, and 20 votes, 10 of them bad, on bad ones.
    """
    votes = np.array([[np.nan if v is None else v for v in k] for k in patterns], dtype=float)
    count = np.array(list(patterns.values()), dtype=float)
    bad, cast = (votes == 0).astype(float), (~np.isnan(votes)).astype(float)
    share, p, q = 0.9, np.full(votes.shape[1], 0.02), np.full(votes.shape[1], 0.5)

    def is_good(bad, cast):
        a = np.log(share) + bad @ np.log(p) + (cast - bad) @ np.log1p(-p)
        b = np.log1p(-share) + bad @ np.log(q) + (cast - bad) @ np.log1p(-q)
        return 1 / (1 + np.exp(np.clip(b - a, -700, 700)))

    for _ in range(200):
        weight = count * is_good(bad, cast)
        rest = count - weight
        share = np.clip(weight.sum() / count.sum(), 1e-6, 1 - 1e-6)
        p = np.clip((0.02 + weight @ bad) / (1 + weight @ cast), 1e-6, 1 - 1e-6)
        q = np.maximum(p, np.clip((10 + rest @ bad) / (20 + rest @ cast), 1e-6, 1 - 1e-6))
    one = lambda v: (np.array([[float(x == 0) for x in v]]), np.array([[float(x is not None) for x in v]]))
    return (lambda v: float(is_good(*one(v))[0])), float(share)


def test_quality_posterior_follows_the_estimates(docs):
    """What DataFrame functions make of the votes equals the posterior of an estimation written apart, over the documents that pass the base rules."""
    judged = quality_rules.judge(docs, ["doc_id"])
    votes = quality_rules.rules(lambda name: judged["_quality"][name])
    got = judged.select("_quality.p_good", "_quality.kept", "_quality.base_failed", *[v.alias(k) for k, v in votes.items()]).collect()
    posterior, _ = em(Counter(tuple(r[3:]) for r in got if not r["base_failed"]))
    for r in got:
        p = posterior(tuple(r[3:]))
        assert abs(p - r["p_good"]) < 1e-6
        assert r["kept"] == (not r["base_failed"] and p >= 0.5) or abs(p - 0.5) < 1e-6


def test_estimation_finds_planted_rates():
    import random

    rng = random.Random(1)
    rates = [(0.02, 0.9), (0.05, 0.6), (0.01, 0.7), (0.08, 0.8)]
    seen = Counter()
    for _ in range(30_000):
        good = rng.random() < 0.8
        seen[tuple(int(rng.random() >= (g if good else b)) if rng.random() < 0.9 else None for g, b in rates)] += 1
    share, found = quality_rules.estimate(list(seen.items()))
    assert abs(share - 0.8) < 0.03
    assert all(abs(a - c) < 0.03 and abs(b - d) < 0.08 for (a, b), (c, d) in zip(rates, found, strict=True))


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.1"
    out = quality_rules.report(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "kept", "base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in out if r["quality"] == 1], [r for r in out if r["quality"] == 0]
    print(len(good), sum(r["kept"] for r in good), sum(r["base_failed"] for r in good), len(bad), sum(r["kept"] for r in bad))
    assert sum(r["kept"] for r in good if not r["base_failed"]) >= 0.97 * sum(not r["base_failed"] for r in good)


def test_quality_posterior_decides_and_no_single_vote(spark):
    """Documents with a bad vote that the posterior keeps, and labelled good ones among them; junk goes, and not by one rule alone."""
    d = "/root/testdata/sf0.1"
    judged = quality_rules.judge(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id"])
    votes = quality_rules.rules(lambda name: judged["_quality"][name])
    assert list(votes) == quality_rules.RULES
    out = judged.select("doc_id", "_quality.kept", "_quality.base_failed", "_quality.p_good", *[v.alias(k) for k, v in votes.items()]).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").collect()
    down = [r for r in out if not r["base_failed"] and any(r[k] == 0 for k in votes)]
    good, bad = [r for r in down if r["quality"] == 1], [r for r in down if r["quality"] == 0]
    print(len(down), sum(r["kept"] for r in down), len(good), sum(r["kept"] for r in good), len(bad), sum(r["kept"] for r in bad))
    assert any(r["kept"] for r in down)
    assert good and sum(r["kept"] for r in good) >= 0.9 * len(good)
    assert bad and sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert all(sum(r[k] == 0 for k in votes) >= 2 for r in down if not r["kept"])


def test_quality_drops_documents_without_a_bad_vote_where_the_posterior_says_so(spark):
    """Where most of what passes the base rules is junk, a document on which nearly all rules abstain is more likely junk than not; one with good votes stays."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    junk = [" ".join(x for _ in range(30) for x in (word(5), "|")) for _ in range(300)]
    fine = [" ".join(word(5) for _ in range(60)) for _ in range(40)]
    unsure = " ".join(f"{word(2)}7" for _ in range(25)) + " #"  # 25 words of 3 characters, a third of them digits
    unsure = unsure.replace("7", "x", 22)
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*junk, *fine, unsure])], "doc_id long, text string")
    judged = quality_rules.judge(df, ["doc_id"])
    votes = quality_rules.rules(lambda name: judged["_quality"][name])
    got = {r["doc_id"]: r for r in judged.select("doc_id", "_quality.kept", "_quality.base_failed", *[v.alias(k) for k, v in votes.items()]).collect()}
    last = got[len(junk) + len(fine)]
    assert not last["base_failed"] and not any(last[k] == 0 for k in votes)
    assert not last["kept"]
    assert all(got[len(junk) + k]["kept"] for k in range(len(fine)))


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute_lines(docs):
    """Lines that go, by comparing every line with all earlier ones."""
    named = [(i if i is not None else 2**63 - 1, t, n) for n, (i, t) in enumerate(docs)]
    lines = [((i, t, no), n, x.strip(" ").split(" ")) for i, t, n in named if t is not None for no, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2] != [""]]
    gone, first = {}, {}
    for at, n, w in lines:
        first[tuple(w)] = min(first.get(tuple(w), at), at)
    for at, n, w in lines:  # equal lines of any length
        if first[tuple(w)] < at:
            gone.setdefault(n, set()).add(at[2])
    lines = [x for x in lines if len(x[2]) >= 5]
    by_end = {}
    for at, n, w in lines:
        for k in {(1, *w[:2]), (-1, *w[-2:])}:
            by_end.setdefault(k, []).append((at, w))
    for at, n, w in lines:
        # one edit leaves the first two or the last two words as they are, of five or more
        near = [x for k in {(1, *w[:2]), (-1, *w[-2:])} for x in by_end[k]]
        if any((o[0], o[2]) < (at[0], at[2]) and (o[0] != at[0] or o[1] == at[1]) and one_edit(w, x) for o, x in near):
            gone.setdefault(n, set()).add(at[2])
    return gone


def test_lines(docs):
    plain = [(i, t) for i, t in texts(docs)]
    gone = brute_lines(plain)
    want = []
    for n, (i, t) in enumerate(plain):
        kept = "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone.get(n, ())) if t is not None else ""
        want.append({"doc_id": i, "n_lines": len(t.split("\n")) if t is not None else 0, "n_dropped": len(gone.get(n, ())), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()})
    assert by_id(rows(line_dedup.report(with_clashes(docs)))) == by_id(want)


def test_lines_one_edit_apart(spark):
    a = "one two three four five six"
    cases = [a, a.replace("three", "3"), a + " seven", a[4:], "one two four three five six", "zero " + a, a.upper(), "one two three four", "one two three four"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.report(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0, 8: 1}  # of lines under five words only equal ones go


def base_spans(text):
    text, found = text or "", []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, docs):
    ratios = secret_scan.train(secret_scan.sample(spark))
    at = {c: k for k, c in enumerate(secret_scan.ALPHABET)}
    want = []
    for i, t in texts(docs):
        base = base_spans(t)
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t or ""):
            w = m[0]
            ratio = sum(ratios[at[a] * len(at) + at[b]] for a, b in zip(w, w[1:])) / (len(w) - 1)
            if ratio >= secret_scan.RATIO_FROM and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                more.append((m.start(), 3, m.end(), "model"))
        show = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(x))
        n = Counter(k for *_, k in base)
        want.append({"doc_id": i, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "n_model": len(more), "base_sha256": hashlib.sha256(show(base).encode()).hexdigest(), "spans": show(base + more)})
    assert by_id(rows(secret_scan.report(with_clashes(docs)))) == by_id(want)


def test_models_on_held_out_samples(spark):
    ratios = secret_scan.train(secret_scan.sample(spark))
    at = {c: k for k, c in enumerate(secret_scan.ALPHABET)}
    right = total = 0
    for r in secret_scan.sample(spark, seed=99, each=600).collect():
        w = r["token"]
        if len(w) >= 20:
            ratio = sum(ratios[at[a] * len(at) + at[b]] for a, b in zip(w, w[1:])) / (len(w) - 1)
            right += (ratio >= secret_scan.RATIO_FROM) == r["secret"]
            total += 1
    assert right >= 0.97 * total


def test_recall_by_alphabet(spark):
    """Random tokens of letters alone are found as those with digits are; words run together are not."""
    rng = random.Random(17)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(secret_scan.PARTS) for _ in range(9)) for _ in range(200)]
    tokens = [("".join(rng.choice(a) for _ in range(n)), True) for a in (letters, letters[:26], letters[26:], letters + "0123456789") for n in (20, 28, 40) for _ in range(70)] + [(w, False) for w in words if len(w) >= 20]
    df = spark.createDataFrame([(k, f"see {t} here") for k, (t, _) in enumerate(tokens)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_model"] + r["n_access"] + r["n_hex"] > 0 for r in secret_scan.report(df).collect()}
    secret = [found[k] for k, (_, s) in enumerate(tokens) if s]
    plain = [found[k] for k, (_, s) in enumerate(tokens) if not s]
    print(sum(secret), len(secret), sum(plain), len(plain))
    assert sum(secret) >= 0.97 * len(secret)
    assert sum(plain) <= 0.02 * len(plain)


def test_many_matches_in_one_text(spark):
    t = "é token=abcdef1 " * 3000
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = secret_scan.report(df).first()
    assert r["n_assign"] == 3000
    assert r["spans"].split(",")[2999] == f"assign:{16 * 2999 + 2}:{16 * 2999 + 15}"


@pytest.mark.parametrize("op", [quality_rules.report, line_dedup.report, secret_scan.report])
def test_empty_table(spark, op):
    assert op(empty(spark)).collect() == []
