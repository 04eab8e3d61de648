"""Benchmark decontamination (operator 8): Wu-Manber search for test windows, over words.

Test windows of a common length are searched together. A table of block shifts tells how far the window's
end may jump; where the shift is 0, the block's hash selects a bucket of test strings, and they are compared
word by word and then byte by byte. Many documents, cut into short stretches, are searched in step, so each
step is one numpy operation on all stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .texthash import ALNUM, BASE, FOLD, U, chunks, mix, span_hashes, words

WINDOW = 10
#: Ends of windows in one stretch.
STRETCH = 256
#: Slots of a shift table for each block in the windows, as a power of two within these bounds.
SLOTS_A_BLOCK, LEAST_BITS, MOST_BITS = 8, 10, 22
#: Test text in one broadcast; more goes out as several. The index takes at most so many bytes for each word of it, and the text itself, item ids and shift tables (8 MB at most, for each of ten lengths) besides.
BROADCAST_BYTES, INDEX_BYTES_A_WORD = 4 << 20, 48

FOUND_TYPE = "struct<n_words: bigint, hits: array<struct<lo: int, hi: int>>, items: array<string>>"


class Tests:
    """The words of all test items, in order: bytes once, where each word starts and ends, its hash, and where each item's words start."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        parts: list[list] = [[], [], [], []]
        data, firsts, base, n = [], [np.zeros(1, np.int64)], 0, 0
        for _, _, raw, offsets in chunks(pa.array([t for _, t in items], pa.string())):
            buf = FOLD[raw]
            starts, ends, first = words(buf, offsets, ALNUM)
            for part, x in zip(parts, (starts + base, ends + base, span_hashes(buf, starts, ends) if len(starts) else np.zeros(0, U)), strict=False):
                part.append(x)
            firsts.append(first[1:] + n)
            data.append(buf.tobytes())
            base, n = base + len(buf), n + len(starts)
        flat = lambda part, kind: np.concatenate(part).astype(kind) if part else np.zeros(0, kind)
        self.data, self.starts, self.ends, self.hashes = b"".join(data), flat(parts[0], np.int64), flat(parts[1], np.int64), flat(parts[2], U)
        self.first = np.concatenate(firsts)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, with a space between."""
        return b" ".join([self.data[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)])


def blocks(h: np.ndarray, width: int) -> np.ndarray:
    """At each word, the hash of the block of `width` words that ends there; before the first full block, anything."""
    out = h.copy()
    if width == 2:
        out[1:] = mix(h[:-1] * U(BASE) + h[1:])
    return out


class Patterns:
    """Windows of one length with their shift table and suffix buckets; a window is the place of its first word among the tests' words."""

    def __init__(self, length: int, tests: Tests, at: np.ndarray, item: np.ndarray):
        self.length, self.width, self.tests = length, min(2, length), tests
        block = blocks(tests.hashes, self.width)
        in_windows = min(len(at) * (length - self.width + 1), len(tests.hashes))  # blocks, at most
        self.bits = min(max(LEAST_BITS, (SLOTS_A_BLOCK * in_windows).bit_length()), MOST_BITS)
        self.shift = np.full(1 << self.bits, length - self.width + 1, dtype=np.int16)
        for k in range(self.width - 1, length):
            np.minimum.at(self.shift, self.slot(block[at + k]), length - 1 - k)
        order = np.argsort(block[at + length - 1], kind="stable")
        self.at, self.item = at[order], item[order].astype(np.int32)
        self.suffixes = block[self.at + length - 1]

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> U(64 - self.bits)).astype(np.int64)

    def search(self, h: np.ndarray, first: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """(ends, items) of all occurrences among the words with hashes h; documents start at `first`."""
        m = self.length
        lo, hi = first[:-1] + m - 1, first[1:]
        lo, hi = lo[lo < hi], hi[lo < hi]
        each = -(-(hi - lo) // STRETCH)
        if not len(lo):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at = np.repeat(lo, each) + nth * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(hi, each))
        block = blocks(h, self.width)
        jump = self.shift[self.slot(block)]
        stops = []
        while len(at):
            step = jump[at]
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends = np.concatenate(stops)
        low = np.searchsorted(self.suffixes, block[ends], side="left")
        high = np.searchsorted(self.suffixes, block[ends], side="right")
        found_at, found = [], []
        while len(ends):  # one test string of each bucket at a time
            on = low < high
            ends, low, high = ends[on], low[on], high[on]
            same = np.ones(len(ends), dtype=bool)
            for k in range(m):
                same[same] = h[ends[same] - (m - 1 - k)] == self.tests.hashes[self.at[low[same]] + k]
            for end, place, item in zip(ends[same].tolist(), self.at[low[same]].tolist(), self.item[low[same]].tolist(), strict=True):
                if text_of(end - m + 1, end + 1) == self.tests.text(place, place + m):
                    found_at.append(end)
                    found.append(item)
            low = low + 1
        return np.array(found_at, np.int64), np.array(found, np.int64)


def compile_patterns(items: list[tuple[str, str]], window: int) -> list[Patterns]:
    tests = Tests(items)
    n_words = np.diff(tests.first)
    out = []
    for length in np.unique(np.minimum(n_words, window)[n_words > 0]).tolist():
        mine = np.flatnonzero(np.minimum(n_words, window) == length)
        n = n_words[mine] - length + 1
        item = np.repeat(mine, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tests.first[mine], n)
        h = np.zeros(len(at), U)
        for k in range(length):
            h = h * U(BASE) + tests.hashes[at + k]
        once = np.unique(np.stack([h, item.astype(U)]), axis=1, return_index=True)[1]  # an item's repeated window is one
        once = np.sort(once)
        out.append(Patterns(length, tests, at[once], item[once]))
    return out


def scan(texts: pa.Array, patterns: list[Patterns]):
    """For each text (number of words, runs of hit words, items found)."""
    for _, _, raw, offsets in chunks(texts):
        buf = FOLD[raw]
        starts, ends, first = words(buf, offsets, ALNUM)
        rows = len(offsets) - 1
        runs: list[list] = [[] for _ in range(rows)]
        found: list[set] = [set() for _ in range(rows)]
        if len(starts) and patterns:
            h = span_hashes(buf, starts, ends)
            data = buf.tobytes()
            text_of = lambda a, b: b" ".join([data[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)])  # noqa: E731, B023
            cover = np.zeros(len(starts) + 1, dtype=np.int32)
            for p in patterns:
                at, which = p.search(h, first, text_of)
                np.add.at(cover, at - p.length + 1, 1)
                np.add.at(cover, at + 1, -1)
                for row, pattern in zip((np.searchsorted(first, at, side="right") - 1).tolist(), which.tolist(), strict=True):
                    found[row].add(p.tests.names[pattern])
            hit = np.cumsum(cover[:-1]) > 0
            if hit.any():
                edge = hit.copy()
                edge[1:] &= ~hit[:-1]
                inner = first[(first > 0) & (first < len(hit))]
                edge[inner] = hit[inner]
                last = hit.copy()
                last[:-1] &= ~hit[1:]
                last[inner - 1] = hit[inner - 1]
                for a, b in zip(np.flatnonzero(edge).tolist(), (np.flatnonzero(last) + 1).tolist(), strict=True):
                    row = int(np.searchsorted(first, a, side="right")) - 1
                    runs[row].append({"lo": a - int(first[row]), "hi": b - int(first[row])})
        for n, r, f in zip(np.diff(first).tolist(), runs, found, strict=True):
            yield n, r, sorted(f)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, *, name: str = "_found") -> DataFrame:
    """docs with the struct column `name`: n_words, hits (runs of hit words), items (ids as text).

    Null and empty texts have no words. Items of the same id are one item; a null id is the empty text. An
    empty benchmark hits nothing. All columns of docs pass through; the name must be free among them.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    parts = max(1, -(-size // broadcast_bytes))
    out = docs.withColumn(name, F.lit(None).cast(FOUND_TYPE))
    for part in range(parts):  # one, unless the tests are too many for one broadcast
        some = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        out = _scanned(out, spark.sparkContext.broadcast(compile_patterns([(r["item"], r["text"]) for r in some], window)), name)
    return out


def _scanned(docs: DataFrame, patterns, name: str) -> DataFrame:
    """docs with what these patterns find added to the column `name`."""
    text_at, found_at = docs.columns.index("text"), docs.columns.index(name)

    def run(batches):
        for batch in batches:
            found = []
            for (n, runs, items), old in zip(scan(batch.column(text_at), patterns.value), batch.column(found_at).to_pylist(), strict=True):
                if old:
                    runs, items = merged([*old["hits"], *runs]), sorted({*old["items"], *items})
                found.append({"n_words": n, "hits": runs, "items": items})
            columns = list(batch.columns)
            columns[found_at] = pa.array(found, batch.schema.field(found_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def merged(runs: list[dict]) -> list[dict]:
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["lo"]):
        if out and r["lo"] <= out[-1]["hi"]:
            out[-1] = {"lo": out[-1]["lo"], "hi": max(out[-1]["hi"], r["hi"])}
        else:
            out.append(r)
    return out


def n_hit(hits):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, x: acc + (x["hi"] - x["lo"]))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs; awkward rows fare as `search` says."""
    found = search(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window)
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        n_hit(F.col("_found.hits")).alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_found.items"), ","), 256).alias("items_sha256"),
        (F.size("_found.hits") > 0).alias("contaminated"),
    )
