"""N-gram Jaccard join (operator 6): T-occurrence search with DivideSkip over the documents that can meet.

1. Documents with equal shingle sets are one class from here on.
2. Two sets of Jaccard similarity t differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) shingles. If the
   shingles are dealt by hash to more than d parts, some part is the same in both. Documents send one key for
   each part, those of one key may meet, and the rest can't be similar: no link is lost. Keys only chain
   documents of one group together, never all pairs. Documents so connected form a neighbourhood.
   Shared passages chain documents that aren't similar, and the more the larger the input is, so a large
   neighbourhood is connected anew by the pairs whose sketches (parities of the shingles' buckets) differ in
   no more bits than similar sets could: a shingle that only one of two sets has changes one bit.
3. In each neighbourhood a T-occurrence search finds the links: for a query set, documents that occur in at
   least T of the inverted lists of its shingles. DivideSkip merges the short lists and looks up the long
   ones for the documents that the merge leaves. Small neighbourhoods are searched many to a task; large ones
   are cut into blocks, and each pair of blocks is a task. A pair already known to be connected isn't tested
   again, so a task returns a spanning forest and not all of its links.
4. Components of the links are the result.

Shingles are 64-bit hashes. Similarity is decided in whole numbers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import connected
from .texthash import BASE, FOLD, NOT_SPACE, U, chunks, mix, span_hashes, window_hashes, words

SHINGLE, PERCENT = 3, 90
#: Documents in one block of a large neighbourhood, and those that a task of small ones gets on average.
BLOCK = 1000
#: Sketches in one block of a large neighbourhood, and rows and bits of them that are compared at once.
SKETCH_BLOCK, TILE_ROWS, TILE_BITS = 4000, 500, 1024
#: Ratio of the largest to the smallest set size that share a number of parts.
RATIO = 1.5
#: DivideSkip's weight of a lookup against a merge.
MU = 0.0085
#: Shingles are counted in so many buckets; those of buckets above the mean by so many standard deviations, and by so many, are common.
BUCKET_BITS, COMMON_SIGMAS, COMMON_LEAST = 20, 10, 16


def shingle_sets(texts: pa.Array, n: int):
    """The sorted distinct shingle hashes of each text."""
    for _, _, raw, offsets in chunks(texts):
        buf = FOLD[raw]
        starts, ends, first = words(buf, offsets, NOT_SPACE)
        h = span_hashes(buf, starts, ends) if len(starts) else np.zeros(0, U)
        grams = window_hashes(h, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield window_hashes(h[a:b], b - a) ^ U(b - a)
            else:
                yield np.zeros(0, U)


def size_class(size: int) -> int:
    return int(math.log(size) / math.log(RATIO) + 1e-9)


def class_top(c: int) -> int:
    """The largest size of class c."""
    top = int(RATIO ** (c + 1)) + 2
    while size_class(top) > c:
        top -= 1
    return top


def parts_of(c: int, percent: int) -> tuple[int, int]:
    """(parts, empty parts that are left out) for pairs whose larger set is of class c."""
    top = class_top(c)
    differ = (100 - percent) * 2 * top // (100 + percent)
    if not differ:
        return 1, 0
    # of the parts that are the same in both, some may be empty in both; so many more parts are made
    expected = top / RATIO / (differ + 1)
    spare = math.ceil(3 + 3 * differ * math.exp(-expected))
    return differ + 1 + spare, spare


def part_keys(shingles: np.ndarray, percent: int, common_buckets: np.ndarray | None = None) -> np.ndarray:
    """Keys of which two sets of at least this similarity share one.

    Common shingles are left out of the parts: what is left of two sets differs no more than the sets do.
    """
    size = len(shingles)
    if not size:
        return np.zeros(0, U)
    if common_buckets is not None:
        shingles = shingles[~common_buckets[shingles >> U(64 - BUCKET_BITS)]]
    # the larger set of a pair is of one of these classes
    classes = range(size_class(size), size_class(100 * size // percent) + 1)
    out = []
    for c in classes:
        parts, spare = parts_of(c, percent)
        at = ((shingles >> U(32)) * U(parts)) >> U(32)  # in order, as the shingles are
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        keys = np.add.reduceat(mix(shingles), starts) if len(at) else np.zeros(0, U)
        out.append(mix(keys * U(BASE) + at[starts] * U(4096) + U(c)))
        if parts - len(starts) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=U), at[starts])
            out.append(mix(empty * U(4096) + U(c)))
    return np.unique(np.concatenate(out))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums by which equal sets are known."""
    if not len(shingles):
        return 0, 0
    return int(mix(shingles).sum(dtype=U).view(np.int64)), int(mix(shingles ^ U(BASE)).sum(dtype=U).view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """For each of at least 2n buckets, a power of two, whether an odd number of the n shingles is in it. Sketches of two lengths are compared at the shorter one, the longer one folded."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((mix(shingles) & U(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches at the length of the shortest, a row each."""
    width = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, width), axis=0) for s in sketches])


def close(sketches: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs between left and right whose sets could be similar by sizes and sketches; no similar pair is apart in it."""
    label, width, out = np.arange(len(size)), sketches.shape[1], []
    signs = lambda rows, at: np.unpackbits(sketches[rows, at : at + TILE_BITS // 8], axis=1).astype(np.float32) * 2 - 1
    for first in range(0, len(left), TILE_ROWS):
        rows = left[first : first + TILE_ROWS]
        product = np.zeros((len(rows), len(right)), np.float32)
        for at in range(0, width, TILE_BITS // 8):
            product += signs(rows, at) @ signs(right, at).T
        both = size[rows][:, None] + size[right]
        # similar sets share at least percent / (100 + percent) of both sizes, and differ in the rest
        hits = (8 * width - product) / 2 <= both - 2 * -(-percent * both // (100 + percent))
        for r, hit in zip(rows.tolist(), hits, strict=True):
            found = right[hit]
            roots, at = np.unique(label[found], return_index=True)
            for root, to in zip(roots.tolist(), found[at].tolist(), strict=True):
                if root != label[r]:
                    out.append((r, to))
                    label[label == root] = label[r]
    return out


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc, n, a, b, bits): the number of shingles of each document, the digest of their set and its sketch."""

    def run(batches):
        for batch in batches:
            size, a, b, bits = [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                x, y = digest(s)
                size.append(len(s))
                a.append(x)
                b.append(y)
                bits.append(sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (size, a, b)], pa.array(bits, pa.binary())], names=["doc", "n", "a", "b", "bits"])

    return docs.mapInArrow(run, "doc long, n long, a long, b long, bits binary")


def _common(docs: DataFrame, n: int) -> np.ndarray:
    """Buckets of shingles that stand in far more documents than a bucket does on average, such as those of passages that many share.

    Any such choice leaves the join exact; this one keeps shared passages from chaining documents that have
    nothing else in common. Counts are added up by parts; 2 ** BUCKET_BITS numbers come to the driver.
    """
    parts, each = 64, (1 << BUCKET_BITS) // 64

    def count(batches):
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(1), n):
                counts[s >> U(64 - BUCKET_BITS)] += 1
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([counts[p * each : (p + 1) * each].astype("<i4").tobytes() for p in range(parts)], pa.binary())], names=["part", "counts"])

    def add(key, batches):
        total = np.zeros(each, dtype=np.int64)
        for body in batches.column("counts"):
            total += np.frombuffer(body.as_py(), "<i4")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    rows = docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for r in rows:
        counts[r["part"] * each : (r["part"] + 1) * each] = np.frombuffer(r["counts"], "<i8")
    mean = counts.mean()
    return counts > mean + COMMON_SIGMAS * math.sqrt(mean) + COMMON_LEAST


def _keys(docs: DataFrame, n: int, percent: int, common_buckets) -> DataFrame:
    """(doc, key) rows; of documents with equal sets in a batch, only one sends its keys."""

    def run(batches):
        for batch in batches:
            seen, ids, keys = set(), [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    keys.append(part_keys(s, percent, common_buckets.value).view(np.int64))
                    ids.append(np.full(len(keys[-1]), doc))
            for at in range(0, len(ids), 256):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x[at : at + 256])) for x in (ids, keys)], names=["doc", "key"])

    return docs.mapInArrow(run, "doc long, key long")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


class Index:
    """Inverted lists of documents by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        holder = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.holder = holder[order]
        self.shingles, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))
        self.sets = sets

    def lists(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingles, starts, ends) of the query's lists, shortest first."""
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        there = self.shingles[at] == query
        at = at[there]
        at = at[np.argsort(self.ends[at] - self.starts[at], kind="stable")]
        return self.shingles[at], self.starts[at], self.ends[at]

    def merge(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, number of these lists that each is on), by a heap over the lists."""
        runs = [self.holder[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        docs: list[int] = []
        counts: list[int] = []
        for doc in heapq.merge(*[r.tolist() for r in runs]):
            if docs and docs[-1] == doc:
                counts[-1] += 1
            else:
                docs.append(doc)
                counts.append(1)
        return np.array(docs, np.int64), np.array(counts, np.int64)

    def search(self, query: np.ndarray, percent: int, known) -> list[int]:
        """Documents whose similarity to the query is at least percent; known(doc) tells which need no test."""
        shingles, starts, ends = self.lists(query)
        # whatever the partner's size, it holds at least so many of the query's shingles
        least = -(-percent * len(query) // 100)
        if len(shingles) < least:
            return []
        longest = int(ends[-1] - starts[-1])
        long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
        short = len(shingles) - long
        docs, counts = self.merge(starts[:short], ends[:short])
        out = []
        for doc, count in zip(docs[counts >= least - long].tolist(), counts[counts >= least - long].tolist(), strict=True):
            if known(doc):
                continue
            other = self.sets[doc]
            # similarity as a number of shared shingles: 100 * i >= percent * (|A| + |B| - i)
            needed = -(-percent * (len(query) + len(other)) // (100 + percent))
            if count + long < needed or len(other) > 100 * len(query) // percent:
                continue
            at = np.minimum(np.searchsorted(other, shingles[short:]), len(other) - 1)
            if count + int((other[at] == shingles[short:]).sum()) >= needed:
                out.append(doc)
                known(doc, True)
        return out


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within left, or, with right, of those between the two."""
    index = Index([sets[i] for i in left])
    forest = Forest(len(sets))
    out = []
    for q in left if right is None else right:

        def known(doc: int, join: bool = False, q=int(q)) -> bool:
            d = int(left[doc])
            if join:
                forest.join(q, d)
            return forest.root(q) == forest.root(d)

        out += [(int(q), int(left[doc])) for doc in index.search(sets[q], percent, known)]
    return out


def _cell(percent: int):
    """The class of set size n: similar sets are of one class or of neighbouring ones."""
    return F.floor(F.log("n") / math.log(max(100 / percent, 1.05)) + 1e-9).cast("int").alias("k")


def _cells(members: DataFrame, block: int) -> DataFrame:
    """(component, k, cuts, m): members of each neighbourhood and size class, and the blocks that they are cut into by hash."""
    return members.groupBy("component", "k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"), F.count(F.lit(1)).alias("m"))


def _blocks(large: DataFrame, cells: DataFrame, *more: str) -> DataFrame:
    """(doc, component, own, hood, i, j) and more columns: members of large neighbourhoods, a row for each pair of blocks that they are compared in."""
    code = lambda k, at: F.shiftleft(k.cast("long"), 32) + at
    near_cells = cells.select("component", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"), F.col("k").alias("other"), F.col("cuts").alias("other_cuts"))
    own = F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int")
    placed = large.join(cells.select("component", "k", "cuts"), ["component", "k"]).withColumn("own", code(F.col("k"), own)).join(near_cells, ["component", "k"])
    blocks = placed.select("doc", "component", "own", *more, F.explode(F.transform(F.sequence(F.lit(0), F.col("other_cuts") - 1), lambda x: code(F.col("other"), x))).alias("with"))
    return blocks.select("doc", "component", "own", *more, F.col("component").alias("hood"), F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))


def _tightened(near: DataFrame, seen: DataFrame, percent: int, block: int) -> DataFrame:
    """near (node, component) with neighbourhoods of more than block nodes connected anew, by the pairs in them that are close by their sketches."""
    large = near.join(near.groupBy("component").count().filter(F.col("count") > block).select("component"), "component")
    if large.isEmpty():
        return near
    # rows of one id with other sets count as that id, as they do when the texts are searched
    rows = common.stage(seen.filter("n > 0").join(large.select(F.col("node").alias("doc"), "component"), "doc").select("doc", "component", "n", "bits", _cell(percent)), "sketches")

    def compare(key, table):
        doc, size, own = (table.column(c).to_numpy() for c in ("doc", "n", "own"))
        _, i, j = (k.as_py() for k in key)
        found = close(folded(table.column("bits").to_pylist()), size, np.flatnonzero(own == i), np.flatnonzero(own == j), percent) if (own == i).any() and (own == j).any() else []
        return pa.table({"a": pa.array([int(doc[x]) for x, _ in found], pa.int64()), "b": pa.array([int(doc[y]) for _, y in found], pa.int64())})

    edges = _blocks(rows, _cells(rows, SKETCH_BLOCK), "n", "bits").groupBy("hood", "i", "j").applyInArrow(compare, "a long, b long")
    out = common.stage(near.join(large.select("node"), "node", "left_anti").unionByName(connected(edges)), "neighbourhoods")
    common.unstage(rows)
    common.unstage(near)
    return out


def components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc, n_shingles, component) for each row of docs (doc_id, text); doc and component have LAST_ID for null."""
    named = docs.select(F.coalesce(F.col("doc_id"), F.lit(common.LAST_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    seen = common.stage(_sets(named, n), "shingle-sets")
    reps = common.stage(seen.filter("n > 0").groupBy("a", "b", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("times")), "shingle-classes")
    with_sets = reps.agg(F.sum("times")).first()[0] or 0
    of = common.stage(common.join_counted(seen.filter("n > 0"), reps, ["a", "b", "n"], "times", with_sets).select("doc", "rep", "n"), "shingle-members")
    # 2. chains through the documents of each key, between the classes that they belong to
    common_buckets = docs.sparkSession.sparkContext.broadcast(_common(named, n))  # 2 ** BUCKET_BITS truth values
    by_key = _keys(named, n, percent, common_buckets).select(F.col("doc").alias("y"), F.lag("doc").over(W.partitionBy("key").orderBy("doc")).alias("x"))
    chained = common.stage(by_key.filter("x IS NOT NULL AND x != y").distinct(), "chains")
    common.release(docs.sparkSession)
    edges = chained.join(of.select(F.col("doc").alias("x"), F.col("rep").alias("a")), "x").join(of.select(F.col("doc").alias("y"), F.col("rep").alias("b")), "y").select("a", "b")
    near = common.stage(connected(edges), "neighbourhoods")
    common.unstage(chained)
    near = _tightened(near, seen, percent, block)
    total = near.count()
    tasks = max(1, -(-total // block))
    # a large neighbourhood is cut into blocks by set size, and then by hash
    members = near.join(reps.select(F.col("rep").alias("node"), _cell(percent)).distinct(), "node").withColumnRenamed("node", "doc")
    cells = _cells(members, block)
    sizes = cells.groupBy("component").agg(F.sum("m").alias("size"))
    small = members.join(sizes, "component").filter(F.col("size") <= block)
    bins = small.select("doc", "component", F.lit(0).cast("long").alias("own"), F.lit(-1).cast("long").alias("hood"), F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("i"), F.lit(-1).cast("long").alias("j"))
    blocks = _blocks(members.join(sizes, "component").filter(F.col("size") > block), cells)
    dealt = common.stage(bins.unionByName(blocks), "dealt")
    common.release(docs.sparkSession)  # the keys' shuffle files go before the texts' come
    # a class is represented by one document of its smallest id; repeated rows with that id and other sets are told apart by the set
    # the same join at every size; one that is broadcast for small inputs only would hide what large ones cost
    texts = named.join(dealt.hint("merge"), "doc")

    def search(key, table):
        pieces = list(shingle_sets(table.column("text").combine_chunks(), n))
        doc, hood, own_block = (table.column(c).to_numpy() for c in ("doc", "component", "own"))
        kept = [i for i, s in enumerate(pieces) if len(s)]
        found = []
        _, i, j = (k.as_py() for k in key)
        if j < 0 or i == j:
            by_hood: dict = {}
            for k in kept:
                by_hood.setdefault(hood[k], []).append(k)
            for members in by_hood.values():
                found += links(pieces, np.array(members), None, percent)
        else:
            left, right = [k for k in kept if own_block[k] == i], [k for k in kept if own_block[k] == j]
            if left and right:
                found += links(pieces, np.array(left), np.array(right), percent)
        return pa.table({"a": pa.array([int(doc[x]) for x, _ in found], pa.int64()), "b": pa.array([int(doc[y]) for _, y in found], pa.int64())})

    found = texts.groupBy("hood", "i", "j").applyInArrow(search, "a long, b long")
    # documents of a class are linked too, and so are repeated rows of one id
    same = of.filter("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    joined = connected(found.unionByName(same))
    return seen.join(joined, seen["doc"] == joined["node"], "left").select("doc", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component"))


def report(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents without words, null texts among them, have no shingles and are linked with nothing. Rows of one
    id are one node: links of any of them hold for the id. A null id is a node of its own that sorts last; its
    component_id is null unless it is linked to another document. An empty table gives no rows.
    """
    id_of = lambda c: F.nullif(F.col(c), F.lit(common.LAST_ID))
    return components(docs.select("doc_id", "text"), n, percent).select(id_of("doc").alias("doc_id"), "n_shingles", id_of("component").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that of the smallest id, and every row of it. Rows with a null id stay unless they are linked to an id."""
    found, doc = components(docs.select("doc_id", "text"), n, percent), common.free_name(docs, "doc")
    gone = found.filter("doc != component").select(F.col("doc").alias(doc)).distinct()
    named = docs.withColumn(doc, F.coalesce(F.col("doc_id"), F.lit(common.LAST_ID)))
    return named.join(gone, doc, "left_anti").select(*docs.columns)
