"""Suffix-array dedup (operator 2): a radix sort of suffixes that goes no deeper than the threshold.

A suffix counts only through its first DEPTH bytes, and equal groups after the last pass are exactly the
repeated windows. Most suffixes are unlike all others, so the first pass, by most significant digit, is made
to drop nearly all of them cheaply:

* Each window of DEPTH bytes has one anchor, the leftmost of its GRAM-byte strings whose hash is smallest.
  Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so there are
  some thirteen times fewer anchors than windows.
* Pass 1 takes an anchor's hash as the digit. Blocks of documents send each bucket their distinct hashes; the
  bucket answers with one bit for each: does it occur in another document? Windows whose anchor doesn't are
  settled.
* The rest go to the buckets as stretches of text around their anchors, each distinct one once a block. There
  the windows are ordered by eight bytes at a time, most significant first; windows that have become alone
  in their group drop out after each pass. A bucket answers with one bit a window: does it start in a
  document of smaller id?

A block sends a hash or stretch once, however many of its documents hold it, so a passage that a third of all
documents share is as many entries as there are blocks. Blocks and buckets grow in number with the input and
not in size. A block sends a bucket all its entries as one message, and none where it has none: there are never
more messages than entries, which grow in proportion to the input (some 0.07 a byte), and while there are fewer
blocks than entries in a block, messages only save headers. Hashes only rule windows out or send them to one
bucket; which stretches and windows are equal is decided by the radix passes over their bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .texthash import BASE, CHUNK_BYTES, U, chunks, mix

DEPTH = 50
GRAM = 24
#: Windows that one anchor can have.
SPREAD = DEPTH - GRAM + 1
#: Bytes of a hash that are sent.
DIGIT = 6
BLOCK_BYTES = 8 << 20

MESSAGE = "bucket long, block long, body binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A mixed hash, never all ones, of each GRAM bytes, by doubling."""
    h, have, base = buf.astype(U) + U(1), 1, U(BASE)
    parts, at = None, 0
    for bit in range(GRAM.bit_length()):
        if GRAM >> bit & 1:
            n = len(buf) - GRAM + 1
            piece = h[at : at + n]
            parts = piece.copy() if parts is None else parts * base + piece
            at += have
        if GRAM >> (bit + 1):
            with np.errstate(over="ignore"):
                h = h[:-have] * base + h[have:]
                base = U(int(base) * int(base) & (2**64 - 1))
            have *= 2
    return mix(parts) >> U(1)


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, number of windows) of the anchors of all documents in buf, by document and place."""
    none = np.zeros(0, dtype=np.int64)
    if len(buf) < DEPTH:
        return none, none.astype(U), none, none
    h = gram_hashes(buf)
    # the smallest of SPREAD neighbours, from smallest of 2, 4, 8 and so on
    least, have = h, 1
    while have * 2 <= SPREAD:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = SPREAD - have
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    n = len(buf) - DEPTH + 1
    least = least[:n]
    # windows that lie within one document
    valid = np.zeros(n, dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[a : max(a, b - DEPTH + 1)] = True
    open_ = np.flatnonzero(valid)
    if not len(open_):
        return none, none.astype(U), none, none
    # a window's anchor: the next place at or after its start that has its smallest hash. Neighbours of one smallest hash
    # share the first one's until they have passed it; then theirs is another equal hash
    smallest, gap = least[open_], np.diff(open_) != 1
    first = np.ones(len(open_), dtype=bool)
    first[1:] = (smallest[1:] != smallest[:-1]) | gap
    at = np.flatnonzero(first)
    heads = open_[at]
    entered = np.zeros(len(at), dtype=bool)  # a smaller hash than all before came in at the end of the window
    entered[1:] = (smallest[at[1:]] < smallest[at[1:] - 1]) & ~gap[at[1:] - 1]
    of_head = np.where(entered, heads + SPREAD - 1, -1)
    of_head[~entered] = _seek(h, least, heads[~entered])
    place = np.repeat(of_head, np.diff(np.append(at, len(open_))))
    while len(late := np.flatnonzero(place < open_)):
        place[late] = _seek(h, least, open_[late])
    change = np.ones(len(open_), dtype=bool)
    change[1:] = (place[1:] != place[:-1]) | gap
    at = np.flatnonzero(change)
    return place[at], h[place[at]], open_[at], np.diff(np.append(at, len(open_)))


def anchors_in_steps(buf: np.ndarray, offsets: np.ndarray, step: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As anchors; a text that is longer than a chunk is gone through in steps that overlap by a window, so that memory doesn't grow with it. A window's anchor depends on the window alone."""
    if len(buf) <= step or len(offsets) != 2:
        return anchors(buf, offsets)
    parts = []
    for at in range(0, len(buf) - DEPTH + 1, step):
        piece = buf[at : at + step + DEPTH - 1]
        place, h, first, count = anchors(piece, np.array([0, len(piece)]))
        parts.append((place + at, h, first + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _seek(h: np.ndarray, least: np.ndarray, windows: np.ndarray) -> np.ndarray:
    out = np.full(len(windows), -1, dtype=np.int64)
    todo = np.arange(len(windows))
    for k in range(SPREAD):
        same = h[windows[todo] + k] == least[windows[todo]]
        out[todo[same]] = windows[todo[same]] + k
        todo = todo[~same]
        if not len(todo):
            break
    return out


class Block:
    """A block's documents, by id, and its anchors in an order that depends on them alone."""

    def __init__(self, table: pa.Table, buckets: int):
        ids = table.column("doc_id").combine_chunks()
        order_by = ids.fill_null(common.LAST_ID).to_numpy(zero_copy_only=False)
        texts = table.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
        digest = np.array([hashlib.md5(x.as_py()).digest()[:8] for x in texts], dtype="S8") if len(np.unique(order_by)) < len(order_by) else np.zeros(len(order_by), "S8")
        order = np.lexsort((digest, order_by))
        self.null = ids.is_null().to_numpy(zero_copy_only=False)[order]
        self.ids, self.texts = order_by[order], texts.take(pa.array(order))
        cols = []
        self.bufs = []
        for lo, hi, buf, offsets in chunks(self.texts):
            place, h, first, count = anchors_in_steps(buf, offsets)
            doc = np.searchsorted(offsets, place, side="right") - 1
            # of empty documents at one offset, the last holds the bytes
            cols.append((np.full(len(place), len(self.bufs)), doc + lo, place, h, first, count, first - offsets[doc]))
            self.bufs.append(buf)
        chunk, doc, place, h, first, count, within = (np.concatenate(c) if cols else np.zeros(0, np.int64) for c in zip(*cols, strict=True)) if cols else [np.zeros(0, np.int64)] * 7
        self.chunk, self.doc, self.place, self.hash, self.first, self.count, self.within = chunk, doc, place, h.astype(U), first, count, within
        self.buckets = buckets

    @cached_property
    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes by bucket, their buckets, index of each anchor's hash, whether two documents of the block have it)."""
        key = self.hash >> U(63 - 8 * DIGIT)
        distinct, back = np.unique(key, return_inverse=True)
        bucket = (mix(distinct) % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        index = rank[back]
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), -1)
        np.minimum.at(low, index, self.ids[self.doc])
        np.maximum.at(high, index, self.ids[self.doc])
        return distinct[order], bucket[order], index, low < high

    def stretches(self, shared: np.ndarray) -> tuple:
        """Distinct stretches whose anchors are shared.

        Returns (records, owner, bucket, members, of): padded records by bucket; the first document that has
        each; its bucket; the anchors concerned and the record of each.
        """
        distinct, bucket, index, several = self.digits
        members = np.flatnonzero((shared | several)[index])
        width = SPREAD + DEPTH - 1
        rec = np.zeros((len(members), DIGIT + 2 + width), dtype=np.uint8)
        key = distinct[index[members]]
        rec[:, :DIGIT] = key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGIT :]
        rec[:, DIGIT] = self.place[members] - self.first[members]
        rec[:, DIGIT + 1] = self.count[members]
        for c, buf in enumerate(self.bufs):
            mine = np.flatnonzero(self.chunk[members] == c)
            if not len(mine):
                continue
            m = members[mine]
            size = self.count[m] + DEPTH - 1
            at = self.first[m][:, None] + np.arange(width)[None, :]
            inside = np.arange(width)[None, :] < size[:, None]
            rec[mine, DIGIT + 2 :] = np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0)
        order, of = equal_rows(rec, bucket[index[members]])
        keep = order[np.unique(of[order], return_index=True)[1]]
        owner = np.full(len(keep), np.iinfo(np.int64).max)
        np.minimum.at(owner, of, self.ids[self.doc[members]])
        return rec[keep], owner, bucket[index[members[keep]]], members, of


def equal_rows(records: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by group, number of each row's kind in that order): rows are of one kind if radix passes over all of their bytes leave them together. Equal rows must be of one group."""
    n = len(records)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = msd_groups(records)
    alone = kind < 0
    kind[alone] = n + np.flatnonzero(alone)
    order = np.argsort(kind if group is None else group * (2 * n) + kind, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = kind[order[1:]] != kind[order[:-1]]
    kind[order] = np.cumsum(new) - 1
    return order, kind


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first entry, end) for entries in order of their buckets."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
        if hi > lo:
            yield int(bucket[lo]), lo, hi


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "body": pa.array([r[2] for r in rows], pa.binary())})


def msd_groups(windows: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the groups of equal rows of windows (bytes) that start in the same group; -1 for a window alone.

    Most significant digits first, eight bytes a pass; a window that is alone after a pass is not looked at again,
    and groups that a pass doesn't split are not sorted again.
    """
    out = np.full(len(windows), -1, dtype=np.int64)
    width = -(-windows.shape[1] // 8) * 8
    padded = windows
    if width != windows.shape[1]:
        padded = np.zeros((len(windows), width), dtype=np.uint8)
        padded[:, : windows.shape[1]] = windows
    digits = np.ascontiguousarray(padded).view(">u8")
    first = digits[:, 0].astype(U)
    live = np.argsort(first, kind="stable") if group is None else np.lexsort((first, group))
    group = np.zeros(len(live), np.int64) if group is None else group[live]
    digit = first[live]
    for k in range(digits.shape[1]):
        if not len(live):
            return out
        same = group[1:] == group[:-1]
        if k:
            digit = digits[live, k].astype(U)
            split = np.flatnonzero(same & (digit[1:] != digit[:-1]))
            if not len(split):
                continue
            torn = np.zeros(group[-1] + 1, dtype=bool)
            torn[group[split]] = True
            rows = np.flatnonzero(torn[group])  # of a group all or none, so they can be sorted in their places
            order = rows[np.lexsort((digit[rows], group[rows]))]
            live[rows], digit[rows] = live[order], digit[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = ~same | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        live, group = live[several], number[several]
    out[live] = group
    return out


def earlier(records: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each record a bit mask of its windows that start in a document of smaller id than its owner."""
    n = len(records)
    mask = np.zeros(n, dtype=U)
    if not n:
        return mask
    _, same = equal_rows(records)
    least = np.full(same.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, owner)
    count = records[:, DIGIT + 1].astype(np.int64)
    full = (U(1) << count.astype(U)) - U(1)
    mask[owner > least[same]] = full[owner > least[same]]
    # one record of each kind stands for its windows, under its smallest owner
    one = np.full(len(least), -1)
    one[same[::-1]] = np.arange(n)[::-1]
    _, digit = equal_rows(records[one][:, :DIGIT])
    alone = np.bincount(digit)[digit] == 1
    one, digit = one[~alone], digit[~alone]
    if not len(one):
        return mask
    windows_of = count[one]
    rec = np.repeat(np.arange(len(one)), windows_of)
    nth = np.arange(len(rec)) - np.repeat(np.cumsum(windows_of) - windows_of, windows_of)
    to_anchor = records[one, DIGIT].astype(np.int64)[rec] - nth
    smaller = np.zeros(len(rec), dtype=bool)
    step = 200_000  # by whole groups of one digit and place, so that memory is bounded
    order = np.lexsort((to_anchor, digit[rec]))
    start = digit[rec][order] * 256 + to_anchor[order]
    edges = np.flatnonzero(np.diff(start)) + 1
    lo = 0
    while lo < len(order):
        hi = len(order) if lo + step >= len(order) else int(edges[min(np.searchsorted(edges, lo + step), len(edges) - 1)]) if len(edges) and edges[-1] > lo + step else len(order)
        some = order[lo:hi]
        r = one[rec[some]]
        windows = records[r[:, None], (DIGIT + 2 + nth[some])[:, None] + np.arange(DEPTH)[None, :]]
        group = msd_groups(windows, start[lo:hi])
        grouped = group >= 0
        if grouped.any():
            low = np.full(group.max() + 1, np.iinfo(np.int64).max)
            kind_owner = least[same[r]]
            np.minimum.at(low, group[grouped], kind_owner[grouped])
            smaller[some[grouped]] = low[group[grouped]] < kind_owner[grouped]
        lo = hi
    add = np.zeros(len(one), dtype=U)
    np.bitwise_or.at(add, rec[smaller], U(1) << nth[smaller].astype(U))
    of_kind = np.zeros(len(least), dtype=U)
    of_kind[same[one]] = add
    return mask | of_kind[same]


def replies(table: pa.Table, rounds: str) -> dict[int, bytes]:
    kinds, buckets, bodies = (table.column(c).to_pylist() for c in ("kind", "bucket", "body"))
    return {b: body for k, b, body in zip(kinds, buckets, bodies, strict=True) if k == rounds}


def answered(block: Block, table: pa.Table) -> np.ndarray:
    """Which of the block's distinct hashes other documents have, from the buckets' replies."""
    distinct, bucket, _, _ = block.digits
    told = replies(table, "digits")
    shared = np.zeros(len(distinct), dtype=bool)
    for b, lo, hi in by_bucket(bucket):
        shared[lo:hi] = unbits(told[b], hi - lo)
    return shared


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. A null doc_id sorts after all others. Documents of equal id are not earlier than
    each other, so repeated rows remove nothing from one another. Documents under DEPTH bytes lose nothing.
    Other columns of docs are not read. An empty table gives no rows.
    """
    import zstandard

    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    sized = docs.select("doc_id", text.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    blocks = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)))
    squeeze, stretch = zstandard.compress, zstandard.decompress

    def send_digits(key, table):
        distinct, bucket, _, several = Block(table, n).digits
        low = distinct.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGIT :]
        return messages([(b, key[0].as_py(), low[lo:hi].tobytes()) for b, lo, hi in by_bucket(bucket)])

    def meet_digits(key, table):
        parts = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, DIGIT) for x in table.column("body")]
        whole = np.zeros((sum(map(len, parts)), 8), dtype=np.uint8)
        whole[:, 8 - DIGIT :] = np.concatenate(parts)
        key_of = whole.view(">u8").ravel().astype(U)
        order = np.argsort(key_of, kind="stable")
        same = np.zeros(len(order) + 1, dtype=bool)
        same[1:-1] = key_of[order][1:] == key_of[order][:-1]
        shared = np.empty(len(order), dtype=bool)
        shared[order] = same[:-1] | same[1:]
        at = np.cumsum([0, *map(len, parts)])
        return messages([(key[0].as_py(), b, bits(shared[lo:hi])) for b, lo, hi in zip(table.column("block").to_pylist(), at[:-1], at[1:], strict=True)])

    def send_stretches(key, left, right):
        block = Block(left, n)
        records, owner, bucket, _, _ = block.stretches(answered(block, right))
        return messages([(b, key[0].as_py(), squeeze(owner[lo:hi].astype("<i8").tobytes() + records[lo:hi].tobytes(), 1)) for b, lo, hi in by_bucket(bucket)])

    def meet_stretches(key, table):
        wide = DIGIT + 2 + SPREAD + DEPTH - 1
        owners, records = [], []
        for x in table.column("body"):
            body = stretch(x.as_py())
            k = len(body) // (8 + wide)
            owners.append(np.frombuffer(body, "<i8", k))
            records.append(np.frombuffer(body, np.uint8, offset=8 * k).reshape(k, wide))
        masks = earlier(np.concatenate(records), np.concatenate(owners))
        at = np.cumsum([0, *map(len, owners)])
        return messages([(key[0].as_py(), b, squeeze(masks[lo:hi].astype("<u8").tobytes(), 1)) for b, lo, hi in zip(table.column("block").to_pylist(), at[:-1], at[1:], strict=True)])

    def remove(key, left, right):
        block = Block(left, n)
        _, owner, bucket, members, of = block.stretches(answered(block, right))
        told = replies(right, "stretches")
        masks = np.zeros(len(owner), dtype=U)
        for b, lo, hi in by_bucket(bucket):
            masks[lo:hi] = np.frombuffer(stretch(told[b]), "<u8")
        count = block.count[members]
        full = (U(1) << count.astype(U)) - U(1)
        mask = np.where(block.ids[block.doc[members]] > owner[of], full, masks[of]) if len(members) else np.zeros(0, U)
        hit = np.flatnonzero(mask)
        doc, within, mask, count = block.doc[members[hit]], block.within[members[hit]], mask[hit], count[hit]
        edges = np.searchsorted(doc, np.arange(len(block.ids) + 1))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for d, text in enumerate(block.texts):
            data = text.as_py()
            lo, hi = edges[d], edges[d + 1]
            removed = spans = 0
            if hi > lo:
                cover = np.zeros(len(data) + 1, dtype=np.int32)
                flags = (mask[lo:hi, None] >> np.arange(SPREAD, dtype=U)[None, :]) & U(1) == 1
                starts = (within[lo:hi, None] + np.arange(SPREAD)[None, :])[flags]
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + DEPTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            else:
                kept = data
            for name, v in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                out[name].append(v)
        return pa.table({"doc_id": pa.array(block.ids, pa.int64(), mask=block.null), **{k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}})

    tagged = lambda df, kind: df.withColumn("kind", F.lit(kind))
    # for replies, "bucket" is the bucket that answers and "block" the block asked for
    digits = tagged(blocks.groupBy("block").applyInArrow(send_digits, MESSAGE).groupBy("bucket").applyInArrow(meet_digits, MESSAGE), "digits")
    asked = blocks.groupBy("block").cogroup(digits.groupBy("block")).applyInArrow(send_stretches, MESSAGE)
    stretches = tagged(asked.groupBy("bucket").applyInArrow(meet_stretches, MESSAGE), "stretches")
    return blocks.groupBy("block").cogroup(digits.unionByName(stretches).groupBy("block")).applyInArrow(remove, OUT)


report = dedup
