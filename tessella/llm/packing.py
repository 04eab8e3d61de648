"""Best-fit packing (operator 9): best-two-fit over the histogram of piece lengths.

Which sequence a piece goes to depends on its length alone, so the packing is worked out on the number of
pieces of each length (at most 2048 numbers, whatever the input) and the pieces then take their places by
their rank among those of their length. Bins are filled greedily, largest piece that fits first; then a
bin's smallest piece is exchanged for two unpacked ones that fit its gap more tightly. A pattern of lengths
is used as often as the pieces last, so the number of patterns is bounded by the number of lengths.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import common

CAPACITY = 2048
#: The id 0 after each document.
END_OF_DOCUMENT = b"\0\0\0\0"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The pre-tokenizer that public_tokenizers.PATTERN spells out.
BYTE_LEVEL = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}


def byte_of_sign() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}


def ranks_decide(path: str) -> bool:
    """Whether merging by the rank of what a pair makes, as tiktoken does, gives the ids of the file's own merges for every text.

    It does if ranks rise with the order of the merges, and if each token's characters, merged by rank alone, come
    to the token by the very pair that its merge names. A text whose merges went another way would hold a stretch
    on whose borders nothing has been merged, that is one token by rank and not by the file: that stretch alone
    would differ too, and all of them have been looked at.
    """
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, before = d["model"], d.get("pre_tokenizer") or {}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or d.get("normalizer") or any(before.get(k) != v for k, v in BYTE_LEVEL.items()):
        return False
    vocabulary, made = model["vocab"], {}
    for m in model["merges"]:
        left, right = m if isinstance(m, list) else m.split(" ")
        made.setdefault(left + right, (left, right))
    ids = [vocabulary[x] for x in made]
    if len(made) != len(model["merges"]) or ids != sorted(ids):
        return False
    for token in vocabulary:
        if len(token) == 1 or token not in made:
            if len(token) > 1 and all(c in byte_of_sign() for c in token):
                return False  # a token that no merge makes
            continue
        parts, pair = list(token), None
        while len(parts) > 1:
            rank, at = min((vocabulary.get(x + y, len(vocabulary)), k) for k, (x, y) in enumerate(itertools.pairwise(parts)))
            if rank == len(vocabulary):
                return False
            pair = (parts[at], parts[at + 1])
            parts[at : at + 2] = ["".join(pair)]
        if pair != made[token]:
            return False
    return True


class Encoder:
    """Ids of whole texts under a byte-level BPE vocabulary in the tokenizers format.

    Where ranks_decide, and a probe gives the same ids, tiktoken does the work several times as fast; else tokenizers does all of it.
    """

    PROBE = "It's 12 o'clock,  \t\n été ß日本語 -- x_y  \u00a0z \U0001f600 don't <|endoftext|> \r\n\n end "

    def __init__(self, path: str, by_rank: bool | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.same = ranks_decide(path) if by_rank is None else by_rank
        if self.same:
            with open(path, encoding="utf-8") as f:
                vocabulary = json.load(f)["model"]["vocab"]
            shown = byte_of_sign()
            ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if all(c in shown for c in token)}
            special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
            ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in special}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.same = self.fast.encode_ordinary(self.PROBE) == self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers, with id 0 after them; a null is an empty text."""
        for text in texts:
            ids = self.fast.encode_ordinary(text or "") if self.same else self.tokenizer.encode(text or "", add_special_tokens=False).ids
            yield np.array(ids, dtype="<u4").tobytes() + END_OF_DOCUMENT


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32): one piece, or full ones after a first piece of what is left over."""
    n = len(ids) // 4
    ends = range(n % capacity or min(n, capacity), n + 1, capacity) if n > capacity else [n]
    start = 0
    for k, end in enumerate(ends):
        yield k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        start = end


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document; the file is looked into once, on the driver, to tell how ids may be made."""
    by_rank = ranks_decide(tokenizer)

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer, by_rank)
        encoder = _encoders[tokenizer]
        for batch in batches:
            # a few hundred texts at a time, so that the ids of a batch are never all held at once
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                doc_ids, cols = part.column(0).to_pylist(), [[], [], [], [], []]
                for doc_id, ids in zip(doc_ids, encoder.encode(part.column(1).to_pylist()), strict=True):
                    for row in cut_pieces(ids, capacity):
                        for col, v in zip(cols, (doc_id, *row), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(times, lengths)]: how often a sequence of these lengths, in this order, is used. Every piece is used once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    size = np.arange(capacity + 1)

    def largest(within: int) -> int:
        """The largest length left that is at most `within`, or 0."""
        there = np.flatnonzero(left[: max(within, 0) + 1])
        return int(there[-1]) if len(there) else 0

    while (first := largest(capacity)) > 0:
        held, gap = [], capacity
        while (x := first if not held else largest(gap)) > 0:
            held.append(x)
            left[x] -= 1
            gap -= x
        if gap > 0 and len(held) > 1:
            small = held[-1]
            room = gap + small
            # for each length a that is left, the largest b that is left beside it
            below = np.maximum.accumulate(np.where(left[: room + 1] > 0, size[: room + 1], 0))
            a = np.flatnonzero(left[: room + 1])
            b = below[room - a]
            twin = (b == a) & (left[a] < 2)
            if twin.any():
                less = np.array([below[x - 1] if x else 0 for x in b[twin]])
                b[twin] = less
            both = np.where(b > 0, a + b, 0)
            if len(both) and both.max() > small:
                k = int(both.argmax())
                held[-1:] = [int(max(a[k], b[k])), int(min(a[k], b[k]))]
                left[small] += 1
                left[held[-1]] -= 1
                left[held[-2]] -= 1
        used, of = np.unique(held, return_counts=True)
        more = int((left[used] // of).min())  # the same choices are made again while these lengths last
        left[used] -= more * of
        out.append((1 + more, held))
    return out


def places(chosen: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset): where the pieces of each length go, by rank."""
    out, used, sequence = [], {}, 0
    for times, held in chosen:
        at = 0
        for length in held:
            start = used.get(length, 0)
            out.append((length, start, start + times, sequence, at))
            used[length] = start + times
            at += length
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds only the end id. A null doc_id stays null. Repeated rows are
    packed as often as they stand there. An empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    cut = common.stage(pieces(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    where: dict[int, list] = {}
    for length, *rest in places(plan(counts, capacity)):
        where.setdefault(length, []).append(tuple(rest))
    schema = T.StructType.fromDDL("length long, _where array<struct<lo: long, hi: long, sequence: long, at: long>>")
    spots = F.broadcast(spark.createDataFrame(list(where.items()), schema))  # bounded: one row a length, and each pattern uses up a length
    ranked = common.number_slots(cut, "length", ["doc_id", "piece", "ids_crc32", "_row"], "_rank")
    spot = F.get(F.filter("_where", lambda x: (F.col("_rank") >= x["lo"]) & (F.col("_rank") < x["hi"])), F.lit(0))
    return (
        ranked.join(spots, "length")
        .withColumn("_spot", spot)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_spot.sequence") + F.col("_rank") - F.col("_spot.lo")).alias("sequence_id"), F.col("_spot.at").alias("offset"))
    )
