"""Line dedup (operator 5): a deletion-neighbourhood join over the words of lines.

A line is dropped if an equal line, of any length, stands earlier: in a document of smaller id, or further up in
the same one. A line of five words or more is also dropped if another such line at most one word edit away (a
word put in, left out or exchanged, so four words in five agree at least) stands earlier; in shorter lines one
edit would leave less than 0.8 alike. Words are what stands between single spaces, once spaces at the ends are
cut off; what is empty then is no line that counts.

1. Equal lines meet by their digest; only distinct lines go on.
2. Of two lines one edit apart, the first or the last half of the longer one's words, less one, is untouched.
   So only lines that share such a half with another line go on. This loses no pair.
3. Those emit all their variants as hashed keys: the line, the line without each word, and, for exchanged
   words, the line without each word together with that word's place. Lines meet under equal keys. No pairs
   within a group are made: each line asks for the earliest line under each of its keys.
4. The words of a line and its earliest partner are compared, and the later line goes.

Every step is a DataFrame operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

#: Words from which lines one edit apart are near.
MIN_WORDS = 5
#: Bits a line of step 3, and at most, of the filter that lets lines through to the join with those; 64 to a broadcast row, so at most 2 ** 20 rows.
FILTER_BITS_A_LINE, FILTER_BITS_MOST = 16, 1 << 26


def n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


#: Half keys of a line: (column, label of two, first or last words, bit). Lines one edit apart share a label, and one of its keys.
HALVES = [("k1", 0, 1, 1), ("k2", 0, -1, 2), ("k3", 1, 1, 4), ("k4", 1, -1, 8)]


def _label(n: Column, which: int) -> Column:
    """n // 2 or (n + 1) // 2: two lengths that differ by one at most have one of them in common. The key takes one word less."""
    return F.floor((n + which) / 2).cast("int")


def half_keys(line: Column, n: Column) -> dict[str, Column]:
    out = {}
    for name, which, side, _ in HALVES:
        label = _label(n, which)
        key = F.when(n >= MIN_WORDS, F.xxhash64(label, F.lit(side), F.call_function("substring_index", line, F.lit(" "), (label - 1) * side)))
        out[name] = key if not which else F.when(n % 2 == 1, key)  # for even n the labels are one
    return out


def _place(id_: str, t: str, no: str) -> Column:
    """A line's place in the order of documents and lines as one number, which aggregates without sorting; of texts of one id, the order is by eight digits of their hash."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (wide(F.col(id_)) * wide(F.lit(10**18)) + (F.pmod(F.col(t), F.lit(10**8)) * F.lit(10**10) + F.col(no)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _exploded(docs: DataFrame) -> DataFrame:
    """(id, t, no, line, n) for lines that count, where (id, t) names a document: repeated rows are named alike."""
    text = F.col("text").cast("string")
    named = docs.select(F.coalesce(F.col("doc_id"), F.lit(common.LAST_ID)).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return named.withColumn("line", F.trim("line")).withColumn("n", n_words(F.col("line"))).filter(F.col("line") != "")


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _xor_before(values: Column) -> Column:
    """For each entry the XOR of those before it; by groups of a square root's size, so long lines don't take quadratic time."""

    def of(v: Column) -> Column:
        def with_size(size: Column) -> Column:
            groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda g: _xor(F.slice(v, g * size + 1, size)))
            return let(groups, lambda gs: F.transform(v, lambda x, i: let(F.floor(i / size).cast("int"), lambda g: _xor(F.slice(gs, F.lit(1), g)).bitwiseXOR(_xor(F.slice(v, g * size + 1, i - g * size))))))

        return let(F.ceil(F.sqrt(F.size(v))).cast("int"), with_size)

    return let(values, of)


def variants(near: DataFrame) -> DataFrame:
    """(key, kind, ln): variants of the lines in near, as hashed keys. kind: 0 without a word, with its place; 1 without a word; 2 the whole line.

    A word goes only if it lies outside of some half that the line shares with another.
    """
    n = F.col("n")
    inside = [(name, which, side, bit) for name, which, side, bit in HALVES]

    def open_at(at: Column) -> Column:
        out = F.lit(False)
        for _, which, side, bit in inside:
            has = F.col("flags").bitwiseAND(bit) > 0
            half = _label(n, which) - 1
            out = out | (has & ((at >= half) if side == 1 else (at < n - half)))
        return out

    def of(f: Column, moved: Column, to: Column, to_moved: Column) -> Column:
        entry = lambda kind, *key: F.struct(F.xxhash64(F.lit(int(kind > 0)), *key).alias("key"), F.lit(kind).cast("byte").alias("kind"))

        def at(i: Column, total: Column, total_moved: Column) -> Column:
            without = F.get(to, i).bitwiseXOR(total_moved).bitwiseXOR(F.get(to_moved, i)).bitwiseXOR(F.get(moved, i))
            return F.array(entry(0, total.bitwiseXOR(F.get(f, i)), n, i), entry(1, without, n - 1))

        def body(totals: Column) -> Column:
            places = F.filter(F.sequence(F.lit(0), n - 1), open_at)
            return F.concat(F.flatten(F.transform(places, lambda i: at(i, totals["f"], totals["m"]))), F.array(entry(2, totals["f"], n)))

        return let(F.struct(_xor(f).alias("f"), _xor(moved).alias("m")), body)

    words = F.split("line", " ")
    hashes = let(words, lambda w: F.struct(F.transform(w, lambda x, i: F.xxhash64(x, i)).alias("f"), F.transform(w, lambda x, i: F.xxhash64(x, i - 1)).alias("m")))
    sums = let(hashes, lambda h: F.struct(h["f"].alias("f"), h["m"].alias("m"), _xor_before(h["f"]).alias("to"), _xor_before(h["m"]).alias("to_m")))
    made = let(sums, lambda x: of(x["f"], x["m"], x["to"], x["to_m"]))
    return near.select("ln", F.explode(made).alias("v")).select("v.key", "v.kind", "ln")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether arrays of words a and b are one edit apart at most."""

    def one_out(long: Column, short: Column) -> Column:
        at = F.coalesce(F.nullif(F.array_position(F.zip_with(long, short, lambda x, y: F.coalesce(x == y, F.lit(False))), False), F.lit(0)), F.size(long)).cast("int")
        return let(at, lambda k: F.slice(long, k + 1, F.size(long)) == F.slice(short, k, F.size(long)))

    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: ~x)) <= 1
    return F.when(F.size(a) == F.size(b), same).when(F.size(a) == F.size(b) + 1, one_out(a, b)).when(F.size(b) == F.size(a) + 1, one_out(b, a)).otherwise(False)


def _likely(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key may be in wanted: all that are, and few others while wanted is small against FILTER_BITS_MOST."""
    bits = min(max(1 << 16, 1 << (FILTER_BITS_A_LINE * wanted.count()).bit_length()), FILTER_BITS_MOST)
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    cut = lambda d: d.withColumn("_bit", bit).withColumn("_cell", F.floor(F.col("_bit") / 64).cast("int")).withColumn("_off", (F.col("_bit") % 64).cast("int"))
    cells = cut(wanted.select(key)).groupBy("_cell").agg(F.bit_or(F.expr("shiftleft(1L, _off)")).alias("_bits"))
    return cut(df).join(F.broadcast(cells), "_cell").filter("shiftright(_bits, _off) & 1 = 1").drop("_bit", "_cell", "_off", "_bits")


def _dropped(docs: DataFrame) -> DataFrame:
    halves = half_keys(F.col("line"), F.col("n"))
    seen = common.stage(_exploded(docs).select("id", "t", "no", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"), *[k.alias(name) for name, k in halves.items()]), "lines")
    # 1. distinct lines; every column is of fixed width, so they aggregate by hash
    lines = common.stage(
        seen.groupBy("h", "g").agg(F.min(_place("id", "t", "no")).alias("first"), F.count(F.lit(1)).alias("times"), *[F.any_value(name).alias(name) for name in halves]),
        "distinct-lines",
    )
    # 2. lines that share a half with another line
    entries = F.filter(F.array(*[F.struct(F.col(name).alias("half"), F.lit(bit).alias("bit")) for name, _, _, bit in HALVES]), lambda x: x["half"].isNotNull())
    each = lines.select("h", "g", "first", F.explode(entries).alias("e")).select("h", "g", "first", "e.half", "e.bit")
    met = each.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("half")
    near = common.stage(each.join(met.hint("merge"), "half", "left_semi").groupBy("h", "g").agg(F.first("first").alias("first"), F.bit_or("bit").alias("flags")), "near-lines")
    placed = _exploded(docs).withColumn("first", _place("id", "t", "no"))
    found = _likely(placed, near, "first").join(near.hint("merge"), "first").select("h", "g", "first", "flags", "n", "line").dropDuplicates(["h", "g"])
    # numbers in the order of the lines' places
    texts = common.stage(found.orderBy("first").withColumn("ln", F.monotonically_increasing_id()), "near-texts")
    # 3. for each key, the earliest line of each kind
    keys = variants(texts)
    alone = F.col("kind") != 1
    earliest = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(alone, F.col("ln"))).alias("w"), F.min(F.when(~alone, F.col("ln"))).alias("d")).filter("n > 1").drop("n")
    partner = F.when(F.col("kind") == 2, F.col("d")).otherwise(F.col("w"))
    pairs = keys.join(earliest.hint("merge"), "key").withColumn("other", partner).filter("other < ln").select("ln", "other").distinct()
    # 4. verified word by word
    words = texts.select("ln", F.split("line", " ").alias("words"))
    verified = (
        pairs.join(words.join(texts.select("ln", "h", "g"), "ln"), "ln")
        .join(words.select(F.col("ln").alias("other"), F.col("words").alias("others")), "other")
        .filter(within_one_edit(F.col("words"), F.col("others")))
        .select("h", "g")
        .distinct()
        .withColumn("near", F.lit(True))
    )
    gone = lines.select("h", "g", "first", "times").join(verified, ["h", "g"], "left").filter("times > 1 OR near").select("h", "g", "first", "times", F.coalesce("near", F.lit(False)).alias("near"))
    total = lines.agg(F.sum("times")).first()[0] or 0
    gone = common.stage(gone, "gone-lines")
    each = common.join_counted(seen.select("h", "g", "id", "t", "no"), gone, ["h", "g"], "times", total)
    later = each.filter(F.col("near") | (_place("id", "t", "no") != F.col("first")))
    out = common.stage(later.groupBy("id", "t").agg(F.collect_set("no").alias("lines")), "dropped-lines")
    for done in (seen, lines, near, texts, gone):
        common.unstage(done)
    return out


def dropped(docs: DataFrame) -> DataFrame:
    """(id, t, lines): the numbers, from 0, of the lines that go from the document of that name."""
    out = _dropped(docs)
    common.release(docs.sparkSession)
    return out


def dedup(docs: DataFrame, n_lines: str = "_n_lines", n_dropped: str = "_n_dropped") -> DataFrame:
    """docs without the dropped lines, with two more long columns of the given names, which must be free.

    A null or empty text has no line that counts and stays. A null doc_id sorts last; of documents with the
    same id, order is by a hash of the text; repeated rows (same id and text) are judged as one document, so
    each keeps what the first keeps. Columns other than text keep their names and values, whatever their names,
    n_chars included. An empty table gives no rows.
    """
    gone = dropped(docs.select("doc_id", "text"))
    id_, t, lines_gone = (common.free_name(docs, wish) for wish in ("id", "t", "gone"))
    named = docs.withColumns({id_: F.coalesce(F.col("doc_id"), F.lit(common.LAST_ID)), t: F.xxhash64(F.col("text").cast("string"))})
    out = named.join(gone.select(F.col("id").alias(id_), F.col("t").alias(t), F.col("lines").alias(lines_gone)).hint("merge"), [id_, t], "left")  # by merge at every size

    def rest(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lines_gone)), lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(lines_gone).isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    counts = {n_lines: F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"), n_dropped: F.coalesce(F.size(lines_gone), F.lit(0)).cast("long")}
    return out.withColumns({"text": text} | counts).select(*docs.columns, n_lines, n_dropped)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256 of the text that is left. Awkward rows fare as `dedup` says; a null text has no lines."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
