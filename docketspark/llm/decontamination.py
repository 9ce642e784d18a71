"""Benchmark decontamination with SimHash windows and a multi-index Hamming search, in DataFrame functions only.

Words are lower-cased runs of letters and digits; shingles are runs of ``k`` of them. A shingle of the benchmark weighs
1 + ln((items + 1) / (items with it + 1)), any other as one that no item has. A document leaks an item when one of
its windows, as long as the item, has a weighted Jaccard similarity (shared weight over joint weight) of
``threshold`` or more with it.

1. Windows. A window that is similar enough shares ``threshold`` of the item's weight. So it has one of the item's anchors: its
   shingles from the rarest in the documents on, until the others weigh less than that. Documents meet items by anchors, and
   go on with those of which they have the weight; a phrase that many items or documents share is an anchor of no
   item that has enough else. Item-sized windows are laid where such a document has a shingle of such an item, one for each place
   that the item suggests. Only (document, place, shingle) rows of the benchmark's shingles are shuffled; texts of
   documents that have windows are read once more, and cut in pieces of bounded size.
2. SimHash. Each window and item gets the 64 signs of its weighted shingle votes.
3. Multi-index search. Signatures are cut into 8 blocks of 8 bits; within Hamming distance 23 two signatures differ by
   at most two bits in some block. Items are listed under each block value and its 36 neighbours of one or two bits; an
   equi-join on (number of words, block, value) so finds every item within ``radius`` of a window as long as it, whichever
   item the window was laid for. A pair that meets in several blocks goes on from the first of them only.
4. Exact similarity of the survivors decides.

The index's rows are of a fixed size (BLOCK_BYTES); shingles of the benchmark and items' weighted shingles are broadcast
after a check of their bytes, and joined by shuffle beyond BROADCAST_BYTES.

Null texts and ids of items, and items with fewer than ``k`` words, match nothing. Repeated items are compared once. Rows of
one document id are documents of their own: each is told by the hash of its text, which ``leaks`` does not return. Equal rows of one id give
one result. A null document id is reported as null. Other columns take no part. Empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import NULL_ID, cut, named, with_row_key

K, THRESHOLD, RADIUS = 5, 0.8, 23
BLOCKS, BITS = 8, 8
#: bits that may differ in a block, and the masks of all such differences
NEAR = 2
MASKS = [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(BITS), n)]
#: bytes of a table that may be broadcast; of a row of the index, of a shingle's place, of a weighted shingle
BROADCAST_BYTES, BLOCK_BYTES, PLACE_BYTES, WEIGHT_BYTES = 64 << 20, 56, 40, 32
#: documents with windows whose rows may be broadcast, about 100 bytes each
BROADCAST_DOCS = 200_000
#: words of all windows of one length that are cut from one piece of a text, about
PIECE = 1 << 16
EPSILON = 1e-6


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hash_at(pos: Column, k: int) -> Column:
    return F.xxhash64(*(F.get("words", pos + i) for i in range(k)))


def _hashes(k: int) -> Column:
    """The hash of each run of k words of a short text, in order; none for fewer words."""
    return F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda p: _hash_at(p, k))).otherwise(F.array().cast("array<bigint>"))


def simhash(weighted: str) -> Column:
    """64 signs of the weighted votes of array<struct<s: bigint, w: double>>, as a bigint."""
    bit = lambda b: F.aggregate(weighted, F.lit(0.0), lambda a, x: a + F.when(F.getbit(x["s"], b) == 1, x["w"]).otherwise(-x["w"]))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(bit(b) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))


def _blocks(signature: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.struct(b.alias("block"), F.call_function("shiftrightunsigned", F.col(signature), b * BITS).bitwiseAND(F.lit(255)).alias("value")))


def _within(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, by a generator of one row: later expressions that use them don't work them out again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _weighted(df: DataFrame, keys: list[str], counted: DataFrame, weight: Column, name: str) -> DataFrame:
    """df's keys with the distinct shingles of the rows' words and their weights, in order."""
    rows = df.select(*keys, F.explode(F.array_distinct("hashes")).alias("s")).join(counted, "s", "left")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("s", weight.alias("w")))).alias(name))


def row_leaks(keyed: DataFrame, benchmark: DataFrame, item_col: str = "item_id", k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(_doc, _ord, item, similarity, start, n_words): the best window of each item that a document of keyed(_doc, _ord, text) leaks."""
    if not 0 <= radius < (NEAR + 1) * BLOCKS:
        raise ValueError(f"radius must be below {(NEAR + 1) * BLOCKS}: {radius}")
    items = _step(benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), "text"), words=words()).select("item", "words").where(F.size("words") >= k).distinct()
    items = cut(_step(items, hashes=_hashes(k)).select("item", F.size("words").alias("n_words"), "hashes"))
    placed = items.select("n_words", F.posexplode("hashes").alias("p", "s"), "item")
    n_placed, n_items = placed.count(), items.count()
    counted = _within(placed.groupBy("s").agg(F.countDistinct("item").alias("df")), n_placed * PLACE_BYTES)
    weight = 1 + F.log((F.lit(n_items) + 1) / (F.coalesce("df", F.lit(0)) + 1))

    # where documents have shingles of the benchmark, and which items they can leak
    texts = keyed.select("_doc", "_ord", words().alias("words")).where(F.size("words") >= k)
    at = texts.select("_doc", "_ord", "words", F.size("words").alias("size"), F.posexplode("words").alias("pos", "w"))
    at = at.where(F.col("pos") + k <= F.col("size")).select("_doc", "_ord", "size", "pos", _hash_at(F.col("pos"), k).alias("s"))  # the words end here
    at = cut(at.join(_within(placed.select("s").distinct(), n_placed * PLACE_BYTES), "s", "left_semi"))
    rows = at.groupBy("s").agg(F.count("*").alias("n"))
    weighed = cut(placed.select("item", "n_words", "s").distinct().join(counted, "s").join(rows, "s").select("item", "n_words", "s", weight.alias("w"), (F.col("n") * F.col("df")).alias("n")))
    enough = placed.select("item", "n_words", "s").distinct().join(counted, "s").groupBy("item", "n_words").agg((threshold * F.sum(weight) - EPSILON).alias("least"))
    rest = F.sum("w").over(Window.partitionBy("item", "n_words").orderBy(F.desc("n"), "s").rowsBetween(Window.unboundedPreceding, 0))
    anchors = weighed.select("*", rest.alias("rest")).join(enough, ["item", "n_words"]).where("rest >= least").select("s", "item", "n_words", "least")
    met = at.join(_within(anchors, n_placed * PLACE_BYTES), "s").select("_doc", "_ord", "item", "n_words", "least").distinct()
    shared = met.join(_within(weighed.select("item", "n_words", "s", "w"), n_placed * PLACE_BYTES), ["item", "n_words"]).join(at.select("_doc", "_ord", "s").distinct(), ["_doc", "_ord", "s"])
    able = cut(shared.groupBy("_doc", "_ord", "item", "n_words").agg(F.sum("w").alias("w"), F.first("least").alias("least")).where("w >= least").select("_doc", "_ord", "item", "n_words"))

    # windows of these documents, a piece of the text at a time
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("p"), F.col("size") - F.col("n_words")))
    hits = able.join(_within(placed, n_placed * PLACE_BYTES), ["item", "n_words"]).join(at, ["_doc", "_ord", "s"]).select("_doc", "_ord", start.alias("start"), "n_words").distinct()
    piece = F.floor(F.col("start") / F.greatest(F.lit(1), F.floor(F.lit(PIECE) / F.col("n_words"))))
    laid = cut(hits.groupBy("_doc", "_ord", "n_words", piece.alias("piece")).agg(F.min("start").alias("first"), (F.max("start") + F.col("n_words")).alias("end"), F.collect_list("start").alias("at")))
    laid = F.broadcast(laid) if laid.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0] <= BROADCAST_DOCS else laid
    read = _step(keyed.select("_doc", "_ord", "text").join(laid, ["_doc", "_ord"]), words=words())
    read = read.select("_doc", "_ord", "n_words", "first", "at", F.slice("words", F.col("first") + 1, F.col("end") - F.col("first")).alias("words"))
    read = _step(_step(read, piece=F.col("words")).drop("words").withColumnRenamed("piece", "words"), hashes=_hashes(k))
    cut_out = F.transform("at", lambda x: F.struct(x.alias("start"), F.slice("hashes", x - F.col("first") + 1, F.col("n_words") - k + 1).alias("hashes")))
    windows = read.select("_doc", "_ord", "n_words", F.inline(cut_out))
    windows = _step(_weighted(windows, ["_doc", "_ord", "start", "n_words"], counted, weight, "ws"), signature=simhash("ws"))

    signed = cut(_weighted(items, ["item", "n_words"], counted, weight, "iws").withColumn("item_signature", simhash("iws")))
    listed = signed.select("item", "n_words", "item_signature", F.inline(_blocks("item_signature")))
    near = F.transform(F.array(*map(F.lit, MASKS)), lambda m: F.col("value").bitwiseXOR(m.cast("long")))
    probes = _within(listed.select("item", "n_words", "item_signature", "block", F.explode(near).alias("value")), n_items * BLOCKS * len(MASKS) * BLOCK_BYTES)

    blocks = windows.select("*", F.inline(_blocks("signature")))
    differ = F.col("signature").bitwiseXOR(F.col("item_signature"))
    meet = lambda b: F.bit_count(F.call_function("shiftrightunsigned", differ, b * BITS).bitwiseAND(F.lit(255))) <= NEAR
    once = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), meet)) == F.col("block")
    pairs = blocks.join(probes, ["n_words", "block", "value"]).where((F.bit_count(differ) <= radius) & once)
    pairs = pairs.join(_within(signed.select("item", "n_words", "iws"), n_placed * WEIGHT_BYTES), ["item", "n_words"])
    # in the order of both, a shingle of both stands twice
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["w"])
    twice = lambda a, x: F.struct(x["s"].alias("s"), F.when(x["s"] == a["s"], a["w"] + x["w"]).otherwise(a["w"]).alias("w"))
    common = F.aggregate(F.array_sort(F.concat("ws", "iws")), F.struct(F.lit(None).cast("long").alias("s"), F.lit(0.0).alias("w")), twice)["w"]
    scored = _step(pairs, common=common, both=total("ws") + total("iws"))
    scored = scored.withColumn("similarity", F.col("common") / (F.col("both") - F.col("common")))
    best = scored.where(F.col("similarity") >= threshold).groupBy("_doc", "_ord", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best"))
    return best.select("_doc", "_ord", "item", "best.similarity", (-F.col("best.back")).cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """(id, item id, similarity, start, n_words): the best window of each item that a document leaks."""
    keyed, _ = with_row_key(docs.select(*named([id_col, "text"])).toDF("id", "text"), "id")
    found = row_leaks(keyed, benchmark, item_col, **options)
    return found.select(F.nullif("_doc", F.lit(NULL_ID)).alias(id_col), F.col("item").alias(item_col), "similarity", "start", "n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that leak no item, told apart by id and text."""
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), F.col("text").alias("text"), *named([id_col])).toDF("row", "text", "id")
    keyed, _ = with_row_key(rows, "id")
    gone = cut(row_leaks(keyed, benchmark, **options).select("_doc", "_ord").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_DOCS else gone
    return keyed.join(gone, ["_doc", "_ord"], "left_anti").select("row.*")
