"""Exact and similar duplicates of records.

Case numbers that are empty or unreadable are one hot key; they take part in no window. ``similar_record_groups`` compares
them like all others, by representatives and in blocks. Counts combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Names, words
from ..functions.text import is_empty, let
from .order import ranked
from .sizing import broadcast_if_small, materialize

#: longest value whose shortened forms are compared; longer ones are compared by segments
SHORT = 15
#: representatives of a case number that one row compares with as many others, at least and at most
BLOCK, WIDEST = 1024, 8192
#: blocks of a case number, or more, from which on they are wider than the least
BLOCKS = 16
#: representatives of a case number up to which all its pairs are one row's work, and up to which they are compared pair by pair
SMALL, FEW = 512, 96
#: pairs that are compared pair by pair at once, about
TOGETHER = 1 << 18
#: a word of more than one in so many values is common; there are at most that many times as many of them as a value has words
COMMON = 1000
#: sources of a case number up to which they are listed in one row
LISTED = 1000


def duplicate_case_numbers(records: DataFrame) -> DataFrame:
    """(case_number, count) of values that occur more than once; the empty value counts too."""
    return records.groupBy(F.coalesce("case_number", F.lit("")).alias("case_number")).agg(F.count("*").alias("count")).where("count > 1")


def unique_case_numbers(records: DataFrame) -> DataFrame:
    return records.select(F.coalesce("case_number", F.lit("")).alias("case_number")).distinct()


def mark_duplicates(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """records with is_duplicate and duplicate_of, the first id with the same non-empty case number.

    The first ids come from a minimum that combines before the shuffle, and only of numbers that repeat; empty values
    are null in the join and so meet nothing.
    """
    key = F.when(F.col("case_number") != "", F.col("case_number"))
    first = records.select(key.alias("_case"), F.col(id_col).alias("_id")).where("_case is not null").groupBy("_case").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = records.drop("is_duplicate", "duplicate_of").withColumn("_case", key).join(first, "_case", "left")
    later = F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))
    return out.withColumn("is_duplicate", later).withColumn("duplicate_of", F.when(later, F.col("_first"))).drop("_case", "_first")


def source_counts(records: DataFrame, source_col: str = "image_id") -> DataFrame:
    """(case_number, source, count, place) of repeated non-empty case numbers: a row for each source, place from 1 on in its order.

    Counts combine before the shuffle and places come from ranges, so a case number of very many sources is the work of
    many tasks. A null source counts as none.
    """
    flat = records.where(F.col("case_number") != "").groupBy("case_number", F.col(source_col).alias("source")).agg(F.count("*").alias("count"))
    repeated = flat.groupBy("case_number").agg(F.sum("count").alias("_all")).where("_all > 1").drop("_all")
    named = flat.join(repeated, "case_number").where("source is not null")
    return ranked(named, ["case_number"], [F.col("source").asc()], "place")


def duplicate_sources(records: DataFrame, source_col: str = "image_id", listed: int = LISTED) -> DataFrame:
    """(case_number, count, n_sources, sources in order) of repeated non-empty case numbers.

    The list is null where a case number has more than listed sources; ``source_counts`` has them all, one a row.
    """
    flat = records.where(F.col("case_number") != "").groupBy("case_number", F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    totals = flat.groupBy("case_number").agg(F.sum("n").alias("count"), F.count("source").alias("n_sources")).where("count > 1")
    few = totals.where(F.col("n_sources") <= listed).select("case_number")
    lists = flat.where("source is not null").join(few, "case_number").groupBy("case_number").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    nothing = F.when(F.col("n_sources") == 0, F.array())
    return totals.join(lists, "case_number", "left").withColumn("sources", F.coalesce("sources", nothing))


def handle_duplicates(marked: DataFrame, mode: str = "review") -> DataFrame:
    """keep_all, remove_exact, or review (duplicates ask for review)."""
    if mode == "keep_all":
        return marked
    if mode == "remove_exact":
        return marked.where(~F.col("is_duplicate"))
    if mode == "review":
        return marked.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | F.col("is_duplicate"))
    raise ValueError(f"unknown duplicate mode: {mode}")


def _least_ratio(threshold: float) -> float:
    """The ratio from which on records of one case number are similar, a little less for rounding."""
    return 100 * (threshold - 0.7) / 0.3 - 1e-6


def _pairs_of_rows(threshold: float, counts: bool):
    """Rows with lists of representatives (ids, parties, and other_ids, other_parties where two lists meet) to links, or to counts of pairs."""
    least = _least_ratio(threshold)

    def similar(ratio: np.ndarray) -> np.ndarray:
        return 0.7 + 0.3 * (ratio / 100.0)

    def told(one: np.ndarray, two: np.ndarray, similarity: np.ndarray, looked: int, full: int) -> pa.RecordBatch:
        if counts:
            return pa.record_batch([pa.array([looked]), pa.array([full])], names=["pairs", "compared"])
        return pa.record_batch([pa.array(x) for x in (np.minimum(one, two), np.maximum(one, two), similarity)], names=["id1", "id2", "similarity"])

    def compared(names: Names, ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        ratio, full = names.ratios(i, j, least)
        similarity = similar(ratio)
        hit = similarity >= threshold
        return told(ids[i[hit]], ids[j[hit]], similarity[hit], len(i), full)

    def each(names: Names, ids: np.ndarray, i: np.ndarray, j: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for x, y, code, values, halved, full in names.coded(i, j, least):
            shape, similarity = (len(x), len(y)), similar(values)
            hit = similarity >= threshold
            hit = hit if code is None else np.take(hit, code)
            looked = hit.size
            if halved:
                right = np.triu(np.ones(shape, bool), 1)
                looked = int(np.count_nonzero(right))
                hit &= right
            # links of one smaller id stand together, so that a file holds that id once for them
            before = ids[x][:, None] < ids[y]
            parts = []
            for one, two, here, of in ((x, y, hit & before, code), (y, x, (hit & ~before).T, None if code is None else code.T)):
                told_of = (similarity if one is x else similarity.T)[here] if of is None else np.take(similarity, of[here])
                parts.append((np.repeat(ids[one], np.count_nonzero(here, axis=1)), np.broadcast_to(ids[two], here.shape)[here], told_of))
            yield told(*(np.concatenate(c) for c in zip(*parts, strict=True)), looked, full)

    def pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs within lists that begin at first."""
        one, two = [], []
        for n in np.unique(size).tolist():
            a, b = np.triu_indices(n, 1)
            at = first[size == n]
            one.append((at[:, None] + a).ravel())
            two.append((at[:, None] + b).ravel())
        return (np.concatenate(one), np.concatenate(two)) if one else (first, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in ("ids", "parties", "other_ids", "other_parties") if c in batch.schema.names}
            sizes = np.diff(lists["ids"].offsets.to_numpy())
            alone = np.arange(batch.num_rows) if "other_ids" in lists else np.flatnonzero(sizes > FEW)
            for k in alone.tolist():
                part = {c: x.slice(k, 1) for c, x in lists.items()}
                ids, parties = part["ids"].flatten().to_numpy(), part["parties"].flatten().to_pylist()
                n, other = len(ids), None
                if "other_ids" in part and part["other_ids"][0].is_valid:
                    ids, parties = np.concatenate([ids, part["other_ids"].flatten().to_numpy()]), parties + part["other_parties"].flatten().to_pylist()
                    other = n + np.argsort(ids[n:], kind="stable")
                yield from each(Names(parties), ids, np.argsort(ids[:n], kind="stable"), other)
            few = np.setdiff1d(np.arange(batch.num_rows), alone)
            shares = np.cumsum(sizes[few] * (sizes[few] - 1) // 2) // TOGETHER
            for of in np.split(few, np.flatnonzero(np.diff(shares)) + 1):
                ids, parties = lists["ids"].take(pa.array(of)).flatten().to_numpy(), lists["parties"].take(pa.array(of)).flatten().to_pylist()
                i, j = pairs(np.cumsum(sizes[of]) - sizes[of], sizes[of])
                if len(i):
                    yield compared(Names(parties), ids, i, j)

    return run


def _needed_words(w: Column, common: Column | None, ratio: float) -> Column:
    """Of sorted words, those of which one must be shared with any text of which this one is mostly a part.

    Such a pair scores by the common words alone: 1 - (1 + rest) / (common + length) >= ratio, or has no rest. Words are taken from the
    rarest on; once the words from one on, all shared, can't reach the ratio, one before it must be shared.
    """
    count = lambda x: F.coalesce(F.try_element_at(common, x), F.lit(0).cast("long")) if common is not None else F.lit(0).cast("long")
    rare_first = F.array_sort(F.transform(w, lambda x: F.struct(count(x).alias("n"), x.alias("word"))))
    size = lambda words_: F.aggregate(words_, F.lit(0), lambda a, x: a + F.length(x["word"]) + 1)

    def needed(ordered: Column) -> Column:
        def enough(x: Column, i: Column) -> Column:
            before = size(F.slice(ordered, F.lit(1), i))  # the rest and the space behind it
            whole = size(ordered) - 1
            return (i == 0) | (before <= (1 - ratio + 1e-9) * (whole - before + whole))

        return F.transform(F.filter(ordered, enough), lambda x: x["word"])

    return let(rare_first, needed)


def _contained(named: DataFrame) -> DataFrame:
    """(id1, id2) of representatives (case, id, w) of one case number of which one has all words of the other.

    Each is looked up by the word that the fewest of its case number have, and met only by those that have it; a word that no other has
    leads nowhere and is dropped before anything is joined.
    """
    named = materialize(named.select("case", "id", "w"))
    single = named.select("case", "id", F.explode("w").alias("word"))
    counted = single.groupBy("case", "word").agg(F.count("*").alias("n"))
    rarest = single.join(counted, ["case", "word"]).groupBy("case", "id").agg(F.min(F.struct("n", "word")).alias("r")).where("r.n > 1")
    needed = materialize(rarest.select("case", "id", F.col("r.word").alias("word")))
    having = single.join(needed.select("case", "word").distinct(), ["case", "word"], "left_semi").withColumnRenamed("id", "_id")
    met = needed.join(having, ["case", "word"]).where("id != _id").select("case", "id", "_id")
    both = met.join(named, ["case", "id"]).join(named.select("case", F.col("id").alias("_id"), F.col("w").alias("_w")), ["case", "_id"])
    # equal sets contain each other and would be told twice
    held = (F.size(F.array_except("w", "_w")) == 0) & ((F.size("w") < F.size("_w")) | (F.col("id") < F.col("_id")))
    return both.where(held).select(F.least("id", "_id").alias("id1"), F.greatest("id", "_id").alias("id2"))


def similar_record_groups(records: DataFrame, threshold: float = 0.9, block: int = BLOCK, small: int = SMALL, id_col: str = "record_id", counts: bool = False) -> DataFrame:
    """(kind, id1, id2, similarity): all similar records of equal case numbers, empty ones included, by representatives.

    Records of equal case number and party name are a group, its smallest id stands for it. ``member`` rows name the
    representative and each other record of its group, where these are similar to each other; ``link`` rows name two
    representatives, id1 < id2, whose records are all similar across.

    The pairs of a case number of up to ``small`` representatives are one row's work. Those of others are dealt into blocks by the length of
    their words and a hash; blocks meet whose lengths are so near that a pair can be similar as a whole, a pair of blocks a row, so
    a hot key is the work of many tasks. Where lengths are further apart a short name can only be a part of a long one, and the
    two meet by a word that they must share and by the long one's order of length. Of the pairs that meet, bounds by common words and by classes of signs leave few more than the
    links to be compared in full; counts=True gives (pairs, compared) in place of the links. At a threshold of 1 only a name that has all words
    of the other is similar to it, and names meet by their rarest word alone.
    """
    return _groups(_narrow(records, id_col), threshold, block, small, counts)


def _narrow(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(case, party, id) of records, worked out once."""
    return materialize(records.select(F.coalesce("case_number", F.lit("")).alias("case"), F.coalesce("party_name", F.lit("")).alias("party"), F.col(id_col).cast("long").alias("id")))


def _groups(rows: DataFrame, threshold: float, block: int = BLOCK, small: int = SMALL, counts: bool = False) -> DataFrame:
    """``similar_record_groups`` of rows (case, party, id)."""
    groups = materialize(rows.groupBy("case", "party").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    alike = 0.7 + 0.3 * (F.when(F.size(words(F.col("party"))) > 0, 100.0).otherwise(0.0) / 100.0)
    repeated = groups.where("n > 1").withColumn("similarity", alike).where(F.col("similarity") >= threshold).drop("n")
    members = rows.join(repeated, ["case", "party"]).where("id > first").select(F.lit("member").alias("kind"), F.col("first").alias("id1"), F.col("id").alias("id2"), "similarity")

    ratio = _least_ratio(threshold) / 100
    sizes = groups.groupBy("case").agg(F.count("*").alias("size"))

    def named(some: DataFrame) -> DataFrame:
        worded = some.withColumn("w", words(F.col("party"))).where(F.lit(ratio <= 0) | (F.size("w") > 0))
        return worded.withColumnRenamed("first", "id").withColumn("length", F.length(F.array_join("w", " ")))

    if threshold == 1 and not counts:  # less than all words in common gives less than 100
        return _contained(named(groups.join(sizes.where("size > 1"), "case"))).select(F.lit("link").alias("kind"), "id1", "id2", F.lit(1.0).alias("similarity")).unionByName(members)
    listed = (F.collect_list("id").alias("ids"), F.collect_list("party").alias("parties"))
    # few bytes and much work: a stated number of tasks is not joined to fewer
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one in so many names is a large case number at most: the names themselves need not be dealt to be told from others
    sizes = broadcast_if_small(materialize(sizes.where(F.col("size") > small)))
    few = named(groups.join(sizes.select("case"), "case", "left_anti")).select("case", "id", "party")
    within = few.repartition(tasks, "case").groupBy("case").agg(*listed).where(F.size("ids") > 1)

    large = named(groups.join(sizes, "case")).select("case", "size", "id", "party", "w", "length")
    # a name is sent once for each block that its own meets: wider blocks where there are very many
    wide = F.greatest(F.lit(block), F.least(F.lit(WIDEST), F.col("size") / BLOCKS))
    per_length = large.groupBy("case", "size", "length").agg(F.count("*").alias("n")).select("case", "length", F.ceil(F.col("n") / wide).cast("int").alias("subs"))
    per_length = broadcast_if_small(materialize(per_length))
    dealt = large.join(per_length, ["case", "length"]).withColumn("sub", F.pmod(F.xxhash64("party"), F.col("subs")).cast("int"))
    # dealt by block, as a hot case number's blocks are copied for all that they meet
    blocks = dealt.repartition(tasks, "case", "length", "sub").groupBy("case", "length", "sub").agg(*listed)
    lengths = broadcast_if_small(per_length.groupBy("case").agg(F.collect_list(F.struct("length", "subs")).alias("lengths")))
    most = lambda n: n * ((2 - ratio) / ratio) + 1e-6 if ratio > 0 else F.lit(float("inf"))
    near = F.filter("lengths", lambda x: F.greatest(x["length"], F.col("length")) <= most(F.least(x["length"], F.col("length"))))
    partners = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["subs"] - 1), lambda k: F.struct(x["length"].alias("length"), k.alias("sub")))))
    # each block goes straight to where it meets another, once for both
    own = F.struct("length", "sub")
    met = blocks.join(lengths, "case").withColumn("other", F.explode(partners)).select("case", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), (own <= F.col("other")).alias("is_low"), "ids", "parties")
    side = lambda c, low: F.first(F.when(F.col("is_low") == low, F.col(c)), ignorenulls=True)
    across = met.repartition(tasks, "case", "low", "high").groupBy("case", "low", "high").agg(side("ids", True).alias("ids"), side("parties", True).alias("parties"), side("ids", False).alias("other_ids"), side("parties", False).alias("other_parties"))
    across = across.select("ids", "parties", "other_ids", "other_parties")

    schema = "pairs long, compared long" if counts else "id1 long, id2 long, similarity double"
    links = within.select("ids", "parties").mapInArrow(_pairs_of_rows(threshold, counts), schema).unionByName(across.mapInArrow(_pairs_of_rows(threshold, counts), schema))
    if ratio > 0:
        factor = (2 - ratio) / ratio
        rank = F.floor(F.log(F.col("length").cast("double")) / F.log(F.lit(factor))).cast("int")
        ranks = large.select("case", rank.alias("rank")).distinct()
        short = large.select("case", "id", "party", "w", "length", rank.alias("_rank")).join(ranks, "case").where("rank > _rank")
        short = short.select("case", "rank", "id", "party", "length", F.explode(_needed_words(F.col("w"), None, ratio)).alias("word"))
        long = large.select("case", rank.alias("rank"), F.col("id").alias("_id"), F.col("party").alias("_party"), F.col("length").alias("_length"), F.explode("w").alias("word"))
        part = short.join(long, ["case", "rank", "word"]).where(F.col("_length") > F.col("length") * factor + 1e-6)
        apart = part.groupBy("id", "_id").agg(F.first("party").alias("party"), F.first("_party").alias("_party"))
        far = apart.select(F.array("id").alias("ids"), F.array("party").alias("parties"), F.array("_id").alias("other_ids"), F.array("_party").alias("other_parties"))
        links = links.unionByName(far.mapInArrow(_pairs_of_rows(threshold, counts), schema))
    if counts:
        return links.agg(F.sum("pairs").alias("pairs"), F.sum("compared").alias("compared"))
    return links.select(F.lit("link").alias("kind"), "id1", "id2", "similarity").unionByName(members)


def similar_records(records: DataFrame, threshold: float = 0.9, skip_empty: bool = True, id_col: str = "record_id") -> DataFrame:
    """(id1, id2, similarity) of records with equal case numbers: 0.7 + 0.3 * party similarity >= threshold.

    The groups of ``similar_record_groups``, each record for itself: as many rows as there are pairs. Empty case numbers are equal to each
    other; skip_empty leaves these pairs out.
    """
    rows = records.where(~is_empty(F.col("case_number"))) if skip_empty else records
    found = similar_record_groups(rows, threshold, id_col=id_col)
    links, members = found.where("kind = 'link'"), found.where("kind = 'member'")
    first = rows.groupBy(F.coalesce("case_number", F.lit("")).alias("_case"), F.coalesce("party_name", F.lit("")).alias("_party")).agg(F.min(F.col(id_col).cast("long")).alias("first")).select("first")
    of = first.select("first", F.col("first").alias("id")).unionByName(members.select(F.col("id1").alias("first"), F.col("id2").alias("id")))
    across = links.join(of.select(F.col("first").alias("id1"), F.col("id").alias("a")), "id1").join(of.select(F.col("first").alias("id2"), F.col("id").alias("b")), "id2")
    pairs = across.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "similarity")
    own = members.select("id1", "id2", "similarity")
    beside = own.select("id1", F.col("id2").alias("a"), "similarity").join(own.select("id1", F.col("id2").alias("b")), "id1").where("a < b").select(F.col("a").alias("id1"), F.col("b").alias("id2"), "similarity")
    return pairs.unionByName(own).unionByName(beside)


def _allowed(total: int, threshold: float) -> int:
    """The most insertions and deletions of two texts of this length together at which they are still similar."""
    return floor((1 - threshold) * total + 1e-9)


def _common_length(n: int, other: int, threshold: float) -> int | None:
    """The length of a subsequence that two similar texts of these lengths must share; None where they can't be similar."""
    m = ceil((n + other - _allowed(n + other, threshold)) / 2)
    return m if m <= min(n, other) else None


def candidate_keys(value: str, threshold: float, shorter: bool) -> set[tuple[str, str]]:
    """Keys such that values of similar sorted words, without a word in common, share one, as by ``text_keys``."""
    return text_keys(" ".join(sorted(set(value.split()))), threshold, shorter)


def bag_keys(value: str, threshold: float, shorter: bool) -> set[tuple[str, str]]:
    """Keys of the sorted signs of a value, such that values whose whole texts are similar share one, whatever words they share.

    Setting common words aside changes neither the length of two texts nor by how many signs they differ, and sorted signs
    differ by no more insertions and deletions than the texts.
    """
    return {(f"bag {kind}", key) for kind, key in text_keys("".join(sorted(" ".join(set(value.split())))), threshold, shorter)}


def text_keys(text: str, threshold: float, shorter: bool) -> set[tuple[str, str]]:
    """Keys as the shorter, or as the longer, of two texts, such that the two share one if they differ by as few insertions and deletions as the threshold allows.

    A kind names both lengths, so that none meet by what only texts of other lengths must share; texts of one length, marked by =, meet both ways.
    Two texts of up to SHORT characters share a subsequence of the length their lengths demand: each gives all of
    its own. Otherwise the shorter is cut into one segment more than edits are allowed; one stays whole and
    stands in the longer at most that many places away.
    """
    n, keys = len(text), set()
    lengths = lambda other: f"= {n}" if n == other else f"{min(n, other)} {max(n, other)}"
    if n <= SHORT:
        subs: dict[int, list[str]] = {}
        for other in range(n, SHORT + 1) if shorter else range(1, n + 1):
            m = _common_length(n, other, threshold)
            if m is not None:
                if m not in subs:
                    subs[m] = ["".join(c) for c in combinations(text, m)]
                kind = f"sub {lengths(other)}"
                keys |= {(kind, key) for key in subs[m]}
    reach = range(n, ceil(n * (2 - threshold) / threshold) + 1) if shorter else range(max(1, floor(n * threshold / (2 - threshold))), n + 1)
    for other in reach:
        short, long = min(n, other), max(n, other)
        edits = _allowed(short + long, threshold)
        if long <= SHORT or long - short > edits:
            continue
        cuts = [short * i // (edits + 1) for i in range(edits + 2)]
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            kind = f"seg {lengths(other)} {i}"
            if shorter:
                keys.add((kind, text[lo:hi]))
            else:
                keys |= {(kind, text[at : at + hi - lo]) for at in range(max(0, lo - edits), min(n - (hi - lo), lo + edits) + 1)}
    return keys


def common_words(values: DataFrame, per: int = COMMON) -> DataFrame:
    """(word, n) of words that stand in more than one in per values; bounded by per times the words of a value."""
    total = values.count()
    return values.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > total / per)


def pairs_by_words(values: DataFrame, threshold: float) -> DataFrame:
    """(case1, case2) of values of which one may be mostly a part of the other: a word that the one needs is among the other's.

    Words are taken in one order for all values, those that few values have first; the table of common ones is bounded and broadcast.
    """
    counted = F.broadcast(common_words(values).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("common")))
    needed = values.join(counted).select("value", F.explode(_needed_words(F.col("w"), F.col("common"), threshold)).alias("word"))
    every = values.select(F.col("value").alias("other"), F.explode("w").alias("word"))
    return needed.join(every, "word").where("value != other").select(F.least("value", "other").alias("case1"), F.greatest("value", "other").alias("case2"))


def similar_number_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """(case1, case2) that may be similar, case1 < case2, of different values (value, w: its words).

    Three ways lead to a ratio: the whole texts are similar and no word is shared (keys of the text), they are similar and
    words are shared (keys of the sorted signs, only of values of several words), or one value is mostly a part of the other: then they meet by
    one of its words that must be shared, the rarest first, so that a word of very many values is looked up
    only by values that hardly consist of anything else.
    """

    def keys(shorter: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 256):
                    rows = []
                    for v in batch.column(0).slice(begin, 256).to_pylist():
                        formed = candidate_keys(v, threshold, shorter) | (bag_keys(v, threshold, shorter) if len(set(v.split())) > 1 else set())
                        rows += [(v, kind, k) for kind, k in formed]
                    if rows:
                        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["value", "kind", "key"])

        return run

    # few bytes and much work: a stated number of tasks is not joined to fewer
    tasks = 4 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.select("value").repartition(tasks, "value")
    short, long = (dealt.mapInArrow(keys(shorter), f"{name} string, kind string, key string") for name, shorter in (("value", True), ("other", False)))
    met = short.join(long, ["kind", "key"]).where(F.when(F.col("kind").contains("="), F.col("value") < F.col("other")).otherwise(F.lit(True)))
    near = met.select(F.least("value", "other").alias("case1"), F.greatest("value", "other").alias("case2"))

    return near.unionByName(pairs_by_words(values, threshold)).distinct()


def _rated(threshold: float):
    """Pairs of values to those that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).dictionary_encode() for c in ("case1", "case2"))
            i, j = one.indices.to_numpy(), two.indices.to_numpy() + len(one.dictionary)
            names = Names(one.dictionary.to_pylist() + two.dictionary.to_pylist())
            similarity = names.ratios(i, j, 100 * threshold - 1e-6)[0] / 100.0
            hit = pa.array(similarity >= threshold)
            yield pa.record_batch([*(batch.column(c).filter(hit) for c in ("case1", "case2")), pa.array(similarity).filter(hit)], names=["case1", "case2", "similarity"])

    return run


def similar_case_numbers(records: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(case1, case2, similarity, pairs): different values, case1 < case2, similar by token_set_ratio; pairs counts their rows.

    Works on distinct values; every pair of ``similar_number_pairs`` is compared in full. No pair at or above the threshold is missed.
    """
    counted = records.groupBy(F.coalesce("case_number", F.lit("")).alias("value")).agg(F.count("*").alias("n")).withColumn("w", words(F.col("value"))).where(F.size("w") > 0)
    counted = materialize(counted)
    # few bytes and much work: a stated number of tasks is not joined to fewer
    tasks = 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = similar_number_pairs(counted.select("value", "w"), threshold)
    scored = pairs.repartition(tasks, "case1").sortWithinPartitions("case1").mapInArrow(_rated(threshold), "case1 string, case2 string, similarity double")
    n1, n2 = (counted.select(F.col("value").alias(f"case{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    return scored.join(n1, "case1").join(n2, "case2").select("case1", "case2", "similarity", (F.col("n1") * F.col("n2")).alias("pairs"))


def duplicate_candidates(records: DataFrame, record_threshold: float = 0.9, number_threshold: float = 0.85) -> DataFrame:
    """(kind, first, second, score): exact case numbers with their count, similar records (links and members) and similar numbers.

    The three are found in the same narrow rows, which are worked out once.
    """
    rows = _narrow(records)
    records = rows.select(F.col("case").alias("case_number"))
    exact = duplicate_case_numbers(records).select(F.lit("exact").alias("kind"), F.col("case_number").alias("first"), F.col("case_number").alias("second"), F.col("count").cast("double").alias("score"))
    alike = _groups(rows, record_threshold).select(F.when(F.col("kind") == "link", "record").otherwise("member").alias("kind"), F.col("id1").cast("string").alias("first"), F.col("id2").cast("string").alias("second"), F.col("similarity").alias("score"))
    numbers = similar_case_numbers(records, number_threshold).select(F.lit("number").alias("kind"), F.col("case1").alias("first"), F.col("case2").alias("second"), F.col("similarity").alias("score"))
    return exact.unionByName(alike).unionByName(numbers)
