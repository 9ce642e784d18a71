"""Near-duplicate groups: MinHash with tensored banding, links confirmed on whole shingle sets.

A document's set holds its distinct runs of ``k`` lower-cased words (the whole sequence where it has fewer words);
documents are linked when 100 * intersection >= percent * union, and a group is a connected component.

Tensored banding: two collections of ``m`` sub-signatures of ``rows`` MinHashes each; the key of table (i, j) joins
sub-signature i of the first with j of the second. m*m tables so cost 2*m*rows MinHashes, where independent tables
would need m*m*2*rows. A pair of similarity s shares a key with probability (1 - (1 - s**rows)**m)**2: for the
defaults 0.998 at s = 0.8, 0.9999 at 0.85, 0.33 at 0.5, 0.0003 at 0.2.

1. Documents with equal sets are one node, named by a 64-bit hash of the set.
2. Tasks hold the whole sets of some 12,000 documents at a time. Nodes that share a key there are compared at once; a
   node that is linked with an earlier one is absorbed by it, its anchor, and the anchor takes part under the node's
   keys too. So a key sends one row for each anchor, not for each copy. Per key, anchors are paired with the smallest.
3. These pairs are confirmed on whole sets, by joins. Only confirmed links are closed transitively.
4. What is left open is compared exactly. Two nodes that share a key both have a known distance (1 - similarity) from the
   smallest anchor of the key, or bounds of it where they were absorbed; by the triangle inequality they can only be linked
   if these differ by no more than the threshold allows, and need no look if they are connected already. What is left for
   an anchor is dealt into blocks of about ``block`` shingles, and pairs of blocks meet in a task each; what is
   connected with the anchor is only compared with what is not. A group of near copies is connected after step 3, so
   none of it is dealt, whatever its size, unless others are almost as near to it.
5. Components of confirmed links are the groups.

Null or empty texts have an empty set and stay alone. Rows of one id are documents of their own in all steps; the id of a
group is its smallest, and null counts as the smallest. Two nodes share a 64-bit hash with probability 3e-8 among a million
distinct texts, 3e-2 among a billion; their groups would then be one. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .text import NULL_ID, Words, cut, join_hot, mix, named, slices, with_row_key

#: keys that a task gathers before it compares nodes among themselves
FLUSH = 2_000_000
#: bytes of shingles that a task holds before it hands on their keys
FLUSH_BYTES = 128 << 20
#: rows of an Arrow batch handed back
ROWS = 1 << 16
#: candidate documents whose ids may be broadcast: 16 bytes each
BROADCAST_ROWS = 500_000


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for row, end, data, offsets in slices(column):
        w = Words(data, offsets, lower=True)
        doc, h = w.shingles(k)
        at = np.searchsorted(doc, np.arange(w.n_docs + 1)).tolist()
        for d in range(end - row):
            yield row + d, np.unique(h[at[d] : at[d + 1]])


def _node(s: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(digest[0]), int(digest[1])


def distance(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common, len(a) + len(b) - common


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo = [], [], []
            for _, s in _sets(batch.column(2), k):
                h1, h2 = _node(s)
                n.append(len(s))
                hi.append(h1)
                lo.append(h2)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["doc", "ord", "n_shingles", "h1", "h2"])

    return run


def minhashes(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHashes of each set h[starts[i]:starts[i+1]], all sets non-empty."""
    seeds = mix(np.arange(2 * n, dtype=np.uint64), 11)
    return np.stack([np.minimum.reduceat((h ^ seeds[2 * t]) * (seeds[2 * t + 1] | np.uint64(1)), starts) for t in range(n)], axis=1)


def tensored_keys(signature: np.ndarray, m: int, rows: int) -> np.ndarray:
    """The m*m table keys of each signature of 2*m*rows MinHashes."""
    part = np.zeros((len(signature), 2 * m), np.uint64)
    for r in range(rows):
        part = mix(part ^ signature[:, r::rows], r)
    keys = part[:, :m, None] * np.uint64(0xD6E8FEB86659FD93) + part[:, None, m:]
    return mix(keys.reshape(len(signature), m * m) ^ (np.arange(m * m, dtype=np.uint64) << np.uint64(48)))


def absorb(nodes: np.ndarray, sets: list[np.ndarray], key: np.ndarray, of: np.ndarray, percent: int) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """The anchor of each node (itself, where it is not absorbed) and (anchor, node, distance) of the absorbed ones.

    key[i] is a key of node number of[i]. Nodes are taken in ascending order; each is compared with the anchors of the
    smallest nodes of its keys until one is linked with it.
    """
    rank = np.argsort(nodes, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[rank] = np.arange(len(nodes))
    order = np.lexsort((place[of], key))
    sorted_key, sorted_of = key[order], of[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    lead = sorted_of[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    near = np.unique(np.stack([place[sorted_of], place[lead]], axis=1)[sorted_of != lead], axis=0)
    anchor, links = np.arange(len(nodes)), []
    begin = np.flatnonzero(np.concatenate([[len(near) > 0], near[1:, 0] != near[:-1, 0]])) if len(near) else []
    for lo, hi in zip(begin, [*begin[1:], len(near)], strict=True) if len(near) else []:
        x = int(rank[near[lo, 0]])
        for a in dict.fromkeys(anchor[rank[near[lo:hi, 1]]].tolist()):
            common, union = distance(sets[a], sets[x])
            if 100 * common >= percent * union:
                anchor[x] = a
                links.append((int(nodes[a]), int(nodes[x]), 1 - common / union))
                break
    return anchor, links


def _keys(k: int, m: int, rows: int, percent: int):
    """Of texts: (0, key, anchor, 0) of each key of an anchor, and (1, anchor, node, distance) of the absorbed nodes."""

    def flush(tables: list[np.ndarray], nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, key = np.array(nodes, np.int64), np.concatenate(tables)
        of = np.repeat(np.arange(len(node)), m * m)
        anchor, links = absorb(node, sets, key.ravel(), of, percent)
        order = np.lexsort((anchor[of], key.ravel()))
        a, h = anchor[of][order], key.ravel()[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])])
        yield from out(0, h[new].view(np.int64), node[a[new]], np.zeros(int(new.sum())))
        if links:
            x, y, d = (np.array(c) for c in zip(*links, strict=True))
            yield from out(1, x, y, d)

    def out(kind: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), ROWS):
            part = slice(at, at + ROWS)
            yield pa.record_batch([pa.array(np.full(len(a[part]), kind, np.int8)), pa.array(a[part]), pa.array(b[part]), pa.array(d[part])], names=["kind", "a", "b", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, nodes, held, seen, fresh, size = [], [], [], set(), [], 0
        for batch in batches:
            for _, s in _sets(batch.column(0), k):
                if len(s) and (node := _node(s)[0]) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    fresh.append(s)
                    size += s.nbytes
                    if len(fresh) >= 512 or len(s) > 100_000:
                        tables.append(signed(fresh))
                        held += fresh
                        fresh = []
                if len(nodes) * m * m >= FLUSH or size >= FLUSH_BYTES:
                    yield from flush([*tables, *([signed(fresh)] if fresh else [])], nodes, held + fresh)
                    tables, nodes, held, seen, fresh, size = [], [], [], set(), [], 0
        if nodes:
            yield from flush([*tables, *([signed(fresh)] if fresh else [])], nodes, held + fresh)

    def signed(sets: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        return tensored_keys(minhashes(np.concatenate(sets), starts, 2 * m * rows), m, rows)

    return run


def _named_sets(k: int):
    """(node, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [s for _, s in _sets(part.column(1), k)]
                yield pa.record_batch([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def _compare(percent: int):
    """(a, b, linked, d) of each row (a, b, one, two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [distance(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            linked = [100 * c >= percent * u for c, u in sizes]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array([1 - c / u for c, u in sizes], pa.float64())], names=["a", "b", "linked", "d"])

    return run


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of blocks that a node takes part in, of (lead, node, comp, inner, blk, b_in, b_out, shingles).

    Inner nodes are connected already: their blocks, 0 to b_in - 1, only meet those of outer nodes, which follow.
    """
    names = ["lead", "i", "j", "blk", "comp", "node", "shingles"]
    for batch in batches:
        inner, blk, b_in, b_out = (batch.column(c).to_pylist() for c in (3, 4, 5, 6))
        row, other = [], []
        for r in range(batch.num_rows):
            row += [r] * (b_out[r] if inner[r] else b_in[r] + b_out[r])
            other += range(b_in[r] if inner[r] else 0, b_in[r] + b_out[r])
        row, other, own = np.array(row), np.array(other), np.array(blk)
        for at in range(0, len(row), 512):
            r, o = row[at : at + 512], other[at : at + 512]
            part = batch.take(pa.array(r))
            yield pa.record_batch([part.column(0), pa.array(np.minimum(own[r], o), pa.int32()), pa.array(np.maximum(own[r], o), pa.int32()), pa.array(own[r], pa.int32()), part.column(2), part.column(1), part.column(7)], names=names)


def confirmed(ids: np.ndarray, blocks: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what links between these nodes connect, those of one component being connected; all pairs in one block, else those across two."""
    across = len(np.unique(blocks)) > 1
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(shingle, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(count)])
    root = np.unique(comps, return_index=True)[1][np.unique(comps, return_inverse=True)[1]]
    links = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    at = np.concatenate([[0], np.cumsum(size)])
    for x in range(len(sets) - 1):
        mine = shingle[at[x] : at[x + 1]]
        lo, n = begin[mine], count[mine]
        lo, n = lo[n > 1], n[n > 1]
        if not len(lo):
            continue
        flat = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        common = np.bincount(posting[flat], minlength=len(sets))
        hit = np.flatnonzero((100 * common >= percent * (size[x] + size - common)) & (np.arange(len(sets)) > x))
        for y in hit.tolist():
            if (not across or blocks[x] != blocks[y]) and (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                links.append((int(ids[x]), int(ids[y])))
    return links


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        links = confirmed(table["node"].to_numpy(), table["blk"].to_numpy(), table["comp"].to_numpy(), sets, percent) if len(sets) > 1 else []
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """A table of narrow rows, broadcast if it has BROADCAST_ROWS at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select("node", F.col("component").alias("comp"))


def open_nodes(pairs: DataFrame, members: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(lead, node, comp, inner): nodes of which some may be linked though no confirmed link connects them, for each lead that bounds their distance.

    pairs (a, b, linked, d) and members (a, b, d) give distances from anchors, comps the component of linked nodes. Inner nodes
    are of the lead's own component.
    """
    t = 1 - percent / 100 + 1e-9
    leads = pairs.where("not linked").select(F.col("a").alias("lead")).distinct()
    direct = pairs.join(leads, pairs.a == leads.lead, "left_semi").select(F.col("a").alias("lead"), F.col("b").alias("node"), F.col("d").alias("lo"), F.col("d").alias("hi"))
    zero = leads.select("lead", F.col("lead").alias("node"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    anchors = direct.unionByName(zero)
    absorbed = anchors.join(members.select(F.col("a").alias("node"), F.col("b").alias("member"), "d"), "node").select("lead", F.col("member").alias("node"), F.greatest(F.lit(0.0), F.col("lo") - F.col("d"), F.col("d") - F.col("hi")).alias("lo"), (F.col("hi") + F.col("d")).alias("hi"))
    near = anchors.unionByName(absorbed).groupBy("lead", "node").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    of = lambda c, name: comps.select(F.col("node").alias(c), F.col("comp").alias(name))
    near = near.join(of("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    near = near.join(of("lead", "main"), "lead", "left").withColumn("main", F.coalesce("main", "lead"))
    near = cut(near.withColumn("inner", F.col("comp") == F.col("main")))
    least = lambda f, c, x: f(F.when(F.col("inner") == x, F.col(c)))
    bounds = near.groupBy("lead").agg(least(F.min, "lo", False).alias("out_lo"), least(F.max, "hi", True).alias("in_hi"), least(F.min, "comp", False).alias("c1"), least(F.max, "comp", False).alias("c2"), F.count("*").alias("n"))
    bounds = cut(bounds.where("out_lo is not null"))
    kept = join_hot(near, bounds, ["lead"]).where(F.when(F.col("inner"), F.col("hi") >= F.col("out_lo") - t).otherwise((F.col("lo") <= F.col("in_hi") + t) | (F.col("c1") != F.col("c2"))))
    return kept.select("lead", "node", "comp", "inner")


def dealt_nodes(near: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(lead, node, comp, inner, blk, b_in, b_out) of open nodes, for leads with nodes of two components or more; sizes is (node, n_shingles)."""
    near = cut(near.join(sizes, "node"))
    count = lambda x: F.ceil(F.coalesce(F.sum(F.when(F.col("inner") == x, F.col("n_shingles"))), F.lit(0)) / block).cast("int")
    blocks = near.groupBy("lead").agg(count(True).alias("b_in"), count(False).alias("b_out"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n")).where("c1 <> c2").drop("c1", "c2")
    dealt = join_hot(near, cut(blocks), ["lead"])
    h = F.xxhash64("node")
    blk = F.when(F.col("inner"), F.pmod(h, F.greatest("b_in", F.lit(1)))).otherwise(F.col("b_in") + F.pmod(h, F.greatest("b_out", F.lit(1)))).cast("int")
    return dealt.select("lead", "node", "comp", "inner", blk.alias("blk"), "b_in", "b_out")


def row_groups(keyed: DataFrame, k: int = 5, percent: int = 80, m: int = 13, rows: int = 4, block: int = 1 << 18) -> DataFrame:
    """(doc, ord, n_shingles, component_id, component_ord): each row's set size and the first document of its group."""
    table = cut(keyed.select("_doc", "_ord", "text").mapInArrow(_digests(k), "doc long, ord long, n_shingles long, h1 long, h2 long"))
    nodes = table.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc", "ord")).alias("rep"), F.first("n_shingles").alias("n_shingles"))
    nodes = cut(nodes.select(F.col("h1").alias("node"), "h2", "rep", "n_shingles"))

    found = keyed.select("text").mapInArrow(_keys(k, m, rows, percent), "kind byte, a long, b long, d double")
    found = found.withColumn("p", F.when(F.col("kind") == 0, F.col("a")).otherwise(F.xxhash64("a", "b"))).repartition("kind", "p")
    found = found.withColumn("a", F.when(F.col("kind") == 0, F.min("b").over(Window.partitionBy("kind", "p"))).otherwise(F.col("a")))
    found = cut(found.where("a <> b").groupBy("kind", "a", "b").agg(F.min("d").alias("d")))
    members = found.where("kind = 1").select("a", "b", "d")

    def sets(wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the wanted nodes."""
        known = nodes.join(wanted, "node").select("node", F.col("rep.doc").alias("_doc"), F.col("rep.ord").alias("_ord"))
        texts = keyed.select("_doc", "_ord", "text").join(_small(cut(known)), ["_doc", "_ord"])
        return texts.select("node", "text").mapInArrow(_named_sets(k), "node long, shingles binary").dropDuplicates(["node"])

    pairs = found.where("kind = 0").select("a", "b")
    shingles = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    one, two = (shingles.toDF(c, f"{c}_shingles") for c in ("a", "b"))
    compared = pairs.join(two, "b").join(one, "a").select("a", "b", "a_shingles", "b_shingles")
    pairs = cut(compared.mapInArrow(_compare(percent), "a long, b long, linked boolean, d double"))
    comps = cut(_components(pairs.where("linked").select("a", "b").unionByName(members.select("a", "b"))))

    near = cut(dealt_nodes(open_nodes(pairs, members, comps, percent), nodes.select("node", "n_shingles"), block))
    if not near.isEmpty():
        given = near.join(sets(near.select("node").distinct()), "node").select("lead", "node", "comp", "inner", "blk", "b_in", "b_out", "shingles")
        dealt = given.mapInArrow(_deal, "lead long, i int, j int, blk int, comp long, node long, shingles binary")
        links = cut(dealt.groupBy("lead", "i", "j").applyInArrow(_confirm(percent), "a long, b long"))
        if not links.isEmpty():
            comps = cut(_components(links.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))))

    rooted = nodes.join(comps, "node", "left").withColumn("root", F.coalesce("comp", "node"))
    first = comps.join(nodes, "node").groupBy(F.col("comp").alias("root")).agg(F.min("rep").alias("first"))
    rooted = rooted.join(first, "root", "left").select(F.col("node").alias("h1"), "h2", F.coalesce("first", "rep").alias("first"))
    out = table.join(rooted, ["h1", "h2"], "left")
    mine = F.struct("doc", "ord")
    first = F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(mine)
    return out.select("doc", "ord", "n_shingles", first["doc"].alias("component_id"), first["ord"].alias("component_ord"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", k: int = 5, percent: int = 80, m: int = 13, rows: int = 4, block: int = 1 << 18) -> DataFrame:
    """id, n_shingles, component_id, kept (whether the id is the group's) of each row of docs."""
    keyed, _ = with_row_key(docs.select(*named([id_col, "text"])).toDF("id", "text"), "id")
    out = row_groups(keyed, k, percent, m, rows, block)
    null = F.lit(NULL_ID)
    return out.select(F.nullif("doc", null).alias(id_col), "n_shingles", F.nullif("component_id", null).alias("component_id"), (F.col("doc") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each group: the first document's. Of equal rows of one id one stays, of differing ones beside equal texts any."""
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), F.col("text").alias("text"), *named([id_col])).toDF("row", "text", "id")
    keyed, several = with_row_key(rows, "id")
    later = row_groups(keyed, **options).where("doc <> component_id or ord <> component_ord").select(F.col("doc").alias("_doc"), F.col("ord").alias("_ord")).distinct()
    left = keyed.join(_small(cut(later)), ["_doc", "_ord"], "left_anti")
    if several:
        left = left.where("_ord = 0").unionByName(left.where("_ord <> 0").dropDuplicates(["_doc", "_ord"]))
    return left.select("row.*")
