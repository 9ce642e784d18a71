"""Mixing sources to target weights.

Words are counted per source; each source gets a share of all words by its weight, but at most ``max_rate`` times its
own size, and what is above that goes to the others by weight until none is above. A source's rate is its target over
its size. A document is taken floor(rate) times, plus once more when a hash of its id, its text and the seed, read as a number
in [0, 1), is below the fraction of the rate: reruns agree whatever the partitioning.

Sources are ordered by code point, null last, and weigh ``weights`` in turn. Null and empty texts have no words. A source
without words has rate 0. Rows sharing an id, or without one, are drawn each by its text; equal rows are drawn alike. Other columns stay as they are, and
a new column whose name is taken gets _ behind. The table of sources, one narrow row each, is ordered in one task; the
documents are not. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import free_name, named

WEIGHTS = (5, 2, 1)
#: sources whose targets may be broadcast, about 50 bytes each
BROADCAST_SOURCES = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: float = 3.0) -> DataFrame:
    """(source, source_size, target) of (source, size) rows; one row a source, its rank and sums over that small table.

    Handing the excess on until none is above ends where every source has min(cap, level * weight) for one level;
    in the order of cap / weight, the capped sources come first, and the first source whose cap is not below
    its share of the rest sets the level.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_rate))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    shared = ranked.withColumn("share", share)
    level = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "share"))).over(everything)["share"]
    return shared.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))).alias("target"))


def _taken(docs: DataFrame, id_col: str, weights: Sequence[int], max_rate: float, seed: int) -> DataFrame:
    """(row: all columns of docs, id, size, source_size, target, copies)."""
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), *named([id_col, "source", "text"])).toDF("row", "id", "source", "text")
    sized = rows.select("row", "id", "source", n_words().alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    targets = source_targets(sized.select("source", "size"), weights, max_rate).withColumnRenamed("source", "_source")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets, sized.source.eqNullSafe(targets._source), "left").drop("_source", "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = unit_hash(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest"), F.lit(str(seed))) < rate - F.floor(rate)
    return joined.withColumn("copies", F.floor(rate) + extra.cast("long")).drop("digest")


def copies(docs: DataFrame, id_col: str = "doc_id", weights: Sequence[int] = WEIGHTS, max_rate: float = 3.0, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document)."""
    new = ("size", "source_size", "target", "copies")
    names = [free_name(c, docs.columns) for c in new]
    return _taken(docs, id_col, weights, max_rate, seed).select("row.*", *new).toDF(*docs.columns, *names)


def mix(docs: DataFrame, id_col: str = "doc_id", weights: Sequence[int] = WEIGHTS, max_rate: float = 3.0, seed: int = 0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with a copy number, copy, from 1 on."""
    taken = _taken(docs, id_col, weights, max_rate, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("number")).select("row.*", "number").toDF(*docs.columns, free_name("copy", docs.columns))


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return _taken(docs, "doc_id", WEIGHTS, 3.0, 0).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 3.0::DOUBLE AS cap FROM ranked),
shared AS (SELECT *, (sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed),
level AS (SELECT arg_min(share, (cap / weight, rank)) AS level FROM shared WHERE share * weight <= cap),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM shared, level),
rated AS (SELECT doc_id, digest, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest || '|0'), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
