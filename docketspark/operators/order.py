"""Sort orders and pages. Every order ends with the record's id, so it is total and stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_sort_key
from ..functions.text import CASE_PATTERN, let, natural_sort_key, strip
from .sizing import broadcast_if_small, materialize


def case_sort_key(c: Column) -> Column:
    """struct(prefix, number, year); empty texts come first, texts of another form by themselves with zeros."""

    def key(t: Column) -> Column:
        match = t.rlike(CASE_PATTERN)
        part = lambda i: F.split_part(t, F.lit("/"), F.lit(i))
        return F.struct(
            F.when(t.isin("", "-"), "").when(match, part(1)).otherwise(c).alias("prefix"),
            F.when(match, part(2).try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"),
            F.when(match, part(3).try_cast("int")).otherwise(0).alias("year"),
        )

    return let(strip(F.coalesce(c, F.lit(""))), key)


def sort_key(field: str) -> Column:
    if field == "case_number":
        return case_sort_key(F.col(field))
    return date_sort_key(F.col(field)) if field == "hearing_date" else natural_sort_key(F.col(field).cast("string"))


def ordered(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """df in the order of keys, each a column and whether it is turned.

    The keys are columns before the sort, once a row: Spark works an expression in a sort order out again in each comparison.
    """
    taken = {c.lower() for c in df.columns}
    names = [n for n in (f"_key_{i}" for i in range(len(taken) + len(keys))) if n not in taken][: len(keys)]
    keyed = df.select("*", *(k.alias(n) for n, (k, _) in zip(names, keys, strict=True)))
    return keyed.orderBy(*(F.col(n).desc() if turned else F.col(n).asc() for n, (_, turned) in zip(names, keys, strict=True))).drop(*names)


def _ordered(df: DataFrame, field: str, reverse: bool, id_col: str) -> DataFrame:
    return ordered(df, [(sort_key(field), reverse), (F.col(id_col), False)])


def sort_by_case_number(df: DataFrame, reverse: bool = False, id_col: str = "record_id") -> DataFrame:
    """Equal case numbers stay in input order in both directions."""
    return _ordered(df, "case_number", reverse, id_col)


def sort_by_date(df: DataFrame, reverse: bool = False, id_col: str = "record_id") -> DataFrame:
    """Empty and unreadable dates come last, or first in reverse."""
    return _ordered(df, "hearing_date", reverse, id_col)


def sort_by_party_name(df: DataFrame, reverse: bool = False, id_col: str = "record_id") -> DataFrame:
    return _ordered(df, "party_name", reverse, id_col)


def _field_keys(order: list[tuple[str, bool]], per_field: bool, id_col: str) -> list[tuple[Column, bool]]:
    if per_field:
        return [*((sort_key(f), r) for f, r in order), (F.col(id_col), False)]
    turned = sum(r for _, r in order) % 2 == 1
    return [*((sort_key(f), turned) for f, _ in order), (F.col(id_col), turned)]


def field_orders(order: list[tuple[str, bool]], per_field: bool = False, id_col: str = "record_id") -> list[Column]:
    """Sort columns of (field, reverse) pairs. Each true flag turns the whole list, ties included, so an odd number of
    them turns everything; with per_field each flag acts on its own field."""
    return [k.desc() if turned else k.asc() for k, turned in _field_keys(order, per_field, id_col)]


def sort_by_fields(df: DataFrame, order: list[tuple[str, bool]] | None = None, per_field: bool = False, id_col: str = "record_id") -> DataFrame:
    return ordered(df, _field_keys(order or [("case_number", False)], per_field, id_col))


def mode_keys(mode: str = "prefix_number_year") -> list[Column]:
    """Sort keys of a mode: prefix_number_year, number_only or original (none)."""
    key = case_sort_key(F.col("case_number"))
    modes = {"prefix_number_year": [key], "number_only": [key["number"]], "original": []}
    if mode not in modes:
        raise ValueError(f"unknown sort mode: {mode}")
    return modes[mode]


def mode_orders(mode: str = "prefix_number_year", id_col: str = "record_id") -> list[Column]:
    """Sort columns of a mode."""
    return [*(k.asc() for k in mode_keys(mode)), F.col(id_col).asc()]


def sort_by_mode(df: DataFrame, mode: str = "prefix_number_year", id_col: str = "record_id") -> DataFrame:
    return ordered(df, [*((k, False) for k in mode_keys(mode)), (F.col(id_col), False)])


def ranked(keys: DataFrame, group: list[str], orders: list[Column], name: str) -> DataFrame:
    """keys with name, the place from 1 on of each row in its group; a group of any size is sorted by many tasks.

    Rows are dealt by ranges of group and order; a row's place is its place in its range and group, and how many rows of the
    group the ranges before it hold. Give it narrow rows with the columns of the orders: they are written to the shared folder before
    ranges are drawn, which read the rows twice, so what the order depends on is worked out once.
    """
    held = materialize(keys)
    ranged = materialize(held.repartitionByRange(*(F.col(g) for g in group), *orders).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *group).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    placed = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_part", *group).orderBy(*orders)).cast("long"))
    return placed.join(broadcast_if_small(offsets), ["_part", *group]).withColumn(name, F.col(name) + F.col("_before")).select(*keys.columns, name)


def group_and_sort(df: DataFrame, group_field: str, sort_field: str = "case_number", id_col: str = "record_id") -> DataFrame:
    """df with group_value and pos, the place in the group; rows stay flat. id_col must tell the rows apart.

    Only the group, the sorted field's key and the id are dealt and written; places are joined back by id.
    """
    value = F.coalesce(F.col(group_field).cast("string"), F.lit("unknown")) if group_field in df.columns else F.lit("unknown")
    out = df.withColumn("group_value", value)
    keys = out.select(F.col("group_value"), sort_key(sort_field).alias("_key"), F.col(id_col).alias("_id"))
    places = ranked(keys, ["group_value"], [F.col("_key").asc(), F.col("_id").asc()], "pos").select("_id", "pos")
    return out.join(places, F.col(id_col) == F.col("_id")).drop("_id")


def with_position(df: DataFrame, orders: list[Column], columns: list[str] | None = None, id_col: str = "record_id") -> DataFrame:
    """df with position, the place from 1 on of each row in a total order.

    With columns, the id and those that the order reads, only these are dealt and written, and places are joined back by id, which must tell
    the rows apart.
    """
    narrow = df.select(*(F.col(f"`{c}`") for c in columns or df.columns), F.lit(0).alias("_all"))
    places = ranked(narrow, ["_all"], orders, "position").drop("_all")
    if columns is None:
        return places
    return df.join(places.select(id_col, "position"), id_col).select(*(F.col(f"`{c}`") for c in df.columns), "position")


def page(df: DataFrame, limit: int = 100, offset: int = 0, id_col: str = "record_id") -> DataFrame:
    """A page in id order; a top-k, not a full sort."""
    return df.orderBy(id_col).offset(offset).limit(limit)


def page_counts(df: DataFrame, page_size: int = 20) -> DataFrame:
    """(total, pages) of one row."""
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / page_size).alias("pages"))
