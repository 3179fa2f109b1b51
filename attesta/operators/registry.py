"""Registry tables as immutable states: upsert, insert, patch, delete, lookup, history, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import split_name
from attesta.sources.tables import materialise


def _matches(keys: list[str], left: str = "l", right: str = "r") -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return same


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; ties by the whole row, so reruns agree. Aggregated before the shuffle, so a key of
    very many rows costs no task more than others."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    last = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return last.select(*(c if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns))


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], order: str, keep_if_null: list[str]) -> DataFrame:
    """The new state: updated rows take the update's values, but keep what ``keep_if_null`` lacks.

    Only the last update of each key counts. One full outer join on the keys.
    """
    last = newest(updates, keys, order)
    both = current.alias("l").join(last.alias("r"), _matches(keys), "full_outer")
    hit = F.col(f"r.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        if c in keys or c in keep_if_null:
            return F.coalesce(f"r.{c}", f"l.{c}")
        return F.when(hit, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")) if c in last.columns else F.col(f"l.{c}")

    return both.select(*(value(c).alias(c) for c in current.columns))


def full_name(name: Column, *parts: Column) -> Column:
    """The whole name, or its parts put together."""
    joined = F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))
    return F.coalesce(F.nullif(name, F.lit("")), joined)


def insert_new(current: DataFrame, rows: DataFrame, keys: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Append rows whose keys are new, each key once, with defaults for what is missing."""
    fresh = rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    for c, v in (defaults or {}).items():
        fresh = fresh.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return current.unionByName(fresh.select(*current.columns))


def patch(current: DataFrame, changes: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """Overwrite allowed columns of existing keys by the values that are given (not null)."""
    fields = [c for c in allowed if c in changes.columns]
    joined = current.alias("l").join(changes.select(*keys, *fields).alias("r"), _matches(keys), "left")
    return joined.select(*(F.coalesce(f"r.{c}", f"l.{c}").alias(c) if c in fields else F.col(f"l.{c}").alias(c) for c in current.columns))


def save_or_update(current: DataFrame, rows: DataFrame, keys: list[str], allowed: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Existing keys are patched, new ones inserted."""
    return insert_new(patch(current, rows, keys, allowed), rows, keys, defaults)


def lookup(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(wanted.select(*keys).distinct(), keys, "left_semi")


def missing(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(table.select(*keys), keys, "left_anti")


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def with_split_names(rows: DataFrame, name: str, suffix: str) -> DataFrame:
    s = split_name(F.col(name))
    return rows.withColumns({f"{p}_name_{suffix}": s[p] for p in ("first", "middle", "last")})


def verification_rows(rows: DataFrame, now: Column) -> DataFrame:
    """Rows to append: ``verified_at`` only where the status says so."""
    return rows.withColumn("verified_at", F.when(F.col("status") == "verified", now))


def audit_rows(rows: DataFrame, event_type: str, at: Column) -> DataFrame:
    return rows.select(F.lit(event_type).alias("event_type"), F.to_json(F.struct(*rows.columns)).alias("metadata"), at.alias("occurred_at"))


def history(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Rows numbered within each key, newest first."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())))


def verified_newest_first(rows: DataFrame, tie: str) -> DataFrame:
    """The verified rows with their ``rank``, newest first."""
    return ranked(rows.where("status = 'verified'"), [F.col("verified_at").desc(), F.col(tie).desc()])


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place (from 1) in the order of the whole table, without a task that sees all of them.

    Rows are range-partitioned and sorted, and stored with their place in their partition; the sizes of the
    partitions before, a number a partition, make it a place in the table.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the partition, then the row in it
    laid = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "ranked")
    sizes = laid.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select(F.col("_part").alias("_p"), before.alias("_before")))  # at most ``n`` rows
    return laid.join(offsets, F.col("_part") == F.col("_p")).select(*rows.columns, (F.col("_before") + F.col("_place") + 1).alias(name))


def hydrate(rows: DataFrame, json_col: str, schema: str, overlay: dict[str, str]) -> DataFrame:
    """The JSON's fields as columns, overlaid by columns that are set."""
    parsed = rows.withColumn("_j", F.from_json(json_col, schema))
    names = [f.split()[0] for f in schema.split(", ")]
    return parsed.select(*(c for c in rows.columns if c != json_col and c not in overlay), *(F.coalesce(F.col(overlay[n]) if n in overlay else F.lit(None), F.col("_j")[n]).alias(n) for n in names))


def variant_fields(rows: DataFrame, json_col: str, fields: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Columns read from JSON whose shape differs by row: ``fields`` gives for each name its type and its paths.

    The first path that holds a value of the type counts. Text that is no JSON gives nulls, and ``malformed`` tells.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(json_col))
    found = [F.coalesce(*(F.try_variant_get("_v", path, kind) for path in paths)).alias(name) for name, (kind, paths) in fields.items()]
    return parsed.select(*(c for c in rows.columns if c != json_col), *found, (F.col("_v").isNull() & F.col(json_col).isNotNull()).alias("malformed"))


def overlaid(rows: DataFrame, json_col: str, schema: str, overlay: dict[str, str], out: str = "record") -> DataFrame:
    """The JSON as a record of the schema, with nested fields (``a.b``) replaced by columns that are set."""
    record = F.from_json(json_col, schema)
    for path, column in overlay.items():
        record = record.withField(path, F.coalesce(F.col(column), _inner(F.from_json(json_col, schema), path)))
    return rows.withColumn(out, record)


def _inner(record: Column, path: str) -> Column:
    for part in path.split("."):
        record = record.getField(part)
    return record


def profile(rows: DataFrame, blobs: list[str]) -> DataFrame:
    """Rows, and for each blob column how many are set and their bytes."""
    aggregates = [F.count("*").alias("rows")]
    for b in blobs:
        aggregates += [F.count(b).alias(f"{b}_set"), F.coalesce(F.sum(F.octet_length(b)), F.lit(0)).cast("long").alias(f"{b}_bytes")]
    return rows.agg(*aggregates)


def sample(rows: DataFrame, columns: list[str], blobs: list[str], order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``order``: some columns, and the byte lengths of others."""
    return rows.orderBy(order).limit(n).select(*columns, *(F.octet_length(b).alias(f"{b}_bytes") for b in blobs))


def export_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Chosen columns in order, with a header; columns that the table lacks are left out."""
    rows.select(*(c for c in columns if c in rows.columns)).write.mode("overwrite").option("header", True).csv(path)
