"""Hierarchical policy: leaves scored against thresholds, categories rolled up, one decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

PARTS = ("min", "max", "status")


def active_config(configs: DataFrame, id_col: str = "id") -> DataFrame:
    """The newest wide configuration row as long rows (component, min, max, status); defaults if none.

    The wide row has ``<component>_min``, ``<component>_max``, ``<component>_status`` columns. A missing
    or null status counts as enabled, missing points as 0.
    """
    spark = configs.sparkSession
    tree = [r[0] for r in rules.POLICY]

    def part(component: str, name: str) -> Column:
        column = f"{component}_{name}"
        if column not in configs.columns:
            return F.lit(True) if name == "status" else F.lit(0.0)
        if name == "status":
            return F.coalesce(F.col(column).cast("boolean"), F.lit(True))
        return F.coalesce(F.col(column).cast("double"), F.lit(0.0))

    newest = configs.orderBy(F.col(id_col).desc()).limit(1)
    rows = [F.struct(F.lit(c).alias("component"), *(part(c, p).alias(p) for p in PARTS)) for c in tree]
    found = newest.select(F.inline(F.array(*rows)))
    fallback = rules.policy_defaults(spark).join(F.broadcast(found.limit(1).select(F.lit(1).alias("_one"))), F.lit(True), "left").where("_one IS NULL").drop("_one")
    return found.unionByName(fallback)


def threshold(low: Column, high: Column) -> Column:
    return F.when(high == 0, 0.0).otherwise(low / high * 100)


def components(scores: DataFrame, config: DataFrame, subject: str = "subject") -> DataFrame:
    """One row for each subject and component: threshold, score (percent), points, passed.

    ``scores`` is long: subject, ``score_key``, ``raw`` (0 to 1). Missing scores are 0; disabled
    components give no points and pass. The tree has a fixed depth, so two group-bys roll it up. Points are
    added in the tree's order, whatever the order of rows: a total on a limit must not hang on a sum's last bit.
    """
    dim = F.broadcast(rules.policy_tree(scores.sparkSession).join(config, "component"))
    subjects = scores.select(subject).distinct()

    def nodes_of(level: int) -> DataFrame:
        """A row for each subject and component of a level of the fixed tree."""
        names = F.array(*(F.lit(r[0]) for r in rules.POLICY if r[3] == level))
        return subjects.select(subject, F.explode(names).alias("component")).join(dim, "component")

    grid = nodes_of(0)
    raw = scores.groupBy(subject, "score_key").agg(F.max("raw").alias("raw"))
    leaves = grid.join(raw, [subject, "score_key"], "left")
    percent = F.coalesce("raw", F.lit(0.0)) * 100
    limit = threshold(F.col("min"), F.col("max"))
    leaves = leaves.select(
        subject, "component", "parent", "level", "min", "max", "status",
        F.when(F.col("status"), limit).otherwise(0.0).alias("threshold"),
        F.when(F.col("status"), percent).otherwise(0.0).alias("score"),
        F.when(F.col("status"), percent / 100 * F.col("max")).otherwise(0.0).alias("points"),
        (~F.col("status") | (percent >= limit)).alias("passed"),
    )

    def roll_up(children: DataFrame, level: int) -> DataFrame:
        each = [F.coalesce(F.sum(F.when(F.col("component") == r[0], F.col("points"))), F.lit(0.0)) for r in rules.POLICY if r[3] == level - 1]
        sums = children.groupBy(subject, F.col("parent").alias("component")).agg(reduce(lambda a, b: a + b, each).alias("given"))
        nodes = nodes_of(level).join(sums, [subject, "component"], "left")
        given = F.least(F.coalesce("given", F.lit(0.0)), F.col("max"))
        return nodes.select(
            subject, "component", "parent", "level", "min", "max", "status",
            F.when(F.col("status"), limit).otherwise(0.0).alias("threshold"),
            F.when(F.col("status") & (F.col("max") > 0), given / F.col("max") * 100).otherwise(0.0).alias("score"),
            F.when(F.col("status"), given).otherwise(0.0).alias("points"),
            (~F.col("status") | (given >= F.col("min"))).alias("passed"),
        )

    categories = roll_up(leaves, 1)
    return leaves.unionByName(categories).unionByName(roll_up(categories, 2))


def rounded(number: Column, places: int) -> Column:
    """A number to so many places, halves up, as a decimal: what float sums leave below 1e-9 does not count."""
    return F.round(number.cast("decimal(20,9)"), places)


def decide(found: DataFrame, subject: str = "subject") -> DataFrame:
    """Decision, total, and the reasons of components that failed, by subject."""
    one = lambda *names: [rounded(F.col(n), 1).cast("string") for n in names]
    reason = F.when(
        ~F.col("passed") & (F.col("level") == 0),
        F.format_string("%s: score %s%% < threshold %s%% (got %s/%s pts, need %s)", "component", *one("score", "threshold", "points"), "max", "min"),
    ).when(~F.col("passed"), F.format_string("%s: %s/%s pts (min required: %s)", "component", *one("points"), "max", "min"))
    root = F.col("component") == "ekyc"
    total, on = F.max(F.when(root, F.col("points"))), F.max(F.when(root, F.col("status")))
    per = found.groupBy(subject).agg(
        total.alias("total_score"), F.max(F.when(root & F.col("status"), F.col("max")).otherwise(0.0)).alias("max_possible"), on.alias("_on"),
        F.array_sort(F.collect_list(reason)).alias("reasons"),
    )
    decision = F.when(~F.col("_on"), "APPROVED").when(F.col("total_score") > 90, "APPROVED").when(F.col("total_score") >= 50, "MANUAL_REVIEW").otherwise("REJECTED")
    return per.select(subject, decision.alias("decision"), "total_score", "max_possible", F.when(F.col("_on"), F.col("reasons")).otherwise(F.array(F.lit("EKYC disabled"))).alias("reasons"))


def wide_log(found: DataFrame, subject: str = "subject") -> DataFrame:
    """One wide row for each subject with five columns for each component."""
    names = [r[0] for r in rules.POLICY]
    wide = found.groupBy(subject).pivot("component", names).agg(
        F.first("min").alias("min"), F.first("max").alias("max"), F.first("status").alias("status"), F.first("threshold").alias("threshold"), F.first("score").alias("score")
    )
    return wide.withColumn("log_id", F.uuid())


def result_document(decided: DataFrame, found: DataFrame, subject: str = "subject") -> DataFrame:
    """The decision with its rounded components as one JSON text."""
    two = lambda name: rounded(F.col(name), 2).cast("double")
    entry = F.struct(F.col("component"), F.struct(two("threshold").alias("threshold"), two("score").alias("score"), two("points").alias("score_obtained"), "passed"))
    parts = found.groupBy(subject).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("components"))
    joined = decided.join(parts, subject)
    return joined.select(subject, F.to_json(F.struct("decision", two("total_score").alias("total_score"), "components", "reasons")).alias("document"))


def dynamic_config(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """``key``, ``value``, ``is_override``: an override wins if it casts to the default's kind.

    ``defaults``: key, value, kind (``int``, ``float``, ``bool``, ``str``); ``overrides``: key, value.
    """
    o = overrides.select("key", F.col("value").alias("_new"))
    text = F.trim("_new")
    fits = (
        F.when(F.col("kind") == "int", F.expr("try_cast(_new AS BIGINT)").isNotNull())
        .when(F.col("kind") == "float", F.expr("try_cast(_new AS DOUBLE)").isNotNull())
        .otherwise(F.col("_new").isNotNull())
    )
    boolean = F.lower(text).isin("true", "1", "yes", "on").cast("string")
    value = F.when(fits, F.when(F.col("kind") == "bool", boolean).otherwise(F.col("_new"))).otherwise(F.col("value"))
    return defaults.join(o, "key", "left").select("key", value.alias("value"), F.coalesce(fits & F.col("_new").isNotNull(), F.lit(False)).alias("is_override"))
