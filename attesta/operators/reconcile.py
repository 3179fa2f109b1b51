"""Typed records against extracted ones: field by field, then one decision for each submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import dates
from attesta.functions.phonetic import arabic_to_latin

from . import names, places, rules

#: Fixed value: how a line about contradicting genders begins.
FRAUD_LABEL = "\u26a0\ufe0f FRAUD ALERT: "


def exact_score(a: Column, b: Column) -> Column:
    return F.when(F.upper(F.trim(a)).eqNullSafe(F.upper(F.trim(b))), 1.0).otherwise(0.0)


def gender_of_id(id_number: Column) -> Column:
    digit = F.substring(id_number, 4, 1)
    return F.when(F.length(id_number) >= 4, F.when(digit == "0", "Female").when(digit == "1", "Male"))


def gender_fraud(a: Column, b: Column, number: Column, passport: Column) -> Column:
    """A gender that contradicts the identity number's fourth digit, or a digit that stands for none."""
    expected = gender_of_id(number)
    wrong = lambda g: F.coalesce(g != expected, F.lit(False))
    return ~passport & F.coalesce(F.length(number) >= 4, F.lit(False)) & (expected.isNull() | wrong(a) | wrong(b))


def gender_score(a: Column, b: Column, number: Column, passport: Column) -> Column:
    """Plain equality for passports; otherwise whatever is given must fit the number."""
    fits = F.coalesce(F.length(number) >= 4, F.lit(False)) & ~gender_fraud(a, b, number, passport)
    return F.when(F.when(passport, a.eqNullSafe(b)).otherwise(fits), 1.0).otherwise(0.0)


def fields_of(typed: DataFrame, extracted: DataFrame, rule_table: DataFrame, key: str = "submission_id", skip_absent: bool = False) -> DataFrame:
    """Long rows (key, field, extracted, typed, confidence, rule columns) that are to be compared."""
    wanted = [r[1] for r in rules.FIELDS]
    value = lambda df, f: F.col(f"{df}.{f}").cast("string") if f in {"t": typed, "e": extracted}[df].columns else F.lit(None).cast("string")
    both = typed.alias("t").join(extracted.alias("e"), F.col(f"t.{key}") == F.col(f"e.{key}"), "full_outer")
    confidence = F.coalesce(F.col("e.confidence"), F.lit(1.0)) if "confidence" in extracted.columns else F.lit(1.0)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), value("e", f).alias("extracted"), value("t", f).alias("typed")) for f in wanted))
    number = F.coalesce(value("t", "passport_number"), value("t", "id_number"))
    long = both.select(F.coalesce(f"t.{key}", f"e.{key}").alias(key), value("t", "passport_number").isNotNull().alias("passport"), number.alias("number"), confidence.alias("confidence"), value("e", "name_arabic").alias("extracted_arabic"), F.inline(pairs))
    long = long.join(F.broadcast(rule_table), "field")
    other_number = F.when(F.col("passport"), "id_number").otherwise("passport_number")
    optional = (F.col("field") == "name_english") & ~F.col("passport") & F.col("typed").isNull()
    unfilled = F.col("typed").isNull() & F.col("extracted").isNotNull() & (F.col("severity") != "high")
    kept = long.where((F.col("field") != other_number) & ~optional & ~unfilled)
    if skip_absent:
        kept = kept.where(F.col("typed").isNotNull() | F.col("extracted").isNotNull())
    # An English name that was not extracted is romanised from the Arabic one.
    bridge = (F.col("field") == "name_english") & (F.coalesce("extracted", F.lit("")) == "") & (F.coalesce("typed", F.lit("")) != "") & (F.coalesce("extracted_arabic", F.lit("")) != "")
    return kept.withColumn("extracted", F.when(bridge, arabic_to_latin(F.col("extracted_arabic"))).otherwise(F.col("extracted"))).drop("extracted_arabic")


def compare_fields(long: DataFrame, key: str = "submission_id", kinds: tuple[str, ...] = ("exact", "date", "gender", "name_english", "name_arabic", "place")) -> DataFrame:
    """Add ``score``, ``fraud`` and ``decision``; names and places go through their own operators."""
    a, b = F.col("extracted"), F.col("typed")
    native = long.where(F.col("matching").isin("exact", "date", "gender"))
    score = F.when(F.col("matching") == "date", dates.date_score(a, b)).when(F.col("matching") == "gender", gender_score(a, b, F.col("number"), F.col("passport"))).otherwise(exact_score(a, b))
    fraud = (F.col("matching") == "gender") & gender_fraud(a, b, F.col("number"), F.col("passport")) & (a.isNotNull() | b.isNotNull())
    parts = [native.withColumn("score", score).withColumn("fraud", fraud)]
    for kind in ("name_english", "name_arabic"):
        if kind in kinds:
            rows = names.compare(long.where(F.col("matching") == kind), "extracted", "typed", kind.removeprefix("name_"), "_n").drop("_n_tier")
            parts.append(rows.withColumn("score", F.col("_n") * F.col("confidence")).drop("_n").withColumn("fraud", F.lit(False)))
    if "place" in kinds:
        rows = long.where(F.col("matching") == "place").withColumn("_row", F.col(key))
        parts.append(places.validate(rows, "_row").drop("_row", "decision", "governorate", "district").withColumn("fraud", F.lit(False)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    absent = a.isNull() & b.isNull()
    out = out.withColumn("score", F.when(absent, 0.0).otherwise(F.col("score")))
    high = F.col("severity") == "high"
    decision = (
        F.when(absent, F.when(high, "reject").otherwise("manual_review"))
        .when(F.col("fraud"), "reject")
        .when(F.col("score") >= F.col("pass_at"), "pass")
        .when(high & (F.col("score") < F.col("review_at")), "reject")
        .otherwise("manual_review")
    )
    return out.withColumn("decision", decision)


#: Scores are summed in whole units of this size, so that no order of rows changes a sum.
UNITS = 10**12


def _weighted(found: DataFrame) -> tuple[list[Column], Column, Column]:
    """Aggregates of each severity, and from them the weighted score and the weights' sum, in tenths of units.

    A severity counts with the mean of its fields; means and sums are whole numbers, halves rounded up.
    """
    units = F.round(F.col("score") * UNITS).cast("long")
    aggregates, score, weights = [], F.lit(0).cast("long"), F.lit(0).cast("long")
    for severity, weight in rules.WEIGHTS:
        mine, tenths = F.col("severity") == severity, F.lit(round(10 * weight)).cast("long")
        aggregates += [F.sum(F.when(mine, units)).alias(f"_s_{severity}"), F.count_if(mine).alias(f"_n_{severity}")]
        n = F.col(f"_n_{severity}")
        mean = F.expr(f"(_s_{severity} + _n_{severity} div 2) div _n_{severity}")
        score = score + F.when(n > 0, tenths * mean).otherwise(0)
        weights = weights + F.when(n > 0, tenths).otherwise(0)
    return aggregates, score, weights


def percent(tenths: Column) -> Column:
    """A score, in tenths of units, as a percentage with two places, halves rounded up."""
    hundredths = F.floor((tenths + 5 * UNITS // 10**4) / F.lit(10 * UNITS // 10**4)).cast("long")
    return F.format_string("%d.%02d%%", F.floor(hundredths / 100).cast("long"), F.pmod(hundredths, F.lit(100)))


def summarise(found: DataFrame, key: str = "submission_id", fraud_rejects: bool = False) -> DataFrame:
    """Counts, severity-weighted score, decision and recommendations for each submission, in one aggregation.

    Scores are exact to 1e-12 and do not depend on the order of rows, partitions or threads.
    """
    sums, score, weights = _weighted(found)
    is_ = lambda d: F.col("decision") == d
    fatal = (F.col("severity") == "high") & is_("reject") | (F.col("fraud") if fraud_rejects else F.lit(False))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "field")))), lambda x: x["field"]), ", ")
    review = {s: listed((F.col("severity") == s) & is_("manual_review")) for s in ("high", "medium", "low")}
    per = found.groupBy(key).agg(
        F.count("*").alias("total_fields"), F.count_if(is_("pass")).alias("passed_fields"), F.count_if(is_("manual_review")).alias("review_fields"), F.count_if(is_("reject")).alias("failed_fields"),
        F.bool_or(fatal).alias("_fatal"), listed(fatal).alias("_failed"), listed(fatal & F.col("fraud")).alias("_fraud"), *(v.alias(f"_{k}") for k, v in review.items()), *sums,
    ).withColumn("_score", score).withColumn("_weights", weights)
    decision = F.when(F.col("_fatal"), "rejected").when(F.col("review_fields") > 0, "manual_review").otherwise("approved")
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    lines = F.when(F.col("_fatal"), F.array(line("High-severity fields failed: ", "_failed"), line(FRAUD_LABEL, "_fraud"))).when(
        F.col("review_fields") > 0, F.array(line("High-severity borderline: ", "_high"), line("Medium-severity mismatches: ", "_medium"), line("Low-severity mismatches: ", "_low"))
    ).otherwise(F.array(F.lit("All fields meet defined thresholds")))
    advice = F.concat(F.filter(lines, lambda x: x.isNotNull()), F.array(F.concat(F.lit("Weighted matching score: "), percent(F.col("_score")))))
    overall, normalised = F.col("_score") / (10 * UNITS), F.col("_score") / F.col("_weights") / UNITS
    return per.select(key, "total_fields", "passed_fields", "review_fields", "failed_fields", overall.alias("overall_score"), normalised.alias("normalised_score"), decision.alias("overall_decision"), advice.alias("recommendations"))
