"""Name comparison in tiers, cross-script scores, and blocked registry screening."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import similarity as sim
from attesta.functions import text
from attesta.functions.phonetic import arabic_to_latin, code
from attesta.sources.tables import materialise


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few bytes, much work: spread by count, since Spark would merge such partitions by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ratios(strings: DataFrame) -> DataFrame:
    """``x``, ``y`` and their ``ratio``, each distinct pair of strings once: all that Python sees of names."""
    return _spread(strings.select("x", "y").distinct(), "x", "y").withColumn("ratio", F.when(F.col("x") == F.col("y"), 1.0).otherwise(sim.similarity_ratio("x", "y")))


def fuzzy_scores(pairs: DataFrame, language: str) -> DataFrame:
    """``_a``, ``_b`` and ``_s`` of distinct pairs of normalised names.

    Tokens pair up greedily, one to one; the score is the share that pairs up times their mean score. English tokens
    score higher where their phonetic codes agree or nearly agree, and the whole strings or whole codes
    count if they agree better. Strings are compared once for each distinct pair of tokens, codes or names; what is made of
    the ratios, the pairing included, stays in the plan. ``pairs`` is read several times; let it be a stored table.
    """
    english = language == "english"
    at_least = 0.65 if english else 0.75
    held = pairs.select("_a", "_b", text.tokens(F.col("_a")).alias("_ta"), text.tokens(F.col("_b")).alias("_tb"))
    each = held.select("_a", "_b", F.posexplode("_ta").alias("_i", "_u"), "_tb").select("_a", "_b", "_i", "_u", F.posexplode("_tb").alias("_j", "_v"))
    met = each.select("_u", "_v").distinct()
    spoken = lambda c: code(F.col(c), True)
    met = met.withColumn("_cu", spoken("_u")).withColumn("_cv", spoken("_v")) if english else met
    both = (F.col("_cu") != "") & (F.col("_cv") != "") if english else None
    as_pair = lambda df, x, y: df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    strings = as_pair(met, "_u", "_v")
    if english:
        whole = held.select("_a", "_b", spoken("_a").alias("_wa"), spoken("_b").alias("_wb"))
        strings = strings.union(as_pair(met.where(both), "_cu", "_cv")).union(as_pair(whole, "_a", "_b")).union(as_pair(whole.where("_wa <> '' AND _wb <> ''"), "_wa", "_wb"))
    found = materialise(ratios(strings), "ratios")

    def with_ratio(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
        r = found.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("ratio").alias(out))
        return df.join(r, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left").drop("_x", "_y")

    scored, plain = with_ratio(met, "_u", "_v", "_plain"), F.col("_plain")
    score = plain
    if english:
        scored = with_ratio(scored, "_cu", "_cv", "_near")
        score = F.when(~both, plain).when(F.col("_cu") == F.col("_cv"), F.greatest(plain, F.lit(sim.PHONETIC_FLOOR))).when(F.col("_near") >= sim.PHONETIC_NEAR, F.greatest(plain, 0.6 * plain + 0.4 * F.col("_near"))).otherwise(plain)
    scored = scored.select("_u", "_v", score.alias("_score")).where(F.col("_score") >= at_least)
    options = each.join(scored, ["_u", "_v"]).groupBy("_a", "_b").agg(F.collect_list(F.struct(F.col("_i").alias("i"), (-F.col("_score")).alias("less"), F.col("_j").alias("j"))).alias("_options"))
    best = F.expr(sim.paired("_options", at_least))
    chosen = options.select("_a", "_b", best["n"].alias("_n"), best["total"].alias("_total"))
    share = F.when(F.col("_n") > 0, F.col("_n") / F.greatest(F.size(text.tokens(F.col("_a"))), F.size(text.tokens(F.col("_b")))) * (F.col("_total") / F.col("_n"))).otherwise(0.0)
    out = held.select("_a", "_b").join(chosen, ["_a", "_b"], "left").withColumn("_s", F.coalesce(share, F.lit(0.0)))
    if english:
        out = with_ratio(with_ratio(out.join(whole, ["_a", "_b"]), "_a", "_b", "_r1"), "_wa", "_wb", "_r2")
        out = out.withColumn("_s", F.greatest("_s", F.coalesce("_r1", F.lit(0.0)), F.coalesce("_r2", F.lit(0.0))))
    return out.select("_a", "_b", "_s")


def compare_all(rows: DataFrame, wanted: list[tuple[str, str, str, str]]) -> DataFrame:
    """Add a score and ``<score>_tier`` for each wanted (first name, second name, language, score).

    Tiers are exact, token_set, fuzzy or none. Only pairs that are fuzzy go to :func:`fuzzy_scores`: one scan
    gathers the distinct ones of all wanted columns, and they are scored once for each language.
    """
    columns = rows.columns
    for k, (a, b, language, out) in enumerate(wanted):
        normal = text.arabic_name if language == "arabic" else text.english_name
        rows = rows.withColumn(f"_a{k}", normal(F.col(a))).withColumn(f"_b{k}", normal(F.col(b)))
        x, y = F.col(f"_a{k}"), F.col(f"_b{k}")
        tier = F.when((x == "") | (y == ""), "none").when(x == y, "exact").when(text.same_token_set(text.tokens(x), text.tokens(y)), "token_set").otherwise("fuzzy")
        rows = rows.withColumn(f"{out}_tier", F.coalesce(tier, F.lit("fuzzy")))
    each = [F.when(F.col(f"{out}_tier") == "fuzzy", F.struct(F.lit(language).alias("language"), F.col(f"_a{k}").alias("_a"), F.col(f"_b{k}").alias("_b"))) for k, (_, _, language, out) in enumerate(wanted)]
    hard = rows.select(F.inline(F.filter(F.array(*each), lambda p: p.isNotNull()))).where("_a IS NOT NULL AND _b IS NOT NULL").distinct()
    hard = materialise(hard, "name-pairs")
    scores = {language: materialise(fuzzy_scores(hard.where(F.col("language") == language).drop("language"), language), "name-scores") for language in {w[2] for w in wanted}}
    for k, (_, _, language, out) in enumerate(wanted):
        found = scores[language].select(F.col("_a").alias("_first"), F.col("_b").alias("_second"), F.col("_s").alias("_found"))
        rows = rows.join(found, (F.col(f"_a{k}") == F.col("_first")) & (F.col(f"_b{k}") == F.col("_second")) & (F.col(f"{out}_tier") == "fuzzy"), "left")
        score = F.when(F.col(f"{out}_tier").isin("exact", "token_set"), 1.0).when(F.col(f"{out}_tier") == "none", 0.0).otherwise(F.col("_found"))
        rows = rows.withColumn(out, score).drop("_first", "_second", "_found")
    return rows.select(*columns, *(c for _, _, _, out in wanted for c in (f"{out}_tier", out)))


def compare(pairs: DataFrame, a: str, b: str, language: str, out: str = "name_score") -> DataFrame:
    """Add ``out`` and ``<out>_tier`` (see :func:`compare_all`)."""
    return compare_all(pairs, [(a, b, language, out)])


def decision(score: Column, pass_at: float | Column = 0.90, review_at: float | Column = 0.70) -> Column:
    return F.when(score >= pass_at, "pass").when(score >= review_at, "manual_review").otherwise("reject")


def validate(pairs: DataFrame, confidence: str = "confidence", pass_at: float = 0.90, review_at: float = 0.70) -> DataFrame:
    """Two-language decision over (extracted_ar, typed_ar, extracted_en, typed_en, confidence).

    Where the English names are missing or disagree, the Arabic one is romanised and compared with the
    typed English one; that score joins the mean if nothing else does or if it exceeds 0.8.
    """
    given = lambda *cs: [F.coalesce(F.col(c), F.lit("")) != "" for c in cs]
    rows = pairs.withColumn("_latin", arabic_to_latin(F.col("extracted_ar")))
    rows = compare_all(rows, [("extracted_ar", "typed_ar", "arabic", "_ar"), ("extracted_en", "typed_en", "english", "_en"), ("_latin", "typed_en", "english", "_x")])
    (ea, ta), (ee, te) = given("extracted_ar", "typed_ar"), given("extracted_en", "typed_en")
    arabic, english = F.when(ea & ta, F.col("_ar")), F.when(ee & te, F.col("_en"))
    cross = F.when(ea & te & (english.isNull() | ((english < pass_at) & arabic.isNull())), F.col("_x"))
    cross = F.when((arabic.isNull() & english.isNull()) | (cross > 0.8), cross)
    known = F.filter(F.array(arabic, english, cross), lambda s: s.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(known), F.lit(0))
    final = F.coalesce(mean, F.lit(0.0)) * F.col(confidence)
    verdict = F.when(F.size(known) == 0, "manual_review").otherwise(decision(final, pass_at, review_at))
    return rows.select(*pairs.columns, F.coalesce(mean, F.lit(0.0)).alias("combined_score"), final.alias("final_score"), verdict.alias("decision"))


def cross_script(pairs: DataFrame, a: str, b: str, arabic_weight: float = 0.7, latin_weight: float = 0.3) -> DataFrame:
    """Add ``arabic_similarity``, ``phonetic_similarity``, ``token_overlap`` and ``similarity``."""
    bridge = lambda c: F.when(text.has_arabic(F.col(c)), arabic_to_latin(F.col(c))).when(text.has_latin(F.col(c)), text.latin(F.col(c)))
    toks = lambda c: F.when(text.has_arabic(F.col(c)), text.arabic_tokens(F.col(c))).otherwise(text.latin_tokens(F.col(c)))
    once = pairs.select(a, b).distinct()
    once = once.withColumn("_ta", toks(a)).withColumn("_tb", toks(b))
    once = once.withColumn("_ca", code(text.latin(F.coalesce(bridge(a), F.lit(""))))).withColumn("_cb", code(text.latin(F.coalesce(bridge(b), F.lit("")))))
    both = text.has_arabic(F.col(a)) & text.has_arabic(F.col(b))
    once = once.select(a, b, both.alias("_both"), sim.best_match_mean("_ta", "_tb").alias("_best"), F.expr(sim.jaro_winkler("_ca", "_cb")).alias("phonetic_similarity"), sim.token_overlap("_ta", "_tb").alias("token_overlap"))
    arabic = F.when(F.col("_both"), F.col("_best")).otherwise(0.0)
    final = F.when(F.col("_both"), arabic_weight * arabic + latin_weight * F.col("phonetic_similarity")).otherwise(F.col("phonetic_similarity"))
    once = once.select(F.col(a).alias("_ka"), F.col(b).alias("_kb"), arabic.alias("arabic_similarity"), "phonetic_similarity", "token_overlap", final.alias("similarity"))
    return pairs.join(once, F.col(a).eqNullSafe(F.col("_ka")) & F.col(b).eqNullSafe(F.col("_kb"))).drop("_ka", "_kb")


def _facts(names: DataFrame, language: str) -> DataFrame:
    """What scores need of each distinct name ``n``, worked out once: tokens, their codes, the whole code."""
    shown = arabic_to_latin(F.col("n")) if language == "arabic" else F.col("n")
    rows = names.select("n", text.tokens(F.col("n")).alias("words"), F.transform(text.tokens(shown), lambda t: code(t, True)).alias("each"), code(F.col("n"), True).alias("whole"))
    return rows.withColumn("codes", F.array_distinct(F.filter("each", lambda c: c != ""))).withColumn("kinds", F.array_sort(F.array_distinct("words")))


def _reach(a: str, b: str) -> Column:
    """The most that any of the fuzzy scores of two names can come to, by lengths and token counts alone."""
    def bound(x: Column, y: Column) -> Column:
        return 2 * F.least(x, y) / F.greatest(x + y, F.lit(1))

    size = lambda c, of: (of(f"{a}.{c}"), of(f"{b}.{c}"))
    n, m = size("words", F.size)
    return F.greatest(bound(*size("n", F.length)), bound(*size("whole", F.length)), F.least(n, m) / F.greatest(n, m))


def screen(queries: DataFrame, registry: DataFrame, language: str = "english", at_least: float = 0.85, hot: int = 10_000, best_only: bool = True) -> DataFrame:
    """Registry names that match query names: (query_id, registry_id, score, tier).

    ``queries``: query_id, name; ``registry``: registry_id, name. Names that share a phonetic code of a
    token are candidates. Equal names are collapsed first, so a block holds distinct names only. The names
    of a code that more than ``hot`` of them carry are dealt to salts of about ``hot`` names, each of which
    meets the queries of that code. Candidates are scored once for each distinct pair of names. The best
    name of a query is chosen among distinct names, of equal ones that with the smallest registry id; rows
    are joined to it only then.
    """
    normal = text.arabic_name if language == "arabic" else text.english_name

    def coded(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        named = df.select(key, normal(F.col("name")).alias("n")).where("n <> ''")
        return named, _facts(named.select("n").distinct(), language)

    q_rows, q_names = coded(queries, "query_id")
    r_rows, r_names = coded(registry, "registry_id")
    q, r = (names.select(F.col("n").alias(x), F.explode("codes").alias("code")) for names, x in ((q_names, "qn"), (r_names, "rn")))
    hot_codes = r.groupBy("code").count().where(F.col("count") > hot).select(F.col("code").alias("hot_code"), F.ceil(F.col("count") / hot).alias("salts"))

    def salted(side: DataFrame, name: str, every_salt: bool) -> DataFrame:
        n = F.coalesce("salts", F.lit(1))
        salt = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)) if every_salt else F.pmod(F.xxhash64(name), n)
        return side.join(hot_codes, F.col("code") == F.col("hot_code"), "left").select(name, "code", salt.alias("salt"))

    pairs = salted(q, "qn", True).join(salted(r, "rn", False), ["code", "salt"]).select("qn", "rn").distinct()
    as_one = lambda df, name: df.select(F.col("n").alias(f"_{name}"), F.struct(*df.columns).alias(name))
    met = pairs.join(as_one(r_names, "a"), F.col("rn") == F.col("_a")).join(as_one(q_names, "b"), F.col("qn") == F.col("_b"))
    tier = F.when(F.col("rn") == F.col("qn"), "exact").when(F.col("a.kinds") == F.col("b.kinds"), "token_set").otherwise("fuzzy")
    met = met.select("qn", "rn", "a", "b", tier.alias("tier"))
    hard = _spread(met.where((F.col("tier") == "fuzzy") & (_reach("a", "b") >= at_least)), "qn", "rn")
    if language == "arabic":
        score = sim.arabic_fuzzy("rn", "qn")
    else:
        score = sim.english_above(at_least)("rn", "qn", F.col("a.each"), F.col("b.each"), F.col("a.whole"), F.col("b.whole"))
    scored = hard.select("qn", "rn", score.alias("score"), "tier").where(F.col("score") >= at_least)
    scored = scored.unionByName(met.where(F.col("tier") != "fuzzy").select("qn", "rn", F.lit(1.0).alias("score"), "tier"))
    if best_only:
        least = r_rows.groupBy("n").agg(F.min("registry_id").alias("registry_id"))
        nth = F.row_number().over(Window.partitionBy("qn").orderBy(F.col("score").desc(), "registry_id"))
        found = scored.join(least, F.col("rn") == least["n"]).drop("n").withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    else:
        found = scored.join(r_rows, F.col("rn") == r_rows["n"]).drop("n")
    return found.join(q_rows, F.col("qn") == q_rows["n"]).select("query_id", "registry_id", "score", "tier")


@F.pandas_udf(T.StructType([T.StructField("tier", T.StringType()), T.StructField("score", T.DoubleType())]))
def name_compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Tier and score of two names that are already normalised, for SQL."""
    rows = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        if not x or not y:
            rows.append(("none", 0.0))
        elif x == y:
            rows.append(("exact", 1.0))
        elif set(x.split()) == set(y.split()):
            rows.append(("token_set", 1.0))
        else:
            rows.append(("fuzzy", max(sim.fuzzy(x, y, 0.75), 0.0)))
    return pd.DataFrame(rows, columns=["tier", "score"])
