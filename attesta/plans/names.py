"""Name comparison, screening and romanisation over ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import gazetteer, romanise
from attesta.operators import names as ops

from . import duck
from .registry import ORACLES, pick, query, table

FIRST = ["Mohammed", "Muhammad", "Fatima", "Abdullah", "Khaled", "Yousef", "Sara", "Layla", "Hassan", "Nasser", "Omar"]
LAST = ["Ali", "Alsqaf", "Al-Omari", "Saleh", "Thabit", "Qasim", "Zaid"]
ARABIC = ["محمد", "فاطمة", "عبدالله", "نور", "غريب", "جميلة سالم", "", "يوسف", "الزهراني", "بشير قاسم"]
ENGLISH = {"محمد": "Mohammed", "فاطمة": "Fatima", "عبدالله": "Abdullah", "نور": "Noor", "يوسف": "Youssef", "الزهراني": "Al-Zahrani"}


_LIST = lambda names, key: "[" + ", ".join(f"'{n}'" for n in names) + f"][CAST(({key}) % {len(names)} AS INT) + 1]"
_PEOPLE = f"SELECT c_custkey, {_LIST(FIRST, 'c_custkey')} || ' ' || {_LIST(LAST, 'c_custkey // 11')} || ' ' || {_LIST(LAST, 'c_custkey // 77')} AS name, {_LIST(ARABIC, 'c_custkey')} AS arabic FROM customer"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.concat_ws(" ", pick(FIRST, "c_custkey"), pick(LAST, "c_custkey div 11"), pick(LAST, "c_custkey div 77"))
    return table(spark, sf_dir, "customer").select("c_custkey", last.alias("name"), pick(ARABIC, "c_custkey").alias("arabic"))


#: A syllable for each digit: names that are as many as the table has rows.
SYLLABLES = ["ba", "de", "ssi", "mmo", "lu", "ra", "ni", "ke", "tha", "zo"]
_SPOKEN = lambda key: f"array_to_string(list_transform(string_split(CAST({key} AS VARCHAR), ''), lambda d: [{', '.join(repr(s) for s in SYLLABLES)}][CAST(d AS INT) + 1]), '')"
#: Three neighbours share a first name; every twentieth has the commonest one, and every sixth its parts in the other order.
_CITIZENS = f"""SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN own || ' ' || given ELSE given || ' ' || own END AS name, {_LIST(ARABIC, 'c_custkey')} AS arabic
FROM (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'Mohammed' ELSE {_SPOKEN('c_custkey // 3')} END AS given, {_SPOKEN('c_custkey * 7 % 10007 + 3 * c_custkey')} AS own FROM customer)"""


def citizens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under names that differ from row to row, so that work on distinct names grows with the table."""
    k = F.col("c_custkey")
    digit = lambda d: F.element_at(F.array(*map(F.lit, SYLLABLES)), d.cast("int") + 1)
    spoken = lambda key: F.array_join(F.transform(F.filter(F.split(F.expr(key).cast("string"), ""), lambda d: d != ""), digit), "")
    given, own = F.when(k % 20 == 0, "Mohammed").otherwise(spoken("c_custkey div 3")), spoken("c_custkey * 7 % 10007 + 3 * c_custkey")
    named = F.when(k % 6 == 5, F.concat_ws(" ", own, given)).otherwise(F.concat_ws(" ", given, own))
    return table(spark, sf_dir, "customer").select(k, named.alias("name"), pick(ARABIC, "c_custkey").alias("arabic"))


_CODES = f"list_distinct(list_filter(list_transform({duck.tokens('n')}, lambda t: {duck.code('t')}), lambda c: c <> ''))"


@query(f"""WITH RECURSIVE p AS (SELECT c_custkey, {duck.english('name')} AS n, {duck.english("regexp_replace(name, 'mm', 'm', 'g')")} AS typed FROM ({_CITIZENS})),
r AS (SELECT n, min(c_custkey) AS registry_id, unnest({_CODES}) AS c FROM p WHERE n <> '' GROUP BY n), q AS (SELECT n, unnest({_CODES}) AS c FROM (SELECT DISTINCT typed AS n FROM p WHERE c_custkey % 10 = 0 AND typed <> '')),
s AS (SELECT DISTINCT r.n AS a, q.n AS b FROM r JOIN q USING (c)), {duck.compare('x', 's', 'english')},
k AS (SELECT b, score, tier, registry_id, row_number() OVER (PARTITION BY b ORDER BY score DESC, registry_id) AS nth FROM x JOIN (SELECT DISTINCT n, registry_id FROM r) ON n = a WHERE score >= 0.85)
SELECT c_custkey AS query_id, registry_id, round(score, 6) AS score, tier FROM p JOIN k ON typed = b WHERE c_custkey % 10 = 0 AND nth = 1""")
def screen_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = citizens(spark, sf_dir)
    asked = p.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("query_id"), F.regexp_replace("name", "mm", "m").alias("name"))
    found = ops.screen(asked, p.select(F.col("c_custkey").alias("registry_id"), "name"))
    return found.withColumn("score", F.round("score", 6))


_PAIRS = f"""SELECT c_custkey, nullif(arabic, '') AS ea, {_LIST(ARABIC, 'c_custkey + c_custkey % 3')} AS ta, CASE WHEN c_custkey % 2 = 0 THEN name END AS ee, regexp_replace(name, 'ss', 's', 'g') AS te, {duck.arabic_to_latin("coalesce(nullif(arabic, ''), '')")} AS latin FROM ({_CITIZENS})"""


@query(f"""WITH RECURSIVE p AS (SELECT *, {duck.arabic("coalesce(ea, '')")} AS na, {duck.arabic('ta')} AS nt, {duck.english("coalesce(ee, '')")} AS ne, {duck.english('te')} AS nte, {duck.english('latin')} AS nl FROM ({_PAIRS})),
pa AS (SELECT na AS a, nt AS b FROM p), pe AS (SELECT ne AS a, nte AS b FROM p UNION SELECT nl, nte FROM p), {duck.compare('x', 'pa', 'arabic')}, {duck.compare('y', 'pe', 'english')},
s AS (SELECT c_custkey, CASE WHEN coalesce(ea, '') <> '' AND ta <> '' THEN x.score END AS ar, CASE WHEN coalesce(ee, '') <> '' AND te <> '' THEN y.score END AS en, CASE WHEN coalesce(ea, '') <> '' AND te <> '' THEN z.score END AS cross0
  FROM p JOIN x ON x.a = na AND x.b = nt JOIN y ON y.a = ne AND y.b = nte JOIN y z ON z.a = nl AND z.b = nte),
c AS (SELECT c_custkey, ar, en, CASE WHEN (ar IS NULL AND en IS NULL) OR cr > 0.8 THEN cr END AS cr FROM (SELECT *, CASE WHEN en IS NULL OR (en < 0.9 AND ar IS NULL) THEN cross0 END AS cr FROM s)),
m AS (SELECT c_custkey, (coalesce(ar, 0) + coalesce(en, 0) + coalesce(cr, 0)) / nullif((ar IS NOT NULL)::INT + (en IS NOT NULL)::INT + (cr IS NOT NULL)::INT, 0) AS mean FROM c)
SELECT c_custkey, round(coalesce(mean, 0), 6) AS combined_score, round(coalesce(mean, 0) * 0.95, 6) AS final_score, CASE WHEN mean IS NULL THEN 'manual_review' WHEN mean * 0.95 >= 0.9 THEN 'pass' WHEN mean * 0.95 >= 0.7 THEN 'manual_review' ELSE 'reject' END AS decision FROM m""")
def name_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = citizens(spark, sf_dir)
    pairs = p.select("c_custkey", F.nullif("arabic", F.lit("")).alias("extracted_ar"), pick(ARABIC, "c_custkey + c_custkey % 3").alias("typed_ar"), F.when(F.col("c_custkey") % 2 == 0, F.col("name")).alias("extracted_en"), F.regexp_replace("name", "ss", "s").alias("typed_en"), F.lit(0.95).alias("confidence"))
    return ops.validate(pairs).select("c_custkey", F.round("combined_score", 6).alias("combined_score"), F.round("final_score", 6).alias("final_score"), "decision")


_AR_OF = lambda x: f"CASE WHEN regexp_matches({x}, '[\\x{{0600}}-\\x{{06FF}}]') THEN {duck.arabic_tokens(x)} ELSE {duck.latin_tokens(x)} END"
_BRIDGE = lambda x: f"coalesce(CASE WHEN regexp_matches({x}, '[\\x{{0600}}-\\x{{06FF}}]') THEN {duck.arabic_to_latin(x)} WHEN regexp_matches({x}, '[a-zA-Z]') THEN {duck.latin(x)} END, '')"


@query(f"""WITH RECURSIVE p AS (SELECT c_custkey, arabic AS x, CASE WHEN c_custkey % 3 = 0 THEN {_LIST(ARABIC, 'c_custkey + c_custkey % 7')} WHEN c_custkey % 3 = 1 THEN name ELSE {_LIST(list(ENGLISH.values()), 'c_custkey')} || ' Salem' END AS y FROM ({_PEOPLE})),
d AS (SELECT x AS a, y AS b, regexp_matches(x, '[\\x{{0600}}-\\x{{06FF}}]') AND regexp_matches(y, '[\\x{{0600}}-\\x{{06FF}}]') AS two, {_AR_OF('x')} AS ta, {_AR_OF('y')} AS tb, {duck.code(duck.latin('bx'), False)} AS ca, {duck.code(duck.latin('by_'), False)} AS cb FROM (SELECT *, {_BRIDGE('x')} AS bx, {_BRIDGE('y')} AS by_ FROM (SELECT DISTINCT x, y FROM p))),
t AS (SELECT DISTINCT u, unnest(tb) AS v FROM (SELECT unnest(ta) AS u, tb FROM d)), w AS (SELECT u AS a, v AS b FROM t UNION SELECT lower(u), lower(v) FROM t UNION SELECT ca, cb FROM d), {duck.jaro_winkler('j', 'w')},
best AS (SELECT a, b, avg(m) * (0.8 + 0.2 * least(any_value(na), any_value(nb)) / greatest(any_value(na), any_value(nb))) AS s FROM (SELECT d.a, d.b, i, len(any_value(ta)) AS na, len(any_value(tb)) AS nb, max(jw) AS m FROM (SELECT *, unnest(range(1, len(ta) + 1)) AS i FROM d) d JOIN j ON j.a = ta[i] AND list_contains(tb, j.b) GROUP BY d.a, d.b, i) GROUP BY a, b),
low AS (SELECT a, b, list_transform(ta, lambda z: lower(z)) AS ta, list_transform(tb, lambda z: lower(z)) AS tb FROM d), js AS (SELECT a AS u, b AS v, jw AS score FROM j), {duck.greedy('g', 'low', 'js', 0.85)},
f AS (SELECT d.a, d.b, CASE WHEN two THEN least(1.0, coalesce(s, 0)) ELSE 0.0 END AS ar, coalesce(jw, 0.0) AS ph, coalesce(n / greatest(na, nb), 0.0) AS ov, two FROM d LEFT JOIN best USING (a, b) LEFT JOIN j ON j.a = ca AND j.b = cb LEFT JOIN g ON g.a = d.a AND g.b = d.b)
SELECT c_custkey, round(ar, 6) AS arabic_similarity, round(ph, 6) AS phonetic_similarity, round(ov, 6) AS token_overlap, round(CASE WHEN two THEN 0.7 * ar + 0.3 * ph ELSE ph END, 6) AS similarity FROM p JOIN f ON a = x AND b = y""")
def cross_script_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arabic against Arabic, against another name in Latin letters, and against its own romanised form."""
    k = F.col("c_custkey") % 3
    other = F.when(k == 0, pick(ARABIC, "c_custkey + c_custkey % 7")).when(k == 1, F.col("name")).otherwise(F.concat(pick(list(ENGLISH.values()), "c_custkey"), F.lit(" Salem")))
    p = people(spark, sf_dir).select("c_custkey", "arabic", other.alias("name"))
    found = ops.cross_script(p, "arabic", "name")
    return found.select("c_custkey", *(F.round(c, 6).alias(c) for c in ("arabic_similarity", "phonetic_similarity", "token_overlap", "similarity")))


_AR = "[" + ", ".join(f"'{a}'" for a in ARABIC) + "][CAST(c_custkey % 10 AS INT) + 1]"


@query(f"""WITH k AS (SELECT DISTINCT trim(arabic) AS t FROM ({_PEOPLE})), d(ar, en) AS {duck.values(list(gazetteer.NAMES.items()))}, sp AS (SELECT {duck.code('name', False)} AS c, min_by(name, ord) AS name FROM {duck.values(list(enumerate(gazetteer.SPELLINGS)))} AS v(ord, name) GROUP BY 1),
r AS (SELECT t, en, CASE WHEN en IS NULL AND t <> '' THEN {duck.spoken('t')} END AS raw FROM k LEFT JOIN d ON ar = t),
w AS (SELECT t, i, raw_words[i] AS word FROM (SELECT *, unnest(range(1, len(raw_words) + 1)) AS i FROM (SELECT t, {duck.tokens('raw')} AS raw_words FROM r WHERE raw <> ''))),
f AS (SELECT t, string_agg(coalesce(name, word), ' ' ORDER BY i) AS fixed FROM w LEFT JOIN sp ON c = {duck.code('word', False)} AND length(word) >= 2 GROUP BY t)
SELECT c_custkey, CASE WHEN t = '' THEN t ELSE coalesce(en, fixed, raw) END AS english, CASE WHEN t = '' THEN 'empty' WHEN en IS NOT NULL THEN 'dictionary' WHEN fixed <> raw THEN 'corrected' ELSE 'phonetic' END AS method, raw AS raw_phonetic
FROM ({_PEOPLE}) JOIN r ON t = trim(arabic) LEFT JOIN f USING (t)""")
def romanised_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return romanise.convert(people(spark, sf_dir), "c_custkey", "arabic").select("c_custkey", "english", "method", "raw_phonetic")


@query(f"SELECT c_custkey, CASE WHEN method = 'dictionary' THEN english END AS dictionary, method FROM ({ORACLES['romanised_letters']})")
def romanise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = romanise.convert(people(spark, sf_dir), "c_custkey", "arabic")
    return got.select("c_custkey", F.when(F.col("method") == "dictionary", F.col("english")).alias("dictionary"), "method")


MEANINGS = {"محمد": "Mohammed", "نور": "Light", "جميلة سالم": " Beautiful"}


@query(f"""SELECT *, lower(trim(translated)) NOT IN ({", ".join(f"'{w}'" for w in gazetteer.COMMON_WORDS)}) AS kept
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN a {" ".join(f"WHEN a = '{k}' THEN '{v}'" for k, v in MEANINGS.items())} ELSE a END AS translated FROM (SELECT c_custkey, {_AR} AS a FROM customer))""")
def translated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations that give a name's meaning are common words, and are not kept as names."""
    p = people(spark, sf_dir).select("c_custkey", F.col("arabic").alias("text"), F.when(F.col("c_custkey") % 3 == 0, "en").otherwise("ar").alias("language"))
    dictionary = spark.createDataFrame(list(MEANINGS.items()), "source string, target string")
    got = romanise.translate_rows(p, dictionary)
    names = romanise.without_common_words(got.select("c_custkey", "translated"), "translated").select(F.col("c_custkey").alias("k"))
    return got.join(names, got["c_custkey"] == names["k"], "left").select("c_custkey", "translated", F.col("k").isNotNull().alias("kept"))


#: One translation for each rule, and good ones.
_GIVEN = ["محمد علي", "محمد", "Fatima", "نور الدين سالم"]
_SAID = ["Mohammed Ali", "xyz", "Rhythms", "Salem, Omar; Said!", "Noor of the morning", "akllal", "Akllal,", "Brrrrk Fghe", "محمد علي", "  ", "Nora", "A-l-i, O.m.a.r", "12345", "Fatima", "FATIMA"]


@query(f"""SELECT c_custkey, trim(t) <> '' AND (c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR (length(t) >= 5 AND len(regexp_extract_all(t, '[.,;!?]')) <= 2 AND lower(t) NOT IN ({", ".join(f"'{w}'" for w in romanise.BAD_TRANSLATIONS)})
AND len(regexp_extract_all(lower(t), '[aeiou]')) >= length(t) * 0.2 AND regexp_matches(t, '\\p{{L}}') AND trim(t) <> trim(s) AND (NOT contains(s, ' ') OR contains(t, ' ')))) AS good
FROM (SELECT c_custkey, {_LIST(_GIVEN, 'c_custkey // 3')} AS s, {_LIST(_SAID, 'c_custkey')} AS t FROM customer)""")
def translation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, pick(_GIVEN, "c_custkey div 3").alias("s"), pick(_SAID, "c_custkey").alias("t"))
    good = romanise.good_translation(F.col("s"), F.col("t"), F.when(k % 7 == 0, "en").otherwise("ar"), F.when(k % 11 == 0, "ar").otherwise("en"))
    return c.select(k, good.alias("good"))
