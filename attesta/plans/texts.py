"""Text functions over ``part.p_name`` and inline names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import phonetic, text

from . import duck
from .registry import pick, query, table

NAMES = ["Abdulrahman Al-Saleh", "Mohammed  Ali", "Shaykh Yusef Thabit", "CECILIA Gym", "el-Amin Youssef", "abdullah alsqaf", "Xavier Quy", "bin Ibrahim Noor"]
ARABIC = ["أحمد عَلي", "عبدالله محمّد", "فاطمة الزهراء", "مصطفى حسن", "إبراهيم ١٢٣", "Ali علي", "رمـاح", "سعيد-ناصر"]
_N = "SELECT p_partkey, [" + ", ".join(f"'{n}'" for n in NAMES) + "][CAST(p_partkey % 8 AS INT) + 1] AS name, [" + ", ".join(f"'{n}'" for n in ARABIC) + "][CAST(p_partkey % 8 AS INT) + 1] AS arabic, p_name FROM part"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", pick(NAMES, "p_partkey").alias("name"), pick(ARABIC, "p_partkey").alias("arabic"), "p_name")


@query(f"SELECT p_partkey, {duck.code('name', False)} AS code, {duck.code('p_name')} AS code_before_vowel FROM ({_N})")
def phonetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", phonetic.code(F.col("name")).alias("code"), phonetic.code(F.col("p_name"), True).alias("code_before_vowel"))


@query(f"SELECT p_partkey, {duck.latin('name')} AS latin, {duck.english('name')} AS english, len(string_split_regex(trim(p_name), '\\s+')) AS n_tokens FROM ({_N})")
def latin_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir)
    return rows.select("p_partkey", text.latin(F.col("name")).alias("latin"), text.english_name(F.col("name")).alias("english"), F.size(text.tokens(text.squeezed(F.col("p_name")))).cast("long").alias("n_tokens"))


@query(f"""SELECT p_partkey, {duck.arabic_place('arabic')} AS place_text, {duck.arabic('arabic')} AS arabic_name, {duck.arabic_strict('arabic')} AS strict,
translate(arabic, '{text.DIGITS_FROM}', '{text.DIGITS_TO}') AS digits FROM ({_N})""")
def arabic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("arabic")
    return _names(spark, sf_dir).select("p_partkey", text.place_text(a).alias("place_text"), text.arabic_name(a).alias("arabic_name"), text.arabic_strict(a).alias("strict"), text.plain_digits(a).alias("digits"))


_AR, _LA = "len(regexp_extract_all(arabic, '[\\x{0600}-\\x{06FF}]'))", "len(regexp_extract_all(arabic, '[a-zA-Z]'))"


@query(f"""SELECT p_partkey, {_AR} > 0 AS has_arabic, {_LA} > 0 AS has_latin, CASE WHEN {_AR} > {_LA} THEN 'ar' ELSE 'en' END AS text_language,
CASE WHEN {_AR} + {_LA} = 0 THEN 'unknown' WHEN {_AR} / ({_AR} + {_LA}) >= 0.6 THEN 'arabic' WHEN {_AR} / ({_AR} + {_LA}) <= 0.4 THEN 'english' ELSE 'mixed' END AS name_language FROM ({_N})""")
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("arabic")
    return _names(spark, sf_dir).select("p_partkey", text.has_arabic(a).alias("has_arabic"), text.has_latin(a).alias("has_latin"), text.text_language(a).alias("text_language"), text.name_language(a).alias("name_language"))


@query(f"""SELECT p_partkey, t[1] AS first, CASE WHEN len(t) > 2 THEN array_to_string(t[2:len(t)-1], ' ') ELSE '' END AS middle, CASE WHEN len(t) > 1 THEN t[-1] ELSE '' END AS last,
CASE WHEN len(t) >= 4 THEN t[-1] WHEN len(t) = 3 THEN t[3] END AS family, t[2] AS second, t[3] AS third FROM (SELECT *, string_split_regex(trim(p_name), '\\s+') AS t FROM ({_N}))""")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir).select("p_partkey", text.split_name(F.col("p_name")).alias("s"), text.name_parts(F.col("p_name")).alias("p"))
    return rows.select("p_partkey", "s.first", "s.middle", "s.last", "p.family", "p.second", "p.third")


@query(f"SELECT p_partkey, array_to_string({duck.arabic_tokens('arabic')}, ' ') AS arabic_tokens, array_to_string({duck.latin_tokens('name')}, ' ') AS latin_tokens FROM ({_N})")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir)
    return rows.select("p_partkey", F.array_join(text.arabic_tokens(F.col("arabic")), " ").alias("arabic_tokens"), F.array_join(text.latin_tokens(F.col("name")), " ").alias("latin_tokens"))
