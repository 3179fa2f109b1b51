"""Similarities that Spark lacks: folds over arrays, and the ratio of common blocks over distinct pairs of strings."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHONETIC_FLOOR, PHONETIC_NEAR = 0.92, 0.8


@lru_cache(maxsize=1 << 17)
def ratio(a: str, b: str) -> float:
    """Twice the matched length over both lengths, by longest common blocks; the order of arguments matters."""
    return SequenceMatcher(None, a, b).ratio()


def jaro_winkler(a: str, b: str, prefix: int = 4, boost: float = 0.1) -> str:
    """The textbook measure of two SQL expressions, without a floor below which the prefix is ignored, in SQL.

    The letters of ``a`` are folded from left to right; each takes the first equal letter of ``b`` within reach
    that none before it took, and the state keeps the places of both. Nulls and empty texts score 0.
    """
    letters = lambda x: f"filter(split(coalesce({x}, ''), ''), c -> c <> '')"
    reach = "greatest(0, greatest(size(s.a), size(s.b)) div 2 - 1)"
    first = f"get(filter(sequence(1, size(s.b)), j -> j >= i - {reach} AND j <= i + {reach} AND get(s.b, j - 1) = get(s.a, i - 1) AND NOT array_contains(st.of_b, j)), 0)"
    take = f"get(transform(array({first}), j -> CASE WHEN j IS NULL THEN st ELSE named_struct('of_a', array_append(st.of_a, i), 'of_b', array_append(st.of_b, j)) END), 0)"
    swaps = "size(filter(zip_with(st.of_a, array_sort(st.of_b), (x, y) -> get(s.a, x - 1) <> get(s.b, y - 1)), d -> d)) / 2"
    near = f"least({prefix}, size(s.a), size(s.b))"
    same = f"coalesce(get(filter(sequence(0, {near} - 1), k -> get(s.a, k) <> get(s.b, k)), 0), {near})"
    jaro = f"(size(st.of_a) / size(s.a) + size(st.of_a) / size(s.b) + (size(st.of_a) - {swaps}) / size(st.of_a)) / 3"
    finish = f"CASE WHEN size(st.of_a) = 0 THEN 0D ELSE get(transform(array({jaro}), v -> v + {same} * {boost}D * (1 - v)), 0) END"
    none = "CAST(array() AS ARRAY<INT>)"
    fold = f"aggregate(sequence(1, size(s.a)), named_struct('of_a', {none}, 'of_b', {none}), (st, i) -> {take}, st -> {finish})"
    whole = f"CASE WHEN size(s.a) = 0 OR size(s.b) = 0 THEN 0D WHEN s.a = s.b THEN 1D ELSE {fold} END"
    return f"get(transform(array(named_struct('a', {letters(a)}, 'b', {letters(b)})), s -> {whole}), 0)"


def paired(options: str, at_least: float) -> str:
    """Greedy one-to-one pairing, in SQL: a struct of ``n`` pairs and their summed ``total``.

    ``options`` are structs of ``i``, ``less`` (the score, negated) and ``j``. In the order of ``i`` each takes the best
    free ``j``, of equal ones the first, if it scores ``at_least``. One fold over the sorted options.
    """
    free = f"o.i <> st.last AND NOT array_contains(st.used, o.j) AND -o.less >= {at_least}D AND o.less < 0"
    take = "named_struct('last', o.i, 'used', array_append(st.used, o.j), 'n', st.n + 1, 'total', st.total - o.less)"
    start = "named_struct('last', -1, 'used', CAST(array() AS ARRAY<INT>), 'n', 0, 'total', 0D)"
    return f"aggregate(array_sort({options}), {start}, (st, o) -> CASE WHEN {free} THEN {take} ELSE st END, st -> named_struct('n', st.n, 'total', st.total))"


def token_score(a: str, b: str, code_a: str = "", code_b: str = "") -> float:
    """Character ratio, raised where the phonetic codes agree or nearly agree."""
    plain = ratio(a, b)
    if not code_a or not code_b:
        return plain
    if code_a == code_b:
        return max(plain, PHONETIC_FLOOR)
    near = ratio(code_a, code_b)
    return max(plain, 0.6 * plain + 0.4 * near) if near >= PHONETIC_NEAR else plain


def assigned(a: list, b: list, at_least: float, score) -> tuple[int, float]:
    """Greedy one-to-one assignment in the order of ``a``: how many pairs, and their summed score."""
    free, n, total = list(range(len(b))), 0, 0.0
    for x in a:
        best, at = max(((score(x, b[j]), -j) for j in free), default=(0.0, 0))
        if best >= at_least and best > 0:
            free.remove(-at)
            n, total = n + 1, total + best
    return n, total


def fuzzy(a: str, b: str, at_least: float, codes_a: list[str] | None = None, codes_b: list[str] | None = None) -> float:
    """Share of tokens that pair up, times the mean score of the pairs."""
    ta, tb = a.split(), b.split()
    if not ta or not tb:
        return 0.0
    xs, ys = list(zip(ta, codes_a or [""] * len(ta), strict=True)), list(zip(tb, codes_b or [""] * len(tb), strict=True))
    n, total = assigned(xs, ys, at_least, lambda x, y: token_score(x[0], y[0], x[1], y[1]))
    return n / max(len(ta), len(tb)) * (total / n) if n else 0.0


def better(a: str, b: str, than: float) -> float:
    """The larger of ``than`` and the ratio, which is worked out only where its bounds allow more."""
    m = SequenceMatcher(None, a, b)
    return max(than, m.ratio()) if m.real_quick_ratio() > than and m.quick_ratio() > than else than


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def arabic_fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzzy(x, y, 0.75) for x, y in zip(a, b, strict=True)], dtype="float64")


def english_above(at_least: float):
    """Tokens with phonetic help, or the whole strings or whole codes if those agree better.

    Scores from ``at_least`` on are exact; what lies below may be less than the true score, but no more.
    """

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series, codes_a: pd.Series, codes_b: pd.Series, whole_a: pd.Series, whole_b: pd.Series) -> pd.Series:
        out = []
        for x, y, cx, cy, wx, wy in zip(a, b, codes_a, codes_b, whole_a, whole_b, strict=True):
            found = fuzzy(x, y, 0.65, list(cx), list(cy))
            floor = max(found, at_least - 1e-9)
            best = better(x, y, floor)
            best = better(wx, wy, best) if wx and wy else best
            out.append(best if best > floor else found)
        return pd.Series(out, dtype="float64")

    return score


def best_match_mean(a: str, b: str) -> Column:
    """Mean over the first list's tokens of the best Jaro-Winkler score, less for unequal lengths."""
    mean = f"aggregate(transform({a}, u -> array_max(transform({b}, t -> {jaro_winkler('u', 't')}))), 0D, (x, y) -> x + y) / size({a})"
    return F.expr(f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE least(1D, {mean} * (0.8D + 0.2D * least(size({a}), size({b})) / greatest(size({a}), size({b})))) END")


def token_overlap(a: str, b: str, at_least: float = 0.85) -> Column:
    """Share of tokens that pair up one to one at a Jaro-Winkler score of 0.85 or more."""
    each = f"flatten(transform({a}, (u, m) -> transform({b}, (t, n) -> named_struct('i', m, 'less', -{jaro_winkler('lower(u)', 'lower(t)')}, 'j', n))))"
    return F.expr(f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE {paired(each, at_least)}.n / greatest(size({a}), size({b})) END")


def register(spark: SparkSession) -> None:
    """Publish ``similarity_ratio``, ``jaro_winkler`` (a SQL expression) and ``name_compare`` to SQL."""
    from attesta.operators.names import name_compare

    spark.udf.register("similarity_ratio", similarity_ratio)
    spark.udf.register("name_compare", name_compare)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION jaro_winkler(a STRING, b STRING) RETURNS DOUBLE RETURN {jaro_winkler('a', 'b')}")
