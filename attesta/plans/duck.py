"""Parts of the queries' SQL: names, codes and similarities said once, as DuckDB expressions and common table expressions.

Pairs are tables of columns ``a`` and ``b``. Longest common blocks, greedy pairing and Jaro's matching take
one step of a recursive table for each block, token or letter; all pairs step together.
"""

from __future__ import annotations

from attesta.functions import phonetic, text


def chain(x: str, steps: list[tuple[str, str]]) -> str:
    """Regular expressions applied one after another."""
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def code(x: str, before_vowel: bool = True) -> str:
    """The phonetic code of :func:`attesta.functions.phonetic.code`."""
    steps = [("[^A-Z]", " "), ("SH", "x"), ("TH", "0"), ("C([EIY])", r"s\1"), ("C", "k"), ("G([EIY])", r"j\1"), ("G", "k"), ("X", "ks")]
    steps += [("Y([AEIOU])", r"y\1"), ("Y", "")] if before_vowel else [("Y", "y")]
    return f"replace(upper(translate({chain(f'upper({x})', [*steps, ('^[AEIOU]', 'a'), ('[AEIOU]', '')])}, 'BDQVZ', 'PTKFS')), ' ', '')"


def latin(x: str) -> str:
    bare = chain(f"lower({x})", [(r"[^\w\s]", ""), ("aa+", "a"), ("oo+", "o"), ("ee+", "i"), ("ii+", "i"), ("uu+", "u")])
    return squeezed(bare)


def english(x: str) -> str:
    bare = chain(squeezed(f"lower({x})"), [(r"[^a-z\s\-]", ""), *((rf"\b{a}\b", b) for a, b in text.ENGLISH_COMPOUNDS)])
    return squeezed(chain(bare, [(r"\bal-", "al "), (r"\bel-", "el "), (r"\bal([a-z]{3,})\b", r"al \1")]))


def arabic_place(x: str) -> str:
    return squeezed(chain(f"translate({x}, '{text.FOLD_FROM}', '{text.FOLD_TO}')", [(r"[\x{064B}-\x{065F}]", "")]))


def arabic(x: str) -> str:
    return chain(arabic_place(x), [(r"[^a-zA-Z\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\s\-]", "")])


def arabic_strict(x: str) -> str:
    return chain(squeezed(f"translate(translate({x}, '{text.FOLD_FROM}', '{text.FOLD_TO}'), '{text.MARKS}', '')"), [(r"[^\x{0600}-\x{06FF}\s0-9]", "")])


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def arabic_tokens(x: str) -> str:
    return tokens(chain(arabic_strict(x), [(f"{p}({text.ARTICLE})", rf"{p} \1") for p in text.ARABIC_PREFIXES]))


def latin_tokens(x: str) -> str:
    return tokens(chain(latin(x), list(text.LATIN_PREFIXES)))


def _letters(x: str, letters: dict[str, str]) -> str:
    keys, values = ("[" + ", ".join("'" + v.replace("'", "''") + "'" for v in side) + "]" for side in (letters, letters.values()))
    each = f"list_transform(string_split({x}, ''), lambda c: coalesce(list_extract({values}, list_position({keys}, c)), CASE WHEN ascii(c) < 128 THEN c ELSE '' END))"
    words = f"string_split({squeezed(f'array_to_string({each}, chr(0))').replace('chr(0)', repr(''))}, ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(left(w, 1)) || lower(w[2:])), ' ')"


def arabic_to_latin(x: str) -> str:
    return _letters(arabic_strict(x), phonetic.LETTERS)


def spoken(x: str) -> str:
    return _letters(x, phonetic.SPOKEN)


def values(rows: list[tuple]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


def _block(al: str, ah: str, bl: str, bh: str) -> str:
    """The longest common block of a segment: length, then the earliest in ``a``, then in ``b``, as one number."""
    size = f"len(list_filter(range(1, least({ah} - i, {bh} - j) + 1), lambda k: a[i:i + k - 1] = b[j:j + k - 1]))"
    each = f"list_transform(range({bl}, {bh}), lambda j: CASE WHEN a[i] = b[j] THEN 10000 * {size} + (99 - i) * 100 + 99 - j ELSE 0 END)"
    return f"coalesce(list_max(flatten(list_transform(range({al}, {ah}), lambda i: {each}))), 0)"


def ratio(name: str, pairs: str) -> str:
    """``name`` (a, b, ratio): twice the letters in longest common blocks over both lengths (below 100 letters)."""
    return f"""{name}_s AS (SELECT a, b, CAST(1 AS BIGINT) AS al, length(a) + 1 AS ah, CAST(1 AS BIGINT) AS bl, length(b) + 1 AS bh, {_block("1", "length(a) + 1", "1", "length(b) + 1")} AS m FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '')
UNION ALL SELECT a, b, g.al, g.ah, g.bl, g.bh, {_block("g.al", "g.ah", "g.bl", "g.bh")} FROM
  (SELECT a, b, unnest([{{'al': al, 'ah': i, 'bl': bl, 'bh': j}}, {{'al': i + k, 'ah': ah, 'bl': j + k, 'bh': bh}}]) AS g FROM (SELECT *, m // 10000 AS k, 99 - (m // 100) % 100 AS i, 99 - m % 100 AS j FROM {name}_s WHERE m >= 10000)) WHERE g.ah > g.al AND g.bh > g.bl),
{name} AS (SELECT a, b, 2.0 * sum(m // 10000) / (length(a) + length(b)) AS ratio FROM {name}_s GROUP BY a, b)"""


def jaro_winkler(name: str, pairs: str) -> str:
    """``name`` (a, b, jw): matches within the window in the order of ``a``, half the swaps, a prefix of at most 4."""
    prefix = "len(list_filter(range(1, least(4, length(a), length(b)) + 1), lambda k: left(a, k) = left(b, k)))"
    return f"""{name}_s AS (SELECT a, b, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS js, CAST([] AS BIGINT[]) AS ms, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS d FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '')
UNION ALL SELECT a, b, i + 1, CASE WHEN j IS NULL THEN js ELSE list_append(js, j) END, CASE WHEN j IS NULL THEN ms ELSE list_append(ms, i + 1) END, d FROM
  (SELECT *, list_min(list_filter(range(greatest(1, i + 1 - d), least(length(b), i + 1 + d) + 1), lambda j: b[j] = a[i + 1] AND NOT list_contains(js, j))) AS j FROM {name}_s WHERE i < length(a))),
{name}_j AS (SELECT a, b, len(js) AS m, len(list_filter(list_zip(ms, list_sort(js)), lambda z: a[z[1]] <> b[z[2]])) AS swaps FROM {name}_s WHERE i = length(a)),
{name} AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN m = 0 THEN 0.0 ELSE jaro + {prefix} * 0.1 * (1 - jaro) END AS jw FROM (SELECT *, (m / length(a) + m / length(b) + (m - swaps / 2) / m) / 3 AS jaro FROM {name}_j))"""


def greedy(name: str, pairs: str, scores: str, at_least: float) -> str:
    """``name`` (a, b, na, nb, n, total): tokens of ``a`` in order take the best free token of ``b``.

    ``pairs``: a, b, ta, tb (token lists); ``scores``: u, v, score of all their token pairs.
    """
    return f"""{name}_m AS (SELECT a, b, len(any_value(ta)) AS na, len(any_value(tb)) AS nb, list(score ORDER BY i, j) AS scores FROM
  (SELECT *, unnest(range(1, len(tb) + 1)) AS j FROM (SELECT *, unnest(range(1, len(ta) + 1)) AS i FROM {pairs})) JOIN {scores} ON u = ta[i] AND v = tb[j] GROUP BY a, b),
{name}_g AS (SELECT *, CAST(0 AS BIGINT) AS i, range(1, nb + 1) AS free, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS total FROM {name}_m
UNION ALL SELECT a, b, na, nb, scores, i + 1, CASE WHEN ok THEN list_filter(free, lambda f: f <> j) ELSE free END, n + CAST(ok AS BIGINT), total + CASE WHEN ok THEN best ELSE 0 END FROM
  (SELECT *, coalesce(best >= {at_least} AND best > 0, false) AS ok, list_min(list_filter(free, lambda f: scores[i * nb + f] = best)) AS j FROM
    (SELECT *, list_max(list_transform(free, lambda f: scores[i * nb + f])) AS best FROM {name}_g WHERE i < na))),
{name} AS (SELECT a, b, na, nb, n, total FROM {name}_g WHERE i = na)"""


def compare(name: str, pairs: str, language: str) -> str:
    """``name`` (a, b, tier, score) of normalised names: exact, token_set, fuzzy or none."""
    help_ = language == "english"
    codes = f", {code('u')} AS cu, {code('v')} AS cv" if help_ else ""
    whole = f"UNION SELECT a, b FROM {name}_h UNION SELECT {code('a')}, {code('b')} FROM {name}_h UNION SELECT cu, cv FROM {name}_t" if help_ else ""
    near = f"LEFT JOIN {name}_r c ON c.a = cu AND c.b = cv" if help_ else ""
    plain = "coalesce(p.ratio, 0)"
    score = f"CASE WHEN cu = '' OR cv = '' THEN {plain} WHEN cu = cv THEN greatest({plain}, 0.92) WHEN c.ratio >= 0.8 THEN greatest({plain}, 0.6 * {plain} + 0.4 * c.ratio) ELSE {plain} END" if help_ else plain
    share = "CASE WHEN n = 0 THEN 0.0 ELSE n / greatest(na, nb) * (total / n) END"
    best = f"greatest({share}, coalesce(w.ratio, 0), coalesce(k.ratio, 0))" if help_ else share
    more = f"LEFT JOIN {name}_r w ON w.a = f.a AND w.b = f.b LEFT JOIN {name}_r k ON k.a = {code('f.a')} AND k.b = {code('f.b')}" if help_ else ""
    return f"""{name}_d AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 'none' WHEN a = b THEN 'exact' WHEN len(ta) > 0 AND list_sort(list_distinct(ta)) = list_sort(list_distinct(tb)) THEN 'token_set' ELSE 'fuzzy' END AS tier FROM (SELECT a, b, {tokens('a')} AS ta, {tokens('b')} AS tb FROM (SELECT DISTINCT a, b FROM {pairs}))),
{name}_h AS (SELECT a, b, ta, tb FROM {name}_d WHERE tier = 'fuzzy'),
{name}_t AS (SELECT u, v{codes} FROM (SELECT DISTINCT u, unnest(tb) AS v FROM (SELECT unnest(ta) AS u, tb FROM {name}_h))),
{name}_q AS (SELECT u AS a, v AS b FROM {name}_t {whole}),
{ratio(f'{name}_r', f'{name}_q')},
{name}_v AS (SELECT u, v, {score} AS score FROM {name}_t LEFT JOIN {name}_r p ON p.a = u AND p.b = v {near}),
{greedy(f'{name}_f', f'{name}_h', f'{name}_v', 0.65 if help_ else 0.75)},
{name} AS (SELECT d.a, d.b, tier, CASE tier WHEN 'none' THEN 0.0 WHEN 'fuzzy' THEN coalesce({best}, 0.0) ELSE 1.0 END AS score FROM {name}_d d LEFT JOIN {name}_f f ON f.a = d.a AND f.b = d.b {more})"""
