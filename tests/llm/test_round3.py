"""Operators 11 to 13 against plain versions: a search over edits, all squares, the library itself."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from attesta.llm import conversations, periodic, queries, tokencounts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11: conversations -------------------------------------------------------------------------------------


def or_space(x) -> str:
    return " " if x is None else str(x)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        pick = zlib.crc32(f"{or_space(conv)}:{or_space(turn)}".encode()) % 20
        role, text = or_space(role), or_space(text)
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        role = "user" if pick == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(pick, 1)
    return out


def cheapest(rows):
    """Least cost, then least edits, of (role, fault) rows: a search over all edits."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, edits, made
        if (i, state) in done:
            continue
        done.add((i, state))
        new = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[new]
        heapq.heappush(heap, (cost + 2, edits + "I", i, new, (*made, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state, made))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, new, (*made, f"{name}:{text}")))
                if (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, after[state, role[:1]], (*made, f"{role}:{text}")))


def plain_repair(rows):
    """The contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in damaged(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marked, seen = [], set()
        for _, role, text in mine:
            rest = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits, made = cheapest(marked)
        kinds = [f for *_, f in marked]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, edits, sha("\n".join(made)))
    return out


def as_plain(rows):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def odd_conversations():
    draw = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(draw.choice([0, 1, 2, 5, 9, 25])):
            turn = draw.choice([None, *range(8)]) if conv is None or conv % 3 == 0 else draw.randrange(30)
            role = draw.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = draw.choice(["Hi there.", "Hi there", "", " \t", None, "x" * 50 + "!", "é ß. ", "so\x0b?\x0b", "a:b\nc.", f"n {draw.random()}."])
            rows.append((conv, turn, role, text))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = df.withColumns({c: F.lit(1) for c in ("conv", "mark", "repeated", "part", "cost", "lines")})
    return rows, clashing.repartition(5)


@pytest.mark.parametrize("bounds", [(conversations.LONG, conversations.PIECE), ((4, 1 << 20), (2, 1 << 20)), ((0, 0), (3, 60))])
def test_conversations_match_a_search_over_edits(odd, bounds):
    rows, df = odd
    got = as_plain(conversations.Repair(conversations.damage(df), *bounds).report().collect())
    want = plain_repair(rows)
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert {c: got.get(c, empty) for c in want} == want
    assert set(got) <= set(want)


@pytest.mark.parametrize("bounds", [(conversations.LONG, conversations.PIECE), ((4, 1 << 20), (2, 1 << 20))])
def test_repaired_rows_are_what_the_digest_says(odd, bounds):
    rows, df = odd
    repair = conversations.Repair(conversations.damage(df), *bounds)
    lines = {}
    for r in sorted(repair.lines().collect(), key=lambda r: (r.piece, r.line)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair.report().collect():
        assert sha("\n".join(lines.get(r.conv_id, []))) == r.repaired_sha256


def test_conversation_query_covers_every_conversation(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_plain(queries.op11_conversations(spark, SF).collect()) == plain_repair(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    repair = conversations.Repair(conversations.damage(df))
    assert repair.report().collect() == [] and repair.lines().collect() == []


def test_rules_are_shared_and_ropes_agree_with_sequences():
    found = conversations.Grammar()
    sequence = bytes([0, *[2, 4] * 500])
    whole = found.symbols([sequence, sequence[1:]])
    assert len(found.cost) < 60  # 1001 rows, some tens of rules
    assert [found.close(s) for s in whole] == [(0, "K" * 1001), (0, "K" * 1000)]


# --- 12: token counts --------------------------------------------------------------------------------------

ODD_TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", "▁▁ a", "a ▁b", "\n", "a\nb c\t d", "<s> a </s>", "<unk>", "<0x0A>", "é 漢字 かな", "x" * 5000, "a b " * 3, "\x00 a b", "🙂 🙂", "word " * 4095 + "word", "word " * 4096 + "word"]


@pytest.fixture(scope="module")
def piece_model():
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer_path("piece_bpe_32k.model")
    return path, SentencePieceProcessor(model_file=path)


def test_counts_are_the_librarys(spark, piece_model):
    path, model = piece_model
    rows = [*enumerate(ODD_TEXTS), (None, "a b"), (None, None), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "digest", "n_tokens", "least", "_digest")})
    got = sorted(tuple(r) for r in tokencounts.count(df.where("doc_id is not null"), path).collect())
    want = sorted((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows if i is not None)
    assert got == want
    assert sorted(r.n_tokens for r in tokencounts.count(df.where("doc_id is null"), path).collect()) == [0, 2]


def test_counts_of_a_tokenizers_file(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    df = spark.createDataFrame([*enumerate([*ODD_TEXTS, "a <|endoftext|> b"])], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencounts.count(df, path).collect()}
    assert got == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in df.collect()}


def test_cache_is_asked_before_the_encoder(spark, piece_model, tmp_path, monkeypatch):
    path, model = piece_model
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, "▁other")], "doc_id long, text string")
    tokencounts.count(first, path, cache).collect()
    stored = tokencounts.CountCache(spark, cache, path)
    assert stored.stored().count() == 2
    asked = []
    real = tokencounts.encoded
    monkeypatch.setattr(tokencounts, "encoded", lambda texts, p: asked.append(texts.count()) or real(texts, p))
    more = first.union(spark.createDataFrame([(4, " other"), (5, "new"), (6, "new")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in tokencounts.count(more, path, cache).collect()}
    assert asked == [1]  # of six rows only one digest is new
    assert got == {i: len(model.encode(t)) for i, t in more.collect()}
    stored.append(spark.createDataFrame([(bytes(32), 7)], tokencounts.STORED))
    stored.append(spark.createDataFrame([(bytes(32), 7)], tokencounts.STORED))  # a batch that ran twice
    assert stored.stored().where(F.col("digest") == F.lit(bytes(32))).count() == 1
    other = tokencounts.CountCache(spark, cache, queries.tokenizer_path())
    assert other.folder != stored.folder and other.stored().count() == 0


def test_counts_of_nothing(spark, piece_model):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokencounts.count(df, piece_model[0]).collect() == []


def test_count_query(spark, piece_model):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op12_token_counts(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {i: (len((t or "").encode()), len(piece_model[1].encode(t or ""))) for i, t in rows}


# --- 13: runs ----------------------------------------------------------------------------------------------


def plain_runs(words, shortest=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(shortest, 2 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(draw, most=70):
    n, kinds = draw.randrange(most), draw.choice([1, 2, 3, 30])
    words = [f"w{draw.randrange(kinds)}" for _ in range(n)]
    if n and draw.random() < 0.7:
        a, p = draw.randrange(n), draw.randrange(1, 1 + max(1, n // 3))
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.parametrize("shortest", [2, 12])
def test_runs_are_all_maximal_repetitions(shortest):
    draw = random.Random(1)
    for _ in range(400):
        words = some_words(draw)
        assert periodic.runs_of(words, shortest) == plain_runs(words, shortest)


def plain_periodic(doc, text):
    words, h = WORDS.findall(text or ""), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_run_query_against_all_squares(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, draw.choice(" \n\t ").join(some_words(draw, 120))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \x0b "), (1003, "a " * 400), (None, "x y " * 9), (None, None), (7, rows[7][1]), (7, "other " * 13), (1004, "Straße É " * 11 + " ende"), (1005, "a b " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("runs", "collapsed", "_w", "_h", "_text")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted(((i, *plain_periodic(i, t)) for i, t in rows), key=key)


def test_long_texts_and_many_texts_in_a_batch(spark):
    draw = random.Random(3)
    free = [f"u{i}" for i in range(30_000)]
    words = free[:9000] + [f"p{i % 700}" for i in range(5000)] + free[9000:] + ["z"] * 20
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(draw.sample(free, 2000)))], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.find(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(9000, 5000, 700), (35_000, 20, 1)] and got[2].runs == []
    assert got[1].collapsed.split() == free[:9000] + [f"p{i}" for i in range(700)] + free[9000:] + ["z"]


def test_runs_of_nothing(spark):
    assert periodic.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- earlier operators ---------------------------------------------------------------------------------------


def test_mixing_deals_rows_without_an_id(spark):
    """Half of the ids are null, and a third of the rows share one id: shards stay as many as the words ask for."""
    from attesta.llm import mixing

    rows = [(None if i % 2 else 7 if i % 3 == 0 else i, f"w{i} " * (5 + i % 40), "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shard_words=1500).collect()
    words, shards = {}, {r.shard for r in got}
    for r in got:
        if r.doc_id is None:
            words[r.shard] = words.get(r.shard, 0) + r.size
    assert len(got) == 3000 and len(shards) >= 40 and len(words) >= 0.9 * len(shards) and max(words.values()) < 3000
    kept = mixing.repeat_taken(df, shard_words=1500)
    times = {r.text: r["count"] for r in kept.groupBy("text").count().collect()}
    assert max(times.values()) <= 2 and abs(sum(len(t.split()) * n for t, n in times.items()) - got[0].target) <= 0.02 * got[0].target


def plain_kneser_ney(text, order, discount=0.75):
    """Probability of a symbol after a history, by the textbook; ``None`` stands for every unseen symbol."""
    from collections import Counter

    from attesta.llm import langid

    s = langid.symbols(text).tolist()
    full = [Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for n in range(1, order + 1)]
    counts = [Counter(g[1:] for g in full[n]) for n in range(1, order)] + [full[-1]]
    known = sorted(set(s))

    def prob(history, symbol):
        n = len(history) + 1
        if n == 1:
            total, kinds = sum(counts[0].values()), len(counts[0])
            return max(counts[0][(symbol,)] - discount, 0) / total + discount * kinds / total / (len(known) + 1)
        after = {g: c for g, c in counts[n - 1].items() if g[:-1] == tuple(history)}
        lower = prob(history[1:], symbol)
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get((*history, symbol), 0) - discount, 0) / total + discount * len(after) / total * lower

    return known, prob


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_against_the_textbook(order):
    import itertools

    import numpy as np

    from attesta.llm import langid

    text = "Abra cadabra, a barb! Brac"
    s = langid.symbols(text)

    def counted(n):
        w, c = np.unique(np.lib.stride_tricks.sliding_window_view(s, n), axis=0, return_counts=True)
        return w, np.zeros(len(w), np.int64), c.astype(float)

    model = langid.estimate(["x"], order, [counted(n) for n in range(1, order + 1)])
    known, prob = plain_kneser_ney(text, order)
    unseen = ord("z")
    histories = list(itertools.product([*known, unseen], repeat=order - 1))
    for history in random.Random(1).sample(histories, min(60, len(histories))):
        got = [float(np.exp(model._rows(np.array([[*history, c]], np.uint32), order)[0, 0])) for c in [*known, unseen]]
        assert got == pytest.approx([prob(list(history), c) for c in [*known, unseen]], abs=1e-12)
        assert sum(got) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("texts", [["Hello there"], ["abcd", "efgh"], ["same text here"] * 5, ["a"], ["a", "b", "c"], ["1 2 3"], ["long text of many words", "x"]])
def test_language_models_from_little(spark, texts):
    """One text, equal lengths, repeated rows, texts below the order, texts without letters."""
    from attesta.llm import langid

    df = spark.createDataFrame([(i, t, "en" if i % 2 == 0 else "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].lang_pred == ("und" if not any(c.isalpha() for c in t) else got[i].lang_pred) and 0 <= got[i].score <= 1
        assert got[i].rejected == (not any(c.isalpha() for c in t))


def test_language_ties_go_to_the_first(spark):
    from attesta.llm import langid

    df = spark.createDataFrame([(1, "one text", "fr"), (2, "one text", "de")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 9)) for r in langid.predict(df, langid.train(df)).collect()} == {("de", 0.5)}


LONG = "A sentence that is long enough to count as text on its own, twice over. " * 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>Hi.</p></article>" + "<div>" + "</div><div>".join(f"{i} {'text ' * 60}".strip() for i in range(20)) + "</div>", ["Hi.", *(f"{i} {'text ' * 60}".strip() for i in range(20))]),
        (f'<article><p>{LONG}</p></article><div>Posted in news.</div><div class="x">{LONG[:90]}</div>', [LONG.strip()]),
        (f'<article><p class="cookie-notice">We use cookies</p><p>{LONG}</p><h3 class="comments-title">Two replies</h3><ul><li class="advert">Buy<p>now</p><li>Point<li class=promo>Sale</ul><p>End.</p></article>', [LONG.strip(), "Point", "End."]),
        (f'<p class="cookie-notice">We use cookies<p>{LONG}<h3 class="comments-title">Two replies</h3>', [LONG.strip()]),
        (f'<main><article><h1 class="page-header">Head</h1><p>{LONG}</p></article></main><article class="teaser"><h2>Other</h2><p>{LONG}</p></article>', ["Head", LONG.strip()]),
        (f'<article><table><tr class="ads"><td>Ad</td><td>More</td></tr><tr><td>One</td><td>two</td></tr></table><p>{LONG}</p></article>', ["One two", LONG.strip()]),
        (f'<article><ul><li class="advert"><ul><li>inner</li></ul></li><li>kept</li></ul><p style="display:none">no</p><p>{LONG}</p></article>', ["kept", LONG.strip()]),
    ],
)
def test_html_marks_and_outside_text(page, want):
    from attesta.llm import html

    assert html.extract(page) == "\n\n".join(want)


def test_html_on_labelled_pages():
    """Pages put together from labelled blocks: what is labelled as text, and only that, in page order."""
    from attesta.llm import html

    draw = random.Random(9)
    marks = ['class="cookie-notice"', 'class="ad"', 'id="comments"', 'class="sidebar"', 'role="dialog"', 'class="share"', "hidden"]
    for nth in range(400):
        marked, blocks, want = draw.random() < 0.5, [], []
        for k in range(draw.randint(1, 12)):
            text = f"{nth}.{k} " + " ".join("word" * draw.randint(1, 3) for _ in range(draw.randint(20, 40))) + "."
            tag = draw.choice(["p", "h2", "div", "ul", "blockquote", "pre"])
            inner = f"<li>{text}</li>" if tag == "ul" else text
            if draw.random() < 0.3:
                mark = draw.choice(marks[:2] + marks[-1:] if tag in ("p", "h2", "pre") else marks)
                blocks.append(f"<{tag} {mark}>{inner}</{tag}>")
            else:
                blocks.append(f"<{tag}>{inner}</{tag}>")
                want.append(text)
            if draw.random() < 0.2:
                blocks.append(draw.choice(["<nav><a href=/>Home page of this</a></nav>", "<script>var x = '<p>no</p>'</script>", "<form>Your mail <input></form>", "<!-- <p>no</p> -->", "<aside>Aside</aside>"]))
        around = ("<article>", "</article>") if marked else ("<div>", "</div>")
        page = f"<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav>{around[0]}{''.join(blocks)}{around[1]}<footer>&copy; foot</footer></body></html>"
        assert html.extract(page) == "\n\n".join(want)


# --- near copies of the pipeline ------------------------------------------------------------------------------


def edited_copies(draw, groups):
    """Texts of one base each, edited in so many places: many of a group are not similar enough to each other."""
    rows = []
    for size, words, edits in groups:
        base = [f"w{draw.randrange(4000)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for at in draw.sample(range(words), draw.randint(0, edits)):
                text[at] = f"e{draw.randrange(10**6)}" if draw.random() < 0.7 else "same"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_of_near_copies(spark, monkeypatch, seed):
    """The classes of all pairs in the buckets' families, for a share of their comparisons."""
    import itertools

    from attesta.llm import nearcopies

    draw = random.Random(seed)
    rows = edited_copies(draw, [(260, 220, 9), (60, 90, 4), (20, 60, 6), (3, 7, 1)])
    compared = []
    real = nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, sets: compared.append(pairs.count()) or real(pairs, sets))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "family", "shingle", "held", "root", "n", "w", "hub")})
    got = {r.id.id: r.component_id.id for r in nearcopies.near_copies(df).collect()}
    sets = [set(nearcopies.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: find(i) for i in range(len(rows))} == got
    pairs = 260 * 259 // 2 + 60 * 59 // 2
    assert len({*got.values()}) > 20 and sum(compared) < pairs / 4


def test_family_links_are_those_of_all_pairs(spark):
    """Any sets, not only copies: links of a family join just what similar pairs join."""
    import itertools

    import numpy as np

    from attesta.llm import nearcopies

    draw = random.Random(3)
    sets = {}
    for k in range(90):
        base = [x + 1000 * (k % 3) for x in range(1, draw.choice([6, 12, 25]))]
        sets[k] = sorted({x if draw.random() < 0.93 else draw.randrange(5000, 5040) for x in base})
    members = spark.createDataFrame([(k, len(s), k, 0) for k, s in sets.items()], "node long, n long, root long, family long")
    held = spark.createDataFrame([(k, np.array(s, np.uint64).tobytes()) for k, s in sets.items()], "node long, held binary")
    links = {tuple(sorted((r.u, r.v))) for r in nearcopies.family_links(members, held).collect()}
    similar = {(a, b) for a, b in itertools.combinations(sets, 2) if nearcopies.near(np.array(sets[a], np.uint64), np.array(sets[b], np.uint64))}

    def classes(pairs):
        root = {k: k for k in sets}
        for a, b in sorted(pairs) * 90:
            root[a] = root[b] = min(root[a], root[b])
        return root

    assert links <= similar and classes(links) == classes(similar) and len(similar) > len(sets)
