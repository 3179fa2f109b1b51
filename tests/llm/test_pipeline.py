"""The pipeline's stages against plain Python, each on its own input."""

import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from attesta.llm import mixing, nearcopies, simhash
from attesta.llm.decontaminate import gram_hashes, word_hashes
from attesta.llm.queries import tokenizer_path
from tests.llm.test_operators import SF, plain_contamination


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language id"](spark, docs, SF)
    assert known.columns == docs.columns
    letters = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    kept = {r.doc_id for r in known.collect()}
    assert kept <= letters and len(kept) >= 0.98 * len(letters)

    one = stage["near duplicates"](spark, docs, SF)
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    first = plain_near_copies([t for _, t in texts])
    assert sorted(r.doc_id for r in one.collect()) == [texts[i][0] for i in sorted(set(first))]

    clean = stage["decontamination"](spark, docs, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [r[0] for r in plain_contamination(texts, items) if not r[2]]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(want)

    mixed = stage["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2 and set(times) <= {i for i, _ in texts}

    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    for r, (i, t) in zip(sorted(stage["token ids"](spark, docs, SF).collect(), key=lambda r: r.start), texts, strict=True):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


CLASHING = ["id", "node", "size", "target", "taken", "source_size", "shard", "text_hash", "begin", "end", "items", "component_id", "n", "h", "rejected"]


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns of clashing names, empty tables."""
    long = " ".join(f"the{i % 700} house" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, long, "en", None, 1), (5, long, "en", None, 1), (None, "some words without an id", "en", "s", 1), (None, "some words without an id", None, "s", None)]
    rows += [(6, "one and the same row", "en", "t", 1)] * 3 + [(6, "another text of that id", "en", "t", 1), (7, "12 34", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHING))
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stage = dict(corpus_pipeline.STAGES)
    got = {name: f(spark, docs, SF) for name, f in stage.items()}
    assert all(got[name].columns == corpus_pipeline.COLUMNS for name in list(stage)[:-1])
    known = texts(got["language id"])
    assert all(re.search(r"[^\W\d_]", t or "") for _, t in known) and set(known) <= {(r[0], r[1]) for r in rows}
    want = [(1, None), (4, long), (None, "some words without an id"), (6, "one and the same row"), (6, "another text of that id"), (7, "12 34")]
    assert texts(got["near duplicates"]) == sorted(want, key=str)
    assert texts(got["decontamination"]) == texts(docs)
    mixed = texts(got["mixing"])
    assert set(mixed) <= {(r[0], r[1]) for r in rows if (r[1] or "").strip()} and all(mixed.count(x) <= 2 * [r[:2] for r in rows].count(x) for x in set(mixed))
    assert len(got["token ids"].collect()) == len(rows)
    empty = docs.limit(0)
    assert all(f(spark, empty, SF).count() == 0 for f in stage.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_mixing_meets_targets(spark):
    """Whole copies come to the target of each source, also where the target is a part of the source."""
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    rows = [(i if i % 500 else None, "w " * (1 + i * 37 % 400), "hot" if i % 10 < 3 else f"cold{i // 10 % 20}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.mix(docs, shard_words=50_000).collect()}
    kept, times = {}, {}
    for r in mixing.repeat_taken(docs, shard_words=50_000).collect():
        kept[r.source] = kept.get(r.source, 0) + words(r.text)
        times[r.doc_id, r.text, r.source] = times.get((r.doc_id, r.text, r.source), 0) + 1
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    assert any(0.1 < target[s] / size[s] < 0.45 for s in size)  # such a source used to vanish
    assert all(abs(kept[s] - t) <= 0.02 * t for s, t in target.items())
    assert max(n for (i, _, _), n in times.items() if i is not None) <= 2 and any(i is None for i, _, _ in times)


def plain_near_copies(texts):
    """Each text's first near copy, over all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or (a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])):
                if find(i) != find(j):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_by_shingles(spark):
    """Recall against all pairs: texts with a few edited words go, texts below the similarity stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    draw, rows = random.Random(4), []
    for i in range(60):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([30, 120, 400]))]
        for k in range(5):  # from equal to clearly below the similarity
            text = list(base)
            for at in draw.sample(range(len(text)), len(text) * k // 80):
                text[at] = "edited"
            rows.append((100000 + 5 * i + k, " ".join(text)))
    rows += [(200000, "four short words here"), (200001, "Four short  words here"), (200002, ""), (200003, " "), (200004, None)]
    rows = sorted(rows + [(r.doc_id, r.text) for r in docs.collect()])
    want = [rows[i][0] for i in sorted(set(plain_near_copies([t for _, t in rows])))]
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, _wide(spark, rows), SF).collect())
    assert got == want


def test_a_chain_of_near_copies(spark):
    """A group in which most texts are near some but not all others: links as all pairs would set them."""
    draw, rows = random.Random(8), []
    base = [f"w{draw.randrange(3000)}" for _ in range(150)]
    for i in range(400):
        text = list(draw.choice(rows)[1].split() if i % 3 else base) if rows else list(base)
        for _ in range(draw.randrange(5)):
            text[draw.randrange(len(text))] = draw.choice(["edited", "other", f"x{i}"])
        rows.append((i, " ".join(text)))
    first = plain_near_copies([t for _, t in rows])
    assert 3 < len(set(first)) < 300  # several classes, large and small
    got = sorted(r.doc_id for r in nearcopies.keep_one(_wide(spark, rows)).collect())
    assert got == sorted({rows[i][0] for i in first})


def without_a_shared_band(draw, n_words):
    """A text and its copy with one word edited for each band: no band keeps its smallest hashes."""
    words = [f"w{draw.randrange(10**6)}" for _ in range(n_words)]
    base, edited = " ".join(words), list(words)
    grams = gram_hashes(word_hashes(base, nearcopies._IS_WORD)[0], 5)
    while True:
        a, b = (nearcopies.buckets(nearcopies.shingles(t)) for t in (base, " ".join(edited)))
        if not (a == b).any():
            return base, " ".join(edited)
        row = int(np.flatnonzero(a == b)[0]) * nearcopies.ROWS
        least = ((grams ^ nearcopies._FLIP[row]) * nearcopies._ODD[row]).argmin()
        edited[least + 2] = f"x{draw.randrange(10**6)}"


def test_near_copies_meet_by_their_fingerprints(spark):
    """Copies that share no band are linked through the vantage-point shards, and what is not similar stays apart."""
    draw, rows = random.Random(6), []
    while len(rows) < 6:
        pair = without_a_shared_band(draw, 20_000)
        a, b = (simhash.majority(nearcopies.shingles(t)) for t in pair)
        if (a ^ b).bit_count() <= nearcopies.RADIUS:
            rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
    first = plain_near_copies([t for _, t in rows])
    assert first == [0, 0, 2, 2, 4, 4]
    got = {r.id.id: r.component_id.id for r in nearcopies.near_copies(_wide(spark, rows)).collect()}
    assert got == dict(enumerate(first))


def test_sources_are_links_that_span():
    draw = np.random.default_rng(5)
    x = np.unique(draw.integers(0, 1 << 62, 40, np.uint64)[draw.integers(0, 40, 900)] ^ (np.uint64(1) << draw.integers(0, 64, 900, np.uint64)))
    source, root = simhash.sources_within(x, 3), simhash.components_within(x, 3)
    assert (np.bitwise_count(x ^ source.view(np.uint64)) <= 3).all() and (source != x.view(np.int64)).sum() == len(x) - len(set(root.tolist()))
    at = source
    for _ in range(len(x)):
        at = source[np.searchsorted(x, at.view(np.uint64))]
    assert len(set(zip(at.tolist(), root.tolist(), strict=True))) == len(set(root.tolist())) == len(set(at.tolist()))


def _wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
