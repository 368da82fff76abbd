"""Hard negatives, language identification and phrases against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import collocations, multi_index, naive_bayes

VECTORS = "vec_id long, embedding array<float>, label int"


# ---- hard negatives


def plain_negatives(rows: list[tuple[int, int, list[int]]], every: int) -> set[tuple]:
    rows = sorted({(i, label, tuple(q)) for i, label, q in rows})
    width = max((len(q) for *_, q in rows), default=0)
    full = [(i, label, q + (0,) * (width - len(q))) for i, label, q in rows]
    out = set()
    for anchor, label, q in full:
        if anchor % every:
            continue
        scored = sorted((-sum(map(int.__mul__, q, r)), i, other == label) for i, other, r in full)
        positives = [(i, -s) for s, i, alike in scored if alike and i != anchor][:5]
        for positive, ps in positives:
            fit = [(i, -s) for s, i, alike in scored if not alike and 30 * ps <= -100 * s <= 90 * ps][:10]
            out |= {(anchor, positive, rank, i, ps, ns) for rank, (i, ns) in enumerate(fit, 1)}
    return out


def whole(x: list[float]) -> list[int]:
    return [math.floor(256 * float(np.float32(c))) for c in x]


def clustered(n: int, width: int, seed: int) -> list[tuple]:
    """Vectors around a few directions, with a third of all rows the same vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, width))
    rows = []
    for i in range(n):
        x = centres[0] if i % 3 == 0 else centres[rng.integers(6)] + rng.normal(0, 0.3, width)
        rows.append((i, [float(np.float32(c)) for c in x], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize(("n", "width", "first"), [(400, 6, 50), (400, 6, 100_000), (300, 5, 20), (60, 1, 10)])
def test_negatives_match_all_pairs(spark, n, width, first):
    data = clustered(n, width, n + width)
    frame = multi_index.whole_rows(spark.createDataFrame(data, VECTORS))
    got = multi_index.hard_negatives(frame, every=10, words=4, block=64, anchors=16, first=first)
    want = plain_negatives([(i, label, whole(x)) for i, x, label in data], 10)
    assert {tuple(r) for r in got.collect()} == want
    assert want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (0, [0.5, 2.0], 2), (None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1),
        (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None), (6, [], 1), (7, [1.0], 1), (8, [0.9, 0.9], 1),
        (9, [0.5, 0.5, 0.5], 2), (11, [0.4, 0.4], 2), (12, [-1.0, -1.0], 1), (13, [0.4, 0.4], 3), (100, [-1.0, -1.0], 9), (101, [1.0, 1.0], 9),
    ]
    frame = spark.createDataFrame(data, VECTORS).select("*", *(F.lit("x").alias(c) for c in ("q", "cell", "place", "score", "rank")))
    got = multi_index.hard_negatives(multi_index.whole_rows(frame), every=100)
    sound = [(i, x, y) for i, x, y in data if None not in (i, x, y) and all(c is not None and math.isfinite(c) for c in x)]
    assert {tuple(r) for r in got.collect()} == plain_negatives([(i, y, whole(x)) for i, x, y in sound], 100)
    assert len(multi_index.hard_negatives(multi_index.whole_rows(frame.limit(0))).collect()) == 0
    assert len(multi_index.hard_negatives(multi_index.whole_rows(frame.where("vec_id = 7"))).collect()) == 0


def test_cells_come_by_falling_bounds_that_hold():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (500, 6))
    books = tuple(multi_index.codebook(h.astype(float), 8) for h in multi_index.halves(x))
    (a, far_a), (b, far_b) = (multi_index.nearest(h.astype(float), book) for h, book in zip(multi_index.halves(x), books, strict=True))
    radii = tuple(np.array([far[w == k].max(initial=0) for k in range(len(book))]) for w, far, book in ((a, far_a, books[0]), (b, far_b, books[1])))
    cells = a * len(books[1]) + b
    index = multi_index.Index(books, radii, np.bincount(cells, minlength=len(books[0]) * len(books[1])), 6)
    anchor = x[17]
    seen = list(multi_index.visits(index, anchor))
    assert sorted(c for _, c, _ in seen) == list(range(len(index.counts)))
    assert [u for u, *_ in seen] == sorted((u for u, *_ in seen), reverse=True)
    for upper, cell, lower in seen:
        assert all(lower <= s <= upper for s in x[cells == cell] @ anchor)


def test_route_stops_where_no_cell_can_add(spark):
    data = [(i, [40.0 * (i % 5 == k) + 0.01 * (i % 7) for k in range(6)], i % 3) for i in range(500)]
    store = multi_index.build(multi_index.whole_rows(spark.createDataFrame(data, VECTORS)), words=8, block=64)
    anchor = np.array(whole(data[0][1]))
    cells, seen, bound = multi_index.route(store.index, anchor, 0, 10**9, 10**6, multi_index.HIGH)
    assert bound is None
    assert 0 < store.index.counts[cells].sum() <= 150
    again = multi_index.route(store.index, anchor, 0, 50, 10**6, multi_index.HIGH)
    rest = multi_index.route(store.index, anchor, again[1], 10**9, 10**6, multi_index.HIGH)
    assert again[0] + rest[0] == cells


def test_large_scores_are_exact_and_ties_go_by_id():
    x = np.array([[1 << 30, 3], [-(1 << 30), 1]])
    assert multi_index.products(x, x).tolist() == [[(1 << 60) + 9, 3 - (1 << 60)], [3 - (1 << 60), (1 << 60) + 1]]
    wide = np.array([[1 << 40, 1 << 40]])
    assert multi_index.products(wide, wide).tolist() == [[(1 << 63) - 1]]
    scores = np.array([[5, 7, 7, 7, (1 << 60) + 1, 1 << 60]])
    anchor, row = multi_index.best_rows(scores, scores > 0, np.array([1, 9, 2, 4, 8, 3]), 4)
    assert anchor.tolist() == [0] * 4 and row.tolist() == [4, 5, 2, 3]


# ---- language identification


def plain_slots(text: str, slots: int) -> list[int]:
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    spaced, mask, out = re.sub(" +", " ", spaced), (1 << 64) - 1, []
    for n in naive_bayes.SIZES:
        for i in range(len(spaced) - n + 1):
            gram = spaced[i : i + n]
            if gram == " ":
                continue
            h = n
            for c in gram:
                h = ((h * naive_bayes._MIX[0] + ord(c)) * naive_bayes._MIX[1]) & mask
                h ^= h >> 29
            out.append(((h * naive_bayes._MIX[2] & mask) >> 16) & (slots - 1))
    return out


def test_naive_bayes_matches_its_formula(spark, rows, docs):
    import zlib

    def held(x: dict) -> bool:
        return zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1

    learned = [x for x in rows if not held(x) and x["lang"] is not None]
    langs = sorted({x["lang"] for x in learned})
    counts = {lang: Counter() for lang in langs}
    for x in learned:
        counts[x["lang"]].update(plain_slots(x["text"] or "", naive_bayes.SLOTS))
    sizes = {lang: sum(counts[lang].values()) + naive_bayes.SMOOTHING * naive_bayes.SLOTS for lang in langs}
    got = {r.doc_id: r for r in naive_bayes.languages(docs).collect()}
    assert len(got) == len(rows)
    for x in rows[:120]:
        grams = Counter(plain_slots(x["text"] or "", naive_bayes.SLOTS))
        total = [
            math.log(sum(y["lang"] == lang for y in learned) / len(learned))
            + sum(n * math.log((counts[lang][s] + naive_bayes.SMOOTHING) / sizes[lang]) for s, n in grams.items())
            for lang in langs
        ]
        best = max(range(len(langs)), key=lambda i: total[i])
        r = got[x["doc_id"]]
        assert r.held_out == held(x)
        assert r.lang_pred == langs[best]
        assert r.score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total), abs=1e-3)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = naive_bayes.languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, total = found.agg(F.avg(F.expr("cast(lang = lang_pred as int)")), F.count("*")).first()
    assert total > 250 and right > 0.98


def test_languages_of_odd_rows(spark, odd, nothing):
    got = naive_bayes.languages(odd).collect()
    source = odd.select("doc_id", "text").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in source)
    blank = {1, 2, 3}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in blank:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is None:
            assert not r.held_out
    assert naive_bayes.languages(nothing).collect() == []
    unlabelled = naive_bayes.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    broken = odd.withColumn("text", F.expr("cast(unhex('ff41fe42') as string)"))
    assert naive_bayes.languages(broken).count() == odd.count()


def test_windows_of_a_long_text_count_each_gram_once(monkeypatch):
    monkeypatch.setattr(naive_bayes, "WINDOW", 7)
    texts = ["abc  déf 12 ghi " * 5, "", "x", "Ünï 日本語 z"]
    points, of, _ = naive_bayes.normal_form([t.encode() for t in texts])
    found = defaultdict(Counter)
    for slot, text in naive_bayes.slot_windows(points, of, 1 << 12):
        for s, t in zip(slot.tolist(), text.tolist(), strict=True):
            found[t][s] += 1
    assert [found[i] for i in range(4)] == [Counter(plain_slots(t, 1 << 12)) for t in texts]


def test_many_languages_shrink_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(naive_bayes, "CELLS", 1 << 10)
    monkeypatch.setattr(naive_bayes, "HELD_LANGS", 2)
    data = [(i, f"word{chr(97 + i % 20)} " * 3, f"l{i % 20:02d}") for i in range(200)]
    model = naive_bayes.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert model.matrix.shape == (32, 20)
    monkeypatch.setattr(naive_bayes, "MAX_LANGS", 3)
    assert len(naive_bayes.fit(spark.createDataFrame(data, "doc_id long, text string, lang string")).langs) == 3


# ---- phrases


def plain_phrases(rows: list[SimpleNamespace], support: int, longest: int, top: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        folded = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    frequent = {k: v for k, v in f.items() if v >= support}
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        longer = (q for (other, q), v in frequent.items() if other == lang and len(q) > len(p) and v >= a)
        if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total, -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right, total) in enumerate(sorted(found)[:top], 1)
    )


def some_texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["a", "B", "c", "dd", "é", "the", "of", "x\x1cy", "日本"]
    out = []
    for i in range(120):
        spans = []
        for _ in range(rng.randrange(4)):
            spans.append(rng.choice([" ", "\t", "  "]).join(rng.choices(words, [9, 5, 4, 2, 2, 9, 9, 1, 1], k=rng.randrange(12))))
        out.append((rng.choice([i, 7, None]), rng.choice(".,\n!").join(spans) if spans else None, rng.choice(["en", "en", "en", "de", None, "und"])))
    return out


def test_word_hashes_follow_the_words(monkeypatch):
    text = "A\tbb  a,bb. . \n é日本\x1cx a;a  bb!" + "w" * 50 + " a"
    want = text.lower().encode().translate(bytes.maketrans(b",;!\n\t", b".... ")).replace(b".", b" . ").split()
    whole = collocations.word_hashes(text.encode())
    assert (whole == 0).tolist() == [w == b"." for w in want]
    by_word = defaultdict(set)
    for w, h in zip(want, whole.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(hashes) == 1 for hashes in by_word.values())
    assert len({min(h) for h in by_word.values()}) == len(by_word)
    for stretch in (1, 3, 7):
        monkeypatch.setattr(collocations, "STRETCH", stretch)
        assert collocations.word_hashes(text.encode()).tolist() == whole.tolist()
    assert [len(collocations.word_hashes(t)) for t in (b"", b" ", b".", b"a")] == [0, 0, 1, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_match_plain_counts(spark, monkeypatch, seed):
    monkeypatch.setattr(collocations, "CHUNK", 300)
    monkeypatch.setattr(collocations, "NEAR", 2)
    data = some_texts(seed)
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = collocations.collocations(frame, support=4, top=15, shards=3)
    want = plain_phrases([SimpleNamespace(doc_id=i, text=t, lang=lang) for i, t, lang in data], 4, 5, 15)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 20


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    frame = spark.createDataFrame(some_texts(3), "doc_id long, text string, lang string")
    want = sorted(collocations.collocations(frame, support=5, shards=4).collect())
    monkeypatch.setattr(collocations, "LEAST_BITS", 3)
    monkeypatch.setattr(collocations, "MOST_BITS", 4)
    assert sorted(collocations.collocations(frame, support=5, shards=4).collect()) == want


def test_shards_miss_no_frequent_phrase(spark, monkeypatch):
    """One document in a shard of its own holds few of the occurrences, the others very many."""
    data = [(i, "rare pair here. " * (1 if i else 12) + "other words only " * 40, "en") for i in range(9)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    monkeypatch.setattr(collocations, "NEAR", 0)
    found, totals = collocations.frequent_phrases(frame, support=20, shards=5)
    assert {r.phrase: r.f for r in found.collect()}["rare pair here"] == 20
    assert totals.first().n == 9 * 120 + 20 * 3


def test_phrases_of_odd_rows(spark, odd, nothing):
    rows = [SimpleNamespace(**r.asDict()) for r in odd.select("doc_id", "text", "lang").collect()]
    got = sorted(tuple(r) for r in collocations.collocations(odd, support=100).collect())
    assert got == plain_phrases(rows, 100, 5, 2000)
    assert got
    assert collocations.collocations(nothing).collect() == []
    blank = collocations.collocations(odd.where("doc_id < 4"), support=1).collect()
    assert blank == []
    broken = odd.withColumn("text", F.expr("cast(unhex('ff20fe20ff20fe') as string)"))
    assert {r.phrase for r in collocations.collocations(broken, support=2).collect()} == {"\ufffd" + " \ufffd" * n for n in (1, 2, 3)}


def test_scores_pass_64_bits(spark):
    """The exact quotient of numbers whose products need more than 64 bits."""
    text = "1000 * cast(3000000000 as long)"
    exact = f"(cast({text} as decimal(19, 0)) * cast(9000000000000000 as decimal(18, 0))) div (cast(2999999999 as decimal(18, 0)) * cast(3000000007 as decimal(18, 0)))"
    assert spark.range(1).selectExpr(exact).first()[0] == 1000 * 3000000000 * 9000000000000000 // (2999999999 * 3000000007)
