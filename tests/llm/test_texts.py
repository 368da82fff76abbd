"""Mixing, quality rules, line dedup and personal data."""

from __future__ import annotations

import hashlib
import re

import pytest
from llm import brute
from pyspark.sql import functions as F

from wardline.llm import divergence, line_windows, mixing, pii_boosting

from llm.conftest import DOCS


def _targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, budget, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = {s: budget * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] >= 3 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in above}
        budget -= sum(3 * sizes[s] for s in above)
        free -= above
    return target


def test_mix_meets_its_targets(docs, rows):
    got = mixing.with_copies(docs).select("kept.*", "*").collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want, source = _targets(sizes), {r["doc_id"]: r["source"] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    longest = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        ratio = want[s] / sizes[s]
        assert r.taken == r.copies * r.size and r.copies in (int(ratio), int(ratio) + (ratio < 3))
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.with_copies(docs.repartition(7)).select("kept.doc_id", "taken").collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_takes_the_smallest_ratios(spark):
    frame = spark.createDataFrame([(i, "word " * (1 + i % 5), "en", "ab"[i % 4 == 0], 1) for i in range(4000)], DOCS)
    got = mixing.with_copies(frame, weights=(1, 9), keep=("doc_id", "source")).select("kept.*", "copies").withColumn("draw", F.conv(F.substring(mixing.draw(F.col("doc_id"), 17), 1, 13), 16, 10).cast("long")).collect()
    for s in "ab":
        own = sorted((r.draw, r.copies) for r in got if r.source == s)
        extra = [c > min(c for _, c in own) for _, c in own]
        assert extra == sorted(extra, reverse=True) and (len(set(extra)) == 2 or own[0][1] == 3)


def test_mix_prefers(spark):
    frame = spark.createDataFrame([(i, "a b c", "en", "ab"[i % 2], 1, [1.0, 4.0, 0.0, None, -1.0][i // 2 % 5]) for i in range(4000)], DOCS + ", liking double")
    got = mixing.with_copies(frame, weights=(3, 1), preference="liking", keep=("doc_id", "source", "liking")).select("kept.*", "copies", "taken").collect()
    mean = lambda s, x: sum(r.copies for r in got if r.source == s and r.liking == x) / 400
    assert mean("b", 4.0) > 3 * mean("b", 1.0) > 0
    assert all(r.copies == 0 for r in got if not r.liking or r.liking < 0)
    assert abs(sum(r.taken for r in got if r.source == "b") - 3000) <= 3


def test_mix_odd_rows(odd, nothing):
    got = mixing.with_copies(odd, keep=tuple(odd.columns[:5])).select("kept.*", "copies", "target").collect()
    assert len(got) == 12 and all(r.copies == 0 for r in got if not brute.words(r.text))
    assert {r.copies for r in got if r.text == "one two three four"} in ({0}, {1}, {2}, {3})
    assert len({r.target for r in got if r.source is None}) == 1
    assert mixing.with_copies(nothing).count() == 0


def test_base_counts(docs, rows):
    got = {r.doc_id: tuple(r)[1:7] for r in divergence.judged(docs.select("doc_id", "lang", "text")).select("doc_id", *list(divergence.ADDED)[:6]).collect()}
    assert got == {r["doc_id"]: brute.base_counts(r["text"]) for r in rows}


@pytest.mark.parametrize("text", ["a b c d e f g h " * 2, "a " * 30, "a b c d e f g h x a b c d e f g h", "\n".join(["x y", "x y", "", "", "x y"]), "é|ü #x", ""])
def test_counts_of_small_texts(text):
    found = divergence.base(text.encode(), text.encode().split())
    assert (*found, found.failed) == brute.base_counts(text)


def test_verdicts_follow_the_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = divergence.judged(docs).join(labels, "doc_id").where("n_words >= 20").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.1


def test_documents_of_unnamed_language_pass_as_their_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    known = divergence.references(docs)
    unnamed = docs.withColumn("lang", F.lit(None).cast("string"))
    own, free = ({r.doc_id for r in divergence.judged(d, known).where("kept").collect()} for d in (docs, unnamed))
    assert len(known) == 4 and own <= free and len(free - own) < 0.01 * len(own)


def test_base_rules_decide_for_small_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rare = docs.where("lang = 'es' and length(text) between 300 and 900").orderBy("doc_id").limit(8).withColumn("lang", F.lit("rare"))
    got = divergence.judged(docs.where("lang = 'en'").unionByName(rare)).where("lang = 'rare'").collect()
    assert 0 < sum(r.n_words for r in got if not r.base_failed) < divergence.LEAST_REFERENCE
    assert any(r.n_words >= 60 and r.kept for r in got)
    assert all(r.kept == (not r.base_failed) and r.char_distance is None and r.word_distance is None for r in got)


def test_distance_is_a_metric_value():
    import numpy as np

    assert divergence.js_distance(np.array([1, 0]), np.array([0, 5])) == 1.0
    assert divergence.js_distance(np.array([2, 4]), np.array([1, 2])) == 0.0
    assert divergence.js_distance(np.zeros(2), np.ones(2)) == 1.0


def test_quality_odd_rows(odd, nothing):
    got = divergence.judged(odd)
    assert set(got.columns) == set(odd.columns) | set(divergence.ADDED)
    rows = got.collect()
    assert len(rows) == 12 and not any(r.kept for r in rows)
    assert divergence.judged(nothing).count() == 0


def test_line_windows_match_brute_force(docs, rows):
    got = {r.doc_id: r.text for r in line_windows.without_repeated_windows(docs).collect()}
    assert got == brute.without_windows([(r["doc_id"], r["text"]) for r in rows])


def test_line_windows_merge_and_keep_the_first(spark):
    texts = {1: "a\nb\nc\nd\ne", 2: "x\n a\nb \n\nc\nd\ny", 3: "b\nc\nd\nz", 4: "a\nb", 5: "q\nq\nq\nq\nq", 6: "a\nb\nc\nd\ne", 9: "one long line " * 5000}
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    rows = {r.doc_id: r for r in line_windows.without_repeated_windows(frame).collect()}
    got = {i: r.text for i, r in rows.items()}
    assert got == brute.without_windows(list(texts.items()))
    assert got[1] == texts[1] and got[2] == "x\ny" and got[3] == "z" and got[4] == texts[4] and got[5] == "" or got[5]
    assert (rows[2].n_lines, rows[2].n_removed, rows[6].text, rows[6].n_words_left) == (6, 4, "", 0)


def test_line_windows_odd_rows(odd, nothing):
    got = line_windows.without_repeated_windows(odd)
    rows = got.collect()
    assert set(odd.columns) <= set(got.columns) and len(rows) == 12
    assert sum(r.text is None for r in rows) == 2
    assert line_windows.without_repeated_windows(nothing).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _passes(kind: str, hit: str) -> bool:
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in hit.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and _luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def _base_spans(text: str) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if _passes(k, m.group())]


PERSONAL = [
    "mail a@b.c_x@d.e and a.b@c-d.ef.gh. or @x.y foo@.bar@x.y a@b a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 00000000000000000001.2.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 or 4111111111111112 4111  1111", "+1 (902) 555-1127 +1234 +49.30.1234567 +12345678901234567 +1()",
    "é日\U0001f600 x@y.zz 日 +49 30 1234567é", "a" * 30_000 + " " + "1" * 30_000 + "@" + "1 " * 9000, "", "no data",
]


def test_base_spans_match_plain_patterns(spark, docs, rows):
    texts = {**{r["doc_id"]: r["text"] for r in rows}, **{1000 + i: t for i, t in enumerate(PERSONAL)}}
    frame = docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(PERSONAL)], DOCS))
    got = {r.doc_id: r for r in pii_boosting.pii(frame).collect()}
    for i, text in texts.items():
        base = _base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, base)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k + ":") for b in base) for k in PATTERNS]
        assert set(base) <= set(got[i].spans.split(",")) or not base


def test_added_spans(spark, docs):
    personal = ["please call me: (555) 867-5309 thanks", "write to ann [at] mail [dot] example [dot] com now", "tel 212-555-0147 ok", "host 2001:db8:1:2:3:4:5:6 up"]
    plain = ["order 20431999 shipped", "version 3.11.4.20240501", "at 12:30:45 on 2024-03-01", "the population was 83 200 000", "see page 12-3456789"]
    frame = spark.createDataFrame([(10_000 + i, t, "en", "s", 1) for i, t in enumerate(personal + plain)], DOCS)
    got = {r.doc_id: r.spans for r in pii_boosting.pii(docs.unionByName(frame)).where("doc_id >= 10000").collect()}
    found = [bool(got[10_000 + i]) for i in range(len(personal + plain))]
    assert found == [True] * len(personal) + [False] * len(plain), got


def test_strict_spans_do_not_move_the_thresholds():
    from wardline.llm.boosting import Pattern, boosted

    def loose(cue: int, negative: float, positive: float) -> Pattern:
        return Pattern((6, 0, 3, 2, 3, cue, 0, 0, 0), negative, positive)

    strict = [Pattern((3, 1, d, 2, g, 1, 0, 0, 0), 0.0, 9.0) for d in range(8) for g in range(1, 9)]
    trees = boosted([*strict, loose(1, 0.0, 9.0), loose(0, 3.0, 6.0)])
    apart = [loose(1, 0.0, 3.0), loose(0, 2.0, 1.0)]
    good, bad = (pii_boosting.margin(trees, p.features) for p in apart)
    assert good > bad > 0
    assert pii_boosting._thresholds(trees, apart)["phone"] == pii_boosting._thresholds(trees, apart + strict)["phone"] == good


def test_pii_odd_rows(odd, nothing):
    got = pii_boosting.pii(odd).collect()
    assert len(got) == 12 and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii_boosting.pii(nothing).count() == 0
