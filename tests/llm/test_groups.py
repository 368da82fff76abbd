"""SimHash and embedding near-duplicates, components and the Golay code."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import brute
from pyspark.sql import functions as F

from wardline.llm import epsilon_grid, golay, simhash
from wardline.llm.components import connected, local_roots
from wardline.llm.numbering import numbered

WORD23 = st.integers(0, (1 << 23) - 1)


def test_golay_code_is_perfect():
    assert len({golay.codeword(d) for d in range(1 << 12)}) == 1 << 12
    assert min(golay.codeword(d).bit_count() for d in range(1, 1 << 12)) == 7
    rows, _ = golay.indices(np.arange(0, 1 << 23, 4099))
    assert set(np.bincount(rows)) == {1, 6}


@settings(max_examples=200, deadline=None)
@given(WORD23, st.sets(st.integers(0, 22), max_size=2))
def test_two_bits_share_an_index(word, bits):
    other = word ^ sum(1 << b for b in bits)
    sets = [set(golay.indices(np.array([w]))[1]) for w in (word, other)]
    assert sets[0] & sets[1]


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    pairs += [(i, i + 1) for i in range(500, 600)] + [(700, i) for i in range(701, 900)] + [(3, 3)]
    linked = {frozenset(p) for p in pairs}
    want = brute.roots(900, lambda i, j: frozenset((i, j)) in linked)
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(900))
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots():
    linked = np.zeros((5, 5), dtype=bool)
    for i, j in ((4, 2), (2, 1)):
        linked[i, j] = linked[j, i] = True
    assert list(local_roots(linked)) == [0, 1, 1, 3, 1]


def test_numbers_follow_the_order(spark):
    frame = spark.createDataFrame([(None,), *((f"k{i:03d}",) for i in range(200, 0, -1))], "k string")
    got = {r.k: r.position for r in numbered(frame, [F.col("k").asc_nulls_last()]).collect()}
    assert got == {**{f"k{i:03d}": i - 1 for i in range(1, 201)}, None: 200}


def _fingerprint_set() -> list[int]:
    rng = random.Random(3)
    out = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    for fp in list(out)[:30]:
        out |= {fp ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3, 4]))) for _ in range(4)}
    center = rng.getrandbits(64)
    out |= {center ^ (1 << b) for b in range(64)} | {center ^ (1 << b) ^ (1 << c) for b in range(20) for c in range(b)}
    return sorted(out)


@pytest.mark.parametrize("pairwise", [2, 96])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_fingerprint_links_lose_none(spark, pairwise, bits):
    fps = _fingerprint_set()
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, pairwise)
    got = {r.node: r.root for r in connected(links).collect()}
    order = sorted(range(len(fps)), key=lambda i: signed[i])
    want = brute.roots(len(fps), lambda i, j: (fps[order[i]] ^ fps[order[j]]).bit_count() <= bits)
    assert all(got.get(signed[order[i]], signed[order[i]]) == signed[order[want[i]]] for i in range(len(fps)))
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([], "fp long"), 3)


def test_simhash_query_matches_all_pairs(spark, docs, rows):
    fps = [brute.fingerprint(r["text"]) for r in rows]
    want = brute.roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == {r["doc_id"]: (f"{fps[i]:016x}", rows[want[i]]["doc_id"]) for i, r in enumerate(rows)}
    kept = simhash.simhash_survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[i]["doc_id"] for i in want})


def test_simhash_odd_rows(odd, nothing):
    got = [tuple(r) for r in simhash.simhash_groups(odd).collect()]
    assert len(got) == 12
    assert {g[2] for g in got if g[1] == "0" * 16} == {1}
    assert sum(g[0] == 5 and g[2] == 5 for g in got) == 3
    kept = simhash.simhash_survivors(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("one two three four") == 1 and "no id here" in texts and texts.count(None) == 1
    assert simhash.simhash_groups(nothing).count() == 0 and simhash.simhash_survivors(nothing).count() == 0


def _vectors() -> list[tuple]:
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=12) for _ in range(120)]
    rows += [rows[i] + rng.normal(size=12) * s for i in range(25) for s in (0.01, 0.05, 0.1)]
    rows += [rows[0]] * 5 + [rows[1] * 7]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_join_matches_all_pairs(spark, block):
    vectors = _vectors()
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    want = brute.roots(len(x), lambda i, j: cosine[i, j] >= 0.95)
    odd = [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] + [1.0] * 11), (904, [float("inf")] * 12), (905, [None, 1.0]), (None, None)]
    frame = spark.createDataFrame([(*v, "x") for v in vectors + odd], "vec_id long, embedding array<float>, rep string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsilon_grid.embedding_links(frame, block=block).collect()}
    for i in range(len(x)):
        assert got[i] == (int((cosine[i] >= 0.95).sum()) - 1, want[i], want[i] == i)
    assert all(got[i] == (0, i, True) for i, _ in odd)
    assert epsilon_grid.embedding_links(frame.limit(0)).count() == 0


def test_distant_blocks_are_skipped(spark):
    rows = [(i, [float(10 * (i // 8)), float(10 * (i // 8)) + 1]) for i in range(64)]
    boxes = spark.createDataFrame([(i, v[:1], v[1:]) for i, v in rows], "block long, low array<double>, high array<double>")
    pairs = {(r.a, r.b) for r in epsilon_grid.near_blocks(boxes, 64, 0.5).collect()}
    assert pairs == {(a, b) for a in range(64) for b in range(a, 64) if a // 8 == b // 8}


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Blocks are dealt to parts before they meet; a pair of blocks goes straight to its comparison."""
    rows = spark.range(6).selectExpr("id block", "array(id) reps", "array(1L) counts", "unhex('00') units")
    pairs = spark.range(6).selectExpr("id a", "explode(sequence(id, 5L)) b")
    plan = epsilon_grid._join_blocks(pairs, rows, np.eye(1), 0.95, 6)._jdf.queryExecution().sparkPlan().toString()
    above, met, _ = plan.partition("CartesianProduct")
    assert met and "Exchange" not in above and "Join" not in above


def test_vectors_of_any_length(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0]), (3, [0.0, 0.0, 1e-30]), (3, [0.0, 0.0, 1e30])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in epsilon_grid.embedding_links(frame).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3)]
