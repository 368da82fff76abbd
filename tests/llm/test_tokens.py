"""Token files, packing, classifiers, the queries and the pipeline."""

from __future__ import annotations

import importlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm import brute
from tokenizers import Tokenizer

from wardline.llm import byte_cnn, divergence, learning, packing, token_files, tokens, toxic_cnn
from wardline.llm.learning import Adam, best_cut, calibrated, maybe_among
from wardline.llm.queries import QUERIES, vocabulary
from wardline.llm.tokens import Encoder

from llm.conftest import SMALL

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def _ids(path: str, texts: list[str | None], end: int) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(path)
    return [[*e.ids, end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("path", "spaced"), [(WORDS, False), (BYTES, True)])
def test_pieces_encode_like_whole_texts(path, spaced):
    rng = random.Random(1)
    signs = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0   　aB9é!?'sΣς́İ"
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(1500)] + ["don't  stop", "x" * 3000, " ", ""]
    encoder = Encoder(path, spaced, "uint32")
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder([t.encode() for t in texts]) == want
    assert encoder([t.encode() for t in texts]) == want
    with pytest.raises(ValueError):
        Encoder(path, spaced, "uint8")


def test_files_round_trip(docs, rows):
    order = sorted(rows, key=lambda r: r["doc_id"])
    ids = _ids(WORDS, [r["text"] for r in order], 2)
    got = sorted(tuple(r) for r in token_files.read_token_files(token_files.write_token_files(docs, WORDS, 2)).collect())
    starts = np.cumsum([0, *map(len, ids)])
    assert got == [(r["doc_id"], int(s), len(x), brute.crc(x)) for r, s, x in zip(order, starts, ids, strict=False)]


def test_file_format(spark, docs, rows, tmp_path):
    manifest = token_files.write_token_files(docs, WORDS, 2, folder=f"file://{tmp_path}").collect()
    first = next(r for r in sorted(manifest, key=lambda r: r.part) if r.n_docs)
    tokens, offsets, ids = (np.fromfile(f"{first.path}.{n}", dtype=d) for n, d in (("tokens", "<u2"), ("offsets", "<i8"), ("ids", "<i8")))
    assert first.first_token == 0 and len(tokens) == first.n_tokens == offsets[-1] and len(offsets) == first.n_docs + 1
    text = {r["doc_id"]: r["text"] for r in rows}
    assert tokens[: offsets[1]].tolist() == _ids(WORDS, [text[ids[0]]], 2)[0]
    assert sum(r.n_docs for r in manifest) == len(rows)
    with pytest.raises(ValueError):
        token_files.mounted("hdfs://host/folder")


def test_files_of_odd_rows(odd, nothing):
    got = token_files.read_token_files(token_files.write_token_files(odd, WORDS, 2)).collect()
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [1, 2, 3, 4, 5, 5, 5, 6, 7, 8, None, None]
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start[:-1])]).tolist()
    assert by_start[0].n_tokens == 1
    assert token_files.read_token_files(token_files.write_token_files(nothing, WORDS, 2)).count() == 0


def _check_sequences(got, ids: dict, capacity: int) -> float:
    """All ids once, offsets gapless; the share of padding."""
    pieces: dict = {}
    sequences: dict = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.ids_crc32 == brute.crc(ids[doc][at : at + r.length])
            at += r.length
        assert at == len(ids[doc])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return 1 - sum(len(x) for x in ids.values()) / (len(sequences) * capacity)


@pytest.mark.parametrize(("parts", "most_open"), [(1, 64), (40, 4)])
def test_packing(docs, rows, parts, most_open):
    ids = dict(zip([r["doc_id"] for r in rows], _ids(BYTES, [r["text"] for r in rows], 1), strict=True))
    got = packing.packed(docs.repartition(parts, "doc_id"), BYTES, 1, most_open=most_open).collect()
    assert _check_sequences(got, ids, 2048) < 0.03


def test_packer_is_best_fit_and_bounded():
    packer = packing.Packer(10, 2)
    for i, length in enumerate([6, 7, 3, 4, 9, 8]):
        packer.add((i, 0, length, 0, length))
        assert len(packer.rooms) <= 2
    done = [[p[0] for p in pieces] for _, pieces in packer.done]
    assert done == [[1, 2], [0, 3]] and sorted(w for w in packer.pieces) == [2, 3]
    packer.add((9, 0, 5, 0, 5))
    assert [p[0] for p in packer.done[-1][1]] == [4]


def test_packing_odd_rows(odd, nothing):
    got = packing.packed(odd, BYTES, 1).collect()
    assert sum(r.length for r in got if r.doc_id in (1, 2)) == 2 and sum(r.doc_id == 5 for r in got) == 3
    assert packing.packed(nothing, BYTES, 1).count() == 0


def _agreement(got, labels, label, folds, fold) -> float:
    truth = {r.doc_id: r[label] for r in labels.collect()}
    hits = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % folds == fold]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    return sum(hits) / len(hits)


@pytest.mark.parametrize(("run", "label", "folds", "fold"), [(toxic_cnn.toxicity, "toxic", 4, 2), (byte_cnn.quality, "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, odd, nothing, run, label, folds, fold):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = run(docs, labels).collect()
    assert len(got) == docs.count() and _agreement(got, labels, label, folds, fold) > 0.95
    other = labels.withColumn(label, 1 - labels[label]).where(f"crc32(cast(doc_id as string)) % {folds} = {fold}")
    known = labels.where(f"crc32(cast(doc_id as string)) % {folds} <> {fold}")
    again = run(docs, known.unionByName(other.select(labels.columns))).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}
    assert len(run(odd, labels).collect()) == 12
    assert run(nothing, labels).count() == 0
    assert {r.score for r in run(odd, labels.limit(0)).collect()} == {0.0}


def test_learning_parts():
    y, z = np.array([0, 0, 1, 1.0]), np.array([-2.0, -1, 1, 2])
    assert best_cut(z, y) == 0.0 and calibrated(z, y)(np.array([0.0]))[0] == pytest.approx(0.3)
    value = np.array([3.0])
    adam = Adam([value], 0.1)
    for _ in range(200):
        adam.step([2 * value])
    assert abs(value[0]) < 0.1


def test_chunk_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (0, 1, 255, 256, 257, 5000, 300_000)]
    model = byte_cnn.train(texts, np.array([0, 1, 0, 1, 0, 1, 0.0]))
    alone = [model.outputs([t])[0] for t in texts]
    assert np.allclose(model.outputs(texts), alone, atol=1e-4)


def test_toxic_filters_stay_in_their_document():
    docs = [toxic_cnn.word_slots(t) for t in (b"", b"good day", b"idiot moron", b"")]
    model = toxic_cnn.train(docs, np.array([0, 0, 1, 0.0]))
    assert np.allclose(model.outputs(docs), [model.outputs([d])[0] for d in docs], atol=1e-4)


def test_toxic_words_are_counted_over_all_rows(spark):
    """More rows than a sample would hold."""
    docs = [[1 + i % 7, 9, 9] for i in range(7000)]
    y = np.array([i % 2 for i in range(7000)])
    rows = spark.range(7000).selectExpr("cast(id % 2 as int) y", "array(cast(1 + id % 7 as int), 9, 9) slots")
    assert np.allclose(toxic_cnn._counted_odds(rows, (3500, 3500)), toxic_cnn.log_odds(docs, y))


def test_words_of_labelled_texts_meet_the_labels_not_texts(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id doc_id", "'en' lang", "concat('word', id, ' and more') text")
    known = spark.range(3, 8000, 40).selectExpr("id doc_id", "cast(id % 2 as int) y")
    want = {r.doc_id for r in known.collect()} & set(range(4000))
    near = {r.doc_id for r in maybe_among(docs, known).collect()}
    assert want <= near and len(near) < len(want) + 10
    monkeypatch.setattr(learning, "BITMAP_POWER", 6)  # too small: more rows stay, and the join drops them
    assert len(maybe_among(docs, known).collect()) > 1000
    found = toxic_cnn._labelled_words(docs, known)
    assert {(r.doc_id, r.y) for r in found.collect()} == {(i, i % 2) for i in want}
    assert {r.doc_id: r.slots for r in found.collect()}[43] == toxic_cnn.word_slots(b"word43 and more")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("MapInArrow")


def test_known_pieces_are_looked_up_without_a_call_each(monkeypatch):
    """Also where the dictionary is full, a batch has new pieces, and pieces are too long to be kept."""
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    encoder, calls = Encoder(WORDS, False, "uint16"), []
    texts = [" ".join(f"word{i % 50}" for i in range(5000)), "x" * 100, "", "word1 other"]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    texts = [t.encode() for t in texts]
    for _ in range(3):
        sys.setprofile(lambda _, event, __: calls.append(1) if event == "call" else None)
        try:
            got = encoder(texts)
        finally:
            sys.setprofile(None)
        assert got == want and len(encoder.known) == 5
    assert len(calls) < 3000


def test_pieces_with_the_mark_between_pieces_encode_like_whole_texts():
    encoder = Encoder(WORDS, False, "uint16")
    mark, one = encoder.mark
    texts = [f"a{mark}b {mark} {mark}{mark} c", " ".join(f"n{i}" for i in range(300)), mark, "", f"x {mark}"]
    want = [np.array(e.ids, dtype="<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder([t.encode() for t in texts]) == want and encoder.known[mark.encode()] == np.array([one], "<u2").tobytes()


class _Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **how)


@pytest.mark.parametrize(("path", "spaced"), [(WORDS, False), (BYTES, True)])
def test_new_pieces_are_encoded_many_at_a_time(path, spaced):
    encoder = Encoder(path, spaced, "uint32")
    texts = [" ".join(f"w{i}x{k}," for i in range(500)) + "\n\tend \u3000 Über§ 3.5" for k in range(10)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder.tokenizer = _Counted(encoder.tokenizer)
    assert encoder([t.encode() for t in texts]) == want and len(encoder.known) > 5000
    assert encoder.tokenizer.texts < 300


def test_spaced_pieces_with_the_mark_or_odd_space_encode_like_whole_texts():
    rng = random.Random(2)
    mark = Encoder(BYTES, True, "uint32").mark[0]
    signs = [mark, f" {mark}", " ", "  ", "\n", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "a", "'s", "!", "7", "é", "你好", "<|endoftext|>"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)]
    texts += [f"a{mark}b {mark} {mark}{mark} c", f" {mark}", f" {mark} {mark}", mark, "", " ", f"x {mark} ", "don't\x1c we'll  go"]
    encoder = Encoder(BYTES, True, "uint32")
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder([t.encode() for t in texts]) == want
    again = Encoder(BYTES, True, "uint32")
    assert [again([t.encode()])[0] for t in texts] == want


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_matches_plain_steps(spark, docs, rows):
    import corpus_pipeline

    from wardline.llm import divergence

    known = divergence.references(docs)

    def kept(r: dict) -> bool:
        text = r["text"].encode()
        if divergence.base(text, text.split()).failed:
            return False
        folds = [divergence.folded(w) for w in r["text"].lower().encode().split()]
        by = divergence.distances(text.split(), folds, r["lang"], known)
        return divergence.verdict(len(b"".join(text.split()).decode()), len([f for f in folds if f]), *by)

    left = brute.without_windows([(r["doc_id"], r["text"]) for r in rows if kept(r)])
    left = {i: t for i, t in left.items() if brute.words(t)}
    ids = sorted(left)
    fps = [brute.fingerprint(left[i]) for i in ids]
    roots = brute.roots(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    alone = {i for k, i in enumerate(ids) if roots[k] == k}
    frame, results = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, SMALL)
        assert frame.columns == docs.columns
        results[name] = frame.collect()
    assert {r.doc_id: r.text for r in results["SimHash near-dedup"]} == {i: left[i] for i in alone}
    mixed = results["mixing to target weights"]
    words = sum(len(brute.words(r.text)) for r in mixed)
    assert words == pytest.approx(sum(len(brute.words(left[i])) for i in alone), rel=0.05)
    packed = corpus_pipeline.run(spark, SMALL).collect()
    tokens = {r.doc_id: len(x) for r, x in zip(mixed, _ids(BYTES, [r.text for r in mixed], 1), strict=True)}
    assert sum(r.length for r in packed) == sum(tokens[r.doc_id] for r in mixed)


def test_pipeline_keeps_the_columns_of_the_table(spark, docs):
    """Columns named like those that operators add come out as they went in, and ``n_chars`` may be missing."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from llm.conftest import CLASHES

    names = [c for c in CLASHES if c != "spans"]
    frame = docs.drop("n_chars").select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, SMALL)
        assert frame.columns == [*docs.drop("n_chars").columns, *names]
    got = frame.select("doc_id", *names).collect()
    assert len(got) > 20
    assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in names)


def test_bytes_that_are_not_utf8(spark):
    """They count as replacement characters, in every operator and stage."""
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(30)).encode()
    rows = [(1, b"\xff\xfe " + words), (2, words + b" \xc3"), (3, words)]
    frame = spark.createDataFrame(rows, "doc_id long, raw binary").selectExpr(
        "doc_id", "cast(raw as string) text", "'en' lang", "'a' source", "cast(1 as long) n_chars"
    )
    counts = {r.doc_id: r for r in divergence.judged(frame).collect()}
    assert [counts[i].n_words for i in (1, 2, 3)] == [31, 31, 30]
    assert [counts[i].word_chars - counts[3].word_chars for i in (1, 2)] == [2, 1]
    ids = {r.doc_id: r.n_tokens for r in token_files.read_token_files(token_files.write_token_files(frame, vocabulary("word_bpe_49k.json"), 2)).collect()}
    fixed = spark.createDataFrame([(i, raw.decode("utf-8", "replace")) for i, raw in rows], "doc_id long, text string")
    assert ids == {r.doc_id: r.n_tokens for r in token_files.read_token_files(token_files.write_token_files(fixed, vocabulary("word_bpe_49k.json"), 2)).collect()}
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SMALL)
    assert {r.doc_id for r in frame.collect()} <= {1, 2, 3}


def test_pipeline_of_odd_tables(spark, odd, nothing):
    import corpus_pipeline

    for frame in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SMALL)
        frame.collect()
