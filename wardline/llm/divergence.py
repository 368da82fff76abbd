"""Quality rules by distribution divergence.

Two histograms of a document are compared with those of its language: the classes of its
characters, and the common words of the language with one bin for all other words. The
measure is the Jensen-Shannon distance (base 2, from 0 to 1). Short documents scatter, so
a document needs a minimum length for each test, and the allowance falls with length.

References come from all documents that pass the base rules. The share of a character
class is the median of its documents' shares, so that a minority of odd documents does not
move it. A common word has at least 1/256 of its language's words, so there are at most 256.

Cases: a null text is empty and fails the base rules; a document whose language is null
is compared with every reference, and kept if it passes both tests with any one; where its
language is too small for a reference, or there is none at all, the base rules decide.
Other columns pass through.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import slices, staged, utf8

#: Base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
#: A word is common from this share of its language's words; a reference needs this many words.
COMMON_SHARE, LEAST_REFERENCE = 1 / 256, 2000
#: Shortest documents that are tested, in characters and in words.
LEAST_CHARS, LEAST_TESTED_WORDS = 60, 40
#: Largest distances of long documents, and how much more short ones may have (over sqrt(n)).
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.15, 0.28
CHAR_SLACK, WORD_SLACK = 1.0, 1.1
#: Steps in which the share of a class is counted.
SHARES = 1000
#: Words that a task counts before it passes its counts on.
HELD_WORDS = 300_000

CLASSES = ("lower", "upper", "letter", "mark", "digit", "stop", "quote", "dash", "bracket", "shout", "symbol", "other")
_PUNCTUATION = {".": "stop", ",": "stop", ";": "stop", ":": "stop", "!": "shout", "?": "shout", "'": "quote", '"': "quote"}
_CATEGORY = {
    "Ll": "lower", "Lu": "upper", "Lt": "upper", "Lo": "letter", "Lm": "letter", "Mn": "mark", "Mc": "mark", "Nd": "digit",
    "Nl": "digit", "No": "digit", "Pi": "quote", "Pf": "quote", "Pd": "dash", "Ps": "bracket", "Pe": "bracket", "Po": "symbol",
    "Pc": "symbol", "Sm": "symbol", "Sc": "symbol", "Sk": "symbol", "So": "symbol",
}
_EDGES = b".,;:!?'\"()[]{}#*$%&|<>-_/"


@functools.cache
def _class_of() -> np.ndarray:
    """The class of each code point of the basic plane; those beyond count as letters."""
    names = (_PUNCTUATION.get(chr(c)) or _CATEGORY.get(unicodedata.category(chr(c)), "other") for c in range(1 << 16))
    return np.array([CLASSES.index(n) for n in names], dtype=np.uint8)


def char_classes(words: list[bytes]) -> np.ndarray:
    points = np.frombuffer(b"".join(words).decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    table = _class_of()
    classes = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], CLASSES.index("letter"))
    return np.bincount(classes, minlength=len(CLASSES)).astype(np.int64)


def folded(word: bytes) -> bytes:
    return word.strip(_EDGES)


def n_repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text; exact, by doubling ids."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        _, ids = np.unique(ids[: len(ids) - step] * (ids.max() + 1) + ids[step:], return_inverse=True)
        width += step
    counts = np.bincount(ids)
    starts = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def base(text: bytes, words: list[bytes]) -> Base:
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    chars = len(b" ".join(words).decode("utf-8", "replace")) - max(len(words) - 1, 0)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return Base(len(words), chars, symbols, len(lines) - len(set(lines)), n_repeated(words))


def histogram(folds: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    """Counts of the common words, then of all others; what has no letters at all is no word."""
    counts = np.zeros(len(common) + 1)
    found = Counter(map(common.get, folds))
    for index, n in found.items():
        counts[len(common) if index is None else index] += n
    counts[-1] -= folds.count(b"")
    return counts


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0.0).sum() / 2 for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts))))


class Reference(NamedTuple):
    chars: np.ndarray
    common: dict[bytes, int]
    words: np.ndarray


def references(docs: DataFrame) -> dict[str | None, Reference]:
    """Histograms per language from all documents that pass the base rules.

    The driver gets at most 256 words and 1,001 shares of each class, for each language
    with 2,000 words or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: Counter = Counter()
        counts: dict[str | None, Counter] = {}

        def passed_on() -> pa.RecordBatch:
            rows: Counter = Counter()
            for lang, counter in counts.items():
                for word, n in counter.items():
                    if fold := folded(word):
                        rows[lang, 0, fold] += n
                        rows[lang, 2, b""] += n
            rows.update(shares)
            shares.clear()
            counts.clear()
            langs, kinds, keys = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(rows.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "key", "n"])

        for part in slices(batches):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            for lang, text in zip(langs, utf8(part), strict=True):
                words = text.split()
                if len(words) < LEAST_WORDS or 100 * n_repeated(words) > MOST_REPEATED * len(words):
                    continue
                classes = char_classes(words)
                steps = np.rint(SHARES * classes / classes.sum()).astype(int)
                shares.update((lang, 1, f"{name}:{step}".encode()) for name, step in zip(CLASSES, steps, strict=True))
                counts.setdefault(lang, Counter()).update(text.decode("utf-8", "replace").lower().encode().split())
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield passed_on()
        yield passed_on()

    summed = docs.select("lang", "text").mapInArrow(run, "lang string, kind int, key binary, n long")
    summed = staged(summed.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "word-counts")
    totals = summed.where(F.col("kind") == 2).select(F.col("lang").alias("of"), F.col("n").alias("total"))
    # written, so that its size is known: one row per language, which need not meet the words by a shuffle
    totals = staged(totals.where(F.col("total") >= LEAST_REFERENCE), "word-totals")
    wanted = summed.join(totals, F.col("lang").eqNullSafe(F.col("of"))).where(
        (F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("n") >= COMMON_SHARE * F.col("total")))
    )
    by_lang: dict[str | None, list] = {}
    for row in wanted.collect():
        by_lang.setdefault(row.lang, []).append((row.kind, bytes(row.key), row.n, row.total))
    found = {lang: _reference(sorted(rows)) for lang, rows in by_lang.items()}
    return {lang: found[lang] for lang in sorted(found, key=lambda x: (x is None, x or "")) if found[lang].common}


def _reference(rows: list[tuple[int, bytes, int, int]]) -> Reference:
    words = [(key, n) for kind, key, n, _ in rows if kind == 0]
    chars = np.zeros(len(CLASSES))
    for index, name in enumerate(CLASSES):
        steps = sorted((int(key.split(b":")[1]), n) for kind, key, n, _ in rows if kind == 1 and key.startswith(name.encode() + b":"))
        middle, seen = sum(n for _, n in steps) / 2, 0
        for step, n in steps:
            if seen < middle:
                chars[index] = step
            seen += n
    counts = [n for _, n in words]
    return Reference(chars, {key: k for k, (key, _) in enumerate(words)}, np.array([*counts, rows[0][3] - sum(counts)], dtype=float))


def distances(words: list[bytes], folds: list[bytes], lang: str | None, known: dict[str | None, Reference]) -> tuple[float, float]:
    """Both distances to the document's language; without one, to a reference it passes, or else that with the nearest words."""
    chars = char_classes(words)
    chosen = known.values() if lang is None else [known[lang]]
    found = [(js_distance(chars, r.chars), js_distance(histogram(folds, r.common), r.words)) for r in chosen]
    n_chars, n_tested = int(chars.sum()), len(folds) - folds.count(b"")
    return min(found, key=lambda d: (not verdict(n_chars, n_tested, *d), d[1], d[0]))


def verdict(n_chars: int, n_tested: int, by_chars: float, by_words: float) -> bool:
    if n_chars >= LEAST_CHARS and by_chars > MOST_CHAR_DISTANCE + CHAR_SLACK / n_chars**0.5:
        return False
    return not (n_tested >= LEAST_TESTED_WORDS and by_words > MOST_WORD_DISTANCE + WORD_SLACK / n_tested**0.5)


#: What :func:`judged` adds.
ADDED = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "char_distance": "double", "word_distance": "double",
}


def judged(docs: DataFrame, known: dict[str | None, Reference] | None = None) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and both distances (null if untested).

    Columns of these names that the table has give way.
    """
    known = references(docs) if known is None else known
    columns = [c for c in docs.columns if c not in ADDED]
    schema = docs.select(*columns, *(F.lit(None).cast(t).alias(c) for c, t in ADDED.items())).schema

    def judge(text: bytes, lang: str | None) -> tuple:
        words = text.split()
        found = base(text, words)
        by_chars = by_words = None
        kept = not found.failed
        if kept and known and (lang is None or lang in known):
            folds = [folded(w) for w in text.decode("utf-8", "replace").lower().encode().split()]
            by_chars, by_words = distances(words, folds, lang, known)
            kept = verdict(found.word_chars, len(folds) - folds.count(b""), by_chars, by_words)
        return (*found, found.failed, kept, by_chars, by_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            rows = [judge(t, lang) for t, lang in zip(utf8(part), langs, strict=True)]
            own = [part.column(part.schema.get_field_index(c)) for c in columns]
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            new = [pa.array([row[k] for row in rows], type=kinds[t]) for k, t in enumerate(ADDED.values())]
            yield pa.RecordBatch.from_arrays([*own, *new], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)
