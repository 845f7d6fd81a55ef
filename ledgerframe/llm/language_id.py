"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every training text, summed by language in each task and then by Spark, so
that only languages x DIMENSIONS sums reach the driver whatever the corpus size, a block of LANGUAGES languages at a time. The log-probability matrix
(DIMENSIONS float32 a language) is broadcast in those blocks and batches are scored by sparse gathers in numpy. There is no limit on languages; a model's
size is their number times 256 KiB.

Texts are read in pieces that hand their last letters on, so that the grams are those of the whole text.

Defined cases. Null text or one without a letter: `und`, score 0. Null lang, null doc_id: no training row. A training set
without any language: every text `und`. Ties between languages: the first in code-point order. With `reject_unlike` also a text that evenly spread
grams would explain better than any language: `und`, score 0. Extra columns pass through untouched. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, mix64, staged

UNDETERMINED = "und"
#: Hash range of the n-grams, and languages of a block of the matrix.
DIMENSIONS, LANGUAGES = 1 << 16, 64
LONGEST_GRAM, SMOOTHING = 3, 0.5
_CODES = np.random.Generator(np.random.PCG64(4099)).integers(1, 2**64 - 1, size=8, dtype=np.uint64) | np.uint64(1)
_PIECE = 1 << 19
_IS_LETTER: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    basic = points < 0x10000
    out = _IS_LETTER[0][np.where(basic, points, 0)]
    if not basic.all():
        out = out.copy()
        far = np.flatnonzero(~basic)
        out[far] = [chr(i).isalpha() for i in points[far]]
    return out


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-gram indices of a whole text, piece by piece: lower case, runs of other than letters as one space, a space at both ends."""
    whole = (text or "").lower()
    tail, inside, any_letter = np.array([32], dtype=np.uint64), False, False
    for at in range(0, len(whole), _PIECE):
        points = np.frombuffer(whole[at : at + _PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters(points)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= inside  # the first that is no letter after a word is its space
        inside, any_letter = bool(letter[-1]), any_letter or bool(letter.any())
        new = np.where(letter, points, 32)[keep].astype(np.uint64)
        if any_letter:
            yield from _grams_ending_in(tail, new)
            tail = np.concatenate([tail, new])[-LONGEST_GRAM:]
    if any_letter and inside:
        yield from _grams_ending_in(tail, np.array([32], dtype=np.uint64))


def _grams_ending_in(tail: np.ndarray, new: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of the n-grams of tail and new that end in new; the very first space counts with what follows it."""
    first = len(tail) == 1
    for n in range(1, LONGEST_GRAM + 1):
        points = np.concatenate([tail[len(tail) - (n - 1 + first) :] if n - 1 + first <= len(tail) else tail, new])
        if len(points) >= n:
            total = np.zeros(len(points) - n + 1, dtype=np.uint64)
            for i in range(n):
                total += points[i : len(points) - n + 1 + i] * _CODES[i]
            yield (mix64(total + np.uint64(n)) >> np.uint64(48)).astype(np.int64)


def counts_by_language(train: DataFrame) -> DataFrame:
    """(lang, gram, n) of all rows of train(text, lang)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for g in grams(text):
                    if lang not in sums:
                        sums[lang] = np.zeros(DIMENSIONS, dtype=np.int64)
                    sums[lang] += np.bincount(g, minlength=DIMENSIONS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": total[at]})

    rows = train.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    return rows.mapInPandas(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """Languages in code-point order, and their log-probabilities by blocks of languages (DIMENSIONS x languages of the block, float32)."""

    languages: list[str]
    blocks: list[np.ndarray]


def fit(train: DataFrame) -> Model:
    """The model of all rows of train(text, lang)."""
    found = staged(counts_by_language(train), "language-counts")
    languages = sorted(r[0] for r in found.select("lang").distinct().collect())
    blocks = []
    for at in range(0, len(languages), LANGUAGES):
        names = languages[at : at + LANGUAGES]
        counts = found.filter(F.col("lang").isin(names)).toPandas()
        total = np.full((DIMENSIONS, len(names)), SMOOTHING)
        np.add.at(total, (counts["gram"].to_numpy(), counts["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()), counts["n"].to_numpy(dtype=float))
        blocks.append((np.log(total) - np.log(total.sum(axis=0))).astype(np.float32))
    discard(found)
    return Model(languages, blocks)


def score_texts(texts: list[str | None], languages: list[str], blocks: list[np.ndarray], reject_unlike: bool = False) -> tuple[list[str], list[float]]:
    """Most probable language and its posterior under a flat prior."""
    out, sure = [], []
    for text in texts:
        totals, n = [np.zeros(b.shape[1]) for b in blocks], 0
        for g in grams(text):
            n += len(g)
            for total, block in zip(totals, blocks, strict=True):
                for at in range(0, len(g), 65536):
                    total += np.take(block, g[at : at + 65536], axis=0).sum(axis=0, dtype=np.float64)
        whole = np.concatenate(totals) if totals else np.empty(0)
        if not n or not len(whole) or reject_unlike and whole.max() < -n * np.log(DIMENSIONS):
            out.append(UNDETERMINED)
            sure.append(0.0)
            continue
        best = int(whole.argmax())
        out.append(languages[best])
        sure.append(float(1 / np.exp(whole - whole[best]).sum()))
    return out, sure


def identify(docs: DataFrame, model: Model, text: str = "text", reject_unlike: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score added (columns of those names are replaced); without the text column unless keep_text."""
    spark, languages = docs.sparkSession, model.languages
    shared = [spark.sparkContext.broadcast(b) for b in model.blocks]
    kept = docs.drop("lang_pred", "score")
    names = [c for c in kept.columns if keep_text or c != text]
    schema = kept.select(*[F.col(f"`{c}`") for c in names]).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the other columns pass through as they are
        for batch in batches:
            found, sure = score_texts(batch.column(text).to_pylist(), languages, [b.value for b in shared], reject_unlike)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
