"""Language ID (operator 4): multinomial naive Bayes over hashed character n-grams.

The matrix of log-probabilities (n-gram bins by languages) is broadcast; a batch
is scored by looking up its n-grams and summing by document, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytebpe import LETTER, classes
from .textcols import code_points, mix64, sub_batches

#: The model is fitted on at most so many documents, chosen by hash of their id and text.
SAMPLE_DOCUMENTS = 20_000

#: n-grams of 1 to ORDER letters and spaces, in so many bins each.
ORDER, BINS = 4, 1 << 14

#: Added to every count.
SMOOTHING = 0.5

UNKNOWN = "und"


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the n-grams, a row per order; the offsets of the texts; and whether each text has a letter.

    Texts are lower-cased; a run of other characters than letters counts as one space.
    """
    points, offsets = code_points([t.lower() if t else "" for t in texts])
    letter = classes()[points] == LETTER
    n_letters = np.concatenate([[0], np.cumsum(letter)])[offsets]
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:-1]
    keep |= first[:-1]
    symbols = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    bins = np.empty((ORDER, len(symbols)), np.int32)
    running = np.zeros(len(symbols), np.uint64)
    document_end = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(symbols))
    for k in range(ORDER):
        shifted = np.zeros(len(symbols), np.uint64)
        shifted[: len(symbols) - k] = symbols[k:]
        shifted[place + k >= document_end] = 32  # beyond the text there are spaces
        running = mix64(running + shifted)
        bins[k] = (running >> np.uint64(40)).astype(np.int32) % BINS + k * BINS
    return bins, bounds, np.diff(n_letters) > 0


def sample_of(rows: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """At most `most` rows, chosen by hash of id and text; rows that repeat both count as one, so a repeated id cannot widen or fill the sample.

    Adds own_mark, a hash of the text.
    """
    marked = rows.withColumn("own_mark", F.xxhash64(text_col))
    order = (F.xxhash64("chosen_id", "chosen_mark"), "chosen_id", "chosen_mark")
    chosen = marked.select(F.col(id_col).alias("chosen_id"), F.col("own_mark").alias("chosen_mark")).distinct().orderBy(*order).limit(most)
    same = F.col(id_col).eqNullSafe(F.col("chosen_id")) & (F.col("own_mark") == F.col("chosen_mark"))
    return marked.join(F.broadcast(chosen), same, "left_semi").dropDuplicates([id_col, "own_mark"])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the matrix of log-probabilities with the log-priors as its last row.

    Fitted on at most SAMPLE_DOCUMENTS rows for which `learn` holds, text and language not null.
    """
    usable = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = sample_of(usable, "own_id", "text", SAMPLE_DOCUMENTS).select("own_id", "text", "lang")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for part, texts in sub_batches(batches, "text"):
            bins, bounds, _ = ngrams(texts)
            for lang, a, b in zip(part.column(2).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                row = sums.setdefault(lang, np.zeros(ORDER * BINS + 1))
                row[:-1] += np.bincount(bins[:, a:b].ravel(), minlength=ORDER * BINS)
                row[-1] += 1
        for lang, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([row.tobytes()], pa.binary())], ["lang", "counts"])

    totals: dict[str, np.ndarray] = {}
    for r in sample.coalesce(8).mapInArrow(run, "lang string, counts binary").collect():
        totals[r.lang] = totals.get(r.lang, 0) + np.frombuffer(r.counts)
    langs = sorted(totals)
    if not langs:
        return [], np.zeros((ORDER * BINS + 1, 0), np.float32)
    counts = np.stack([totals[x] for x in langs], axis=1)
    grams = counts[:-1].reshape(ORDER, BINS, -1) + SMOOTHING
    logs = np.log(grams) - np.log(grams.sum(axis=1, keepdims=True))
    priors = np.log(counts[-1:] / counts[-1].sum())
    return langs, np.concatenate([logs.reshape(ORDER * BINS, -1), priors]).astype(np.float32)


def score_batch(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    bins, bounds, lettered = ngrams(texts)
    full = np.flatnonzero(lettered & (len(langs) > 0))
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if len(full):
        # texts without letters have one symbol or none; their ranges end where the next begins
        total = np.zeros((len(full), len(langs)))
        ends = bounds[full + 1]
        cuts = np.stack([bounds[full], ends], axis=1).ravel()
        for j in range(len(langs)):
            column = np.ascontiguousarray(matrix[:-1, j])
            sums = np.zeros(bins.shape[1] + 1)
            for k in range(ORDER):
                sums[:-1] += column[bins[k]]
            total[:, j] = np.add.reduceat(sums, cuts)[::2] + matrix[-1, j]
        total -= total.max(axis=1, keepdims=True)
        chance = np.exp(total)
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        for i, b in zip(full.tolist(), best.tolist()):
            out[i] = langs[b]
        score[full] = chance[np.arange(len(full)), best]
    return out, score


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; only id and text are read. One narrow pass."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in sub_batches(batches, text_col):
            found, score = score_batch(texts, *model.value)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(found), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Learned from rows outside the held-out fold only; rows with a null id are never
    learned from and not held out. Null texts, texts without a letter, and all texts if
    nothing could be learned, are `und` with score 0. Of equally likely languages the first in code-point order
    counts. Equal texts get equal results;
    repeated rows repeat; an empty table gives an empty one.
    """
    part = fold(id_col, folds)
    langs, matrix = fit(docs, part != held_out, id_col, text_col, lang_col)
    out = predict(docs, langs, matrix, id_col, text_col)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
