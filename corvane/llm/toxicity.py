"""Toxicity (operator 5): a logistic classifier with counterfactual regularisation.

Features are the distinct words of a text and their first letters (stems), by
hash. For labelled texts that name a group, the same text with the terms swapped
for other groups' is made, and a change of the score between the two is penalised;
so that naming a group neutrally does not raise the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytebpe import LETTER, NUMBER, classes
from .langid import fold, sample_of
from .shared import saved
from .textcols import code_points, range_hashes, sub_batches

#: Terms that name groups, in four languages; a term is swapped for the next of its line.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("man", "woman"),
    ("men", "women"),
    ("male", "female"),
    ("boy", "girl"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish"),
    ("old", "young"),
    ("disabled", "blind", "deaf", "autistic"),
    ("christ", "moslem", "jude", "buddhist"),
    ("christen", "muslime", "juden", "buddhisten"),
    ("christliche", "muslimische", "jüdische"),
    ("schwarze", "weiße", "asiatische", "arabische"),
    ("schwule", "lesben", "heteros"),
    ("mann", "frau"),
    ("männer", "frauen"),
    ("junge", "mädchen"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("türken", "deutsche", "polen", "russen"),
    ("behinderte", "blinde", "gehörlose"),
    ("chrétien", "musulman", "juif"),
    ("chrétiens", "musulmans", "juifs"),
    ("noir", "blanc", "asiatique", "arabe"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("homosexuels", "hétérosexuels", "lesbiennes"),
    ("homme", "femme"),
    ("hommes", "femmes"),
    ("garçon", "fille"),
    ("immigrés", "réfugiés", "étrangers"),
    ("français", "allemands", "algériens"),
    ("handicapés", "aveugles", "sourds"),
    ("cristiano", "musulmán", "judío"),
    ("cristianos", "musulmanes", "judíos"),
    ("negro", "blanco", "asiático", "árabe"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("homosexuales", "heterosexuales", "lesbianas"),
    ("hombre", "mujer"),
    ("hombres", "mujeres"),
    ("niño", "niña"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("españoles", "mexicanos", "marroquíes"),
    ("discapacitados", "ciegos", "sordos"),
)

#: The model is fitted on at most so many labelled documents, chosen by hash of id and text. Its features are bounded by their words.
SAMPLE_DOCUMENTS = 20_000

#: A word is a feature if its log-odds between the labels are so many standard errors above or below zero.
LEAST_Z = 3.5

#: A stem is a word's first so many characters.
STEMS = (4, 5, 6)

THRESHOLD = 0.7
#: A toxic example counts as so many clean ones: the best F1 of 1, 2, 3, 5 and 8 over four folds of the learning rows.
TOXIC_WEIGHT = 3.0

L2, COUNTERFACTUAL, STEPS = 1e-5, 1.0, 400


def features_of(texts: list[str | None], stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, lower-cased) and then of their stems; the text of each."""
    points, offsets = code_points([t.lower() if t else "" for t in texts])
    kind = classes()[points]
    inside = (kind == LETTER) | (kind == NUMBER)
    edge = np.zeros(len(points) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    if len(starts):
        real = inside[starts]
        starts, ends = starts[real], ends[real]
    document = np.searchsorted(offsets, starts, "right") - 1
    hashes, documents = [range_hashes(points, starts, ends)], [document]
    for k in stems:
        long = ends - starts > k
        hashes.append(range_hashes(points, starts[long], starts[long] + k))
        documents.append(document[long])
    return np.concatenate(hashes), np.concatenate(documents)


def term_hashes() -> np.ndarray:
    """Sorted hashes of the identity terms."""
    return np.sort(features_of([t for line in IDENTITY_TERMS for t in line], ())[0])


_SWAPS = {line[i]: line[(i + 1) % len(line)] for line in IDENTITY_TERMS for i in range(len(line))}
_TERM = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(_SWAPS)) + r")(?![^\W_])")


def swap_terms(text: str | None) -> str | None:
    """The text, lower-cased, with every identity term swapped for the next of its line."""
    return _TERM.sub(lambda m: _SWAPS[m[0]], text.lower()) if text else text


class _Rows:
    """A sparse matrix of rows of distinct feature numbers, all entries 1 (or signs)."""

    def __init__(self, features: list[np.ndarray], n_features: int, signs: list[np.ndarray] | None = None):
        sizes = np.array([len(f) for f in features], np.int64)
        self.n, self.width = len(features), n_features
        self.column = np.concatenate(features) if len(features) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.sign = np.concatenate(signs) if signs else None

    def times(self, w: np.ndarray) -> np.ndarray:
        values = w[self.column] if self.sign is None else w[self.column] * self.sign
        return np.bincount(self.row, weights=values, minlength=self.n)

    def across(self, e: np.ndarray) -> np.ndarray:
        values = e[self.row] if self.sign is None else e[self.row] * self.sign
        return np.bincount(self.column, weights=values, minlength=self.width)


def train(rows: dict[tuple[bytes, bytes, int], int], n_features: int, counterfactual: float | None = None, steps: int | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias, from how often each (features, features swapped, label) occurs; features are int32 numbers as bytes.

    The loss is the weighted log loss, L2 / 2 times the squared weights, and counterfactual / 2 times the
    mean squared change of the score when the terms of a text are swapped. With one label only, the score is that label's share.
    """
    counterfactual, steps = COUNTERFACTUAL if counterfactual is None else counterfactual, STEPS if steps is None else steps
    keys = sorted(rows)
    times = np.array([rows[k] for k in keys], np.float64)
    labels = np.array([k[2] for k in keys], np.float64)
    if not len(keys) or labels.min() == labels.max():
        share = (labels @ times + 0.5) / (times.sum() + 1) if len(keys) else 0.0
        return np.zeros(n_features), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    sets = [[np.frombuffer(k[which], np.int32).astype(np.int64) for which in (0, 1)] for k in keys]
    x = _Rows([a for a, _ in sets], n_features)
    swapped = [i for i, k in enumerate(keys) if k[0] != k[1]]
    lost, won = ([np.setdiff1d(*pair) for pair in pairs] for pairs in ([sets[i] for i in swapped], [sets[i][::-1] for i in swapped]))
    change = _Rows([np.concatenate(p) for p in zip(lost, won)], n_features, [np.repeat([-1.0, 1.0], [len(a), len(b)]) for a, b in zip(lost, won)])
    weight = times[swapped] / max(1.0, times[swapped].sum())
    share = times * np.where(labels > 0, TOXIC_WEIGHT, 1.0)
    share /= share.sum()
    w, bias = np.zeros(n_features), 0.0
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        error = share * (1 / (1 + np.exp(-np.clip(x.times(w) + bias, -50, 50))) - labels)
        gradient = x.across(error) + L2 * w
        if swapped and counterfactual:
            gradient += counterfactual * change.across(weight * change.times(w))
        g = np.append(gradient, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def score_batch(texts: list[str | None], features: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Chance of label 1 of each text: each feature counts once however often it occurs."""
    total = np.full(len(texts), bias)
    hashes, document = features_of(texts)
    if len(features) and len(hashes):
        spot = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
        hit = np.flatnonzero(features[spot] == hashes)
        pairs = np.unique(document[hit] * len(features) + spot[hit])
        total += np.bincount(pairs // len(features), weights=weights[pairs % len(features)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple:
    """The model, from at most SAMPLE_DOCUMENTS labelled documents for which `learn` (on the label's id) holds."""
    usable = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    # of labels that differ for one id the higher holds; ids are bounded first, then the documents they have
    one = usable.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    labelled = saved(one.orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_DOCUMENTS), "labels")
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(F.broadcast(labelled.select("label_id")), F.col("own_id") == F.col("label_id"), "left_semi")
    sample = sample_of(texts, "own_id", "text", SAMPLE_DOCUMENTS).join(F.broadcast(labelled), F.col("own_id") == F.col("label_id")).select("text", "label")

    def distinct(texts: list[str | None]) -> list[np.ndarray]:
        hashes, document = features_of(texts)
        order = np.argsort(document, kind="stable")
        bounds = np.searchsorted(document[order], np.arange(len(texts) + 1)).tolist()
        return [np.unique(hashes[order[a:b]]) for a, b in zip(bounds, bounds[1:])]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in sub_batches(batches, "text"):
            words, swapped = distinct(texts), distinct([swap_terms(t) for t in texts])
            listed = [pa.array([w.view(np.int64) for w in some], pa.list_(pa.int64())) for some in (words, swapped)]
            yield pa.RecordBatch.from_arrays([*listed, part.column(1).cast(pa.int32())], ["words", "swapped", "label"])

    every = sample.mapInArrow(run, "words array<long>, swapped array<long>, label int")
    # texts of equal words and label count once
    rows = saved(every.groupBy(F.xxhash64("words").alias("digest"), "label").agg(F.first("words").alias("words"), F.first("swapped").alias("swapped")), "labelled")
    features = select_features(rows)

    def narrowed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = []
            for name in ("words", "swapped"):
                found = []
                for words in batch.column(name):
                    own = words.values.to_numpy().view(np.uint64)
                    spot = np.minimum(np.searchsorted(features, own), len(features) - 1)
                    found.append(np.unique(spot[features[spot] == own]).astype(np.int32).tobytes())
                columns.append(pa.array(found, pa.binary()))
            yield pa.RecordBatch.from_arrays([*columns, batch.column("label")], ["a", "b", "label"])

    counts = rows.mapInArrow(narrowed, "a binary, b binary, label int").groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    weights, bias = train({(bytes(r.a), bytes(r.b), r.label): r.n for r in counts}, len(features))
    return features, weights, bias


def select_features(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the words and stems that tell the labels apart, and of the identity terms; as many at most as the sample has words."""
    sums = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(sums.get(1, 0) + 1), float(sum(n for y, n in sums.items() if y != 1) + 1)
    counts = rows.select(F.explode("words").alias("word"), "label").groupBy("word").agg(F.sum((F.col("label") == 1).cast("long")).alias("toxic"), F.count(F.lit(1)).alias("n"))
    toxic, clean = F.col("toxic") + F.lit(0.5), F.col("n") - F.col("toxic") + F.lit(0.5)
    odds = F.log(toxic / (n1 - toxic)) - F.log(clean / (n0 - clean))
    error = F.sqrt(1 / toxic + 1 / clean + 1 / (n1 - toxic) + 1 / (n0 - clean))
    best = counts.select("word", F.abs(odds / error).alias("z")).where(F.col("z") >= LEAST_Z).select("word").collect()
    return np.union1d(np.array([r.word for r in best], np.int64).view(np.uint64), term_hashes())


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row; only id and text are read. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in sub_batches(batches, text_col):
            chance = score_batch(texts, *shared.value)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(chance), pa.array((chance >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Learned only from labels outside the held-out fold; rows with a null id or
    label teach nothing; a null id is not held out. Null and empty texts get the
    score of a text without any feature. Of labels that differ for one id the
    higher holds. Equal texts get equal scores; repeated rows repeat; an empty table
    gives an empty one; without labels every score is 0.
    """
    model = fit(docs, labels, fold(id_col, folds) != held_out, id_col, text_col, label_col)
    out = score(docs, model, id_col, text_col)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: tuple, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold; all columns, one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, texts in sub_batches(batches, text_col):
            yield part.filter(pa.array(score_batch(texts, *shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
