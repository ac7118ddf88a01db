"""Toxicity: a linear classifier whose score must not change when identity terms are swapped."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblume.llm.common import land, runs
from joblume.llm.language_id import held_out

SAMPLE = 20_000  # labelled documents that the classifier is fitted on, at most
FEATURES = 1024  # words and word beginnings that it looks at, at most
PREFIXES = (4, 5)
LEAST_GAIN = 2.0  # log likelihood ratio that a feature must have
SWAP_WEIGHT = 10.0  # of the squared change of score under swaps
RIDGE = 3e-5
STEPS = 400
_BATCH_BYTES = 8 * 1024 * 1024
_CACHED_TOKENS = 400_000
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»„“”…–—’‘"

# Neutral mentions of groups; a term is swapped for the next one of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("african", "asian", "european", "american", "mexican"),
    ("black", "white", "brown"),
    ("deaf", "blind", "disabled", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes"),
)
SWAPS = {term: row[(i + 1) % len(row)] for row in IDENTITY_TERMS for i, term in enumerate(row)}


def words_of(text: str) -> set[str]:
    """Distinct words, in lower case and without marks around them."""
    return {word for token in set(text.lower().split()) if (word := token.strip(_STRIP))}


def features_of(words: set[str]) -> set[str]:
    found = {f"={word}" for word in words}
    for n in PREFIXES:
        found.update(f"^{word[:n]}" for word in words if len(word) >= n)
    return found


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in runs(batches, _BATCH_BYTES):
        counts = Counter(), Counter()
        for toxic, text in zip(rows["toxic"].to_pylist(), rows["text"].to_pylist(), strict=True):
            counts[toxic].update(features_of(words_of(text)))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[name] for name in names], pa.int64()) for c in counts)],
            ["feature", "clean", "toxic"])


def _select(sample: DataFrame, clean: int, toxic: int, most: int) -> list[str]:
    """The features that speak most for toxicity, by log likelihood ratio, and all identity terms."""
    counted = (sample.select("toxic", "text").mapInArrow(_frequencies, "feature string, clean long, toxic long")
               .groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")))
    share = F.lit(toxic / max(1, clean + toxic))
    both = F.col("c") + F.col("t")
    gain = (F.col("t") * F.log(F.col("t") / (both * share))
            + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - share)))).otherwise(0))
    best = (counted.where((F.col("t") > 1) & (F.col("t") > both * share)).withColumn("gain", gain)
            .where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "feature").limit(most))
    return sorted({r.feature for r in best.select("feature").collect()} | features_of(set(SWAPS)))


class _Encoder:
    """The numbers of the selected features that a text has; what a token gives is kept."""

    def __init__(self, features: list[str]):
        self._numbers = {f: i for i, f in enumerate(features)}
        self._known: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        return tuple(n for f in features_of({word}) if (n := self._numbers.get(f)) is not None)

    def encode(self, text: str) -> list[int]:
        if len(self._known) > _CACHED_TOKENS:
            self._known.clear()
        known, found = self._known, set()
        for token in set(text.lower().split()):
            numbers = known.get(token)
            if numbers is None:
                word = token.strip(_STRIP)
                numbers = known[token] = self._of(word) if word else ()
            if numbers:
                found.update(numbers)
        return sorted(found)

    def swapped(self, text: str) -> list[int] | None:
        """As ``encode`` for the text with its identity terms swapped; None if it has none."""
        words = words_of(text)
        if not words & SWAPS.keys():
            return None
        return sorted({n for word in words for n in self._of(SWAPS.get(word, word))})


def _encode_sample(features: list[str]):
    def encode(batches):
        encoder = _Encoder(features)
        for rows in runs(batches, _BATCH_BYTES):
            texts = rows["text"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [rows["toxic"].combine_chunks().cast(pa.int64()),
                 pa.array([encoder.encode(x) for x in texts], pa.list_(pa.int64())),
                 pa.array([encoder.swapped(x) for x in texts], pa.list_(pa.int64()))], ["toxic", "own", "swapped"])
    return encode


def fit(toxic: np.ndarray, own: list[list[int]], swapped: list[list[int] | None], n: int) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on binary features, with the change under swaps penalised."""
    share = toxic.mean() if len(toxic) else 0.0
    if not 0 < share < 1:
        return np.zeros(n), 40.0 if share else -40.0
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    columns = np.concatenate([np.asarray(x, np.int64) for x in own])
    pairs = [(a, b) for a, b in zip(own, swapped, strict=True) if b is not None]
    change_rows = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.empty(0, np.int64)
    change_columns = np.concatenate([np.asarray([*a, *b], np.int64) for a, b in pairs] or [np.empty(0, np.int64)])
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs] or [np.empty(0)])
    w, bias = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, w[columns], len(own))
        wrong = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) / len(toxic)
        slope = np.bincount(columns, wrong[rows], n) + RIDGE * w
        if pairs:
            change = np.bincount(change_rows, sign * w[change_columns], len(pairs))
            slope += SWAP_WEIGHT / len(pairs) * np.bincount(change_columns, sign * change[change_rows], n)
        slope = np.append(slope, wrong.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def _score(shared):
    def score(batches):
        features, weights, bias = shared.value
        encoder = _Encoder(features)
        for rows in runs(batches, _BATCH_BYTES):
            z = np.array([bias + weights[encoder.encode(text)].sum() for text in rows["text"].to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"].combine_chunks(), rows["held_out"].combine_chunks(), pa.array(scores),
                 pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return score


def learn_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
                features: int = FEATURES) -> tuple[list[str], np.ndarray, float]:
    """(features, weights, bias), fitted on ``sample`` labelled documents at most, chosen by a hash of their id.

    The bound holds for rows: of several rows of a doc_id one is learned from.
    """
    usable = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
              .where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # so many rows of two numbers, whatever the data; of a doc_id's rows one counts, as there may be very many
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    labelled = land(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                    .join(F.broadcast(usable), "doc_id")
                    .withColumn("_rank", F.row_number().over(one)).where("_rank = 1").select("toxic", "text"), "labelled")
    count = dict(labelled.groupBy("toxic").count().collect())
    names = _select(labelled, count.get(0, 0), count.get(1, 0), features)
    # feature numbers of the sample, not texts
    rows = labelled.mapInArrow(_encode_sample(names), "toxic long, own array<long>, swapped array<long>").toArrow()
    weights, bias = fit(rows["toxic"].to_numpy(), rows["own"].to_pylist(), rows["swapped"].to_pylist(), len(names))
    return names, weights, bias


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5), one row per row of ``docs``.

    ``toxic`` is learned from labelled documents of the folds that are not held
    out; the score is a function of the text alone.  A null or empty text has
    the score of no evidence.  Rows of ``labels`` without doc_id or with a label
    other than 0 and 1 are left out, of several for one doc_id the largest
    label counts.  If nothing or only one class is labelled, all scores are near
    0, or near 1 if that class is 1.  A null doc_id is scored and not held out,
    repeated rows are scored each; an empty table gives an empty table; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_model(docs, labels, sample, features))
    doc_id: Column = F.col("doc_id")
    return docs.select(doc_id.cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")
