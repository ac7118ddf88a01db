"""Language ID by rank-order profiles: out-of-place distance of a text's most frequent n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblume.llm.common import land, runs

TOP = 400  # n-grams of a profile
BLOCK_LANGUAGES = 2000  # whose profiles go to every task at a time, about; more of them are more turns
UNDETERMINED = "und"
_BATCH_BYTES = 1024 * 1024
_HELD_GRAMS = 1_000_000


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_codes(text: str) -> np.ndarray:
    """The 1-, 2- and 3-grams of the words of a text, words with a blank on either side.

    An n-gram is a number, 21 bits a character, so none are mixed up.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _letters()[points], [False]])
    blank_after = np.concatenate([letter[1:], [False]]) | np.concatenate([[False], letter[:-1]])
    one = np.where(letter, np.concatenate([[32], points, [32]]).astype(np.int64), 32)[letter | blank_after]
    two = one[:-1] << 21 | one[1:]
    three = two[:-1] << 21 | one[2:]
    blank = one == 32
    # two blanks in a row part words, and no 3-gram reaches over a blank
    return np.concatenate([one[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]])


def count_grams(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order, counts)."""
    if weights is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate([codes[:1] == codes[:1], codes[1:] != codes[:-1]]))
    if weights is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, ties by their code."""
    if len(counts) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:top]


class _Totals:
    """Counts by language; what was counted is put together whenever it has grown."""

    def __init__(self):
        self._parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, text: str):
        part = count_grams(gram_codes(text))
        self._parts[lang].append(part)
        self.size += len(part[0])
        if self.size > 2 * _HELD_GRAMS:
            self.compact()

    def compact(self):
        for lang, parts in self._parts.items():
            codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            self._parts[lang] = [count_grams(codes, counts)]
        self.size = sum(len(p[0][0]) for p in self._parts.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.compact()
        for lang, [(codes, counts)] in self._parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes),
                                              pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = _Totals()
    for rows in runs(batches, _BATCH_BYTES):
        texts = defaultdict(list)
        for lang, text in zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True):
            texts[lang].append(text)
        for lang, some in texts.items():
            totals.add(lang, "\n".join(some))
        if totals.size > _HELD_GRAMS:
            totals.compact()
            if totals.size > _HELD_GRAMS:
                yield from totals.rows()
                totals = _Totals()
    yield from totals.rows()


def learn_profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the ``top`` n-grams of each language, counted over all of ``docs``.

    Rows without a lang or a text are left out.  Ties go by the n-gram.
    """
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = (labelled.mapInArrow(_learn, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # the rank limit reaches the map side, so no task sees all n-grams of a language
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top) \
        .select("lang", "gram", "rank")


class _Profiles:
    """Which languages have an n-gram, and at what rank: only what is there is kept."""

    def __init__(self, rows: pa.Table, top: int):
        self.names = sorted(set(rows["lang"].to_pylist()))
        where = {name: i for i, name in enumerate(self.names)}
        order = np.argsort(rows["gram"].to_numpy(), kind="stable")
        self.grams = rows["gram"].to_numpy()[order]
        self.langs = np.array([where[x] for x in rows["lang"].to_pylist()], np.int64)[order]
        self.ranks = rows["rank"].to_numpy()[order]
        self.top = top

    def nearest(self, grams: np.ndarray) -> tuple[int, str]:
        """(out-of-place distance, language) of the nearest profile, ties by name."""
        start, stop = np.searchsorted(self.grams, grams), np.searchsorted(self.grams, grams, side="right")
        n = stop - start
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        # a gram that a profile lacks is ``top`` places off, and no gram is further
        nearer = self.top - np.abs(self.ranks[at] - np.repeat(np.arange(len(grams)), n))
        distance = len(grams) * self.top - np.bincount(self.langs[at], nearer, len(self.names)).astype(np.int64)
        best = int(np.argmin(distance))
        return int(distance[best]), self.names[best]


def _compare(profiles, top: int, columns: list[str]):
    """Takes the nearest language of a block of profiles where it is nearer than what was found before."""
    def compare(batches):
        model = _Profiles(profiles.value, top)
        for rows in runs(batches, _BATCH_BYTES):
            found = []
            for text, least, lang in zip(*(rows[c].to_pylist() for c in ("text", "_least", "_lang")), strict=True):
                grams = ranked(*count_grams(gram_codes(text)), top)
                one = (*model.nearest(grams), len(grams)) if len(grams) and model.names else None
                before = None if lang is None else (least, lang, len(grams))
                found.append(min((x for x in (one, before) if x), default=(None, None, None)))
            yield from pa.table([*(rows[c] for c in columns), *(pa.array(c, kind) for c, kind in zip(
                zip(*found, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True))],
                names=[*columns, "_least", "_lang", "_grams"]).to_batches()
    return compare


def identify_language(docs: DataFrame, profiles: DataFrame, keep: list[Column], top: int = TOP) -> DataFrame:
    """Columns ``keep`` with lang_pred and score (0 to 1) for every row of ``docs``.

    The score is 1 less the out-of-place distance, which is 1 where no n-gram of
    the text is in the profile; of equal distances the first language by name
    wins.  A null text, one without letters, and any text if there are no
    profiles is ``und`` with score 0.  Repeated rows and null ids are scored
    like any other; only ``text`` is read besides ``keep``; an empty table gives
    an empty table.  Any number of languages is compared, in turns of some 2,000.
    A text is read whole, with some 100 bytes of memory a character.
    """
    spark = docs.sparkSession
    profiles = land(profiles, "profiles")
    turns = max(1, -(-profiles.select("lang").distinct().count() // BLOCK_LANGUAGES))
    texts = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    columns = texts.columns
    found = texts.withColumns({c: F.lit(None).cast(kind) for c, kind in
                               (("_least", "long"), ("_lang", "string"), ("_grams", "long"))})
    for turn in range(turns):
        block = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(turns)) == turn)
        shared = spark.sparkContext.broadcast(block.toArrow())
        found = found.mapInArrow(_compare(shared, top, columns), found.schema)
    score = 1.0 - F.col("_least") / (F.col("_grams") * top)
    return found.select(*[F.col(f"`{c}`") for c in columns if c != "text"],
                        F.coalesce("_lang", F.lit(UNDETERMINED)).alias("lang_pred"),
                        F.coalesce(score, F.lit(0.0)).alias("score"))


def learn_and_identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learned from the rows of the other folds, for every row."""
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))), top)
    return identify_language(docs, profiles, [F.col("doc_id").cast("long").alias("doc_id"),
                                              held_out(F.col("doc_id")).alias("held_out")], top)
