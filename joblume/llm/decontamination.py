"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks.

The TF-IDF matrix has a row for each passage of the corpus and a column for each
word of the benchmark that is not everywhere.  Its leading right singular
vectors come from one distributed pass of a randomised SVD.  What is read word by
word is decided by an exact count of an item's words, which any passage that holds
the item must reach, and not by the cosine: other words in a passage lower that.
The cosine in the latent space is told with each find and chooses among equals.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblume.llm.common import KEY, NO_ID, hash_words, identified, land, runs, text_buffer

PASSAGE = 64  # words of a passage that the SVD sees; longer items are looked for in pieces of so many
WINDOW, STRIDE = 128, 32  # words of a passage that is searched: all stretches of 96 that begin in its first 32 lie in it
RANK = 256
BLOCK_PIECES = 224  # benchmark pieces that share a latent space; more of them make several
COMMON = 0.02  # words in more passages than that are no columns,
RAREST = 8  # but for the rarest so many of each piece
LCS_SURE, LCS_LIKELY = 0.8, 0.6  # shares of a piece's words; the lower one counts if the answer is there as well
ANSWER_WORDS, ANSWER_SHARE = 8, 0.5
ITEM_WEIGHT = 1000.0  # of a benchmark row in the sketch, so that its direction is in the space
SEED = 20240115
_CHUNK_BYTES = 1024 * 1024
_FAN_IN = 64
_PASSAGES = 64  # that are sketched at a time: their rows stay in the processor's cache
_ROWS = 1024  # columns of the matrix that are added up together

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, with A-Z in lower case and other ASCII marks as blanks, and where each text's words begin."""
    raw, offsets = text_buffer(column)
    return hash_words(_PLAIN[raw], offsets)


def _pieces(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    """(item, word hashes) of the items' pieces; a long item's last piece reaches back to be full."""
    found = []
    for item, text in items:
        words, _ = plain_words(pa.array([text or ""], pa.large_string()))
        starts = range(0, max(1, len(words)), PASSAGE)
        for start in starts:
            start = max(0, min(start, len(words) - PASSAGE))
            if len(piece := words[start:start + PASSAGE]):
                found.append((item, piece))
    return found


class _Columns:
    """Finds the columns of word hashes."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Column of each hash, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


def _texts(batches: Iterator[pa.RecordBatch]):
    for rows in runs(batches, _CHUNK_BYTES):
        for part in rows.to_batches():
            yield part, *plain_words(part.column(part.schema.get_field_index("text")))


def _passage_rows(words: np.ndarray, begins: np.ndarray, columns: _Columns):
    """(passage, column, count) of the passages' distinct columns, ordered by passage, and the number of passages."""
    counts = np.diff(begins)
    per = -(-counts // PASSAGE)
    hits = columns.of(words)
    at = np.flatnonzero(hits >= 0)
    doc = np.searchsorted(begins, at, side="right") - 1
    passage = (np.cumsum(per) - per)[doc] + (at - begins[doc]) // PASSAGE
    key, tf = np.unique(passage * (len(columns.words) + 1) + hits[at], return_counts=True)
    return key // (len(columns.words) + 1), key % (len(columns.words) + 1), tf, int(per.sum())


def _count_passages(shared):
    def count(batches):
        columns = _Columns(shared.value)
        found, total = np.zeros(len(columns.words), np.int64), 0
        for _, words, begins in _texts(batches):
            _, column, _, n = _passage_rows(words, begins, columns)
            found += np.bincount(column, minlength=len(found))
            total += n
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], total))],
                                         ["column", "n"])
    return count


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(tf)) * idf).astype(np.float32)


def _sketch(shared):
    """A'AG of the passages of a task, G a fixed Gaussian matrix: the sketch of a randomised SVD."""
    def sketch(batches):
        known, idf, rank = shared.value
        columns, gauss = _Columns(known), _gaussian(len(known), rank)
        total = np.zeros((len(known), rank), np.float32)
        for _, words, begins in _texts(batches):
            passage, column, tf, _ = _passage_rows(words, begins, columns)
            if len(passage):
                _add_sketch(total, passage, column, weigh(tf, idf[column]), gauss)
        for start in range(0, len(known), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()),
                                              pa.array([total[start:start + _ROWS].tobytes()], pa.binary())],
                                             ["start", "rows"])
    return sketch


def _gaussian(n: int, rank: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((n, rank), dtype=np.float32)


def _add_sketch(total, passage, column, value, gauss):
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    lengths = np.diff(np.append(first, len(passage)))
    for a in range(0, len(first), _PASSAGES):
        b = min(a + _PASSAGES, len(first))
        some = slice(first[a], first[b] if b < len(first) else len(passage))
        row = np.add.reduceat(gauss[column[some]] * value[some, None], first[a:b] - first[a], axis=0)
        order = np.argsort(column[some], kind="stable")
        spread = row[np.repeat(np.arange(b - a), lengths[a:b])[order]] * value[some][order, None]
        ordered = column[some][order]
        new = np.flatnonzero(np.diff(ordered, prepend=-1))
        total[ordered[new]] += np.add.reduceat(spread, new, axis=0)


def _add_up(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float32) for x in rows["rows"])
    return pa.table({"start": rows["start"][:1], "part": rows["part"][:1], "rows": pa.array([total.tobytes()])})


def _summed(parts: DataFrame, tasks: int) -> np.ndarray:
    """Adds up the tasks' sketches, some at a time, in as many rounds as that takes."""
    parts, tasks = parts.withColumn("part", F.spark_partition_id()), max(2, tasks)
    while tasks > 1:
        tasks = math.ceil(tasks / _FAN_IN)
        parts = land(parts.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("start", "part")
                     .applyInArrow(_add_up, "start long, part int, rows binary"), "sketch")
    # one matrix of bounded size is left: the columns of a block of pieces by the rank
    rows = parts.orderBy("start").select("rows").toArrow()["rows"]
    return np.concatenate([np.empty(0, np.float32), *(np.frombuffer(x.as_py(), np.float32) for x in rows)])


def latent_basis(sketch: np.ndarray, gauss: np.ndarray) -> np.ndarray:
    """Orthonormal leading right singular vectors out of A'AG, after Nystroem."""
    sketch = sketch.astype(np.float64)
    middle = gauss.T.astype(np.float64) @ sketch
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    sure = values > values.max() * 1e-10 if values.max() > 0 else np.zeros(len(values), bool)
    root = sketch @ (vectors[:, sure] / np.sqrt(values[sure]))
    if not root.size:
        return np.zeros((sketch.shape[0], 1), np.float32)
    left, singular, _ = np.linalg.svd(root, full_matrices=False)
    return left[:, singular > singular.max() * 1e-6].astype(np.float32)


def _masks(item: np.ndarray) -> dict[int, int]:
    """Where each word stands in the item, as bits."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def _longest(masks: list[int], n: int) -> int:
    full = (1 << n) - 1
    row = full
    for mask in masks:
        both = row & mask
        row = ((row + both) | (row - both)) & full
    return n - row.bit_count()


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time."""
    masks = _masks(item)
    return _longest([masks[w] for w in words.tolist() if w in masks], len(item))


def held_stretch(piece: np.ndarray, words: np.ndarray, starts: int) -> tuple[int, int]:
    """(words of ``piece`` found in order, start) of the best stretch half again as long that holds it, or (0, 0).

    Tried are the stretches that begin in the first ``starts`` words with a word
    of the piece; any other has no more of it than the next of these.
    """
    n, masks, words = len(piece), _masks(piece), words.tolist()
    at = [i for i, word in enumerate(words) if word in masks]
    there = [masks[words[i]] for i in at]
    if _longest(there, n) < LCS_LIKELY * n:
        return 0, 0
    span, answer, best = math.ceil(1.5 * n), piece[-ANSWER_WORDS:].tolist(), (0, 0)
    for k, start in enumerate(at):
        end = bisect_left(at, start + span, k)
        if start >= starts or best[0] == n:
            break
        if end - k <= best[0] or end - k < LCS_LIKELY * n:
            continue
        found = _longest(there[k:end], n)
        if found > best[0] and (found >= LCS_SURE * n or found >= LCS_LIKELY * n and sum(
                w in words[start:start + span] for w in answer) >= ANSWER_SHARE * len(answer)):
            best = found, start
    return best


def verified(piece: np.ndarray, words: np.ndarray) -> int:
    """Words of ``piece`` found in order within a stretch half again as long, or 0 if too few."""
    return held_stretch(piece, words, len(words))[0]


def _memberships(pieces: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """For each of ``words`` how often each piece has it: a byte per piece, eight of them in a number."""
    member = np.zeros((len(words), -(-len(pieces) // 8) * 8), np.uint8)
    for q, piece in enumerate(pieces):
        np.add.at(member[:, q], np.searchsorted(words, piece), 1)
    return member.view(np.uint64)


def held_words(block: np.ndarray, word: np.ndarray, blocks: int, member: np.ndarray, starts: np.ndarray,
               width: int) -> np.ndarray:
    """How many of each piece's words (up to 64) are in the ``width`` blocks from each start on, a byte per piece.

    Exact: a word counts as often as the piece has it, however often the blocks
    have it, since a block leaves out what the blocks before it in the window had.
    """
    key = np.unique(word * blocks + block)
    word, block = key // blocks, key % blocks
    gap = np.diff(block, prepend=0)
    gap[np.diff(word, prepend=-1) != 0] = width
    order = np.argsort(block, kind="stable")
    word, block, gap = word[order], block[order], gap[order]
    fresh = np.zeros((blocks + width, member.shape[1]), np.uint64)
    found = np.zeros((len(starts), member.shape[1]), np.uint64)
    for back in range(width):
        # from all words of the block to those that the ``back`` blocks before it do not have
        some = slice(None) if not back else gap == back
        at = block[some]
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            part = np.add.reduceat(member[word[some]], first, axis=0)
            fresh[at[first]] = part if not back else fresh[at[first]] - part
        found += fresh[starts + back]
    return found.view(np.uint8)


def _cosine(words: np.ndarray, columns: _Columns, idf: np.ndarray, basis: np.ndarray, query: np.ndarray) -> float:
    hit = columns.of(words)
    column, tf = np.unique(hit[hit >= 0], return_counts=True)
    latent = weigh(tf, idf[column]) @ basis[column]
    return float(latent @ query / max(np.linalg.norm(latent), 1e-12))


def _search(shared):
    """Reads every window that has enough of a piece's words to hold it; what else it has does not matter."""
    def search(batches):
        known, idf, basis, items, pieces, queries = shared.value
        columns, vocabulary = _Columns(known), _Columns(np.unique(np.concatenate(pieces)))
        member = _memberships(pieces, vocabulary.words)
        needs = np.full(member.shape[1] * 8, 255, np.uint8)
        needs[:len(pieces)] = [math.ceil(LCS_LIKELY * len(p)) for p in pieces]
        for part, words, begins in _texts(batches):
            keys = [part.column(part.schema.get_field_index(c)).to_numpy() for c in KEY]
            hits = vocabulary.of(words)
            at = np.flatnonzero(hits >= 0)
            if not len(at):
                continue
            doc = np.searchsorted(begins, at, side="right") - 1
            # window w of a document begins at its word w * STRIDE and has the WINDOW / STRIDE blocks from there on
            lengths = np.diff(begins)
            windows = np.maximum(-(-(lengths - WINDOW) // STRIDE), 0) + 1
            blocks = windows + WINDOW // STRIDE - 1
            offset = np.cumsum(blocks) - blocks
            block = offset[doc] + (at - begins[doc]) // STRIDE
            starts = np.arange(int(windows.sum())) + np.repeat(offset - (np.cumsum(windows) - windows), windows)
            owner = np.repeat(np.arange(len(windows)), windows)
            held = held_words(block, hits[at], int(blocks.sum()), member, starts, WINDOW // STRIDE)
            best: dict[tuple[int, int], tuple[int, float, int, float]] = {}
            row, query = np.nonzero(held >= needs)
            for r, q in zip(row.tolist(), query.tolist(), strict=True):
                d = int(owner[r])
                before = best.get((d, items[q]), (0, 0.0, 0, 0.0))[3]
                if before == 1:
                    continue
                start, stop = int(begins[d]) + int(starts[r] - offset[d]) * STRIDE, int(begins[d + 1])
                # later stretches are the next window's, but for the last window
                found, at = held_stretch(pieces[q], words[start:min(start + WINDOW, stop)],
                                         STRIDE if start + WINDOW < stop else WINDOW)
                share = found / len(pieces[q])
                if share > before:
                    start += at
                    stretch = words[start:min(start + math.ceil(1.5 * len(pieces[q])), stop)]
                    best[d, items[q]] = (found, _cosine(stretch, columns, idf, basis, queries[q]),
                                         start - int(begins[d]), share)
            if best:
                docs = np.array([d for d, _ in best])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k[docs]) for k in keys), pa.array([i for _, i in best], pa.int64()),
                     *(pa.array([x[n] for x in best.values()], kind) for n, kind in
                       ((0, pa.int64()), (1, pa.float64()), (2, pa.int64()), (3, pa.float64())))],
                    [*KEY, "item_id", "lcs_words", "cosine", "start_word", "share"])
    return search


def _block_leaks(texts: DataFrame, block: list[tuple[int, np.ndarray]], rank: int) -> DataFrame:
    context = texts.sparkSession.sparkContext
    words = np.unique(np.concatenate([p for _, p in block]))
    counted = dict(texts.select("text").mapInArrow(_count_passages(context.broadcast(words)), "column long, n long")
                   .groupBy("column").agg(F.sum("n")).collect())  # a number per word of the block
    total = counted.pop(-1, 0)
    df = np.array([counted.get(i, 0) for i in range(len(words))], np.float64)
    chosen = df <= COMMON * total
    for _, piece in block:
        at = np.unique(np.searchsorted(words, piece))
        chosen[at[np.argsort(df[at], kind="stable")[:RAREST]]] = True
    known, idf = words[chosen], np.log((1 + total) / (1 + df[chosen])).astype(np.float32) + 1
    columns = _Columns(known)
    rows = []
    for _, piece in block:
        hit = columns.of(piece)
        column, tf = np.unique(hit[hit >= 0], return_counts=True)
        rows.append((column, weigh(tf, idf[column])))
    shared = context.broadcast((known, idf, rank))
    parts = texts.select("text").mapInArrow(_sketch(shared), "start long, rows binary")
    sketch = _summed(parts, texts.rdd.getNumPartitions())
    sketch = sketch.reshape(len(known), rank).copy() if len(sketch) else np.zeros((len(known), rank), np.float32)
    gauss = _gaussian(len(known), rank)
    _add_sketch(sketch, np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows]),
                np.concatenate([c for c, _ in rows]),
                math.sqrt(ITEM_WEIGHT) * np.concatenate([v for _, v in rows]), gauss)
    basis = latent_basis(sketch, gauss)
    queries = np.stack([v @ basis[c] for c, v in rows])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    model = context.broadcast((known, idf, basis, [i for i, _ in block], [p for _, p in block], queries))
    return texts.mapInArrow(_search(model), "_id long, _tag long, _tag2 long, item_id long, lcs_words long, cosine double, "
                                            "start_word long, share double")


def leaked_items(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(_id, _tag, _tag2, item_id, lcs_words, cosine, start_word, share) of documents that hold a benchmark item.

    An item is held where a stretch half again as long as it has four fifths of
    its words in order, or three fifths of them and half of its last words, the
    answer.  Items of over 64 words are looked for in pieces of so many.  Every
    such stretch is tried; start_word and cosine are those of the best.

    The benchmark is the set of queries: it is read whole, 224 pieces at a time
    share a latent space and a search.  A null or empty item is held by nothing,
    repeated items are found each; items of a null item_id come out as the
    largest number.  A null or empty text holds nothing, repeated rows are one
    document.  Empty tables give an empty table; other columns are not read.
    """
    texts = identified(docs)
    items = [(r[0], r[1]) for r in benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)),
                                                    F.col("text").cast("string")).orderBy("item_id").toLocalIterator()]
    pieces = _pieces(items)
    found = None
    for at in range(0, len(pieces), BLOCK_PIECES):
        block = land(_block_leaks(texts, pieces[at:at + BLOCK_PIECES], rank), "leaks")
        found = block if found is None else found.unionByName(block)
    if found is None:
        return docs.sparkSession.createDataFrame([], "_id long, _tag long, _tag2 long, item_id long, lcs_words long, "
                                                     "cosine double, start_word long, share double")
    return found.groupBy(*KEY, "item_id").agg(
        F.max_by(F.struct("lcs_words", "cosine", "start_word", "share"), F.struct("share", "cosine", "start_word"))
        .alias("b")).select(*KEY, "item_id", "b.*")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaked_items`` by doc_id: a row per row of ``docs`` and item that it holds."""
    rows = identified(docs, F.col("doc_id").cast("long").alias("doc_id")).drop("text")
    return rows.join(leaked_items(docs, benchmark), KEY).drop(*KEY)
