"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which of them overlap.

The work is on Arrow columns: tokens are flattened with their parents' numbers,
their lengths are summed up per document, and an Acero join on the key of
(document, byte offset of a token's end) says which ends are those of both.
Each end of either side closes one link: the token of A and the token of B that
cover the byte before it.  Distinct words are tokenized and joined once per task
and remembered; tokens and ends of documents are landed.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblume.llm.common import runs, small_batches
from joblume.session import scratch_path

BATCH_BYTES = 2 * 1024 * 1024  # text that is tokenized and joined together
BATCH_ROWS = 1000  # rows that Spark hands to a task at a time: their tokens take some ten times their text
TOGETHER = 500  # words that are encoded as one text
KNOWN = 150_000  # distinct words that a task remembers
CUT_CHARS = 65_536  # of a long text, where cuts change nothing
SLICE_TOKENS = 500_000
FLUSH = 2_000_000  # distinct pairs of a task that are counted before they are handed on
HEAD = 1_000_000  # pairs whose counts every task gets, at most: so many numbers, whatever the data
DOC_BITS = 33  # of an end's key; the rest is the number of its document in the batch
A_ENDS, B_ENDS = 1, 2
# Two blanks of which one is a space: only there may a token of A reach over a cut at a space.
_RUN_OF_BLANKS = re.compile(r" \s|\s ")
ALIGNED = "doc_id long, a binary, b binary, ends binary"
KINDS = {"a": np.dtype("<i4"), "b": np.dtype("<i4"), "ends": np.dtype("i1")}


class BytePairs:
    """Byte-level BPE from a file of the ``tokenizers`` library; special strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["id"] for t in model["added_tokens"]}
        vocabulary = model["model"]["vocab"]
        byte_of = _byte_level()
        ordinary = {w: i for w, i in vocabulary.items() if i not in special}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in ordinary.items()}
        size = max([*vocabulary.values(), *special]) + 1
        table = [b""] * size
        for word, i in ranks.items():
            table[i] = word
        for token in model["added_tokens"]:
            table[token["id"]] = token["content"].encode()
        self.table = pa.array(table, pa.binary())
        self.lengths = np.array([len(x) for x in table], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        order = [vocabulary[a + b] for a, b in merges]
        # ids in the order of the merges: then the lowest id is the first merge, and the fast library gives the same
        if order == sorted(order) and len(ordinary) == len(set(order)) + 256 and model["pre_tokenizer"]["use_regex"] \
                and not model["pre_tokenizer"]["add_prefix_space"] and model["normalizer"] is None:
            import tiktoken
            from public_tokenizers import PATTERN
            coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [coder.encode_to_numpy(t, disallowed_special=()) for t in texts]
            self.cuts = True  # the pattern begins a new token at each space that stands alone
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
            self.cuts = False


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pieces:
    """BPE of the ``sentencepiece`` library, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece
        self._coder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._coder.id_to_piece(i) for i in range(self._coder.get_piece_size())]
        self.table = pa.array([self._bytes(p) for p in pieces], pa.binary())
        self.lengths = np.array([len(self._bytes(p)) for p in pieces], np.int64)
        # no piece goes on into a further word: then words may be encoded apart, each with the space before it
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and self._coder.id_to_piece(
            self._coder.encode("a")[0]).startswith("▁")

    @staticmethod
    def _bytes(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.cuts or max(map(len, texts), default=0) <= CUT_CHARS:
            return self._coder.encode(texts, num_threads=1)
        return [[i for ids in self._coder.encode(self._parts(t), num_threads=1) for i in ids] for t in texts]

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Cut at single spaces between words; the space that goes is the one that the library puts back."""
        parts, start = [], 0
        while len(text) - start > CUT_CHARS:
            cut = re.compile("[^ ▁] (?=[^ ▁])").search(text, start + CUT_CHARS)
            if cut is None:
                break
            parts.append(text[start:cut.end() - 1])
            start = cut.end()
        return [*parts, text[start:]]


@lru_cache(maxsize=4)
def coder(path: str):
    """By the file's kind: ``.json`` or ``.model``."""
    return BytePairs(path) if path.endswith(".json") else Pieces(path)


def _encoded(side, texts: list[str], lead: str) -> pa.ListArray:
    """Tokens of each text, with ``lead`` before it.  Words are encoded many at a time, as one text."""
    ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for at in range(0, len(texts), TOGETHER):
        some = texts[at:at + TOGETHER]
        if side.cuts and all(t and t == t.strip() and " " not in t for t in some):
            flat = np.asarray(side.encode([lead + " ".join(some)])[0], np.int32)
            ends = np.cumsum(side.lengths[flat])
            stops = np.cumsum([len(t.encode()) + 1 for t in some])
            cuts = np.searchsorted(ends, stops)
            if cuts[-1] < len(ends) and ends[-1] == stops[-1] and (ends[cuts] == stops).all():
                ids.append(flat)
                sizes.append(np.diff(cuts + 1, prepend=0))
                continue
        each = side.encode([lead + t for t in some])
        ids += [np.asarray(x, np.int32) for x in each]
        sizes.append(np.array([len(x) for x in each], np.int64))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))


def _spelled(table: pa.Array, tokens: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(length of each token, all their bytes, where each document's bytes begin and end)."""
    flat = table.take(tokens.flatten())
    lengths = pc.binary_length(flat).cast(pa.int64())
    sums = np.concatenate([[0], pc.cumulative_sum(lengths).to_numpy()])
    return lengths, _raw(flat), sums[tokens.offsets.to_numpy()]


def _raw(strings: pa.Array) -> np.ndarray:
    _, offsets, data = strings.cast(pa.large_binary()).buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if len(strings) and data is not None else np.empty(0, np.uint8)


def _spells(raw: np.ndarray, begins: np.ndarray, texts: np.ndarray, text_begins: np.ndarray) -> np.ndarray:
    """Which documents' tokens have just the bytes of their texts."""
    same = np.diff(begins) == np.diff(text_begins)
    if same.all():
        differ = np.flatnonzero(raw != texts)
        same[np.searchsorted(begins, differ, side="right") - 1] = False
    else:
        for i in np.flatnonzero(same):
            same[i] = np.array_equal(raw[begins[i]:begins[i + 1]], texts[text_begins[i]:text_begins[i + 1]])
    return same


def _end_keys(tokens: pa.ListArray, lengths: pa.Array, begins: np.ndarray) -> pa.Array:
    """The key of each token's end: its document, and the bytes of that document up to there."""
    parent = pc.list_parent_indices(tokens).to_numpy()
    ends = pc.cumulative_sum(lengths).to_numpy() - begins[parent]
    return pa.array((parent.astype(np.int64) << DOC_BITS) | ends)


def align(texts: pa.Array, a, b) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """(tokens of A, tokens of B, ends in order: of A, of B or of both) of each text."""
    texts = texts.cast(pa.string())
    spaced = pc.binary_join_element_wise("", texts, " ")
    listed = texts.to_pylist()
    sides = [_encoded(a, listed, " "), _encoded(b, listed, "")]
    raw = _raw(spaced)
    begins = np.concatenate([[0], np.cumsum(pc.binary_length(spaced).to_numpy().astype(np.int64))])
    good = pc.binary_length(texts).to_numpy() > 0
    for side, tokens in zip((a, b), sides, strict=True):
        _, spelled, at = _spelled(side.table, tokens)
        good &= _spells(spelled, at, raw, begins)
    if not good.all():
        sides = [pc.if_else(pa.array(good), tokens, pa.scalar([], tokens.type)) for tokens in sides]
        sides = [pa.ListArray.from_arrays(_offsets(tokens), tokens.flatten()) for tokens in sides]
    keys = []
    for side, tokens in zip((a, b), sides, strict=True):
        lengths, _, at = _spelled(side.table, tokens)
        keys.append(_end_keys(tokens, lengths, at))
    one = np.int8(1)
    left = pa.table({"key": keys[0], "in_a": pa.array(np.full(len(keys[0]), one))})
    right = pa.table({"key": keys[1], "in_b": pa.array(np.full(len(keys[1]), one))})
    ends = left.join(right, keys="key", join_type="full outer", use_threads=False).sort_by("key")
    kinds = (ends["in_a"].fill_null(0).to_numpy() * np.int8(A_ENDS) + ends["in_b"].fill_null(0).to_numpy() * np.int8(B_ENDS))
    owner = ends["key"].to_numpy() >> DOC_BITS
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    return *sides, pa.ListArray.from_arrays(cuts, pa.array(kinds, pa.int8()))


def _offsets(lists: pa.ListArray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int32))


class _Words:
    """Aligns texts word by word, each distinct word once.

    Where a space stands alone both sides begin a token, so what lies between
    two such spaces is aligned by itself, and a text is its words one after the
    other.  Other texts are aligned whole.
    """

    def __init__(self, a, b):
        self._a, self._b = a, b
        self._apart = a.cuts and b.cuts
        self._clear()

    def _clear(self):
        self._number: dict[str, int] = {}
        self._sides = [(np.empty(0, kind), np.zeros(1, np.int64)) for kind in (np.int32, np.int32, np.int8)]

    def _learn(self, sides, texts: list[str]):
        """Tokens and ends, flat and where each text's begin, with those of more texts."""
        if not texts:
            return sides
        return [(np.concatenate([flat, more.flatten().to_numpy()]),
                 np.concatenate([begins, begins[-1] + more.offsets.to_numpy()[1:]]))
                for (flat, begins), more in zip(sides, align(pa.array(texts, pa.string()), self._a, self._b), strict=True)]

    def align(self, texts: list[str]) -> list[pa.ListArray]:
        if len(self._number) > KNOWN:
            self._clear()
        number, old = self._number.setdefault, len(self._number)
        parts, whole = [], {}
        for i, text in enumerate(texts):
            words = text.split(" ") if self._apart else [""]
            if not text:
                parts.append(np.empty(0, np.int64))
            elif "" in words or _RUN_OF_BLANKS.search(text):
                whole[i] = text
                parts.append(None)
            else:
                known = list(map(self._number.get, words))
                if None in known:
                    known = [number(w, len(self._number)) if n is None else n for w, n in zip(words, known, strict=True)]
                parts.append(np.array(known, np.int64))
        self._sides = self._learn(self._sides, list(islice(self._number, old, None)))
        for n, i in enumerate(whole):
            parts[i] = np.array([len(self._number) + n])
        sides = self._learn(self._sides, list(whole.values()))
        sizes = np.array([len(p) for p in parts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        words = np.concatenate([np.empty(0, np.int64), *parts])
        lost = np.zeros(len(texts), bool)  # where a word is not spelled, its text is not
        begins = sides[0][1]
        lost[owner[begins[words + 1] == begins[words]]] = True
        words, owner = words[~lost[owner]], owner[~lost[owner]]
        out = []
        for flat, begins in sides:
            n = begins[words + 1] - begins[words]
            at = np.arange(int(n.sum())) + np.repeat(begins[words] - (np.cumsum(n) - n), n)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, n, len(texts)))]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(cuts, pa.array(flat[at])))
        return out


def _packed(lists: pa.ListArray, kind: np.dtype) -> pa.Array:
    """Each list's numbers as bytes: rows of few large values cost Spark little."""
    flat = lists.flatten().to_numpy().astype(kind)
    offsets = lists.offsets.to_numpy().astype(np.int64) * kind.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()),
                                                                 pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _unpacked(batch: pa.RecordBatch, column: str) -> pa.ListArray:
    """The lists of a column of ``_packed``."""
    values, kind = batch.column(column).cast(pa.large_binary()), KINDS[column]
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.empty(0, np.uint8)
    cuts = ((ends - ends[0]) // kind.itemsize).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, pa.array(np.frombuffer(raw.tobytes(), kind)))


def _aligned(path_a: str, path_b: str):
    names = ["doc_id", "a", "b", "ends"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(coder(path_a), coder(path_b))
        for rows in runs(batches, BATCH_BYTES):
            columns = [_packed(x, kind) for x, kind in
                       zip(words.align(rows["text"].to_pylist()), KINDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), *columns], names)
            pa.default_memory_pool().release_unused()
    return aligned


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """_row, doc_id, tokens ``a`` and ``b``, and ``ends`` of each row of ``docs``, landed, packed.

    ``token_lists`` makes arrays of them.

    ``path_a`` and ``path_b`` are files of byte-level BPE (``.json``) or of
    ``sentencepiece`` (``.model``).  A encodes a space and the text, B the text,
    to which it adds the space; special strings in texts are plain text.
    ``ends`` has a number for each byte offset at which a token ends: 1 one of
    A, 2 one of B, 3 both.  ``_row`` numbers the rows, with gaps.

    A text that is null or empty, or that the tokens of A or of B do not spell
    byte by byte, has no tokens.  A null doc_id stays null; a repeated row is a
    document each time; an empty table gives an empty table; other columns are
    not read.  A text is tokenized whole by one task, with some 200 bytes of
    memory a character at most.  Spark hands over 1,000 rows at a time from then on.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")) \
        .mapInArrow(_aligned(path_a, path_b), ALIGNED)
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS)
    path = scratch_path(spark, "tokens")
    found.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def token_lists(aligned: DataFrame) -> DataFrame:
    """_row, doc_id, and a, b and ends as arrays."""
    def lists(batches):
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"),
                                              *(_unpacked(batch, c) for c in KINDS)], ["_row", "doc_id", *KINDS])
    return aligned.select("_row", "doc_id", *KINDS).mapInArrow(
        lists, "_row long, doc_id long, a array<int>, b array<int>, ends array<tinyint>")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about SLICE_TOKENS ends; a longer document stands alone."""
    for batch in batches:
        sums = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("ends")).to_numpy(), dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(sums, sums[start] + SLICE_TOKENS, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in the batch, id of A, id of B) of each link."""
    lists = [_unpacked(batch, c) for c in KINDS]
    a, b, ends = (x.flatten().to_numpy() for x in lists)
    in_a, in_b = ends & A_ENDS, ends >> 1
    owner = pc.list_parent_indices(lists[2]).to_numpy()
    return owner, a[np.cumsum(in_a, dtype=np.int64) - in_a], b[np.cumsum(in_b, dtype=np.int64) - in_b]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b


def _count_partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each pair is linked, partly: once per batch or so."""
    held, n = [], 0

    def added():
        counts = pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("docs", "sum")])
        return counts.rename_columns({"docs_sum": "docs"}).select(["pair", "docs"])

    for batch in _slices(batches):
        owner, a, b = _links(batch)
        once = pa.table({"doc": owner, "pair": _pairs(a, b)}).group_by(["doc", "pair"], use_threads=False).aggregate([])
        counts = once.group_by("pair", use_threads=False).aggregate([([], "count_all")])
        held.append(counts.rename_columns({"count_all": "docs"}).select(["pair", "docs"]))
        n += len(held[-1])
        if n > FLUSH:
            held = [added()]
            n = len(held[0])
            if n > FLUSH // 2:
                yield from held[0].to_batches()
                held, n = [], 0
    if held:
        yield from added().to_batches()


def _score(shared):
    """Per document its numbers, with the links whose pair's count is known; the others by pair."""
    schema = pa.schema([(c, pa.int64()) for c in ("_row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                                  "pair", "n")])

    def score(batches):
        pairs, counts, best = shared.value
        known = pa.array(pairs)
        for batch in _slices(batches):
            owner, a, b = _links(batch)
            pair = _pairs(a, b)
            at = pc.index_in(pa.array(pair), value_set=known)
            found = at.is_valid().to_numpy(zero_copy_only=False)
            count = np.zeros(len(pair), np.int64)
            count[found] = counts[at.drop_null().to_numpy()]
            size = batch.num_rows
            ends = _unpacked(batch, "ends")
            sums = lambda values: np.bincount(owner, values, size).astype(np.int64)
            row = batch.column("_row").to_numpy()
            total = np.zeros(size, np.int64)
            np.add.at(total, owner, count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (
                    row, *(pc.binary_length(batch.column(c)).to_numpy() // KINDS[c].itemsize for c in ("a", "b")),
                    sums(ends.flatten().to_numpy() == A_ENDS + B_ENDS), pc.list_value_length(ends).to_numpy(),
                    sums(found & (count == best[a])), total,
                    -1 - row, np.zeros(size, np.int64))], schema=schema)  # a pair that none is: joins with nothing
            if not found.all():
                rest = pa.table({"row": row[owner[~found]], "pair": pair[~found]}) \
                    .group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")])
                none = pa.nulls(len(rest), pa.int64())
                columns = [rest["row"], *[none] * 6, rest["pair"], rest["count_all"]]
                yield from pa.table(columns, schema=schema).to_batches()
    return score


def count_links(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """_row, n_a, n_b, n_groups, n_links, n_best and count_sum of landed ``aligned`` documents.

    A link is a pair of occurrences of tokens whose bytes overlap.  The count of
    its pair of ids is the number of documents with such a link.  n_best are the
    links whose count is the highest of any pair of their id of A; count_sum
    adds up the counts of all links.

    The counts of the most frequent pairs, ``head`` at most, go to every task;
    links of other pairs are joined with their counts in a shuffle.
    """
    spark = aligned.sparkSession
    path = scratch_path(spark, "pairs")
    (aligned.select("a", "b", "ends").mapInArrow(_count_partly, "pair long, docs long")
     .groupBy("pair").agg(F.sum("docs").alias("docs")).write.parquet(path))
    counts = spark.read.parquet(path)
    # powers of two that counts reach: 64 rows at most
    steps = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least = 0
    while sum(s.n for s in steps if s.step >= least) > head:
        least += 1
    frequent = F.col("docs") >= 2 ** least
    known = counts.where(frequent).toArrow()
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("best"))
    highest = best.toArrow()  # as many rows as A has ids, at most
    top = np.zeros(int(max(highest["a"].to_numpy(), default=0)) + 1, np.int64)
    top[highest["a"].to_numpy()] = highest["best"].to_numpy()
    shared = spark.sparkContext.broadcast((known["pair"].to_numpy(), known["docs"].to_numpy(), top))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    scored = aligned.select("_row", "a", "b", "ends").mapInArrow(
        _score(shared), "_row long, " + ", ".join(f"{c} long" for c in [*numbers, "pair", "n"]))
    rare = counts.where(~frequent).withColumn("a", F.shiftright("pair", 32)).join(best, "a").drop("a")
    joined = scored.join(rare.hint("merge"), "pair", "left")
    rest = {"n_best": F.when(F.col("docs") == F.col("best"), F.col("n")), "count_sum": F.col("n") * F.col("docs")}
    return joined.groupBy("_row").agg(*[
        (F.coalesce(F.sum(c), F.lit(0)) + (F.coalesce(F.sum(rest[c]), F.lit(0)) if c in rest else 0)).alias(c)
        for c in numbers])


def _group_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        lists = {c: _unpacked(batch, c) for c in KINDS}
        ends = lists["ends"].flatten().to_numpy()
        closes = ends == A_ENDS + B_ENDS
        sides = []
        for column, taken in (("a", ends & A_ENDS), ("b", ends >> 1)):
            cuts = np.concatenate([[0], np.cumsum(taken, dtype=np.int64)[closes]]).astype(np.int32)
            ids = lists[column].flatten().cast(pa.string())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(cuts, ids), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        owner = pc.list_parent_indices(lists["ends"]).to_numpy()[closes]
        cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, groups), ";")
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), texts],
                                         ["_row", "doc_id", "groups"])


def group_texts(aligned: DataFrame) -> DataFrame:
    """_row, doc_id and ``groups``: ids of A, ``|``, ids of B of each group between two common ends, by ``;``."""
    return aligned.select("_row", "doc_id", "a", "b", "ends").mapInArrow(
        _group_texts, "_row long, doc_id long, groups string")
