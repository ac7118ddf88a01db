"""Token counts: every distinct pre-token is encoded once, and its pieces are joined to the documents."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblume.llm.common import land, runs

HEAD = 200_000  # the most frequent pre-tokens go to every task: so many strings, whatever the data
BATCH_BYTES = 8 * 1024 * 1024
_FLUSH = 400_000
# Two blanks of which one is a space: only there do cuts at single spaces and the pattern's cuts differ.
_RUN_OF_BLANKS = re.compile(r" \s|\s ")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Splitter:
    """Pre-tokens of texts, by the pattern of byte-level BPE and the vocabulary's special strings."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        self._tokenizer = _tokenizer(path)
        special = self._tokenizer.get_added_tokens_decoder().values()
        odd = [s.content for s in special if s.single_word or s.lstrip or s.rstrip]
        if odd:
            raise ValueError(f"special tokens that take in their surroundings are not supported: {odd}")
        names = sorted((s.content for s in special), key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._names = set(names)
        self._pattern = regex.compile(PATTERN)

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """(pre-tokens, words) of the text; a word stands for the pre-tokens that ``parts`` gives."""
        if self._special and any(name in text for name in self._names):
            found = []
            for part in self._special.split(text):
                found += [part] if part in self._names else self._pattern.findall(part)
            return found, []
        if _RUN_OF_BLANKS.search(text):
            return self._pattern.findall(text), []
        # no run of blanks holds a space: each space begins a new pre-token, so what
        # lies between spaces can be cut on its own, once per worker
        first, *words = text.split(" ")
        return self._pattern.findall(first), words

    def parts(self, word: str) -> list[str]:
        """Pre-tokens of a word with the space before it."""
        return self._pattern.findall(" " + word)

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self._tokenizer.encode_batch(pretokens, add_special_tokens=False)]


def _vocabulary(path: str):
    schema = pa.schema([("pretoken", pa.string()), ("n", pa.int64())])

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())],
                                          schema=schema)

    def distinct(batches: Iterator[pa.RecordBatch]):
        splitter, found, words = Splitter(path), Counter(), Counter()

        def settle():
            for word, n in words.items():
                for pretoken in splitter.parts(word):
                    found[pretoken] += n
            words.clear()

        for rows in runs(batches, BATCH_BYTES):
            for text in rows["text"].to_pylist():
                pretokens, more = splitter.cut(text)
                found.update(pretokens)
                words.update(more)
            if len(words) > _FLUSH:
                settle()
            if len(found) > _FLUSH:
                yield out(found)
                found.clear()
        settle()
        yield out(found)
    return distinct


def _encode(path: str):
    schema = pa.schema([("pretoken", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])

    def encode(batches):
        splitter = Splitter(path)
        for batch in batches:
            pieces = splitter.pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1),
                                              pa.array(pieces, pa.int64())], schema=schema)
    return encode


ROWS = "doc_id long, text_hash long, n_bytes long, base long, pretoken string, n long"


class _Known:
    """Tokens of words by the head's pre-tokens, and the other pre-tokens that they have."""

    def __init__(self, splitter: Splitter, head: dict[str, int]):
        self._splitter, self._head = splitter, head
        self._whole: dict[str, int] = {}  # words of the head's pre-tokens alone
        self._rest: dict[str, tuple[int, list[str]]] = {}

    def tokens(self, text: str) -> tuple[int, Counter]:
        """(tokens of the head's pre-tokens, how often each other pre-token occurs)."""
        if len(self._whole) + len(self._rest) > _FLUSH:
            self._whole.clear()
            self._rest.clear()
        pretokens, words = self._splitter.cut(text)
        total, others = self._split(pretokens)
        others = Counter(others)
        known = list(map(self._whole.get, words))
        if None in known:
            for i, n in enumerate(known):
                if n is None:
                    known[i], rest = self._learn(words[i])
                    others.update(rest)
        return total + sum(known), others

    def _learn(self, word: str) -> tuple[int, list[str]]:
        found = self._rest.get(word)
        if found is None:
            found = self._split(self._splitter.parts(word))
            if found[1]:
                self._rest[word] = found
            else:
                self._whole[word] = found[0]
        return found

    def _split(self, pretokens: list[str]) -> tuple[int, list[str]]:
        pieces = [self._head.get(p) for p in pretokens]
        return sum(n for n in pieces if n is not None), [p for p, n in zip(pretokens, pieces, strict=True) if n is None]


def _frequencies(path: str, head):
    """Per document a row with ``base``, the tokens of the head's pre-tokens, and a row for each other pre-token."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()),
                        ("base", pa.int64()), ("pretoken", pa.string()), ("n", pa.int64())])

    def frequencies(batches):
        known = _Known(Splitter(path), head.value)
        for rows in runs(batches, BATCH_BYTES):
            out = []
            for id_, key, size, text in zip(*(rows[c].to_pylist() for c in ("doc_id", "text_hash", "n_bytes", "text")),
                                            strict=True):
                base, others = known.tokens(text)
                out += [(id_, key, size, None, pretoken, n) for pretoken, n in others.items()]
                # n = 0: joins with nothing that counts, and spreads over the tasks
                out.append((id_, key, size, base, f"\0{key}", 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in
                                              zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    return frequencies


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``), one row per row of ``docs``.

    ``path`` is a byte-level BPE file of the ``tokenizers`` library, and n_tokens
    is the number of ids its ``encode`` gives for the whole text without added
    tokens; a special string inside a text counts as one.  No ids of documents
    are made: pieces are counted once per distinct pre-token of the corpus.  The
    ``head`` most frequent of these are looked up in the map tasks, the rest is
    joined in a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens.  A null doc_id is kept, and
    a repeated row gives a row each time.  An empty table gives an empty table;
    other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    vocabulary = land(docs.select(text.alias("text")).mapInArrow(_vocabulary(path), "pretoken string, n long")
                      .groupBy("pretoken").agg(F.sum("n").alias("n"))
                      .mapInArrow(_encode(path), "pretoken string, n long, pieces long"), "pretokens")
    frequent = vocabulary.orderBy(F.desc("n"), "pretoken").limit(head).select("pretoken", "pieces").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        dict(zip(frequent["pretoken"].to_pylist(), frequent["pieces"].to_pylist(), strict=True)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = (keyed.mapInArrow(_frequencies(path, shared), ROWS)
               .join(vocabulary.select("pretoken", "pieces"), "pretoken", "left")
               .groupBy("doc_id", "text_hash", "n_bytes")
               # equal rows add up here, and are dealt out again
               .agg(F.count("base").alias("rows"),
                    (F.sum("base") + F.sum(F.col("n") * F.coalesce("pieces", F.lit(0)))).alias("all")))
    n_tokens = F.expr("all div rows")
    return (counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"),
                           F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_"))
            .drop("_"))
