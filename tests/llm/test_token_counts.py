import random

import pytest

from joblume.llm.queries import tokenizer_path
from joblume.llm.token_counts import count_tokens

TEXTS = ["a  b", "  a", "a ", "a   ", "\n\n a\n \nb", "x<|endoftext|> y<|endoftext|><|endoftext|>", "it's 'tis we'll I'M",
         "", "½²३ नमस्ते १२", "é‍👩‍👩‍👧  　x y", "a\tb\t c", "  ", " ", "\n", "\x1c\x1d x \x85y", "日本語 テキスト  ok", "\0 \0a",
         "letters" * 3000, "word " * 5000]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    marks = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "²", "'", "s", "'ll", ".", "_", "<|endoftext|>", "中", "😀", "́", "\x1f", "ſ"]
    return TEXTS + ["".join(r.choice(marks) for _ in range(r.randrange(25))) for _ in range(200)]


@pytest.mark.parametrize("head", [0, 5, 200_000])
def test_counts_are_those_of_the_library(documents, odd, texts, head):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    rows = list(enumerate(texts)) + [(1, texts[1])] + odd
    expected = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids),
                       n > 1024) for i, t in rows)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit)
                 for r in count_tokens(documents(rows), tokenizer_path(), head=head).collect())
    assert got == expected


def test_empty_table(documents):
    assert count_tokens(documents([]), tokenizer_path()).count() == 0
