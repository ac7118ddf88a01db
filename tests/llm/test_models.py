"""Language ID, toxicity and decontamination: learned on small made-up corpora."""

import random
import re

import numpy as np
import pytest

from joblume.llm import toxicity
from joblume.llm.decontamination import (STRIDE, _memberships, common_subsequence, find_leaks, held_words, latent_basis,
                                         verified)
from joblume.llm.language_id import count_grams, gram_codes, learn_and_identify, learn_profiles, ranked
from joblume.llm.toxicity import fit, score_toxicity

SYLLABLES = {"aa": ["ka", "ti", "mo", "re"], "bb": ["sch", "ung", "ich", "ein"], "cc": ["что", "это", "как", "она"]}


def say(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages_are_told_apart(documents, odd):
    r = random.Random(1)
    rows = [(i, say(r, lang, r.randrange(3, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 50)]
    got = {str(x.doc_id): x for x in learn_and_identify(documents(rows)).collect()}
    assert all(got[str(i)].lang_pred == lang for i, _, lang in rows)
    assert {x.held_out for x in got.values()} == {True, False} and all(0 <= x.score <= 1 for x in got.values())
    found = learn_and_identify(documents(rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    letterless = {str(i) for i, t in odd if not re.search(r"[^\W\d_]", t or "")} - {"None"}
    assert {str(x.doc_id) for x in found if x.lang_pred == "und"} - {"None"} == {
        x for x in letterless if x not in {str(i) for i, _, _ in rows}} | (letterless & {
            str(x.doc_id) for x in found if x.lang_pred == "und"})


def test_nothing_to_learn_from(documents):
    assert [tuple(x)[2:] for x in learn_and_identify(documents([(1, "text")])).collect()] == [("und", 0.0)]
    assert learn_and_identify(documents([])).count() == 0


def test_held_out_rows_and_ids_teach_nothing(documents):
    rows = [(i, "alpha beta", "aa") for i in range(40)]
    profile = learn_profiles(documents(rows)).count()
    assert profile == len(set(gram_codes("alpha beta").tolist()))


def test_grams_against_slicing():
    for text in ["Hello,  world 12 a", "", "  ", "x", "É é-a", "a1b", "日本 語"]:
        expected = []
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            expected += [g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i:i + n]) != " "]
        codes = [sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))) for g in expected]
        assert sorted(gram_codes(text).tolist()) == sorted(codes)
        grams, counts = count_grams(gram_codes(text))
        best = sorted(set(codes), key=lambda g: (-codes.count(g), g))[:5]
        assert ranked(grams, counts, 5).tolist() == best


def test_toxicity_on_held_out_rows(spark, documents, odd):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{r.randrange(300)}" for _ in range(r.randrange(5, 80))]
        toxic = r.random() < 0.3
        if toxic:
            words[r.randrange(len(words))] = r.choice(["Nastyling!", "vileness", "vilesome"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows_with_odd = rows + [(1000 + (i or 0), t) for i, t in odd] + [(None, "vileness"), rows[0]]
    table = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None), (5001, 1, 7), labels[0]],
                                  "doc_id long, quality int, toxic int")
    got = score_toxicity(documents(rows_with_odd), table).collect()
    assert len(got) == len(rows_with_odd)
    toxic = {i for i, _, t in labels if t}
    wrong = [x.doc_id for x in got if x.doc_id is not None and x.doc_id < 300 and x.predicted != (x.doc_id in toxic)]
    assert len(wrong) <= 3 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert [x.predicted for x in got if x.doc_id is None] == [1]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_one_class_or_none(spark, documents, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_toxicity(documents([(1, "text"), (2, None)]), table).collect()
    assert {x.predicted for x in got} == {labels[0][2] if labels else 0}
    assert score_toxicity(documents([]), table).count() == 0


def test_swaps_hardly_change_the_score(monkeypatch):
    # feature 0: a group that is often insulted, 1: another group, 2: the insult, which is often missed
    r = np.random.default_rng(3)
    own, swapped, toxic = [], [], []
    for _ in range(400):
        group, insult = int(r.random() < 0.5), r.random() < 0.3
        label = int(insult or (group == 0 and r.random() < 0.3))
        own.append([group, 2] if insult else [group])
        swapped.append([1 - group, 2] if insult else [1 - group])
        toxic.append(label)
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", 0.0)
    plain, _ = fit(np.array(toxic), own, swapped, 3)
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", 10.0)
    fair, bias = fit(np.array(toxic), own, swapped, 3)
    assert abs(fair[0] - fair[1]) < 0.1 * abs(plain[0] - plain[1])
    assert bias + fair[0] < 0 < bias + fair[1] + fair[2]


def test_leaks(spark, documents, odd):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    common = ["the", "of", "and", "in", "to"]

    def prose(n):
        return [r.choice(common) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(prose(r.randrange(15, 60)))) for i in range(20)] + [(20, " ".join(prose(150)))]
    rows, expected = list(odd), set()
    for i in range(100, 220):
        words = prose(r.randrange(0, 400))
        if r.random() < 0.3:
            item, text = r.choice(items)
            leak = text.split()
            kind = r.random()
            if kind < 0.3:  # words exchanged, the end as it was
                for at in r.sample(range(len(leak) - 8), max(1, len(leak) // 5)):
                    leak[at] = "changed"
            elif kind < 0.5:
                leak = [w.upper() + "," for w in leak]
            at = r.randrange(len(words) + 1)
            words[at:at] = leak
            expected.add((i, item))
        rows.append((i, " ".join(words)))
    rows.append(rows[-1])
    table = spark.createDataFrame([(*x, "e") for x in items] + [(30, None, "e"), (31, "", "e"), (None, None, "e")],
                                  "item_id long, text string, _id string")
    found = find_leaks(documents(rows), table)
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert got == expected
    assert find_leaks(documents([]), table).count() == 0
    assert find_leaks(documents(rows), table.limit(0)).count() == 0


def test_verbatim_items_inside_repeated_words(spark, documents):
    r = random.Random(7)
    items = [(i, " ".join(f"v{r.randrange(1500)}" for _ in range(r.randrange(20, 60)))) for i in range(40)]
    rows, expected = [], set()
    for i, text in items:
        for k, word in enumerate(r.sample(" ".join(t for _, t in items).split(), 3)):
            rows.append((100 * i + k, " ".join([word] * 60 + [text] + [word] * 60)))
            expected.add((100 * i + k, i))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in find_leaks(documents(rows), table).collect()} >= expected


def test_shared_items_beside_rare_ones(spark, documents):
    r = random.Random(9)
    items = [(i, " ".join(f"v{i}x{k}" for k in range(r.randrange(30, 50)))) for i in range(40)]
    rows, expected = [], set()
    for i in range(20):
        for k in range(30):  # passages with the item's words, in another order
            words = items[i][1].split()
            r.shuffle(words)
            rows.append((10_000 + 100 * i + k, " ".join(words + [f"u{r.randrange(3000)}" for _ in range(20)])))
        rows.append((i, f"{items[i][1]} {items[20 + i][1]}"))
        expected |= {(i, i), (i, 20 + i)}
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in find_leaks(documents(rows), table).collect()} == expected


def test_stretches_between_windows(spark, documents):
    r = random.Random(10)
    items = [(i, " ".join(f"v{i}x{k}" for k in range(64))) for i in range(20)]
    rows, expected = [], {}
    for i, text in items:
        for before in range(0, 48, 8):
            words = text.split()[:52]  # 81 % and no answer, in a stretch of 96 with other words in between
            for at in sorted(r.sample(range(1, 95), 44)):
                words.insert(at, f"u{r.randrange(500)}")
            if len(words) == 96 and words[0] == text.split()[0] and words[-1] == text.split()[51]:
                expected[100 * i + before, i] = (52, before)
            rows.append((100 * i + before, " ".join(f"u{r.randrange(500)}" for _ in range(before)) + " " + " ".join(words)
                         + " " + " ".join(f"u{r.randrange(500)}" for _ in range(100))))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id): (x.lcs_words, x.start_word) for x in find_leaks(documents(rows), table).collect()}
    assert len(expected) > 20 and found.items() >= expected.items()


def test_stretches_against_every_start():
    r = np.random.default_rng(11)
    for _ in range(300):
        piece, words = r.integers(0, 12, r.integers(1, 20)).astype(np.uint64), r.integers(0, 14, 60).astype(np.uint64)
        n, span, best = len(piece), -(-3 * len(piece) // 2), 0
        for start in range(60):
            stretch = words[start:start + span]
            found = common_subsequence(piece, stretch)
            if found >= 0.8 * n or found >= 0.6 * n and np.isin(piece[-8:], stretch).mean() >= 0.5:
                best = max(best, found)
        assert verified(piece, words) == best


def test_counted_words_against_sets():
    r = np.random.default_rng(8)
    words = np.arange(30, dtype=np.uint64)
    pieces = [r.choice(words, r.integers(1, 65)) for _ in range(11)] + [np.zeros(64, np.uint64)]
    for width in (3, 4):
        text = r.choice(30, 700) * (r.random(700) < 0.7)
        starts = np.arange(-(-700 // STRIDE))
        held = held_words(np.arange(700) // STRIDE, text, len(starts), _memberships(pieces, words), starts, width)
        for s in starts:
            there = set(text[s * STRIDE:(s + width) * STRIDE].tolist())
            assert held[s, :12].tolist() == [sum(w in there for w in p.tolist()) for p in pieces]


def test_common_subsequence_against_the_table():
    r = random.Random(5)
    for _ in range(200):
        a = [r.randrange(6) for _ in range(r.randrange(1, 20))]
        b = [r.randrange(6) for _ in range(r.randrange(0, 30))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == best[-1][-1]


def test_answer_decides_on_what_is_likely_only():
    piece = np.arange(20, dtype=np.uint64)
    with_answer = np.concatenate([np.arange(100, 106), np.arange(6, 20)]).astype(np.uint64)
    without = np.concatenate([np.arange(0, 13), np.arange(200, 207)]).astype(np.uint64)
    assert verified(piece, with_answer) == 14 and verified(piece, without) == 0
    assert verified(piece, piece) == 20


def test_basis_spans_the_leading_directions():
    r = np.random.default_rng(6)
    matrix = r.standard_normal((400, 5)) @ r.standard_normal((5, 60)) + 0.01 * r.standard_normal((400, 60))
    gauss = r.standard_normal((60, 12))
    basis = latent_basis(matrix.T @ (matrix @ gauss), gauss)
    leading = np.linalg.svd(matrix, full_matrices=False)[2][:5]
    assert np.allclose(np.linalg.norm(leading @ basis, axis=1), 1, atol=1e-2)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)


def test_any_number_of_languages(spark, documents, monkeypatch):
    from joblume.llm import language_id
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 400)
    # a language a syllable pair; each says its own
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{chr(97 + i // 676)}q " * 3, f"l{i:04d}") for i in range(1500)]
    docs = documents(rows)
    found = language_id.identify_language(docs, learn_profiles(docs), [docs.lang]).collect()
    assert len(found) == 1500 and all(x.lang == x.lang_pred and x.score == 1.0 for x in found)


def rank_order(texts, top=400):
    """Profile of some texts by slicing and counting, n-grams in order."""
    from collections import Counter
    found = Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            found.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i:i + n]) != " ")
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(found, key=lambda g: (-found[g], code(g)))[:top]


def test_distance_against_brute_force_with_held_out_rows(documents):
    import zlib
    r = random.Random(6)
    rows = [(i, say(r, lang, r.randrange(1, 12)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    # a held-out row that would teach all of "cc" to "aa", were it learned from
    wrong = next(i for i in range(1000, 2000) if out(i))
    rows += [(wrong, " ".join(t for _, t, lang in rows if lang == "cc") * 3, "aa"), (900, "123 456", "aa"), (901, "zzzz", None)]
    profiles = {lang: rank_order([t for i, t, x in rows if x == lang and not out(i)]) for lang in ("aa", "bb", "cc")}
    for x in learn_and_identify(documents(rows)).collect():
        grams = rank_order([next(t for i, t, _ in rows if i == x.doc_id)])
        if not grams:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        distance = {lang: sum(abs(p.index(g) - k) if g in p else 400 for k, g in enumerate(grams)) for lang, p in profiles.items()}
        best = min(distance, key=lambda lang: (distance[lang], lang))
        assert x.lang_pred == best and abs(x.score - (1 - distance[best] / (400 * len(grams)))) < 1e-12
        assert x.held_out == out(x.doc_id)


def test_held_out_labels_would_flip_the_score(spark, documents):
    import zlib
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    r = random.Random(7)
    learned = [i for i in range(2000) if not out(i)][:200]
    rows = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(20)) + (" vile" if k % 3 == 0 else "")) for k, i in enumerate(learned)]
    labels = [(i, 1, int(k % 3 == 0)) for k, i in enumerate(learned)]
    held = [i for i in range(2000, 9000) if out(i)][:600]
    rows += [(i, " ".join(f"w{r.randrange(50)}" for _ in range(20)) + " mild") for i in held]
    table = spark.createDataFrame(labels + [(i, 1, 1) for i in held], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in score_toxicity(documents(rows), table).collect()}
    assert all(got[i].held_out and got[i].predicted == 0 for i in held)
    assert all(got[i].predicted == int(k % 3 == 0) for k, i in enumerate(learned))


def test_a_labelled_id_of_very_many_rows_is_learned_from_once(spark, documents):
    import zlib
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], f"word{i}") for i in range(500)] + [(i, "vile" if i % 2 else "kind") for i in ids[1:]]
    table = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    names, weights, _ = toxicity.learn_model(documents(rows), table)
    assert sum(n.strip("^$ ").startswith("word") for n in names) <= 9
