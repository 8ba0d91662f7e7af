"""Token ids of single words by the vocabulary's merges, against the whole tokenizer."""

import random

import numpy as np
import pyarrow as pa
import pytest

from timedtext.llm import packing


@pytest.fixture(scope="module")
def words():
    return packing.Words(packing.vocabulary_path())


def letters():
    return [chr(c) for c in range(0x250) if packing.Words.LETTERS.fullmatch(chr(c))]


def test_every_letter(words):
    assert len(letters()) > 200 and "İ" not in letters() and "×" not in letters()
    for c in letters():
        for text in (c, c + "s", "a" + c + "É", c * 3):
            assert words[text] == words.plain(text), text


def test_random_words(words):
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(letters()) for _ in range(rng.randrange(1, 25)))
        assert words[text] == words.plain(text), text


def test_random_texts(words):
    rng = random.Random(5)
    parts = ["Word", "don't", "we'll", "x1", "42", "İstanbul", "ǅ", "é", "é", "日本", "ẞ", "ﬁ", "...", "!?", "\t", " ", "a.b", "#%"]
    for _ in range(300):
        text = "".join(rng.choice([*parts, " ", " ", "\n", rng.choice(letters())]) for _ in range(rng.randrange(40)))
        expected = words.tokenizer.encode(text, add_special_tokens=False).ids + [packing.END]
        assert words.ids(text).tolist() == expected, text


def test_few_known_words(words, monkeypatch):
    """Words that are forgotten are found again."""
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5)
    few = packing.Words(packing.vocabulary_path())
    rng = random.Random(6)
    for _ in range(200):
        text = " ".join(rng.choice(["the", "The", "of,", "été", "x1.", "word", "#%", "fog", "pier", "gull"]) for _ in range(9))
        assert few.ids(text).tolist() == words.ids(text).tolist()
        assert len(few) <= 5


@pytest.mark.parametrize("size", [0, 1, 2, 3000])
def test_counted(size):
    ids = np.random.default_rng(size).integers(0, 900, size).astype("<u4")
    for got, expected in zip(packing.counted(ids), np.unique(ids, return_counts=True), strict=True):
        assert got.tolist() == expected.tolist() and got.dtype == expected.dtype


def test_latin_texts_in_lower_case_at_once(words):
    """The start of a special token keeps its case, and so does a text with other letters."""
    assert packing.is_latin("ÀÞß µ×÷ Straße") and packing.is_latin("") and not packing.is_latin("Ÿ") and not packing.is_latin("İK")
    for text in ["ÀÉÎÕÜ ÞORN, Über-GRÖSSE. IT'S A.B.", "STRASSE ÿ ª º ² ¼", "İSTANBUL Ÿ ΣΑΣ K Å", "A <|startoftext|> B", "AB"]:
        expected = words.tokenizer.encode(text, add_special_tokens=False).ids + [packing.END]
        assert words.ids(text).tolist() == expected
    fresh = packing.Words(packing.vocabulary_path())
    fresh.ids("ÀÉÎÕÜ Straße STRASSE Iß")
    assert set(fresh) == {"àéîõü", "straße", "strasse", "iß"}


def batch_of(texts):
    return pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def test_many_texts_at_once(words, monkeypatch):
    """Texts of a slice share their lookups; ids are those of the whole tokenizer, in order."""
    rng = random.Random(7)
    marks = [".", ",", "...", "?!", "'s", "-x", "%", "", "", "\u0301", "\t", "\u00a0", "<|endoftext|>"]
    texts = [
        rng.choice([" ", "  ", "\n"]).join(
            "".join(rng.choice(letters() + ["1"]) for _ in range(rng.randrange(5))) + rng.choice(marks)
            for _ in range(rng.randrange(30))
        )
        for _ in range(300)
    ]
    texts += ["", " ", "é.", "Été, été.", "STRASSE ß; 日本.", "a" * 200 + "!", "x\x00. y"]
    expected = [words.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END] for t in texts]
    assert [ids.tolist() for ids in packing.Words(packing.vocabulary_path()).ids_of(texts)] == expected
    monkeypatch.setattr(packing, "SLICE_CHARS", 500)
    batch = batch_of([*texts, None])
    parts = list(packing.slices(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 5
    assert [i for ids, _ in parts for i in ids] == list(range(len(texts) + 1))
    assert [t for _, part in parts for t in part] == [*texts, ""]


def test_each_new_word_goes_to_the_merges_once(monkeypatch):
    few = packing.Words(packing.vocabulary_path())
    asked, merges = [], few.merges
    few.merges = lambda word: asked.append(word) or merges(word)
    monkeypatch.setattr(few, "plain", lambda text: pytest.fail(text) if text.strip(few.MARKS) else b"")
    few.ids_of(["Fog, été. fog!", "FOG ÉTÉ, pier."])
    assert sorted(asked) == sorted(["fog", "été".translate(few.spelling), "pier"])


def test_worker_keeps_no_words_after_a_task():
    """The worker stays alive beside the tasks of later steps."""
    run = packing.tokenized(packing.vocabulary_path())
    rows = [row for out in run(iter([batch_of(["The fog, the pier.", None, "gull " * 5000])])) for row in out.to_pylist()]
    assert [row["doc_tokens"] for row in rows if row["terms"]] == [7, 1, 5001]
    table = packing.words_of(packing.vocabulary_path())
    assert not table and not table.older
