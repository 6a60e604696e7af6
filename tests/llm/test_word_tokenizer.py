"""The word-by-word tokenizer of the token files against the library on whole texts."""

import random
import string

import numpy as np
import public_tokenizers
import pytest

from broadloom.llm import token_files


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def whole(tokenizer, texts):
    return [np.array(e.ids, tokenizer.kind).tobytes() for e in tokenizer.library.encode_batch_fast(texts, add_special_tokens=False)]


def test_each_stem_is_encoded_once(tokenizer_json, monkeypatch):
    """op5: a word with other marks behind it was once a word of its own, and every word a call of the whole pipeline."""
    tokenizer, seen = token_files.WordTokenizer(tokenizer_json), []
    for name in ("_encode", "_encode_plain"):
        encode = getattr(tokenizer, name)
        monkeypatch.setattr(tokenizer, name, lambda words, encode=encode: seen.extend(words) or encode(words))
    text = "bellow bellow! bellow*** (bellow), Bellow; café café. 12 12% 12"
    assert tokenizer.encode([text]) == whole(tokenizer, [text])
    assert sorted(seen) == sorted({"bellow", "!", "***", "(bellow", "),", ";", "café", ".", "12", "%"})


def test_words_and_marks_give_the_ids_of_the_whole_text(tokenizer_json):
    tokenizer, draw = token_files.WordTokenizer(tokenizer_json), random.Random(5)
    assert tokenizer.by_words and tokenizer.plain is not None
    signs = [*string.ascii_letters, *string.digits, *string.punctuation, *"'''....,,,", *"éßÄÿ÷µª²İΣ̸́…’ 一ำ\U0001f600"]
    words = ["".join(draw.choices(signs, k=draw.choice((1, 2, 3, 5, 9, 40)))) for _ in range(20_000)]
    words += ["".join(draw.choices(token_files._LETTERS, k=draw.choice((1, 3, 8, 300)))) + draw.choice(("", ".", "'s", "'s.", "̸")) for _ in range(3000)]
    texts = [draw.choice((" ", "\n", "  ", "\t")).join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["", " "]
    assert tokenizer.encode(texts) == whole(tokenizer, texts)


def test_plain_words_that_do_not_part_go_to_the_library_one_by_one(tokenizer_json, monkeypatch):
    tokenizer = token_files.WordTokenizer(tokenizer_json)
    monkeypatch.setattr(tokenizer, "ends_word", np.zeros_like(tokenizer.ends_word))
    text = "some words that are plain"
    assert tokenizer.encode([text]) == whole(tokenizer, [text])


def test_a_tokenizer_without_word_ends_has_no_plain_words(tokenizer_json):
    import json

    spec = json.loads(tokenizer_json)
    spec["normalizer"] = None
    assert token_files.WordTokenizer(json.dumps(spec)).by_words is False  # case counts
    spec = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "truncation": None, "padding": None}
    spec["model"] = {"type": "WordLevel", "vocab": {"a": 0, "b": 1, "?": 2}, "unk_token": "?"}
    tokenizer = token_files.WordTokenizer(json.dumps(spec))
    assert tokenizer.plain is None
    assert tokenizer.encode(["a b, c A"]) == whole(tokenizer, ["a b, c A"])
