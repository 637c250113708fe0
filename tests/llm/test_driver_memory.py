"""Steps that run in the driver hold their inputs no longer than needed and hand over in pieces."""

from unittest.mock import MagicMock

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from meritlens.llm import bpe, toxicity  # noqa: E402


def compiled(monkeypatch, words):
    """The artifact as the shared folder gets it, call by call."""
    spark, calls = MagicMock(), []
    store = spark._jvm.org.apache.hadoop.fs.Path.return_value.getFileSystem.return_value
    store.create.return_value.write = lambda part: calls.append(bytes(part))
    monkeypatch.setattr(bpe, "new_folder", lambda *_: "/shared")
    bpe.compile_lexicon(spark, words, bpe.default_tokenizer())
    return calls


def test_the_lexicon_is_handed_over_in_pieces(monkeypatch):
    calls = compiled(monkeypatch, ["some", "words", "of", "a", "corpus"])
    assert len(calls) > 1 and max(map(len, calls)) <= 1 << 20


def test_parts_of_the_lexicon_give_the_same_artifact(monkeypatch):
    words = [f"word{i}" for i in range(50)] + ["<|endoftext|>", "naïve", "日本"]
    whole = b"".join(compiled(monkeypatch, words))
    monkeypatch.setattr(bpe, "LEXICON_PART", 7)
    assert b"".join(compiled(monkeypatch, words)) == whole


def test_the_fit_lets_go_of_its_texts():
    texts = ["you are an idiot", "a fine day", ""] * 20
    labels = np.array([1, 0, 0] * 20)
    net = toxicity.train(texts, labels, np.ones(60))
    assert texts == [] and np.isfinite(net.scale).all()
