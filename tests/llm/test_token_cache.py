"""The tokenizer runs without the library's store of merged words, and counts as the library does."""

import public_tokenizers
from tokenizers import Tokenizer

from sluice.llm import tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_are_not_stored(monkeypatch):
    sizes = []

    class Held:
        model = type("Model", (), {"_resize_cache": sizes.append})

        def no_truncation(self):
            pass

        no_padding = no_truncation

    monkeypatch.setattr("tokenizers.Tokenizer", type("Tokenizer", (), {"from_file": staticmethod(lambda path: Held())}))
    tokens._tokenizer.__wrapped__("x")
    assert sizes == [1]


def test_counts_without_store_are_those_of_the_library():
    texts = ["ofthe ofthe zzqx zzqx", "<|endoftext|> a  b\n\té", "", "wörter " * 500]
    whole = Tokenizer.from_file(PATH)
    assert tokens.count_tokens([t.encode() for t in texts], PATH) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
