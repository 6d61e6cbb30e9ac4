"""Ids of other tokenizers than the one whose rules are known."""

import json

import public_tokenizers
from tokenizers import Tokenizer

from skein.llm.tokens import Encoder, default_path, goes_by_word

TEXTS = ["The Quick brown FOX's 123 été naïve × 漢字 é", "", None, " a  b\n\nc ", "<|endoftext|> x", "x" * 300]


def test_a_tokenizer_with_other_rules_gets_texts_whole(tmp_path):
    assert goes_by_word(default_path())
    with open(default_path(), encoding="utf-8") as file:
        told = json.load(file)
    told["normalizer"] = None  # keeps capitals
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told), encoding="utf-8")
    for path in (str(other), public_tokenizers.path("byte_bpe_50k.json"), default_path()):
        library = Tokenizer.from_file(path)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
        assert goes_by_word(path) == (path == default_path())
        assert [list(map(int, ids)) for ids in Encoder(path).encode(TEXTS)] == want
