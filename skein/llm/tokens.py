"""Token ids by the tokenizers library, with the ids of recurring words remembered.

The tokenizer named here normalises (NFC, lower case), cuts the text into words
(a fixed pattern, white space dropped) and encodes every word on its own.  So a
text's ids are its words' ids, one after another, and each distinct word needs
to go to the library once per worker (until the remembered words exceed
``most`` and are forgotten).

* Texts of ASCII and Latin-1 letters are cut here, by the same pattern; there
  NFC changes nothing, and lower-casing A-Z first saves remembering both cases.
* Other texts are cut at ASCII white space only, which no word crosses.
* Texts with a special token's opening ``<|`` go to the library whole.

A tokenizer with other rules gets every text whole.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Sequence
from itertools import chain, count, islice

import numpy as np

from skein.llm.common import offsets, resident

#: The tokenizer's word pattern, for bytes of ASCII and Latin-1 letters.
_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc3\x80-\xbf]+|[0-9]|[^\sa-z0-9\xc3\x80-\xbf]+")
_LATIN = bytes(range(128)) + b"\xc3" + bytes(range(0x80, 0xC0))


#: The rules, as a tokenizer's file states them, under which words can be encoded on their own.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def goes_by_word(path: str) -> bool:
    """Whether the tokenizer of this file normalises, cuts and marks special tokens as is said above."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    normal, before = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    cuts = before.get("pretokenizers") or [{}]
    whole = cuts[-1].get("type") == "ByteLevel" and not cuts[-1].get("add_prefix_space") and not cuts[-1].get("use_regex")
    special = all(t["content"].startswith("<|") for t in told.get("added_tokens") or ())
    return normal.get("normalizers") == _NORMALIZER and cuts[:-1] == [_SPLIT] and whole and special and told.get("post_processor") is None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def worker_encoder(path: str | None) -> Encoder:
    """The encoder of this Python worker, with the words that earlier tasks met."""
    return resident(("encoder", path), lambda: Encoder(path))


class Encoder:
    def __init__(self, path: str | None = None, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.by_word = goes_by_word(path or default_path())
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.sizes = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _remember(self, first: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        total, end = len(ids), first + len(sizes)
        if end > len(self.starts):
            more = np.zeros(max(end, len(self.starts)), dtype=np.int64)
            self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), dtype=np.uint32)])
        self.sizes[first:end] = sizes
        self.starts[first:end] = self.used + offsets(sizes)[:-1]
        self.pool[self.used : self.used + total] = ids
        self.used += total

    def _learn_one_by_one(self, first: int, parts: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch([p.decode() for p in parts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self._remember(first, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes)

    def _learn_words(self, first: int, parts: list[bytes]) -> None:
        together = self.tokenizer.encode(b" ".join(parts).decode(), add_special_tokens=False)
        word = np.array(together.word_ids, dtype=np.int64)
        if len(word) and word[-1] == len(parts) - 1:
            self._remember(first, np.array(together.ids, dtype=np.uint32), np.bincount(word, minlength=len(parts)))
        else:
            self._learn_one_by_one(first, parts)

    def _numbers(self, parts: list[list[bytes]], learn) -> np.ndarray:
        first = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=sum(map(len, parts)))
        if fresh := len(self.number) - first:
            learn(first, list(islice(reversed(self.number), fresh))[::-1])
        return at

    def _ids(self, parts: list[list[bytes]], learn) -> list[np.ndarray]:
        at = self._numbers(parts, learn)
        sizes = self.sizes[at]
        begin = offsets(sizes)
        index = np.repeat(self.starts[at] - begin[:-1], sizes)
        index += np.arange(begin[-1])
        flat = self.pool[index]
        ends = begin[offsets([len(p) for p in parts])]
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none), as uint32 arrays."""
        if len(self.number) > self.most:
            self._forget()
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        cut: dict[int, list[bytes]] = {}
        spaced: dict[int, list[bytes]] = {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or "<|" in text:
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            raw = text.encode().lower()
            if raw.translate(None, _LATIN) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
                spaced[k] = raw.split()
            else:
                cut[k] = _WORD.findall(raw)
        for parts, learn in ((cut, self._learn_words), (spaced, self._learn_one_by_one)):
            for k, ids in zip(parts, self._ids(list(parts.values()), learn), strict=True):
                out[k] = ids
        return out
