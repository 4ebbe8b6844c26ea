"""Token ids of a public byte-level vocabulary, inside tasks."""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these code points two regex libraries may class a letter differently, as they know different Unicode versions.
_SURE = re.compile("[^\x00-ɏ]")


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in such a vocabulary file: itself if it prints, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """``encode(text)`` gives the ids that ``tokenizers`` gives for the file, without special tokens, as uint32.

    Where the file is a plain byte-level BPE whose merges come in the order of their ids, ``tiktoken`` computes the same
    ids from the same file several times faster; it takes texts in the scripts where both agree on what a letter is.
    All else goes through ``tokenizers``, such as texts that hold the string of an added token, which becomes that token's
    id. A test compares the two.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            return None
        vocab, byte_of = model["vocab"], _byte_of()
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        ids = [vocab[a + b] for a, b in pairs]
        if ids != sorted(ids) or min(ids) < 256 or model.get("ignore_merges") or model.get("unk_token"):
            return None
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or _SURE.search(text) or any(x in text for x in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_CACHE: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]
