"""Token ids of a public byte-level tokenizer, a word at a time through a bounded memo."""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: The split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_WORDS = 1 << 17

#: Texts of these characters, on whose class all Unicode versions agree, are cut at single spaces; others go to the library whole.
_PLAIN = regex.compile(r"[\t\n\r -~¡-ɏΑ-Ωα-ωА-я‐-‧€]*+")
_made: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as a rule: printable bytes for themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``encode`` returns ids as little-endian unsigned 32-bit numbers, equal to the tokenizers library's for the whole text.

    The pattern never joins what a single space parts, so a text is the sum of its
    words, each with the space before it. New words are encoded by their bytes' merge
    ranks, which in such a vocabulary are the ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.special}
        self.word = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        words = text.split(" ")
        if "" in words or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first = np.array(self.word(words[0]), "<u4").tobytes()
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        rest = words[1:]
        found = list(map(memo.get, rest))
        if None in found:
            for word in {w for w, f in zip(rest, found) if f is None}:
                memo[word] = np.array(self.word(" " + word), "<u4").tobytes()
            found = list(map(memo.__getitem__, rest))
        return first + b"".join(found)


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
