"""Token ids of many texts with the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import os
import re

import numpy as np

#: White space that the tokenizers' and Python's patterns may see differently; such texts, and those with marks of special tokens, are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters before punctuation are a piece of their own: every pre-tokenizer here cuts between the two.
_WORDS = re.compile(rf"[{_LETTERS}]++(?=[.,!?;: \t-\r])|[^ \t-\r]++")
_SPACED = re.compile(rf" ?(?:[{_LETTERS}]++(?=[.,!?;: \t-\r])|[^ \t-\r]++)|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


def default_path(name: str) -> str:
    """The place of a public vocabulary file that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, equal to encoding each text by the library.

    The library never joins a token across the pieces that its own pre-tokenizer makes, so a piece has the
    same ids wherever it stands. Texts are cut where every such pre-tokenizer cuts, and each distinct piece is
    encoded once by the library and remembered. split: "words" where white space is dropped and letters are
    lower-cased (pieces are words), "spaces" where a space goes with the word behind it, None to encode whole texts.
    Texts with white space beyond ASCII or with special tokens are encoded whole. Pieces are remembered in two
    generations of at most ``keep`` each: a piece met again moves to the younger one, and the older one is dropped when that is full.
    """

    def __init__(self, path: str, split: str | None, keep: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split, self.keep = split, keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Make sure that the younger generation has all the pieces."""
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        fresh = pieces.difference(self.young)
        again = self.old.keys() & fresh
        self.young.update((p, self.old[p]) for p in again)
        new = list(fresh - again)
        self.young.update(zip(new, self._whole(new), strict=True))

    def _pieces(self, text: str) -> list[str]:
        if self.split == "words":
            return _WORDS.findall(text.lower() if text.isascii() else text)
        return _SPACED.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """An array of uint32 ids for each text."""
        cut = [None if self.split is None or "<|" in t or _ODD.search(t) else self._pieces(t) for t in texts]
        self._learn(set().union(*[c for c in cut if c is not None]))
        ids = self.young.__getitem__
        raw = [self._whole([t])[0] if c is None else b"".join(map(ids, c)) for t, c in zip(texts, cut, strict=True)]
        return [np.frombuffer(r, dtype="<u4") for r in raw]


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, split: str | None) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (path, split) not in _ENCODERS:
        _ENCODERS[path, split] = Encoder(path, split)
    return _ENCODERS[path, split]
