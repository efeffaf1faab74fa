"""Token ids of whole texts from a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from tidemill.llm.common import held


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that normalise one by one, whatever stands beside them.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


KINDS = {"H": "<u2", "I": "<u4"}


def ids_kind(path: str) -> str:
    """The numpy type that holds each id of the tokenizer file at ``path``."""
    from tokenizers import Tokenizer

    return KINDS["H" if Tokenizer.from_file(path).get_vocab_size() <= 65536 else "I"]


class WordIds(dict):
    """white-space-free piece of a text (bytes) -> its token ids (bytes, ``kind`` a piece).

    For tokenizers that drop white space, never join what it parts, and keep a run of letters as
    one word: the ids of a text are those of its pieces in turn, so pieces can be remembered
    (``room`` of them at most).
    """

    room = 400_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.dtype = KINDS[self.kind]
        self.word = re.compile(f"([{LETTERS}]+)([.,]?)")
        # How the model spells each letter, asked of the tokenizer's own steps.
        normal, parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        letters = filter(re.compile(f"[{LETTERS}]").match, map(chr, range(256)))
        self.spelling = str.maketrans({c: "".join(p for p, _ in parts.pre_tokenize_str(normal.normalize_str(c))) for c in letters})

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        word = self.word.fullmatch(text)
        if word and word[2]:
            value = self[word[1].encode()] + self[word[2].encode()]
        else:
            ids = [t.id for t in self.model.tokenize(text.translate(self.spelling))] if word else self.tokenizer.encode(text, add_special_tokens=False).ids
            value = array(self.kind, ids).tobytes()
        if len(self) < self.room:
            self[piece] = value
        return value

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    """One cache a worker process, kept from task to task."""
    return held(f"ids {path}", lambda: WordIds(path))
