"""Public vocabularies applied word by word, with a bounded memory of words.

A text is cut where no token can cross: before each run of white space. Each
distinct piece then goes to the library once, and the ids of a text are the
joined ids of its pieces. Sentencepiece is as fast on whole texts where many
words are new, so it gets whole texts unless they are long. `tests/llm/test_encoders.py` holds this against the
libraries on whole texts.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: Bytes of remembered pieces, by their lengths and what each takes besides, in one generation.
REMEMBERED, EACH = 32_000_000, 120

#: Characters of a text that sentencepiece gets whole, at most: it holds some hundred bytes for each.
WHOLE = 100_000

#: The mark that stands for a space in sentencepiece vocabularies (fixed value).
SPACE = "▁"

#: Letters that stay one letter in lower case. Pre-tokenizers part a mark from the letter before it.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = rf"[{LETTERS}]++(?=[\s.,;:!?]|\Z)"
PLAIN = re.compile(f" ?[{LETTERS}]+").fullmatch

#: White space as the libraries see it: Python's, without four control characters.
WHITE, INK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
CONTROLS, BEYOND = re.compile("[\x1c-\x1f]").search, re.compile("[^\x00-\xff]").search


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory(dict):
    """What ``make`` gives for a key, remembered in two generations of bounded size.

    Once the young generation is full it becomes the old one; what is asked for
    again moves back. A key of over a hundredth of the bound is not remembered.
    """

    def __init__(self, make: Callable, bound: int = REMEMBERED):
        super().__init__()
        self.make, self.bound, self.size, self.old = make, bound, 0, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = len(key) + (len(value) if isinstance(value, bytes) else 0) + EACH
        if 100 * size > self.bound:
            return value
        self.size += size
        if self.size > self.bound:
            self.old, self.size = dict(self), size
            self.clear()
        self[key] = value
        return value


def _signs() -> dict[int, str]:
    """The sign that byte-level vocabularies show each byte as: itself where it prints, else the next after 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


SIGNS = _signs()


def as_signs(word: str) -> str:
    """A word's UTF-8 bytes as the signs that stand for them."""
    if word.isascii() and word.lstrip(" ").isalpha():
        return word.replace(" ", SIGNS[32])
    return word.encode().decode("latin-1").translate(SIGNS)


def little(ids: list[int]) -> bytes:
    """Little-endian unsigned 16-bit integers."""
    found = array("H", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Encoder:
    """Ids of whole texts as little-endian unsigned 16-bit integers.

    For `.json` files the tokenizers library, for `.model` files sentencepiece,
    both without added special tokens and with their defaults for special
    strings inside a text. Vocabularies have at most 65,536 ids.
    """

    def __init__(self, path: str, bound: int = REMEMBERED):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
            self.ready = lambda text: (SPACE + text.replace(" ", SPACE)) if text else ""
            # The library puts one mark before what it is given.
            alone = [model.piece_to_id(SPACE)]
            ids = lambda piece: model.encode(piece[1:]) if piece != SPACE else alone
            size = model.get_piece_size()
            self.is_byte = np.array([model.is_byte(i) for i in range(size)])
            self.whole = lambda text: little(model.encode(text))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            whole = lambda piece: model.encode(piece, add_special_tokens=False).ids
            merge = model.model.tokenize
            exact = re.compile(f"{WHITE}*{INK}+|{WHITE}+").findall
            bytewise = whole(" é") in ([t.id for t in merge(as_signs(" é"))], whole("é"))
            # Where neither white space nor case matters, they are dropped before words are told apart.
            folded = bytewise and whole("a") == whole(" a") == whole("\nA")
            fast = re.compile(f"{WORD}|\\S+" if folded else rf"\s*{WORD}|\s*\S+|\s+").findall

            def split(text: str) -> list[str]:
                if not bytewise or CONTROLS(text):
                    return exact(text)
                if not folded:
                    return fast(text)
                # Special strings are told apart by case, and beyond Latin-1 lower cases differ.
                return exact(text) if "<|" in text or BEYOND(text) else fast(text.lower())

            def ids(piece: str) -> list[int]:
                if bytewise and PLAIN(piece) and not (folded and piece != piece.strip().lower()):
                    return [t.id for t in merge(as_signs(piece))]
                return whole(piece)

            self.split, self.ready, self.whole = split, lambda text: text, None
            size = model.get_vocab_size(with_added_tokens=True)
            self.is_byte = np.zeros(size, dtype=bool)
        if size > 65_536:
            raise ValueError(f"{path} has {size} ids; 65,536 is the most")
        self.ids = Memory(lambda piece: little(ids(piece)), bound)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        known, whole = self.ids.__getitem__, self.whole
        return [
            b"" if not t else whole(t) if whole and len(t) <= WHOLE else b"".join(map(known, self.split(self.ready(t))))
            for t in texts
        ]


#: What a Python worker keeps from task to task, idle ones too: one thing at a time.
KEPT: list = [None, None]


def lasting(key: tuple, make: Callable):
    """What ``make`` gave for ``key`` in an earlier task of this worker, if nothing else was asked for since."""
    if KEPT[0] != key:
        KEPT[:] = [None, None]  # the old one goes before the new one is made
        KEPT[:] = [key, make()]
    return KEPT[1]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary, kept by a Python worker from task to task until it needs another."""
    return lasting(("encoder", path), lambda: Encoder(path))
