import random

import numpy as np
import pytest

from dossier.llm.encoders import EACH, SIGNS, Encoder, Memory, as_signs, vocabulary
from dossier.llm.tokencount import MergeCounter

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
#: Bits of text that meet at places where tokens could cross.
BITS = [
    " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", "▁", "▁▁", "a", "The", "don't", "I'LL", "é", "é", "ñ", "Ñandú", "ß", "İ", "ſ", "x.", "y,", "Z!?", "end.", "½.", "²,",
    "1.", "3,5", "_a_.", "...", "'s", "'S.", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>.", "</s>", "<s>", "<unk>", "<0x41>", "漢字", "漢。", "ก", "😀", "👩‍👩‍👧", "​", "﻿", "\x00", "a" * 300, "12345678901234567890", "http://a.b/c?d=e", "#tag", "--", "퟿",
]


def library(name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        return lambda text: model.encode(text)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary(name))
    return lambda text: model.encode(text, add_special_tokens=False).ids


def hostile(n):
    rng = random.Random(4)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + BITS + ["", "word " * 30_000]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("bound", [30_000, 80_000_000])
def test_ids_equal_the_library(name, bound):
    texts, encode, ids = hostile(1500), Encoder(vocabulary(name), bound), library(name)
    for text, raw in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == ids(text), repr(text)
    assert encode([None]) == [b""]


def test_counts_equal_the_library():
    texts, count, ids = hostile(1500), MergeCounter(vocabulary(FILES[2])), library(FILES[2])
    for text in texts:
        assert count(text) == len(ids(text)), repr(text)


def test_memory_stays_within_its_bound():
    made = []
    memory = Memory(lambda k: made.append(k) or b"x", 300 * EACH)
    for k in range(5000):
        memory[str(k)]
        assert len(memory) + len(memory.old) <= 600 and memory["0"] == b"x"
    assert made.count("0") == 1  # asked for all the time, so never forgotten
    long = Memory(lambda k: k.encode(), 300 * EACH)
    assert long["y" * 10_000] == b"y" * 10_000 and not long


def test_sentencepiece_gets_whole_texts_unless_they_are_long(monkeypatch):
    texts, ids = hostile(300), library(FILES[2])
    for most in (0, 20, 1_000_000):
        monkeypatch.setattr("dossier.llm.encoders.WHOLE", most)
        encode = Encoder(vocabulary(FILES[2]))
        assert [np.frombuffer(raw, "<u2").tolist() for raw in encode(texts)] == [ids(t) for t in texts]
        assert bool(encode.ids) == (most < 150_000)  # before: every word was remembered


def test_signs_of_plain_words_are_those_of_their_bytes():
    for word in (" a", "Zz", "  b", " ", "", "a b", " é", "x.", "\na"):
        assert as_signs(word) == word.encode().decode("latin-1").translate(SIGNS)
