"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts
from .encoders import REMEMBERED, SPACE, Memory, lasting, vocabulary


class MergeCounter:
    """Counts tokens of a sentencepiece byte-pair vocabulary without making ids.

    A text starts as one symbol a character, or as many as it has UTF-8 bytes
    when the vocabulary lacks the character. Adjacent symbols whose joined
    string is in the vocabulary wait in a heap by rank, the leftmost first
    among equals; each merge takes one from the count. No vocabulary entry
    holds a space mark after another character, so counts are kept by word,
    and a word is cut further wherever no entry has its two adjacent characters.
    """

    def __init__(self, path: str, bound: int = REMEMBERED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        }
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(p[0] != SPACE and p[1] == SPACE for p in self.pairs):
            raise ValueError(f"{path} has entries that cross a space")
        self.words, self.parts = Memory(self.word, bound), Memory(self.merged, bound // 4)
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        pieces = self.split(SPACE + text.replace(" ", SPACE))
        return sum(map(self.words.__getitem__, pieces))

    def word(self, word: str) -> int:
        pairs, start, total = self.pairs, 0, 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in pairs:
                part, start = word[start:i], i
                total += self.parts[part]
        return total

    def merged(self, part: str) -> int:
        """Initial symbols less merges."""
        rank, text = self.rank, list(part)
        size = len(text)
        count = sum([1 if c in rank else len(c.encode()) for c in text])
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        heap = [(rank[p], i, p) for i in range(size - 1) if (p := part[i : i + 2]) in rank]
        heapify(heap)
        while heap:
            _, left, piece = heappop(heap)
            if text[left] is None or (right := after[left]) < 0 or len(text[left]) + len(text[right]) != len(piece) or text[left] + text[right] != piece:
                continue  # one of the two was merged meanwhile
            text[left], text[right] = piece, None
            after[left] = nxt = after[right]
            count -= 1
            if nxt >= 0:
                before[nxt] = left
                if (p := piece + text[nxt]) in rank:
                    heappush(heap, (rank[p], left, p))
            if (prev := before[left]) >= 0 and (p := text[prev] + piece) in rank:
                heappush(heap, (rank[p], prev, p))
        return count


def merge_counter(path: str) -> MergeCounter:
    """The counter of a vocabulary, kept by a Python worker from task to task."""
    return lasting(("counter", path), lambda: MergeCounter(path))


def count_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str | None = None,
    limit: int = 4096,
) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit of each whole text.

    Null and empty texts have 0 bytes and 0 tokens. Rows are kept as they are:
    a repeated id or text gives a row each; an empty table gives an empty one.
    There is no shuffle, and no prefix or cap: a very long text costs its length
    times the logarithm of its longest word.
    """
    path = model_path or vocabulary("piece_bpe_32k.model")

    def make():
        counter = merge_counter(path)

        def count(texts: list[str | None]) -> list[pa.Array]:
            tokens = [counter(t) for t in texts]
            return [
                pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]

        return count

    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
    return map_texts(df, text_col, make, fields, [id_col])
