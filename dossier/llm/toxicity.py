"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text, per length, less exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts
from .store import written

#: Terms that count without any label, at weight SEED_WEIGHT (fixed values).
SEEDS = (
    "idiot", "moron", "imbecile", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumbass",
    "bastard", "bitch", "asshole", "retard", "whore", "slut", "jackass", "vermin", "subhuman", "kill yourself", "shut up",
)
SEED_WEIGHT = 3.0

#: Phrases in which a term is meant otherwise; what they cover doesn't count (fixed values).
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "rodeo clown", "sore loser", "winner and loser",
    "the idiot by dostoevsky", "pond scum", "soap scum", "stupid mistake", "flame retard", "fire retard",
)

#: Signs of other scripts that look like a Latin letter (fixed values).
HOMOGLYPHS = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "β": "b", "ь": "b", "с": "c", "ϲ": "c", "ԁ": "d", "ɗ": "d", "е": "e", "ё": "e", "ε": "e", "є": "e",
    "ғ": "f", "ɡ": "g", "һ": "h", "н": "h", "η": "n", "і": "i", "ї": "i", "ι": "i", "ı": "i", "ӏ": "i", "ј": "j", "к": "k", "κ": "k", "ⅼ": "l",
    "м": "m", "ո": "n", "п": "n", "о": "o", "ο": "o", "σ": "o", "օ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t",
    "υ": "u", "ս": "u", "ц": "u", "ν": "v", "ѵ": "v", "ω": "w", "ш": "w", "ԝ": "w", "х": "x", "χ": "x", "у": "y", "ү": "y", "γ": "y", "ż": "z",
    "ß": "b", "ø": "o", "đ": "d", "ł": "l", "æ": "a", "œ": "o", "þ": "p",
}
#: Digits and signs that stand for a letter inside a word (fixed values). 1, l and | all become i, in terms as well.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}

#: Signs that count only where a letter follows and no other sign stands before.
_SIGN = re.compile(r"(?<![^\s\w])[@$!|€£](?=\w)")
#: Letters that stand alone, parted by one and the same sign or space: s.t.u.p.i.d.
_SPACED = re.compile(rb"(?<![a-z0-9\x80-\xff])[a-z](?:([ .\-_*])[a-z])(?:\1[a-z]){2,}(?![a-z0-9\x80-\xff])")
_LONG_RUN = re.compile(rb"([a-z])\1{2,}")

#: Lengths of the word beginnings that are terms beside whole words.
BEGINNINGS = range(4, 9)


@lru_cache(maxsize=1)
def _letters() -> dict[int, str | None]:
    """Signs whose compatibility form is one Latin letter, look-alikes, marks and invisible signs, which go, and what parts words."""
    table: dict[int, str | None] = {}
    for point in (*range(0xA0, 0x3100), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800), *range(0x1F130, 0x1F18A)):
        sign = chr(point)
        if unicodedata.category(sign) in ("Mn", "Cf"):
            table[point] = None
            continue
        plain = [c for c in unicodedata.normalize("NFKD", sign).lower() if not unicodedata.combining(c)]
        if len(plain) == 1 and plain[0] != sign and (plain[0] in HOMOGLYPHS or plain[0].isascii() and plain[0].isalnum()):
            table[point] = HOMOGLYPHS.get(plain[0], plain[0])
        elif unicodedata.category(sign)[0] in "PSZ":
            table[point] = " "
    table |= {ord(a): b for a, b in HOMOGLYPHS.items()}
    table[0xAD] = None
    return table


_DIGITS = bytes.maketrans("".join(DIGITS).encode(), "".join(DIGITS.values()).encode())
#: Bytes of words; all others become spaces, and l becomes i.
_IN_WORDS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_PARTED = bytes(ord("i") if b == ord("l") else b if _IN_WORDS[b] else 32 for b in range(256))


def fold(text: str) -> str:
    """Words of ``text`` in one spelling, a space before, between and after them.

    Small letters, without accents; look-alikes of other scripts as the Latin
    letter they look like; digits and signs inside a word as the letter they
    stand for, l and 1 as i; letters of a word that are parted one by one
    joined; three or more of a letter as one. Whole texts are folded, in time
    that grows with their length; patterns run only where their bytes occur.
    """
    text = text.lower()
    if not text.isascii():
        table, odd = _letters(), [c for c in set(text) if c > "\x7f"]
        if len(odd) > 64:
            text = text.translate(table)
        else:
            for c in odd:
                if ord(c) in table:
                    text = text.replace(c, table[ord(c)] or "")
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    text = text.encode()
    data = np.frombuffer(text, np.uint8)
    inside = _IN_WORDS[data]
    if len(data) >= 7:
        alone = inside.copy()
        alone[1:] &= ~inside[:-1]
        alone[:-1] &= ~inside[1:]
        if (alone[:-6] & alone[2:-4] & alone[4:-2] & alone[6:]).any():
            text = _SPACED.sub(lambda m: m[0].replace(m[1], b""), text)
    same = data[1:] == data[:-1]
    if (same[1:] & same[:-1] & inside[2:]).any():
        text = _LONG_RUN.sub(rb"\1", text)
    words = text.translate(_PARTED).split()
    if ((data >= 48) & (data <= 57)).any():
        words = [w if w.isalpha() or w.isdigit() else w.translate(_DIGITS) for w in words]
    return f" {b' '.join(words).decode()} "


def terms_of(word: str) -> list[str]:
    """The whole word, a space after it, and its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in BEGINNINGS if k < len(word))]


class Lexicon:
    """Weighted terms and exception phrases as one automaton over folded text."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (len(term), weight, False))
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (len(fold(phrase)), 0.0, True))
        self.automaton.make_automaton()

    def measure(self, folded: str) -> tuple[float, int]:
        """The sum of weights, of each word the longest term's alone, and how many words have one."""
        best: dict[int, tuple[int, float]] = {}
        covered = []
        for end, (size, weight, exception) in self.automaton.iter(folded):
            start = end - size + 1
            if exception:
                covered.append((start, end))
            elif size >= best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        if covered:
            covered.sort()
            at, reach = 0, -1
            for start in sorted(best):
                while at < len(covered) and covered[at][0] <= start:
                    reach, at = max(reach, covered[at][1]), at + 1
                if start < reach:
                    del best[start]
        return math.fsum(w for _, w in best.values()), len(best)


def figures(df: DataFrame, weights: dict[str, float], text_col: str, keep: list[str], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """``keep`` and, of each whole text, n_terms (words that hold a term), weight (their sum) and per_100 (the sum for 100 words)."""
    fields = [T.StructField("n_terms", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("per_100", T.DoubleType())]

    def make() -> Callable[[list[str | None]], list[pa.Array]]:
        lexicon = Lexicon(weights, exceptions)

        def measured(texts: list[str | None]) -> list[pa.Array]:
            found = []
            for text in texts:
                folded = fold(text or "")
                total, n = lexicon.measure(folded)
                found.append((n, total, 100.0 * total / max(1, folded.count(" ") - 1)))
            return [pa.array([x[i] for x in found], f) for i, f in enumerate((pa.int64(), pa.float64(), pa.float64()))]

        return measured

    return map_texts(df, text_col, make, fields, keep)


def term_counts(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """term, and how many toxic and other texts hold it (bad, good).

    A task sums what it reads before anything is shuffled, in parts of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            terms = list(sums[0].keys() | sums[1].keys())
            counts = [pa.array([s[t] for t in terms], pa.int64()) for s in sums]
            for s in sums:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], names=["term", "bad", "good"])

        for batch in batches:
            for text, bad in zip(batch.column("text").to_pylist(), batch.column("bad").to_pylist(), strict=True):
                words = set(fold(text or "").split())
                sums[0 if bad else 1].update({t for word in words for t in terms_of(word)})
                if len(sums[0]) + len(sums[1]) > 200_000:
                    yield flush()
        yield flush()

    parts = rows.select(F.col(text_col).alias("text"), (F.col(label_col) == 1).alias("bad")).mapInArrow(run, "term string, bad long, good long")
    return parts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn_lexicon(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", most: int = 4096, least_z: float = 4.5) -> dict[str, float]:
    """Weights of SEEDS and of terms that more of the labelled toxic texts hold than of the others.

    A weight is the logarithm of the ratio of shares, a half added to each
    count, less one standard error. Texts are counted, not occurrences, so one
    that repeats a word tells no more, and equal texts count once. Terms whose
    share differs by under ``least_z`` standard errors are left out, by their
    likelihood ratio, which serves rare terms, and by the ratio of shares. Of
    the rest the ``most`` with the highest make up the lexicon: that bounds
    what the driver gets, whatever the size of the corpus.
    """
    once = rows.dropDuplicates([text_col])
    total = once.agg(F.count(F.when(F.col(label_col) == 1, 1)).alias("all_bad"), F.count(F.when(F.col(label_col) != 1, 1)).alias("all_good"))
    b, g = F.col("bad") + 0.5, F.col("good") + 0.5
    ratio = F.log(b / (F.col("all_bad") + 1)) - F.log(g / (F.col("all_good") + 1))
    found = term_counts(once, text_col, label_col).where("bad > 1").join(F.broadcast(total))
    has, all_bad, all_good = F.col("bad") + F.col("good"), F.col("all_bad"), F.col("all_good")
    every = all_bad + all_good
    # Of texts with and without the term, toxic or not: what is there against what equal shares would give.
    cell = lambda x, row, column: F.when(x > 0, x * F.log(x * every / (row * column))).otherwise(0.0)
    sides = cell(F.col("bad"), has, all_bad) + cell(F.col("good"), has, all_good)
    sides += cell(all_bad - F.col("bad"), every - has, all_bad) + cell(all_good - F.col("good"), every - has, all_good)
    found = found.withColumns({"ratio": ratio, "error": F.sqrt(1 / b + 1 / g), "z": F.greatest(F.sqrt(2 * sides), ratio / F.sqrt(1 / b + 1 / g))}).where((F.col("z") >= least_z) & (ratio > F.col("error")))
    top = found.orderBy(F.desc("z"), "term").limit(most).select("term", "bad", (F.col("ratio") - F.col("error")).alias("w")).collect()
    seeds = {f" {fold(s).strip()} ": SEED_WEIGHT for s in SEEDS}
    return seeds | {r["term"]: r["w"] for r in _without_stubs(top)}


def _without_stubs(terms: list[Row], share: float = 0.8) -> list[Row]:
    """Without beginnings that ``share`` of the texts have from one longer term alone: not every word that begins like it is meant."""
    most: dict[str, int] = {}
    for r in terms:
        for k in BEGINNINGS:
            if k + 1 < len(r["term"].rstrip()) or (k + 1 == len(r["term"].rstrip()) and r["term"].endswith(" ")):
                stub = r["term"][: k + 1]
                most[stub] = max(most.get(stub, 0), r["bad"])
    return [r for r in terms if most.get(r["term"], 0) < share * r["bad"]]


def crc_fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5


def calibrated(scored: DataFrame, features: list[str], label_col: str, rounds: int = 12, pull: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression (constant first) by Newton's steps; each step is one aggregate over ``scored``."""
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    y, n = (F.col(label_col) == 1).cast("double"), len(features) + 1
    beta = np.zeros(n)
    for _ in range(rounds):
        line = sum((F.lit(float(w)) * c for w, c in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))
        sums = [F.sum((y - p) * c) for c in x] + [F.sum(p * (1 - p) * x[i] * x[j]) for i in range(n) for j in range(i, n)] + [F.count("*")]
        row = scored.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        if not row[-1]:
            return beta
        slope, second = np.array(row[:n]), np.zeros((n, n))
        second[np.triu_indices(n)] = row[n:-1]
        second += np.triu(second, 1).T
        ridge = pull * row[-1] * np.diag([1e-6] + [1.0] * (n - 1))
        step = np.linalg.solve(second + ridge + 1e-9 * np.eye(n), slope - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return beta


def features() -> dict[str, Column]:
    """What the score is made of."""
    return {"dense": F.log1p("per_100")}


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = 20_000,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> DataFrame:
    """Per row: ``id_col``, held_out, score (0 to 1), predicted, n_terms and per_100.

    The lexicon and its calibration are learned from labelled rows whose
    crc32 of the id as text isn't divisible by 5 (others are ``held_out``), of
    at most about ``train_rows`` of them, drawn by a hash of the id: that
    bounds what is learned from, never what is scored. Every whole text is
    scored, by the text alone. Labels of ids with several differing labels, or
    without one, are not learned from. A label is joined by the id: as many
    rows come out as ``docs`` has, repeated ones included. Without any label
    the seeds alone count, and then a score is the weight for 100 words
    against that of one seed in 50.

    Null and empty texts hold no term and get the score of such. Very long
    texts are folded and matched whole. A null id is held out. An empty table
    gives an empty one. Other columns are not read, so any names are safe.
    """
    drawn = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(11)), F.lit(1 << 20))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id is not null and _y is not null")
    marks = marks.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_other")).where("_y = _other").drop("_other")
    marks = marks.where(crc_fold("_id") != 0)
    n = marks.count()
    if n > train_rows:
        marks = marks.where(drawn < math.ceil((1 << 20) * train_rows / n))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # About train_rows at most: broadcast, so that texts stay where they are.
    train = written(texts.join(F.broadcast(marks), "_id").select("_text", "_y"), "toxic-train")
    weights = learn_lexicon(train, "_text", "_y")
    scored = written(figures(train, weights, "_text", ["_y"], exceptions).withColumns(features()), "toxic-figures")
    names = list(features())
    classes = scored.select("_y").distinct().count() if n else 0
    beta = calibrated(scored, names, "_y") if classes > 1 else np.array([-2.0 * math.log1p(2 * SEED_WEIGHT), 2.0])
    line = sum((F.lit(float(w)) * F.col(c) for w, c in zip(beta[1:], names, strict=True)), F.lit(float(beta[0])))
    score = 1 / (1 + F.exp(-line))
    every = figures(texts, weights, "_text", ["_id"], exceptions).withColumns(features())
    return every.select(
        F.col("_id").alias(id_col),
        F.coalesce(crc_fold("_id") == 0, F.lit(True)).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        "n_terms",
        "per_100",
    )


def held_out_accuracy(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Of labelled rows that were held out: how many, accuracy, precision and recall."""
    rows = scored.where("held_out").join(labels.select(id_col, F.col(label_col).alias("_y")), id_col)
    hit = (F.col("predicted") == 1) & (F.col("_y") == 1)
    count = lambda c: F.sum(c.cast("long"))
    return rows.agg(
        F.count("*").alias("n"),
        F.avg((F.col("predicted") == F.col("_y")).cast("double")).alias("accuracy"),
        (count(hit) / F.nullif(count(F.col("predicted") == 1), F.lit(0))).alias("precision"),
        (count(hit) / F.nullif(count(F.col("_y") == 1), F.lit(0))).alias("recall"),
    )
