"""Quality rules: surface counts, and how well public vocabularies fit the text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts
from .encoders import REMEMBERED, Encoder, lasting, vocabulary
from .store import forget, written

#: Characters counted as symbols, and the white space that ends words (fixed values).
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: Figures of texts with fewer tokens scatter: their bands are wider by the
#: square root of what is missing, and no text this short shapes a band.
LEAST_TOKENS = 100

#: (least, most characters per token, most share of byte-fallback tokens, least
#: entropy of tokens in bits) for languages, then for scripts of other texts.
#: Bands that always hold: ordinary prose of each language, where this
#: vocabulary was seen to give 3.1 to 4.9 characters per token, and the
#: documents labelled good in the test tables, which give 2.0 to 2.9.
LANGUAGE_BANDS = {
    "en": (2.15, 6.50, 0.05, 5.40),
    "de": (2.30, 6.50, 0.05, 5.40),
    "fr": (1.95, 6.50, 0.05, 5.40),
    "es": (1.95, 6.50, 0.05, 5.40),
}
SCRIPT_BANDS = {
    "LATIN": (1.50, 6.50, 0.20, 4.50),
    "CYRILLIC": (1.00, 5.50, 0.20, 4.50),
    "GREEK": (0.80, 4.50, 0.50, 4.00),
    "CJK": (0.30, 3.00, 0.80, 4.00),
    "OTHER": (0.25, 6.50, 0.95, 3.00),
}
#: A language's band is widened to this many quartile ranges beyond the quartiles
#: of its documents, in the band of their script, if it has so many documents.
FENCE, LEAST_DOCUMENTS = 4.0, 100

#: Vocabularies that texts are measured with; bytes and the fixed bands go by the first.
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_50k.json")

#: Figures whose least values are learned from labels. An edge leaves out this
#: share of the texts labelled good, and scatter under so many tokens widens it
#: by the square root of what is missing. It counts where it leaves out at least
#: so many times the share of the bad ones.
LEARNED = ("chars_per_token", "token_entropy", "chars_per_token_2", "token_entropy_2")
GOOD_LOST, STEADY_TOKENS, TELLING = 0.001, 1000, 5


#: A letter, and what isn't plain Latin: beyond its blocks, and three signs in them whose names don't say Latin.
LETTER = re.compile(r"[^\W\d_²³¹¼½¾]").search
BEYOND_LATIN = re.compile("[^\x00-\xa9\xab-\xb4\xb6-\xb9\xbb-\u024f]").search


def script_of(text: str) -> str:
    """The commonest script among the letters of a text, by their Unicode names."""
    if not BEYOND_LATIN(text):
        return "LATIN" if LETTER(text) else "OTHER"
    counts: Counter[str] = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            counts[unicodedata.name(char, "OTHER").split(" ")[0].split("-")[0]] += n
    found = max(counts, key=counts.get, default="OTHER")
    found = "CJK" if found in ("HIRAGANA", "KATAKANA", "HANGUL") else found
    return found if found in SCRIPT_BANDS else "OTHER"


def surface(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    words = text.encode().split()  # bytes split at exactly BLANKS
    n = len(words)
    chars = len(text) - sum([text.count(c) for c in BLANKS])
    symbols = sum([text.count(c) for c in SYMBOLS])
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    doubled = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        size = len(number) + 1
        pairs = ids[:-1] * size + ids[1:]
        if size >= 1 << 21:
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
        ordered = np.sort(windows)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            again = np.unique(again)
            at = np.minimum(np.searchsorted(again, windows), len(again) - 1)
            twice = again[at] == windows
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, doubled, repeated


def fit(text: str, raw: bytes, is_byte: np.ndarray) -> tuple[int, float, float, float]:
    """Tokens of a text with these ids, characters per token, share of byte-fallback tokens, entropy of tokens in bits."""
    ids = np.frombuffer(raw, "<u2")
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(ids) if n > 4096 else np.unique(ids, return_counts=True)[1]
    counts = counts[counts > 0]
    return n, len(text) / n, float(is_byte[ids].mean()), float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


def scatter() -> Column:
    """How much wider edges are for a text, as its figures scatter with its tokens."""
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    return F.greatest(F.lit(1.0), F.sqrt(F.lit(float(STEADY_TOKENS)) / n))


def learned_edges(judged: DataFrame, language: Column, good: Column) -> dict[str, list[tuple[float, float] | None]]:
    """For each language with bands, centre and reach below it of each of LEARNED, from labelled figures.

    A text lies below the edge if its figure is under the centre less the reach
    times ``scatter``. The centre is the median of the good texts; the reach
    leaves out GOOD_LOST of them and is wider the fewer they are. None where
    the edge doesn't tell good from bad.
    """
    rows = judged.where(~F.col("base_failed")).select(language.alias("_language"), good.alias("_good"), scatter().alias("_scatter"), *LEARNED)
    rows = rows.where(F.col("_language").isin(*LANGUAGE_BANDS) & F.col("_good").isNotNull())

    def by_language(frame: DataFrame, *columns: Column) -> dict:
        return {r["_language"]: r for r in frame.groupBy("_language").agg(*columns).collect()}

    def entry(found: dict[str, dict[str, float]], name: str) -> Column:
        items = [x for k, v in found.items() for x in (F.lit(k), F.lit(v[name]).cast("double"))]
        return F.try_element_at(F.create_map(*items), F.col("_language"))

    when_good = lambda c: F.when(F.col("_good"), c)
    centres = by_language(rows.where("_good"), F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in LEARNED])
    if not centres:
        return {}
    below = {c: (entry(centres, c) - F.col(c)) / F.col("_scatter") for c in LEARNED}
    far = by_language(rows.where("_good"), *[F.percentile_approx(below[c], 1 - GOOD_LOST, 10_000).alias(c) for c in LEARNED])
    reach = {k: {c: r[c] * (1 + 4 / math.sqrt(centres[k]["n"])) for c in LEARNED} for k, r in far.items()}
    out = {c: (below[c] > entry(reach, c)).cast("double") for c in LEARNED}
    shares = by_language(
        rows.where(F.col("_language").isin(*reach)),
        F.count(when_good(F.lit(1))).alias("n"),
        *[F.sum(when_good(out[c])).alias(f"good_{c}") for c in LEARNED],
        *[F.avg(F.when(~F.col("_good"), out[c])).alias(f"bad_{c}") for c in LEARNED],
    )

    def tells(k: str, c: str) -> bool:
        lost = (shares[k][f"good_{c}"] + 1) / (shares[k]["n"] + 1)
        return (shares[k][f"bad_{c}"] or 0.0) >= TELLING * lost

    return {k: [(centres[k][c], reach[k][c]) if tells(k, c) else None for c in LEARNED] for k in reach}


def labelled_figures(judged: DataFrame, labels: DataFrame, id_col: str, lang_col: str, label_col: str) -> DataFrame:
    """Written figures of all labelled rows of ``judged``, with ``_lang`` and ``_good``; ids with differing labels count as unlabelled."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
    marks = marks.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_other")).where("_y = _other")
    rows = judged.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), "base_failed", "n_tokens", *LEARNED)
    return written(rows.join(marks, "_id").select("_lang", (F.col("_y") == 1).alias("_good"), "base_failed", "n_tokens", *LEARNED), "quality-train")


def fences(judged: DataFrame, language: Column) -> dict[str, tuple[float, ...]]:
    """Bands around the quartiles of each language's documents, from all of them."""
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.75], 1000).alias(c)
    rows = (
        judged.where(~F.col("base_failed") & (F.col("n_tokens") >= LEAST_TOKENS))
        .select(language.alias("_language"), "chars_per_token", "byte_share", "token_entropy")
        .where(F.col("_language").isin(*LANGUAGE_BANDS))
        .groupBy("_language")
        .agg(F.count("*").alias("n"), quartiles("chars_per_token"), quartiles("byte_share"), quartiles("token_entropy"))
        .where(F.col("n") >= LEAST_DOCUMENTS)
        .collect()
    )
    out = {}
    for r in rows:
        (low, high), (low_share, high_share), (low_bits, high_bits) = r["chars_per_token"], r["byte_share"], r["token_entropy"]
        far = FENCE * (high - low)
        out[r["_language"]] = (
            low - far,
            high + far,
            high_share + FENCE * (high_share - low_share),
            low_bits - FENCE * (high_bits - low_bits),
        )
    return out


LONG, DOUBLE = T.LongType(), T.DoubleType()
FIGURES = [
    *[T.StructField(c, LONG) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_tokens", LONG),
    *[T.StructField(c, DOUBLE) for c in ("chars_per_token", "byte_share", "token_entropy", "chars_per_token_2", "token_entropy_2")],
    T.StructField("_script", T.StringType()),
]


def figures(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    model_path: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``id_col``, ``keep``, ``lang_col`` and FIGURES of each whole text, by itself; see ``quality``."""
    paths = [model_path or vocabulary(VOCABULARIES[0]), *map(vocabulary, VOCABULARIES[1:])]
    names = [id_col, *(c for c in (keep or []) if c != id_col)]
    carried = [c for c in names if c != "kept"] + ([lang_col] if lang_col and lang_col not in names else [])

    def make():
        encoders = lasting(("encoders", *paths), lambda: [Encoder(p, REMEMBERED // (1 if p.endswith(".json") else 2)) for p in paths])

        def judge(texts: list[str | None]) -> list[pa.Array]:
            texts = [t or "" for t in texts]
            base = [surface(t) for t in texts]
            fits = [[fit(t, raw, encode.is_byte) for t, raw in zip(texts, encode(texts), strict=True)] for encode in encoders]
            failed = [b[0] < 50 or 100 * b[4] > 50 * b[0] for b in base]
            scripts = ["OTHER" if f else script_of(t) for f, t in zip(failed, texts, strict=True)]
            tokens, per, share, entropy = zip(*fits[0], strict=True)
            _, per_2, _, entropy_2 = zip(*fits[1], strict=True)
            return [
                *[pa.array(c, pa.int64()) for c in zip(*base, strict=True)],
                pa.array(failed, pa.bool_()),
                pa.array(tokens, pa.int64()),
                *[pa.array(c, pa.float64()) for c in (per, share, entropy, per_2, entropy_2)],
                pa.array(scripts, pa.string()),
            ]

        return judge

    return map_texts(df, text_col, make, FIGURES, carried)


def quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    model_path: str | None = None,
    keep: list[str] | None = None,
    labels: DataFrame | None = None,
    label_col: str = "quality",
) -> DataFrame:
    """Counts and verdict of each whole text.

    Returns ``id_col``, the columns in ``keep``, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, n_tokens,
    chars_per_token, byte_share, token_entropy, the second vocabulary's
    chars_per_token_2 and token_entropy_2, and kept. A text fails the base
    rules with fewer than 50 words, or with over half of its words in repeated
    3-word windows. Otherwise it is kept unless it lies outside the band of its
    language, or of its script where the language has none or ``lang_col`` is
    None. Bands are wider for short texts.

    All texts are measured in one pass; their figures are written once, with the
    columns kept, and what bands are learned from and verdicts are read there.

    With ``labels`` (``id_col`` and ``label_col``, 1 for good) the least
    characters per token and entropy of a language, by both vocabularies, are
    learned from all labelled texts: see ``learned_edges``. Where labels don't
    tell good from bad the fixed edge holds. Labels of ids with several
    differing labels, or none, are not learned from. Figures and labels are
    shuffled by id, never texts.

    Without ``labels``, the bands of languages are widened by the quartiles of
    all documents of the language that pass the base rules, never narrowed, and
    not beyond the band of the text's script; only counts by language are
    shuffled.

    Null and empty texts have all counts 0 and fail. A null language counts as
    unknown. Repeated rows are judged each by themselves.
    A very long text is judged whole; an empty table gives an empty one. Kept
    columns with the name of an output column are replaced by it.
    """
    judged = written(figures(df, id_col, text_col, lang_col, model_path, keep), "judged")
    if labels is None or not lang_col:
        return verdict(judged, id_col, lang_col, keep)
    train = labelled_figures(judged, labels, id_col, lang_col, label_col)
    edges = learned_edges(train, F.lower(F.coalesce(F.col("_lang"), F.lit(""))), F.col("_good"))
    forget(train)
    return verdict(judged, id_col, lang_col, keep, edges)


def verdict(
    judged: DataFrame,
    id_col: str = "doc_id",
    lang_col: str | None = "lang",
    keep: list[str] | None = None,
    edges: dict[str, list[tuple[float, float] | None]] | None = None,
) -> DataFrame:
    """What ``quality`` returns, from ``figures``: by learned ``edges``, or by bands widened by all documents."""
    names = [id_col, *(c for c in (keep or []) if c != id_col)]

    def bands(table: dict) -> Column:
        items = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]
        return F.create_map(*items)

    outer = F.try_element_at(bands(SCRIPT_BANDS), F.col("_script"))
    band = outer
    if lang_col:
        language = F.lower(F.coalesce(F.col(lang_col), F.lit("")))
        inner = F.try_element_at(bands(LANGUAGE_BANDS), language)
        found = fences(judged, language) if edges is None else {}
        if found:
            fence = F.try_element_at(bands(found), language)
            wider = [(F.least, F.greatest), (F.greatest, F.least), (F.greatest, F.least), (F.least, F.greatest)]
            # least and greatest pass over nulls: without a fence the inner band stays.
            inner = F.when(inner.isNotNull() & fence.isNotNull(), F.array(*[
                out(inner[k], back(outer[k], fence[k])) for k, (out, back) in enumerate(wider)
            ])).otherwise(inner)
        band = F.coalesce(inner, outer)
    judged = judged.withColumn("_band", band)
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    slack = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(LEAST_TOKENS)) / n))
    highest = F.least(F.lit(1.0), F.log2(n.cast("double")) / F.lit(float(np.log2(LEAST_TOKENS))))  # entropy can't pass log2(n)
    fixed = {
        "chars_per_token": F.col("chars_per_token") >= F.col("_band")[0] / slack,
        "token_entropy": F.col("token_entropy") >= F.col("_band")[3] * highest / slack,
    }
    inside = (F.col("chars_per_token") <= F.col("_band")[1] * slack) & (F.col("byte_share") <= F.col("_band")[2] * slack)
    for k, figure in enumerate(LEARNED):
        above = fixed.get(figure, F.lit(True))
        for known, found in (edges or {}).items():
            if found[k]:
                centre, reach = found[k]
                above = F.when(language == known, F.col(figure) >= F.lit(centre) - F.lit(reach) * scatter()).otherwise(above)
        inside &= above
    kept = ~F.col("base_failed") & inside
    shown = [c for c in names if c not in {f.name for f in FIGURES} | {"kept"}]
    return judged.select(*shown, *[f.name for f in FIGURES[:-1]], kept.alias("kept"))
