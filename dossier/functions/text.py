"""Column functions for record documents: cells, sections, tables, key/value pairs, tags."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..labels import TRUNCATED

#: Ends of lines.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: White space, that of other scripts and four control characters included; patterns with it carry UNICODE.
SPACE = r"[\s\x1c-\x1f]"
#: The same signs one by one: those that Unicode calls white space, and the four.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Flags: Unicode classes; only \n ends a line for ^, $ and the dot; ^ and $ at every line.
UNICODE, LINES = "(?U)", "(?dmU)"
#: The heading of a section; the white space after its marks may hold a line end.
HEADING = rf"{LINES}^(#{{1,4}}){SPACE}+(.+)$"


def strip(c: Column) -> Column:
    """Without white space at both ends, ideographic spaces included."""
    return F.btrim(c, F.lit(SPACES))


def only_newlines(c: Column) -> Column:
    """Whether no line of ``c`` ends by anything but a newline."""
    signs = [*"\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"]
    return ~reduce(Column.__or__, [c.contains(x) for x in signs])


def lines(c: Column, plain: Column | None = None) -> Column:
    """Lines of a text. Where ``plain`` holds (by default ``only_newlines`` of it) they are cut without a pattern, at a fraction of the time."""
    return F.when(only_newlines(c) if plain is None else plain, F.split(c, "\n")).otherwise(F.split(c, LINE_ENDS))


def found(c: Column, pattern: str, flags: str = UNICODE) -> Column:
    """The first group of the first match; "" without one."""
    return F.regexp_extract(c, flags + pattern, 1)


def pieces(c: Column, separators: str) -> Column:
    """Parts between separators, without white space around them, empty ones dropped."""
    return F.filter(F.transform(F.split(c, UNICODE + separators), strip), lambda x: x != "")


def holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether ``c`` contains one of the words: without a pattern, at a fraction of the time."""
    return reduce(Column.__or__, [c.contains(w) for w in words])


def alternatives(words: tuple[str, ...]) -> str:
    """A pattern of literal words, tried in their order."""
    return "|".join(rf"\Q{w}\E" for w in words)


def clean_cell(c: Column) -> Column:
    """Line-break tags become spaces."""
    return strip(F.when(c.contains("<br"), F.regexp_replace(c, rf"{UNICODE}<br{SPACE}*/?>", " ")).otherwise(c))


def has_colon(c: Column) -> Column:
    """A cheap test before patterns that need a colon."""
    return c.contains(":") | c.contains("：")


def safe_name(c: Column, default: str = "") -> Column:
    """Letters, digits, - and _ only; ``default`` if nothing is left."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "")
    return F.when(kept == "", F.lit(default)).otherwise(kept) if default else kept


def headings(md: Column) -> Column:
    """Names of sections in order; the text before the first is ``_preamble``."""
    return F.concat(F.array(F.lit("_preamble")), F.transform(F.regexp_extract_all(md, F.lit(HEADING), F.lit(2)), strip))


def bodies(md: Column) -> Column:
    """Texts under the names that ``headings`` gives."""
    return F.transform(F.split(md, HEADING), strip)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def _one_of_each(items: Column, name: str, pick: Callable[[Column, Column], Column]) -> Column:
    """Of items that have the same ``name``, struct with it first, those that ``pick`` takes: sorted once, then each beside its neighbours."""
    return bound(F.sort_array(items), lambda s: F.filter(s, lambda x, i: F.coalesce(pick(s, i)[name] != x[name], F.lit(True))))


def sections(names: Column, texts: Column) -> Column:
    """Array of (name, body); a repeated heading keeps its first place and its last body.

    Headings are sorted once, so a text of many sections costs little more
    than in proportion.
    """
    whole = F.transform(F.arrays_zip(names.alias("n"), texts.alias("t")), lambda x, i: F.struct(x["n"].alias("name"), i.alias("at"), x["t"].alias("body")))

    def placed(items: Column) -> Column:
        first = _one_of_each(items, "name", lambda s, i: F.get(s, i - 1))
        last = _one_of_each(items, "name", lambda s, i: F.get(s, i + 1))
        both = bound(last, lambda b: F.transform(first, lambda x, i: F.struct(x["at"].alias("at"), x["name"].alias("name"), F.get(b, i)["body"].alias("body"))))
        return F.transform(F.sort_array(both), lambda x: F.struct(x["name"].alias("name"), x["body"].alias("body")))

    return bound(whole, placed)


def section(parts: Column, name: str) -> Column:
    """Body of a section; "" where it is missing."""
    return F.coalesce(F.get(F.filter(parts, lambda s: s["name"] == name), 0)["body"], F.lit(""))


def barred(body: Column, plain: Column | None = None) -> Column:
    """Lines that start with a bar, without separator rows."""
    return F.filter(F.transform(lines(body, plain), strip), lambda x: x.startswith("|") & ~x.rlike(rf"{UNICODE}^\|(?:{SPACE}|[-:|])+\|\z"))


def table_rows(body: Column, plain: Column | None = None) -> Column:
    """Cells of each line that starts with a bar, without separator rows and outer empty cells."""

    def cells(line: Column) -> Column:
        inner = lambda s: F.slice(s, F.lit(2), F.size(s) - F.when(strip(F.try_element_at(s, F.lit(-1))) == "", 2).otherwise(1))
        return bound(F.split(line, r"\|"), lambda s: F.transform(inner(s), clean_cell))

    return F.transform(barred(body, plain), cells)


def key_values(rows: Column) -> Column:
    """(key, value) pairs of rows: a cell that ends in a colon is a key, the next one its value."""
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")

    def pairs(cells: Column) -> Column:
        def step(acc: Column, cell: Column) -> Column:
            is_key = has_colon(cell) & cell.rlike(rf"{UNICODE}[:：]{SPACE}*\z")
            key = strip(F.replace(strip(F.regexp_replace(cell, rf"{UNICODE}(?:{SPACE}|\*)*[:：]{SPACE}*\z", "")), F.lit("*"), F.lit("")))
            paired = F.struct(acc["pending"].alias("key"), cell.alias("value"))
            return (
                F.when(acc["pending"].isNotNull(), F.struct(F.lit(None).cast("string").alias("pending"), F.array_append(acc["out"], paired).alias("out")))
                .when(is_key, F.struct(key.alias("pending"), acc["out"].alias("out")))
                .otherwise(acc)
            )

        def close(acc: Column) -> Column:
            last = F.struct(acc["pending"].alias("key"), F.lit("").alias("value"))
            return F.when(acc["pending"].isNotNull(), F.array_append(acc["out"], last)).otherwise(acc["out"])

        return F.aggregate(cells, F.struct(F.lit(None).cast("string").alias("pending"), none.alias("out")), step, close)

    return F.filter(F.flatten(F.transform(rows, pairs)), lambda x: x["key"] != "")


def keys_in_text(text: Column, keys: tuple[str, ...]) -> Column:
    """(key, value) pairs of running text: a known key and a colon start a value that lasts to the next."""
    mark = rf"{UNICODE}({alternatives(keys)}){SPACE}*[:：]{SPACE}*"
    names = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
    # Cut once, not once for each key.
    pairs = bound(F.split(text, mark), lambda v: F.transform(names, lambda n, i: F.struct(n.alias("key"), strip(F.get(v, i + 1)).alias("value"))))
    return F.when(has_colon(text), pairs).otherwise(F.expr("cast(array() as array<struct<key:string,value:string>>)"))


def running_text(section: Column) -> Column:
    """Lines that are no images and no headings, joined by spaces, without bold marks."""
    plain = F.filter(
        F.transform(lines(section), strip), lambda x: (x != "") & ~x.startswith("![") & ~x.rlike(rf"{UNICODE}^#{{1,4}}{SPACE}+")
    )
    return F.replace(F.array_join(plain, " "), F.lit("**"), F.lit(""))


def _unique(pairs: Column, sign: int) -> Column:
    """Of each key the pair that comes first once places are multiplied by ``sign``; in the order of keys."""
    placed = F.transform(pairs, lambda x, i: F.struct(x["key"].alias("key"), (i * sign).alias("at"), x["value"].alias("value")))
    return _one_of_each(placed, "key", lambda s, i: F.get(s, i - 1))


def last_of_each(pairs: Column) -> Column:
    """Of each key the last pair, by one sort; in the order of keys."""
    return F.transform(_unique(pairs, -1), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def first_of_each(pairs: Column) -> Column:
    """Of each key the first pair, by one sort; in the order of keys."""
    return F.transform(_unique(pairs, 1), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def key_map(pairs: Column, last: bool = False) -> Column:
    """Map of keys to their first value, or to the last. Keys are made unique by a sort, so the session's rule on repeated keys doesn't matter."""
    return F.map_from_entries(last_of_each(pairs) if last else first_of_each(pairs))


def at_key(pairs: Column, *keys: str) -> Column:
    """What a map holds for the first of ``keys`` that is in it; "" without one."""
    return F.coalesce(*[F.try_element_at(pairs, F.lit(k)) for k in keys], F.lit(""))


def filled(pairs: Column, more: Column) -> Column:
    """Pairs that hold text, then ``more``, then those left: the first of a key counts."""
    return F.concat(F.filter(pairs, lambda x: x["value"] != ""), more, pairs)


def value(pairs: Column, *keys: str) -> Column:
    """The last value of the first key that is present; "" without one."""

    def last(key: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda x: x["key"] == key), F.lit(-1))["value"]

    return F.coalesce(*[last(k) for k in keys], F.lit(""))


def first_value(pairs: Column, *keys: str) -> Column:
    """The first value of the first key that is present; "" without one."""

    def first(key: str) -> Column:
        return F.get(F.filter(pairs, lambda x: x["key"] == key), 0)["value"]

    return F.coalesce(*[first(k) for k in keys], F.lit(""))


def hashtags(body: Column) -> Column:
    """Distinct tags of lines that start with # and are no headings, in order; a tag with # inside is none."""
    tagged = F.filter(F.transform(lines(body), strip), lambda x: x.startswith("#") & ~x.rlike(rf"{UNICODE}^#{{1,4}}{SPACE}+\S"))
    tags = F.flatten(F.transform(tagged, lambda x: F.regexp_extract_all(x, F.lit(rf"{UNICODE}#(\S[^#]*?)(?={SPACE}+#|{SPACE}*\z)"), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(tags, strip), lambda x: x != ""))


def hashtag_lines(text: Column) -> Column:
    """For display: tags of each line that holds nothing else, parted by white space."""
    whole = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike(r"^#\w\S*(?:\s+#\w\S*)*$"))
    return F.transform(whole, lambda x: F.transform(F.split(x, r"\s+"), lambda t: F.substr(t, F.lit(2))))


def split_documents(text: Column, heading: str) -> Column:
    """One text for each person: cut before lines of 1 to 6 # and ``heading``; text before the first stays.

    A blank text is one part as it is.
    """
    parts = F.filter(F.transform(F.split(text, rf"{LINES}(?=^#{{1,6}} {heading}$)"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def log_name(text: Column, index: Column, key: str) -> Column:
    """The value cell beside the name key, else candidate_ and the number."""
    name = strip(found(text, rf"\Q{key}\E:{SPACE}*\|{SPACE}*([^\n|]+)"))
    return F.when(text.rlike(rf"{UNICODE}\Q{key}\E:{SPACE}*\|{SPACE}*[^\n|]+"), name).otherwise(F.concat(F.lit("candidate_"), index.cast("string")))


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("double")


def score_band(
    score: Column,
    cuts: tuple[float, ...] = (80, 60, 40),
    names: tuple[str, ...] = ("80+", "60-79", "40-59", "<40"),
    missing: str = "No Score",
    rounded: bool = False,
) -> Column:
    """The name of the first cut that ``score`` reaches, after rounding to one place if asked; ``missing`` for null."""
    reached = round_to_tenth(score) if rounded else score
    band = F.when(score.isNull(), missing)
    for cut, name in zip(cuts, names, strict=False):
        band = band.when(reached >= cut, name)
    return band.otherwise(names[-1])


def round_to_tenth(c: Column) -> Column:
    """To one place by the exact value of the double, ties to the even digit.

    Twenty times the value less an odd number tells which tenth is nearer; as
    16 and 4 times it, no step of that is rounded.
    """
    low = F.floor(c * 10)
    odd = (low * 2 + 1).cast("double")
    over = (c * 16 - odd) + c * 4
    up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2)) == 1))
    return (F.when(up, low + 1).otherwise(low) / F.lit(10)).cast("double")


def score_label(score: Column) -> Column:
    """Rounded half up; -- for null."""
    return F.coalesce(F.floor(score + 0.5).cast("string"), F.lit("--"))


def preview(items: Column, n: int) -> tuple[Column, Column]:
    """The first ``n`` items and how many are left over."""
    return F.slice(items, 1, n), F.greatest(F.size(items) - n, F.lit(0))


def strip_fences(c: Column) -> Column:
    """Without the code fence around a reply."""
    text = strip(c)
    opened = F.regexp_replace(F.regexp_replace(text, r"(?U)^```\w*\n?", ""), r"\n?```\z", "")
    return F.when(text.startswith("```"), strip(opened)).otherwise(text)


def within_budget(c: Column, context: int = 4096, response: int = 2048, system_chars: int = 0) -> Column:
    """Cut to what a model's context leaves, at two characters a token, with a marker."""
    limit = max((context - (system_chars // 2 + 50) - response) * 2, 500)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(TRUNCATED))).otherwise(c)


def encode_list(c: Column) -> Column:
    return F.to_json(F.coalesce(c, F.expr("cast(array() as array<string>)")))


def decode_list(c: Column) -> Column:
    """Null and empty text give an empty list."""
    return F.coalesce(F.from_json(F.nullif(c, F.lit("")), "array<string>"), F.expr("cast(array() as array<string>)"))


def path_parts(c: Column) -> tuple[Column, Column, Column]:
    """Folder, stem and suffix of a path; the suffix has its dot."""
    name = F.regexp_extract(c, r"([^/]*)/*$", 1)
    folder = F.regexp_replace(F.regexp_extract(c, r"^(.*)/[^/]*$", 1), r"/+$", "")
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return folder, F.left(name, F.length(name) - F.length(suffix)), suffix
