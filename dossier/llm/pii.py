"""Personal data: patterns propose, checksums confirm, context words adjust. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Countries by the number of signs in their IBANs.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(" ".join(IBAN_SIGNS.values()).split())
#: A country's own number of signs ends its IBAN, whatever follows after a space.
#: Codes of no such country take all signs that follow, up to one of a known country.
_IBAN = "|".join(
    [rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_SIGNS.items()]
    + [rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20(?!(?:{_KNOWN})[0-9]{{2}})[A-Z0-9]|[A-Z0-9]){{11,30}}+"]
)

#: Kinds in the order of the result; the first four are the base kinds (fixed patterns).
#: Quantifiers are possessive where what follows can't match inside them, and
#: starts inside a run that has failed already are skipped, so time stays
#: proportional to the text and no repetition recurses.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
BASE = ("email", "ip", "card", "phone")

#: A text without this has no match: a cheap test before the pattern.
NEEDS = {"email": "@", "phone": "+"}

#: Score of a valid match, and what a context word nearby adds. Base kinds are
#: reported at any score; the others from LEAST on, so an IBAN stands by its
#: checksum, while a bare number of nine or ten digits needs its word.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "tel": 0.3}
CONTEXT_ADDS, CONTEXT_CHARS, LEAST = 0.35, 40, 0.6
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|credit|visa|master|amex|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|handy|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|\bsocial\b",
    "tel": r"phone|\btel|call|mobile|fax|handy|telefon|téléphone|teléfono",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Remainder of an IBAN: first four signs last, letters as 10 to 35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    signs = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(
        signs,
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def _valid(kind: str, match: Column) -> Column:
    count = F.length(_digits(match))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        # The checksum is only asked of digits that are few enough.
        return F.when((count >= 13) & (count <= 19), F.call_function("luhn_check", _digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return (count >= 9) & (count <= 15)
    if kind == "iban":
        return _mod97(match) == 1
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


#: Items of an array that are summed up one by one; longer arrays go block by block.
BLOCK = 128
#: Characters of a text that are cut out together.
STRETCH = 1000


def running(values: Column, kind: str, join, start) -> Column:
    """Before each item, what ``join`` makes of ``start`` and all items before it.

    Appending to an array copies it, so blocks are run through by themselves
    and then moved by what stands before them.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    first = F.lit(start).cast(kind)

    def scan(items: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(first.alias("now"), none.alias("out")),
            lambda acc, x: F.struct(join(acc["now"], x).cast(kind).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")),
            lambda acc: acc["out"],
        )

    total = lambda items: F.aggregate(items, first, lambda acc, x: join(acc, x).cast(kind))
    at = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(BLOCK)).cast("int"))
    blocks = F.transform(at, lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    before = scan(F.transform(blocks, total))
    moved = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before.alias("s")), lambda z: F.transform(scan(z["b"]), lambda x: join(z["s"], x).cast(kind))))
    return F.when(F.size(values) == 0, none).when(F.size(values) <= BLOCK, scan(values)).otherwise(moved)


def stretches(text: Column) -> Column:
    """The text in stretches of STRETCH characters, from which ``cut`` takes parts without going through all of it."""
    return F.when(F.length(text) <= STRETCH, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRETCH}}}+"), F.lit(0)))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end`` of the text in ``parts``."""
    low = F.floor(start / F.lit(STRETCH)).cast("int")
    count = F.floor(end / F.lit(STRETCH)).cast("int") - low + 1
    near = F.array_join(F.slice(parts, low + 1, count), "")
    return F.substr(near, start - low * STRETCH + 1, F.greatest(end - start, F.lit(0)))


def _with_spans(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with __text, its __parts and __spans: valid matches in code points, by kind, then by start.

    Arrays are columns before lambdas use them: a lambda would make them anew for each item.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = df.select("*", text.alias("__text"), stretches(text).alias("__parts"))
    text, kinds = F.col("__text"), list(PATTERNS)
    no_text, no_number = (F.expr(f"cast(array() as array<{t}>)") for t in ("string", "int"))
    has = {k: F.contains(text, F.lit(NEEDS[k])) if k in NEEDS else text.rlike(pattern_probe(k)) for k in kinds}
    at = at.select("*", *[F.when(has[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(no_text).alias(f"__m_{k}") for k in kinds])
    gaps = {k: F.transform(F.split(text, PATTERNS[k], -1), F.length) for k in kinds}
    at = at.select("*", *[F.when(F.size(f"__m_{k}") > 0, gaps[k]).otherwise(no_number).alias(f"__g_{k}") for k in kinds])
    # Each match begins where the gaps and matches before it end.
    step = lambda k: F.zip_with(F.slice(f"__g_{k}", F.lit(1), F.size(f"__m_{k}")), f"__m_{k}", lambda g, m: g + F.length(m))
    at = at.select("*", *[step(k).alias(f"__s_{k}") for k in kinds])
    at = at.select("*", *[running(F.col(f"__s_{k}"), "int", lambda a, b: a + b, 0).alias(f"__b_{k}") for k in kinds])
    at = at.select("*", *[_judged(k).alias(f"__k_{k}") for k in kinds])
    return at.select(*df.columns, "__text", "__parts", F.concat(*[f"__k_{k}" for k in kinds]).alias("__spans"))


def _judged(kind: str) -> Column:
    """Of the matches of one kind the valid ones, as structs with their scores."""
    ends = F.zip_with(f"__b_{kind}", f"__s_{kind}", lambda a, b: a + b)
    places = F.zip_with(ends, f"__m_{kind}", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    def scored(x: Column) -> Column:
        before = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(cut(F.col("__parts"), before, x["end"] + CONTEXT_CHARS))
        word = F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_ADDS)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.least(F.lit(1.0), F.lit(SCORES[kind]) + word).alias("score"),
        )

    spans = F.transform(F.filter(places, lambda x: _valid(kind, x["match"])), scored)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST)


def pattern_probe(kind: str) -> str:
    """A simple pattern that any match of the kind contains."""
    return {"iban": "[A-Z]{2}[0-9]{2}", "ssn": "-[0-9]{2}-", "ip": r"[0-9]\.[0-9]"}.get(kind, "[0-9]")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Spans of personal data in each whole text.

    Returns ``id_col``, the columns in ``keep`` and spans, an array of (kind,
    start, end, score), by kind in the order of PATTERNS, then by start; end is
    exclusive and both count code points. Spans of different kinds may overlap.

    Null and empty texts have no spans. Rows are judged each by themselves,
    repeated ones too; an empty table gives an empty one. Time is in proportion
    to a text and its matches, however long. Nothing is shuffled.
    """
    names = [id_col, *(c for c in (keep or []) if c not in (id_col, "spans"))]
    rows = df.select(F.struct(*names).alias("row"), F.col(text_col).alias("text"))
    return _with_spans(rows, "text").select("row.*", F.col("__spans").alias("spans"))


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash of the base spans and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return df.select(
        id_col,
        *[count(k) for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the spans in its texts replaced; a null text stays null, an empty one empty, every row stays.

    A column n_chars, where there is one, gets the new length.
    """
    names = df.columns
    rows = _with_spans(df.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), "text")
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = rows.withColumn("__spans", ordered).withColumn("__ends", F.transform("__spans", lambda s: s["end"]))
    # Where the spans before each one end: those that begin there or later start a run.
    rows = rows.withColumn("__reached", running(F.col("__ends"), "int", lambda a, b: F.greatest(a, b), 0))
    head = lambda s, r: F.when((s["start"] >= r) | (r == 0), F.struct(r.alias("from"), s["start"].alias("to"), s["kind"].alias("kind")))
    rows = rows.withColumn("__heads", F.filter(F.zip_with("__spans", "__reached", head), lambda x: x.isNotNull()))
    parts = F.col("__parts")
    pieces = F.transform("__heads", lambda h: F.concat(cut(parts, h["from"], h["to"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
    new = F.concat(F.array_join(pieces, ""), cut(parts, F.array_max("__ends"), F.length("__text")))
    rows = rows.withColumn("__new", F.when(F.size("__spans") > 0, new))
    made = {text_col: F.coalesce("__new", "text")}
    if "n_chars" in names:
        length = F.length("__new").cast(df.schema["n_chars"].dataType)
        made["n_chars"] = F.when(F.col("__new").isNotNull(), length).otherwise(F.col("row")["n_chars"])
    return rows.select(*[made.get(c, F.col("row")[c]).alias(c) for c in names])
