"""Operators 11 to 13 against brute force, held-out labels and exact round trips, with every kind of row."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import audit, middle, toxicity
from dossier.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LONG = "Some words of a very long text, IDIOT # number 4. " * 25_000  # over 1 MB
TEXTS = [(1, None), (2, ""), (3, LONG), (4, "a b c d idiot"), (4, "a b c d idiot"), (5, "a b c d idiot"), (6, " \n\t "), (None, "a b c d idiot"), (7, "a"), (7, "b")]
CLASHES = ["part", "mask", "n", "_id", "_text", "_y", "score", "form", "output", "weight", "row", "first", "step"]


def table(spark, rows=TEXTS):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") > 3, "en"))
    return docs.withColumns({c: F.lit(f"old {c}") for c in CLASHES})


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("_y", F.lit(7))


# Toxicity


@pytest.mark.parametrize(
    "text", ["You IDIOT!", "1d10t", "іdіоt in Cyrillic", "ïdïöt", "i.d.i.o.t", "i d i o t", "idiiiiot", "“idiot”", "ｉｄｉｏｔ", "idi​ot", "idiot$$$", "x !diot", "id!ot", "\N{MATHEMATICAL BOLD SMALL I}diot"]
)
def test_spellings_fold_alike(text):
    assert " idiot " in toxicity.fold(text)


@pytest.mark.parametrize("text", ["idiotic", "an idi ot", "100 4 1", "l.i", "", " \n", "idio t"])
def test_other_texts_do_not(text):
    assert " idiot " not in toxicity.fold(text)
    assert toxicity.fold(text).split() == toxicity.fold(toxicity.fold(text)).split()


def test_automaton_equals_words_looked_up_one_by_one():
    weights = {" idiot ": 3.0, " scum ": 2.5, " ach": 0.5, " achii": 1.5, " shut up ": 3.0, " trash ": 2.0}
    rng = random.Random(5)
    words = ["idiot", "scum", "achlich", "ach", "achl", "shut", "up", "trash", "can", "other", "scumm", "Trash", "t4", "pond"]
    lexicon = toxicity.Lexicon(weights)
    phrases = [toxicity.fold(p).split() for p in toxicity.EXCEPTIONS]
    for _ in range(500):
        said = toxicity.fold(" ".join(rng.choices(words, k=rng.randrange(30)))).split()
        total = n = 0
        covered = {i + j for i in range(len(said)) for p in phrases if said[i : i + len(p)] == p for j in range(len(p))}
        for i, word in enumerate(said):
            rest = " " + " ".join(said[i:]) + " "
            found = [t for t in weights if rest.startswith(t)]
            if found and i not in covered:
                total, n = total + weights[max(found, key=len)], n + 1
        got = lexicon.measure(f" {' '.join(said)} ")
        assert got[1] == n and got[0] == pytest.approx(total)


def test_exception_phrases_do_not_count():
    lexicon = toxicity.Lexicon({" trash ": 2.0})
    assert lexicon.measure(toxicity.fold("Put it in the trash can."))[1] == 0
    assert lexicon.measure(toxicity.fold("trash can trash"))[1] == 1


def test_held_out_labels_are_met_and_never_read(spark):
    folder = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 4000"), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.toxicity(docs, marks).cache()
    r = toxicity.held_out_accuracy(found, marks).first()
    assert r["n"] > 200 and r["accuracy"] > 0.97 and r["precision"] > 0.9 and r["recall"] > 0.75
    rows = {x["doc_id"]: x for x in found.collect()}
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for i, x in rows.items())
    # Other labels of held-out rows, languages and sources change nothing.
    other = marks.withColumn("toxic", F.when(toxicity.crc_fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}), other)
    assert {x["doc_id"]: x["score"] for x in again.collect()} == pytest.approx({i: x["score"] for i, x in rows.items()}, abs=1e-12)


def test_toxicity_takes_any_row(spark):
    made = [(100 + k, f"nasty grobble phrase w{k}" if k % 2 else f"kind words here w{k}") for k in range(60)]
    marks = [(i, 1, int("nasty" in t)) for i, t in made] + [(2, 1, 0), (None, 1, 1), (5, 1, None), (6, 0, 0), (6, 0, 1)]
    got = toxicity.toxicity(table(spark, TEXTS + made), labels(spark, marks)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS + made)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["score"], r["n_terms"]))
    assert by[1] == by[2] == by[6] == {(r["score"], 0) for r in got if r["doc_id"] == 2}  # null, empty and blank alike
    assert by[4] == by[5] == by[None] and len(by[4]) == 1  # equal texts alike
    assert [n for _, n in by[3]] == [25_000]
    assert all(r["predicted"] == int("nasty" in t) for r in got for i, t in made if r["doc_id"] == i)
    assert next(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.toxicity(table(spark, []), labels(spark, marks)).collect() == []
    # Without labels the seeds alone count.
    alone = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(table(spark), labels(spark, [])).collect()}
    assert alone[4] == 1 and alone[1] == alone[7] == 0


# Audit of filters


def test_intervals_tile_the_ranks():
    for k in (1, 3, 5):
        orders = list(permutations(range(k)))
        by = defaultdict(dict)
        for mask, step, start, end in audit.intervals(k):
            for rank in range(start, end):
                assert rank not in by[mask]
                by[mask][rank] = step
        for mask in range(1, 1 << k):
            assert by[mask] == {r: next(i + 1 for i, f in enumerate(o) if mask >> f & 1) for r, o in enumerate(orders)}
    assert len(audit.intervals(5)) * 2 - sum(end == factorial(5) for *_, end in audit.intervals(5)) > 0


def audited(docs, marks):
    """Every order applied to every text, one by one."""
    good = {i for i, q, _ in marks if q == 1}
    toxic = {i for i, _, t in marks if t == 1}
    texts = [(i, t or "") for i, t, _ in docs]
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and t == text for j, t in texts):
            fails.add("E")
        rows.append((part or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                out[part, order, step + 1] = [f, len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[out[key][0]])
    return out


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(3)
    docs = [(i, t, "en" if i is None or i > 3 else None) for i, t in TEXTS]
    plain = " ".join(f"w{k}" for k in range(250))
    made = [plain, plain + " $", plain.upper(), "w " * 300, "W# " * 300, plain, "x", "x"]
    docs += [(20 + k, rng.choice(made), rng.choice(["en", "de", None, ""])) for k in range(40)]
    marks = [(20 + k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 40, 2)] + [(20, 1, 1), (None, 1, 1), (4, 1, 0)]
    df = table(spark, [(i, t) for i, t, _ in docs]).drop("lang")
    langs = spark.createDataFrame([(i, t, p) for i, t, p in docs], "doc_id long, text string, lang string")
    got = audit.audit_filters(langs.withColumns({c: F.lit("x") for c in CLASHES}), labels(spark, marks)).collect()
    want = audited(docs, marks)
    assert len(got) == len(want) and df.columns
    for r in got:
        mine = [r[c] for c in ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
        assert mine == want[r["part"], r["filter_order"], r["step"]], (r["part"], r["filter_order"], r["step"])
    assert audit.audit_filters(table(spark, []), labels(spark, marks)).collect() == []


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1), ("p", 3, 2, 1)], "part string, mask int, n long, good long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["good_lost"], r["shapley"]) for r in audit.audit_masks(counts, "AB", ("good",)).collect()}
    assert got == {("AB", 1): (5, 2, 0, 1, 2), ("AB", 2): (5, 0, 2, 0, 2), ("BA", 1): (5, 2, 0, 1, 2), ("BA", 2): (5, 0, 2, 0, 2)}
    with pytest.raises(ValueError):
        audit.audit_masks(counts, "BA")


# Fill in the middle


def cut(i, text):
    text = text or ""
    n, sha = len(text), lambda x: hashlib.sha256(x.encode()).hexdigest()
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, sha(text), sha(text))
    if h4 % 100 < 20:
        return (i, n, "spm", p, q - p, sha("<S>" + text[q:] + "<P>" + text[:p] + "<M>" + text[p:q]), sha(text))
    return (i, n, "psm", p, q - p, sha("<P>" + text[:p] + "<S>" + text[q:] + "<M>" + text[p:q]), sha(text))


ODD = ["<P", "<<S>", "a<P>b", "<M>", "é" * 3000, "漢字😀" * 2000, "\x00퟿\U0010ffff", "x" * 9000, "<S" * 50, "P>S>M>" * 20, "́e" * 99, "a😀"]


def test_cuts_equal_plain_slices(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = sorted(cut(i, t) for i, t in docs)
    assert sorted(map(tuple, QUERIES["op13_fill_in_middle"](spark, DATA).collect())) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_cuts_of_any_row(spark):
    rows = TEXTS + [(1000 + 50 * k + j, t) for k, t in enumerate(ODD) for j in range(20)]
    found = middle.fill_in_middle(table(spark, rows), keep=CLASHES)
    kept = [c for c in CLASHES if c not in ("n", "form", "output")]
    assert all(r[c] == f"old {c}" for r in found.collect() for c in kept)
    key = lambda x: (x[0] is None, *map(str, x))
    assert sorted(map(tuple, middle.digest(found).collect()), key=key) == sorted((cut(i, t) for i, t in rows), key=key)
    assert middle.digest(middle.fill_in_middle(table(spark, []))).collect() == []


def test_chunks_follow_content_and_counts_place_characters():
    rng = random.Random(1)
    signs = ["a", "é", "漢", "😀", " "]
    passage = "".join(rng.choices(signs, k=6000)).encode()
    one, two = (("".join(rng.choices(signs, k=n))).encode() + passage for n in (500, 777))
    chunks = [{d[a:b] for a, b in zip([0, *e[:-1]], e, strict=True)} for d in (one, two) for e in [middle.chunk_ends(np.frombuffer(d, np.uint8))]]
    shared = sum(map(len, chunks[0] & chunks[1]))
    assert shared > 0.8 * len(passage)
    cutter = middle.Cutter()
    for data in (one, two, b"", "é".encode() * 5000, b"x" * 10_000):
        text = data.decode()
        ends, counts = cutter.table(data)
        assert (int(counts[-1]) if len(counts) else 0) == len(text)
        assert not len(ends) or (ends[-1] == len(data) and max(np.diff(ends, prepend=0)) <= middle.MOST)
        for k in {0, 1, len(text) // 3, len(text) - 1, len(text)} if text else {0}:
            assert cutter.offset(data, ends, counts, k) == len(text[:k].encode())
