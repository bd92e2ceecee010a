"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import embeddings, idfiles, jaccard, mainpart, mixing, packing, pii, quality, shards, tokencount

LONG = "Some words of a very long text, number 4111 1111 1111 1111. " * 17_000  # over 1 MB
TEXTS = [(1, None), (2, ""), (3, LONG), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), (6, " \n\t "), (None, "a b c d e f")]
CLASHES = ["p", "at", "kept", "weight", "n_words", "_k", "spans", "row", "token", "slot", "judged", "n", "id"]


def table(spark, rows=TEXTS):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 3, "s"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit(f"old {c}") for c in CLASHES})


def through_files(df, folder):
    idfiles.write_id_files(df, folder)
    return idfiles.read_id_files(df.sparkSession, folder)


OPERATORS = {
    "op1": lambda df, tmp: jaccard.jaccard_components(df),
    "op2": lambda df, tmp: mainpart.extract_main_text(df, "doc_id", "text", None),
    "op3": lambda df, tmp: shards.assign_shards(df),
    "op5": lambda df, tmp: through_files(df, str(tmp / "ids")),
    "op6": lambda df, tmp: packing.pack_sequences(df),
    "op7": lambda df, tmp: pii.digest(pii.find_pii(df)),
    "op8": lambda df, tmp: quality.quality(df),
    "op9": lambda df, tmp: tokencount.count_tokens(df),
    "op10": lambda df, tmp: mixing.mix_sources(df, keep=CLASHES),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_any_row(spark, tmp_path, name):
    got = OPERATORS[name](table(spark), tmp_path).collect()
    want = Counter(i for i, _ in TEXTS)
    assert Counter(r["doc_id"] for r in got if name != "op6" or r["piece"] == 0) == want
    if name == "op1":
        of = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
        assert of[(5, 2)] == of[(4, 2)] == 4 and of[(1, 0)] == 1 and of[(None, 2)] is None
    if name == "op10":
        kept = [c for c in CLASHES if c not in ("slot", "weight")]
        assert all(r[c] == f"old {c}" for r in got for c in kept)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_empty_tables(spark, tmp_path, name):
    assert OPERATORS[name](table(spark, []), tmp_path).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_row(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = table(spark)
    out = stage(spark, docs, "")
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns and all(r[c] == f"old {c}" for r in rows for c in CLASHES)
        ids = Counter(r["doc_id"] for r in rows)
        assert ids == [ids, {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 6: 1}, Counter(i for i, _ in TEXTS), Counter(i for i, _ in TEXTS)][k]
    assert stage(spark, table(spark, []), "").collect() == []


def test_vectors_of_any_kind(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1e-200, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, []), (8, [1e200, 1e190]),
        (9, [0.0, 1.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [1.0]), (11, [2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "rep", "links", "vector", "copies")})
    got = defaultdict(list)
    for r in embeddings.near_vectors(df).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(2, 1, True)] and got[2] == [(2, 1, False)] and got[8] == [(2, 1, False)]
    assert got[9] == [(1, 9, True)] * 2 and got[10] == [(1, 10, True)] and got[11] == [(1, 10, False)]
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7)) and got[None] == [(0, None, True)]
    assert embeddings.near_vectors(df.limit(0)).collect() == []


def test_shards_hold_near_equal_bytes(spark):
    rows = [(k, f"text {k} " * (1 + k % 50)) for k in range(3000)] + [(5000 + k, "the same copy " * 30) for k in range(900)]
    got = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts, sums = dict(rows), Counter()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sums[r["shard"]] += r["size"]
    mean = sum(sums.values()) / 8
    assert set(sums) == set(range(8)) and all(abs(s - mean) < 0.02 * mean for s in sums.values())


def test_counts_of_bytes_and_limits(spark):
    rows = [(1, "é 漢"), (2, "word " * 5000), (3, None)]
    got = {r["doc_id"]: r for r in tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["n_bytes"] for k in (1, 2, 3)] == [6, 25_000, 0] and [got[k]["over_limit"] for k in (1, 2, 3)] == [False, True, False]


def test_named_weights_hold(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(4000)], "doc_id long, source string")
    got = mixing.mix_sources(df, weights={"a": 3.0, "b": 1.0}, block_rows=10).collect()
    blocks = {r["slot"]: r["source"] for r in got}
    for n in (40, 100, 200):
        assert abs(sum(blocks[k] == "a" for k in range(n)) - 0.75 * n) < 1
    assert len(got) == 4000 and {r["place"] for r in got} == set(range(10))


def test_packing_nears_best_fit_of_all(spark):
    import random

    rng = random.Random(6)
    for sizes in ([rng.randint(1, 1023) for _ in range(4000)], [600] * 500 + [5] * 40, [400] * 900, [1023] * 50 + [1]):
        df = spark.createDataFrame(list(enumerate(sizes)), "uid long, size long")
        bins = defaultdict(list)
        for r in packing.pack_items(df, 1024).collect():
            bins[r["bin"]].append((r["offset"], sizes[r["uid"]]))
        for places in bins.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= 1024
        assert sum(len(x) for x in bins.values()) == len(sizes)
        assert len(bins) <= 1.02 * len(packing.best_fit(sizes, 1024)) + 2


def test_id_files_open_in_another_process(spark, tmp_path):
    folder, docs = str(tmp_path / "ids"), [(k, f"Document number {k} " * (k % 40 + 1)) for k in range(400)]
    idfiles.write_id_files(spark.createDataFrame(docs, "doc_id long, text string"), folder)
    found = {r["doc_id"]: r["ids"] for r in idfiles.read_documents(spark, folder, [7, 333, 9999]).collect()}
    code = f"""
import sys; sys.path.insert(0, {sys.path[0]!r}); sys.path.insert(0, {str(corpus_pipeline.__file__.rsplit('/', 1)[0])!r})
import glob, numpy as np, pyarrow.parquet as pq
from dossier.llm.idfiles import IdFile
dictionary = pq.read_table(glob.glob({folder!r} + '/dictionary/*.parquet')[0]).column(0)[0].as_py()
for f in glob.glob({folder!r} + '/files/*.parquet'):
    for data in pq.read_table(f).column('file').to_pylist():
        opened = IdFile(data, dictionary)
        for k, d in enumerate(opened.doc_ids):
            if d in (7, 333): print(d, np.frombuffer(opened[k], '<u2').tolist())
        try: IdFile(data, b'another'); print('opened with a wrong dictionary')
        except ValueError: pass
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    lines = sorted(x for x in said.stdout.splitlines() if x)
    assert lines == sorted(f"{d} {found[d]}" for d in (7, 333)) and set(found) == {7, 333}, said.stderr
