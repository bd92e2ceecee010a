import re

import numpy as np
import pytest
from pyspark.sql import Row

from dossier.llm.jaccard import jaccard_components, prefix_length, signature


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def answer(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, **more).collect()}


def near_texts():
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):  # a chain: neighbours are near, the ends are not
        rows.append((k, " ".join(words[k : k + 60])))
    for k in range(40):  # copies with one word changed each
        rows.append((100 + k, " ".join(words[:k] + ["X"] + words[k + 1 :])))
    rows += [(200, "A b C"), (201, "a B c"), (202, "a b"), (203, ""), (204, None), (205, "Ünder ünder"), (206, "ünder ünder")]
    rows += [(300, "w " * 20_000), (301, "w w w w w"), (302, " ".join(words).upper())]
    return rows


@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_equals_brute_force(spark, chunk):
    rows = near_texts()
    assert answer(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk) == brute(rows)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert answer(df) == brute(rows)


def test_empty_null_and_clashing_columns(spark):
    assert answer(spark.createDataFrame([], "doc_id long, text string")) == {}
    df = spark.createDataFrame([Row(doc_id=1, text="a b", component_id=9, token=1, n=2), Row(doc_id=None, text="a b", component_id=9, token=1, n=2)])
    assert answer(df) == {1: (1, 1), None: (1, None)}


def test_prefix_covers_every_overlap():
    for n in range(1, 300):
        assert n - prefix_length(n, 80) < 0.8 * n


def test_signatures_differ_by_no_more_than_the_sets():
    random = np.random.default_rng(3)
    for n in (1, 20, 300, 3000):
        a = np.unique(random.integers(0, 1 << 54, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 4 :], random.integers(0, 1 << 54, n // 5).astype(np.uint64)]))
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(signature(a), signature(b), strict=True))
        assert bits <= len(np.setxor1d(a, b))
