import corpus_pipeline


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}


def test_sequences_keep_the_mixture(spark):
    from collections import Counter, defaultdict

    from dossier.llm.mixing import mix_sources
    from dossier.llm.packing import pack_mixture

    rows = [(k, f"word{k} " * (1 + k % 37) + "long text " * (1500 * (k % 400 == 3)), "abc"[min(2, k % 7)]) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = {r["doc_id"]: r for r in mix_sources(df).collect()}
    packed = corpus_pipeline.pack(spark, df, "").collect()
    assert {r["doc_id"] for r in packed} == set(mixed)
    small = pack_mixture(df, range_slots=4).collect()
    for got, size in ((packed, 64), (small, 4)):
        held = defaultdict(list)
        for r in got:
            held[r["sequence_id"]].append(r)
        order = []
        for sequence in sorted(held):
            at = 0
            for r in sorted(held[sequence], key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 1024
            order.append({mixed[r["doc_id"]]["slot"] // size for r in held[sequence]})
        assert all(len(ranges) == 1 for ranges in order)
        assert [min(x) for x in order] == sorted(min(x) for x in order)
    # Prefixes of sequences: every source within a block of its weight, until one runs out.
    weights = {r["source"]: r["weight"] for r in mixed.values()}
    blocks = {r["slot"]: r["source"] for r in mixed.values()}
    left, total = Counter(blocks.values()), sum(weights.values())
    seen, ends = set(), 0
    for slot in sorted({x["slot"] // 4 for x in mixed.values()}):
        seen |= {(mixed[r["doc_id"]]["source"], mixed[r["doc_id"]]["block"]) for r in small if mixed[r["doc_id"]]["slot"] // 4 == slot and r["sequence_id"] >> 32 == slot}
        done = Counter(s for s, _ in seen)
        if any(done[s] >= left[s] for s in left):
            break
        ends += 1
        assert all(abs(done[s] - 4 * (slot + 1) * w / total) < 1 for s, w in weights.items())
    assert ends > 2


def test_what_ranges_leave_underfull_is_handed_on(spark):
    from collections import defaultdict

    from dossier.llm.mixing import mix_sources
    from dossier.llm.packing import RANGE_SLOTS, pack_mixture

    rows = [(k, f"word{k} " * (1 + k % 37) + "long text " * (1500 * (k % 999 == 3)), "abc"[min(2, k % 7)]) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ranges = {r["doc_id"]: r["slot"] // RANGE_SLOTS for r in mix_sources(df).collect()}
    assert len(set(ranges.values())) > 4
    sizes, held = [], defaultdict(list)
    for packed in (pack_mixture(df, range_slots=RANGE_SLOTS).collect(), corpus_pipeline.pack(spark, df, "").collect()):
        held.clear()
        for r in packed:
            held[r["sequence_id"]].append(r)
        sizes.append(len(held))
    assert len(packed) == len({(r["doc_id"], r["piece"]) for r in packed}) and {r["doc_id"] for r in packed} == set(ranges)
    least = -(-sum(r["length"] for r in packed) // 1024)
    assert least <= sizes[1] <= least + 1 < sizes[0]  # before: a sequence more for each range
    for sequence, members in held.items():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and sequence >> 32 == min(ranges[r["doc_id"]] for r in members)


def test_one_row_of_each_group_stays(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (2, "a b c"), (3, near), (3, near + " end"), (4, near), (5, "d e f"), (6, "x y z"), (None, "x y z")]
    out = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"][:5]) for r in out) == [(0, "x y z"), (1, "a b c"), (1, "d e f"), (3, near[:5]), (6, "x y z")]


def test_results_of_a_stage_outlast_the_next_call(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for sf_dir in ("", "/root/testdata/sf0.001"):
        one, two = corpus_pipeline.keep_good(spark, docs, sf_dir), corpus_pipeline.keep_good(spark, docs, sf_dir)
        assert one.count() == two.count() > 0
    one, two = (corpus_pipeline.keep_one_of_each_group(spark, docs, "") for _ in range(2))
    assert one.count() == two.count() > 0


def test_the_order_of_the_mixing_stage_reaches_the_sequences(spark, tmp_path, monkeypatch):
    from collections import defaultdict

    from dossier.llm import packing
    from dossier.llm.mixing import mix_sources

    rows = [(k, f"word{k} " * (1 + k % 300), "abc"[min(2, k % 7)]) for k in range(5000)] + [(None, "x", None), (7, "again", "a"), (7, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = {r["doc_id"]: (r["slot"], r["place"]) for r in mix_sources(df).collect()}
    # Files of a few rows each, small ones read by the same task.
    corpus_pipeline.mix(spark, df, "").write.option("maxRecordsPerFile", 700).parquet(str(tmp_path / "mixed"))
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    assert docs.columns == df.columns and docs.count() == len(rows)
    mixed_again = []
    monkeypatch.setattr(packing, "mix_sources", lambda *a, **b: mixed_again.append(1) or mix_sources(*a, **b))
    packed = packing.pack_mixture(docs, range_slots=2).collect()
    assert not mixed_again  # before: the stage's order was dropped, and found again here
    held = defaultdict(list)
    for r in packed:
        if r["doc_id"] not in (None, 7):
            held[r["sequence_id"] >> 32].append(order[r["doc_id"]])
    assert len(held) > 50 and {r["doc_id"] for r in packed} == set(order)
    places = [(min(held[k]), max(held[k])) for k in sorted(held)]
    assert all(one[1] < two[0] for one, two in zip(places, places[1:], strict=False))
    # What doesn't come straight from the files is mixed here.
    assert packing.pack_mixture(docs.groupBy("doc_id", "source").agg({"text": "max"}).withColumnRenamed("max(text)", "text")).count() and mixed_again
