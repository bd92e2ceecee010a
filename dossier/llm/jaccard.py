"""Texts joined by the Jaccard similarity of their word n-grams, by prefixes under several orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import TASK_EDGES, connected
from .encoders import Memory, lasting
from .store import forget, written

#: n-grams that a chunk of texts, and a range of n-gram hashes, hold at about.
CHUNK = 1 << 20
#: The orders: a seed, and whether n-grams go by how many texts have them before they go by the seed's hash.
ORDERS = ((0x9E3779B97F4A7C15, True), (0xC2B2AE3D27D4EB4F, True), (0x165667B19E3779F9, False))
#: Rounds in which each text is compared with one other of its buckets, at most; they
#: end when one adds less than this share of the links found so far.
ROUNDS, GAIN = 8, 0.02
LOW = 48
#: Bytes of words remembered with their hashes, which are quickly made again.
WORDS = 12_000_000
#: Words of 64 bits in a text's signature.
SIGNATURE = 8

UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit integers."""
    values = values ^ np.uint64(seed)
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


class Shingler:
    """Sorted hashes of a text's distinct n-grams of words, A-Z in lower case."""

    def __init__(self, n: int):
        self.n, self.hashes = n, Memory(xxhash.xxh3_64_intdigest, WORDS)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        values = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(values))
        total = np.full(len(values) - width + 1, width, np.uint64)
        for k in range(width):
            total = mixed(total + values[k : k + len(total)], k)
        return np.unique(total)


def shingler(n: int) -> Shingler:
    """One in each Python worker, from task to task."""
    return lasting(("shingles", n), lambda: Shingler(n))


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which a set of ``n`` shares one with any set at ``percent`` or more, in any order."""
    return n - (percent * n + 99) // 100 + 1


def signature(tokens: np.ndarray) -> list[int]:
    """For each of 512 bits, whether an odd number of tokens falls on it.

    Two sets' signatures differ in at most as many bits as there are tokens in one set alone.
    """
    at = (mixed(tokens, 0x27D4EB2F165667C5) & np.uint64(64 * SIGNATURE - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * SIGNATURE) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8").tolist()


#: What a chunk knows of each of its texts: id, whether it has one, n-grams, tokens in the chunk, fingerprint.
TEXTS = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<i8"), ("size", "<i8"), ("f1", "<i8"), ("f2", "<i8")])


def _chunks(docs: DataFrame, n: int, bits: int, chunk: int) -> DataFrame:
    """Rows (part, chunk, tokens, counts, texts): a chunk's distinct tokens by range of hashes.

    A row with a negative part is the chunk's own: its texts, and those of its
    tokens that several of them have, each with its text, in token order.
    Texts come in the order in which ``docs`` is read.
    """
    schema = "part long, chunk long, tokens binary, counts binary, texts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, number = shingler(n), TaskContext.get().partitionId() << 32
        texts: list[tuple] = []
        sets: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            own = np.array(texts, TEXTS)
            tokens = np.concatenate(sets) >> np.uint64(64 - LOW - bits)
            owner = np.repeat(np.arange(len(sets), dtype="<u2"), own["size"])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.flatnonzero(np.concatenate([[len(tokens) > 0], tokens[1:] != tokens[:-1]]))
            times = np.diff(np.append(first, len(tokens)))
            once = tokens[first]
            part = (once >> np.uint64(LOW)).astype(np.int64)
            edges = np.searchsorted(part, np.arange((1 << bits) + 1))
            low = once.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            # Whatever occurs in several texts of the chunk stays here with its owners; alone are sent to count.
            again = np.repeat(times > 1, times)
            rows = [(-1 - number, number, tokens[again].astype("<u8").tobytes(), owner[again].tobytes(), own.tobytes())]
            alone = np.where(times > 1, 0xFFFF, owner[first]).astype("<u2")
            several = times.astype("<u4")
            for k in range(1 << bits):
                a, b = edges[k], edges[k + 1]
                if a < b:
                    more = several[a:b][times[a:b] > 1]
                    rows.append((k, number, low[a:b].tobytes(), alone[a:b].tobytes() + more.tobytes(), None))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = zip(zip(*rows, strict=True), kinds, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["part", "chunk", "tokens", "counts", "texts"])

        none = np.empty(0, np.uint64)
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingles(text)
                raw = found.tobytes()
                marks = [xxhash.xxh3_64_intdigest(raw, k) - (1 << 63) for k in (1, 2)]
                known = doc is not None
                sets.append(found if known else none)
                texts.append((doc or 0, known, len(found), len(sets[-1]), *marks))
                held += len(sets[-1])
                if held >= chunk or len(texts) >= 60_000:
                    yield closed()
                    texts.clear(), sets.clear()
                    held, number = 0, number + 1
        if texts:
            yield closed()

    return docs.mapInArrow(run, schema)


def _shared(table: pa.Table) -> pa.Table:
    """Of one range: for each chunk its tokens that more than one text has, their owners and counts."""
    parts, chunks = table.column("part").to_pylist(), table.column("chunk").to_pylist()
    tokens, counts = table.column("tokens").to_pylist(), table.column("counts").to_pylist()
    names = ["own", "chunk", "tokens", "owners", "counts", "texts"]
    kinds = [pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    if parts[0] < 0:
        rows = [(True, c, t, o, b"", x) for c, t, o, x in zip(chunks, tokens, counts, table.column("texts").to_pylist(), strict=True)]
    else:
        low, owner, times = [], [], []
        for raw, rest in zip(tokens, counts, strict=True):
            size = len(raw) // 6
            wide = np.zeros((size, 8), np.uint8)
            wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            low.append(wide.view("<u8").ravel())
            who = np.frombuffer(rest[: 2 * size], "<u2")
            many = np.ones(size, np.int64)
            many[who == 0xFFFF] = np.frombuffer(rest[2 * size :], "<u4")
            owner.append(who)
            times.append(many)
        sizes = [len(x) for x in low]
        whole, weight = np.concatenate(low), np.concatenate(times)
        order = np.argsort(whole, kind="stable")
        ranked = whole[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = np.add.reduceat(weight[order], first)
        df = np.empty(len(whole), np.int64)
        df[order] = np.repeat(sums, np.diff(np.append(first, len(whole))))
        rows, at = [], 0
        for c, x, who, size in zip(chunks, low, owner, sizes, strict=True):
            mine = df[at : at + size]
            at += size
            keep = mine > 1
            if keep.any():
                full = x[keep] | np.uint64(parts[0] << LOW)
                rows.append((False, c, full.tobytes(), who[keep].tobytes(), np.minimum(mine[keep], 0xFFFFFFFF).astype("<u4").tobytes(), None))
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


GROUPS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("linked", T.BooleanType()),
        *[T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")],
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("at", T.ArrayType(T.IntegerType())),
    ]
)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk a row for each of its distinct sets: ids, least first, and places of the texts that have it."""
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(raw, TEXTS)
            order = np.lexsort((np.arange(len(own)), own["id"], own["f2"], own["f1"], own["n"], own["known"]))
            own = own[order]
            new = [True] * bool(len(own))
            same = np.ones(max(0, len(own) - 1), bool)
            for c in ("known", "n", "f1", "f2"):
                same &= own[c][1:] == own[c][:-1]
            first = np.flatnonzero(np.concatenate([new, ~same]))
            offsets = pa.array(np.append(first, len(own)), pa.int32())
            ids = pa.array(own["id"], pa.int64(), mask=own["known"] == 0)
            head = own[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * len(first), pa.int64()),
                    pa.array((head["known"] == 1) & (head["n"] > 0)),
                    *[pa.array(head[c]) for c in ("n", "f1", "f2")],
                    pa.ListArray.from_arrays(offsets, ids),
                    pa.ListArray.from_arrays(offsets, pa.array(order, pa.int32())),
                ],
                names=GROUPS.names,
            )


SETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("shared", T.LongType()),
        T.StructField("signature", T.ArrayType(T.LongType())),
        T.StructField("tokens", T.BinaryType()),
        *[T.StructField(f"prefix{k}", T.BinaryType() if k else T.ArrayType(T.LongType())) for k in range(len(ORDERS))],
    ]
)


def _prefixes(percent: int):
    def run(table: pa.Table, stays: pa.Table) -> pa.Table:
        """Of one chunk: of its texts that stay, those that have shared tokens in their prefixes."""
        found = []
        names = ("own", "tokens", "owners", "counts", "texts")
        for mine, tokens, owners, counts, raw in zip(*(table.column(c).to_pylist() for c in names), strict=True):
            if mine:
                own, tokens_here, owner_here = np.frombuffer(raw, TEXTS), np.frombuffer(tokens, "<u8"), np.frombuffer(owners, "<u2")
            else:
                found.append((np.frombuffer(tokens, "<u8"), np.frombuffer(owners, "<u2"), np.frombuffer(counts, "<u4")))
        places = stays.column("at").to_pylist()
        rows = []
        if found and places:
            shared, who, df = (np.concatenate(x) for x in zip(*found, strict=True))
            several = who == 0xFFFF
            order = np.argsort(shared[several])
            counted, times = shared[several][order], df[several][order]
            # Tokens kept at home learn how many texts have them.
            here = times[np.searchsorted(counted, tokens_here)] if len(tokens_here) else np.empty(0, np.uint32)
            alone = ~several
            tokens, owner, df = np.concatenate([tokens_here, shared[alone]]), np.concatenate([owner_here, who[alone]]), np.concatenate([here, df[alone]])
            order = np.lexsort((tokens, owner))
            tokens, owner, df = tokens[order], owner[order], df[order]
            edges = np.searchsorted(owner, np.arange(len(own) + 1))
            for k in places[0]:
                a, b, n = edges[k], edges[k + 1], int(own["n"][k])
                length = prefix_length(n, percent) - (n - (b - a))  # tokens of one text come first
                if length <= 0:
                    continue
                mine, times = tokens[a:b], df[a:b]
                prefixes = []
                for seed, by_count in ORDERS:
                    by_hash = mixed(mine, seed)
                    order = np.lexsort((by_hash, times)) if by_count else np.argsort(by_hash)
                    prefixes.append(mine[order[:length]])
                rows.append((int(own["id"][k]), n, len(mine), signature(mine), mine.tobytes(), prefixes[0].astype("<i8").tolist(), *[np.sort(p).tobytes() for p in prefixes[1:]]))
        columns = list(zip(*rows, strict=True)) or [()] * (5 + len(ORDERS))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * (len(ORDERS) - 1)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=SETS.names)

    return run


def _values(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit integers in each of a column's binaries, without copies."""
    wide = pa.types.is_large_binary(column.type)
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).tolist()
    # Values of 8 bytes each: where the first begins at a multiple of 8, so do all.
    if data is None:
        return [np.empty(0, "<u8")] * len(column)
    start = edges[0] % 8
    whole = np.frombuffer(data, "<u8", (len(data) - start) // 8, start)
    return [whole[(a - start) // 8 : (b - start) // 8] for a, b in zip(edges, edges[1:])]


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share tokens in the prefixes of every order and are similar enough."""
    columns = ["n", "tokens", *[f"prefix{k}" for k in range(1, len(ORDERS))]]
    sides = pairs
    for end in ("a", "b"):
        sides = sides.join(sets.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)

    def common(x: np.ndarray, y: np.ndarray) -> int:
        """Values in both of two sorted sets."""
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        return int((y[at] == x).sum()) if len(y) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            most = {c: get[c].to_numpy() for c in ("n_a", "n_b")}
            keep = np.ones(batch.num_rows, bool)
            for k in range(1, len(ORDERS)):
                left, right = _values(get[f"prefix{k}_a"]), _values(get[f"prefix{k}_b"])
                for i in np.flatnonzero(keep):
                    keep[i] = common(left[i], right[i]) > 0
            left, right = _values(get["tokens_a"]), _values(get["tokens_b"])
            for i in np.flatnonzero(keep):
                both = common(left[i], right[i])
                keep[i] = 100 * both >= percent * (int(most["n_a"][i]) + int(most["n_b"][i]) - both)
            yield pa.RecordBatch.from_arrays([get[c].filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return sides.mapInArrow(run, "a long, b long")


def _rooted(keys: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``keys`` with the root of each text's component; without roots, the text itself."""
    if roots is None:
        return keys.withColumn("root", F.col("id"))
    return keys.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, chunk: int = CHUNK
) -> DataFrame:
    """``id_col``, n_shingles, component_id and kept of every text.

    Two texts link when the Jaccard similarity of their sets of ``n`` words in
    a row is at least ``percent``; a component is all that links reach, named
    by its least id.

    Texts with equal sets become one class at once. Tokens that one class alone
    has can't be shared, so they are counted and left out; the others are sorted
    by how many classes have them, then in each of ORDERS by a hash of its own.
    Two similar sets share a token in their prefixes under every order: the
    first order finds candidates, the others sift them, and what is left is
    compared exactly. Since components are asked for, texts are first compared
    with one other text each, in rounds, and joined; then every pair of
    candidates that is still in two components is compared. A group of copies
    so costs its size, not its square, and no pair is left out. Of those last
    pairs, only such are sent to be compared whose sizes, the place of a shared
    token in both orders and signatures of 512 bits allow enough shared tokens:
    bounds that no linked pair exceeds.

    Frequent tokens are summed in their chunk of texts first, so a range of
    hashes holds one entry for each chunk at most. Tokens are hashes of 48 bits
    and as many more as there are binary digits in the number of ranges.

    A text without words, or null, has no tokens and is its own component. A
    null id is kept with its size and a null component and links with nothing.
    Rows with one id and different texts each count as texts of that id; they
    share its component. An empty table gives an empty one.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Only how finely tokens are dealt out depends on this: a word and the space after it are six signs or so.
    words = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6
    bits = max(6, int(np.ceil(np.log2(max(1, words / (2 * chunk))))))
    columns = "own boolean, chunk long, tokens binary, owners binary, counts binary, texts binary"
    ranges = written(_chunks(docs, n, bits, chunk).groupBy("part").applyInArrow(_shared, columns), "ranges")
    # Copies in one chunk are one row from here on, so those of one text are as many rows as chunks at most.
    groups = written(ranges.where("own").select("chunk", "texts").mapInArrow(_groups, GROUPS), "groups")
    whole = groups.where("linked")
    firsts = whole.select("n", "f1", "f2", F.struct(F.get("ids", F.lit(0)).alias("id"), "chunk", F.get("at", F.lit(0)).alias("at")).alias("rep"))
    classes = written(firsts.groupBy("n", "f1", "f2").agg(F.min("rep").alias("rep")), "classes")
    stays = classes.groupBy("rep.chunk").agg(F.collect_list("rep.at").alias("at"))
    sets = ranges.groupBy("chunk").cogroup(stays.groupBy("chunk")).applyInArrow(_prefixes(percent), SETS)
    sets = written(sets, "sets")
    forget(ranges)

    # Tokens of one text come first in its order, so they count in a token's place.
    keys = sets.select("id", "n", "shared", F.posexplode("prefix0").alias("rank", "token"))
    keys = keys.select("id", "n", "token", (F.col("n") - F.col("shared") + F.col("rank")).alias("place"))
    # What was summed is written before it is joined: only then can Spark split a token that very many texts have.
    several = written(keys.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token"), "several")
    keys = written(keys.join(several, "token"), "keys")
    forget(several)

    def near(n: Column, place: Column, m: Column, other: Column) -> Column:
        """Whether the token can be the first that two similar sets of these sizes share."""
        alike = F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
        return alike & (F.lit(100 + percent) * F.least(n - place, m - other) >= F.lit(percent) * (n + m))

    links = roots = None
    for turn in range(ROUNDS):
        now = _rooted(keys, roots)
        pivot = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("by"), "id", "n", "place", "root")).alias("pivot")
        open_ = now.groupBy("token").agg(pivot, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        open_ = written(open_.select("token", "pivot"), "open")
        met = now.join(open_, "token").where(
            (F.col("root") != F.col("pivot.root")) & near(F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place"))
        )
        pairs = met.groupBy("id").agg(F.min("pivot").alias("pivot")).select(F.col("id").alias("a"), F.col("pivot.id").alias("b"))
        found = written(_linked(pairs, sets, percent), "links")
        gained = found.count()
        forget(open_)
        links = links.union(found) if links is not None else found
        total = links.count()
        if gained:
            last, roots = roots, written(connected(links).toDF("id", "root"), "reached", total // TASK_EDGES + 1)
            forget(last)
        if gained <= GAIN * total:
            break

    # What is left: all pairs in two components that share a token, exact bounds first.
    now = _rooted(keys, roots)
    by_root = now.groupBy("token", "root").agg(F.count("*").alias("times"))
    open_ = by_root.groupBy("token").agg(F.max_by("root", "times").alias("major"), F.count("*").alias("roots")).where("roots > 1")
    open_ = written(open_.select("token", "major"), "open")
    words = [F.get("signature", F.lit(k)).alias(f"s{k}") for k in range(SIGNATURE)]
    left = written(now.join(open_, "token").join(sets.select("id", "shared", *words), "id"), "left")
    # Of two texts in two components, one at least is not in the token's largest.
    minor = left.where("root <> major")
    right = left.select(*[F.col(c).alias(c if c == "token" else f"{c}_2") for c in left.columns])
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}_2"))) for k in range(SIGNATURE)), F.lit(0))
    enough = F.lit(100 + percent) * (F.col("shared") + F.col("shared_2") - differ) >= F.lit(2 * percent) * (F.col("n") + F.col("n_2"))
    once = (F.col("root_2") == F.col("major_2")) | (F.col("id") < F.col("id_2"))
    met = minor.join(right, "token").where(
        (F.col("root") != F.col("root_2")) & once & near(F.col("n"), F.col("place"), F.col("n_2"), F.col("place_2")) & enough
    )
    pairs = met.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()
    links = links.union(written(_linked(pairs, sets, percent), "links"))
    # Copies link with their class here, and rows of one id through that id.
    same = whole.join(classes, ["n", "f1", "f2"]).select(F.explode("ids").alias("a"), F.col("rep.id").alias("b"))
    roots = written(connected(links.union(same)).toDF("id", "root"), "components")
    forget(sets, keys, open_, left, classes)
    component = F.coalesce("root", "id")
    return groups.select("n", F.explode("ids").alias("id")).join(roots, "id", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
