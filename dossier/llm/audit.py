"""What each filter removes in every order of application, from counts by failure mask and intervals of permutation ranks."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at the text alone: too short (A), repetitive (B), shouting (C), marked up (D).

    Null counts as empty. Words are runs of other signs than white space, case counts.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, SPACES), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * F.length(F.regexp_replace(whole, "[^A-Z]+", "")).cast("long") > 3 * F.length(whole).cast("long"),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, end): at ``step`` a text that fails the filters of ``mask`` goes, in the orders of ranks start to end.

    Orders are ranked lexicographically. All that begin with the same
    ``step`` filters lie side by side: the first one's rank is its Lehmer code
    in the factorial base, and (k - step)! follow it. A text goes at the
    first filter that it fails, so each beginning that passes until its last
    filter gives one interval. Bit i of a mask stands for filter i.
    """
    found = []
    for mask in range(1, 1 << k):
        for step in range(1, k + 1):
            passed = [f for f in range(k) if not mask >> f & 1]
            for head in permutations(passed, step - 1):
                for last in (f for f in range(k) if mask >> f & 1):
                    start, left = 0, list(range(k))
                    for place, f in enumerate((*head, last)):
                        start += left.index(f) * factorial(k - 1 - place)
                        left.remove(f)
                    found.append((mask, step, start, start + factorial(k - step)))
    return found


def orders(spark: SparkSession, names: str) -> DataFrame:
    """rank, filter_order, step, filter and bit of each step of each order."""
    rows = [(rank, "".join(order), step + 1, f, names.index(f)) for rank, order in enumerate(permutations(names)) for step, f in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, filter string, bit int")


def audit_masks(counts: DataFrame, names: str, measures: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """The audit of all orders from rows (part, mask, n and ``measures``), at most 2 to the number of filters for each part.

    ``names`` has one letter for each filter, at most seven, in alphabetical
    order. Each mask's counts are added where one of its intervals begins and
    taken off where it ends; sums along the ranks then give what goes at each
    step of each order. So a mask costs as many rows as it has intervals, not
    as there are orders, and a part's work is the same for any number of texts.

    Returns part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, <measure>_lost and shapley, zeros included.
    """
    if list(names) != sorted(set(names)) or len(names) > 7:
        raise ValueError("at most seven different letters in alphabetical order")
    spark, k = counts.sparkSession, len(names)
    found = intervals(k)
    # Of constants: k filters alone decide their numbers, 1,842 for five.
    ends = [(m, s, a, 1) for m, s, a, _ in found] + [(m, s, b, -1) for m, s, _, b in found if b < factorial(k)]
    ends = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")
    every, sums = ("n", *measures), ("removed", *[f"{m}_lost" for m in measures])
    steps = counts.where("mask > 0").join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(m) * F.col("sign")).alias(s) for m, s in zip(every, sums, strict=True)])
    # Totals: of a part, and by filter of the texts that fail it and of those that fail nothing else.
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)) for i in range(k)]
    only = [F.sum(F.when(F.col("mask") == (1 << i), F.col("n")).otherwise(0)) for i in range(k)]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*only).alias("only"))
    cells = totals.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) * k - 1))))
    cells = cells.withColumns({"rank": F.floor(F.col("_cell") / k).cast("int"), "step": (F.pmod("_cell", F.lit(k)) + 1).cast("int")}).drop("_cell")
    grid = cells.join(F.broadcast(orders(spark, names)), ["rank", "step"])  # the orders are constants: k! k rows
    along = Window.partitionBy("part", "step").orderBy("rank")
    grid = grid.join(steps, ["part", "step", "rank"], "left").withColumns({s: F.sum(F.coalesce(F.col(s), F.lit(0))).over(along) for s in sums})
    down = Window.partitionBy("part", "rank").orderBy("step")
    grid = grid.withColumn("kept", F.col("total") - F.sum("removed").over(down))
    grid = grid.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    at = F.get("fails", F.col("bit"))
    return grid.select(
        "part",
        "filter_order",
        "step",
        "filter",
        *[c.cast("long").alias(n) for n, c in {"kept": F.col("kept"), "removed": F.col("removed"), "redundant": at - F.col("removed"), "unique_fails": F.get("only", F.col("bit"))}.items()],
        *[F.col(s).cast("long").alias(s) for s in sums[1:]],
        F.col("shapley").cast("long").alias("shapley"),
    )


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good and toxic: how many texts of each part fail just those filters.

    Filter E is failed by a text that equals one of a smaller id anywhere in
    the table. Texts meet by their SHA-256, and equal texts fail the other
    filters alike; of them only the rows with the least id pass. Rows are
    summed by digest and part before they meet, so a text that a third of all
    rows share is a few rows by then.
    """
    label = labels.select(F.col(id_col).alias("_id"), (F.col("quality") == 1).alias("_g"), (F.col("toxic") == 1).alias("_t")).where("_id is not null")
    label = label.groupBy("_id").agg(F.coalesce(F.max("_g"), F.lit(False)).alias("_g"), F.coalesce(F.max("_t"), F.lit(False)).alias("_t"))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(text_failures(F.col(text_col)).values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("_text"),
        mask.alias("mask"),
    )
    rows = rows.join(label, "_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("_g", "_t")})
    alike = ["_text", "mask", "part", "_g", "_t"]
    rows = rows.groupBy("_id", *alike).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n"))).alias("first")
    idless = F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("idless")
    groups = rows.groupBy(*alike).agg(F.sum("n").alias("n"), first, idless)
    least = F.min("first._id").over(Window.partitionBy("_text"))
    fresh = F.col("idless") + F.when(F.col("first._id") == F.col("least"), F.col("first.n")).otherwise(0)
    groups = groups.withColumn("least", least).withColumn("fresh", fresh)
    both = F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    spread = groups.select("part", "_g", "_t", F.inline(both)).where("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return spread.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("_g").alias("good"), count("_t").alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What filters A to E remove in each of their 120 orders, by ``part_col``: see ``audit_masks``.

    Null texts count as empty and equal empty ones, null parts as "". A null
    id is smaller than none and has none smaller; rows of one id and text don't
    make each other fail E. Very long texts are read whole, where they lie;
    only digests are shuffled. An id with several labels is good or toxic if
    one of them says so. An empty table gives no part. Other columns are not
    read, so any names are safe.
    """
    # Written, as two sums read it: at most 32 rows a part.
    return audit_masks(written(failure_masks(docs, labels, id_col, text_col, part_col), "masks", 1), "ABCDE")


#: The same by brute force, each order on its own, for DuckDB.
AUDIT_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
marked AS (SELECT part, coalesce(l.good, FALSE) AS good, coalesce(l.bad, FALSE) AS bad,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM words LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1) l ON l.doc_id = words.doc_id),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS b FROM marked GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
met AS (SELECT part, filter_order, step, filter, n, g, b, contains(fails, filter) AS hit, fails = filter AS alone,
    len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM masks, steps),
sums AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails, coalesce(sum(g) FILTER (WHERE hit AND NOT gone), 0) AS good_lost,
    coalesce(sum(b) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost FROM met GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM sums
"""
