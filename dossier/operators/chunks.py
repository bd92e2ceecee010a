"""Documents cut into ordered chunks: at page marks and images, or at heading paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .shared import spread_by

#: A mark of a place, or the link of a page's image (fixed pattern).
MARK = r'(?d)<span id="([^"]+)"></span>|!\[.*?\]\(([^)]*?_page_(\d+)_Figure_\d+\.jpeg)\)'


def _numbered(chunks: DataFrame, id_col: str) -> DataFrame:
    """Chunks with text, counted from 1 in each document, and the name of each one's file."""
    order = Window.partitionBy(id_col).orderBy("pos", "sub")
    safe = F.regexp_replace("name", r"[^\p{L}\p{N}_-]", "_")
    number = F.row_number().over(order)
    return (
        chunks.withColumn("content", strip(F.col("content")))
        .where("content <> ''")
        .withColumn("chunk", number)
        .select(id_col, "chunk", "kind", "name", F.format_string("%04d_%s_%s.txt", "chunk", "kind", safe).alias("file"), "content")
    )


def ordered_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, chunk, kind, name, file and content of each chunk of each text.

    A text is cut at MARK. The text before the first mark is the header; a text
    without marks has no chunk. A page's mark names its text ``pageN-k``, k
    counted for each page, blank ones included. An image is a chunk, and text
    after it is the next k of the page seen last, or dropped before any page.
    One text's marks are numbered in windows by text and page.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = lambda k: F.regexp_extract_all(text, F.lit(MARK), F.lit(k))
    found = spread_by(df.select(id_col, text_col), id_col).select(F.col(id_col), group(1).alias("_span"), group(2).alias("_image"), F.split(text, MARK).alias("_texts")).where(F.size("_span") > 0)
    marks = found.select(
        id_col, "_texts", F.posexplode(F.arrays_zip(F.array_insert("_span", 1, F.lit("")).alias("span"), F.array_insert("_image", 1, F.lit("")).alias("image"))).alias("pos", "m")
    ).select(id_col, "pos", "m.span", "m.image", F.get("_texts", F.col("pos")).alias("text"))
    page = F.when(F.col("span").rlike(r"^page\p{Nd}+$"), F.regexp_replace(F.substr("span", F.lit(5)), r"^0+(?=\d)", ""))
    before = Window.partitionBy(id_col).orderBy("pos")
    marks = marks.withColumn("page", page).withColumn("seen", F.last("page", ignorenulls=True).over(before))
    # Marks that advance their page's count: the page's own, and images after it.
    counts = F.col("page").isNotNull() | ((F.col("image") != "") & F.col("seen").isNotNull())
    k = F.sum(counts.cast("int")).over(Window.partitionBy(id_col, "seen").orderBy("pos"))
    paged = F.concat(F.lit("page"), "seen", F.lit("-"), k.cast("string"))
    name = F.when(F.col("pos") == 0, F.lit("header")).when(counts, paged).when(F.col("span") != "", F.col("span"))
    stem = F.regexp_extract("image", r"([^/]*)\.jpeg$", 1)
    link = F.struct(F.lit(0).alias("sub"), F.lit("img").alias("kind"), stem.alias("name"), F.concat(F.lit("![]("), "image", F.lit(")")).alias("content"))
    body = F.struct(F.lit(1).alias("sub"), F.lit("span").alias("kind"), F.col("_name").alias("name"), F.col("text").alias("content"))
    rows = F.filter(F.array(F.when(F.col("image") != "", link), F.when(F.col("_name").isNotNull(), body)), lambda x: x.isNotNull())
    return _numbered(marks.withColumn("_name", name).select(id_col, "pos", F.explode(rows).alias("c")).select(id_col, "pos", "c.*"), id_col)


def heading_chunks(paragraphs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, chunk, kind, name, file and content from rows (``id_col``, pos, style, text, image).

    A paragraph of style ``Heading n`` with text starts a chunk named
    ``hn_text`` and stands in it with n marks before it. An image is a chunk of
    its own and ends the open one; text after it starts another of the same
    name. Text before all headings is named ``start``. Paragraphs of a chunk
    are joined by blank lines.
    """
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    rows = spread_by(paragraphs, id_col).select(id_col, "pos", F.coalesce("style", F.lit("")).alias("style"), text.alias("text"), F.coalesce("image", F.lit("")).alias("image"))
    level = F.regexp_extract("style", r"^Heading (\d+)", 1)
    heads = (level != "") & (F.col("text") != "")
    title = F.when(heads, F.concat(F.lit("h"), level, F.lit("_"), "text"))
    shown = F.when(heads, F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "), "text")).otherwise(F.col("text"))
    # An image comes before the text of its paragraph; a heading's image is passed over.
    items = F.filter(
        F.array(
            F.when((F.col("image") != "") & ~heads, F.struct(F.lit(0).alias("sub"), F.lit(True).alias("is_image"), F.lit(True).alias("starts"), F.concat(F.lit("![]("), "image", F.lit(")")).alias("content"), F.concat(F.lit("img_"), "image").alias("title"))),
            F.when(F.col("text") != "", F.struct(F.lit(1).alias("sub"), F.lit(False).alias("is_image"), heads.alias("starts"), shown.alias("content"), title.alias("title"))),
        ),
        lambda x: x.isNotNull(),
    )
    order = Window.partitionBy(id_col).orderBy("pos", "sub")
    flat = rows.select(id_col, "pos", F.explode(items).alias("i")).select(id_col, "pos", "i.*")
    after_image = F.coalesce(F.lag("is_image").over(order), F.lit(False))
    flat = flat.withColumn("starts", F.col("starts") | after_image).withColumn("part", F.sum(F.col("starts").cast("int")).over(order))
    heading = F.last(F.when(~F.col("is_image"), F.col("title")), ignorenulls=True).over(order)
    flat = flat.withColumn("heading", F.coalesce(heading, F.lit("start")))
    parts = flat.groupBy(id_col, "part").agg(
        F.min("pos").alias("pos"),
        F.min("sub").alias("sub"),
        F.bool_or("is_image").alias("is_image"),
        F.max("title").alias("image"),
        F.min_by("heading", F.struct("pos", "sub")).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "content"))), lambda x: x["content"]), "\n\n").alias("content"),
    )
    kind: Column = F.when(F.col("is_image"), "img").otherwise("span")
    name = F.when(F.col("is_image"), F.col("image")).otherwise(F.col("heading"))
    return _numbered(parts.withColumns({"kind": kind, "name": name}), id_col)


def slide_chunks(slides: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One chunk for each slide, from rows (``id_col``, slide, pos, text, image): a title line, then texts and images in order."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    image = F.when(F.coalesce(F.col("image"), F.lit("")) != "", F.concat(F.lit("![]("), "image", F.lit(")")))
    lines = F.filter(F.array(F.when(text != "", text), image), lambda x: x.isNotNull())
    parts = slides.select(id_col, "slide", "pos", lines.alias("lines")).groupBy(id_col, "slide")
    texts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lines"))), lambda x: x["lines"]))
    title = F.concat(F.lit("## Slide "), F.col("slide").cast("string"))
    found = parts.agg(texts.alias("texts")).select(
        id_col,
        F.col("slide").alias("pos"),
        F.lit(0).alias("sub"),
        F.lit("span").alias("kind"),
        F.concat(F.lit("slide_"), F.col("slide").cast("string")).alias("name"),
        F.array_join(F.concat(F.array(title), "texts"), "\n\n").alias("content"),
    )
    return _numbered(found, id_col)
