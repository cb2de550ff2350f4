"""Page streams over the driver's tables, and scans of page files.

A page stream has bundle_id, page_index (0-based, gapless in a bundle) and what
is known of the page.  The total orders make the numbering deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


#: Low bits of the document ids of one range.
DOCUMENT_BITS = 12
#: Stored bytes of texts for each task that sorts them.
TASK_BYTES = 8 << 20
#: Stored bytes of texts for each task that sorts their words.
WORD_BYTES = 2 << 20
#: Stored bytes of short texts that grow in the tasks.
NAME_BYTES = 128 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle is a customer's line items; each order in it is a document. Some numbers and totals are hidden.

    One shuffle by bundle, into more tasks for larger tables, serves all windows here and those over bundles that
    follow: an order belongs to one customer.  Numbers within orders go by the bundles' sort, as its first column is the order.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("bundle_id"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).repartition(_tasks(lines), "bundle_id")
    bundle = Window.partitionBy("bundle_id").orderBy(*LINE_ORDER)
    document = Window.partitionBy("bundle_id", "l_orderkey")
    shown = F.col("l_partkey") % 5 != 0
    numbered = rows.withColumns({"page_index": (F.row_number().over(bundle) - 1).cast("int"), "num": F.row_number().over(document.orderBy(*LINE_ORDER[1:])), "total": F.count("*").over(document)})
    return numbered.select(
        "bundle_id",
        "page_index",
        F.when(shown, F.col("num")).cast("int").alias("page_num"),
        F.when(shown & (F.col("l_suppkey") % 3 != 0), F.col("total")).cast("int").alias("page_total"),
        F.when(F.col("l_returnflag") == "A", 595.0).otherwise(612.0).alias("width"),
        F.lit(792.0).alias("height"),
        F.lit(0).alias("rotation"),
        F.col("l_orderkey").alias("gold_id"),
        (F.col("num") == 1).alias("gold_start"),
    )


def deal_bundles(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Order pages by bundle again, into as many tasks, after a step that Spark can't see through."""
    return pages.repartition(_tasks(table(spark, sf_dir, "lineitem")), "bundle_id")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle is a source, a page one document.

    Pages are numbered within ranges of ids, behind those of the ranges before, so that no task sorts a whole source's texts.
    """
    docs = table(spark, sf_dir, "documents")
    place = F.struct(F.col("source").alias("bundle_id"), F.shiftright(F.col("doc_id").cast("long"), DOCUMENT_BITS).alias("part")).alias("place")
    counts = docs.groupBy(place).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("place.bundle_id").orderBy("place.part")) - F.col("n")
    # One exchange of the texts, into more tasks for larger tables, serves the windows and the join.
    dealt = docs.select(place, "doc_id", "text", "lang").repartition(_tasks(docs), "place")
    within = dealt.withColumn("within", F.row_number().over(Window.partitionBy("place").orderBy("doc_id")))
    placed = within.join(counts.select("place", before.alias("first")), "place")
    return placed.select("place.bundle_id", (F.col("first") + F.col("within") - 1).cast("int").alias("page_index"), "doc_id", "text", "lang")


def document_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of an exchange of the documents' texts, to be cut into words."""
    return _tasks(table(spark, sf_dir, "documents"), WORD_BYTES)


def _tasks(df: DataFrame, each: int = TASK_BYTES) -> int:
    """Tasks of an exchange of whole rows: by the optimizer's size (stored bytes, for files)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 14, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // each))


def spread(df: DataFrame, each: int = TASK_BYTES) -> DataFrame:
    """The rows dealt evenly into tasks of some ``each`` stored bytes, however few files and row groups hold them."""
    return df.repartition(_tasks(df, each))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle is a conversation, a page one turn, between lines that repeat: a head, and a numbered foot."""
    turns = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("string").alias("bundle_id"), (F.row_number().over(order) - 1).cast("int").alias("page_index"), "role", "text")
    return rows.withColumn("total", F.count("*").over(Window.partitionBy("bundle_id")).cast("int"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of the html pages: a bundle is a host; kinds come from the tags."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("bundle_id"), "html")
    order = Window.partitionBy("bundle_id").orderBy("page_id")
    numbered = pages.withColumn("page_index", (F.row_number().over(order) - 1).cast("int"))
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:title|h1|h2|h3|p|li|footer)[^>]*>.*?</(?:title|h1|h2|h3|p|li|footer)>)"), F.lit(1))
    each = numbered.select("bundle_id", "page_index", F.posexplode(found).alias("reading_order", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"(?i)^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    kind = F.when(tag == "title", "title").when(tag.isin("h1", "h2", "h3"), "heading").when(tag == "li", "list_item").when(tag == "footer", "footer").otherwise("paragraph")
    level = F.when(tag == "title", 0).when(tag.isin("h1", "h2", "h3"), F.substring(tag, 2, 1).try_cast("int"))
    blocks = each.select("bundle_id", "page_index", "reading_order", kind.alias("kind"), level.alias("heading_level"), text.alias("text")).where("text <> ''")
    return blocks.withColumn("block_id", F.format_string("%s-p%d-b%d", "bundle_id", "page_index", "reading_order"))


def embedding_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle is a label, a page one vector."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("bundle_id"), (F.row_number().over(order) - 1).cast("int").alias("page_index"), "vec_id", "embedding")


def origins(spark: SparkSession, path: str) -> DataFrame:
    """Provenance of the files under a path: name, size and SHA-256."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("bundle_id"), "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSONL trace; a malformed line fails the read."""
    return spark.read.schema("bundle_id string, seq long, kind string, page int, payload string").json(path, mode="FAILFAST")


def write_trace(events: DataFrame, path: str) -> None:
    """JSONL, one folder a bundle; Spark's commit makes it whole or nothing."""
    events.write.mode("overwrite").partitionBy("bundle_id").json(path)


def bundle_window(order: str = "page_index"):
    return Window.partitionBy("bundle_id").orderBy(order)


def size_jump(prefix: str = "prev_") -> Column:
    """Rotation changed, or width or height differ by more than 20; unknown sizes never jump."""
    known = F.col("width").isNotNull() & F.col("height").isNotNull() & F.col(f"{prefix}width").isNotNull() & F.col(f"{prefix}height").isNotNull()
    moved = (F.col("rotation") != F.col(f"{prefix}rotation")) | (F.abs(F.col("width") - F.col(f"{prefix}width")) > 20) | (F.abs(F.col("height") - F.col(f"{prefix}height")) > 20)
    return F.coalesce(known & moved, F.lit(False))
