"""Files: page logs (JSON lines), directories of scans, page images, content hashes and product files."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import PAGES_LOG


def read_log(spark: SparkSession, path: str, strict: bool = True, schema: str = PAGES_LOG) -> DataFrame:
    """A page log. strict raises on a malformed line; else such a line, one without an integer page, is in _malformed, its columns are null, and every record has _line."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    got = lines.select("value", "line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.expr("try_cast(get_json_object(value, '$.page') AS int)").alias("p"))
    return got.selectExpr("r.*", "IF(p IS NULL, value, NULL) AS _malformed", "line AS _line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of text files. A line's number is its place in its split and the lines of the file's earlier splits, so files are read in parallel."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    per = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    at = per.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return raw.join(at, ["file", "start"]).selectExpr("file", "before + id - first + 1 AS line", "value")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends records; Spark's job commit makes them visible all at once."""
    rows.write.mode("append").json(path)


def page_of(log: DataFrame, page: int) -> DataFrame:
    """The latest record of one page."""
    return log.where(F.col("page") == page).groupBy("page").agg(F.max_by(F.struct(*[c for c in log.columns if c != "page"]), "seq").alias("r")).select("page", "r.*")


def event_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where("trim(value) <> ''").count()


def scan(spark: SparkSession, folder: str, suffix: str = "*.pdf", limit: int | None = None) -> DataFrame:
    """path, length, modified, sha256 and fingerprint of the files below a folder, by path. Hashing reads each file in one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(folder)
    out = files.select(
        "path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"),
        F.sha2(F.concat_ws(":", "path", "length", F.unix_micros("modificationTime")), 256).alias("fingerprint"),
    )
    return out.orderBy("path").limit(limit) if limit else out


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """Grayscale pixels of PNG or JPEG pages: path, width, height, pixels; unreadable ones have null pixels."""
    image = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    return image.select("image.origin", "image.width", "image.height", "image.nChannels", F.expr("IF(image.height > 0, image.data, NULL)").alias("data"))


def page_numbers(books: DataFrame) -> DataFrame:
    return books.where("page_count > 0").selectExpr("*", "explode(sequence(1, page_count)) AS page")


def page_sample(books: DataFrame, first: int = 20, step: int = 40, most: int = 10) -> DataFrame:
    """Every step-th page from first on, clipped to the book's last page, each once."""
    picks = f"slice(array_sort(array_distinct(transform(sequence(0, {most - 1}), i -> least({first} + i * {step}, page_count)))), 1, {most})"
    return books.where("page_count > 0").selectExpr("book_id", f"explode({picks}) AS page")


def write_atomically(path: str, text: str) -> None:
    """A product file of the driver: a temporary file beside it, flushed, then renamed."""
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def output_folder(path: str, base: str = ".") -> str:
    """Where a book's products go unless told otherwise: a folder of the file's name without its suffix."""
    return os.path.join(base, os.path.splitext(os.path.basename(path))[0])


def products(folder: str, names=("book.txt", "book.md")) -> list[tuple[str, int | None]]:
    """(name, bytes) of a book's products; None for one that is missing."""
    at = [(n, os.path.join(folder, n)) for n in names]
    return [(n, os.path.getsize(p) if os.path.exists(p) else None) for n, p in at]
