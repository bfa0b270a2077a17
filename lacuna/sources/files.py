"""Readers and writers: JSON, JSON Lines, TSV, XML, binary tiles, tensors; resume and read-through."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of records. Files are whole records to Spark: large tables belong in JSON Lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """JSON Lines files with one permissive schema: fields that a file lacks are null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(list(paths))


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """(ref, text) of an XML corpus: its verse elements, words joined by blanks, notes left out, Hebrew letters only."""
    d = spark.read.format("xml").option("rowTag", "verse").schema("_osisID string, w array<string>").load(path)
    words = F.transform("w", lambda w: F.regexp_replace(w, "[^א-ת]", ""))
    return d.select(F.col("_osisID").alias("ref"), F.array_join(F.filter(words, lambda w: w != ""), " ").alias("text"))


def flatten_paths(nested: DataFrame, key: str, column: str, depth: int) -> DataFrame:
    """(key, path, text): leaves of arrays nested `depth` deep, with their places from 1 as a dotted path."""
    d = nested.select(key, F.lit("").alias("path"), F.col(column).alias("x"))
    for _ in range(depth):
        d = d.select(key, "path", F.posexplode("x").alias("i", "x"))
        d = d.select(key, F.concat("path", F.when(F.col("path") == "", "").otherwise("."), (F.col("i") + 1).cast("string")).alias("path"), "x")
    return d.select(key, "path", F.col("x").alias("text"))


def plain_letters(c: Column) -> Column:
    """Markup, points and joining marks away."""
    c = F.regexp_replace(c, r"<[^>]*>|&[a-z]+;", " ")
    c = F.regexp_replace(F.translate(c, "־", " "), "[֑-ֽֿ-ׇ]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of binary files; pixels are not decoded."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def harvest(pages: DataFrame, fetch: Callable[[dict], list[dict]], schema: str, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """Rows that `fetch` returns for each page description, retried after `wait` seconds, twice that, four times... A page that
    fails each time gives one row whose columns are null but for `error`, which the schema must have. Pages are spread over
    tasks."""

    def run(frames: Iterator) -> Iterator:
        import time

        import pandas as pd

        names = [f.split()[0] for f in schema.split(",")]
        for d in frames:
            rows: list[dict] = []
            for page in d.to_dict("records"):
                for k in range(tries):
                    try:
                        rows += fetch(page)
                        break
                    except Exception as e:
                        if k + 1 == tries:
                            rows.append({"error": f"{type(e).__name__}: {e}"})
                        else:
                            time.sleep(wait * 2**k)
            yield pd.DataFrame(rows, columns=names)

    return pages.mapInPandas(run, schema)


def harvest_pages(spark: SparkSession, fetch: Callable[[dict], list[dict]], pages: int, schema: str, key: str, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """All pages (from 1 on) of a source: (schema..., page), one row for each key, of repeated keys the one from the last page
    and the last place on it. Rows without a key, which are the failed pages, stay."""
    page = spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page"))

    def numbered(p: dict) -> list[dict]:
        return [{**r, "page": p["page"], "at": i} for i, r in enumerate(fetch(p))]

    got = harvest(page.repartition(min(pages, spark.sparkContext.defaultParallelism) or 1, "page"), numbered, f"{schema}, page int, at int", tries, wait)
    rest = [c for c in got.columns if c != key]
    last = got.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("page", "at")).alias("r"))
    return last.select(key, *[F.col("r")[c].alias(c) for c in rest]).unionByName(got.where(F.col(key).isNull())).drop("at")


def harvest_report(rows: DataFrame, key: str, expected: int) -> DataFrame:
    """One row: how many keys came, how many were expected, how many pages failed, and whether something is missing."""
    n = rows.agg(F.count(key).alias("unique"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return n.select("unique", F.lit(expected).cast("long").alias("expected"), "failed", (F.col("unique") != expected).alias("incomplete"))


def stitched(tiles: DataFrame, image: str, row: str, col: str, pixels: str, tile: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """(image, y, x, value): the pixels of an image out of its tiles, trimmed to its size; tiles and sizes are (width, height),
    pixels an array row after row. Later tiles don't overlap earlier ones, so nothing is sorted or gathered."""
    w, h = tile
    d = tiles.select(image, F.col(row).alias("_r"), F.col(col).alias("_c"), F.posexplode(pixels).alias("_i", "value"))
    d = d.select(image, (F.col("_r") * h + F.floor(F.col("_i") / w)).cast("int").alias("y"), (F.col("_c") * w + F.col("_i") % w).cast("int").alias("x"), "value")
    return d.where((F.col("x") < size[0]) & (F.col("y") < size[1]))


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, made and written first if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(work: DataFrame, path: str, key: Sequence[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs `step` on the rows whose keys aren't in the table at `path` yet, appends what it gives, and reads the whole."""
    spark = work.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        work = work.join(spark.read.parquet(path).select(*key).distinct(), list(key), "left_anti")
    step(work).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def tensor_rows(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, i, value): an array column as a long table, the form in which tensors are stored."""
    return df.select(*keys, F.posexplode(column).alias("i", "value"))


def tensor_arrays(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The inverse of tensor_rows: (keys, values)."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("values"))
