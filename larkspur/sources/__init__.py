"""Reading and writing tables: Parquet by name, all-string CSV, JSON, and idempotent page stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_strings(spark: SparkSession, path: str, columns: list[str], null_value: str | None = None) -> DataFrame:
    """A headered CSV with every column a string (S01, S02); ``null_value`` decides what the literal 'null' means."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.option("nullValue", null_value) if null_value is not None else reader).csv(path)


def scan(df: DataFrame, columns: list[str] | None = None, equal: dict | None = None, among: dict[str, list] | None = None,
    order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """The rows of a table that meet all given conditions (S07): equal values, lists of values, order, limit; all of it reaches the scan."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
    for c, v in (among or {}).items():
        df = df.where(F.col(c).isin(*v))
    df = df.orderBy(*order) if order else df
    df = df if limit is None else df.limit(limit)
    return df.select(*columns) if columns else df


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON, one a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def insert_counted(df: DataFrame, path: str, errors: dict[str, Column], dry_run: bool = False) -> dict[str, int]:
    """Append the rows that break no rule and count both kinds in the same pass (S09); a dry run only counts."""
    from pyspark.sql import Observation

    good, bad = split_flag(errors)
    seen = Observation()
    rows = df.observe(seen, F.count_if(good).alias("inserted"), F.count_if(bad).alias("failed")).where(good)
    if dry_run:
        rows.write.format("noop").mode("overwrite").save()
    else:
        rows.write.mode("append").parquet(path)
    return seen.get


def split_flag(errors: dict[str, Column]) -> tuple[Column, Column]:
    """(whether a row breaks no rule, whether it breaks one)."""
    bad = F.lit(False)
    for c in errors.values():
        bad = bad | F.coalesce(c, F.lit(False))
    return ~bad, bad


def append_events(events: DataFrame, path: str, fallback: str, errors: dict[str, Column], correlation: Column | None = None) -> None:
    """Append events that break no rule, the others with their errors to a fallback table (S20, S21); ``correlation`` becomes correlation_id."""
    rows = events if correlation is None else events.withColumn("correlation_id", correlation)
    good, bad = split_valid(rows, errors)
    good.write.mode("append").parquet(path)
    bad.write.mode("append").parquet(fallback)


def xml_items(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """The items of an XML list."""
    return spark.read.schema(schema).format("xml").option("rowTag", row_tag).load(path)


#: Folders that the pages of all documents are dealt to.
PAGE_BUCKETS = 64


def page_bucket(buckets: int = PAGE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(buckets)).cast("int")


def write_pages(pages: DataFrame, path: str, buckets: int = PAGE_BUCKETS) -> None:
    """Store page artifacts (doc_id, page, content, and variant if there is one) (S10, S12); writing a document again replaces it.

    Documents are dealt to ``buckets`` folders by a hash of their id; a write replaces the folders that it touches, with their other documents as
    they were.
    """
    rows = pages.withColumn("bucket", page_bucket(buckets))
    if exists(pages.sparkSession, path):
        old = pages.sparkSession.read.parquet(path)
        kept = old.join(F.broadcast(rows.select("bucket").distinct()), "bucket", "left_semi")  # a row a bucket
        rows = kept.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def load_pages(spark: SparkSession, path: str, doc_ids: list, buckets: int = PAGE_BUCKETS, variant: str | None = None) -> DataFrame | None:
    """The pages of some documents, None where nothing is stored at the path (S11, S12); only their folders are read."""
    if not exists(spark, path):
        return None
    asked = spark.createDataFrame([(str(i),) for i in doc_ids], "id string").select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("b"))
    folders = [r.b for r in asked.distinct().collect()]
    pages = spark.read.parquet(path).where(F.col("bucket").isin(*folders) & F.col("doc_id").isin(*doc_ids)).drop("bucket")
    return pages if variant is None else pages.where(F.col("variant") == variant)


def page_manifest(pages: DataFrame) -> DataFrame:
    """Per document: number of pages, bytes in total, and a checksum over its pages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.sha2("content", 256).alias("sum"))))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum(F.octet_length("content")).alias("bytes"),
        F.sha2(F.array_join(F.transform(ordered, lambda p: p["sum"]), ""), 256).alias("checksum"),
    )


def split_valid(rows: DataFrame, errors: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with the names of the rules they break."""
    named = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in errors.items())), lambda e: e.isNotNull())
    told = rows.withColumn("errors", named)
    return told.where(F.size("errors") == 0).drop("errors"), told.where(F.size("errors") > 0)
