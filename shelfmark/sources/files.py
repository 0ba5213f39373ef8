"""Files in: product lines, JSON envelopes, CSV, judge batches, images. Files out: JSON, CSV, JSON lines, run folders."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT = (
    "id string, category string, subcategory string, title string, brand string, price double, colors array<string>, sizes array<string>, "
    "parameters map<string,string>, rating double, shop_name string, after_sales map<string,string>, description string, image string"
)
JUDGE = (
    "method_name string, case_start int, case_end int, case_range array<int>, case_count int, source_file string, evaluation_mode string, avg_top5_relevant_ratio_gpt double, avg_filtered_correct_ratio_gpt double, "
    "rows array<struct<subcategory_slug:string,canonical_zh:string,top5_relevant_ratio_gpt:double,filtered_correct_ratio_gpt:double,notes:string>>"
)


def read_products(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """JSON lines of products with ``idx``, the position of the line from 0.

    Positions come from the lines' place in their file, files in order of name: lines are numbered within each split,
    and the splits' sizes, a row each, give the starts. With ``strict`` a line that isn't JSON, or whose
    fields aren't exactly those of a product, is an error.
    """
    fields = [x.split()[0] for x in PRODUCT.split(", ")]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    rows = lines.withColumn("within", within).join(starts, ["file", "block"]).select((F.col("start") + F.col("within")).alias("idx"), "value")
    parsed = rows.withColumn("p", F.from_json("value", PRODUCT)).withColumn("keys", F.json_object_keys("value"))
    if strict:
        wrong = F.col("keys").isNull() | (F.array_sort("keys") != F.lit(sorted(fields)))
        parsed = parsed.withColumn("idx", F.when(wrong, F.raise_error(F.concat(F.lit("not a product, line "), F.col("idx").cast("string"))).cast("bigint")).otherwise(F.col("idx")))
    return parsed.select("idx", "p.*")


def read_envelope(spark: SparkSession, path: str, schema: str, *, start: int = 0, limit: int = 0) -> DataFrame:
    """The ``rows`` of a JSON file in order, with ``pos``; ``limit`` 0 or less is to the end."""
    rows = spark.read.schema(f"rows array<struct<{schema}>>").json(path, multiLine=True).select(F.posexplode("rows").alias("pos", "row"))
    return row_range(rows, start, limit).select("pos", "row.*")


def row_range(rows: DataFrame, start: int = 0, limit: int = 0, position: str = "pos") -> DataFrame:
    keep = F.col(position) >= start
    return rows.where(keep & (F.col(position) < start + limit) if limit > 0 else keep)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_judge_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of judge files, whatever header fields they have."""
    return spark.read.schema(JUDGE).json(path, multiLine=True).select("method_name", "evaluation_mode", F.inline("rows"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of image files; decoding is the encoder's."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_json(path: str, payload: Any) -> None:
    """A small result as indented JSON, folders made, with an end of line."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(payload, ensure_ascii=False, indent=2) + "\n")


def write_rows_json(df: DataFrame, path: str) -> None:
    """A small table as ``{"rows": [...]}``."""
    write_json(path, {"rows": [r.asDict(recursive=True) for r in df.collect()]})


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One CSV file of a report-sized table in a folder; lists and maps as JSON text."""
    df = df.select(*columns) if columns else df
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def predictions(rankings: DataFrame, qrels: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, topk_image_paths, topk_scores, topk_correct_flags`` in order of rank."""
    from shelfmark.operators.metrics import judged

    rows = judged(rankings.where(F.col("rank") <= k), qrels).join(products.select("idx", "image"), "idx")
    at = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "image", "score", "rel"))).alias("x"))
    cells = {"topk_image_paths": "image", "topk_scores": "score", "topk_correct_flags": "rel"}
    return at.select("query_id", *[F.col(f"x.{c}").alias(n) for n, c in cells.items()])


def run_name(prefix: str, now: datetime | None = None) -> str:
    return f"{prefix}_{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}"


def write_manifest(folder: str, name: str, **fields: Any) -> str:
    """``run_manifest.json`` in the run's own folder, whose path is returned."""
    own = os.path.join(folder, name)
    write_json(os.path.join(own, "run_manifest.json"), {"run_name": name, **fields})
    return own
