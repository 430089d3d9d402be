"""Log and decision text: SRC-9 read, SNK-6 / SNK-7 write, FLT-15 filter,
LIM-1 tail, AGG-8 count.

Line order is not a property of a distributed text read, so our exports
write an explicit ``line_no`` with every line (``<line_no>\\t<line>``). Plain
log files (no numbers) are read by splits, each line numbered by its place in
its split and the lines of the file's splits before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def read_log(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """SRC-9: (file, line_no, line). ``numbered`` reads our own export format."""
    if numbered:
        raw = spark.read.text(path)
        return raw.select(
            F.input_file_name().alias("file"),
            F.regexp_extract("value", r"^(\d+)\t", 1).cast("bigint").alias("line_no"),
            F.regexp_replace("value", r"^\d+\t", "").alias("line"))
    return number_splits(spark.read.option("lineSep", "\n").text(path))


def number_splits(raw: DataFrame) -> DataFrame:
    """``file, line_no, line`` of files read as text, numbered from 1 in each file. Rows
    of a split follow each other in one task, so a line's place in its split is its
    distance from the split's first row; counts per split (a file has few) are added
    up in the order of the splits. No task reads or numbers a whole file."""
    split = ["file", "start"]
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy(*split).agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_lead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(sizes.drop("n"), split).select(
        "file", (F.col("_lead") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def number_lines(lines: DataFrame, order: list[str], line_no: str = "line_no") -> DataFrame:
    """Lines with their number from 1 in the order of ``order`` (of any sortable type):
    sorted by ranges over all tasks, counted per range, and the counts added up. Lines
    that share a place in the order keep one each."""
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged).withColumn("_part", F.shiftright("_id", 33))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # one row per range
    lead = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.join(counts.select("_part", lead.alias("_lead")), "_part")
    number = F.col("_lead") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn(line_no, number).drop("_id", "_part", "_lead")


def write_lines(lines: DataFrame, path: str, line_no: str = "line_no", line: str = "line") -> None:
    """SNK-6 text export: ``<line_no>\\t<line>`` so order survives the round trip."""
    (lines.select(F.format_string("%d\t%s", F.col(line_no), F.col(line)).alias("value"))
          .write.mode("overwrite").text(path))


def write_decisions(decisions: DataFrame, path: str) -> None:
    """SNK-6 table form: the decisions as Parquet (the text is only an export)."""
    decisions.write.mode("overwrite").parquet(path)


def write_diff(diff: DataFrame, path: str) -> None:
    """SNK-7: the diff partitioned by bucket; rows are spread over all tasks, as
    most of them share one bucket."""
    diff.repartition("bucket", "company", "title").write.mode("overwrite").partitionBy("bucket").parquet(path)


def log_lines(lines: DataFrame, source: str | None = None, level: str | None = None,
              filtered_only: bool = False) -> DataFrame:
    """FLT-15: company ('[source]' or case-insensitive substring), level
    ('[LEVEL]'), only FILTERED lines."""
    out = lines
    if source:
        out = out.where(F.col("line").contains(f"[{source}]") | F.lower(F.col("line")).contains(source.lower()))
    if level:
        out = out.where(F.col("line").contains(f"[{level.upper()}]"))
    if filtered_only:
        out = out.where(F.col("line").contains("FILTERED"))
    return out


def tail(lines: DataFrame, n: int | None = None, order_col: str = "line_no") -> DataFrame:
    """LIM-1: last n lines in original order (a top-n, so each task keeps at
    most n rows, then sorted back). ``None`` returns every line, as it comes; 0
    returns none (Q15 fixed)."""
    if n is None:
        return lines
    return lines.orderBy(F.col(order_col).desc()).limit(n).orderBy(order_col)
