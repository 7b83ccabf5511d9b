"""Hand-coded truth files: quoted CSV of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenflow.functions.strings import named

# Cell contents that stand for "no value" in a truth file.
NO_VALUE = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


ORD = "ord"
FILE, BLOCK, RANK = "_truth_file", "_truth_block", "_truth_rank"
# The lower bits of an increasing id count the rows of a task.
ROWS_OF_TASK = 2**33 - 1


def read_truth_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Read a truth CSV with every column a string and header names stripped.

    ``multiline`` keeps line breaks inside quoted cells, at the price of one
    task per file; switch it off for files known to have none. Rows are
    numbered as ``ord`` by the path of their file and their place in it, unless
    there is such a column.
    """
    raw = spark.read.csv(
        path,
        header=True,
        multiLine=multiline,
        quote='"',
        escape='"',
        inferSchema=False,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        maxCharsPerColumn=-1,
    )
    cells = [F.when(~named(c).isin(*NO_VALUE), named(c)).alias(c.strip()) for c in raw.columns]
    if ORD in (c.strip() for c in raw.columns):
        table = raw.select(*cells)
        return table.withColumn(ORD, F.col(ORD).cast("bigint"))
    # A task may read its blocks of files in any order, but each of them from start to end.
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)]
    blocks = raw.select(*place).distinct()
    rank = F.row_number().over(Window.orderBy(FILE, BLOCK)).cast("bigint")
    in_block = F.monotonically_increasing_id().bitwiseAND(ROWS_OF_TASK)
    numbered = raw.select(*cells, *place, in_block.alias(ORD)).join(
        blocks.withColumn(RANK, rank), [FILE, BLOCK]
    )
    return numbered.withColumn(ORD, F.col(RANK) * (ROWS_OF_TASK + 1) + F.col(ORD)).drop(FILE, BLOCK, RANK)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """Write a CSV folder that `read_truth_csv` and other CSV readers take back unchanged."""
    df.write.mode("errorifexists").csv(
        path,
        header=True,
        quote='"',
        escape='"',
        quoteAll=quote_all,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
