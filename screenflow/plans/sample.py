"""Trial run on a slice of the metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenflow.operators.compare import wide_results
from screenflow.operators.score import Scorer
from screenflow.plans.screening import run_two_pass
from screenflow.sources.metadata import result_listing, sample_slice
from screenflow.sources.results import read_results
from screenflow.spec import CLASSIFY, SCREEN, Settings


def sample_run(
    spark: SparkSession,
    table: DataFrame,
    n: int,
    order_by: str,
    slice_path: str,
    results_path: str,
    settings: Settings,
    scorer: Scorer,
) -> DataFrame:
    """Write the slice, run both passes on it and list the results."""
    sample_slice(table, n, order_by, settings.model_label).write.parquet(slice_path)
    run_two_pass(spark, spark.read.parquet(slice_path), results_path, settings, scorer)
    results = read_results(spark, results_path, model_label=settings.model_label)
    wide = wide_results(results, [settings], [SCREEN, CLASSIFY])
    return result_listing(wide, settings, SCREEN, CLASSIFY)
