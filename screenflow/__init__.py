"""Two-pass text screening of large metadata tables on Spark."""

from screenflow.lexicon import MENTAL_HEALTH, Lexicon, Signal, lexicon_from_table
from screenflow.operators.score import BatchScorer, SignalScorer
from screenflow.plans.cascade import signal_cascade
from screenflow.plans.conversion import convert_benchmark
from screenflow.plans.evaluation import evaluate_stage
from screenflow.plans.sample import sample_run
from screenflow.plans.screening import labels_for_rows, run_stage, run_two_pass
from screenflow.sources.metadata import read_metadata
from screenflow.sources.results import read_results
from screenflow.sources.truth import read_truth_csv
from screenflow.spec import CLASSIFY, SCREEN, Settings, StageSpec
from screenflow.streaming.incremental import run_incremental

__all__ = [
    "CLASSIFY", "MENTAL_HEALTH", "SCREEN", "BatchScorer", "Lexicon", "Settings", "Signal",
    "SignalScorer", "StageSpec", "convert_benchmark", "evaluate_stage", "labels_for_rows",
    "lexicon_from_table", "read_metadata", "read_results", "read_truth_csv", "run_incremental",
    "run_stage", "run_two_pass", "sample_run", "signal_cascade",
]
