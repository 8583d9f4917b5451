"""lettermill: labelled-message analytics expressed as Spark DataFrame plans."""

from lettermill.config import StudyConfig, api_key
from lettermill.operators.metrics import CORE_CLASSIFICATION_METRICS, SUPPLEMENTARY_RANKING_METRICS
from lettermill.plans.study import (
    build_retrieval_manifest,
    load_complete_test_comparison,
    prepare_data,
    preview_retrieval_four_shot_request,
    run_nlp_study,
    run_retrieval_four_shot_batch,
    run_zero_shot_batch,
)
from lettermill.sources.transport import HttpTransport

__all__ = [
    "CORE_CLASSIFICATION_METRICS",
    "SUPPLEMENTARY_RANKING_METRICS",
    "HttpTransport",
    "StudyConfig",
    "api_key",
    "build_retrieval_manifest",
    "load_complete_test_comparison",
    "prepare_data",
    "preview_retrieval_four_shot_request",
    "run_nlp_study",
    "run_retrieval_four_shot_batch",
    "run_zero_shot_batch",
]
