"""featshift: locate, correct and measure feature shift between two Spark tables."""

from featshift.config import CorrectConfig, LocateConfig
from featshift.plans.correct import CorrectionResult, correct_features
from featshift.plans.locate import DetectionResult, LocationResult, detect_shift, locate_shift
from featshift.sources.pair import ShiftPair

__all__ = [
    "CorrectConfig",
    "CorrectionResult",
    "DetectionResult",
    "LocateConfig",
    "LocationResult",
    "ShiftPair",
    "correct_features",
    "detect_shift",
    "locate_shift",
]
