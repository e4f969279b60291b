"""The three jobs users run end to end, composed from the operators."""

from pixelloom.plans.chip import ChipPlan, build_chips
from pixelloom.plans.evaluate import evaluate, predict_map
from pixelloom.plans.split import SplitPlan, build_splits

__all__ = ["ChipPlan", "SplitPlan", "build_chips", "build_splits", "evaluate", "predict_map"]
