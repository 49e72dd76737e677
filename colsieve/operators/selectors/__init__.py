"""The selectors by name. Importing this registers them."""

from colsieve.operators.selectors.base import NotFitted, NothingKept, Seeded, Selector
from colsieve.operators.selectors.filters import (
    ANOVAFSelector,
    BerkJonesSelector,
    CorrelationSelector,
    FDRSelector,
    FWESelector,
    HigherCriticismSelector,
    MannWhitneySelector,
    MutualInfoSelector,
    PercentileSelector,
    RandomSelector,
    VarianceThreshold,
)
from colsieve.operators.selectors.solvers import LassoSelector, RFECVSelector, RFESelector, SequentialSelector, TreeImportanceSelector

__all__ = [
    "ANOVAFSelector", "BerkJonesSelector", "CorrelationSelector", "FDRSelector", "FWESelector", "HigherCriticismSelector", "LassoSelector", "MannWhitneySelector",
    "MutualInfoSelector", "NotFitted", "NothingKept", "PercentileSelector", "RFECVSelector", "RFESelector", "RandomSelector", "Seeded", "Selector", "SequentialSelector", "TreeImportanceSelector", "VarianceThreshold",
]
