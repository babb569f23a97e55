"""Classifiers by the name a model spec uses."""

from foldwise.models.base import EstimatorClassifier
from foldwise.models.boost import BoostClassifier
from foldwise.models.linear import LogisticClassifier
from foldwise.models.neighbors import NeighborsClassifier
from foldwise.models.svm import SupportVectorClassifier
from foldwise.models.trees import ForestClassifier

# The names used in specs.
CLASSIFIERS = {
    "LogisticRegression": LogisticClassifier,
    "SVC": SupportVectorClassifier,
    "KNNC": NeighborsClassifier,
    "AdaBoostClassifier": BoostClassifier,
    "RFC": ForestClassifier,
}

__all__ = ["CLASSIFIERS", "BoostClassifier", "EstimatorClassifier", "ForestClassifier",
           "LogisticClassifier", "NeighborsClassifier", "SupportVectorClassifier"]
