"""Random forest."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier

from foldwise.models.base import EstimatorClassifier, checked_weights

# Spark grows no deeper trees.
MAX_DEPTH = 30


class ForestClassifier(EstimatorClassifier):
    """Random forest.

    Thresholds come from binned features (``max_bins``), so trees are close to,
    not equal to, those of an exact splitter. Spark limits the rows of a child,
    not of the node to split: ``min_samples_split`` s becomes s // 2 rows per
    child, the least an even split of such a node leaves. ``class_weight`` is
    None, "balanced" or a dict; ``min_impurity_decrease`` is the least gain at
    a node, not weighted by the node's share of rows.
    """

    def __init__(self, n_estimators: int = 100, criterion: str = "gini",
                 max_depth: int | None = None, min_samples_split: int = 2,
                 min_samples_leaf: int = 1, max_features="sqrt", max_bins: int = 32,
                 random_state: int = 0, bootstrap: bool = True,
                 min_impurity_decrease: float = 0.0, class_weight=None):
        if criterion not in ("gini", "entropy", "log_loss"):
            raise ValueError(f"unknown criterion {criterion!r}")
        self.n_estimators, self.max_bins, self.random_state = n_estimators, max_bins, random_state
        self.impurity = "gini" if criterion == "gini" else "entropy"
        if max_depth is not None and not 1 <= max_depth <= MAX_DEPTH:
            raise ValueError(f"max_depth must lie in 1..{MAX_DEPTH}, or be None for the deepest")
        self.depth = MAX_DEPTH if max_depth is None else max_depth
        self.leaf_rows = max(min_samples_leaf, min_samples_split // 2, 1)
        self.max_features = max_features
        self.bootstrap, self.min_gain = bootstrap, float(min_impurity_decrease)
        self.class_weight = checked_weights(class_weight)

    def estimator(self, rows: int, n_features: int) -> RandomForestClassifier:
        subset = self.max_features
        if subset is None:
            subset = "all"
        elif isinstance(subset, int) or str(subset).isdigit():
            if not 1 <= int(subset) <= n_features:
                raise ValueError(f"max_features is {subset}, but there are {n_features} features")
            subset = str(int(subset))
        return RandomForestClassifier(
            numTrees=self.n_estimators, maxDepth=self.depth, maxBins=self.max_bins,
            impurity=self.impurity, minInstancesPerNode=self.leaf_rows,
            featureSubsetStrategy=str(subset), seed=self.random_state,
            bootstrap=self.bootstrap, minInfoGain=self.min_gain)
