"""Logistic regression with the penalty given as inverse strengths."""

from __future__ import annotations

from collections.abc import Hashable

from pyspark.ml.classification import LogisticRegression

from foldwise.models import newton
from foldwise.models.base import EstimatorClassifier
from foldwise.models.cells import DRIVER_NUMBERS, TrainSide, gather

PENALTIES = ("l1", "l2", "elasticnet", None)


class LogisticClassifier(EstimatorClassifier):
    """Penalised maximum likelihood; the intercept is not penalised.

    ``l1_c`` and ``l2_c`` are inverse strengths C of the sum-of-losses
    objective ``C * sum(loss) + penalty``. Dividing by C * n gives Spark's
    mean-of-losses objective, hence ``regParam = 1 / (C * n)``. An elastic net
    has ``C = l1_c + l2_c`` and mixes by ``l1_c / (l1_c + l2_c)``.
    ``solver`` is accepted and unused: there is one distributed solver.
    """

    def __init__(self, penalty: str | None = "l2", l1_c: float | None = None,
                 l2_c: float | None = None, solver: str | None = None, max_iter: int = 100):
        if penalty not in PENALTIES:
            raise ValueError(f"penalty must be one of {PENALTIES}, not {penalty!r}")
        self.penalty, self.l1_c, self.l2_c, self.max_iter = penalty, l1_c, l2_c, max_iter
        self.strength()

    @staticmethod
    def sampled(parameters: dict) -> list[str]:
        """``parameters`` hold the sampled penalty; unused strengths are left out."""
        needs = {"l1": ["l1_c"], "l2": ["l2_c"], "elasticnet": ["l1_c", "l2_c"]}
        used = needs.get(parameters.get("penalty"), [])
        return [k for k in parameters if k not in ("l1_c", "l2_c") or k in used]

    def strength(self) -> tuple[float | None, float]:
        """(C, share of l1)."""
        need = {"l1": [self.l1_c], "l2": [self.l2_c],
                "elasticnet": [self.l1_c, self.l2_c]}.get(self.penalty, [])
        if None in need:
            raise ValueError(f"penalty {self.penalty!r} needs its strength (l1_c, l2_c)")
        if self.penalty == "elasticnet":
            return self.l1_c + self.l2_c, self.l1_c / (self.l1_c + self.l2_c)
        return (need[0] if need else None), 1.0 if self.penalty == "l1" else 0.0

    def estimator(self, rows: int, n_features: int) -> LogisticRegression:
        c, l1_share = self.strength()
        return LogisticRegression(
            regParam=0.0 if c is None else 1.0 / (c * rows), elasticNetParam=l1_share,
            standardization=False, family="auto", maxIter=self.max_iter, tol=1e-5)

    @staticmethod
    def fit_cells(parts: dict[Hashable, tuple["LogisticClassifier", TrainSide]]) -> dict:
        """Fit many cells together, a job a step for all of them.

        A cell whose Hessian is too wide for the driver is fitted by itself.
        """
        rows = gather({key: learn for key, (_, learn) in parts.items()}, packed=True)
        try:
            narrow = {key: model for key, (model, _) in parts.items()
                      if newton.numbers(rows.cells[key]) <= DRIVER_NUMBERS}
            most = max((model.max_iter for model in narrow.values()), default=0)
            out = newton.fit(rows, {key: model.strength() for key, model in narrow.items()}, most)
        finally:
            rows.release()
        out.update({key: model.fit(learn.rows()) for key, (model, learn) in parts.items()
                    if key not in out})
        return out
