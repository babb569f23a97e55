"""A study: tune a model and its transforms per replicate, score every trial.

For each trial of each replicate: fit the pipeline and the model on every cross
and score the held-out part (stage ``train``; its mean is the objective), refit
on the whole in-group and score it there (``validate``) and on the out-group
(``test``). The predictions of all these cells form one table and all metrics
are grouped aggregations over it.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.frame import Frame, col
from foldwise.models import CLASSIFIERS
from foldwise.models.base import sampled_parameters
from foldwise.models.cells import TrainSide
from foldwise.operators import metrics as M
from foldwise.operators.folds import FoldPlan, assign_slices, side
from foldwise.operators.select import isolate_target
from foldwise.plans.pipeline import Pipeline, Run, Step, check_options
from foldwise.plans.proposals import propose
from foldwise.plans.space import Parameter, Space
from foldwise.sources.results import ResultStore, run_label, stage_name, train_name
from foldwise.sources.formats import TABULAR, read_format
from foldwise.sources.tables import stored

STAGES = ("train", "validate", "test")
STARTUP_TRIALS = 10
MODEL = "model"


@dataclass(frozen=True)
class StudySpec:
    """The study's own settings, checked before any job runs."""

    label: str
    target: str
    objective: str
    metrics: dict[str, list[str]]
    # The defaults that users of such studies know.
    seed: int = 71554
    replicates: int = 10
    crosses: int = 10
    trials: int = 100
    direction: str = "minimize"

    @staticmethod
    def of(spec: dict, custom_metrics: dict | None = None) -> "StudySpec":
        known = M.known_metrics() | set(custom_metrics or {})
        metrics = {stage: list(spec.get("metrics", {}).get(stage, [])) for stage in STAGES}
        for name in [spec["objective"], *(m for ms in metrics.values() for m in ms)]:
            if name not in known:
                raise ValueError(f"unknown metric {name!r}")
        objective = spec["objective"]
        if objective not in {*M.SCALAR_METRICS, *(custom_metrics or {})}:
            raise ValueError(f"objective {objective!r} is not a single number")
        direction = "minimize" if objective in M.MINIMISED else "maximize"
        return StudySpec(spec["label"], spec["target"], objective, metrics,
                         spec.get("random_seed", 71554), spec.get("no_replicates", 10),
                         spec.get("no_crosses", 10), spec.get("no_trials", 100),
                         spec.get("direction", direction))


@dataclass
class Prepared:
    """A replicate of a trial before its models are fitted."""

    replicate: int
    model: object
    used: list[str]
    # By (stage, cross): the rows to train on, and those to score.
    sides: dict[tuple, tuple[TrainSide, Frame]]


class Study:
    """Data, model and study specs put together. ``custom_*`` add transforms,
    models and metrics by name."""

    def __init__(self, data: dict, model: dict, study: dict,
                 custom_transforms: dict[str, Callable] | None = None,
                 custom_models: dict[str, type] | None = None,
                 custom_metrics: dict[str, Callable] | None = None, parallel: int = 4):
        self.data = data
        self.custom_metrics = custom_metrics or {}
        self.spec = StudySpec.of(study, self.custom_metrics)
        self.plan = FoldPlan(self.spec.replicates, self.spec.crosses)
        if self.spec.crosses < 2:
            raise ValueError("at least 2 crosses are needed to score a trial")
        self.pipeline = Pipeline.of(data, custom_transforms)
        models = {**CLASSIFIERS, **(custom_models or {})}
        if model["model"] not in models:
            raise ValueError(f"unknown model {model['model']!r}; known are {sorted(models)}")
        self.classifier = models[model["model"]]
        self.parameters = model.get("parameters", {})
        check_options(self.classifier, self.parameters, model["model"])
        self.space = Space.of({**self.pipeline.owners(), MODEL: self.parameters})
        self._check_choices()
        self.run_name = run_label(self.spec.label, model["label"], data["label"])
        self.parallel = parallel

    def _check_choices(self) -> None:
        """Build the model once for each value of each choice, before any job runs."""
        usual = {k: Parameter.of(k, v).first() if isinstance(v, dict) else v
                 for k, v in self.parameters.items()}
        for key, spec in self.parameters.items():
            choices = Parameter.of(key, spec).choices if isinstance(spec, dict) else ()
            for value in choices or [usual[key]]:
                given = {**usual, key: value}
                self.classifier(**{k: given[k] for k in sampled_parameters(self.classifier,
                                                                           given)})

    # --- Tables --------------------------------------------------------------

    def result_schema(self) -> T.StructType:
        """replicate, trial, objective, tuned parameters, metrics by stage."""
        fields = ["replicate int", "trial int", "objective double"]
        fields += [f"`{p.label}` {p.sql_type}" for p in self.space.parameters.values()]
        for m in self.spec.metrics["train"]:
            fields += [f"`{train_name(m, x)}` {self._kind(m)}" for x in range(self.plan.crosses)]
        for stage in STAGES[1:]:
            fields += [f"`{stage_name(m, stage)}` {self._kind(m)}"
                       for m in self.spec.metrics[stage]]
        return T._parse_datatype_string(", ".join(fields))

    @staticmethod
    def _kind(metric: str) -> str:
        if metric in M.ROW_METRICS:
            return "bigint"  # how many; which ones is in the rows table
        if metric in M.CLASS_METRICS or metric == M.IMPORTANCE:
            return "map<string,double>"
        return "double"

    def load(self, spark: SparkSession) -> Frame:
        name = self.data.get("format", TABULAR)
        options = {"separator": self.data["separator"]} if "separator" in self.data else {}
        return read_format(spark, name, self.data["data_source"], self.data.get("index"), **options)

    # --- The loop ------------------------------------------------------------

    def run(self, spark: SparkSession, store: ResultStore, frame: Frame | None = None,
            overwrite: bool = False, resume: bool = False) -> DataFrame:
        """Run all trials; with ``resume``, those not yet in the store."""
        frame = isolate_target(frame or self.load(spark), self.spec.target)
        frame = assign_slices(frame, self.plan, self.spec.seed)
        fits: dict = {}
        # What no trial and no replicate changes is done and written once.
        lead = Run("all", lambda step: step.options, fits)
        frame = self.pipeline.prepare(stored(frame, "slices"), "replicate", lead,
                                      slice(self.pipeline.fixed))
        if self.pipeline.fixed:
            frame = stored(frame, "prepared")
        if not (resume and store.exists(self.run_name)):
            store.create(self.run_name, self.result_schema(), overwrite)
        done = {(r["replicate"], r["trial"])
                for r in store.load(self.run_name).select("replicate", "trial").collect()}
        self._fit_ahead(frame, fits)
        writing = Lock()

        def finish(replicate: int, trial: int, chosen: dict, together: dict) -> None:
            row = self._trial(frame, store, replicate, trial, chosen, fits, together)
            with writing:  # one writer of the folder at a time
                store.append(self.run_name, spark.createDataFrame([row], self.result_schema()))

        for trial in range(self.spec.trials):
            todo = [r for r in range(self.plan.replicates) if (r, trial) not in done]
            if not todo:
                continue
            chosen = self._parameters(spark, store, trial)
            with ThreadPoolExecutor(self.parallel) as pool:
                together = {}
                if hasattr(self.classifier, "fit_cells"):
                    together = self._fit_cells(list(pool.map(
                        lambda r: self._prepared(frame, r, chosen.get(r, {}), fits), todo)))
                # A failing replicate raises after the others are stored.
                list(pool.map(lambda r: finish(r, trial, chosen.get(r, {}), together), todo))
        return store.load(self.run_name)

    def _fit_ahead(self, frame: Frame, fits: dict) -> None:
        """Fit the first step after the split for all replicates in one job."""
        if any(s.tuned and s.per_replicate for s in self.pipeline.before):
            return
        run = Run("all", lambda step: step.options, fits)
        whole = self.pipeline.prepare(frame, "replicate", run, slice(self.pipeline.fixed, None))
        self.pipeline.fit_ahead(whole, "replicate", {
            Run(r, run.resolve, fits): self.plan.in_group(r)
            for r in range(self.plan.replicates)})

    def _parameters(self, spark: SparkSession, store: ResultStore, trial: int) -> dict[int, dict]:
        """Every replicate's values for a trial: drawn at first, then proposed."""
        if not self.space.parameters:
            return {}
        if trial < STARTUP_TRIALS:
            keys = spark.range(self.plan.replicates).select(
                F.col("id").cast("int").alias("replicate"), F.lit(trial).alias("trial"))
            table = self.space.sample(keys, self.spec.seed)
        else:
            table = propose(store.load(self.run_name).filter(F.col("trial") < trial), self.space,
                            self.spec.seed + trial, self.spec.direction)
        return {r["replicate"]: r.asDict() for r in table.collect()}

    def _prepared(self, frame: Frame, replicate: int, chosen: dict, fits: dict) -> Prepared:
        """Fit the transforms of a replicate; its models are not fitted yet."""
        def resolve(step: Step) -> dict:
            return self.space.resolve(step.owner, step.options, chosen)

        given = self.space.resolve(MODEL, self.parameters, chosen)
        used = sampled_parameters(self.classifier, given)
        model = self.classifier(**{k: given[k] for k in used})

        run = Run("all", resolve, fits)
        whole = self.pipeline.prepare(frame, "replicate", run, slice(self.pipeline.fixed, None))
        run = Run(replicate, resolve, fits if run.clean else {}, private=not run.clean)
        inside, outside = self.pipeline.split(
            side(whole, self.plan.in_group(replicate)),
            side(whole, self.plan.out_group(replicate)), "replicate", run)
        sides = self._crosses(inside, replicate, run, fits)
        sides["validate", None] = (TrainSide(inside), inside)
        sides["test", None] = (TrainSide(inside), outside)
        return Prepared(replicate, model, used, sides)

    def _crosses(self, inside: Frame, replicate: int, run: Run, fits: dict) -> dict[tuple, tuple]:
        """Train and held-out side of every cross of a replicate."""
        shared = self.pipeline.prepare(inside, "cross", run)
        private = run.private or not run.clean
        held = {} if private else fits
        runs = [Run((replicate, x), run.resolve, held, private)
                for x in range(self.plan.crosses)]
        self.pipeline.fit_ahead(shared, "cross", {
            r: self.plan.cross_train(replicate, x) for x, r in enumerate(runs)})
        own_fits = any(s.runs_at("cross") for s in self.pipeline.after)
        sides: dict[tuple, tuple] = {}
        for x, cross_run in enumerate(runs):
            slices = self.plan.cross_train(replicate, x)
            test = side(shared, self.plan.cross_test(replicate, x))
            learn = TrainSide(shared, tuple(slices))  # one frame for all crosses
            if own_fits:
                train, test = self.pipeline.split(side(shared, slices), test, "cross", cross_run)
                learn = TrainSide(train)
            sides["train", x] = (learn, test)
        return sides

    def _fit_cells(self, ready: list[Prepared]) -> dict[int, tuple[Prepared, dict]]:
        """By replicate its sides and models by cross, all fitted together."""
        fitted = self.classifier.fit_cells({
            (p.replicate, cross): (p.model, learn)
            for p in ready for (_, cross), (learn, _) in p.sides.items()})
        return {p.replicate: (p, {cross: fitted[p.replicate, cross] for _, cross in p.sides})
                for p in ready}

    def _trial(self, frame: Frame, store: ResultStore, replicate: int, trial: int, chosen: dict,
               fits: dict, together: dict) -> dict:
        """Predict and score all cells of one replicate; fit them, unless that is done."""
        if replicate in together:
            ready, own = together[replicate]
        else:
            ready, own = self._prepared(frame, replicate, chosen, fits), {}
        for (_, cross), (learn, _) in ready.sides.items():
            if cross not in own:
                own[cross] = ready.model.fit(learn.rows())
        fitted = {(stage, cross): (own[cross], frame)
                  for (stage, cross), (_, frame) in ready.sides.items()}
        preds = reduce(DataFrame.unionByName, [
            self._scored(model, frame, stage, cross, self._needed())
            for (stage, cross), (model, frame) in fitted.items()])
        preds = preds.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            row = self._scores(preds, fitted)
            self._store_rows(store, preds, row, replicate, trial)
            self._importance(fitted, row)
        finally:
            preds.unpersist()
            for model in own.values():
                if hasattr(model, "release"):
                    model.release()
        for (owner, key), p in self.space.parameters.items():
            sampled = owner != MODEL or key in ready.used
            row[p.label] = chosen[p.label] if sampled else None
        row.update(replicate=replicate, trial=trial)
        return {f.name: row.get(f.name) for f in self.result_schema()}

    def _needed(self) -> tuple[str, ...]:
        """The features that metrics ask for."""
        used = {self.spec.objective, *(m for own in self.spec.metrics.values() for m in own)}
        asked = [f for m in sorted(used) if isinstance(self.custom_metrics.get(m), M.FeatureMetric)
                 for f in self.custom_metrics[m].features]
        return tuple(dict.fromkeys(asked))

    @staticmethod
    def _scored(fitted, frame: Frame, stage: str, cross: int | None,
                features: tuple[str, ...] = ()) -> DataFrame:
        scored = fitted.predict(frame)
        if features:
            scored = M.with_features(scored, frame, features)
        return scored.select(
            F.lit(stage).alias("stage"), F.lit(cross).cast("int").alias("cross"),
            col(frame.row_id).alias("row_id"), col(frame.label).alias("label"), "pred", "proba",
            *[col(f) for f in features])

    # --- Scores --------------------------------------------------------------

    def _scores(self, preds: DataFrame, fitted: dict) -> dict:
        """All metrics of a trial under their column names."""
        wanted: dict[str, set[str]] = {}
        for stage in STAGES:
            for m in self.spec.metrics[stage]:
                wanted.setdefault(m, set()).add(stage)
        wanted.setdefault(self.spec.objective, set()).add("train")
        parts = [M.evaluate(preds.filter(F.col("stage").isin(sorted(stages))),
                            ["stage", "cross"], [m], self.custom_metrics)
                 for m, stages in wanted.items() if m not in M.ROW_METRICS and m != M.IMPORTANCE
                 and not isinstance(self.custom_metrics.get(m), M.ModelMetric)]
        found = [(r["stage"], r["cross"], r["metric"],
                  r["value"] if r["classes"] is None else r["classes"])
                 for r in (reduce(DataFrame.unionByName, parts).collect() if parts else ())]
        found += [(stage, cross, m, self.custom_metrics[m].compute(model, frame))
                  for m, stages in wanted.items()
                  if isinstance(self.custom_metrics.get(m), M.ModelMetric)
                  for (stage, cross), (model, frame) in fitted.items() if stage in stages]
        row: dict = {}
        held_out = []
        for stage, cross, metric, value in found:
            if stage == "train":
                row[train_name(metric, cross)] = value
                if metric == self.spec.objective:
                    held_out.append(value)
            else:
                row[stage_name(metric, stage)] = value
        known = [v for v in held_out if v is not None]
        row["objective"] = sum(known) / len(known) if known else None
        return row

    def _store_rows(self, store: ResultStore, preds: DataFrame, row: dict, replicate: int,
                    trial: int) -> None:
        """Keep which rows were right or wrong; their number goes to the row."""
        picked = []
        for stage in STAGES:
            for m in self.spec.metrics[stage]:
                if m in M.ROW_METRICS:
                    crosses = range(self.plan.crosses) if stage == "train" else [None]
                    row.update({train_name(m, x) if stage == "train" else stage_name(m, stage): 0
                                for x in crosses})
                    picked.append(M.ROW_METRICS[m](preds.filter(F.col("stage") == stage)).select(
                        "stage", "cross", F.lit(m).alias("metric"), "row_id"))
        if not picked:
            return
        rows = reduce(DataFrame.unionByName, picked)
        store.write_rows(self.run_name, replicate, trial, rows)
        for r in rows.groupBy("stage", "cross", "metric").count().collect():
            name = (train_name(r["metric"], r["cross"]) if r["stage"] == "train"
                    else stage_name(r["metric"], r["stage"]))
            row[name] = r["count"]

    def _importance(self, fitted: dict, row: dict) -> None:
        for (stage, cross), (model, frame) in fitted.items():
            if M.IMPORTANCE not in self.spec.metrics[stage]:
                continue
            found = M.permutation_importance(model, frame, seed=self.spec.seed).collect()
            name = (train_name(M.IMPORTANCE, cross) if stage == "train"
                    else stage_name(M.IMPORTANCE, stage))
            row[name] = {r["feature"]: r["importance"] for r in found}
