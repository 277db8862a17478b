"""Model registry: fitted parts of the three markets, made on demand and committed one by one.

A registry belongs to one training set and one recipe (trees, depth, folds, seed, ...); their
fingerprint names its folder, so changed training rows or parameters never meet old models.
The parts and what they need:

* ``rows`` — the training set as it was fingerprinted;
* ``matrix`` — imputed features and labels, and the medians;
* ``<market>/frame`` — match id, label, fold and features of one market;
* ``<market>/logit`` — logistic regression on all rows, and its coefficients;
* ``<market>/full`` — forest on all rows, beside that logistic regression;
* ``<market>/fold-<f>`` — the rows of fold ``f`` scored by models of the other folds, with the
  coefficients of the logistic regression and the size of the forest.

A caller names the parts it needs (:meth:`ModelRegistry.ensure`), missing ones are fitted as
concurrent Spark jobs.  Every part is written to a folder of its own attempt; an empty marker file
commits it.  Readers take the first committed attempt, so a crash leaves only an uncommitted
folder behind, two writers of one part do not disturb each other, and a stopped training goes on
with the parts that are missing.

The matrix of a fit is read in as few partitions as its counted size needs (``PART_BYTES``): a
forest exchanges one statistic per partition and node on every level, so partitions that a small
matrix does not need multiply the work.  A matrix of one partition goes to Spark's forest
(``max_memory_mb`` lets a level of all trees be one pass), a larger one to :mod:`.forest`, whose
tasks share out the trees over all blocks, so that a fit is not held to a core per partition.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from . import models as ML
from .forest import fit_blocks
from .features import feature_columns
from .metrics import stratified_folds

PART_BYTES = 64 << 20        # bytes of a training matrix in one partition
MOST_JOBS = 8                # parts fitted at the same time, if their partitions leave cores free
PARTS_AT_ONCE = 64           # partitions of the matrices that are grown from blocks at the same time (2 fits at least)

RECIPE = dict(num_trees=C.FOREST_PARAMS["num_trees"], max_depth=C.FOREST_PARAMS["max_depth"], min_leaf=C.FOREST_PARAMS["min_leaf"],
              logit_c=C.LOGIT_C, logit_max_iter=C.LOGIT_MAX_ITER, folds=C.CV_FOLDS, seed=C.SEED)


class _Files:
    """The few file operations of the registry, through Hadoop's file systems (local, shared or object store)."""

    def __init__(self, spark: SparkSession):
        self._spark = spark

    def _at(self, path: str):
        p = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._spark._jsc.hadoopConfiguration()), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def mark(self, path: str) -> None:
        fs, p = self._at(path)
        fs.createNewFile(p)

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(target)
        fs.mkdirs(p.getParent())
        if not fs.rename(self._at(source)[1], p):
            raise OSError(f"cannot move {source} to {target}")


def fingerprint(rows: DataFrame, recipe: dict) -> str:
    """A name for a training set and a recipe: order of rows and partitions does not matter, repeated rows count."""
    cells = [F.col(c).cast("string") for c in rows.columns]
    first, second = F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)
    got = rows.agg(F.count("*"), F.sum(first.cast("decimal(38,0)")), F.sum(second.cast("decimal(38,0)"))).first()
    text = json.dumps([[str(x) for x in got], rows.dtypes, sorted(recipe.items())])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def class_weights(counts: dict) -> dict:
    """A-07: ``n / (k * n_class)`` for the counted classes of a label (k of them)."""
    n = sum(counts.values())
    return {value: n / (len(counts) * c) for value, c in counts.items()}


def class_weight(counts: dict, label: str) -> Column:
    """A-07 as an expression (see :func:`class_weights`)."""
    out = F.lit(None).cast("double")
    for value, w in class_weights(counts).items():
        out = F.when(F.col(label) == value, F.lit(w)).otherwise(out)
    return out


class ModelRegistry:
    """The parts of one training set under ``root``; ``train`` is evaluated once, when the registry is opened."""

    def __init__(self, train: DataFrame, root: str, min_rows: int = C.MIN_TRAIN_ROWS, **recipe):
        self.spark = train.sparkSession
        self.files = _Files(self.spark)
        self.recipe = {**RECIPE, **recipe}
        self.features = feature_columns(train)
        incoming = f"{root.rstrip('/')}/incoming/{uuid.uuid4().hex}"
        train.select("match_id", *self.features, *C.TARGET_COLS).write.parquet(incoming)
        rows = self.spark.read.parquet(incoming)
        self.n_rows = rows.count()
        self.trainable = self.n_rows >= min_rows
        self.path = f"{root.rstrip('/')}/{fingerprint(rows, {**self.recipe, 'min_rows': min_rows})}"
        if self._committed("rows") is None:
            attempt = uuid.uuid4().hex
            self.files.move(incoming, f"{self.path}/rows/{attempt}")
            self.files.mark(f"{self.path}/rows/{attempt}.done")

    # --- parts -----------------------------------------------------------------------------------

    def _committed(self, part: str) -> str | None:
        done = [n for n in self.files.names(f"{self.path}/{part}") if n.endswith(".done")]
        return f"{self.path}/{part}/{done[0].removesuffix('.done')}" if done else None

    def _part(self, part: str, make: Callable[[str], None]) -> str:
        """The folder of a part; ``make(folder)`` writes it if no attempt is committed yet."""
        found = self._committed(part)
        if found is None:
            attempt = f"{self.path}/{part}/{uuid.uuid4().hex}"
            make(attempt)
            self.files.mark(f"{attempt}.done")
            found = self._committed(part)
        return found

    def ensure(self, parts: Iterable[tuple[str, str]]) -> None:
        """Have ``(market, "full")``, ``(market, "logit")`` and ``(market, "fold-<f>")`` parts, fitting what is missing."""
        wanted = [p for p in dict.fromkeys(parts) if self._committed("/".join(p)) is None]
        if not self.trainable or not wanted:
            return
        self._matrix()
        markets = list(dict.fromkeys(m for m, _ in wanted))
        with ThreadPoolExecutor(max_workers=len(markets)) as pool:
            list(pool.map(self.frame, markets))
        free = self.spark.sparkContext.defaultParallelism if self.partitions() == 1 else PARTS_AT_ONCE // self.partitions()
        jobs = max(2, min(MOST_JOBS, free))
        with ThreadPoolExecutor(max_workers=jobs) as pool:            # independent Spark jobs
            list(pool.map(lambda p: self._fit(*p), wanted))

    def full_parts(self, markets: Iterable[str] = tuple(ML.MARKETS)) -> list[tuple[str, str]]:
        return [(m, "full") for m in markets]

    def fold_parts(self, markets: Iterable[str]) -> list[tuple[str, str]]:
        return [(m, f"fold-{f}") for m in markets for f in range(self.recipe["folds"])]

    # --- training data ---------------------------------------------------------------------------

    def _matrix(self) -> str:
        def make(folder: str) -> None:
            rows = self.spark.read.parquet(self._committed("rows"))
            ML.medians_row(rows, self.features).write.parquet(f"{folder}/medians")
            medians = self.spark.read.parquet(f"{folder}/medians")
            ML.outcome_label(ML.impute_features(rows, self.features, medians)).write.parquet(f"{folder}/x")

        return self._part("matrix", make)

    def matrix(self) -> DataFrame:
        return self.spark.read.parquet(f"{self._matrix()}/x")

    def medians(self) -> DataFrame:
        return self.spark.read.parquet(f"{self._matrix()}/medians")

    def frame(self, market: str) -> DataFrame:
        """match_id, label, fold and the imputed features, in few partitions."""
        label = ML.MARKETS[market]

        def make(folder: str) -> None:
            x = self.matrix()
            folds = stratified_folds(x.select("match_id", label), "match_id", label, self.recipe["folds"], self.recipe["seed"])
            (x.select("match_id", F.col(label).cast("double").alias("label"), *self.features)
             .join(folds.select("match_id", "fold"), "match_id").repartition(self.partitions(), "match_id")
             .sortWithinPartitions("match_id").write.parquet(folder))

        return self.spark.read.parquet(self._part(f"{market}/frame", make))

    def partitions(self) -> int:
        return max(1, -(-self.n_rows * 8 * (len(self.features) + 3) // PART_BYTES))

    # --- fits ------------------------------------------------------------------------------------

    def _fit_forest(self, forest: Pipeline, weighted: DataFrame, counts: dict, market: str) -> PipelineModel:
        if self.partitions() == 1:
            return forest.fit(weighted)
        assemble, estimator = forest.getStages()
        path = f"{self.path}/work/{market}-{uuid.uuid4().hex}"
        return PipelineModel([assemble, fit_blocks(weighted, self.features, class_weights(counts), estimator, path)])

    def _fit(self, market: str, part: str) -> str:
        def make(folder: str) -> None:
            frame = self.frame(market)
            fold = int(part.removeprefix("fold-")) if part.startswith("fold-") else None
            rows = frame if fold is None else frame.where(F.col("fold") != fold)
            counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}       # k classes
            weighted = rows.coalesce(self.partitions()).withColumn("w", class_weight(counts, "label"))
            forest, logit = ML.market_pipelines(self.features, "label", sum(counts.values()), self.recipe["num_trees"],
                                                self.recipe["seed"], self.recipe)
            if part == "logit":
                model = logit.fit(weighted)
                self._logit_table(model).write.parquet(f"{folder}/coefficients")
                model.write().overwrite().save(f"{folder}/logit")
                return
            if fold is None:
                linear = PipelineModel.load(f"{self._fit(market, 'logit')}/logit")
                ML.SoftVote(self._fit_forest(forest, weighted, counts, market), linear, ML.N_CLASSES[market]).save(folder)
                return
            model = ML.SoftVote(self._fit_forest(forest, weighted, counts, market), logit.fit(weighted), ML.N_CLASSES[market])
            self._logit_table(model.logit).write.parquet(f"{folder}/coefficients")
            size = [(fold, *ML.forest_size(self.spark, model.forest))]
            self.spark.createDataFrame(size, "fold int, trees int, nodes int, split_trees int").write.parquet(f"{folder}/forest_size")
            probabilities = [f"p{c}" for c in range(ML.N_CLASSES[market])]
            scored = model.transform(frame.where(F.col("fold") == fold), keep_votes=True)
            scored.select("match_id", "label", "fold", *self.features, *probabilities, "rf_votes", "lr_votes").write.parquet(f"{folder}/scored")

        return self._part(f"{market}/{part}", make)

    def _logit_table(self, model: PipelineModel) -> DataFrame:
        """(class, feature, mean, std, coefficient): a row per class vector and feature, the intercept as ``feature`` null."""
        scaler, logit = model.stages[-2:]
        mean, std = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
        matrix, intercepts = logit.coefficientMatrix.toArray().tolist(), logit.interceptVector.toArray().tolist()
        rows = [(k, f, float(m), float(s), float(c)) for k, vector in enumerate(matrix) for f, m, s, c in zip(self.features, mean, std, vector)]
        rows += [(k, None, None, None, float(b)) for k, b in enumerate(intercepts)]
        return self.spark.createDataFrame(rows, "class int, feature string, mean double, std double, coefficient double").coalesce(1)

    # --- results ---------------------------------------------------------------------------------

    def model(self, market: str) -> "ML.SoftVote | None":
        """The pair fitted on all rows (fitted now if it is missing; None under the minimum of rows)."""
        self.ensure([(market, "full")])
        found = self._committed(f"{market}/full")
        return ML.SoftVote.load(found, ML.N_CLASSES[market]) if found else None

    def models(self) -> "dict[str, ML.SoftVote]":
        self.ensure(self.full_parts())
        return {m: model for m in ML.MARKETS if (model := self.model(m)) is not None}

    def folder(self, market: str, part: str = "full") -> str | None:
        """Where a part lies (fitted now if it is missing)."""
        self.ensure([(market, part)])
        return self._committed(f"{market}/{part}")

    def feature_table(self) -> DataFrame:
        """K-04: (market, feature, ord, median) of the markets with a saved model."""
        saved = [m for m in ML.MARKETS if self._committed(f"{m}/full")]
        lists = self.spark.createDataFrame([(m, c, i) for m in saved for i, c in enumerate(self.features)],
                                           "market string, feature string, ord int")
        return lists.join(self.medians().unpivot([], self.features, "feature", "median"), "feature", "left")

    def out_of_fold(self, market: str) -> DataFrame | None:
        """L-07: every row scored by the models of the other folds."""
        self.ensure(self.fold_parts([market]))
        return self._of_folds(market, "scored")

    def _of_folds(self, market: str, table: str) -> DataFrame | None:
        if not self.trainable:
            return None
        return self.spark.read.parquet(*[f"{self._committed(f'{m}/{p}')}/{table}" for m, p in self.fold_parts([market])])

    def forest_sizes(self, market: str) -> DataFrame | None:
        """(fold, trees, nodes, split_trees) of the cross-validation."""
        self.ensure(self.fold_parts([market]))
        return self._of_folds(market, "forest_size")

    def coefficients(self, market: str, part: str = "full") -> DataFrame:
        """The saved parameters of a fold's logistic regression, or of the one on all rows (which needs no forest)."""
        return self.spark.read.parquet(f"{self.folder(market, 'logit' if part == 'full' else part)}/coefficients")

    def summary(self) -> DataFrame:
        """L-04: one row per market after cross-validation and full fit of all three; empty under the minimum of rows."""
        if not self.trainable:
            return self.spark.createDataFrame([], ML.SUMMARY)
        self.ensure([*self.full_parts(), *self.fold_parts(ML.MARKETS)])
        out = None
        for market in ML.MARKETS:
            row = ML.cv_accuracy(self.out_of_fold(market), market, "label").agg(
                F.lit(market).alias("market"), F.lit(self.n_rows).cast("long").alias("n_rows"), F.lit(len(self.features)).alias("n_features"),
                F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))
            out = row if out is None else out.unionByName(row)
        return out
