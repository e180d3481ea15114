"""Gradient boosting with cross-validation, importances and leakage screens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.functions.numeric import numeric_columns, present, type_class
from plumbline.functions.ordered import positions
from plumbline.functions.trees import Forest
from plumbline.operators.explore import pearson
from plumbline.session import cut_lineage

MIN_ROWS = 20
MAX_FOLDS = 5
# Categories a tree may split on; their labels are kept on the driver.  A column
# with more of them is hashed to this many.
MAX_CATEGORIES = 255
# Rows of a block that changes values with all others, and rows that two large
# blocks send each other; a larger table has larger blocks.
BLOCK_ROWS = 1 << 16
SENT_ROWS = 1000


class TrainingError(ValueError):
    pass


@dataclass
class TrainingData:
    """Cleaned rows, written once and read by every later step."""

    rows: DataFrame
    target: str
    task: str
    numeric: list[str]
    categorical: list[str]
    count: int
    classes: int = 0
    max_bins: int = 32
    # numeric features with missing values, on which trees may split as such
    gaps: list[str] = field(default_factory=list)
    # mean target of a regression, about which squares are summed
    centre: float = 0.0
    features: list[str] = field(init=False)

    def __post_init__(self):
        self.features = [*self.numeric, *self.categorical]


def prepare(df: DataFrame, target: str, task: str = "regression", drop: list[str] | None = None) -> TrainingData:
    """Drop rows without a target, cast features and check what can be trained."""
    if task not in ("regression", "classification"):
        raise TrainingError(f"task {task} is neither regression nor classification")
    kept = df.drop(*(drop or []))
    if target not in kept.columns:
        raise TrainingError(f"no column {target} to learn")
    kept = kept.where(F.col(target).isNotNull())
    kinds = {f.name: type_class(f.dataType) for f in kept.schema.fields if f.name != target}
    categorical = [c for c, kind in kinds.items() if kind == "text"]
    numeric = [c for c, kind in kinds.items() if kind != "text"]
    if not kinds:
        raise TrainingError("No features to train on")

    def as_number(name: str) -> Column:
        if kinds[name] == "date":
            # A calendar value enters as its day number.
            return F.datediff(F.col(name), F.lit("1970-01-01").cast("date")).cast("double")
        return F.col(name).cast("double")

    label = F.col(target).cast("double") if task == "regression" or target in numeric_columns(kept) else F.col(target).cast("string")
    cleaned = kept.select(
        *[as_number(c).alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in categorical],
        label.alias(target),
    )
    # Folds and permutations follow from the row itself, not from files, tasks or cores.
    digest = F.md5(F.to_json(F.struct(*cleaned.columns)).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    rows = cut_lineage(cleaned.withColumn("_u", draw))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct(target, 0.01).alias("classes"),
        (F.avg(target) if task == "regression" else F.lit(0.0)).alias("centre"),
        *[F.approx_count_distinct(c, 0.01).alias(f"d_{c}") for c in categorical],
        *[F.count_if(~present(F.col(f"`{c}`"))).alias(f"m_{c}") for c in numeric],
    ).first()
    if facts["n"] < MIN_ROWS:
        raise TrainingError(f"fewer than {MIN_ROWS} rows with a target")
    wide = [c for c in categorical if facts[f"d_{c}"] > MAX_CATEGORIES]
    rows = rows.withColumns({c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(MAX_CATEGORIES)).cast("string")) for c in wide})
    if task == "classification" and facts["classes"] > MAX_CATEGORIES:
        raise TrainingError(f"Target {target} has more than {MAX_CATEGORIES} classes")
    widest = max([min(facts[f"d_{c}"], MAX_CATEGORIES) for c in categorical], default=0)
    return TrainingData(rows, target, task, numeric, categorical, facts["n"], facts["classes"], max(32, int(widest * 1.05) + 3), [c for c in numeric if facts[f"m_{c}"]], facts["centre"] or 0.0)


def _slots(data: TrainingData) -> list[str]:
    """Columns that make the vector of features, and then the marks of missing values."""
    return [*[f"{c}__filled" for c in data.numeric], *[f"{c}__index" for c in data.categorical], *[f"{c}__gap" for c in data.gaps]]


def _stages(data: TrainingData, max_iter: int, max_depth: int):
    indexed = [f"{c}__index" for c in data.categorical]
    filled = [f"{c}__filled" for c in data.numeric]
    gaps = [f"{c}__gap" for c in data.gaps]
    stages = []
    if gaps:
        marks = ", ".join(f"CAST(`{c}` IS NULL OR isnan(`{c}`) AS DOUBLE) AS `{g}`" for c, g in zip(data.gaps, gaps, strict=True))
        stages.append(SQLTransformer(statement=f"SELECT *, {marks} FROM __THIS__"))
    if data.categorical:
        stages.append(StringIndexer(inputCols=data.categorical, outputCols=indexed, handleInvalid="keep"))
    if data.numeric:
        stages.append(Imputer(inputCols=data.numeric, outputCols=filled, strategy="median"))
    stages.append(VectorAssembler(inputCols=_slots(data), outputCol="features"))
    label = data.target
    if data.task == "classification":
        stages.append(StringIndexer(inputCol=data.target, outputCol="label__index", stringOrderType="alphabetAsc"))
        label = "label__index"
    common = {"featuresCol": "features", "labelCol": label, "maxDepth": max_depth, "maxBins": data.max_bins, "seed": 42}
    if data.task == "regression":
        learner = GBTRegressor(maxIter=max_iter, **common)
    elif data.classes <= 2:
        learner = GBTClassifier(maxIter=max_iter, **common)
    else:
        # Boosted trees tell each class from the rest; the surest one wins.
        learner = OneVsRest(classifier=GBTClassifier(maxIter=max_iter, **common), featuresCol="features", labelCol=label, parallelism=2)
    return [*stages, learner], label


def _cells(rows: DataFrame, data: TrainingData, keys: list[str] | None = None) -> DataFrame:
    """Rows with equal features as one, weighing ``_weight``; ``_within`` is their squared distance from the mean target.

    Trees see features alone, and squared loss sees of the targets of equal rows
    their mean and number, so a fit on cells is the fit on rows.  Classes are a key.
    """
    target, weight = F.col(data.target), F.count(F.lit(1)).cast("double").alias("_weight")
    if data.task == "classification":
        return rows.groupBy(*(keys or []), *data.features, data.target).agg(weight, F.lit(0.0).alias("_within"))
    within = (F.var_pop(target) * F.count(target)).alias("_within")
    return rows.groupBy(*(keys or []), *data.features).agg(F.avg(target).alias(data.target), weight, within)


def _halved(cells: DataFrame, bins: int) -> DataFrame:
    """Trees get no more bins than they see rows, and every category needs one; fewer cells come twice with half their weight, and so on."""
    times = max(0, math.ceil(math.log2(bins / max(1, cells.count()))))
    if not times:
        return cells
    copies = F.array_repeat(F.col("_weight") * F.lit(0.5**times), 2**times)
    return cells.withColumn("_weight", F.explode(copies))


def _fit_cells(rows: DataFrame, cells: DataFrame, stages: list) -> PipelineModel:
    """Medians and categories from ``rows``, trees from ``cells``."""
    prepared = Pipeline(stages=stages[:-1]).fit(rows)
    learner = stages[-1].copy()
    learner.set(learner.weightCol, "_weight")
    trees = learner.getClassifier() if isinstance(learner, OneVsRest) else learner
    return PipelineModel([*prepared.stages, learner.fit(prepared.transform(_halved(cells, trees.getMaxBins())))])


def _spread_out(cells: DataFrame) -> DataFrame:
    """Cells written out; too few partitions would leave cores idle in every boosting round."""
    written = cut_lineage(cells)
    cores = cells.sparkSession.sparkContext.defaultParallelism
    return written if written.rdd.getNumPartitions() >= cores else cut_lineage(written.repartition(cores))


def fit(data: TrainingData, max_iter: int = 100, max_depth: int = 5) -> PipelineModel:
    """Boosted trees; with more than two classes one series of trees for each class against the rest.

    Missing numbers count as the median, and a mark beside them lets a tree tell them apart.
    """
    return _fit_cells(data.rows, _spread_out(_cells(data.rows, data)), _stages(data, max_iter, max_depth)[0])


def cv_score(data: TrainingData, max_iter: int = 100, max_depth: int = 5, parallelism: int = 2) -> DataFrame:
    """Mean and standard deviation of R2 or accuracy over min(5, n // 4) folds."""
    folds = min(MAX_FOLDS, data.count // 4)
    stages, label = _stages(data, max_iter, max_depth)
    rows = data.rows.withColumn("_fold", F.least(F.floor(F.col("_u") * folds), F.lit(folds - 1)).cast("int"))
    cells = _spread_out(_cells(rows, data, ["_fold"]))

    def score(fold: int) -> float:
        train, held_out = F.col("_fold") != fold, F.col("_fold") == fold
        model = _fit_cells(rows.where(train), cells.where(train), stages)
        return float(_scores(model.transform(cells.where(held_out)), label, data, []).first()["score"])

    with ThreadPool(parallelism) as pool:
        scores = pool.map(inheritable_thread_target(rows.sparkSession)(score), range(folds))
    metric = "r2" if data.task == "regression" else "accuracy"
    record = (data.task, metric, folds, data.count, float(np.mean(scores)), float(np.std(scores)))
    return rows.sparkSession.createDataFrame(
        [record], "task string, metric string, folds int, n_samples bigint, cv_mean double, cv_std double"
    )


def tree_importance(data: TrainingData, model: PipelineModel) -> DataFrame:
    """Share of the impurity decrease per feature, its mark of missing values included, largest first."""
    learner = model.stages[-1]
    models = getattr(learner, "models", [learner])
    shares = sum(m.featureImportances.toArray() for m in models) / len(models)
    total = dict.fromkeys(data.features, 0.0)
    for name, share in zip([*data.features, *data.gaps], shares, strict=True):
        total[name] += float(share)
    pairs = sorted(total.items(), key=lambda p: (-p[1], p[0]))
    return data.rows.sparkSession.createDataFrame(
        [(i, name, share) for i, (name, share) in enumerate(pairs, 1)], "rank int, feature string, importance double"
    )


def _placed(rows: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Rows numbered in a random order, and their count."""
    placed = cut_lineage(positions(rows.withColumn("_draw", F.xxhash64(F.lit(seed), "_u")), [], ["_draw", "_u"]).drop("_draw"))
    return placed, max(1, placed.count())


def _step(n: int, repeat: int) -> tuple[int, int]:
    """k and c of i * k + c modulo n, which takes every number once; another k in every repeat."""
    k = next(k for k in range(max(1, int(n * (0.6180339887 + 0.3 * repeat) % n)), 2 * n + 1) if math.gcd(k, n) == 1)
    return k, n // 3 + 1


def _with_other(rows: DataFrame, features: list[str], seed: int, repeat: int = 0) -> DataFrame:
    """Adds ``_other``: the features of another row, each row serving once.

    Number i takes from i * k + c modulo the count, which sends equal rows,
    neighbours in the order, all over the table.  This form moves whole rows;
    ``permutation_importance`` exchanges codes of the same rows.
    """
    placed, n = _placed(rows, seed)
    k, c = _step(n, repeat)
    source = F.pmod(F.col("pos").cast("decimal(38,0)") * F.lit(k) + F.lit(c), F.lit(n)).cast("bigint")
    other = placed.select(F.col("pos").alias("_from"), F.struct(*features).alias("_other"))
    return placed.withColumn("_from", source).join(other, "_from").drop("_from", "pos")


def _forest(data: TrainingData, learner) -> Forest:
    texts = [m.toDebugString for m in getattr(learner, "models", [learner])]
    return Forest(texts, len(_slots(data)), data.task == "regression")


def _target_type(data: TrainingData) -> str:
    return "<f8" if data.task == "regression" else "<u2"


def _blocks(data: TrainingData, prepared: PipelineModel, label: str, forest: Forest, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows in the order of ``_placed``, one row a block: targets and packed codes; and the rows of each block.

    Equal rows may stand in any order, so a number that tells them apart lets a
    block end among them.
    """
    kind, width = _target_type(data), forest.width

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            packed = forest.pack(forest.codes([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]))
            codes = _cut(packed, np.arange(batch.num_rows + 1) * width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], codes], ["_u", "y", "codes"])

    def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ys, codes = 0, [], []
        for batch in parts:
            if batch.num_rows:
                block = batch.column(0)[0].as_py()
                ys.append(batch.column(1).to_numpy(zero_copy_only=False).astype(kind))
                codes.extend(batch.column(2).to_pylist())
        if ys:
            y = np.concatenate(ys)
            columns = [pa.array([block], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([y.tobytes()], pa.binary()), pa.array([b"".join(codes)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "rows", "y", "codes"])

    draw = F.xxhash64(F.lit(seed), "_u")
    rows = prepared.transform(data.rows).select("_u", F.col(label).cast("double").alias("y"), *_slots(data))
    number = math.ceil(data.count / max(BLOCK_ROWS, math.isqrt(SENT_ROWS * data.count)))
    ranges = rows.mapInArrow(coded, "_u double, y double, codes binary").repartitionByRange(number, draw, F.monotonically_increasing_id())
    sorted_ = ranges.sortWithinPartitions(draw, "_u").select(F.spark_partition_id().alias("block"), "y", "codes")
    blocks = cut_lineage(sorted_.mapInArrow(gathered, "block int, rows bigint, y binary, codes binary"))
    return blocks, {r.block: r.rows for r in blocks.select("block", "rows").orderBy("block").collect()}


def _cut(packed: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values from bytes that lie one behind the other."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed))])


_SENT = "block int, repeat int, source bigint, y binary, codes binary"


def _exchanged(blocks: DataFrame, sizes: dict[int, int], width: int, bytes_y: int, repeats: int) -> DataFrame:
    """To each block its own rows, under repeat -1, and for every repeat the codes its rows take from each block, in their order.

    Which row takes which follows from the numbers of both, so only codes are sent.
    """
    ids, ends = np.array([*sizes], np.int32), np.cumsum([0, *sizes.values()])
    n = int(ends[-1])

    def sent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "repeat", "source", "y", "codes"]
        for batch in parts:
            for i in range(batch.num_rows):
                block, rows, y, codes = (batch.column(c)[i].as_py() for c in ("block", "rows", "y", "codes"))
                first = int(ends[np.searchsorted(ids, block)])
                for a in range(0, rows, BLOCK_ROWS):
                    own = (y[a * bytes_y : (a + BLOCK_ROWS) * bytes_y], codes[a * width : (a + BLOCK_ROWS) * width])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([-1], pa.int32()), pa.array([a], pa.int64()), *[pa.array([v], pa.binary()) for v in own]], names)
                packed = np.frombuffer(codes, np.uint8).reshape(rows, width)
                for repeat in range(repeats):
                    k, c = _step(n, repeat)
                    back = pow(k, -1, n)
                    to = ((first - c) * back % n + np.arange(rows) * back) % n
                    order = np.argsort(to)
                    cuts = np.searchsorted(to[order], ends)
                    columns = [pa.array(ids), pa.array(np.full(len(ids), repeat, np.int32)), pa.array(np.full(len(ids), block, np.int64)), pa.nulls(len(ids), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, _cut(packed[order], cuts * width)], names)

    return blocks.mapInArrow(sent, _SENT).repartition(len(sizes), "block")


def _taken(group: pa.Table, sizes: dict[int, int], width: int, repeats: int) -> Iterator[np.ndarray]:
    """Packed codes of the rows of a block, then for every repeat those of the rows they take from."""
    ids, ends = np.array([*sizes], np.int32), np.cumsum([0, *sizes.values()])
    n, block = int(ends[-1]), group.column("block")[0].as_py()
    first, rows = int(ends[np.searchsorted(ids, block)]), sizes[block]
    repeat_of, source_of = (group.column(c).to_numpy() for c in ("repeat", "source"))

    def joined(repeat: int) -> np.ndarray:
        own = np.flatnonzero(repeat_of == repeat)
        own = own[np.argsort(source_of[own])]
        return np.frombuffer(b"".join(group.column("codes")[int(i)].as_py() for i in own), np.uint8).reshape(rows, width)

    yield joined(-1)
    for repeat in range(repeats):
        k, c = _step(n, repeat)
        source = ((first * k + c) % n + np.arange(rows) * (k % n)) % n
        taken = np.empty((rows, width), np.uint8)
        taken[np.argsort(np.searchsorted(ends, source, "right"), kind="stable")] = joined(repeat)
        yield taken


def permutation_importance(data: TrainingData, model: PipelineModel, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean drop of the score when one feature's values change places.

    In every repeat each row takes the feature value of another row of the whole
    table, so all values stay in use and no task holds the whole column.  Rows
    are numbered once for all repeats.  They travel as the numbers of the bins
    that the trees tell apart, a few bytes each, and are scored where they arrive.
    """
    prepared, learner = PipelineModel(model.stages[:-1]), model.stages[-1]
    forest, kind, centre = _forest(data, learner), np.dtype(_target_type(data)), data.centre
    blocks, sizes = _blocks(data, prepared, learner.getOrDefault("labelCol"), forest, seed)
    owners = [*data.features, *data.gaps]
    slots = [[i for i, owner in enumerate(owners) if owner == feature] for feature in data.features]

    def scored(group: pa.Table) -> pa.Table:
        parts = sorted((a, y) for a, r, y in zip(*(group.column(c).to_pylist() for c in ("source", "repeat", "y")), strict=True) if r == -1)
        y = np.frombuffer(b"".join(p for _, p in parts), kind).astype(float)
        taken = _taken(group, sizes, forest.width, repeats)
        own = forest.unpack(next(taken))

        def errors(codes: list[np.ndarray]) -> np.ndarray:
            guess = forest.predict(codes)
            return (y - guess) ** 2 if forest.regression else (y != guess).astype(float)

        before = errors(own)
        d = y - centre
        found = [(-1, -1, float(len(y)), float(d.sum()), float((d * d).sum()))]
        for repeat, packed in enumerate(taken):
            other = forest.unpack(packed)
            for feature, places in enumerate(slots):
                lost = errors([other[i] if i in places else c for i, c in enumerate(own)]) - before
                found.append((repeat, feature, float(lost.sum()), 0.0, 0.0))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), *[pa.float64()] * 3), strict=True)], ["repeat", "feature", "a", "b", "c"])

    sent = _exchanged(blocks, sizes, forest.width, kind.itemsize, repeats)
    sums = sent.groupBy("block").applyInArrow(scored, "repeat int, feature int, a double, b double, c double").groupBy("repeat", "feature").agg(*[F.sum(c).alias(c) for c in "abc"])
    total = {(r.repeat, r.feature): (r.a, r.b, r.c) for r in sums.collect()}
    n, d, dd = total[-1, -1]
    spread = dd - d * d / n if data.task == "regression" else n
    result = []
    for i, feature in enumerate(data.features):
        drops = [total[repeat, i][0] / spread for repeat in range(repeats)] if spread else []
        result.append((feature, float(np.mean(drops)) if drops else None, float(np.std(drops)) if drops else None, repeats))
    return data.rows.sparkSession.createDataFrame(result, "feature string, importance double, importance_std double, repeats bigint")


def _scores(predicted: DataFrame, label: str, data: TrainingData, groups: list[str]) -> DataFrame:
    """R2 or accuracy over predicted cells, as over the rows they stand for."""
    y, yhat, weight = F.col(label), F.col("prediction"), F.col("_weight")
    if data.task == "regression":
        d = y - F.lit(data.centre)
        parts = predicted.groupBy(*groups).agg(
            (F.sum(weight * (y - yhat) ** 2) + F.sum("_within")).alias("error"),
            (F.sum(weight * d * d) - F.sum(weight * d) ** 2 / F.sum(weight) + F.sum("_within")).alias("spread"),
        )
        return parts.select(*groups, (1.0 - F.try_divide("error", "spread")).alias("score"))
    return predicted.groupBy(*groups).agg((F.sum(F.when(y == yhat, weight).otherwise(0.0)) / F.sum(weight)).alias("score"))


def train_score(data: TrainingData, model: PipelineModel) -> float:
    _, label = _stages(data, 1, 1)
    return float(_scores(model.transform(_cells(data.rows, data)), label, data, []).first()["score"])


def train_gradient_boosting(
    df: DataFrame,
    target: str,
    task: str = "regression",
    drop: list[str] | None = None,
    max_iter: int = 100,
    max_depth: int = 5,
) -> DataFrame:
    """Cross-validated score and tree importances, one row per feature."""
    data = prepare(df, target, task, drop)
    model = fit(data, max_iter, max_depth)
    score = cv_score(data, max_iter, max_depth).first()
    return tree_importance(data, model).select(
        "rank", "feature", "importance", *[F.lit(score[c]).alias(c) for c in score.__fields__]
    )


def leaking_features(importance: DataFrame, target: str, threshold: float = DEFAULTS.leakage_importance) -> DataFrame:
    """Features that are the target itself or carry nearly all importance."""
    reason = F.when(F.col("feature") == target, "target among features").when(
        F.col("importance") >= threshold, "dominant importance"
    )
    return importance.withColumn("reason", reason).where("reason is not null")


def leakage_screen(df: DataFrame, target: str, threshold: float = DEFAULTS.leakage_importance) -> DataFrame:
    """Correlation of every numeric feature with the target, from one aggregation."""
    features = [c for c in numeric_columns(df) if c != target]
    wide = df.agg(*[pearson(F.col(f"`{c}`"), F.col(f"`{target}`")).alias(f"r{i}") for i, c in enumerate(features)])
    cells = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"r{i}"), F.lit(0.0)).alias("r")) for i, c in enumerate(features)]
    return wide.select(F.inline(F.array(*cells))).withColumn("leaks", F.abs("r") >= threshold)
