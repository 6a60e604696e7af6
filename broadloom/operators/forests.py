"""All-relevant selection and recursive elimination over forests.

The forests of an elimination's resamples grow together (:mod:`broadloom.operators.grown`), and so do those of a selection's runs
that need not wait for each other (:mod:`broadloom.operators.shadowed`): a pass over the rows, binned and kept once, per level.
What comes back to the driver are splits and one importance per run and column.

Importance is Spark's impurity importance, or with ``importance="permutation"`` the loss that held-out rows gain when
a column is permuted, mean over spread of the trees (:mod:`broadloom.operators.permutation`).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from broadloom.functions import cells
from broadloom.operators import dictionary, fits, grown, importance as imp, shadowed
from broadloom.operators.joins import assert_unique
from broadloom.operators.selectors import col
from broadloom.operators.shadows import ROWS_PER_BLOCK
from broadloom.operators.splitting import fold
from broadloom.session import shared_path, stage

LEAST_SHADOWS = 5


@dataclass(frozen=True)
class Forest:
    """Forest settings. A 0/1 number is a numeric response (regression); classes need ``classes=True``.

    Several trees see a bag of the rows each, a single tree all rows.
    """

    classes: bool = False
    trees: int = 50
    depth: int = 6
    bins: int = 32
    seed: int = 12345
    #: Rows of a training partition of a single fit by Spark, which bags by partition; forests that grow together do not.
    rows_per_partition: int = 50_000
    #: ``impurity``, or ``permutation`` on the third of the rows that a run then holds out.
    importance: str = "impurity"

    def __post_init__(self):
        if self.importance not in ("impurity", "permutation"):
            raise ValueError(f"unknown importance: {self.importance}")

    def estimator(self, run: int):
        make = RandomForestClassifier if self.classes else RandomForestRegressor
        return make(
            featuresCol="features", labelCol="label", numTrees=self.trees, maxDepth=self.depth,
            maxBins=self.bins, seed=self.seed + run, cacheNodeIds=False, bootstrap=self.trees > 1,
        )


def model_table(df: DataFrame, key: str, target: str, fields: Sequence[str], classes: bool) -> DataFrame:
    """``(key, label, fields…)`` as doubles, missing numbers encoded; the fields must be listed."""
    unknown = [f for f in fields if f in (key, target)]
    if unknown:
        raise ValueError(f"key and target cannot be features: {unknown}")
    filled = [_filled(f).alias(f) for f in fields]
    if not classes:
        return df.select(col(key), col(target).cast("double").alias("label"), *filled)
    # classes are numbered in name order by a joined dictionary, whatever their number
    rows = stage(df.select(col(key), col(target).cast("string").alias("__class"), *filled), "classed")
    numbered = dictionary.with_level(rows, "__class", dictionary.levels(rows, ["__class"]), "label")
    missing = F.raise_error(F.lit(f"a missing class in {target}")).cast("double")
    return numbered.select(col(key), F.coalesce(F.col("label").cast("double"), missing).alias("label"), *[col(f) for f in fields])


def _filled(field: str):
    value = F.nullif(col(field).cast("double"), F.lit(float("nan")))
    return F.coalesce(value, F.lit(float(cells.MISSING_NUMBER)))


def _fitted(forest: Forest, rows: DataFrame, inputs: Sequence[str], run: int):
    """A forest over placed rows; ``label`` is the response."""
    assembled = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(rows)
    return forest.estimator(run).fit(assembled.select("label", "features"))


def _importances(forest: Forest, rows: DataFrame, inputs: Sequence[str], run: int):
    model = _fitted(forest, rows, inputs, run)
    return model, dict(zip(inputs, model.featureImportances.toArray().tolist()))


@dataclass
class Relevance:
    """Result of an all-relevant selection: the importance history and one row per field."""

    history: DataFrame
    fields: DataFrame


def all_relevant(
    df: DataFrame,
    key: str,
    target: str,
    fields: Sequence[str],
    max_runs: int = 100,
    forest: Forest = Forest(),
    rows_per_block: int = ROWS_PER_BLOCK,
    slots: int = fits.SLOTS,
) -> Relevance:
    """Compare every field with shuffled copies of all fields over repeated forests.

    A field scores a hit when it beats the best shadow of a run. Two binomial tests, corrected for the
    number of fields, confirm or reject it; rejected fields leave the next forests. At most
    ``max_runs - 1`` forests are grown, together where none of them can wait for a verdict of another
    (``slots`` is kept for callers and changes nothing).
    With few runs and many fields nothing can be confirmed: the result is then a ranking, and ``decision`` is
    only a column.
    """
    table = assert_unique(stage(model_table(df, key, target, fields, forest.classes), "features"), key)
    blocks = shadowed.blocks(table, key, ["label"], fields, forest.seed, forest.bins, rows_per_block)
    try:
        return _relevance(blocks, "label", list(fields), max_runs, forest)
    finally:
        blocks.unpersist()


def _certain_runs(hit_count: dict[str, int], done: int, tentative: list[str], fields: int) -> int:
    """Runs that come before any tentative field can be decided, whatever their hits; they need not wait for each other."""
    ahead = 1
    while not any(imp.decide(hit_count[f] + h, done + ahead, fields) != "Tentative" for f in tentative for h in (0, ahead)):
        ahead += 1
    return ahead


def _relevance(blocks: shadowed.Blocks, label: str, fields: list[str], max_runs: int, forest: Forest) -> Relevance:
    spark = blocks.packed.sparkSession
    hit_count = dict.fromkeys(fields, 0)
    decided = dict.fromkeys(fields, "Tentative")
    history: list[tuple[int, str, float, bool]] = []
    done = 0
    while done < max_runs - 1:
        active = [f for f in fields if decided[f] != "Rejected"]
        tentative = [f for f in fields if decided[f] == "Tentative"]
        if not active or not tentative:
            break
        ahead = min(_certain_runs(hit_count, done, tentative, len(fields)), max_runs - 1 - done)

        runs = range(done + 1, done + ahead + 1)
        copies = {run: [run + k * max_runs for k in range(math.ceil(LEAST_SHADOWS / len(active)))] for run in runs}
        for run, (shadows, found) in shadowed.importances(blocks, label, active, copies, forest).items():
            best = max(found[s] for s in shadows)
            history += [(run, f, found[f], False) for f in active] + [(run, s, found[s], True) for s in shadows]
            for f in active:
                hit_count[f] += found[f] > best
        done += ahead
        for f in tentative:
            decided[f] = imp.decide(hit_count[f], done, len(fields))
    table = spark.createDataFrame(history, imp.HISTORY)
    words = spark.createDataFrame([(f, decided[f]) for f in fields], "field string, decision string")
    stats = imp.statistics(imp.hits(table), max(done, 1))
    return Relevance(table, words.join(stats, "field", "left"))


def chunked_relevance(
    df: DataFrame,
    key: str,
    targets: Iterable[str],
    chunks: Mapping[int, Sequence[str]],
    max_runs: int = 11,
    forest: Forest = Forest(),
    rows_per_block: int = ROWS_PER_BLOCK,
    folder: str | None = None,
    slots: int = fits.SLOTS,
) -> DataFrame:
    """All-relevant selection per numeric target and column chunk: ``(target, chunk, field, …)``.

    ``df`` is run once, into a stage with all columns, and its blocks hold the columns of all chunks and all targets, so the
    data is exchanged once, not once per chunk, target and run. Targets and chunks are independent, ``slots`` of
    them run at once. With ``folder`` each result is saved as it is found, and a job that starts again with the same
    folder and settings goes on with what is missing; other results there are left alone.
    """
    spark, targets = df.sparkSession, list(targets)
    folder = folder or shared_path(spark, "relevance")
    settings = {(t, c): _settings(t, c, list(f), max_runs, forest, rows_per_block) for t in targets for c, f in chunks.items()}
    done = _saved(spark, folder)
    missing = [(c, t) for c in sorted(chunks) for t in targets if settings[t, c] not in done]
    if missing:
        every = list(dict.fromkeys(f for c, _ in missing for f in chunks[c]))
        labels = [col(t).cast("double").alias(t) for t in targets if t not in every]
        numbers = df.select(col(key), *labels, *[_filled(f).alias(f) for f in every])
        staged = assert_unique(stage(numbers, "features"), key)
        blocks = shadowed.blocks(staged, key, targets, every, forest.seed, forest.bins, rows_per_block)

        def select(chunk: int, target: str) -> None:
            found = _relevance(blocks, target, list(chunks[chunk]), max_runs, forest).fields
            labelled = found.select(F.lit(target).alias("target"), F.lit(chunk).alias("chunk"), "*")
            # one row per field; a folder of its own, as jobs end side by side
            labelled.coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings={settings[target, chunk]}")

        try:
            fits.concurrently(spark, [lambda c=c, t=t: select(c, t) for c, t in missing], slots)
        finally:
            blocks.unpersist()
    asked = F.col("settings").isin(sorted(settings.values()))
    return spark.read.parquet(folder).where(asked).drop("settings")


def _settings(target: str, chunk: int, fields: list[str], max_runs: int, forest: Forest, rows_per_block: int) -> str:
    """A digest of all that a saved result depends on, besides the data."""
    return "s" + hashlib.sha256(repr(("grown together", target, chunk, fields, max_runs, forest, rows_per_block)).encode()).hexdigest()


def _saved(spark, folder: str) -> set[str]:
    """The settings whose results a folder already has: one for each target and chunk of earlier jobs."""
    try:
        saved = spark.read.parquet(folder)
    except AnalysisException:  # nothing saved yet
        return set()
    return {r["settings"] for r in saved.select("settings").distinct().collect()}


@dataclass
class Elimination:
    """Result of a recursive elimination: metrics per subset size and the chosen fields."""

    resamples: DataFrame
    profile: DataFrame
    selected: list[str]


def recursive_elimination(
    df: DataFrame,
    key: str,
    target: str,
    fields: Sequence[str],
    sizes: Iterable[int],
    folds: int = 5,
    repeats: int = 5,
    forest: Forest = Forest(),
    slots: int = fits.SLOTS,
) -> Elimination:
    """Repeated cross-validation over subset sizes.

    In each resample a forest on all fields ranks them, and forests on the best ``size`` fields are
    scored on the held-out fold. The size with the best mean score wins; its fields are the best by
    mean importance over the resamples. Ranks are by impurity.

    The forests of all resamples grow together (:mod:`broadloom.operators.grown`): a pass over the rows per level and
    size, whatever the number of resamples. ``slots`` is kept for callers and changes nothing.
    """
    fields = list(fields)
    spark = df.sparkSession
    numbers = [fold(col(key), folds, forest.seed, r).alias(f"__fold_{r}") for r in range(repeats)]
    table = assert_unique(stage(model_table(df, key, target, fields, forest.classes), "features"), key)
    steps = sorted({s for s in sizes if s < len(fields)} | {len(fields)}, reverse=True)
    classes = int(table.agg(F.max("label")).first()[0] or 0) + 1 if forest.classes else 0
    flags = not forest.classes and bool(table.agg(F.bool_and(F.col("label").isin(0.0, 1.0))).first()[0])
    pairs = [(r, h) for r in range(repeats) for h in range(folds)]
    packed = grown.blocks(table, key, fields, numbers, table.count(), forest.bins)
    scores: list[tuple[int, int, int, str, float]] = []
    ordered, found = {p: list(range(len(fields))) for p in pairs}, {}
    try:
        for size in steps:
            model, shares = grown.grow(packed, forest, classes, flags, {p: ordered[p][:size] for p in pairs}, repeats, folds, len(fields))
            if size == len(fields):
                found = {p: dict(zip(fields, shares[p].tolist())) for p in pairs}
                ordered = {p: sorted(range(len(fields)), key=lambda i: (-shares[p][i], fields[i])) for p in pairs}
            for p, sums in grown.scores(packed, forest, classes, model, repeats, len(fields)).items():
                scores += [(*p, size, m, v) for m, v in _metrics(sums, classes).items()]
    finally:
        packed.unpersist()
    ranks = {f: sum(found[p][f] for p in pairs) for f in fields}
    resamples = spark.createDataFrame(scores, "repeat int, fold int, size int, metric string, value double")
    profile = resamples.groupBy("size", "metric").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"))
    lead = "Accuracy" if forest.classes else "RMSE"
    means = {s: sum(v for *_, z, m, v in scores if z == s and m == lead) for s in steps}
    best = min(sorted(means), key=lambda s: -means[s] if forest.classes else means[s])
    return Elimination(resamples, profile, sorted(fields, key=lambda f: (-ranks[f], f))[:best])


def _metrics(sums, classes: int) -> dict[str, float]:
    """Metrics of a resample from its sums (:func:`grown.scores`)."""
    if classes:
        return _agreement([(i // classes, i % classes, int(n)) for i, n in enumerate(sums) if n])
    n, squares, absolute, p, y, pp, yy, py, low, high = sums.tolist()
    if not n:
        return {}
    out = {"RMSE": math.sqrt(squares / n), "MAE": absolute / n}
    across = yy - y * y / n
    if low < high:
        out["Rsquared"] = (py - p * y / n) ** 2 / ((pp - p * p / n) * across) if across > 0 else 1.0
    return out


def _scores(seen: DataFrame, classes: bool) -> dict[str, float]:
    if not classes:
        raise ValueError("numbers are scored by their sums")
    return _agreement([(c["label"], c["prediction"], c["count"]) for c in seen.groupBy("label", "prediction").count().collect()])


def _agreement(pairs: Sequence[tuple[float, float, int]]) -> dict[str, float]:
    """Accuracy and kappa from the rows per class and prediction."""
    total = sum(n for *_, n in pairs)
    if not total:
        return {}
    hit = sum(n for a, b, n in pairs if a == b) / total
    actual, guessed = {}, {}
    for a, b, n in pairs:
        actual[a] = actual.get(a, 0) + n
        guessed[b] = guessed.get(b, 0) + n
    chance = sum(n * guessed.get(k, 0) for k, n in actual.items()) / total**2
    return {"Accuracy": hit, "Kappa": (hit - chance) / (1 - chance) if chance < 1 else 0.0}
