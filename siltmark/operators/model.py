"""Training tables, splits, preprocessing, training, scoring and the model registry."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.config import Feature, categorical, numerical
from siltmark.functions.columns import NUMBER_PATTERN, nan_to_null, numeric
from siltmark.operators.baseline import build_baseline, lowest_keys, sampling_key
from siltmark.operators.longform import to_long_numerical
from siltmark.operators.profile import categorical_profile, medians
from siltmark.sources.partitions import event_time
from siltmark.sources.workspace import stored

#: Rows of a file of a table that many passes read: a table of one row group would be one task in each of them.
PASS_ROWS = 100_000
MIN_RECENT_ROWS = 100


def training_label(df: DataFrame) -> Column:
    """Known label, else ``target``, else score >= 0.5, else 0."""
    tries = [F.col(c) for c in ("prediction_label", "target") if c in df.columns]
    if "prediction_score" in df.columns:
        tries.append((numeric(df, "prediction_score") >= 0.5).cast("int"))
    return F.coalesce(*[t.cast("int") for t in tries], F.lit(0))


def recent_logs(logs: DataFrame, now: str, days: int = 7, time_column: str = "timestamp") -> DataFrame:
    """Logs of the ``days`` up to ``now``, both ends included."""
    at, end = event_time(logs, time_column), F.lit(now).cast("timestamp")
    return logs.filter((at >= end - F.make_dt_interval(F.lit(days))) & (at <= end))


def training_set(
    base: DataFrame, logs: DataFrame | None, features: Iterable[Feature], keep: Sequence[str] = (),
    now: str | None = None, days: int = 7, time_column: str = "timestamp",
) -> DataFrame:
    """Baseline rows plus recent logs (if there are at least 100), features and label.

    With ``now``, logs are recent within ``days`` of it; without, all given logs are.
    """
    both = base.withColumn("_recent", F.lit(False))
    if logs is not None and now:
        logs = recent_logs(logs, now, days, time_column)
    if logs is not None:
        enough = logs.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_RECENT_ROWS)
        recent = logs.join(F.broadcast(enough)).drop("_n")  # one row, or none
        both = both.unionByName(recent.withColumn("_recent", F.lit(True)), allowMissingColumns=True)
    names = [f.name for f in features]
    return both.select(*keep, *names, training_label(both).alias("label"))


def stratified_split(
    df: DataFrame, label: str, identity: Sequence[str], fraction: float = 0.25, seed: int = 42
) -> DataFrame:
    """Add ``is_validation``: the share ``fraction`` of every class, chosen by hash order."""
    key = sampling_key([F.col(c) for c in identity], seed)
    wanted = F.round(F.lit(fraction) * F.col("_n"))
    return lowest_keys(df, key, wanted, [label]).withColumnRenamed("_picked", "is_validation")


def imputation_stats(df: DataFrame, features: Iterable[Feature]) -> DataFrame:
    """``feature, median, mean, std``: exact median; mean and population std after filling."""
    long = to_long_numerical(df, list(features))
    mid = medians(long)
    filled = long.join(F.broadcast(mid), "feature").select(
        "feature", "median", F.coalesce("value", "median").alias("v")
    )
    return filled.groupBy("feature", "median").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )


def impute_and_scale(df: DataFrame, features: Iterable[Feature]) -> DataFrame:
    """Numerical features filled with the median and standardized (lazy form)."""
    nums = numerical(features)
    stats = imputation_stats(df, nums)
    one = stats.agg(*[
        F.max(F.when(F.col("feature") == f.name, F.col(c))).alias(f"_{c}_{f.name}")
        for f in nums for c in ("median", "mean", "std")
    ])
    joined = df.join(F.broadcast(one))  # one row
    out = {
        f.name: (F.coalesce(numeric(df, f.name), F.col(f"_median_{f.name}"))
                 - F.col(f"_mean_{f.name}"))
        / F.when(F.col(f"_std_{f.name}") > 0, F.col(f"_std_{f.name}")).otherwise(1.0)
        for f in nums
    }
    return joined.withColumns(out).select(*df.columns)


def _number(df: DataFrame, name: str) -> str:
    """SQL of a cell as a number: NULL for NaN and for text that is none, as in ``numeric``."""
    if dict(df.dtypes)[name] == "string":
        return f"CASE WHEN `{name}` RLIKE r'{NUMBER_PATTERN}' THEN try_cast(trim(`{name}`) AS DOUBLE) END"
    return f"nanvl(CAST(`{name}` AS DOUBLE), CAST(NULL AS DOUBLE))"


def preprocessing(df: DataFrame, features: Iterable[Feature]) -> Pipeline:
    """Unfitted ML pipeline up to the vector column ``features``.

    Fill values and scales are learned here (a few numbers per feature reach the
    driver) and become a SQL stage, so the saved model needs no custom class.
    """
    features = list(features)
    nums, cats = numerical(features), categorical(features)
    stats = {r["feature"]: r for r in imputation_stats(df, nums).collect()}
    modes = {
        r["feature"]: r["top_category"] for r in categorical_profile(df, cats).collect()
    } if cats else {}
    parts = ["*"]
    for f in nums:
        s = stats.get(f.name) or dict.fromkeys(("median", "mean", "std"))
        middle, mean = (0.0 if s[c] is None else s[c] for c in ("median", "mean"))  # all missing: a constant
        parts.append(
            f"(coalesce({_number(df, f.name)}, {middle!r}D) - {mean!r}D) / {(s['std'] or 1.0)!r}D AS `_num_{f.name}`"
        )
    for f in cats:
        mode = (modes.get(f.name) or "").replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"coalesce(CAST(`{f.name}` AS STRING), '{mode}') AS `_cat_{f.name}`")
    stages: list = [SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__")]
    inputs = [f"_num_{f.name}" for f in nums]
    if cats:
        raw = [f"_cat_{f.name}" for f in cats]
        index = [f"_idx_{f.name}" for f in cats]
        hot = [f"_hot_{f.name}" for f in cats]
        # Unseen categories get the extra index, which the encoder drops: all zeros.
        stages.append(StringIndexer(inputCols=raw, outputCols=index, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages)


def train_challenger(
    df: DataFrame,
    features: Iterable[Feature],
    label: str = "label",
    iterations: int = 100,
    step: float = 0.08,
    depth: int = 5,
    seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted trees over the preprocessing pipeline.

    Every level of every tree reads all rows, so they are written once, in files that all tasks share.
    """
    features = list(features)
    kinds = dict(df.dtypes)
    names = dict.fromkeys([*(f.name for f in features), label])
    df = stored(df.select(*[
        F.col(c).cast("double").alias(c) if kinds.get(c) == "void" else F.col(c) for c in names
    ]), "training", PASS_ROWS)
    trees = GBTClassifier(
        labelCol=label, featuresCol="features", maxIter=iterations, stepSize=step,
        maxDepth=depth, seed=seed,
    )
    return Pipeline(stages=[*preprocessing(df, features).getStages(), trees]).fit(df)


def score_batch(df: DataFrame, model: PipelineModel, version: str) -> DataFrame:
    """Add probability of class 1 (clipped), label and model version; earlier ones are overwritten."""
    df = df.drop("prediction_score", "prediction_label", "model_version")
    scored = model.transform(df)
    p = F.get(vector_to_array("probability"), F.lit(1))
    return with_label(
        scored.select(*[c for c in df.columns], p.alias("prediction_score"))
    ).withColumn("model_version", F.lit(version))


def with_label(df: DataFrame, score: str = "prediction_score") -> DataFrame:
    """Score clipped to [0, 1] and its label; without a score (NULL or NaN) both are NULL."""
    known = nan_to_null(F.col(score).cast("double"))
    clipped = F.when(known.isNotNull(), F.least(F.greatest(known, F.lit(0.0)), F.lit(1.0)))
    return df.withColumn(score, clipped).withColumn(
        "prediction_label", (F.col(score) >= 0.5).cast("long")
    )


# Defaults of absent columns in the rule-based score.
_ABSENT = {
    "credit_score": 650.0, "debt_to_income_ratio": 0.3,
    "annual_income": 50000.0, "loan_amount": 10000.0,
}


def heuristic_score(df: DataFrame) -> Column:
    """Rule-based risk used when no model can score."""

    def field(name: str) -> Column:
        return numeric(df, name) if name in df.columns else F.lit(_ABSENT[name])

    credit, income = field("credit_score"), field("annual_income")
    income = F.when(income.isNotNull(), F.greatest(income, F.lit(1000.0)))  # unknown stays unknown
    # Steps, limits and bounds of the rule-based score.
    score = (
        F.lit(0.2)
        + F.when(credit < 580, 0.35).when(credit < 670, 0.15).otherwise(0.0)
        + F.when(field("debt_to_income_ratio") > 0.45, 0.25).otherwise(0.0)
        + F.when(field("loan_amount") / income > 0.4, 0.2).otherwise(0.0)
    )
    return F.least(F.greatest(score, F.lit(0.01)), F.lit(0.99))


def logistic_fallback_score(df: DataFrame) -> Column:
    """Logistic curve of the credit score, centred on 620."""
    # Default, centre and width of the curve.
    credit = numeric(df, "credit_score") if "credit_score" in df.columns else F.lit(650.0)
    return 1.0 / (1.0 + F.exp((credit - 620.0) / 60.0))


REGISTRY_SCHEMA = (
    "seq long, version string, previous_version string, model_path string, verdict string, "
    "is_rollback boolean, promoted_at timestamp"
)


def _version_number(column: Column) -> Column:
    return F.regexp_extract(column, r"^v(\d+)$", 1).try_cast("long")


def next_version(registry: DataFrame) -> DataFrame:
    """``next_version``: one above the largest vN seen as current or previous."""
    top = F.max(F.greatest(
        F.coalesce(_version_number(F.col("version")), F.lit(0)),
        F.coalesce(_version_number(F.col("previous_version")), F.lit(0)),
    ))
    return registry.agg(
        F.concat(F.lit("v"), (F.coalesce(top, F.lit(0)) + 1).cast("string")).alias("next_version")
    )


def current_pointer(registry: DataFrame) -> DataFrame:
    """The newest registry row, one row or none."""
    whole = F.max_by(F.struct(*registry.columns), "seq").alias("_r")
    return registry.agg(whole).filter("_r IS NOT NULL").select("_r.*")


def promote(
    registry: DataFrame, verdicts: DataFrame, now: str, force: bool = False
) -> DataFrame:
    """Pointer rows to append for approved candidates.

    ``verdicts(candidate_version, verdict)`` is the outcome of one evaluation; an
    unapproved one yields no row unless forced.
    """
    last = registry.agg(
        F.coalesce(F.max("seq"), F.lit(0)).alias("_seq"), F.max_by("version", "seq").alias("_cur")
    )  # one row
    allowed = verdicts if force else verdicts.filter("verdict = 'APPROVED'")
    version = F.col("candidate_version")
    return allowed.crossJoin(F.broadcast(last)).select(
        (F.col("_seq") + 1).cast("long").alias("seq"), version.alias("version"),
        F.col("_cur").alias("previous_version"),
        F.concat(version, F.lit("/model")).alias("model_path"), "verdict",
        F.lit(False).alias("is_rollback"), F.lit(now).cast("timestamp").alias("promoted_at"),
    )


def rollback(registry: DataFrame, now: str) -> DataFrame:
    """Pointer row that swaps current and previous; none without a previous version."""
    cur = current_pointer(registry).filter(F.col("previous_version").isNotNull())
    return cur.select(
        (F.col("seq") + 1).cast("long").alias("seq"),
        F.col("previous_version").alias("version"), F.col("version").alias("previous_version"),
        F.concat("previous_version", F.lit("/model")).alias("model_path"),
        F.lit(None).cast("string").alias("verdict"), F.lit(True).alias("is_rollback"),
        F.lit(now).cast("timestamp").alias("promoted_at"),
    )


def refresh_baseline(
    validation: DataFrame, features: Iterable[Feature], identity: Sequence[str], **options
) -> tuple[DataFrame, DataFrame]:
    """New baseline from the validation rows; a score column is kept and profiled."""
    return build_baseline(validation, features, identity, **options)
