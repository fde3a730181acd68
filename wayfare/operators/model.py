"""Purchase-intent modelling on the cart features: split, preparation, fits, the leakage demonstration.

Fitting runs in pyspark.ml. What Spark's transformers only approximate (medians, population deviation,
exact temporal cut) is written as DataFrame operators.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.metrics import evaluate
from wayfare.operators.ordered import dealt_evenly, hot_keys, join_unique, number_sliced, running_totals
from wayfare.operators.selection import quantiles_by_group
from wayfare.operators.staging import SESSION
from wayfare.operators.tables import stacked
from wayfare.session import written

# Fixed values of the modelling task.
SEED = 42
NUMERIC = [
    "pre_n_events", "pre_n_pageviews", "pre_n_product_views", "pre_n_removes",
    "pre_n_skus_viewed", "pre_n_unique_pages", "pre_viewed_added_sku",
    "pre_add_position", "pre_sec_to_add", "pre_events_per_min",
    "pre_skus_per_page", "pre_n_searches", "pre_n_zero_result",
    "pre_n_search_clicks", "pre_used_search", "day_of_week", "hour_of_day",
    "is_weekend", "price_bucket", "price_is_unknown", "category_depth",
]
CATEGORY = "category_lvl1"
MIN_FREQUENCY = 50
WHOLE_SESSION = [
    "n_events", "n_pageviews", "n_product_views", "n_adds", "n_removes",
    "n_skus_viewed", "n_skus_added", "n_unique_pages", "duration_sec_capped",
    "n_searches", "n_search_clicks", "day_of_week", "hour_of_day",
]
INFREQUENT = "(infrequent)"
WITH_TOTAL, WITHOUT_TOTAL = "Leaky, with the event total", "Leaky, total removed"


def category_pseudonym(carts: DataFrame, slices: int | None = None) -> DataFrame:
    """category -> Cat00, Cat01, ... by falling number of carts, ties by name."""
    counted = carts.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("carts"))
    order = [F.col("carts").desc(), F.col(CATEGORY)]
    ranked = number_sliced(counted, [], order, "rank", slices)
    code = (F.col("rank") - 1).cast("string")
    padded = F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
    return ranked.select(CATEGORY, "carts", F.concat(F.lit("Cat"), padded).alias("category"))


def temporal_split(
    rows: DataFrame, time: str = "add_ts", slices: int | None = None
) -> DataFrame:
    """Earliest 80 % train, the rest test, ties in time by session id. Adds `is_train`.

    Only (time, session) is ordered, to find the last training row; the wide rows stay where they are and
    compare themselves with it.
    """
    placed = number_sliced(rows.select(time, SESSION), [], [F.col(time), F.col(SESSION)], "__at", slices)
    size = rows.agg(F.expr("count(1) * 4 div 5").alias("n"))
    here = F.struct(F.col(time).alias("t"), F.col(SESSION).alias("s"))
    cut = written(placed.filter(F.col("__at") <= size.scalar()).agg(F.max(here).alias("cut")), "cut")
    return rows.withColumn("is_train", F.coalesce(here <= cut.scalar(), F.lit(False)))


def numeric_statistics(train: DataFrame, names: list[str], slices: int | None = None) -> DataFrame:
    """Per feature: exact median, then mean and population deviation after filling NULLs with it.

    One row per feature. Only the medians need the features stacked; as literals they leave the rest to one plain
    aggregate over the rows as they are.
    """
    stack = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]
    )
    long = train.select(F.inline(stack))
    medians = quantiles_by_group(long, "feature", "value", {"median": 0.5})
    known = {r["feature"]: r["median"] for r in medians.collect()}  # one number per feature
    median = {n: F.lit(known.get(n)).cast("double") for n in names}
    filled = {n: F.coalesce(F.col(n).cast("double"), median[n]) for n in names}
    moments = [(F.avg(v).alias(f"mean_{n}"), F.stddev_pop(v).alias(f"deviation_{n}")) for n, v in filled.items()]
    return stacked(
        train.agg(*[m for pair in moments for m in pair]),
        ["feature", "median", "mean", "deviation"],
        [(F.lit(n), median[n], F.col(f"mean_{n}"), F.col(f"deviation_{n}")) for n in names],
    )


def class_means(carts: DataFrame) -> DataFrame:
    """Means of the features among carts with and without a purchase: two rows."""
    return carts.groupBy("purchased").agg(
        F.count(F.lit(1)).alias("carts"), *[F.round(F.avg(F.col(n).cast("double")), 6).alias(n) for n in NUMERIC]
    )


def impute_scale(rows: DataFrame, statistics: DataFrame, names: list[str]) -> DataFrame:
    """Replace each feature by (value or median, centred and scaled); a constant feature becomes 0.

    Only the statistics, one row per feature, come to the driver; they turn into literals.
    """
    known = {r["feature"]: r for r in statistics.collect()}
    scaled: dict[str, Column] = {}
    for name in names:
        found = known[name]
        if found["mean"] is None:  # the feature is NULL throughout
            scaled[name] = F.lit(0.0)
            continue
        filled = F.coalesce(F.col(name).cast("double"), F.lit(found["median"]))
        scaled[name] = (filled - F.lit(found["mean"])) / F.lit(found["deviation"] or 1.0)
    return rows.withColumns(scaled)


def category_levels(train: DataFrame, slices: int | None = None) -> DataFrame:
    """Training categories with their one-hot index: frequent ones each, all others share the last."""
    counted = train.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("carts"))
    known = counted.withColumn("frequent", F.col("carts") >= MIN_FREQUENCY)
    order = [F.col("frequent").desc(), F.col(CATEGORY)]
    marked = known.withColumn("__f", F.col("frequent").cast("bigint"))
    placed = running_totals(marked, [], order, {"__f": "__at"}, slices)
    index = F.when(F.col("frequent"), F.col("__at") - 1).otherwise(F.col("__at_total"))
    level = F.when(F.col("frequent"), F.col(CATEGORY)).otherwise(INFREQUENT)
    return placed.select(CATEGORY, level.alias("level"), index.alias("level_index"))


def encode_category(rows: DataFrame, levels: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Attach `level` and `level_index`; a category unseen in training has neither."""
    hot = hot_keys(rows, [CATEGORY], hot_rows)
    return join_unique(rows, levels, [CATEGORY], "left", hot)


def prepared(carts: DataFrame, slices: int | None = None) -> DataFrame:
    """Split carts with a `features` vector and a double `label`, ready to fit; the fits read it many times."""
    split = temporal_split(carts, slices=slices)
    train = split.filter("is_train")
    levels = category_levels(train, slices)
    width = levels.agg(F.coalesce(F.max("level_index"), F.lit(0))).first()[0] + 1
    scaled = impute_scale(split, numeric_statistics(train, NUMERIC, slices), NUMERIC)
    # An unseen category gets the extra index `width`; dropLast leaves its vector empty.
    encoded = encode_category(scaled, levels).withColumn(
        "level_index", F.coalesce("level_index", F.lit(width)).cast("double")
    )
    hot = _one_hot(encoded, int(width))
    assembled = VectorAssembler(inputCols=[*NUMERIC, "level_vector"], outputCol="features").transform(hot)
    ready = assembled.select(
        SESSION, "add_ts", "is_train", "features", F.col("purchased").cast("double").alias("label")
    )
    return dealt_evenly(ready, [SESSION], carts.count())


def _one_hot(rows: DataFrame, width: int) -> DataFrame:
    """The vector length is known, so the encoder is told the sizes by one row instead of a data pass."""
    sizes = rows.sparkSession.range(width + 1).select(F.col("id").cast("double").alias("level_index"))
    encoder = OneHotEncoder(inputCols=["level_index"], outputCols=["level_vector"], dropLast=True)
    return encoder.fit(sizes).transform(rows)


def balanced_weight(train: DataFrame) -> DataFrame:
    """Weight each class to half of the rows: n / (2 * n_class)."""
    sizes = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    n, positive = float(sizes["n"]), float(sizes["p"] or 0.0)
    weight = {1.0: n / (2 * positive) if positive else 1.0, 0.0: n / (2 * (n - positive)) if n > positive else 1.0}
    return train.withColumn("weight", F.when(F.col("label") == 1.0, weight[1.0]).otherwise(weight[0.0]))


def _logistic(n: int, weighted: bool) -> LogisticRegression:
    # An L2 penalty of one on the summed loss is 1/n on Spark's mean loss; the features are scaled already.
    extra = {"weightCol": "weight"} if weighted else {}
    return LogisticRegression(
        maxIter=2000, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, **extra
    )


def fit_logistic(rows: DataFrame, balanced: bool = True):
    train = rows.filter("is_train")
    return _logistic(train.count(), balanced).fit(balanced_weight(train) if balanced else train)


def fit_gbt(rows: DataFrame, rounds: int = 300):
    """Boosted trees; 15 % of the training rows, chosen by a hash of the session, stop it early."""
    held = F.pmod(F.xxhash64(F.lit(SEED), SESSION), F.lit(100)) < 15
    train = rows.filter("is_train").withColumn("held_out", held)
    return GBTClassifier(
        maxIter=rounds,
        stepSize=0.06,
        maxDepth=6,
        maxBins=255,
        minInstancesPerNode=20,
        seed=SEED,
        validationIndicatorCol="held_out",
        validationTol=1e-4,
    ).fit(train)


def scored_rows(model, rows: DataFrame) -> DataFrame:
    """(is_train, label, score) of all rows."""
    return model.transform(rows).select("is_train", "label", vector_to_array("probability")[1].alias("score"))


def tested(scores: DataFrame) -> DataFrame:
    """(label, score) of the test rows."""
    return scores.filter(~F.col("is_train")).select("label", "score")


def boosting_scores(fitted, rows: DataFrame) -> DataFrame:
    """Scores of all rows with the number of trees that made them."""
    return scored_rows(fitted, rows).withColumn("n_trees", F.lit(fitted.getNumTrees).cast("bigint"))


def _facts(scores: DataFrame, *more: Column) -> DataFrame:
    """Sizes and positives of both parts, the mean training score per class, and the range of all scores."""
    train, positive = F.col("is_train"), F.col("label") == 1.0
    return scores.agg(
        F.count_if(train).alias("n_train"),
        F.count_if(train & positive).alias("train_positives"),
        F.count_if(~train).alias("n_rows"),
        F.count_if(~train & positive).alias("positives"),
        F.avg(F.when(train & positive, F.col("score"))).alias("of_positives"),
        F.avg(F.when(train & ~positive, F.col("score"))).alias("of_negatives"),
        ((F.min("score") >= 0.0) & (F.max("score") <= 1.0)).alias("in_range"),
        *more,
    )


SIZES = ("n_train", "train_positives", "n_rows", "positives")


def check_logistic(scores: DataFrame) -> DataFrame:
    """What must hold of the fit whatever the optimizer's digits are.

    With balanced classes the intercept, which has no penalty, is settled where the weighted mean score is one half.
    """
    off = (F.col("of_positives") + F.col("of_negatives")) / 2 - 0.5
    settled = F.coalesce(F.abs(off) < 1e-3, F.lit(False)).alias("settled")
    weight = F.round(F.col("n_train") / (2 * F.col("train_positives")), 9).alias("weight_of_positives")
    return _facts(scores).select(*SIZES, weight, settled, "in_range")


def logistic_moments(rows: DataFrame, fitted) -> DataFrame:
    """Per numeric feature, its weighted mean among the training buyers and whether the fit reproduces it.

    At the optimum the gradient is zero: the mean of weight * score * value plus the penalty's slope equals the mean of
    weight * label * value, which does not depend on the fit.
    """
    train = balanced_weight(rows.filter("is_train"))
    first = VectorSlicer(inputCol="features", outputCol="numeric", indices=list(range(len(NUMERIC))))
    values = first.transform(fitted.transform(train)).select(
        "label", "weight", vector_to_array("probability")[1].alias("score"), vector_to_array("numeric").alias("x")
    )
    means = [
        F.avg(F.col("weight") * F.col(side) * F.col("x")[k]).alias(f"{side}_{name}")
        for k, name in enumerate(NUMERIC)
        for side in ("label", "score")
    ]
    slope = {name: F.lit(float(fitted.coefficients[k])) / F.col("n") for k, name in enumerate(NUMERIC)}
    return stacked(
        values.agg(F.count(F.lit(1)).alias("n"), *means),
        ["feature", "moment", "met"],
        [
            (
                F.lit(name),
                F.round(F.col(f"label_{name}"), 6) + F.lit(0.0),
                F.abs(F.col(f"score_{name}") + slope[name] - F.col(f"label_{name}")) < 1e-3,
            )
            for name in NUMERIC
        ],
    )


def check_gbt(scores: DataFrame, rounds: int = 300) -> DataFrame:
    """Sizes, no more trees than rounds, scores that rank training positives above negatives on average."""
    learned = (F.col("of_positives") > F.col("of_negatives")).alias("learned")
    few = F.max("n_trees").between(1, rounds).alias("trees_within_rounds")
    return _facts(scores, few).select(*SIZES, "trees_within_rounds", learned, "in_range")


def check_leakage(scores: DataFrame, slices: int | None = None) -> DataFrame:
    """The event total gives the label away, and without it the model ranks worse."""
    total = F.col("model") == WITH_TOTAL
    row = leakage_demo(scores, slices).agg(
        F.max("n_rows").alias("n_rows"),
        F.max(F.round(F.col("n_rows") * F.col("base_rate")).cast("bigint")).alias("positives"),
        F.max(F.when(total, F.col("roc_auc"))).alias("with_total"),
        F.max(F.when(~total, F.col("roc_auc"))).alias("without"),
    )
    return row.select(
        "n_rows",
        "positives",
        (F.col("with_total") > 0.99).alias("given_away"),
        (F.col("without") < F.col("with_total")).alias("less_without_total"),
    )


def baseline_scores(carts: DataFrame, slices: int | None = None) -> DataFrame:
    """Test rows scored with the overall conversion rate."""
    base = carts.agg(F.avg("purchased").alias("base"))
    test = temporal_split(carts, slices=slices).filter(~F.col("is_train"))
    return test.select(F.col("purchased").cast("double").alias("label")).withColumn("score", base.scalar())


def accounting_identity(sessions: DataFrame) -> DataFrame:
    """Cart sessions in which the event total equals the sum of its five parts."""
    parts = ["n_pageviews", "n_product_views", "n_adds", "n_removes", "n_purchases"]
    total = F.col(parts[0])
    for name in parts[1:]:
        total = total + F.col(name)
    return sessions.filter("reached_add").agg(
        F.count_if(F.col("n_events") == total).alias("identity_holds"),
        F.count(F.lit(1)).alias("cart_sessions"),
    )


def leaky_rows(sessions: DataFrame, names: list[str], slices: int | None = None) -> DataFrame:
    """Cart sessions with whole-session features, which already know the outcome."""
    carts = sessions.filter("reached_add").select(
        SESSION,
        "session_start",
        *names,
        F.col("reached_purchase").cast("double").alias("label"),
    )
    split = temporal_split(carts, "session_start", slices)
    statistics = numeric_statistics(split.filter("is_train"), names, slices)
    scaled = impute_scale(split, statistics, names)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(scaled)
    ready = assembled.select(SESSION, "is_train", "features", "label")
    return dealt_evenly(ready, [SESSION], carts.count())


def leaky_scores(rows: DataFrame) -> DataFrame:
    """(model, label, score): test rows under the same linear model with and without the event total.

    A feature is scaled by itself, so the rows are prepared once and the total is cut out of the vector.
    """
    others = [at for at, name in enumerate(WHOLE_SESSION) if name != "n_events"]
    sliced = VectorSlicer(inputCol="features", outputCol="others", indices=others).transform(rows)
    less = sliced.drop("features").withColumnRenamed("others", "features")
    parts = [
        tested(scored_rows(fit_logistic(part, balanced=False), part)).withColumn("model", F.lit(name))
        for name, part in ((WITH_TOTAL, rows), (WITHOUT_TOTAL, less))
    ]
    return parts[0].unionByName(parts[1]).select("model", "label", "score")


def leakage_demo(scores: DataFrame, slices: int | None = None) -> DataFrame:
    """Metrics of the two leaky models."""
    rows = [evaluate(scores.filter(F.col("model") == name), name, slices) for name in (WITH_TOTAL, WITHOUT_TOTAL)]
    return rows[0].unionByName(rows[1])
