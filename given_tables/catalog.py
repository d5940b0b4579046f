"""The registered queries: each operator on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.config import Settings
from stayrate.functions.encode import flag, tenure_years, whole_months_until
from stayrate.operators import distribution, encode, evaluate, model, neighbours, price, profile, segments, split
from stayrate.plans import eda, modelling, report
from stayrate.plans import features as feature_plan
from stayrate.session import durable, shared_folder
from stayrate.sinks.files import prediction_table, write_counted, write_features
from stayrate.sources.files import client_schema, drop_artefact, parse_dates, read_csv, scan_csv

from .views import LAYOUT, SNAPSHOT, bills, clients, discounts, prices, scored, table

Query = Callable[[SparkSession, str], DataFrame]

SETTINGS = replace(
    Settings(),
    reference_date=SNAPSHOT,
    min_category_count=60,
    trees=20,
    max_depth=5,
)
ID, LABEL = LAYOUT.id, LAYOUT.label
DIMENSIONS = {"size": "pow_max", "usage": "cons_12m", "age": "num_years_antig"}
DIGITS = 6


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Round results whose last digits depend on the order of summation."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def text_dates(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def id_hash() -> Column:
    return split.integer_hash(ID)


# --- exploration -----------------------------------------------------------


def dataset_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.overview(clients(spark, folder), "client", LABEL).unionByName(
        profile.overview(prices(spark, folder), "price")
    )


def column_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_gaps(clients(spark, folder))


def class_share(spark: SparkSession, folder: str) -> DataFrame:
    return profile.class_share(clients(spark, folder, margin=False), LABEL)


def price_by_churn(spark: SparkSession, folder: str) -> DataFrame:
    return profile.price_by_label(
        clients(spark, folder, margin=False),
        prices(spark, folder),
        ID,
        LABEL,
        LAYOUT.price_prefix,
    )


def group_means(spark: SparkSession, folder: str) -> DataFrame:
    # pow_max is the only binary float among these columns.
    found = clients(spark, folder).withColumn("pow_max", F.col("pow_max").cast("decimal(15,2)"))
    return profile.group_means(found, LABEL, LAYOUT.mean_columns)


def rate_by_channel(spark: SparkSession, folder: str) -> DataFrame:
    return profile.rate_by_descending(clients(spark, folder, margin=False), "channel_sales", LABEL)


def rate_by_gas(spark: SparkSession, folder: str) -> DataFrame:
    return profile.rate_by(clients(spark, folder, margin=False), "has_gas", LABEL)


def rate_by_gas_encoded(spark: SparkSession, folder: str) -> DataFrame:
    encoded = feature_plan.flag_features(clients(spark, folder, margin=False), LAYOUT)
    return profile.rate_by(encoded, "has_gas", LABEL)


def rate_by_tenure_top5(spark: SparkSession, folder: str) -> DataFrame:
    aged = clients(spark, folder, margin=False).withColumn(
        "tenure", tenure_years("date_activ", "date_end")
    )
    return profile.rate_by_descending(aged, "tenure", LABEL, top=5)


# --- price features --------------------------------------------------------


def monthly_price(spark: SparkSession, folder: str) -> DataFrame:
    return text_dates(price.monthly_prices(prices(spark, folder), LAYOUT), "price_date")


def price_change_first_last(spark: SparkSession, folder: str) -> DataFrame:
    return price.price_change(prices(spark, folder), LAYOUT)


def price_mean_spread(spark: SparkSession, folder: str) -> DataFrame:
    return price.price_mean_spread(prices(spark, folder), LAYOUT)


def price_max_spread(spark: SparkSession, folder: str) -> DataFrame:
    return price.price_max_spread(prices(spark, folder), LAYOUT)


def price_features(spark: SparkSession, folder: str) -> DataFrame:
    return price.price_features(prices(spark, folder), LAYOUT)


def price_volatility(spark: SparkSession, folder: str) -> DataFrame:
    found = price.price_level(prices(spark, folder), LAYOUT)
    return rounded(found, *[f"{c}_volatility" for c in LAYOUT.price_columns], digits=1)


def price_mom(spark: SparkSession, folder: str) -> DataFrame:
    monthly = price.monthly_prices(prices(spark, folder), LAYOUT)
    return text_dates(price.month_on_month(monthly, LAYOUT.price_columns, LAYOUT), "price_date")


def rise_before_churn(spark: SparkSession, folder: str) -> DataFrame:
    found = clients(spark, folder, margin=False)
    return price.rise_before(found, prices(spark, folder), LAYOUT.price_columns, 3, LAYOUT)


def churn_after_rise(spark: SparkSession, folder: str) -> DataFrame:
    found = clients(spark, folder, margin=False)
    return price.rate_after_rises(found, prices(spark, folder), LAYOUT.price_columns, 3, LAYOUT)


def churn_by_volatility(spark: SparkSession, folder: str) -> DataFrame:
    """Do customers with stable prices stay, and for longer?"""
    names = {c: f"{c}_volatility" for c in LAYOUT.price_columns}
    levels = rounded(price.price_level(prices(spark, folder), LAYOUT), *names.values(), digits=1)
    found = clients(spark, folder, margin=False).select(ID, LABEL, "num_years_antig").join(levels, ID)
    rows = durable(found.select(LABEL, "num_years_antig", *names.values()))
    return segments.segment_rates(rows, names, LABEL, means=["num_years_antig"])


def elasticity_monthly(spark: SparkSession, folder: str) -> DataFrame:
    found = price.elasticity(bills(spark, folder), "unit_price", "quantity", LAYOUT)
    return text_dates(rounded(found, "elasticity"), "price_date")


def elasticity(spark: SparkSession, folder: str) -> DataFrame:
    monthly = price.elasticity(bills(spark, folder), "unit_price", "quantity", LAYOUT)
    found = clients(spark, folder, margin=False)
    return rounded(
        price.elasticity_by_segment(found, monthly, "channel_sales", LAYOUT), "median_elasticity"
    )


def _elasticity_by(dimension: str, column: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        monthly = price.elasticity(bills(spark, folder), "unit_price", "quantity", LAYOUT)
        found = durable(clients(spark, folder, margin=False).select(ID, column))
        thirds = segments.with_segments(found, {dimension: column}).where(F.col(dimension).isNotNull())
        return rounded(
            price.elasticity_by_segment(thirds, monthly, dimension, LAYOUT), "median_elasticity"
        )

    query.__name__ = f"elasticity_by_{dimension}"
    return query


elasticity_by_size, elasticity_by_usage, elasticity_by_age = (
    _elasticity_by(dimension, column) for dimension, column in DIMENSIONS.items()
)


# --- entity features -------------------------------------------------------


def tenure(spark: SparkSession, folder: str) -> DataFrame:
    return clients(spark, folder, margin=False).select(
        ID, tenure_years("date_activ", "date_end").alias("tenure")
    )


def months_to_ref(spark: SparkSession, folder: str) -> DataFrame:
    return clients(spark, folder, margin=False).select(
        ID,
        *[
            (whole_months_until(SNAPSHOT, column) * sign).cast("double").alias(name)
            for name, (column, sign) in LAYOUT.month_features.items()
        ],
    )


def bool_encode(spark: SparkSession, folder: str) -> DataFrame:
    return clients(spark, folder, margin=False).select(ID, flag("has_gas").alias("has_gas"))


def category_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return encode.frequent_categories(
        clients(spark, folder, margin=False), LAYOUT.category_columns, SETTINGS.min_category_count
    )


def one_hot_long(spark: SparkSession, folder: str) -> DataFrame:
    return encode.one_hot_long(
        clients(spark, folder, margin=False),
        ID,
        LAYOUT.category_columns,
        SETTINGS.min_category_count,
    )


def one_hot_wide(spark: SparkSession, folder: str) -> DataFrame:
    found = clients(spark, folder, margin=False).select(ID, *LAYOUT.category_columns)
    lists = encode.category_lists(
        found, LAYOUT.category_columns, SETTINGS.min_category_count, SETTINGS.max_categories
    )
    return encode.one_hot_wide(found, lists)


def category_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The names of the 1s in the sparse vectors of each customer."""
    found = durable(clients(spark, folder, margin=False).select(ID, *LAYOUT.category_columns))
    made = encode.category_vectors(found, LAYOUT.category_columns, SETTINGS.min_category_count)
    return encode.active_categories(found, ID, made)


def log10p1(spark: SparkSession, folder: str) -> DataFrame:
    found = clients(spark, folder, margin=False).select(ID, *LAYOUT.log_columns)
    return rounded(feature_plan.log_features(found, LAYOUT), *LAYOUT.log_columns)


def log_invalid(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.log_summary(clients(spark, folder, margin=False), LAYOUT.log_columns)


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_plan.build_features(
        clients(spark, folder), prices(spark, folder), LAYOUT, SETTINGS
    )


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    found = _features(spark, folder)
    names = model.feature_names(found, [ID, LABEL])
    typed = found.select(ID, LABEL, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return rounded(typed, *LAYOUT.log_columns)


def feature_summary(spark: SparkSession, folder: str) -> DataFrame:
    return feature_plan.feature_summary(_features(spark, folder), LAYOUT)


# --- distributions ---------------------------------------------------------


def histogram50(spark: SparkSession, folder: str) -> DataFrame:
    return distribution.histogram(
        clients(spark, folder), LAYOUT.histogram_columns, LABEL, SETTINGS.histogram_bins
    )


def histogram_log(spark: SparkSession, folder: str) -> DataFrame:
    logs = feature_plan.log_features(clients(spark, folder, margin=False), LAYOUT)
    return rounded(distribution.histogram(logs, LAYOUT.density_columns, bins=30), "bin_start")


def histogram_bins(spark: SparkSession, folder: str) -> DataFrame:
    found = durable(clients(spark, folder, margin=False).select(*LAYOUT.log_columns))
    return distribution.auto_bins(found, LAYOUT.log_columns)


def kde_log(spark: SparkSession, folder: str) -> DataFrame:
    logs = feature_plan.log_features(clients(spark, folder, margin=False), LAYOUT)
    return rounded(distribution.density(logs, LAYOUT.density_columns), "x", "density")


def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of numeric features of the feature table, in the order of their names."""
    found = durable(_features(spark, folder))
    names = sorted(model.feature_names(found, [ID, LABEL]))
    return rounded(distribution.correlations(found, names), "corr")


# --- split and evaluation --------------------------------------------------


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    found = clients(spark, folder, margin=False).select(ID, LABEL)
    return split.stratified_split(found, ID, LABEL, hash=id_hash())


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return split.class_weights(clients(spark, folder, margin=False), LABEL)


def oversample(spark: SparkSession, folder: str) -> DataFrame:
    found = clients(spark, folder, margin=False).select(ID, LABEL)
    return split.oversample(found, ID, LABEL, hash=id_hash())


def _filled(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """All features of the feature table; gaps are 0."""
    found = feature_table(spark, folder)
    features = sorted(model.feature_names(found, [ID, LABEL]))
    return durable(found.select(ID, LABEL, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in features])), features


def synthetic_minority(spark: SparkSession, folder: str) -> DataFrame:
    """New customers from all features of the feature table."""
    filled, features = _filled(spark, folder)
    return split.synthetic_minority(filled, ID, LABEL, features, hash=id_hash())


def minority_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five churned customers nearest to each churned one."""
    filled, features = _filled(spark, folder)
    return neighbours.nearest(filled.where(F.col(LABEL) == 1), ID, features, id_hash(), split.HASH_RANGE)


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(scored(spark, folder), "label", "prediction")


def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.binary_metrics(scored(spark, folder), "label", "prediction")


def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.class_report(scored(spark, folder), "label", "prediction")


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.roc_auc(scored(spark, folder), "label", "score")


def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.roc_points(scored(spark, folder), "label", "score")


def pr_points(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.precision_recall_points(scored(spark, folder), "label", "score")


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.threshold_sweep(scored(spark, folder), "label", "score", SETTINGS.thresholds)


def score_deciles(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.score_deciles(scored(spark, folder), "label", "score")


def retention_list(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.retention_list(scored(spark, folder), "id", "score", 20)


# --- segments --------------------------------------------------------------


def segment_rates(spark: SparkSession, folder: str) -> DataFrame:
    found = clients(spark, folder, margin=False).select(LABEL, *DIMENSIONS.values())
    return segments.segment_rates(durable(found), DIMENSIONS, LABEL)


def bill_burden(spark: SparkSession, folder: str) -> DataFrame:
    return segments.bill_burden(
        clients(spark, folder, margin=False), bills(spark, folder), ID, LABEL, "bill"
    )


def discount_rates(spark: SparkSession, folder: str) -> DataFrame:
    found = clients(spark, folder, margin=False).join(discounts(spark, folder), ID)
    return segments.rate_by_condition(found, F.col("mean_discount") > 0.05, LABEL, "discounted")


def at_risk_list(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["net_margin", "num_years_antig", "cons_last_month", "cons_12m"]
    found = durable(clients(spark, folder).select(ID, *columns))
    return segments.at_risk(found, ID, *columns)


# --- sources and sinks -----------------------------------------------------


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV with gaps as 'NA', and scanned back with types."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4()}"
    source = table(spark, folder, "customer")
    gap = F.when(F.col("c_acctbal") < 0, "NA").otherwise(F.col("c_acctbal").cast("string"))
    source.withColumn("c_acctbal", gap).write.option("header", True).csv(path)
    return read_csv(spark, path, source.schema)


def csv_undeclared(spark: SparkSession, folder: str) -> DataFrame:
    """A file with more columns than declared: the numeric ones become features."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4()}"
    found = table(spark, folder, "customer").select(
        F.col("c_custkey").alias(ID),
        (F.col("c_custkey") % 2).cast("int").alias(LABEL),
        F.col("c_mktsegment").alias("extra_text"),
        F.when(F.col("c_nationkey") == 3, "NA").otherwise(F.col("c_acctbal").cast("string")).alias("extra_amount"),
        F.lit("0").alias(LAYOUT.index_artefact),
    )
    found.write.option("header", True).csv(path)
    scanned = drop_artefact(read_csv(spark, path, client_schema(LAYOUT)), LAYOUT)
    return scanned.select(ID, *model.feature_names(scanned, [ID, LABEL]))


def csv_mixed_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers from files with their columns in two orders, one of them without balances."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4()}"
    source, odd = table(spark, folder, "customer"), F.col("c_custkey") % 2 == 1
    columns = ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"]
    source.where(~odd).select(*columns).write.option("header", True).csv(f"{path}/even")
    source.where(odd).select(*columns[2::-1]).write.option("header", True).csv(f"{path}/odd")
    return scan_csv(spark, [f"{path}/even", f"{path}/odd"], source.select(*columns).schema).table.select(*columns)


def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with broken cells and short or long records: those that cannot be read, and why."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4()}"
    source, kind = table(spark, folder, "customer"), F.col("c_custkey") % 9
    key = F.when(kind == 1, F.concat("c_custkey", F.lit(".5"))).otherwise(F.col("c_custkey").cast("string"))
    nation = F.when(kind.isin(1, 2), "x").when(kind == 3, "NA").when(kind == 4, F.concat("c_nationkey", F.lit(".0"))).otherwise(F.col("c_nationkey").cast("string"))
    line = F.when(kind == 5, key).when(kind == 6, F.concat_ws(",", key, nation, "c_mktsegment", F.lit("more"))).otherwise(F.concat_ws(",", key, nation, "c_mktsegment"))
    rows = source.select(line.alias("c_custkey,c_nationkey,c_mktsegment"))
    rows.write.options(header=True, quote="", escapeQuotes=False, sep="\x01").csv(path)
    return scan_csv(spark, path, source.select("c_custkey", "c_nationkey", "c_mktsegment").schema).rejects.select("record", "reason")


def feature_file(spark: SparkSession, folder: str) -> DataFrame:
    """The price features, written as the feature job does and read back."""
    path = f"{shared_folder(spark)}/features-{uuid.uuid4()}"
    return write_features(price.price_features(prices(spark, folder), LAYOUT), path)


def written_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and gaps of the customer table, counted while it is written."""
    return write_counted(clients(spark, folder), f"{shared_folder(spark)}/customers-{uuid.uuid4()}").gaps()


def written_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What the feature job says of its table, with the rows counted while it is written."""
    written = write_counted(_features(spark, folder), f"{shared_folder(spark)}/features-{uuid.uuid4()}")
    return feature_plan.feature_summary(written.table, LAYOUT, SETTINGS, written.rows)


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The rate tables of the report, line by line."""
    tables = eda.explore(clients(spark, folder), prices(spark, folder), LAYOUT, SETTINGS)
    rates = {n: t for n, t in tables.items() if n.startswith("rate_by_")}
    return report.rate_lines(rates)


def date_parse(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("o_orderdate").cast("date").cast("string")
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise(text).alias("lenient"),
        text.alias("strict"),
    )
    parsed = parse_dates(parse_dates(orders, ["lenient"]), ["strict"], strict=True)
    return text_dates(parsed, "lenient", "strict")


# --- cross-validation and importance measures, without a model ----------------


def _folded(spark: SparkSession, folder: str) -> DataFrame:
    found = scored(spark, folder)
    return found.withColumn("fold", F.pmod(split.integer_hash("id"), F.lit(5)).cast("int"))


def fold_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.roc_auc(_folded(spark, folder), "label", "score", ["fold"])


def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(model.fold_summary(fold_auc(spark, folder)), "auc_mean", "auc_std")


def _label_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, importance): how strongly each price and customer feature goes with the label."""
    rows = clients(spark, folder, margin=False).join(price.price_features(prices(spark, folder), LAYOUT), ID)
    names = model.feature_names(rows.drop(*LAYOUT.log_columns), [ID, LABEL])
    found = rounded(distribution.correlations_with(rows, names, LABEL), "corr")
    return found.select(
        F.col("column").alias("feature"), F.coalesce(F.abs("corr"), F.lit(0.0)).alias("importance")
    )


def corr_importance_top(spark: SparkSession, folder: str) -> DataFrame:
    return model.top_importances(_label_correlations(spark, folder), 10)


def corr_price_share(spark: SparkSession, folder: str) -> DataFrame:
    found = report.price_share(durable(_label_correlations(spark, folder)), replace(SETTINGS, top_features=10))
    return rounded(found, "price_importance", "price_share_of_top")


def corr_report_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All figures of the report, from given scores and importances."""
    rows = durable(scored(spark, folder).withColumnRenamed("label", LABEL))
    found = report.report_metrics(
        rows, durable(fold_auc(spark, folder)), durable(_label_correlations(spark, folder)), LAYOUT,
        replace(SETTINGS, top_features=10),
    )
    return rounded(found, "value")


# --- models ----------------------------------------------------------------


def _prepared(spark: SparkSession, folder: str) -> modelling.Prepared:
    return modelling.prepare(_features(spark, folder), LAYOUT, SETTINGS, id_hash())


def rf_predictions(spark: SparkSession, folder: str) -> DataFrame:
    parts = _prepared(spark, folder)
    fitted = modelling.fit_and_score(parts, LAYOUT, SETTINGS)
    return prediction_table(fitted.scored, LABEL, parts.features, ID)


def cv_auc(spark: SparkSession, folder: str) -> DataFrame:
    return modelling.cross_validation(_prepared(spark, folder), LAYOUT, SETTINGS)


def importance_top20(spark: SparkSession, folder: str) -> DataFrame:
    fitted = modelling.fit_and_score(_prepared(spark, folder), LAYOUT, SETTINGS)
    return model.top_importances(fitted.importance, SETTINGS.top_features)


def price_share(spark: SparkSession, folder: str) -> DataFrame:
    fitted = modelling.fit_and_score(_prepared(spark, folder), LAYOUT, SETTINGS)
    return report.price_share(fitted.importance, SETTINGS)


def report_metrics(spark: SparkSession, folder: str) -> DataFrame:
    parts = _prepared(spark, folder)
    fitted = modelling.fit_and_score(parts, LAYOUT, SETTINGS)
    per_fold = modelling.cross_validation(parts, LAYOUT, SETTINGS)
    return report.report_metrics(fitted.scored, per_fold, fitted.importance, LAYOUT, SETTINGS)


def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    parts = _prepared(spark, folder)
    base = modelling.classifier(LAYOUT, SETTINGS)
    grid = ParamGridBuilder().addGrid(base.maxDepth, [3, 5]).addGrid(base.numTrees, [10, 20]).build()
    return model.grid_search(
        parts.train, parts.features, base, grid, ID, LABEL, SETTINGS.folds
    )


def model_compare(spark: SparkSession, folder: str) -> DataFrame:
    parts = _prepared(spark, folder)
    candidates = {
        "random_forest": modelling.classifier(LAYOUT, SETTINGS),
        "boosted_trees": model.boosted_trees(LABEL, 10, 3, SETTINGS.seed),
    }
    return model.compare_models(parts.train, parts.test, parts.features, candidates, ID, LABEL)


def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    parts = _prepared(spark, folder)
    fitted = modelling.fit_and_score(parts, LAYOUT, SETTINGS)
    return model.permutation_importance(fitted.model, parts.test, parts.features, ID, LABEL)


# --- what must hold for any fitted model -------------------------------------


def rf_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every test row once, with a probability that agrees with the predicted class."""
    parts = _prepared(spark, folder)
    found = modelling.fit_and_score(parts, LAYOUT, SETTINGS).scored
    agrees = (F.col("score") > 0.5) == (F.col("prediction") == 1)
    return found.select(
        ID,
        F.col(LABEL).alias("actual_churn"),
        F.col("score").between(0, 1).cast("int").alias("in_range"),
        (agrees | (F.col("score") == 0.5)).cast("int").alias("agrees"),
    )


def cv_folds(spark: SparkSession, folder: str) -> DataFrame:
    found = cv_auc(spark, folder)
    return found.select("fold", "n_pos", "n_neg", F.col("auc").between(0, 1).cast("int").alias("in_range"))


def importance_total(spark: SparkSession, folder: str) -> DataFrame:
    fitted = modelling.fit_and_score(_prepared(spark, folder), LAYOUT, SETTINGS)
    return rounded(
        fitted.importance.agg(F.count("feature").alias("n_features"), F.sum("importance").alias("total")), "total"
    )


VECTOR_SETTINGS = replace(SETTINGS, wide_categories=False)


def _vector_fit(spark: SparkSession, folder: str) -> tuple[modelling.Prepared, modelling.Fitted]:
    """The forest on the same features, their categories in sparse vectors instead of columns."""
    built = feature_plan.build_features(clients(spark, folder), prices(spark, folder), LAYOUT, VECTOR_SETTINGS)
    parts = modelling.prepare(durable(built), LAYOUT, VECTOR_SETTINGS, id_hash())
    return parts, modelling.fit_and_score(parts, LAYOUT, VECTOR_SETTINGS)


def vector_importance_total(spark: SparkSession, folder: str) -> DataFrame:
    _, fitted = _vector_fit(spark, folder)
    return rounded(
        fitted.importance.agg(F.count("feature").alias("n_features"), F.sum("importance").alias("total")), "total"
    )


def vector_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows with the category that each has, as text, and whether the score is a probability."""
    parts, fitted = _vector_fit(spark, folder)
    found = prediction_table(fitted.scored, LABEL, parts.columns, ID)
    return found.select(ID, *LAYOUT.category_columns, F.col("churn_probability").between(0, 1).cast("int").alias("in_range"))


def model_classes(spark: SparkSession, folder: str) -> DataFrame:
    found = model_compare(spark, folder)
    return found.select(
        "model", (F.col("fn") + F.col("tp")).alias("n_pos"), (F.col("tn") + F.col("fp")).alias("n_neg")
    )


def grid_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return grid_search(spark, folder).select("params", "folds")


def permutation_base(spark: SparkSession, folder: str) -> DataFrame:
    """The AUC without permutation is the same whatever feature it is worked out from."""
    base = F.round(F.col("auc") + F.col("auc_drop"), 9)
    return permutation_importance(spark, folder).agg(
        F.count("feature").alias("n_features"), F.count_distinct(base).alias("n_bases")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dataset_profile,
        column_gaps,
        class_share,
        price_by_churn,
        group_means,
        rate_by_channel,
        rate_by_gas,
        rate_by_gas_encoded,
        rate_by_tenure_top5,
        monthly_price,
        price_change_first_last,
        price_mean_spread,
        price_max_spread,
        price_features,
        price_volatility,
        price_mom,
        rise_before_churn,
        churn_after_rise,
        churn_by_volatility,
        elasticity_by_size,
        elasticity_by_usage,
        elasticity_by_age,
        elasticity_monthly,
        elasticity,
        tenure,
        months_to_ref,
        bool_encode,
        category_frequency,
        one_hot_long,
        one_hot_wide,
        category_vectors,
        log10p1,
        log_invalid,
        feature_table,
        feature_summary,
        histogram50,
        histogram_log,
        histogram_bins,
        kde_log,
        corr_matrix,
        stratified_split,
        class_weights,
        oversample,
        synthetic_minority,
        minority_neighbours,
        confusion,
        binary_metrics,
        class_report,
        roc_auc,
        roc_points,
        pr_points,
        threshold_sweep,
        score_deciles,
        retention_list,
        segment_rates,
        bill_burden,
        discount_rates,
        at_risk_list,
        csv_round_trip,
        csv_undeclared,
        csv_mixed_headers,
        csv_rejects,
        feature_file,
        written_gaps,
        written_summary,
        report_lines,
        date_parse,
        fold_auc,
        fold_summary,
        corr_importance_top,
        corr_price_share,
        corr_report_metrics,
        rf_predictions,
        cv_auc,
        importance_top20,
        price_share,
        report_metrics,
        grid_search,
        model_compare,
        permutation_importance,
        rf_rows,
        cv_folds,
        importance_total,
        vector_importance_total,
        vector_predictions,
        model_classes,
        grid_candidates,
        permutation_base,
    )
}
