"""The registered queries: each operator on the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillroll.functions import recode_label, spend_or_share
from tillroll.operators import keysets as ks
from tillroll.operators import kprototypes as kp
from tillroll.operators import lookback as lb
from tillroll.operators import market as mk
from tillroll.operators import reduction as rd
from tillroll.operators import spine as sp
from tillroll.operators.scaling import NUMERIC
from tillroll.plans import features as ft
from tillroll.plans import incremental
from tillroll.plans import pipeline
from tillroll.plans import segments as sg
from tillroll.plans import several_offers as so
from tillroll.session import new_path, stage, work_folder
from tillroll.sources import files, schemas
from tillroll.sources.sample import RetailTables, retail_tables
from tillroll.sources.schemas import ITEMS

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}

SAMPLE_KEYS = {"category": "string", "company": "int", "brand": "string"}


def query(name: str):
    def register(build: Callable[[RetailTables], DataFrame]):
        _queries[name] = lambda spark, sf_dir: build(retail_tables(spark, sf_dir))
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


# --- sources and sinks ---------------------------------------------------


def _through_csv(table: DataFrame, name: str, schema) -> DataFrame:
    spark, path = table.sparkSession, new_path(table.sparkSession, name)
    files.write_csv(table.select(*schema.names), path)
    return files.read_table(spark, path, schema)


@query("scan_offers")
def scan_offers(t: RetailTables) -> DataFrame:
    schema = schemas.offers_schema(**SAMPLE_KEYS)
    scanned = _through_csv(t.offers, "offers-csv", schema)
    return scanned.withColumn("offervalue", F.col("offervalue").cast("double"))


@query("scan_history")
def scan_history(t: RetailTables) -> DataFrame:
    return _through_csv(t.train_history, "train-csv", schemas.train_history_schema())


@query("scan_test_history")
def scan_test_history(t: RetailTables) -> DataFrame:
    return _through_csv(t.test_history, "test-csv", schemas.test_history_schema())


@query("scan_transactions")
def scan_transactions(t: RetailTables) -> DataFrame:
    schema = schemas.transactions_schema(dept="string", **SAMPLE_KEYS)
    scanned = _through_csv(t.transactions, "log-csv", schema)
    return _plain(scanned)


def _log_with_bad_lines(t: RetailTables, name: str) -> tuple[str, StructType]:
    """The log as CSV, every 50th shopper's lines once more without a date."""
    schema = schemas.transactions_schema(dept="string", **SAMPLE_KEYS)
    path = new_path(t.offers.sparkSession, name)
    log = t.transactions.select(*schema.names)
    files.write_csv(log, path)
    undated = log.where("id % 50 = 0").withColumn("date", F.lit("no date"))
    undated.write.mode("append").option("header", True).csv(path)
    return path, schema


@query("scan_good_lines")
def scan_good_lines(t: RetailTables) -> DataFrame:
    path, schema = _log_with_bad_lines(t, "good-lines")
    return _plain(files.split_bad_lines(t.offers.sparkSession, path, schema)[0])


@query("bad_lines")
def bad_lines(t: RetailTables) -> DataFrame:
    path, schema = _log_with_bad_lines(t, "bad-lines")
    bad = files.split_bad_lines(t.offers.sparkSession, path, schema)[1]
    field = F.split("line", ",")
    rows = bad.select(field[0].cast("bigint").alias("id"), field[6].alias("date"))
    return rows.groupBy("id", "date").agg(F.count("*").alias("lines"))


def _plain(rows: DataFrame) -> DataFrame:
    """Amounts as doubles, for comparison."""
    return rows.withColumn("purchaseamount", F.col("purchaseamount").cast("double"))


@query("saved_reduction")
def saved_reduction(t: RetailTables) -> DataFrame:
    spark = t.offers.sparkSession
    path = new_path(spark, "reduced")
    rd.reduced_table(spark, path, t.transactions, t.offers)  # builds and saves
    return _plain(rd.reduced_table(spark, path, t.transactions, t.offers)[0])  # reloads


@query("saved_dept_map")
def saved_dept_map(t: RetailTables) -> DataFrame:
    spark = t.offers.sparkSession
    saved = files.save_versioned(
        sp.category_dept_map(t.transactions), work_folder(spark), "dept-map"
    )
    return files.load_saved(spark, [saved])[0]


@query("saved_features")
def saved_features(t: RetailTables) -> DataFrame:
    spark = t.offers.sparkSession
    features = ft.base_features(t.transactions, t.offers, t.train_history)
    saved = files.save_versioned(ft.sorted_for_export(features), work_folder(spark), "base")
    return files.load_saved(spark, [saved])[0]


@query("features_from_files")
def features_from_files(t: RetailTables) -> DataFrame:
    spark, folder = t.offers.sparkSession, new_path(t.offers.sparkSession, "pipeline")
    inputs = pipeline.Inputs(*[f"{folder}/in/{n}" for n in ("offers", "log", "train")])
    for table, path in zip((t.offers, t.transactions, t.train_history), inputs):
        files.write_csv(table, path)
    key_types = SAMPLE_KEYS | {"dept": "string"}
    results = pipeline.run(spark, inputs, f"{folder}/out", key_types)
    return files.load_saved(spark, [results.saved_features])[0]


@query("features_from_files_test")
def features_from_files_test(t: RetailTables) -> DataFrame:
    spark, folder = t.offers.sparkSession, new_path(t.offers.sparkSession, "pipeline")
    inputs = pipeline.Inputs(*[f"{folder}/in/{n}" for n in ("offers", "log", "test")])
    for table, path in zip((t.offers, t.transactions, t.test_history), inputs):
        files.write_csv(table, path)
    key_types = SAMPLE_KEYS | {"dept": "string"}
    results = pipeline.run(spark, inputs, f"{folder}/out", key_types, outcome=False)
    return files.load_saved(spark, [results.saved_features])[0]


@query("features_from_buckets")
def features_from_buckets(t: RetailTables) -> DataFrame:
    """The log kept in buckets of shoppers."""
    spark, folder = t.offers.sparkSession, new_path(t.offers.sparkSession, "pipeline")
    inputs = pipeline.Inputs(*[f"{folder}/in/{n}" for n in ("offers", "log", "train")])
    for table, path in zip((t.offers, t.transactions, t.train_history), inputs):
        table.write.parquet(path)
    key_types = SAMPLE_KEYS | {"dept": "string"}
    results = pipeline.run(spark, inputs, f"{folder}/out", key_types, "parquet", buckets=16)
    return files.load_saved(spark, [results.saved_features])[0]


@query("features_after_change")
def features_after_change(t: RetailTables) -> DataFrame:
    """The run after the one over half of the log, in the same folder."""
    spark, folder = t.offers.sparkSession, new_path(t.offers.sparkSession, "pipeline")
    inputs = pipeline.Inputs(*[f"{folder}/in/{n}" for n in ("offers", "log", "train")])
    for table, path in zip((t.offers, t.transactions, t.train_history), inputs):
        table.write.parquet(path)
    key_types = SAMPLE_KEYS | {"dept": "string"}
    part = inputs._replace(transactions=f"{folder}/in/part")
    t.transactions.where("id % 2 = 0").write.parquet(part.transactions)
    pipeline.run(spark, part, f"{folder}/out", key_types, "parquet").release()
    results = pipeline.run(spark, inputs, f"{folder}/out", key_types, "parquet")
    return files.load_saved(spark, [results.saved_features])[0]


@query("features_after_append")
def features_after_append(t: RetailTables) -> DataFrame:
    """Half of the log is taken in, then the other half is added beside it."""
    spark, folder = t.offers.sparkSession, new_path(t.offers.sparkSession, "growing")
    inputs = pipeline.Inputs(*[f"{folder}/in/{n}" for n in ("offers", "log", "train")])
    t.offers.write.parquet(inputs.offers)
    t.train_history.write.parquet(inputs.history)
    key_types = SAMPLE_KEYS | {"dept": "string"}
    for day, rest in enumerate(("= 0", "<> 0 or id is null")):
        t.transactions.where(f"id % 2 {rest}").write.parquet(f"{inputs.transactions}/day-{day}")
        # Half of a small log may lack categories on offer.
        options = {"fmt": "parquet", "strict_dept": day == 1}
        grown = incremental.update(spark, inputs, f"{folder}/sums", key_types, **options)
    return grown.features


# --- the spine -------------------------------------------------------------


def _offervalue_double(rows: DataFrame) -> DataFrame:
    return rows.withColumn("offervalue", F.col("offervalue").cast("double"))


def _spine(t: RetailTables) -> DataFrame:
    return sp.history_with_offers(t.train_history, t.offers)


def _spine_dept(t: RetailTables) -> DataFrame:
    return sp.with_dept(_spine(t), stage(sp.category_dept_map(t.transactions), "dept-map"))


@query("spine")
def spine(t: RetailTables) -> DataFrame:
    return _offervalue_double(_spine(t))


@query("spine_test")
def spine_test(t: RetailTables) -> DataFrame:
    return _offervalue_double(sp.history_with_offers(t.test_history, t.offers))


@query("recode_label")
def recoded(t: RetailTables) -> DataFrame:
    return t.train_history.select("id", "repeater", recode_label("repeater").alias("label"))


@query("category_dept_map")
def dept_map(t: RetailTables) -> DataFrame:
    return sp.category_dept_map(t.transactions)


@query("category_dept_map_by_file")
def category_dept_map_by_file(t: RetailTables) -> DataFrame:
    """The dept of each category's last line in a log of several files."""
    spark, path = t.offers.sparkSession, new_path(t.offers.sparkSession, "ordered-csv")
    schema = schemas.transactions_schema(dept="string", **SAMPLE_KEYS)
    ordered = t.transactions.orderBy("date", "productsize", "purchaseamount", "dept")
    files.write_csv(ordered.select(*schema.names), path)
    return sp.category_dept_map(files.read_table(spark, path, schema), order="file")


@query("category_dept_conflicts")
def dept_conflicts(t: RetailTables) -> DataFrame:
    return sp.category_dept_conflicts(t.transactions)


@query("spine_dept")
def spine_dept(t: RetailTables) -> DataFrame:
    return _spine_dept(t).select("id", "offer", "category", "dept")


@query("duplicate_ids")
def duplicate_ids(t: RetailTables) -> DataFrame:
    twice = t.train_history.unionByName(t.train_history.where("id % 50 = 1"))
    return sp.duplicate_ids(twice)


# --- the reduction, membership and sets --------------------------------------


@query("reduce_transactions")
def reduce_transactions(t: RetailTables) -> DataFrame:
    return _plain(rd.reduce_transactions(t.transactions, t.offers))


@query("reduce_by_filter")
def reduce_by_filter(t: RetailTables) -> DataFrame:
    """As if the offers had too many keys to broadcast."""
    return _plain(rd.reduce_transactions(t.transactions, t.offers, small=False))


@query("reduce_stats")
def reduce_stats(t: RetailTables) -> DataFrame:
    path = new_path(t.offers.sparkSession, "reduced")
    _, counts = rd.reduced_table(t.offers.sparkSession, path, t.transactions, t.offers)
    row = (counts["searched"], counts["kept"])
    return t.offers.sparkSession.createDataFrame([row], "searched bigint, kept bigint")


@query("offer_key_counts")
def offer_key_counts(t: RetailTables) -> DataFrame:
    return rd.offer_key_counts(t.offers)


@query("semi_category")
def semi_category(t: RetailTables) -> DataFrame:
    return _plain(ks.rows_on_offer(t.transactions, t.offers, "category"))


@query("semi_category_by_filter")
def semi_category_by_filter(t: RetailTables) -> DataFrame:
    return _plain(ks.rows_on_offer(t.transactions, t.offers, "category", small=False))


@query("semi_company")
def semi_company(t: RetailTables) -> DataFrame:
    return _plain(ks.rows_on_offer(t.transactions, t.offers, "company"))


@query("offer_product_events")
def offer_product_events(t: RetailTables) -> DataFrame:
    return _plain(ks.rows_on_offer(t.transactions, t.offers, *ITEMS))


@query("offer_category_events")
def offer_category_events(t: RetailTables) -> DataFrame:
    return _plain(ks.rows_on_offer(t.transactions, t.offers, "category").distinct())


@query("offer_universe_rows")
def offer_universe_rows(t: RetailTables) -> DataFrame:
    return _plain(ks.offer_universe_rows(t.transactions, t.offers))


@query("offers_in_common")
def offers_in_common(t: RetailTables) -> DataFrame:
    return ks.shared_keys(t.train_history, t.test_history, "offer")


@query("offers_union")
def offers_union(t: RetailTables) -> DataFrame:
    return ks.all_keys(t.train_history, t.test_history, "offer")


@query("offer_frequency")
def offer_frequency(t: RetailTables) -> DataFrame:
    return ks.frequency(t.train_history, "offer", "shoppers")


@query("offer_train_vs_test")
def offer_train_vs_test(t: RetailTables) -> DataFrame:
    names = ("train_offer", "test_offer")
    return ks.compare_frequency(t.train_history, t.test_history, "offer", names)


@query("ids_bought_category")
def ids_bought_category(t: RetailTables) -> DataFrame:
    bought = lb.matched_events(_events(t), "category")
    return ks.shared_keys(t.train_history, bought, "id")


@query("ids_without_universe_spend")
def ids_without_universe_spend(t: RetailTables) -> DataFrame:
    rows = ks.offer_universe_rows(t.transactions, t.offers)
    return ks.only_left_keys(t.train_history, rows, "id")


@query("ids_without_offered_product")
def ids_without_offered_product(t: RetailTables) -> DataFrame:
    bought = ks.rows_on_offer(t.transactions, t.offers, *ITEMS)
    return ks.only_left_keys(t.train_history, bought, "id")


@query("attach_zero_fill")
def attach_zero_fill(t: RetailTables) -> DataFrame:
    return ks.attach(_spine(t).select("id", "offer"), _own_spend(t), "id", keep_unmatched=True)


@query("attach_inner")
def attach_inner(t: RetailTables) -> DataFrame:
    return ks.attach(_spine(t).select("id", "offer"), _own_spend(t), "id", keep_unmatched=False)


def _own_spend(t: RetailTables) -> DataFrame:
    own = lb.matched_events(_events(t), *ITEMS)
    return own.groupBy("id").agg(F.sum("purchaseamount").cast("double").alias("own_spend"))


# --- events of the history's shoppers ----------------------------------------


def _events(t: RetailTables) -> DataFrame:
    return lb.history_events(t.transactions, _spine(t))


def _dept_events(t: RetailTables) -> DataFrame:
    return lb.history_events(t.transactions, _spine_dept(t))


@query("history_events")
def history_events(t: RetailTables) -> DataFrame:
    return _plain(_events(t)).select("id", "offerdate", "date", "purchaseamount", "day_diff")


@query("history_events_before_offer")
def history_events_before_offer(t: RetailTables) -> DataFrame:
    events = lb.history_events(t.transactions, _spine(t), before_offer=True)
    return _plain(events).select("id", "offerdate", "date", "purchaseamount", "day_diff")


@query("day_diff")
def day_diff(t: RetailTables) -> DataFrame:
    return _events(t).groupBy("day_diff").agg(F.count("*").alias("events"))


@query("window_mask_30")
def window_mask_30(t: RetailTables) -> DataFrame:
    return _events(t).select("id", "date", "day_diff", (F.col("day_diff") <= 30).alias("within_30"))


def _wanted(item: str) -> None:
    @query(f"wanted_{item}")
    def wanted(t: RetailTables) -> DataFrame:
        reduced = rd.reduce_transactions(t.transactions, t.offers)
        return _plain(lb.matched_events(lb.history_events(reduced, _spine(t)), item))


for _item in ITEMS:
    _wanted(_item)


@query("own_product_events")
def own_product_events(t: RetailTables) -> DataFrame:
    return _plain(lb.matched_events(_events(t), *ITEMS))


@query("own_dept_events")
def own_dept_events(t: RetailTables) -> DataFrame:
    return _plain(lb.matched_events(_dept_events(t), "dept"))


# --- features, a block at a time ---------------------------------------------


def _block(name: str, features: Callable[[], dict], columns: dict[str, str], dept=False) -> None:
    """A few features of every shopper with purchases, in a single aggregate."""

    @query(name)
    def block(t: RetailTables) -> DataFrame:
        events = _dept_events(t) if dept else _events(t)
        rows = lb.per_shopper(lb.event_measures(events), features())
        return rows.selectExpr("id", *[f"{plain} as {x}" for plain, x in columns.items()])


def _named(*plain: str) -> dict[str, str]:
    return {p: ft.FEATURE_NAMES[p] for p in plain}


def _grid_named(measure: str) -> dict[str, str]:
    return {p: x for p, x in ft.grid_names().items() if p.startswith(f"{measure}_")}


_block("feat_ever_bought", lb.ever_features, _named("ever_category", "ever_company", "ever_brand"))
_block("feat_total_spend", lb.total_spend_feature, _named("total_spend"))
_block("feat_windowed_counts", lambda: lb.grid_features("n"), _grid_named("n"))
_block("feat_windowed_amounts", lambda: lb.grid_features("amount"), _grid_named("amount"))
_block("feat_windowed_quantities", lambda: lb.grid_features("quantity"), _grid_named("quantity"))
_block("feat_spend_30", lb.recent_spend_feature, _named("recent_spend"))
_block(
    "feat_own_product_30",
    lb.own_recent_features,
    _named("own_recent_amount", "own_recent_quantity"),
)
_block("feat_own_product_all", lb.own_features, _named("own_amount", "own_quantity"))
_block(
    "feat_dept_30",
    lb.dept_features,
    _named("dept_recent_amount", "dept_recent_quantity"),
    dept=True,
)
_block("feat_recency", lb.recency_features, _named("days_since_first", "days_since_last"))
_block("feat_returned", lb.returned_feature, _named("returned"))


@query("feat_visits_30")
def feat_visits_30(t: RetailTables) -> DataFrame:
    rolled = lb.roll_up(lb.event_measures(_events(t)))
    return lb.per_shopper(rolled, lb.visit_feature()).withColumnRenamed("recent_visits", "X80")


@query("feat_interactions")
def feat_interactions(t: RetailTables) -> DataFrame:
    ever = lb.per_shopper(lb.event_measures(_events(t)), lb.ever_features())
    rows = ever.withColumns(ft.interactions())
    columns = _named("ever_all", "ever_company_brand", "ever_category_brand")
    return rows.selectExpr("id", *[f"{plain} as {x}" for plain, x in columns.items()])


@query("feat_offer_value")
def feat_offer_value(t: RetailTables) -> DataFrame:
    return _spine(t).select("id", ft.offer_value().alias("X8"))


@query("feat_offer_universe_spend")
def feat_offer_universe_spend(t: RetailTables) -> DataFrame:
    spend = mk.offer_universe_spend(_spine(t), t.transactions, t.offers)
    return spend.withColumnRenamed("universe_spend", "X72")


# --- the market ----------------------------------------------------------------


@query("shopper_totals")
def shopper_totals(t: RetailTables) -> DataFrame:
    return mk.shopper_totals(t.transactions).withColumnRenamed("total_spend", "X7")


@query("user_count")
def user_count(t: RetailTables) -> DataFrame:
    return mk.user_count(t.transactions)


@query("product_counts")
def product_counts(t: RetailTables) -> DataFrame:
    return mk.product_counts(t.transactions, t.offers)


@query("category_counts")
def category_counts(t: RetailTables) -> DataFrame:
    return mk.category_counts(t.transactions, t.offers)


@query("feat_marketshare")
def feat_marketshare(t: RetailTables) -> DataFrame:
    return mk.market_share(t.transactions, t.offers).withColumnRenamed("market_share", "X84")


@query("feat_marketshare_all_rows")
def feat_marketshare_all_rows(t: RetailTables) -> DataFrame:
    share = mk.market_share(t.transactions, t.offers, dedupe=False)
    return share.withColumnRenamed("market_share", "X84")


@query("feat_customer_share_product")
def feat_customer_share_product(t: RetailTables) -> DataFrame:
    share = mk.customer_share(t.transactions, t.offers, ITEMS)
    return share.withColumnRenamed("customer_share", "X86")


@query("feat_customer_share_category")
def feat_customer_share_category(t: RetailTables) -> DataFrame:
    share = mk.customer_share(t.transactions, t.offers, ("category",))
    return share.withColumnRenamed("customer_share", "X87")


@query("feat_spend_or_share")
def feat_spend_or_share(t: RetailTables) -> DataFrame:
    spine = stage(_spine(t), "spine")
    events = lb.history_events(t.transactions, spine)
    own = lb.per_shopper(lb.event_measures(events), lb.own_features())
    share = mk.market_share(t.transactions, t.offers)
    rows = own.join(spine.select("id", *ITEMS), "id").join(share, list(ITEMS))
    return rows.select("id", spend_or_share("own_amount", "market_share").alias("X85"))


# --- the feature tables --------------------------------------------------------


@query("base_features")
def base_features(t: RetailTables) -> DataFrame:
    return ft.base_features(t.transactions, t.offers, t.train_history)


@query("base_features_from_reduction")
def base_features_from_reduction(t: RetailTables) -> DataFrame:
    # total spend is the one base feature that needs the whole log
    reduced = rd.reduce_transactions(t.transactions, t.offers)
    return ft.base_features(reduced, t.offers, t.train_history).drop("X7")


@query("feature_matrix")
def feature_matrix(t: RetailTables) -> DataFrame:
    return ft.feature_matrix(t.transactions, t.offers, t.train_history)


@query("feature_matrix_returned")
def feature_matrix_returned(t: RetailTables) -> DataFrame:
    full = ft.feature_matrix(t.transactions, t.offers, t.train_history, keep_offer_columns=True)
    return ft.sorted_for_export(full)


@query("feature_matrix_before_offer")
def feature_matrix_before_offer(t: RetailTables) -> DataFrame:
    return ft.feature_matrix(t.transactions, t.offers, t.train_history, before_offer=True)


def _several(history: DataFrame) -> DataFrame:
    """A third of the shoppers has a second offer, twenty days later."""
    more = history.where("id % 3 = 1").withColumns(
        {"offer": F.col("offer") % 35 + 1, "offerdate": F.date_add("offerdate", 20)}
    )
    return history.unionByName(more)


@query("feature_matrix_by_offer")
def feature_matrix_by_offer(t: RetailTables) -> DataFrame:
    return so.feature_matrix_by_offer(t.transactions, t.offers, _several(t.train_history))


@query("feature_matrix_by_offer_before")
def feature_matrix_by_offer_before(t: RetailTables) -> DataFrame:
    history = _several(t.train_history)
    return so.feature_matrix_by_offer(t.transactions, t.offers, history, before_offer=True)


@query("feature_matrix_test")
def feature_matrix_test(t: RetailTables) -> DataFrame:
    return ft.feature_matrix(t.transactions, t.offers, t.test_history)


@query("dropped_shoppers")
def dropped_shoppers(t: RetailTables) -> DataFrame:
    return ft.dropped_shoppers(t.transactions, t.offers, t.train_history)


@query("dropped_shoppers_before_offer")
def dropped_shoppers_before_offer(t: RetailTables) -> DataFrame:
    return ft.dropped_shoppers(t.transactions, t.offers, t.train_history, before_offer=True)


@query("left_out")
def left_out(t: RetailTables) -> DataFrame:
    return dropped_shoppers(t).select("id")


@query("left_out_before_offer")
def left_out_before_offer(t: RetailTables) -> DataFrame:
    return dropped_shoppers_before_offer(t).select("id")


# --- clustering ------------------------------------------------------------------


def _scaled(t: RetailTables) -> DataFrame:
    return sg.scaled_matches(t.transactions, stage(_spine(t), "spine"))


def _zscore(item: str) -> None:
    @query(f"zscore_{item}")
    def zscored(t: RetailTables) -> DataFrame:
        scaled = sg.scaled_matches(t.transactions, stage(_spine(t), "spine"), (item,))
        return scaled.select(
            F.col("value").alias(item), *[F.round(c, 6).alias(c) for c in NUMERIC]
        )


for _item in ("category", "company", "brand"):
    _zscore(_item)


@query("kproto_cost_k1")
def kproto_cost_k1(t: RetailTables) -> DataFrame:
    costs = sg.elbow(_scaled(t), ks=[1])
    return costs.select("item", F.round("cost", 4).alias("cost"))


@query("kproto_assign_step")
def kproto_assign_step(t: RetailTables) -> DataFrame:
    scaled = _scaled(t)
    rows = kp.assign(scaled, kp.starting_fits(scaled, [3]))
    return rows.select("item", "value", "cluster", F.round("distance", 5).alias("distance"))


@query("kproto_update_step")
def kproto_update_step(t: RetailTables) -> DataFrame:
    scaled = _scaled(t)
    moved = kp.prototypes_of(kp.assign(scaled, kp.starting_fits(scaled, [3])))
    return moved.select(
        "item", "cluster", "n", "mode", *[F.round(c, 6).alias(c) for c in NUMERIC]
    )


@query("kproto_elbow")
def kproto_elbow(t: RetailTables) -> DataFrame:
    return sg.elbow(_scaled(t)).select("item", "k", F.round("cost", 4).alias("cost"))


@query("kproto_labels")
def kproto_labels(t: RetailTables) -> DataFrame:
    scaled = _scaled(t)
    rows = sg.labelled(scaled, sg.cluster(scaled, ks=[3]))
    numbers = [F.round(c, 6).alias(c) for c in NUMERIC]
    distance = F.round("distance", 5).alias("distance")
    return rows.select("id", "item", "value", *numbers, "k", "cluster", distance)


@query("kproto_random_starts")
def kproto_random_starts(t: RetailTables) -> DataFrame:
    costs = sg.elbow(_scaled(t), ks=[2, 3], seed=1)
    return costs.select("item", "k", F.round("cost", 4).alias("cost"))
