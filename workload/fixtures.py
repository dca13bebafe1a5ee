"""Clinical-shaped views over the given star-schema tables (see FIXTURES.md).

Constant lists are looked up by position inside a row, so a view costs at most one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltframe.functions.scalar import hours
from tiltframe.operators.scaling import Scaler
from tiltframe.operators.scorers import ColumnScorer

# --- fixed values: the lists of FIXTURES.md ---------------------------------------------------
CHART_ITEMS = [
    (720, "SIMV", 1.0), (223849, "CMV", 1.0), (445, "x", 1.0), (720, "Other/Remarks", 1.0),
    (640, "Extubated", 1.0), (640, "Self Extubation", 1.0), (467, "Nasal Cannula", 1.0),
    (467, "Ventilator", 1.0), (211, "x", 4.0), (220045, "x", 7.0), (51, "x", 5.0),
    (8368, "x", 3.0), (456, "x", 3.0), (618, "x", 1.0), (678, "x", 3.0), (223762, "x", 1.0),
    (646, "x", 3.0), (807, "x", 8.0), (220179, "x", 5.0), (220052, "x", 4.0), (224690, "x", 1.0),
    (220277, "x", 2.0), (225664, "x", 6.0), (676, "x", 1.0),
]
LAB_ITEMS = [
    (50868, 1.0), (50862, 0.25), (50882, 1.0), (50885, 4.0), (50912, 4.0), (50902, 3.0),
    (50806, 3.0), (50931, 5.0), (50809, 5.0), (51221, 2.5), (50810, 1.0), (51222, 1.25),
    (50811, 0.5), (50813, 1.25), (50960, 1.5), (50970, 1.5), (51265, 9.0), (50971, 1.0),
    (50822, 0.5), (51275, 4.0), (51237, 1.25), (51274, 4.0), (50983, 5.0), (50824, 4.0),
    (51006, 8.0), (51301, 30.0), (51300, 1.0),
]
ICD_CODES = [
    "39891", "4280", "42731", "V4501", "4240", "4160", "4400", "4019", "40291", "3420", "33392",
    "3450", "4928", "25000", "25040", "2449", "585", "V560", "5712", "5317", "042", "2000", "1970",
    "1629", "7140", "2874", "27800", "78321", "2761", "2800", "2809", "3039", "3050", "V6542",
    "29604", "2950", "311", "3004", "4255", "9999",
]
ETHNICITIES = [
    "WHITE", "WHITE - RUSSIAN", "BLACK/AFRICAN AMERICAN", "HISPANIC OR LATINO", "LATIN AMERICAN",
    "ASIAN - CHINESE", "MIXED BLACK", "UNKNOWN",
]
CARE_UNITS = ["MICU", "CCU", "SICU", "CSRU", "TSICU", "NICU"]
SERVICES = ["MED", "CMED", "SURG", "NMED", "OMED", "ORTHO", "TRAUM"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _at(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def patients(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1925-01-01").cast("date"), (key * 17 % 18000).cast("int"))
    return table(spark, sf, "customer").select(
        key.alias("subject_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("gender"),
        F.when(key % 40 == 0, F.lit("1690-01-01").cast("date")).otherwise(born).alias("dob"),
    )


def admissions(spark, sf) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        key.alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        (day + hours(key % 24)).alias("admittime"),
        (day + hours(key % 240 + 120)).alias("dischtime"),
        F.when(key % 17 == 0, day + hours(60)).alias("deathtime"),
        _at(ETHNICITIES, key % 8).alias("ethnicity"),
        F.col("o_orderpriority").alias("admission_type"),
        F.col("o_orderstatus").alias("diagnosis"),
        F.when(key % 20 == 0, 0).otherwise(1).alias("has_chartevents_data"),
    )


def icustays(spark, sf) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    first = F.struct(
        F.lit(1).alias("n"),
        _at(CARE_UNITS, key % 6).alias("unit"),
        (day + hours(key % 24 + 1)).alias("intime"),
        (day + hours(key % 24 + 21 + key % 97)).alias("outtime"),
    )
    second = F.struct(
        F.lit(2).alias("n"),
        F.lit("MICU").alias("unit"),
        (day + hours(150)).alias("intime"),
        (day + hours(190)).alias("outtime"),
    )
    stays = F.when(key % 5 == 0, F.array(first, second)).otherwise(F.array(first))
    return (
        table(spark, sf, "orders")
        .select("o_orderkey", "o_custkey", F.explode(stays).alias("s"))
        .select(
            (key * 10 + F.col("s.n")).alias("icustay_id"),
            F.col("o_custkey").alias("subject_id"),
            key.alias("hadm_id"),
            F.col("s.unit").alias("first_careunit"),
            "s.intime",
            "s.outtime",
        )
    )


def services(spark, sf) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    first = F.struct(
        (day + hours(key % 24 + 1 + key % 9)).alias("transfertime"),
        F.lit(None).cast("string").alias("prev_service"),
        _at(SERVICES, key % 7).alias("curr_service"),
    )
    second = F.struct(
        (day + hours(key % 24 + 12)).alias("transfertime"),
        F.lit("MED").alias("prev_service"),
        F.lit("NMED").alias("curr_service"),
    )
    moves = F.when(key % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), key.alias("hadm_id"), F.inline_outer(moves)
    )


def _lines_with_orders(spark, sf, *columns) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", *columns)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def chartevents(spark, sf) -> DataFrame:
    part, order, h = F.col("l_partkey"), F.col("o_orderkey"), F.col("h")
    slot = F.when(order % 3 == 0, (part + 7 * h) % 24).otherwise((part + 7 * h) % 16 + 8)
    items = F.array(
        *[
            F.struct(F.lit(i).alias("itemid"), F.lit(v).alias("value"), F.lit(s).alias("scale"))
            for i, v, s in CHART_ITEMS
        ]
    )
    minutes = F.make_dt_interval(
        F.lit(0),
        (order % 24 + 1 + (part + h * 11) % 72).cast("int"),
        (F.col("l_suppkey") % 60).cast("int"),
    )
    return (
        _lines_with_orders(spark, sf, "l_partkey", "l_suppkey", "l_quantity")
        .withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(5))))
        .withColumn("m", F.get(items, slot.cast("int")))
        .select(
            F.col("o_custkey").alias("subject_id"),
            order.alias("hadm_id"),
            (order * 10 + 1).alias("icustay_id"),
            "m.itemid",
            (F.col("o_orderdate") + minutes).alias("charttime"),
            "m.value",
            (F.col("l_quantity") * F.col("m.scale")).alias("valuenum"),
            F.when(part % 50 == 0, 1).when(part % 3 == 0, 0).alias("error"),
        )
    )


def procedures(spark, sf) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    return (
        table(spark, sf, "orders")
        .where(key % 9 == 0)
        .select(
            (key * 10 + 1).alias("icustay_id"),
            (day + hours(key % 24 + 30)).alias("starttime"),
            _at([227194, 225468, 225477, 225792], key % 4).alias("itemid"),
        )
    )


def labevents(spark, sf) -> DataFrame:
    items = F.array(
        *[F.struct(F.lit(i).alias("itemid"), F.lit(s).alias("scale")) for i, s in LAB_ITEMS]
    )
    return (
        _lines_with_orders(spark, sf, "l_partkey", "l_suppkey", "l_quantity")
        .withColumn("m", F.get(items, (F.col("l_suppkey") % 27).cast("int")))
        .select(
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderkey").alias("hadm_id"),
            "m.itemid",
            (F.col("o_orderdate") + hours(F.col("l_partkey") % 60)).alias("charttime"),
            ((F.col("l_quantity") - 2) * F.col("m.scale")).alias("valuenum"),
        )
    )


def diagnoses(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.col("l_linenumber").alias("seq_num"),
        _at(ICD_CODES, F.col("l_partkey") % 40).alias("icd9_code"),
    )


def prescriptions(spark, sf) -> DataFrame:
    start = F.col("l_partkey") % 60
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    lines = _lines_with_orders(spark, sf, "l_partkey", "l_suppkey", "l_linenumber")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        (F.col("o_orderdate") + hours(start)).alias("startdate"),
        (F.col("o_orderdate") + hours(start + F.col("l_suppkey") % 24)).alias("enddate"),
        F.col("p_type").alias("drug_type"),
        F.col("p_name").alias("drug"),
    )


def noteevents(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source", "text")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return docs.join(orders, F.col("doc_id") == F.col("o_orderkey")).select(
        F.col("doc_id").alias("row_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.to_date("o_orderdate").alias("chartdate"),
        (F.col("o_orderdate") + hours(F.col("n_chars") % 96)).alias("charttime"),
        F.col("source").alias("category"),
        "text",
    )


ORDER_FEATURES = ["qty", "price", "disc", "tax", "returned"]
SCALED_FEATURES = ["qty", "price", "disc", "tax"]


def order_features(spark, sf) -> DataFrame:
    """Static feature matrix, one row per order that has lines. Lines are averaged before the
    join, so a huge order crosses the shuffle as a few partial sums."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("case"))
        .agg(
            F.avg("l_quantity").alias("qty"),
            F.avg("l_extendedprice").alias("price"),
            F.avg("l_discount").alias("disc"),
            F.avg("l_tax").alias("tax"),
            F.max(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("returned"),
        )
    )
    labels = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )
    return lines.join(labels, "case").select(
        "case", F.lit(0).alias("timepoint"), *ORDER_FEATURES, "label"
    )


def scaled_order_features(spark, sf) -> DataFrame:
    """The static matrix with its numeric features standardized over the whole frame."""
    data = order_features(spark, sf)
    return Scaler.fit(data, SCALED_FEATURES).transform(data)


DAY_FEATURES = ["view_mean", "click_mean", "purchase_mean", "signup_mean"]


def user_days(spark, sf) -> DataFrame:
    """Panel of daily means per user; timepoint counts down to the last day."""
    kind, value = F.col("event_type"), F.col("value")
    means = [
        F.avg(F.when(kind == k, value)).alias(f"{k}_mean")
        for k in ("view", "click", "purchase", "signup")
    ]
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("case"),
            (30 - F.dayofmonth("ts")).cast("int").alias("timepoint"),
        )
        .agg(*means, F.max(F.when(kind == "error", 1).otherwise(0)).alias("outcome"))
    )


# --- fixed scorers (our own coefficients, the same formulas as in the SQL) --------------------
def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def linear_score(v: dict[str, Column]) -> Column:
    return -0.7 + 0.9 * v["qty"] - 0.4 * v["price"] + 0.6 * v["disc"] - 0.2 * v["tax"] + 0.5 * v["returned"]


def lr_formula(v: dict[str, Column]) -> Column:
    return _sigmoid(linear_score(v))


def mlp_formula(v: dict[str, Column]) -> Column:
    zero = F.lit(0.0)
    h1 = F.greatest(zero, 0.7 * v["qty"] + 0.3 * v["disc"] - 0.2 * v["returned"])
    h2 = F.greatest(zero, 0.5 * v["price"] - 0.6 * v["tax"] + 0.1 * v["returned"])
    return _sigmoid(-0.5 + 1.1 * h1 - 0.8 * h2)


def rf_formula(v: dict[str, Column]) -> Column:
    """Three one-split trees voting in whole percent, so equal votes are exactly equal."""
    t1 = F.when(v["qty"] > 0.2, 70.0).otherwise(30.0)
    t2 = F.when(v["price"] > 0, 35.0).otherwise(60.0)
    t3 = F.when(v["disc"] + v["returned"] > 0.5, 65.0).otherwise(40.0)
    return (t1 + t2 + t3) / 300.0


MODELS = ["lr", "mlp", "rf"]
SCORERS = {
    "lr": ColumnScorer(lr_formula),
    "mlp": ColumnScorer(mlp_formula),
    "rf": ColumnScorer(rf_formula),
}
LINEAR_WEIGHTS = {"qty": 0.9, "price": -0.4, "disc": 0.6, "tax": -0.2, "returned": 0.5}


def day_score(v: dict[str, Column]) -> Column:
    return 0.5 * v["view_mean"] + 0.3 * v["click_mean"] - 0.4 * v["purchase_mean"] + 0.1 * v["signup_mean"]


def sequence_formula(steps: Column) -> Column:
    """Discounted sum over the steps of a padded sequence."""
    parts = F.transform(
        steps,
        lambda s, i: F.pow(F.lit(0.8), i) * day_score({f: s[f] for f in DAY_FEATURES}),
    )
    return _sigmoid(F.aggregate(parts, F.lit(-0.2), lambda a, x: a + x))


SERIES_SCORERS = {"seq": sequence_formula}
# Row-wise models over the daily panel, for the reports that need several timepoints.
DAY_SCORERS = {
    "lr": ColumnScorer(lambda v: _sigmoid(day_score(v) - 0.2)),
    "mlp": ColumnScorer(
        lambda v: _sigmoid(
            0.1
            + 0.8 * F.greatest(F.lit(0.0), day_score(v))
            - 0.6 * F.greatest(F.lit(0.0), 0.4 * v["purchase_mean"] - 0.3 * v["signup_mean"])
        )
    ),
}
