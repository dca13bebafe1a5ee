"""Column layouts passed between the operators."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("case", "timepoint")
NOT_FOUND = "not_found"

# Long form: one row per perturbation.
EFFECTS = T.StructType(
    [
        T.StructField("case", T.LongType()),
        T.StructField("timepoint", T.IntegerType()),
        T.StructField("baseline", T.DoubleType()),
        T.StructField("model", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("orig_prob", T.DoubleType()),
        T.StructField("perturb_prob", T.DoubleType()),
        T.StructField("effect", T.DoubleType()),
    ]
)

# The demo CSV (fixed values: column names of the public diabetes data set).
DEMO_CSV = T.StructType(
    [
        T.StructField("Pregnancies", T.IntegerType()),
        T.StructField("Glucose", T.IntegerType()),
        T.StructField("BloodPressure", T.IntegerType()),
        T.StructField("SkinThickness", T.IntegerType()),
        T.StructField("Insulin", T.IntegerType()),
        T.StructField("BMI", T.DoubleType()),
        T.StructField("DiabetesPedigreeFunction", T.DoubleType()),
        T.StructField("Age", T.IntegerType()),
        T.StructField("Outcome", T.IntegerType()),
    ]
)

# Features of the ICU study (fixed values: column names).
VITALS = [
    "heartrate_mean", "sysbp_mean", "diasbp_mean", "meanbp_mean",
    "resprate_mean", "tempc_mean", "spo2_mean", "glucose_mean",
]
LABS = [
    "aniongap", "albumin", "bicarbonate", "bilirubin", "creatinine", "chloride", "glucose",
    "hemoglobin", "lactate", "magnesium", "phosphate", "platelet", "potassium", "ptt", "inr",
    "pt", "sodium", "bun", "wbc",
]
STUDY_COMORBIDITIES = ["congestive_heart_failure", "chronic_pulmonary", "pulmonary_circulation"]
STUDY_OTHERS = ["age", "gender"]
