"""Comorbidity flags of an admission from its secondary diagnosis codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltframe.codes import COMORBIDITY_CODES

# Output column of each plain flag (fixed values: names).
PLAIN_FLAGS = {
    "chf": "congestive_heart_failure",
    "arrhy": "cardiac_arrhythmias",
    "valve": "valvular_disease",
    "pulmcirc": "pulmonary_circulation",
    "perivasc": "peripheral_vascular",
    "para": "paralysis",
    "neuro": "other_neurological",
    "chrnlung": "chronic_pulmonary",
    "dmcx": "diabetes_complicated",
    "hypothy": "hypothyroidism",
    "renlfail": "renal_failure",
    "liver": "liver_disease",
    "ulcer": "peptic_ulcer",
    "aids": "aids",
    "lymph": "lymphoma",
    "mets": "metastatic_cancer",
    "arth": "rheumatoid_arthritis",
    "coag": "coagulopathy",
    "obese": "obesity",
    "wghtloss": "weight_loss",
    "lytes": "fluid_electrolyte",
    "bldloss": "blood_loss_anemia",
    "anemdef": "deficiency_anemias",
    "alcohol": "alcohol_abuse",
    "drug": "drug_abuse",
    "psych": "psychoses",
    "depress": "depression",
}


def code_masks(spark) -> DataFrame:
    """code -> bit mask of the flags it sets. Built from the code lists alone, so its size
    (a few hundred rows) does not depend on the data and it may be broadcast."""
    masks: dict[str, int] = {}
    for bit, listed in enumerate(COMORBIDITY_CODES.values()):
        for code in listed:
            masks[code] = masks.get(code, 0) | (1 << bit)
    return spark.createDataFrame(sorted(masks.items()), "code string, mask bigint")


def _flag(name: str) -> Column:
    bit = list(COMORBIDITY_CODES).index(name)
    return F.shiftright("mask", bit).bitwiseAND(F.lit(1)).cast("int")


def comorbidity_flags(diagnoses: DataFrame, admissions: DataFrame) -> DataFrame:
    """30 flags for every admission.

    Each code is looked up by its first 3 and 4 characters and as a whole; the flags of an
    admission are one ``bit_or`` over a 64-bit mask, combined before the shuffle. Without
    secondary codes the plain flags are null and the derived ones 0.
    """
    masks = code_masks(diagnoses.sparkSession)
    rows = diagnoses.where(F.col("seq_num") != 1).select("hadm_id", "icd9_code")
    code = F.col("icd9_code")
    parts = {3: F.substring(code, 1, 3), 4: F.substring(code, 1, 4), 5: code}
    for size, part in parts.items():
        found = masks.where(F.length("code") == size).select(
            F.col("code").alias("__code"), F.col("mask").alias(f"__m{size}")
        )
        rows = rows.join(F.broadcast(found), part == F.col("__code"), "left").drop("__code")
    mask = F.lit(0).cast("bigint")
    for size in parts:
        mask = mask.bitwiseOR(F.coalesce(f"__m{size}", F.lit(0)))
    per_admission = rows.groupBy("hadm_id").agg(F.bit_or(mask).alias("mask"))
    joined = admissions.select("hadm_id").join(per_admission, "hadm_id", "left")
    at_most = lambda worse, plain: F.when(worse == 1, 0).when(plain == 1, 1).otherwise(0)
    return joined.select(
        "hadm_id",
        *[_flag(name).alias(out) for name, out in PLAIN_FLAGS.items()],
        F.when((_flag("htn") == 1) | (_flag("htncx") == 1), 1).otherwise(0).alias("hypertension"),
        at_most(_flag("dmcx"), _flag("dm")).alias("diabetes_uncomplicated"),
        at_most(_flag("mets"), _flag("tumor")).alias("solid_tumor"),
    )
