"""Label sets and the activity dimension of the two sensor datasets, and the checks on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LabelSetError(ValueError):
    """A dataset was asked for labels that it can't express."""


# Label sets, the datasets' activity ids, and what is left out on purpose.
LABEL_SETS = {
    "PAMAP2_8": ("lying", "sitting", "standing", "walking", "running", "cycling", "ascending_stairs", "descending_stairs"),
    "CANONICAL_6": ("lying", "sitting", "standing", "walking", "running", "cycling"),
}
ALLOWED = {"pamap2": ("PAMAP2_8", "CANONICAL_6"), "mhealth": ("CANONICAL_6",)}
MAPPED = {
    "pamap2": {1: "lying", 2: "sitting", 3: "standing", 4: "walking", 5: "running", 6: "cycling", 12: "ascending_stairs", 13: "descending_stairs"},
    "mhealth": {1: "standing", 2: "sitting", 3: "lying", 4: "walking", 9: "cycling", 11: "running"},
}
EXCLUDED = {
    "pamap2": {7: "nordic_walking", 16: "vacuum_cleaning", 17: "ironing", 24: "rope_jumping"},
    "mhealth": {5: "climbing_stairs", 6: "waist_bends_forward", 7: "frontal_elevation_arms", 8: "knees_bending_crouching", 10: "jogging", 12: "jump_front_back"},
}
DOCUMENTED = {"pamap2": {9: "watching_tv", 10: "computer_work", 11: "car_driving", 18: "folding_laundry", 19: "house_cleaning", 20: "playing_soccer"}, "mhealth": {}}
NULL_ID = 0
#: Why an activity is left out.
REASONS = {
    ("mhealth", 5): "stairs without a direction: either of the two directions would be made up",
    ("mhealth", 10): "a class of its own beside running: folding it in would redefine running",
}

LABEL_DIM = "dataset string, activity_id int, name string, role string, reason string"


def permitted_label_sets(dataset: str) -> tuple[str, ...]:
    if dataset not in ALLOWED:
        raise LabelSetError(f"no dataset {dataset!r}; there are {sorted(ALLOWED)}")
    return ALLOWED[dataset]


def resolve_label_set(dataset: str, label_set: str) -> tuple[str, ...]:
    """The labels in their order; refuses a set that the dataset can't tell apart."""
    if label_set not in LABEL_SETS:
        raise LabelSetError(f"no label set {label_set!r}; there are {sorted(LABEL_SETS)}")
    if label_set not in permitted_label_sets(dataset):
        raise LabelSetError(f"{dataset} can't express {label_set}; it can express {', '.join(ALLOWED[dataset])}")
    return LABEL_SETS[label_set]


def id_map(dataset: str, label_set: str) -> dict[int, str]:
    names = resolve_label_set(dataset, label_set)
    return {k: v for k, v in MAPPED[dataset].items() if v in names}


def label_dimension(spark: SparkSession) -> DataFrame:
    """Every known activity with its role: mapped, excluded, documented or null. A few dozen rows."""
    rows = []
    for ds in MAPPED:
        rows.append((ds, NULL_ID, "transient", "null", None))
        rows += [(ds, k, v, "mapped", None) for k, v in MAPPED[ds].items()]
        rows += [(ds, k, v, "excluded", REASONS.get((ds, k), "outside the label sets")) for k, v in EXCLUDED[ds].items()]
        rows += [(ds, k, v, "documented", None) for k, v in DOCUMENTED[ds].items()]
    return spark.createDataFrame(rows, LABEL_DIM)


def verify_labels(counts: DataFrame, dimension: DataFrame, thin_below: int = 500, undocumented_from: int = 1000) -> DataFrame:
    """Tiers of (activity_id, n) against (activity_id, name, role): activity_id, name, n, tier, finding.

    Missing or thin expected activities and large undocumented ones are WARN,
    excluded and documented ones INFO, the rest OK.
    """
    both = counts.join(F.broadcast(dimension), "activity_id", "full_outer")
    n, role = F.coalesce("n", F.lit(0)), F.col("role")
    finding = (
        F.when((role == "mapped") & (n == 0), "missing")
        .when((role == "mapped") & (n < thin_below), "thin")
        .when(role == "mapped", "expected")
        .when((role == "excluded") & (n > 0), "excluded by design")
        .when((role == "documented") & (n > 0), "documented, outside the label sets")
        .when(role.isNull() & (n >= undocumented_from), "undocumented")
        .when(role.isNull(), "undocumented, few rows")
        .when(role == "null", "null class, dropped")
        .otherwise("not present")
    )
    tier = F.when(finding.isin("missing", "thin", "undocumented"), "WARN").when(finding.startswith("excluded") | finding.startswith("documented"), "INFO").otherwise("OK")
    return both.select("activity_id", "name", n.cast("long").alias("n"), tier.alias("tier"), finding.alias("finding"))


def verify_observed(spark: SparkSession, activities: Mapping[int, int], dimension: DataFrame, thin_below: int = 500, undocumented_from: int = 1000) -> DataFrame:
    """``verify_labels`` from counts that were taken while the samples were stored (``profile.stored_samples``)."""
    counts = spark.createDataFrame([(int(k), int(n)) for k, n in activities.items()], "activity_id int, n long")
    return verify_labels(counts, dimension, thin_below, undocumented_from)


def missing_activities(observed: DataFrame, dimension: DataFrame) -> DataFrame:
    """Mapped activities that never occur: an anti join."""
    return dimension.where("role = 'mapped'").join(observed.select("activity_id").distinct(), "activity_id", "left_anti")
