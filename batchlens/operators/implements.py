"""Checks on interface references of classes; one row per (class, reference)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALID, MISSING = "VALID", "MISSING_REFERENCES"


class Validated(NamedTuple):
    references: DataFrame  # class_fqn, ref, resolved or not
    classes: DataFrame  # fqn, package, name, is_interface, status, ref_count, missing_count


def validate_implements(classes: DataFrame, refs: DataFrame) -> Validated:
    """A reference is good as a full name, or as a plain name in the class's own package."""
    fqns = classes.select(F.col("fqn").alias("target")).distinct()
    package = classes.select(F.col("fqn").alias("class_fqn"), "package")
    asked = refs.distinct().join(package, "class_fqn")
    exact = asked.join(fqns.withColumnRenamed("target", "ref").withColumn("exact", F.lit(True)), "ref", "left")
    local = F.when(~F.col("ref").contains("."), F.concat_ws(".", "package", "ref"))
    checked = exact.withColumn("target", local).join(fqns.withColumn("near", F.lit(True)), "target", "left")
    found = F.coalesce("exact", "near", F.lit(False))
    references = checked.select("class_fqn", "ref", found.alias("resolved"))
    counts = references.groupBy(F.col("class_fqn").alias("fqn")).agg(
        F.count("*").alias("ref_count"), F.count_if(~F.col("resolved")).alias("missing_count")
    )
    status = F.when(F.col("missing_count") > 0, MISSING).when(F.col("missing_count") == 0, VALID)
    judged = classes.select("fqn", "package", "name", "is_interface").join(counts, "fqn", "left").withColumn("status", status)
    return Validated(references, judged.fillna(0, ["ref_count", "missing_count"]))


def missing_implements(v: Validated, reference: str | None = None) -> DataFrame:
    """Unresolved references by class (all, or of one interface)."""
    gone = v.references.where(~F.col("resolved"))
    if reference is not None:
        gone = gone.where(F.col("ref") == reference)
    return gone.join(v.classes.select(F.col("fqn").alias("class_fqn"), "package", "name"), "class_fqn").select("class_fqn", "package", "name", "ref")


def missing_by_reference(v: Validated) -> DataFrame:
    return v.references.where(~F.col("resolved")).groupBy("ref").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "ref")


def valid_implements(v: Validated, limit: int = 50) -> DataFrame:
    """Sound classes with most references first."""
    return v.classes.where((F.col("status") == VALID) & (F.col("ref_count") > 0)).select("fqn", "ref_count").orderBy(F.desc("ref_count"), "fqn").limit(limit)


def suspicious_empty_implements(v: Validated) -> DataFrame:
    """Classes named like implementations that implement nothing."""
    named = F.col("name").endswith("Impl") | F.col("name").endswith("Implementation") | F.col("name").contains("Default")
    return v.classes.where(~F.col("is_interface") & (F.col("ref_count") == 0) & named).select("fqn", "name")


def implements_status_summary(v: Validated, samples: int = 5) -> DataFrame:
    """Class count per status with the first few names."""
    counts = v.classes.groupBy(F.coalesce("status", F.lit("")).alias("s")).agg(F.count("*").alias("class_count"))
    # the rank limit runs before the shuffle as well, so a large status moves few rows
    w = Window.partitionBy("s").orderBy("fqn")
    first = v.classes.select(F.coalesce("status", F.lit("")).alias("s"), "fqn").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples)
    names = first.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("fqn")), ",").alias("sample_classes"))
    return counts.join(names, "s").select(F.nullif("s", F.lit("")).alias("status"), "class_count", "sample_classes")


def interfaces_without_implementation(v: Validated) -> DataFrame:
    sound = v.classes.where(F.col("status") == VALID).select(F.col("fqn").alias("class_fqn"))
    used = v.references.join(sound, "class_fqn", "left_semi").select(F.col("ref").alias("fqn")).distinct()
    return v.classes.where("is_interface").join(used, "fqn", "left_anti").select("fqn", "package")


def abstract_targets_in_implements(v: Validated) -> DataFrame:
    """Classes that are no interfaces but are referenced as such."""
    sound = v.classes.where(F.col("status") == VALID).select(F.col("fqn").alias("class_fqn"))
    targets = v.classes.where(~F.col("is_interface")).select(F.col("fqn").alias("ref"), "name")
    return v.references.join(sound, "class_fqn", "left_semi").groupBy("ref").agg(F.count("*").alias("referenced_by_count")).join(targets, "ref").select(
        F.col("ref").alias("fqn"), "name", "referenced_by_count"
    )


def implements_detail(v: Validated, fqn: str | None = None) -> DataFrame:
    """References of a class with their state and the class status."""
    picked = v.classes if fqn is None else v.classes.where(F.col("fqn") == fqn)
    refs = v.references.select(F.col("class_fqn").alias("fqn"), "ref", "resolved")
    return picked.join(refs, "fqn", "left").select("fqn", "is_interface", "status", "ref", "resolved")


def packages_by_missing_pct(v: Validated, min_classes: int = 5, limit: int = 20) -> DataFrame:
    """Packages of more than five classes by share of classes with missing references."""
    stats = v.classes.where(F.col("package").isNotNull()).groupBy("package").agg(
        F.count("*").alias("total_classes"), F.count_if(F.col("status") == MISSING).alias("missing_count")
    ).where(F.col("total_classes") > min_classes)
    pct = F.round(F.lit(100.0) * F.col("missing_count") / F.col("total_classes"), 2)
    return stats.withColumn("missing_percentage", pct).orderBy(F.desc("missing_percentage"), F.desc("missing_count"), "package").limit(limit)
