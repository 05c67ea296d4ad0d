"""Role algebra of the class ontology."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = 255


def effective(role: Column, default_role: Column) -> Column:
    """A borderline class takes its default role, or the terrain role where it has none."""
    return F.when(role == "borderline", F.coalesce(default_role, F.lit("id_terrain"))).otherwise(role)


def tier(role: Column) -> Column:
    return F.when(role.rlike("^ood_tier[123]$"), F.concat(F.lit("T"), F.substring(role, 9, 1))).otherwise("")


def ground_truth(role: Column) -> Column:
    """1 out of distribution, 0 in, 255 to be ignored."""
    return F.when(role.startswith("ood_"), 1).when(role.startswith("id_"), 0).otherwise(IGNORE)
