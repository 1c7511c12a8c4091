"""Chi-square test of homogeneity between two category distributions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.config import Feature
from siltmark.functions.columns import null_safe_keys, rounded
from siltmark.functions.pvalues import chi2_p_value
from siltmark.operators.psi import category_statistics, counted_sides


def with_chi2(found: DataFrame, p_value: bool = True) -> DataFrame:
    """Rows of ``category_statistics`` built without a stored list, with ``chi2_statistic, dof`` and the p-value."""
    stat, dof = F.coalesce("chi2", F.lit(0.0)), F.col("k") - 1
    found = found.withColumns({"chi2_statistic": rounded(stat, 4), "dof": dof.cast("long")})
    return found.withColumn("chi2_p_value", rounded(chi2_p_value(F.col("chi2"), dof), 6)) if p_value else found


@null_safe_keys
def chi2_homogeneity(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    keys: Sequence[str] = (),
    add: int = 1,
    p_value: bool = True,
) -> DataFrame:
    """``keys, feature, chi2_statistic, dof, chi2_p_value, ref_n, cur_n``.

    ``add`` goes into every cell; two categories (one degree of freedom) get the continuity correction.
    """
    keys = list(keys)
    found = with_chi2(category_statistics(*counted_sides(ref, cur, features, keys), keys=keys, add=add), p_value)
    return found.select(*keys, "feature", "chi2_statistic", "dof", *(["chi2_p_value"] if p_value else []), "ref_n", "cur_n")
