"""Reuse rules on parsed SQL: similar pairs, clusters, equal CTEs, equal columns, equal derivations.

Their input is ``profiles(catalog)``, parsed once a catalog (see ``sqlprofile``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..registry import Settings, found, rule, say
from . import similarity
from .sqlprofile import parsed

PAIR_RULE = "reuse.model_similarity_candidates"


def bounds(p: Settings) -> tuple[float, int]:
    """Least score and most matches of a model: as set, else those of the ``preset``, which is balanced by default."""
    score, most = similarity.PRESETS[p("preset", "balanced")]
    return float(p("min_score", score)), int(p("max_matches_per_model", most))


@rule(PAIR_RULE, "Models of a layer are not nearly the same", "warning")
def model_similarity_candidates(c: Catalog, p: Settings) -> DataFrame:
    score, most = bounds(p)
    pairs = similarity.similar_pairs(parsed(c).profiles, score)
    rows = pairs.join(similarity.greedy(pairs, most), ["project_id", "left_id", "right_id"], "left_semi")
    changed = None if c.changed is None else c.changed.select("project_id", F.col("path").alias("right_path")).distinct().withColumn("_right", F.lit(True))
    if changed is not None:
        left = c.changed.select("project_id", F.col("path").alias("left_path")).distinct().withColumn("_left", F.lit(True))
        rows = rows.join(changed, ["project_id", "right_path"], "left").join(left, ["project_id", "left_path"], "left")
        turned = F.coalesce("_right", F.lit(False)) & ~F.coalesce("_left", F.lit(False))
    else:
        turned = F.lit(False)
    rows = rows.withColumns({"_name": F.when(turned, F.col("right_name")).otherwise(F.col("left_name")), "_path": F.when(turned, F.col("right_path")).otherwise(F.col("left_path")), "_other": F.when(turned, F.col("left_name")).otherwise(F.col("right_name"))})
    shared = F.array_join(F.slice("shared_inputs", 1, 4), ", ")
    message = say("Model '{}' is highly similar to '{}' (similarity score {}, confidence {}); shared inputs: {}", "_name", "_other", F.format_number("score", 2), similarity.confidence(F.col("score")), shared)
    file = similarity.suggested_name("int_", F.col("shared_inputs"), F.concat_ws("_", "left_name", "right_name"))
    return found(rows, message, say("Move the shared logic to a model such as {}", file), name="_name", path="_path")


@rule("reuse.model_similarity_clusters", "Groups of similar models share a model", "warning")
def model_similarity_clusters(c: Catalog, p: Settings) -> DataFrame:
    own = parsed(c).profiles
    groups = similarity.clusters_of(similarity.groups_of(similarity.similar_kinds(own, bounds(p.of(PAIR_RULE))[0])), int(p("min_cluster_size", 3)))
    message = say("{} models form a reuse cluster: {} (average {}); shared inputs: {}; shared columns: {}", "size", "members", F.format_number("average_score", 2), "shared_inputs", "shared_columns")
    file = similarity.suggested_name("int_", F.filter(F.split("shared_inputs", ", "), lambda x: x != ""), F.array_join(F.slice(F.split("members", ", "), 1, 2), "_"))
    return found(groups, message, say("Move the shared logic to a model such as {}", file), name="anchor", path="anchor_path")


@rule("reuse.identical_select_columns", "Models do not select the same columns from the same inputs", "warning")
def identical_select_columns(c: Catalog, p: Settings) -> DataFrame:
    rows = identical_selects(parsed(c).profiles, int(p("min_columns", 5)))
    return found(rows, say("Model '{}' selects the same {} columns from the same inputs as {} others", "name", F.size("selected"), "others"), "Select them once in a shared model")


def identical_selects(profiles: DataFrame, least_columns: int = 5) -> DataFrame:
    """Models whose inputs, selected columns and layer equal those of another, with how many ``others``."""
    keys = {"_inputs": F.array_sort(F.array_distinct("inputs")), "_selected": F.array_sort(F.array_distinct("selected"))}
    rows = profiles.withColumns(keys).filter(F.size("_selected") >= least_columns)
    by = ["project_id", "layer", "_inputs", "_selected"]
    several = rows.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    return rows.join(several, by)


@rule("reuse.shared_cte_candidates", "Equal CTEs are written once", "info")
def shared_cte_candidates(c: Catalog, p: Settings) -> DataFrame:
    rows = parsed(c).ctes.filter(F.length("body") >= int(p("min_sql_length", 48)))
    one = rows.groupBy("project_id", "model_id", "name", "file_path", "body").agg(F.min("cte").alias("cte"))
    several = one.groupBy("project_id", "body").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= int(p("min_occurrences", 3)))
    return found(one.join(several, ["project_id", "body"]), say("Equivalent CTE logic appears in {} models; here as '{}' in '{}'", "_n", "cte", "name"), say("Move it to a model such as int_{}_shared.sql", "cte"))


@rule("reuse.duplicate_column_derivations", "Equal derived columns are written once", "info")
def duplicate_column_derivations(c: Catalog, p: Settings) -> DataFrame:
    rows = parsed(c).derivations
    one = rows.select("project_id", "model_id", "name", "file_path", "layer", "alias", "expression").distinct()
    by = ["project_id", "layer", "alias", "expression"]
    several = one.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= int(p("min_occurrences", 3)))
    return found(one.join(several, by), say("Derived column '{}' is computed alike in {} models: {}", "alias", "_n", "expression"), say("Compute it once in a model such as int_{}_shared.sql", "alias"))
