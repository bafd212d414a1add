"""Rules that look at one model or source at a time: naming, layout, descriptions, materialisation, ownership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Catalog, blank, truthy
from ..registry import Check, Settings, rule, say

#: Words in the names of sources that hold privileged data.
PRIVILEGED = [
    "user", "users", "customer", "customers", "patient", "patients",
    "employee", "employees", "person", "people", "member", "members",
    "account", "accounts", "contact", "contacts",
    "payment", "payments", "transaction", "transactions",
    "order", "orders", "invoice", "invoices",
]
CLASSIFIED = ["data_classification", "access_policy", "sensitivity", "pii"]


def _label() -> Column:
    return F.concat_ws(".", "source_name", "name")


def _sources(hit: Column, message: Column, suggestion: str) -> Check:
    return Check(hit, message, suggestion, base="sources")


@rule("naming.staging_prefix", "Staging models are named stg_<source>__<entity>", "error")
def staging_prefix(c: Catalog, p: Settings) -> Check:
    hit = (F.col("layer") == "staging") & ~F.col("name").rlike(r"^stg_[a-z0-9_]+__[a-z0-9_]+$")
    hint = F.when(F.col("_first_source").isNotNull(), say("Rename it, for instance to stg_<source>__{}", F.substring_index("_first_source", ".", -1))).otherwise("Rename it to stg_<source>__<entity>")
    return Check(hit, say("Staging model '{}' does not follow stg_<source>__<entity>", "name"), hint, needs=("parents",))


@rule("naming.intermediate_prefix", "Intermediate models start with int_", "error")
def intermediate_prefix(c: Catalog, p: Settings) -> Check:
    hit = (F.col("layer") == "intermediate") & ~F.col("name").startswith("int_")
    return Check(hit, say("Intermediate model '{}' does not start with int_", "name"), "Rename it to int_<entity>_<verb>")


@rule("naming.marts_prefix", "Marts models start with fct_ or dim_", "error")
def marts_prefix(c: Catalog, p: Settings) -> Check:
    hit = (F.col("layer") == "marts") & ~(F.col("name").startswith("fct_") | F.col("name").startswith("dim_"))
    return Check(hit, say("Marts model '{}' starts with neither fct_ nor dim_", "name"), "Rename it to fct_<entity> or dim_<entity>")


@rule("naming.source_schema_required", "Sources name their schema", "warning")
def source_schema_required(c: Catalog, p: Settings) -> Check:
    return _sources(F.coalesce("schema_name", F.lit("")) == "", say("Source '{}' has no schema", _label()), "Set schema on the source")


@rule("naming.model_file_matches_name", "A model's file is named like the model", "warning")
def model_file_matches_name(c: Catalog, p: Settings) -> Check:
    own = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.sql$", "")
    hit = (F.coalesce("file_path", F.lit("")) != "") & (own != F.col("name"))
    return Check(hit, say("Model '{}' is in a file named '{}'", "name", own), "Give file and model the same name")


@rule("structure.model_directories_match_layers", "Models lie in the directory of their layer", "warning")
def model_directories_match_layers(c: Catalog, p: Settings) -> Check:
    n = F.col("name")
    wanted = F.when(n.startswith("stg_"), "staging").when(n.startswith("int_"), "intermediate").when(n.startswith("fct_") | n.startswith("dim_"), "marts")
    path = F.coalesce("file_path", F.lit(""))
    hit = wanted.isNotNull() & (path != "") & ~path.contains(F.concat(F.lit("/"), wanted, F.lit("/"))) & ~path.startswith(F.concat(wanted, F.lit("/")))
    return Check(hit, say("Model '{}' should be under {}/", "name", wanted), say("Move it to models/{}/", wanted))


@rule("testing.marts_have_contract", "Marts models enforce a contract", "warning")
def marts_have_contract(c: Catalog, p: Settings) -> Check:
    hit = (F.col("layer") == "marts") & ~F.coalesce("contract_enforced", F.lit(False))
    return Check(hit, say("Marts model '{}' does not enforce a contract", "name"), "Set contract.enforced: true")


@rule("testing.no_disabled_tests", "Models are not disabled", "warning")
def no_disabled_tests(c: Catalog, p: Settings) -> Check:
    hit = F.col("config")["enabled"] == "false"
    return Check(hit, say("Model '{}' is disabled", "name"), "Enable or remove it")


@rule("documentation.model_description_required", "Models of the listed layers have a description", "warning")
def model_description_required(c: Catalog, p: Settings) -> Check:
    hit = F.col("layer").isin(list(p("layers", ["marts", "intermediate"]))) & blank(F.col("description"))
    return Check(hit, say("Model '{}' has no description", "name"), "Describe the model in its YAML file")


@rule("documentation.source_description_required", "Sources have a description", "info")
def source_description_required(c: Catalog, p: Settings) -> Check:
    return _sources(blank(F.col("description")), say("Source '{}' has no description", _label()), "Describe the source table")


@rule("materialization.staging_must_be_view", "Staging models are views", "warning")
def staging_must_be_view(c: Catalog, p: Settings) -> Check:
    kind = F.lower(F.coalesce("materialization", F.lit("")))
    hit = (F.col("layer") == "staging") & (kind != "") & ~kind.isin("view", "ephemeral")
    return Check(hit, say("Staging model '{}' is materialized as {}", "name", "materialization"), "Make it a view")


def _incremental(key: str, more: Column | None = None) -> Check:
    hit = (F.lower("materialization") == "incremental") & ~truthy(F.col("config")[key])
    return Check(hit if more is None else hit & more, say("Incremental model '{}' sets no " + key, "name"), f"Set {key} in its config")


@rule("materialization.incremental_must_have_unique_key", "Incremental models set unique_key", "error")
def incremental_must_have_unique_key(c: Catalog, p: Settings) -> Check:
    return _incremental("unique_key")


@rule("materialization.incremental_must_have_on_schema_change", "Incremental models set on_schema_change", "warning")
def incremental_must_have_on_schema_change(c: Catalog, p: Settings) -> Check:
    return _incremental("on_schema_change")


@rule("materialization.incremental_requires_partition", "Incremental models beyond staging set partition_by", "warning")
def incremental_requires_partition(c: Catalog, p: Settings) -> Check:
    return _incremental("partition_by", F.col("layer") != "staging")


@rule("materialization.marts_not_view", "Marts and intermediate models are not views", "warning")
def marts_not_view(c: Catalog, p: Settings) -> Check:
    hit = F.col("layer").isin("marts", "intermediate") & (F.lower("materialization") == "view")
    return Check(hit, say("{} model '{}' is a view", F.initcap("layer"), "name"), "Materialize it as a table or incrementally")


@rule("materialization.table_requires_cluster_by", "Marts tables set cluster_by", "info")
def table_requires_cluster_by(c: Catalog, p: Settings) -> Check:
    hit = (F.col("layer") == "marts") & F.lower("materialization").isin("table", "incremental") & ~truthy(F.col("config")["cluster_by"])
    return Check(hit, say("Marts model '{}' sets no cluster_by", "name"), "Set cluster_by in its config")


@rule("migration.no_layering", "Models belong to a layer by name or directory", "warning")
def no_layering(c: Catalog, p: Settings) -> Check:
    named = F.col("name").rlike("(?i)^(stg_|int_|fct_|dim_)")
    placed = F.coalesce("file_path", F.lit("")).rlike("(?i)/(staging|intermediate|marts|mart)/")
    return Check(~named & ~placed, say("Model '{}' belongs to no layer", "name"), "Rename it and move it to the directory of its layer")


@rule("governance.model_ownership_required", "Models have an owner or a group", "warning")
def model_ownership_required(c: Catalog, p: Settings) -> Check:
    hit = ~truthy(F.col("meta")["owner"]) & (F.coalesce("grp", F.lit("")) == "")
    return Check(hit, say("Model '{}' has neither owner nor group", "name"), "Set meta.owner or group")


@rule("governance.public_models_need_contract", "Public models enforce a contract", "error")
def public_models_need_contract(c: Catalog, p: Settings) -> Check:
    hit = (F.col("access") == "public") & ~F.coalesce("contract_enforced", F.lit(False))
    return Check(hit, say("Public model '{}' does not enforce a contract", "name"), "Set contract.enforced: true")


@rule("governance.required_meta_fields", "Models set the listed meta fields", "warning")
def required_meta_fields(c: Catalog, p: Settings) -> Check:
    fields = list(p("fields", []))
    wanted = F.array(*map(F.lit, fields)).cast("array<string>")
    missing = F.filter(wanted, lambda k: ~truthy(F.element_at("meta", k)))
    return Check(F.size(missing) > 0, say("Model '{}' lacks meta fields: {}", "name", F.array_join(missing, ", ")), "Add them to the model's meta")


@rule("security.privileged_access_policy", "Sources with privileged data are classified", "info")
def privileged_access_policy(c: Catalog, p: Settings) -> Check:
    words = F.array(*map(F.lit, PRIVILEGED))
    named = F.exists(words, lambda w: F.contains(F.lower("name"), w) | F.contains(F.lower("source_name"), w))
    classified = F.exists(F.array(*map(F.lit, CLASSIFIED)), lambda k: truthy(F.element_at("meta", k)))
    return _sources(named & ~F.coalesce(classified, F.lit(False)), say("Source '{}' seems to hold personal or business data but has no classification", _label()), "Set meta.data_classification on the source")

