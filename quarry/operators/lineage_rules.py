"""Rules that join models to their tests, columns, sources and neighbours, or count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog, blank
from ..registry import Check, Settings, found, rule, say, side

#: Names of columns with personal data, and tags that say so.
PERSONAL = [
    "email", "email_address", "email_addr",
    "phone", "phone_number", "mobile", "mobile_number", "cell_phone",
    "ssn", "social_security", "social_security_number", "sin",
    "dob", "date_of_birth", "birth_date", "birthdate",
    "address", "street_address", "mailing_address", "billing_address", "home_address",
    "ip_address", "ip_addr",
    "credit_card", "card_number", "ccn", "cvv", "pan",
    "passport", "passport_number",
    "national_id", "drivers_license", "license_number",
    "salary", "compensation", "wage", "income",
    "health_record", "diagnosis", "medication",
]
TAGS = ["pii", "phi", "pci", "sensitive", "restricted", "confidential", "gdpr", "personal", "personal_data"]
KEY = ["project_id", "model_id"]


def in_order(pos: str, value: Column | str) -> Column:
    """Values of a group in the order of ``pos``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), value.alias("v")))), lambda x: x["v"])


@side("parents")
def parents(c: Catalog) -> DataFrame:
    """What a model reads, in order: names of models, of sources and of staging models, and the id of the first source."""
    named = c.models.select("project_id", F.col("model_id").alias("parent_id"), F.lit("model").alias("parent_kind"), F.col("name").alias("_name"), (F.col("layer") == "staging").alias("_staging"))
    labelled = c.sources.select("project_id", F.col("source_id").alias("parent_id"), F.lit("source").alias("parent_kind"), F.concat_ws(".", "source_name", "name").alias("_name"), F.lit(False).alias("_staging"))
    edges = c.edges.join(named.union(labelled), ["project_id", "parent_id", "parent_kind"], "left")
    one = F.struct("pos", F.coalesce("_name", "parent_id").alias("name"), "parent_id", "parent_kind", F.coalesce("_staging", F.lit(False)).alias("staging"))
    read = edges.groupBy("project_id", F.col("child_id").alias("model_id")).agg(F.array_sort(F.collect_list(one)).alias("_read"))
    of = lambda kind: F.filter("_read", lambda x: x["parent_kind"] == kind)
    names = lambda x: F.transform(x, lambda e: e["name"])
    return read.select(
        *KEY, names(of("model")).alias("_model_parents"), names(of("source")).alias("_source_parents"), names(F.filter("_read", lambda x: x["staging"])).alias("_staging_parents"),
        F.get(of("source"), F.lit(0))["parent_id"].alias("_first_source"),
    )


@side("readers")
def readers(c: Catalog) -> DataFrame:
    """How many models read a model, and how many models and exposures use it."""
    uses = c.edges.select("project_id", F.col("parent_id").alias("model_id"), "child_id").union(c.exposures.select("project_id", F.col("parent_id").alias("model_id"), F.lit(None).cast("string")))
    return uses.groupBy(*KEY).agg(F.count_distinct("child_id").alias("_readers"), F.count(F.lit(1)).alias("_uses"))


@side("tests")
def tests(c: Catalog) -> DataFrame:
    name = F.lower(F.coalesce("name", F.lit("")))
    return c.tests.groupBy(*KEY).agg(
        F.bool_or(name.contains("unique") | (F.coalesce("test_type", F.lit("")) == "unique")).alias("_unique"), F.bool_or(name.contains("not_null")).alias("_not_null"),
        F.count(F.lit(1)).alias("_tests"), F.collect_set("column_name").alias("_tested"),
    )


@side("columns")
def columns(c: Catalog) -> DataFrame:
    """Names of a model's columns: all, those without description and those that look personal, in order."""
    # One pass a name: a word at either end, set off by an underscore.
    either = "|".join(PERSONAL)
    personal = F.lower("name").rlike(rf"^(?:{either})(?:_|\z)|_(?:{either})\z")
    one = F.struct("pos", "name", blank(F.col("description")).alias("bare"), F.coalesce(personal, F.lit(False)).alias("personal"))
    listed = c.columns.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("_listed"))
    names = lambda x: F.transform(x, lambda e: e["name"])
    return listed.select(
        *KEY, F.array_distinct(names(F.col("_listed"))).alias("_names"), names(F.filter("_listed", lambda x: x["bare"])).alias("_bare"), names(F.filter("_listed", lambda x: x["personal"])).alias("_personal"),
    )


@side("staged", "sources", ("project_id", "source_id"))
def staged(c: Catalog) -> DataFrame:
    """Sources that a staging model reads."""
    staging = c.models.filter("layer = 'staging'").select("project_id", F.col("model_id").alias("child_id"))
    used = c.edges.filter("parent_kind = 'source'").join(staging, ["project_id", "child_id"], "left_semi")
    return used.select("project_id", F.col("parent_id").alias("source_id")).distinct().withColumn("_staged", F.lit(True))


@side("sharers")
def sharers(c: Catalog) -> DataFrame:
    """Sources that a model reads as others do that stand on the same side of staging, with how many they are."""
    users = c.kept_models().filter("layer is not null").select(*KEY, (F.col("layer") == "staging").alias("_side"))
    uses = c.edges.filter("parent_kind = 'source'").select("project_id", F.col("child_id").alias("model_id"), F.col("parent_id").alias("source_id")).distinct().join(users, KEY)
    # The count comes first, so single users never move on.
    several = uses.groupBy("project_id", "source_id", "_side").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    label = c.sources.select("project_id", "source_id", F.concat_ws(".", "source_name", "name").alias("_label"))
    rows = uses.join(several, ["project_id", "source_id", "_side"]).join(label, ["project_id", "source_id"], "left")
    return rows.groupBy(*KEY).agg(F.collect_list(F.struct(F.coalesce("_label", "source_id").alias("label"), "others")).alias("_sharers"))


def _in_layer(layer: str) -> Column:
    return F.col("layer") == layer


@rule("structure.staging_refs_source_only", "Staging models read sources only", "error")
def staging_refs_source_only(c: Catalog, p: Settings) -> Check:
    hit = _in_layer("staging") & (F.size("_model_parents") > 0)
    return Check(hit, say("Staging model '{}' reads models: {}", "name", F.array_join("_model_parents", ", ")), "Read sources, or move the model to another layer", needs=("parents",))


@rule("structure.marts_no_source_refs", "Marts models read no sources", "error")
def marts_no_source_refs(c: Catalog, p: Settings) -> Check:
    hit = _in_layer("marts") & (F.size("_source_parents") > 0)
    return Check(hit, say("Marts model '{}' reads sources: {}", "name", F.array_join("_source_parents", ", ")), "Read the source through a staging model", needs=("parents",))


@rule("structure.no_cross_layer_skipping", "Marts models read no staging models", "warning")
def no_cross_layer_skipping(c: Catalog, p: Settings) -> Check:
    message = lambda parent: say("Marts model '{}' reads staging model '{}'", "name", parent)
    return Check(_in_layer("marts"), message, "Put an intermediate model between them", needs=("parents",), each=F.col("_staging_parents"))


@rule("structure.no_orphan_models", "Models are read by something", "warning")
def no_orphan_models(c: Catalog, p: Settings) -> Check:
    return Check(F.col("_uses").isNull(), say("Model '{}' is read by no model and no exposure", "name"), "Remove it or name what uses it in an exposure", needs=("readers",))


@rule("structure.max_fanout", "Models have few direct readers", "warning")
def max_fanout(c: Catalog, p: Settings) -> Check:
    most = int(p("max_children", 10))
    return Check(F.col("_readers") > most, say(f"Model '{{}}' has {{}} direct readers, more than {most}", "name", "_readers"), "Put a model between it and groups of readers", needs=("readers",))


@rule("testing.primary_key_test_required", "Models test a key as unique and not null", "error")
def primary_key_test_required(c: Catalog, p: Settings) -> Check:
    unique, not_null = (F.coalesce(k, F.lit(False)) for k in ("_unique", "_not_null"))
    lacks = F.array_join(F.array_compact(F.array(F.when(~unique, "unique"), F.when(~not_null, "not_null"))), ", ")
    return Check(~(unique & not_null), say("Model '{}' lacks key tests: {}", "name", lacks), "Add unique and not_null tests to its key", needs=("tests",))


@rule("testing.minimum_test_coverage", "Models have some tests", "warning")
def minimum_test_coverage(c: Catalog, p: Settings) -> Check:
    least, n = int(p("min_tests_per_model", 2)), F.coalesce("_tests", F.lit(0))
    return Check(n < least, say(f"Model '{{}}' has {{}} tests, fewer than {least}", "name", n), "Add tests", needs=("tests",))


@rule("testing.staging_freshness_required", "Sources of staging models are watched for freshness", "warning")
def staging_freshness_required(c: Catalog, p: Settings) -> Check:
    hit = F.col("_staged") & (F.coalesce("loaded_at_field", F.lit("")) == "") & (F.coalesce("max_loaded_at", F.lit("")) == "")
    return Check(hit, say("Source '{}' has no freshness", F.concat_ws(".", "source_name", "name")), "Set loaded_at_field and freshness", base="sources", needs=("staged",))


@rule("testing.column_test_coverage", "Documented columns are tested", "info")
def column_test_coverage(c: Catalog, p: Settings) -> Check:
    least = float(p("min_coverage_pct", 0.5))
    every = F.size("_names")
    tested = F.coalesce(F.size(F.array_intersect("_names", "_tested")), F.lit(0))
    share = tested / F.nullif(every, F.lit(0))
    hit = F.col("_names").isNotNull() & (share < least)
    return Check(hit, say("Model '{}' tests {}% of its columns ({} of {})", "name", (share * 100).cast("int"), tested, every), "Test more columns", needs=("columns", "tests"))


@rule("documentation.column_description_required", "Columns of the listed layers are described", "warning")
def column_description_required(c: Catalog, p: Settings) -> Check:
    shown = F.concat(F.array_join(F.slice("_bare", 1, 5), ", "), F.when(F.size("_bare") > 5, "...").otherwise(""))
    hit = F.col("layer").isin(list(p("layers", ["marts"]))) & (F.size("_bare") > 0)
    return Check(hit, say("Model '{}' has columns without description: {}", "name", shown), "Describe them in the YAML file", needs=("columns",))


@rule("documentation.schema_yml_exists", "Directories with models have a YAML file", "warning")
def schema_yml_exists(c: Catalog, p: Settings) -> DataFrame:
    dirs = c.kept_models().filter("file_path like '%/%'").select("project_id", F.regexp_replace("file_path", r"/[^/]*$", "").alias("_dir")).distinct()
    have = c.yaml_files.select("project_id", F.regexp_replace("path", r"/[^/]*$", "").alias("_dir")) if c.yaml_files is not None else dirs.limit(0)
    rows = dirs.join(have, ["project_id", "_dir"], "left_anti")
    return found(rows, say("Directory '{}' has models but no YAML file", "_dir"), "Add one that documents them", name="_dir", path="_dir")


@rule("security.pii_columns_tagged", "Models with personal data are tagged", "warning")
def pii_columns_tagged(c: Catalog, p: Settings) -> Check:
    tagged = F.arrays_overlap(F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower), F.array(*map(F.lit, TAGS)))
    more = F.when(F.size("_personal") > 5, F.concat(F.lit(" (+"), (F.size("_personal") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    message = say("Model '{}' has columns that look personal: {}{}", "name", F.array_join(F.slice("_personal", 1, 5), ", "), more)
    return Check(~tagged & (F.size("_personal") > 0), message, "Tag the model, for instance pii", needs=("columns",))


def _shared_source(hit: Column, text: str) -> Check:
    return Check(hit, lambda x: say(text, "name", x["label"], x["others"]), "Read the source through one shared model", needs=("sharers",), each=F.col("_sharers"))


@rule("reuse.duplicate_source_staging", "A source has one staging model", "warning")
def duplicate_source_staging(c: Catalog, p: Settings) -> Check:
    return _shared_source(_in_layer("staging"), "Staging model '{}' stages source '{}', as do {} others")


@rule("reuse.multiple_models_from_same_source", "A source is read through staging", "warning")
def multiple_models_from_same_source(c: Catalog, p: Settings) -> Check:
    return _shared_source(~_in_layer("staging"), "Model '{}' reads source '{}' directly, as do {} others")
