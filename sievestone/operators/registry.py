"""The rules by code, and findings from what rules found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, severity, confidence, and other names of each rule.
RULES = """
duplicate.exact.file high certain duplicate.exact_file
duplicate.exact.body high certain duplicate.exact_body
duplicate.name.function medium high
duplicate.name.class medium high
duplicate.name.method medium high
duplicate.name.react_component medium high
duplicate.name.react_hook medium high
duplicate.name.fastapi_route_handler medium high
duplicate.name.rust_type medium high
duplicate.name.rust_impl_method medium high
duplicate.structural.function medium high duplicate.structural_function
duplicate.near.function medium medium duplicate.near_function
duplicate.semantic.function medium medium duplicate.semantic_function
duplicate.semantic.vector_candidate info low duplicate.semantic_vector_candidate
style.boolean_return_simplifiable low medium
style.expression_arrow_simplifiable low medium
style.unnecessary_else_after_return low medium
style.nested_conditional low medium
style.guard_clause low medium
style.duplicated_literal low medium
style.large_function low medium
style.high_parameter_count low medium
style.complex_condition low medium
python.broad_exception low medium
python.repeated_validation_logic low medium
python.duplicated_route_handler_business_logic low medium
rust.large_function medium medium
rust.too_many_parameters medium medium
rust.duplicate_free_function medium high
rust.duplicate_impl_method medium high rust.duplicate_impl_method_body
rust.duplicate_trait_method_implementation medium medium
rust.repeated_match_arm_body low high rust.duplicate_match_arm_body
rust.suspicious_unwrap_policy medium medium rust.repeated_unwrap_policy rust.unwrap_expect_policy
rust.expect_without_context low medium
rust.repeated_error_mapping low medium
rust.manual_option_result_pattern_candidate low medium rust.manual_result_option_pattern
rust.deeply_nested_match medium medium
rust.large_enum_variant_logic low medium
rust.repeated_result_handling low medium
rust.repeated_conversion_function low medium
rust.repeated_validation_logic low medium
rust.repeated_serde_glue low medium
rust.clippy_unavailable info high
rust.clippy_run_failed info high
react.large_component medium medium react.large.component
react.too_many_props medium medium
react.deeply_nested_jsx medium medium
react.duplicate_component_shape medium medium
react.repeated_hook_logic medium medium
react.unnecessary_effect_candidate medium medium
react.derived_state_candidate medium medium
react.inline_component_inside_render medium medium
react.unstable_list_key medium medium react.unstable.list_key
react.missing_key medium medium
react.prop_drilling_candidate medium medium
react.large_context_provider medium medium
react.mixed_data_fetching_and_rendering medium medium
react.component_too_many_responsibilities medium medium
react.redundant_fragment medium medium
fastapi.duplicate.route high certain fastapi.duplicate_route
fastapi.route_conflict high high
fastapi.blocking_call_in_async_route medium high
fastapi.missing_response_model medium medium fastapi.missing.response_model
fastapi.large_route_handler medium medium
fastapi.business_logic_in_route medium medium
fastapi.repeated_dependency_logic medium medium
fastapi.repeated_auth_logic medium medium
fastapi.broad_exception_in_route medium high
fastapi.inconsistent_status_code low medium
fastapi.duplicated_pydantic_model low medium
fastapi.route_handler_duplicate_logic medium high
fastapi.sync_db_call_inside_async_route medium medium
fastapi.requests_call_inside_async_route medium high
"""
SAFE_FIXES = ("style.boolean_return_simplifiable", "style.expression_arrow_simplifiable", "react.redundant_fragment")
CATEGORIES = {"duplicate": "duplication", "python": "style"}
PARSED = [line.split() for line in RULES.strip().splitlines()]
NAMES = {name.lower(): code for code, _, _, *aliases in PARSED for name in (code, *aliases)}


def catalog(spark: SparkSession) -> DataFrame:
    """One row per rule."""
    framework = lambda code: next((f for f in ("react", "fastapi") if f in code.split(".")[0] or f"name.{f}" in code), None)
    rows = [(code, CATEGORIES.get(code.split(".")[0], code.split(".")[0]), severity, confidence, framework(code), code in SAFE_FIXES, aliases) for code, severity, confidence, *aliases in PARSED]
    return spark.createDataFrame(rows, "rule string, category string, severity string, confidence string, framework string, safe_fix boolean, aliases array<string>")


def canonical(name: Column) -> Column:
    """The code that a name or another name stands for, whatever its case; null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.lower(F.trim(name)))


def findings(found: DataFrame) -> DataFrame:
    """Rows (rule, path, line, name, detail) as findings with the standing of their rules and a key that outlives moves of lines.

    Rows of unknown rules stay, as low findings of low confidence.
    """
    known = F.broadcast(catalog(found.sparkSession).drop("aliases", "category").withColumnRenamed("rule", "__rule"))  # 73 rows
    joined = found.join(known, F.col("rule") == F.col("__rule"), "left").drop("__rule")
    message = F.concat_ws(" ", F.concat(F.col("rule"), F.lit(":")), "name", "detail")
    key = F.sha2(F.concat_ws("|", "rule", "path", F.coalesce("name", F.lit("")), F.coalesce("detail", F.lit(""))), 256)
    place = F.sha2(F.concat_ws("|", key, F.col("line").cast("string")), 256)
    return joined.select(place.alias("id"), "rule", F.coalesce("severity", F.lit("low")).alias("severity"), F.coalesce("confidence", F.lit("low")).alias("confidence"), "path", F.col("line").cast("long").alias("start"), "line", "framework", message.alias("message"), key.alias("fingerprint"), F.coalesce("safe_fix", F.lit(False)).alias("safe_fix"))
