"""A whole run: files to findings under a configuration, compared with a baseline, and whether it fails."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import baseline as baselines
from ..sources import braces, diagnostics, symbols
from ..sources.config import configured, in_scope, limit
from . import clones, registry, routes, rules, suppressions
from .findings import gate, suppressed

REWRITES = {"semantic_normalize_boolean_returns": ("boolean_return",), "semantic_normalize_commutative_ops": ("commutative_order", "boolean_order"), "semantic_normalize_comparisons": ("comparison_inversion", "equality_order")}


def duplicates(files: DataFrame, rows: DataFrame, defs: DataFrame, config: dict) -> list[DataFrame]:
    """The detectors of duplicates that the configuration turns on."""
    d, found = config["duplication"], clones.definitions(rows, defs)
    if not d["enabled"]:
        return []
    size = lambda rule, **usual: {"least_lines": limit(config, rule, "min_lines", usual.get("lines", d["min_lines"])), "least_tokens": limit(config, rule, "min_tokens", usual.get("tokens", d["min_tokens"]))}
    out = []
    if d["detect_exact"]:
        out += [clones.exact_files(files), clones.exact_bodies(found, **size("duplicate.exact.body"))]
    if d["detect_names"]:
        out.append(clones.names(found))
    if d["detect_structural"]:
        out.append(clones.structural(found, **size("duplicate.structural.function", lines=1, tokens=5), least_nodes=limit(config, "duplicate.structural.function", "min_nodes", d["structural_min_nodes"])))
    if d["detect_semantic_candidates"]:
        out.append(clones.semantic(defs, without=tuple(r for key, used in REWRITES.items() if not d[key] for r in used)))
    if d["detect_near"]:
        out.append(clones.near(found, threshold=d["near_similarity_threshold"], least=d["near_common_shingle_min_occurrences"], share=d["near_common_shingle_max_percent"], **size("duplicate.near.function")))
    return out


def found_by(files: DataFrame, config: dict) -> DataFrame:
    """What the rules find in files (path, language, source), with the limits of the configuration."""
    at = lambda rule, option, usual: limit(config, rule, option, usual)
    rows, defs = braces.extract(files), symbols.extract(files)
    style = rules.style(rows, most_lines=at("style.large_function", "max_lines", 80), most_params=at("style.high_parameter_count", "max_params", 6), guard_clauses=config["style"]["prefer_guard_clauses"])
    plain = symbols.style_findings(defs, most_lines=at("style.large_function", "max_lines", 80), most_params=at("style.high_parameter_count", "max_params", 6))
    plain = plain.select("rule", "path", "line", F.col("qualified").alias("name"), F.lit(None).cast("string").alias("detail"))
    r, f, s = config["react"], config["fastapi"], config["rust"]
    tables = [style, plain, rules.literals(rows), rules.validations(files), *duplicates(files, rows, defs, config)]
    if r["enabled"] and "react" in config["project"]["frameworks"]:
        tables += [rules.unstable_keys(files), rules.react(rows, most_lines=at("react.large_component", "max_lines", r["max_component_lines"]), most_props=at("react.too_many_props", "max_props", r["max_props"]), most_depth=at("react.deeply_nested_jsx", "max_depth", 5), forwards=at("react.prop_drilling_candidate", "max_depth", r["prop_drilling_depth"]))]
    if f["enabled"] and "fastapi" in config["project"]["frameworks"]:
        tables.append(routes.fastapi(defs, rows, most_lines=at("fastapi.large_route_handler", "max_lines", 80), patterns=tuple(f["blocking_call_patterns"]), allowed=tuple(f["blocking_call_allowlist"])))
    if s["enabled"]:
        tables.append(rules.rust(rows, most_lines=at("rust.large_function", "max_lines", s["max_function_lines"]), most_params=at("rust.too_many_parameters", "max_params", s["max_params"]), most_unwraps=at("rust.suspicious_unwrap_policy", "max_unwraps", s["max_unwraps"]), most_depth=at("rust.deeply_nested_match", "max_depth", s["max_match_depth"])))
    off = [
        *(["style.boolean_return_simplifiable"] if not config["style"]["simplify_boolean_returns"] else []), *(["style.expression_arrow_simplifiable"] if not config["style"]["prefer_expression_arrows"] else []), *(["react.prop_drilling_candidate"] if not r["detect_prop_drilling"] else []),
        *(["fastapi.duplicate.route", "fastapi.route_conflict"] if not f["detect_duplicate_routes"] else []), *(["fastapi.blocking_call_in_async_route"] if not f["detect_blocking_async_calls"] else []),
    ]
    return rules.union(tables).where(~F.col("rule").isin(*off, ""))


def findings(files: DataFrame, config: dict) -> DataFrame:
    """Findings in files (path, language, source, and skipped if known), with suppressed_by from directives in them."""
    files = in_scope(files, config)
    found = configured(registry.findings(found_by(files, config)), config)
    # A rule about names says by its detail how grave it is.
    named = F.startswith("rule", F.lit("duplicate.name.")) & ~F.col("rule").isin(*config["rules"], "")
    graver = F.regexp_extract("message", r":(high|medium|low):\d+$", 1)
    found = found.withColumn("severity", F.when(named & (graver != ""), graver).otherwise(F.col("severity")))
    return suppressed(found, suppressions.directives(files))


def with_external(found: DataFrame, reported: DataFrame) -> DataFrame:
    """Findings and those of external tools (rows of sources/diagnostics); an external one on lines that a finding covers is absorbed by it."""
    external = diagnostics.findings_of(reported)
    spans = found.select("id", "path", F.col("start").alias("start_line"), F.col("start").alias("end_line"))
    kept, _ = diagnostics.merged(external, spans)
    given = kept.select("id", "rule", "severity", "confidence", "path", F.col("line").alias("start"), "line", "message", F.col("key").alias("fingerprint"))
    return found.unionByName(given, allowMissingColumns=True)


def checked(found: DataFrame, files: DataFrame, config: dict, *, root: str = ".", ci: bool = True) -> tuple[DataFrame, DataFrame]:
    """Findings with their status beside the configured baseline, and one row that says whether any of ci.fail_on is met."""
    path = os.path.join(root, config["ci"]["baseline"])
    now = baselines.entries(found, files)
    before = baselines.read(found.sparkSession, path)[1] if os.path.exists(path) else None
    met = baselines.compared(now, before, missing_is_empty=ci).where("id IS NOT NULL").select(F.col("id").alias("__id"), "status")
    rows = found.join(met, F.col("id").cast("string") == F.col("__id"), "left").drop("__id")
    tests = [gate(rows, level).first().fails for level in config["ci"]["fail_on"]]
    return rows, rows.sparkSession.range(1).select(F.lit(any(tests)).alias("fails"))
