"""Configuration files: defaults, strict reading and checks, path patterns, kinds of known files, workspace facts.

A configuration is small and read by the driver; what it says is applied to tables by column expressions.
"""

from __future__ import annotations

import copy
import os
import re
import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import registry
from ..operators.findings import CONFIDENCES, overridden, rank

FILE_NAME = "sievestone.toml"

# The defaults.
DEFAULTS = tomllib.loads('''
[project]
languages = ["typescript", "tsx", "python", "rust"]
frameworks = ["react", "fastapi"]

[duplication]
enabled = true
detect_names = true
detect_exact = true
detect_structural = true
detect_near = false
detect_semantic_candidates = false
min_tokens = 40
min_lines = 5
min_confidence = "medium"
structural_min_nodes = 5
near_similarity_threshold = 82
near_common_shingle_max_percent = 5
near_common_shingle_min_occurrences = 20
semantic_normalize_boolean_returns = true
semantic_normalize_commutative_ops = true
semantic_normalize_comparisons = true

[style]
simplify_boolean_returns = true
prefer_expression_arrows = true
prefer_guard_clauses = false

[react]
enabled = true
max_component_lines = 180
max_props = 8
detect_prop_drilling = true
prop_drilling_depth = 3

[fastapi]
enabled = true
detect_duplicate_routes = true
detect_blocking_async_calls = true
require_response_model = "warn"
blocking_call_allowlist = []
blocking_call_patterns = ["requests.get", "requests.post", "requests.put", "requests.patch", "requests.delete", "time.sleep", "open(", ".read(", ".write("]

[rust]
enabled = true
max_function_lines = 80
max_params = 6
max_unwraps = 2
max_match_depth = 4

[scanner]
include = []
exclude = []
max_file_size_bytes = 1048576
include_generated = false
detect_javascript = true

[ci]
fail_on = ["new_high"]
baseline = ".sievestone/baseline.json"

[ignore]
paths = [".git", "node_modules", "dist", "build", "coverage", "target", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".next", ".turbo"]

[report]
default_format = "text"

[rules]

[rule_options]
''')
# What lists and words may hold, and the kinds of known files by name.
ALLOWED = {
    "project.languages": ("typescript", "tsx", "python", "rust"), "project.frameworks": ("react", "fastapi"), "ci.fail_on": ("high", "new_high", "new_medium"), "duplication.min_confidence": ("low", "medium", "high", "certain"),
    "report.default_format": ("text", "json", "sarif", "html", "markdown", "md"), "fastapi.require_response_model": ("off", "info", "warn", "error"),
}
LEVELS = ("off", "info", "low", "warn", "medium", "error", "high", "critical")
PERCENTS = ("duplication.near_similarity_threshold", "duplication.near_common_shingle_max_percent")
POSITIVE = ("duplication.near_similarity_threshold", "scanner.max_file_size_bytes", "react.prop_drilling_depth")
OPTIONS = {"min_tokens": int, "min_lines": int, "min_nodes": int, "max_lines": int, "max_params": int, "max_unwraps": int, "max_props": int, "max_depth": int, "min_confidence": str, "include_paths": list, "exclude_paths": list}
#: The limits that a rule takes as options; every rule takes a least confidence and paths.
LIMITS = {
    "style.large_function": ("max_lines",), "style.high_parameter_count": ("max_params",), "rust.large_function": ("max_lines",), "rust.too_many_parameters": ("max_params",), "rust.suspicious_unwrap_policy": ("max_unwraps",), "rust.deeply_nested_match": ("max_depth",),
    "react.large_component": ("max_lines",), "react.too_many_props": ("max_props",), "react.deeply_nested_jsx": ("max_depth",), "react.prop_drilling_candidate": ("max_depth",), "fastapi.large_route_handler": ("max_lines",),
    "duplicate.exact.body": ("min_tokens", "min_lines"), "duplicate.structural.function": ("min_tokens", "min_lines", "min_nodes"), "duplicate.near.function": ("min_tokens", "min_lines"),
}
#: Keys that other tools of this kind know and that mean nothing here, with the reason.
REFUSED = {
    **dict.fromkeys(("near_hash_functions", "near_lsh_bands", "near_lsh_rows", "near_max_bucket_size", "near_max_candidate_pairs"), "near copies are found exactly, by prefixes, without signatures or caps"),
    **dict.fromkeys(("structural_normalize_literals", "structural_max_opaque_percent"), "shapes keep literals and have no opaque nodes"),
    "semantic_property_reads_are_pure": "reads of properties are never moved", "follow_symlinks": "links are never followed", "include_binary": "binary files have no text", "autofix_safe_only": "there are only safe fixes",
}
KINDS = {
    "package_json": "package.json", "tsconfig": "tsconfig.json", "eslint": ".eslintrc .eslintrc.json .eslintrc.js .eslintrc.cjs .eslintrc.mjs eslint.config.js eslint.config.cjs eslint.config.mjs eslint.config.ts eslint.config.cts eslint.config.mts",
    "biome": "biome.json biome.jsonc", "pyproject": "pyproject.toml", "ruff": "ruff.toml .ruff.toml", "mypy": "mypy.ini .mypy.ini", "pyright": "pyrightconfig.json", "semgrep": "semgrep.yml semgrep.yaml .semgrep.yml .semgrep.yaml", "cargo": "cargo.toml",
    "requirements": "requirements.txt", "poetry_lock": "poetry.lock", "uv_lock": "uv.lock", "package_lock": "package-lock.json", "pnpm_lock": "pnpm-lock.yaml", "yarn_lock": "yarn.lock", "bun_lock": "bun.lock bun.lockb",
}


class ConfigError(ValueError):
    """What is wrong, and where."""


def discover(cwd: str) -> str | None:
    """The configuration of a folder or of the nearest folder above it."""
    here = os.path.abspath(cwd)
    while True:
        if os.path.exists(path := os.path.join(here, FILE_NAME)):
            return path
        if (up := os.path.dirname(here)) == here:
            return None
        here = up


def load(path: str | None = None, cwd: str = ".") -> dict:
    """The file's values over the defaults; the defaults alone if there is no file."""
    path = path or discover(cwd)
    if path is None:
        return copy.deepcopy(DEFAULTS)
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def parse(text: str) -> dict:
    """A checked configuration. Unknown keys, wrong types and values out of range are errors; rule names become their codes."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not TOML: {e}") from e
    config = copy.deepcopy(DEFAULTS)
    for section, values in given.items():
        if section not in config or not isinstance(values, dict):
            raise ConfigError(f"unknown section {section}")
        if section in ("rules", "rule_options"):
            config[section] = {code_of(name): v for name, v in values.items()}
            continue
        for key, value in values.items():
            if key in REFUSED:
                raise ConfigError(f"{section}.{key} has no effect here: {REFUSED[key]}")
            if key not in config[section]:
                raise ConfigError(f"unknown key {section}.{key}")
            if type(value) is not type(config[section][key]):
                raise ConfigError(f"{section}.{key} must be of type {type(config[section][key]).__name__}")
            config[section][key] = value
    check(config)
    return config


def code_of(name: str) -> str:
    code = registry.NAMES.get(name.strip().lower())
    if code is None:
        raise ConfigError(f"unknown rule {name}")
    return code


def check(config: dict) -> None:
    at = lambda place: config[place.split(".")[0]][place.split(".")[1]]
    for place, allowed in ALLOWED.items():
        values = at(place) if isinstance(at(place), list) else [at(place)]
        for v in values:
            if v not in allowed:
                raise ConfigError(f"{place}: {v} is none of {', '.join(allowed)}")
    for place in PERCENTS:
        if not 0 <= at(place) <= 100:
            raise ConfigError(f"{place} must lie from 0 to 100")
    for place in POSITIVE:
        if at(place) < 1:
            raise ConfigError(f"{place} must be above 0")
    for code, level in config["rules"].items():
        if level not in LEVELS:
            raise ConfigError(f"rules.{code}: {level} is none of {', '.join(LEVELS)}")
    for code, options in config["rule_options"].items():
        for key, value in options.items():
            if key not in OPTIONS or type(value) is not OPTIONS[key]:
                raise ConfigError(f"rule_options.{code}.{key} is unknown or of another type")
            if key.startswith(("max_", "min_")) and key != "min_confidence" and key not in LIMITS.get(code, ()):
                raise ConfigError(f"rule_options.{code}.{key} has no effect: the rule has no such limit")
            if key == "min_confidence" and value not in ALLOWED["duplication.min_confidence"]:
                raise ConfigError(f"rule_options.{code}.min_confidence: {value} is none of {', '.join(ALLOWED['duplication.min_confidence'])}")


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: stars and question marks also match separators, two stars and one match no folder too."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif c == "*":
            out, k = out + ".*", k + (2 if pattern.startswith("**", k) else 1)
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inside = pattern[k + 1 : end]
            out, k = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and (end := pattern.find("}", k)) > 0:
            out, k = out + "(?:" + "|".join(glob_regex(p)[5:-1] for p in pattern[k + 1 : end].split(",")) + ")", end + 1
        else:
            out, k = out + ("." if c == "?" else re.escape(c)), k + 1
    return f"(?s)^{out}$"


def has_meta(pattern: str) -> bool:
    return bool(re.search(r"[*?\[]", pattern))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def scanned(path: Column, patterns: list[str]) -> Column:
    """Whether a scan's pattern matches a relative path: a pattern as a whole, a literal also as a folder, a bare name anywhere."""
    tests = []
    for pattern in (p.strip().replace("\\", "/").removeprefix("./").rstrip("/") for p in patterns):
        if has_meta(pattern):
            tests.append(path.rlike(glob_regex(pattern)))
        elif pattern:
            tests.append((path == pattern) | F.startswith(path, F.lit(pattern + "/")))
            if "/" not in pattern:
                tests.append(F.array_contains(F.split(path, "/"), pattern))
    return any_of(tests)


def governed(path: Column, patterns: list[str]) -> Column:
    """Whether a policy's pattern matches a path: literals also as an end or inner part, patterns also below any folder."""
    tests = []
    for pattern in (p.strip().replace("\\", "/") for p in patterns):
        if has_meta(pattern):
            tests.append(path.rlike(glob_regex(pattern)))
            if not pattern.startswith("**/"):
                tests.append(path.rlike(glob_regex(f"**/{pattern}")))
        elif pattern:
            tests.append((path == pattern) | F.startswith(path, F.lit(pattern + "/")) | F.endswith(path, F.lit("/" + pattern)) | F.contains(path, F.lit(f"/{pattern}/")))
    return any_of(tests)


def limit(config: dict, rule: str, option: str, usual: int) -> int:
    """A rule's own option, or what holds otherwise."""
    return config["rule_options"].get(rule, {}).get(option, usual)


def in_scope(files: DataFrame, config: dict) -> DataFrame:
    """Files (path, language, source) of the configured languages and paths; those skipped as generated only if they are asked for."""
    ignored = scanned(F.col("path"), config["ignore"]["paths"] + config["scanner"]["exclude"])
    included = scanned(F.col("path"), config["scanner"]["include"]) if config["scanner"]["include"] else F.lit(True)
    wanted = F.coalesce(F.col("language"), F.lit("")).isin(*config["project"]["languages"], *(("javascript", "jsx") if config["scanner"]["detect_javascript"] else ()))
    kept = files.where(included & ~ignored & wanted & (F.octet_length("source") <= config["scanner"]["max_file_size_bytes"]))
    if "skipped" in files.columns:
        kept = kept.where(F.col("skipped").isNull() | F.lit(config["scanner"]["include_generated"]) & F.col("skipped").isin("generated", "minified"))
    return kept


def configured(findings: DataFrame, config: dict) -> DataFrame:
    """Findings under a configuration: rules off, paths out of scope and what is less sure than asked for go, levels set the severity."""
    least = {code: o["min_confidence"] for code, o in config["rule_options"].items() if o.get("min_confidence")}
    at_least = lambda level: rank(F.col("confidence"), CONFIDENCES) >= CONFIDENCES.index(level) + 1
    for code, level in least.items():
        findings = findings.where((F.col("rule") != code) | at_least(level))
    findings = findings.where(~F.startswith("rule", F.lit("duplicate.")) | F.startswith("rule", F.lit("duplicate.name.")) | F.col("rule").isin(*least, "") | at_least(config["duplication"]["min_confidence"]))
    answer = {"off": "off", "info": "info", "error": "error"}.get(config["fastapi"]["require_response_model"])
    levels = ({"fastapi.missing_response_model": answer} if answer else {}) | config["rules"]
    for code, options in config["rule_options"].items():
        mine = F.col("rule") == code
        if options.get("include_paths"):
            findings = findings.where(~mine | governed(F.col("path"), options["include_paths"]))
        if options.get("exclude_paths"):
            findings = findings.where(~mine | ~governed(F.col("path"), options["exclude_paths"]))
    ignored = scanned(F.col("path"), config["ignore"]["paths"] + config["scanner"]["exclude"])
    included = scanned(F.col("path"), config["scanner"]["include"]) if config["scanner"]["include"] else F.lit(True)
    off = [s for s in ("react", "fastapi", "rust") if not config[s]["enabled"] or s != "rust" and s not in config["project"]["frameworks"]]
    return overridden(findings.where(included & ~ignored & ~F.substring_index("rule", ".", 1).isin(*off, "")), levels, [])


def kind(path: Column) -> Column:
    """The kind of a known configuration file by its name, in any case; null for others."""
    name = F.lower(F.substring_index(path, "/", -1))
    known = F.create_map(*[F.lit(x) for k, names in KINDS.items() for n in names.split() for x in (n, k)])
    return F.coalesce(F.element_at(known, name), F.when(name.rlike(r"^tsconfig\..*\.json$"), "tsconfig"))


def facts(files: DataFrame) -> DataFrame:
    """One row of what the files (path, language, source) tell about a workspace."""
    python, source = F.col("language") == "python", F.coalesce("source", F.lit(""))
    holds = lambda *texts: any_of([F.contains(source, F.lit(t)) for t in texts])
    tests = {
        "rust": F.col("language") == "rust", "react_tags": (F.col("language") == "tsx") | F.lower("path").endswith(".jsx"), "fastapi_import": python & holds("from fastapi import", "import fastapi"), "fastapi_app": python & holds("FastAPI("),
        "fastapi_router": python & holds("APIRouter("), "fastapi_route": python & holds("@app.", "@router.", ".get(", ".post("), "fastapi_dependency": python & holds("Depends("), "fastapi_security": python & holds("Security(", "OAuth2", "HTTPBearer", "APIKey"),
        "pydantic_model": python & holds("BaseModel", "pydantic"), "npm": kind(F.col("path")) == "package_lock", "pnpm": kind(F.col("path")) == "pnpm_lock", "yarn": kind(F.col("path")) == "yarn_lock", "bun": kind(F.col("path")) == "bun_lock",
        "poetry": kind(F.col("path")) == "poetry_lock", "uv": kind(F.col("path")) == "uv_lock", "cargo": kind(F.col("path")) == "cargo",
    }
    return files.agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(n) for n, t in tests.items()])
