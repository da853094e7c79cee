import re

import pytest
from pyspark.sql import functions as F

from sievestone.operators import findings, registry
from sievestone.plans import QUERIES
from sievestone.sources import config


def test_defaults_and_discovery(tmp_path):
    assert config.parse("") == config.DEFAULTS and config.load(cwd=str(tmp_path)) == config.DEFAULTS
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / config.FILE_NAME).write_text("[react]\nmax_props = 3\n")
    assert config.load(cwd=str(tmp_path / "a" / "b"))["react"]["max_props"] == 3
    assert config.DEFAULTS["react"]["max_props"] == 8


@pytest.mark.parametrize("text", ["[x]\na = 1", "[react]\nmax = 1", "[react]\nmax_props = '3'", "[ci]\nfail_on = ['all']", "[rules]\n'no.rule' = 'warn'", "[rules]\n'react.missing_key' = 'loud'", "[duplication]\nnear_similarity_threshold = 0", "[rule_options.'react.missing_key']\nodd = 1", "= 1"])
def test_errors(text):
    with pytest.raises(config.ConfigError):
        config.parse(text)


@pytest.mark.parametrize(("pattern", "path", "fits"), [("**/*.rs", "a.rs", True), ("**/*.rs", "x/y/a.rs", True), ("src/*.rs", "src/a/b.rs", True), ("a?c", "abc", True), ("[!a]b", "ab", False), ("x.{ts,tsx}", "x.tsx", True), ("a.b", "axb", False)])
def test_glob(pattern, path, fits):
    assert bool(re.match(config.glob_regex(pattern), path)) is fits


def test_patterns_on_columns(spark):
    paths = spark.createDataFrame([("src/gen/a.ts",), ("gen",), ("x/generated.ts",), (None,)], "path string")
    got = paths.select("path", config.scanned(F.col("path"), ["gen"]).alias("s"), config.governed(F.col("path"), ["a.ts", "*ated.ts"]).alias("g")).collect()
    assert [(r.s, r.g) for r in got] == [(True, True), (True, False), (False, True), (None, None)]


def test_kinds_and_facts(spark):
    assert [r.kind for r in QUERIES["config_files"](spark, "").collect()] == ["package_json", "tsconfig", "eslint", "cargo", None, "uv_lock", None]
    facts = QUERIES["workspace_facts"](spark, "").first()
    assert facts.rust and facts.react_tags and facts.fastapi_router and facts.uv and facts.cargo and not facts.npm and not facts.fastapi_app


def test_configured(spark):
    rows = QUERIES["configured_findings"](spark, "").collect()
    assert not [r for r in rows if r.path == "src/shapes.rs" or r.rule == "react.unstable_list_key"]
    assert {r.path for r in rows if r.rule == "react.missing_key"} == {"web/left.tsx"}
    assert {r.severity for r in rows if r.rule == "style.complex_condition"} == {"high"}


def test_catalog(spark):
    rows = QUERIES["rule_catalog"](spark, "").collect()
    assert len(rows) == len({r.rule for r in rows}) == 73
    named = spark.createDataFrame([("React.Large.Component",), ("none",), (None,)], "name string").select(registry.canonical(F.col("name")).alias("c"))
    assert [r.c for r in named.collect()] == ["react.large_component", None, None]
    found = {r.rule for r in QUERIES["code_findings"](spark, "").collect()}
    assert found <= {r.rule for r in rows}


def test_moved_baseline(spark):
    schema = "id int, path string, message string, fingerprint string, content string"
    now = spark.createDataFrame([(1, "a", "m", "f", "c"), (2, "b", "m", "f", "c"), (3, "z", "m", "g", "d"), (4, "q", "m", None, None), (5, "a", "m", "h", "e")], schema)
    old = spark.createDataFrame([(11, "a", "m", "f", "c"), (12, "y", "m", "x", "d"), (13, "q", "m", None, None), (14, "w", "m", "v", "c")], schema)
    got = {tuple(r) for r in findings.baseline_matched(now, old, ("fingerprint", "content")).collect()}
    assert got == {(1, 11, "fingerprint", "existing"), (2, 14, "content", "changed"), (3, 12, "content", "changed"), (4, None, None, "new"), (5, None, None, "new"), (None, 13, None, "fixed")}
    assert findings.baseline_matched(now.limit(0), old.limit(0), ("content",)).count() == 0
