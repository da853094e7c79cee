import json

import pytest
from pyspark.sql import functions as F

from sievestone.functions import similarity, text
from sievestone.operators import autofix, findings
from sievestone.plans import QUERIES
from sievestone.sources import config, reports, workspace


def test_diagnostics(spark):
    rows = {(r.tool, r.code): r for r in QUERIES["external_diagnostics"](spark, "").collect()}
    assert rows["eslint", "no-var"].severity == "high" and rows["eslint", ""].severity == "medium"
    assert rows["tsc", "TS2304"].line == 10 and rows["tsc", "TS2304"].confidence == "certain"
    assert rows["mypy", "arg-type"].path == "C:\\w\\a.py" and rows["mypy", ""].severity == "info"
    assert (rows["pyright", "reportX"].line, rows["pyright", "reportX"].col) == (1, 5)
    assert ("cargo", "unused_variables") in rows and ("clippy", "clippy::clone") in rows and ("cargo", "clippy::clone") not in rows
    assert len(rows) == 11
    found = QUERIES["external_findings"](spark, "")
    assert found.where("rule = 'external.clippy.clippy.clone'").count() == 1


def test_symbols(spark):
    defs = {r.qualified: r for r in QUERIES["python_definitions"](spark, "").collect() if r.qualified}
    assert defs["find_reader"].route == "GET /readers/{reader_id}" and defs["find_reader"].is_async and defs["Basket.total"].kind == "method"
    groups = [set(r.members) for r in QUERIES["structural_duplicates"](spark, "").collect()]
    assert {"app/admin.py:Basket.total", "app/cart.py:sum_up"} in groups
    meant = QUERIES["semantic_duplicates"](spark, "").collect()
    assert [(set(r.members), r.rewrites) for r in meant] == [({"app/admin.py:grown_up", "app/readers.py:may_vote"}, ["boolean_return"])]
    assert [r.n for r in QUERIES["fastapi_duplicate_routes"](spark, "").collect()] == [2]
    rules = {(r.rule, r.qualified) for r in QUERIES["python_style_findings"](spark, "").collect()}
    assert {("style.high_parameter_count", "enrol"), ("python.broad_exception", "enrol")} == rules


def test_suppressions_and_edits(spark):
    got = {(r.rule, r.from_line, r.to_line) for r in QUERIES["suppression_directives"](spark, "").collect()}
    assert got == {("style.large_function", 2, 2), ("rust.x", 4, 4), ("react.y", 7, 8)}
    assert {r.path: r.source for r in QUERIES["applied_edits"](spark, "").collect()} == {"a.py": "return x\n", "b.py": "e = 1\n"}
    files = spark.createDataFrame([("a", "0123456789")], "path string, source string")
    with pytest.raises(ValueError):
        autofix.applied(files, spark.createDataFrame([("a", 0, 5, ""), ("a", 4, 6, "")], "path string, start int, stop int, replacement string"))


def test_workspace(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.ts").write_text("1")
    (tmp_path / "src" / "__init__.py").write_text("app = FastAPI()\n")
    (tmp_path / "src" / "gen.py").write_text("# @generated\n")
    (tmp_path / "src" / "bin.py").write_bytes(b"a\0b")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "src" / "big.rs").write_text("x" * 200)
    (tmp_path / ".hidden.py").write_text("1")
    (tmp_path / "Cargo.toml").write_text("[package]")
    got = {r.path: (r.language, r.skipped) for r in workspace.scan(spark, str(tmp_path), most_bytes=100).collect()}
    assert got == {"src/__init__.py": ("python", None), "src/gen.py": ("python", "generated"), "src/bin.py": ("python", "binary"), "src/bad.py": ("python", "binary"), "src/big.rs": ("rust", "too_large"), "Cargo.toml": (None, None)}
    facts = config.facts(workspace.scan(spark, str(tmp_path))).first()
    assert facts.fastapi_app and facts.cargo and not facts.react_tags


def test_workspace_ignores(spark, tmp_path):
    """What .gitignore files leave out, and the tasks that read the rest."""
    for path in ("a.py", "b.log", "keep.log", "out/x.py", "src/out/y.py", "src/gen/z.py", "src/deep/gen/w.py", "src/doc1.md", "src/doc22.md", "lib/only.txt", "lib/sub/only.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / ".gitignore").write_text("# note\n*.log\n!keep.log\n/out/\nsrc/**/gen\n\n")
    (tmp_path / "src" / ".gitignore").write_text("doc?.md\n")
    (tmp_path / "lib" / ".gitignore").write_text("/only.txt\n")
    reader = workspace.WorkspaceReader(str(tmp_path))
    assert [p for p, _ in reader.files()] == ["a.py", "keep.log", "lib/sub/only.txt", "src/doc22.md", "src/out/y.py"]
    assert workspace.scan(spark, str(tmp_path)).count() == 5
    for k in range(1200):
        (tmp_path / "src" / f"m{k}.py").write_text("x")
    assert [len(p.value) for p in reader.partitions()] == [500, 500, 205]


def finding(spark, rows):
    return spark.createDataFrame(rows, "id int, severity string, confidence string, path string, group_key string").withColumn("penalty_tenths", findings.penalty_tenths(F.col("severity"), F.col("confidence"), findings.context_percent(F.col("path"), F.lit(False))))


def test_score_golden(spark):
    score = lambda rows: findings.score(finding(spark, rows)).first().score
    assert score([(1, "high", "certain", "src/a", "k")]) == 92
    assert score([(1, "high", "medium", "src/a", "k")]) == 96
    assert score([(1, "high", "certain", "tests/a", "k")]) == 96
    assert score([(k, "high", "certain", "src/a", "k") for k in range(20)]) == 76
    assert findings.score(finding(spark, [(1, "high", "certain", "a", "k")]).limit(0)).first().score == 100


def test_reports(spark, tmp_path):
    schema = "id int, severity string, confidence string, rule string, path string, start int, message string"
    rows = spark.createDataFrame([(1, "high", "certain", "r.a", "p<", 3, "m|x"), (2, "low", "low", "r.b", "q", 1, "n")], schema)
    whole = lambda kind, df=rows: "".join(reports.report(df, kind))
    doc = json.loads(whole("sarif"))
    assert [r["level"] for r in doc["runs"][0]["results"]] == ["error", "note"] and doc["runs"][0]["tool"]["driver"]["rules"] == [{"id": "r.a"}, {"id": "r.b"}]
    told = json.loads(whole("json"))
    assert told["counts"] == {"high": 1, "low": 1} and [f["ruleId"] for f in told["findings"]] == ["r.a", "r.b"]
    assert "m\\|x" in whole("markdown") and "r.b" not in whole("markdown")
    assert whole("text") == "HIGH\n  p<\n    3 [r.a] m|x (certain)\nLOW\n  q\n    1 [r.b] n (low)\n"
    assert "p&lt;" in whole("html") and "filter" in whole("html")
    assert json.loads(whole("json", rows.limit(0)))["findings"] == [] and json.loads(whole("sarif", rows.limit(0)))["runs"][0]["results"] == []
    with pytest.raises(ValueError):
        reports.report(rows, "pdf")
    reports.write(rows, "text", str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text() == whole("text")
    known = rows.withColumn("status", F.when(F.col("id") == 1, "existing").otherwise("new")).withColumn("severity", F.lit("high"))
    known = known.withColumn("related", F.expr("array(named_struct('path', 'z', 'line', 9))")).withColumn("replacement", F.when(F.col("id") == 2, "fixed"))
    assert "New findings (1)" in whole("md", known) and "r.a" not in whole("md", known)
    results = json.loads(whole("sarif", known))["runs"][0]["results"]
    assert results[0]["relatedLocations"][0]["physicalLocation"]["region"]["startLine"] == 9 and results[0]["baselineState"] == "unchanged"
    assert "fixes" not in results[0] and results[1]["fixes"][0]["artifactChanges"][0]["replacements"][0]["insertedContent"]["text"] == "fixed"
    many = spark.range(1500).select(F.col("id").cast("int").alias("id"), F.lit("high").alias("severity"), F.lit("low").alias("confidence"), F.lit("r").alias("rule"), F.lit("p").alias("path"), F.col("id").cast("int").alias("start"), F.lit("m").alias("message"))
    assert whole("html", many).count("<tr class") == whole("text", many).count("[r]") == 1500 and "1490 more" in whole("md", many)
    files = spark.createDataFrame([("p<", "a\nb\nc\nd\ne\nf")], "path string, source string")
    assert {r.id: r.snippet for r in reports.with_snippets(rows, files).collect()} == {1: "a\nb\nc\nd\ne", 2: None}
    assert reports.explained(spark, "React.Large.Component")["rule"] == "react.large_component"


def test_places_of_a_report(spark):
    """Places are those of one sorted list, whatever the partitions."""
    rows = [(k, ("high", "low")[k % 2], f"p{k % 7}", k % 5, f"r{k % 3}") for k in range(500)]
    df = spark.createDataFrame(rows, "id int, severity string, path string, start int, rule string").repartition(7)
    want = sorted(rows, key=lambda r: (r[1] == "low", r[2], r[3], r[4], r[0]))
    got = {r.id: r.place for r in findings.ordered(df).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    assert findings.ordered(df.limit(0)).count() == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.redacted_summary(F.lit("a " + "x" * 90))) == "a [LONG_TEXT:90]"
    assert one(text.redacted_summary(F.lit("my Password"))) == "[REDACTED]"
    assert one(text.normalised_body(F.lit('a = "# no" # yes\n/* b\nc */ d // e'))) == 'a = "# no" d'
    for quote in "\"'`":  # from a table, so that it isn't folded while planning
        long = spark.createDataFrame([(f"a {quote}" + "x\\\\" * 500_000 + f"{quote} // gone",)], "s string").repartition(1)
        assert long.select(text.strip_comments(F.col("s")).alias("x")).first().x.rstrip().endswith("x\\\\" + quote)
    assert one(text.shingles(F.array(*map(F.lit, "abab")), 2)) == ["a b", "b a"]
    assert [one(text.shingle_size(F.lit(n), 3, 5, 7)) for n in (79, 80, 250)] == [3, 5, 7]
    assert one(text.identifier_words(F.lit("readUser_id-x"))) == ["read", "user", "id", "x"]
    assert one(text.rule_code(F.lit("--No Unused/Vars!"))) == "no.unused.vars"
    assert one(text.escaped_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert [one(similarity.percent(F.lit(a), F.lit(b))) for a, b in ((1, 3), (2, 3), (1, 8), (0, 0), (9, 3))] == [33, 67, 13, 0, 100]
    assert one(similarity.count_similarity(F.lit(0), F.lit(0))) == 100
    assert one(similarity.weighted_average((F.lit(100), 1), (F.lit(1), 1))) == 51
    assert one(similarity.rarity(F.lit(100), F.lit(3))) == 6
    assert one(similarity.cosine_percent(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == 50
