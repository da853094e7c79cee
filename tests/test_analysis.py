"""A whole run over sources: detectors of duplicates, every key of the configuration, baselines and the gate."""

import json
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.operators import analysis, clones, findings, groups, routes
from sievestone.plans import code
from sievestone.plans.fixtures import FILES
from sievestone.sources import baseline, braces, config, symbols

BODY = "\n".join(f"    step{k} = read(item{k}, {k}) + {k}" for k in range(12))
MORE = [
    ("app/one.py", "python", f"def load(a):\n{BODY}\n    return a\n"),
    ("app/two.py", "python", f"# a note\ndef load(a):\n{BODY}  # said\n    return a\n"),
    ("app/near.py", "python", "def fetch(a):\n" + BODY.replace("read(item3, 3)", "read(item3, other)") + "\n    return a\n"),
    ("copy/one.py", "python", f"def load(a):\n{BODY}\n    return a\n"),
    ("gen/made.py", "python", "def made(a, b, c, d, e, f, g):\n    return a\n"),
    ("app/jobs.py", "python", "@router.get('/slow')\nasync def slow():\n    time.sleep(1)\n    my_wait(2)\n"),
    ("web/plain.js", "javascript", "var a = 1;\n"),
]


def files(spark):
    rows = [*code.FILES, *((p, "python", s) for p, s in (*FILES, *code.ROUTES)), *MORE]
    return spark.createDataFrame([(p, lang, s, "generated" if p.startswith("gen/") else None) for p, lang, s in rows], "path string, language string, source string, skipped string")


def found(spark, text):
    rows = analysis.findings(files(spark), config.parse(text)).collect()
    return {(r.rule, r.path, r.start): r for r in rows}


@pytest.fixture(scope="module")
def usual(spark):
    return found(spark, "")


def of(rows, rule):
    return {(path, start) for r, path, start in rows if r == rule}


def test_duplicates(usual):
    assert ("app/one.py", 1) in of(usual, "duplicate.exact.file")
    bodies = [r for (rule, _, _), r in usual.items() if rule == "duplicate.exact.body"]
    assert [(r.path, r.message.split()[-1]) for r in bodies] == [("app/one.py", "3")]
    named = {r.message.split()[1]: r for (rule, _, _), r in usual.items() if rule == "duplicate.name.function"}
    assert "load" in named and named["load"].severity in ("medium", "high", "low")
    assert of(usual, "duplicate.structural.function") and not of(usual, "duplicate.near.function") and not of(usual, "duplicate.semantic.function")


CHANGED = """
[project]
languages = ["typescript", "tsx", "python"]
[duplication]
detect_exact = false
detect_names = false
detect_structural = false
detect_near = true
detect_semantic_candidates = true
near_similarity_threshold = 60
semantic_normalize_boolean_returns = false
[style]
simplify_boolean_returns = false
prefer_expression_arrows = false
prefer_guard_clauses = true
[react]
max_component_lines = 3
max_props = 20
detect_prop_drilling = false
[fastapi]
detect_duplicate_routes = false
require_response_model = "error"
blocking_call_allowlist = ["time.sleep"]
blocking_call_patterns = ["my_wait(", "time.sleep"]
[scanner]
include_generated = true
exclude = ["web/right.tsx"]
[ignore]
paths = ["copy"]
[rule_options."style.high_parameter_count"]
max_params = 0
[rule_options."style.complex_condition"]
min_confidence = "high"
[rules]
"python.broad_exception" = "off"
"""


def test_every_key_acts(spark, usual):
    got = found(spark, CHANGED)
    assert [p for _, p, _ in usual if p.endswith(".rs")] and not [p for _, p, _ in got if p.endswith(".rs")]
    for rule in ("duplicate.exact.file", "duplicate.exact.body", "duplicate.structural.function", "style.boolean_return_simplifiable", "style.expression_arrow_simplifiable", "react.too_many_props", "react.prop_drilling_candidate", "fastapi.duplicate.route", "fastapi.route_conflict", "style.complex_condition", "python.broad_exception"):
        assert of(usual, rule) and not of(got, rule), rule
    assert not [r for r in got if r[0].startswith("duplicate.name.")]
    near = [r for (rule, _, _), r in got.items() if rule == "duplicate.near.function"]
    assert [r.path for r in near] == ["app/near.py"]
    assert not of(got, "duplicate.semantic.function")  # the pair there is used the rewrite that is off
    assert of(got, "react.large_component") and not of(usual, "react.large_component")
    assert {p for p, _ in of(got, "style.high_parameter_count") - of(usual, "style.high_parameter_count")} > {"gen/made.py"}
    blocked = {r.message.split()[-1] for (rule, _, _), r in got.items() if rule == "fastapi.blocking_call_in_async_route"}
    assert blocked == {"my_wait("} and {r.message.split()[-1] for (rule, _, _), r in usual.items() if rule == "fastapi.blocking_call_in_async_route"} >= {"time.sleep"}
    assert {r.severity for (rule, _, _), r in got.items() if rule == "fastapi.missing_response_model"} == {"high"}
    assert [p for _, p, _ in got if p == "gen/made.py"] and not [p for _, p, _ in usual if p == "gen/made.py"]
    assert not [p for _, p, _ in got if p.startswith("copy/") or p == "web/right.tsx"]


def test_sections_turned_off(spark):
    got = found(spark, "[duplication]\nenabled = false\n[react]\nenabled = false\n[fastapi]\nenabled = false\n[rust]\nenabled = false\n[style]\nprefer_guard_clauses = true\n")
    assert {r.split(".")[0] for r, _, _ in got} == {"style", "python"} and of(got, "style.guard_clause")
    got = found(spark, "[project]\nframeworks = []\n[duplication]\nmin_tokens = 4000\nmin_confidence = 'certain'\n[rust]\nmax_unwraps = 0\nmax_params = 1\nmax_function_lines = 2\nmax_match_depth = 1\n[scanner]\ninclude = ['src']\n")
    assert {p.split("/")[0] for _, p, _ in got} == {"src"} and not of(got, "duplicate.structural.function")
    assert {"rust.large_function", "rust.too_many_parameters", "rust.suspicious_unwrap_policy", "rust.deeply_nested_match"} <= {r for r, _, _ in got}


@pytest.mark.parametrize("text", ["[duplication]\nnear_lsh_bands = 24", "[scanner]\nfollow_symlinks = true", "[style]\nautofix_safe_only = true", "[rule_options.'react.missing_key']\nmax_lines = 3", "[rule_options.'react.missing_key']\nmin_confidence = 'sure'"])
def test_keys_without_effect_are_refused(text):
    with pytest.raises(config.ConfigError):
        config.parse(text)


def test_semantic_toggle(spark):
    defs = symbols.extract(files(spark))
    assert clones.semantic(defs).count() == 1 and clones.semantic(defs, without=("boolean_return",)).count() == 0


def plain_near(defs):
    """Scores of all pairs by their definition."""

    def shingles(words, k):
        k = min(k, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    own = {}
    for name, plain, calls in defs:
        w = [t.lower() for t in re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", plain)]
        size = 0 if len(w) < 80 else 1 if len(w) < 250 else 2
        lines = [" ".join(re.sub(r";+\s*$", "", re.sub(r"^[\s{}]+|[\s{}]+$", "", x)).split()) for x in plain.split("\n")]
        lines = [x for x in lines if x and x not in (")", "};", ");")]
        nodes = [t for t in w if t in clones.NODES]
        paths = [">".join(nodes[max(0, i - 3) : i + 1]) for i in range(len(nodes))]
        own[name] = {"token": shingles(w, (3, 5, 7)[size]), "tree": shingles(paths, (3, 4, 5)[size]), "statement": shingles(lines, (1, 2, 3)[size]), "call": {(c,) for c in calls}, "control": {(t,) for t in w if t in ("if", "else", "for", "while", "match", "case", "catch", "except", "try", "return", "await", "?")}, "n": len(lines)}
    df = {}
    for sets in own.values():
        for k in ("token", "tree", "statement", "call", "control"):
            for s in sets[k]:
                df[k, s] = df.get((k, s), 0) + 1
    cutoff = max(20, len(own) * 5 // 100, 2)
    weight = {s: min(8, (len(own) // n).bit_length()) for s, n in df.items() if n < cutoff}
    percent = lambda a, b: 0 if b == 0 else min(100, (a * 100 + b // 2) // b)
    out = {}
    for a, b in combinations(sorted(own), 2):
        both, whole, of_ = 0, 0, {}
        for k in ("token", "tree", "statement", "call", "control"):
            x, y = ({s for s in own[n][k] if (k, s) in weight} for n in (a, b))
            common, united = sum(weight[k, s] for s in x & y), sum(weight[k, s] for s in x | y)
            of_[k] = percent(common, united) if united else 100
            both, whole = both + common, whole + united
        of_["whole"] = percent(both, whole)
        n, m = sorted((own[a]["n"], own[b]["n"]))
        of_["statements"] = 100 if m == 0 else percent(n, m)
        score = (sum(of_[k] * p for k, p in clones.PARTS.items()) + 50) // 100
        if score >= 82 and of_["token"] >= 1:
            out[a, b] = score
    return out


def test_near_pairs(spark):
    rng, rows = np.random.default_rng(1), []
    for family in range(8):
        base = [f"v{rng.integers(0, 90)} = f{rng.integers(0, 30)}(a{rng.integers(0, 90)}, {rng.integers(0, 9)});" for _ in range(int(rng.integers(20, 70)))]
        for copy in range(4):
            own = list(base)
            for at in rng.integers(0, len(own), copy // 2):
                own[at] = f"if (z{rng.integers(0, 99)}) {{ return g{rng.integers(0, 30)}(1); }}"
            plain = "\n".join(own)
            rows.append((len(rows), "ts", f"s{len(rows)}", plain, re.findall(r"([A-Za-z_$][\w$.]*)\s*\(", plain)))
    df = spark.createDataFrame(rows, "id long, language string, shape string, plain string, calls array<string>")
    got = {(min(r.l, r.r), max(r.l, r.r)): r.score for r in clones.near_pairs(df).collect()}
    want = plain_near([(i, plain, calls) for i, _, _, plain, calls in rows])
    assert len(want) > 5 and got == want, {p: (got.get(p), want.get(p)) for p in got.keys() | want.keys() if got.get(p) != want.get(p)}


def test_overlapping_routes(spark):
    names = ["/a/b", "/a/{x}", "/{y}/b", "/{y}/{z}", "/a/c", "/q/{x}", "/a", "/{only}", "/a/b/c", "/{k}/b/{m}", "/"]
    rows = [("GET", n, [p for p in n.split("/") if p]) for n in names]
    got = {(r.l, r.r) for r in routes.overlapping(spark.createDataFrame(rows, "method string, template string, parts array<string>"), "template", "method", lambda s: s.rlike(r"^\{")).collect()}
    free = lambda p: p.startswith("{")
    assert got == {(a, b) for _, a, x in rows for _, b, y in rows if a < b and len(x) == len(y) and all(p == q or free(p) or free(q) for p, q in zip(x, y, strict=True))}


def test_external_findings_are_absorbed(spark):
    found = finding_rows(spark, [("r.one", "a.ts", 3, "m")]).withColumn("start", F.col("line"))
    reported = spark.createDataFrame([("eslint", "a.ts", 3, 1, "no-var", "said", "high", "high"), ("eslint", "a.ts", 4, 1, "no-var", "said", "medium", "high"), ("eslint", "a.ts", 4, 1, "no-var", "said", "high", "high")], "tool string, path string, line long, col long, code string, message string, severity string, confidence string")
    rows = analysis.with_external(found, reported).collect()
    assert sorted((r.rule, r.start, r.severity) for r in rows) == [("external.eslint.no.var", 4, "high"), ("r.one", 3, "high")]


def test_filters(spark):
    rows = finding_rows(spark, [("a", "x.py", 1, "m"), ("b", "y/z.rs", 1, "m"), ("c", "w", 1, "m")]).withColumn("severity", F.when(F.col("rule") == "a", "low").otherwise("high"))
    names = lambda **o: {r.rule for r in findings.allowed(rows, **o).collect()}
    assert names(languages=("rust",)) == {"b"} and names(only_severity="low") == {"a"} and names(languages=("python", "rust"), min_severity="high") == {"b"}


SOURCE = "".join(f"line {k}\n" for k in range(1, 41))


def finding_rows(spark, rows):
    """(rule, path, line, message) as findings."""
    df = spark.createDataFrame(rows, "rule string, path string, line long, message string")
    return df.withColumn("id", F.sha2(F.concat_ws("|", "rule", "path", "line"), 256)).withColumn("severity", F.lit("high")).withColumn("confidence", F.lit("high")).withColumn("fingerprint", F.sha2(F.concat_ws("|", "rule", "path", "message"), 256))


def test_baseline_life_cycle(spark, tmp_path):
    path = str(tmp_path / "inner" / "baseline.json")
    sources = spark.createDataFrame([("a.py", SOURCE), ("b.py", SOURCE.upper())], "path string, source string")
    first = finding_rows(spark, [("r.one", "a.py", 5, "m"), ("r.two", "a.py", 20, "n"), ("r.three", "b.py", 9, "gone")])
    entries = baseline.entries(first, sources, owner="team", first_seen=100)
    baseline.write(path, entries, config_hash="c")
    with pytest.raises(baseline.BaselineError):
        baseline.write(path, entries)
    about, read = baseline.read(spark, path)
    assert about["configHash"] == "c" and about["schemaVersion"] == "1" and read.count() == 3
    status = lambda rows: {r.rule: r.status for r in rows.join(baseline.compared(baseline.entries(rows, sources), read).withColumnRenamed("id", "i"), F.col("id") == F.col("i")).collect()}
    assert set(status(first).values()) == {"existing"}
    moved = finding_rows(spark, [("r.one", "a.py", 5, "m"), ("r.two", "a.py", 20, "other words"), ("r.four", "b.py", 1, "fresh")])
    assert status(moved) == {"r.one": "existing", "r.two": "changed", "r.four": "new"}
    fixed = baseline.compared(baseline.entries(moved, sources), read).where("status = 'fixed'").collect()
    assert len(fixed) == 1
    later = baseline.updated(baseline.entries(moved, sources, first_seen=200), read)
    assert {r.ruleId: (r.firstSeen, r.owner) for r in later.collect()} == {"r.one": (100, "team"), "r.two": (100, "team"), "r.four": (200, None)}
    baseline.write(path, later, force=True, created_at=about["createdAt"])
    assert baseline.read(spark, path)[1].count() == 3
    none = baseline.entries(first, sources)
    assert {r.status for r in baseline.compared(none, None).collect()} == {"not_checked"} and {r.status for r in baseline.compared(none, None, missing_is_empty=True).collect()} == {"new"}


def test_baseline_from_a_report(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text(json.dumps({"findings": [{"baseline_key": "k", "rule_id": "r.one", "locations": [{"path": "a\\b.py", "line": 3}], "severity": "low"}, {"message": "no key"}]}))
    row = baseline.read(spark, str(path))[1].collect()
    assert [(r.ruleId, r.normalizedPath, r.line, r.confidence, r.matchingKeys[1]) for r in row] == [("r.one", "a/b.py", 3, "low", "legacy:k")]
    path.write_text("{}")
    with pytest.raises(baseline.BaselineError):
        baseline.read(spark, str(path))


def test_gate_against_a_baseline(spark, tmp_path):
    settings = config.parse("[ci]\nfail_on = ['new_high']\nbaseline = 'base.json'\n")
    sources = files(spark).drop("skipped").where("path IN ('app/one.py', 'app/two.py', 'copy/one.py')")
    seen = groups.checkpointed(analysis.findings(sources, settings))
    rows, fails = analysis.checked(seen, sources, settings, root=str(tmp_path))
    assert fails.first().fails and {r.status for r in rows.collect()} == {"new"}
    baseline.write(str(tmp_path / "base.json"), baseline.entries(seen, sources))
    rows, fails = analysis.checked(seen, sources, settings, root=str(tmp_path))
    assert not fails.first().fails and {r.status for r in rows.collect()} == {"existing"}
    assert analysis.checked(seen, sources, config.parse("[ci]\nfail_on = ['high']\nbaseline = 'base.json'"), root=str(tmp_path))[1].first().fails
    sure = rows.where(findings.blocks(rows)).count()
    assert 0 < sure <= rows.count() and braces.extract(sources).count() >= 0
