import pytest

from sievestone.operators import rules
from sievestone.plans import QUERIES, code
from sievestone.sources import braces


def places(spark, query):
    return {(r.rule, r.path, r.line) for r in QUERIES[query](spark, "").collect()}


def test_style(spark):
    found = {(r.rule, r.line): r.detail for r in QUERIES["style_findings"](spark, "").where("path = 'web/tools.tsx'").collect()}
    assert found == {
        ("style.expression_arrow_simplifiable", 2): "x * 2", ("style.expression_arrow_simplifiable", 3): "({ x })", ("style.boolean_return_simplifiable", 5): "return age > 17;", ("style.high_parameter_count", 10): "7",
        ("style.complex_condition", 11): "4", ("style.nested_conditional", 11): None, ("style.guard_clause", 11): None, ("style.unnecessary_else_after_return", 18): None,
    }
    others = places(spark, "style_findings")
    assert ("style.unnecessary_else_after_return", "app/orders.py", 2) in others
    assert [r.detail for r in QUERIES["style_findings"](spark, "").where("rule = 'style.boolean_return_simplifiable' AND path LIKE '%.rs'").collect()] == ["x > 3"]


def test_guard_clauses_are_off_by_default(spark):
    assert rules.style(braces.extract(code.files(spark))).where("rule = 'style.guard_clause'").count() == 0


def test_react(spark):
    found = QUERIES["react_findings"](spark, "").collect()
    left = {r.rule.split(".")[1]: r.detail for r in found if r.path == "web/left.tsx"}
    assert left == {
        "too_many_props": "9", "deeply_nested_jsx": "7", "duplicate_component_shape": "2", "repeated_hook_logic": "2", "unnecessary_effect_candidate": None, "derived_state_candidate": None, "inline_component_inside_render": "Left", "unstable_list_key": "key={index}",
        "missing_key": None, "prop_drilling_candidate": "3", "large_context_provider": "7", "mixed_data_fetching_and_rendering": None, "component_too_many_responsibilities": "7",
    }
    assert [(r.path, r.detail) for r in found if r.rule == "react.redundant_fragment"] == [("web/tools.tsx", "<p>one</p>")]
    assert rules.react(braces.extract(code.files(spark)), most_lines=10).where("rule = 'react.large_component'").count() == 2


def test_rust(spark):
    found = {r.split(".")[1] for r, _, _ in places(spark, "rust_findings")}
    assert found == {
        "too_many_parameters", "duplicate_free_function", "duplicate_impl_method", "duplicate_trait_method_implementation", "repeated_match_arm_body", "suspicious_unwrap_policy", "expect_without_context", "repeated_error_mapping",
        "manual_option_result_pattern_candidate", "deeply_nested_match", "large_enum_variant_logic", "repeated_result_handling", "repeated_conversion_function", "repeated_validation_logic",
    }
    rows = braces.extract(code.files(spark))
    assert {r.rule for r in rules.rust(rows, most_lines=5).collect()} >= {"rust.large_function"}
    serde = "fn a(x: &X) -> S {\n  let s = serde_json::to_string(x)?; let t = s.trim(); let u = t.len();\n  if u > 3 { return one(u, t, s); }\n  other(s, t, u, x, one, two, three)\n}\n"
    files = spark.createDataFrame([("a.rs", "rust", serde), ("b.rs", "rust", serde.replace("fn a(x", "fn b(y").replace("(x)", "(y)").replace(" x,", " y,"))], "path string, language string, source string")
    assert {(r.rule, r.detail) for r in rules.rust(braces.extract(files)).collect()} == {("rust.repeated_serde_glue", "2"), ("rust.duplicate_free_function", "2")}


def test_fastapi(spark):
    found = {(r.rule, r.name) for r in QUERIES["fastapi_findings"](spark, "").collect()}
    assert {r.split(".")[-1] if r != "fastapi.duplicate.route" else r for r, _ in found} == {
        "blocking_call_in_async_route", "broad_exception_in_route", "business_logic_in_route", "fastapi.duplicate.route", "duplicated_pydantic_model", "inconsistent_status_code", "missing_response_model", "repeated_auth_logic", "repeated_dependency_logic",
        "requests_call_inside_async_route", "route_conflict", "route_handler_duplicate_logic", "sync_db_call_inside_async_route", "duplicated_route_handler_business_logic",
    }
    assert ("fastapi.business_logic_in_route", "create_order") in found and ("fastapi.missing_response_model", "drop_order") not in found


def test_scanner():
    scan = braces.Scan("a.rs", "rust", "// {\nfn f<'a>(x: &'a str) -> char { let c = '{'; let s = r#\"}\"#; c }\n")
    braces.rust_rows(scan)
    assert [(r["name"], r["params"], r["line"], r["end_line"]) for r in scan.rows] == [("f", ["x"], 2, 2)] and scan.rows[0]["body"].endswith("c }")
    assert braces.rows("a.ts", "typescript", "}}})((") == [] and braces.rows("a.py", "python", "def (") == []


@pytest.mark.parametrize(("text", "returns"), [("return 1;", True), ("f();\n return {a: 1};", True), ("if (a) { return 1; }", False), ("return g(() => { x(); });", True), ("return 1;\nf();", False), ("", False), ("const o = { a };\nreturn o", True)])
def test_last_statement(text, returns):
    assert braces.last_returns(text) is returns


def test_only_child():
    assert braces.single_tag("<p>a</p>") and braces.single_tag("<A b={c} />") and braces.single_tag("{x}")
    assert not braces.single_tag("<p>a</p><p>b</p>") and not braces.single_tag("text") and not braces.single_tag("{a}{b}")


def test_safe_fixes(spark):
    fixed = {r.path: r.source for r in QUERIES["safe_fixes"](spark, "").collect()}
    tools = fixed["web/tools.tsx"]
    assert "=> x * 2;" in tools and "=> ({ x });" in tools and "{\n  return age > 17;\n}" in tools and "() => <p>one</p>;" in tools and "return true" not in tools.split("function pick")[0]
    assert "bool { x > 3 }" in fixed["src/shapes.rs"]
    files = spark.createDataFrame([("a.py", "python", "# é\ndef f(a):\n    if a:\n        return False\n    return True\n"), ("b.ts", "typescript", "const f = (a) => { return g((b) => { return b; }); };\n")], "path string, language string, source string")
    edits = rules.safe_edits(files, braces.extract(files))
    got = {r.path: r.source for r in rules_applied(files, edits)}
    assert got == {"a.py": "# é\ndef f(a):\n    return not (a)\n", "b.ts": "const f = (a) => g((b) => { return b; });\n"}


def rules_applied(files, edits):
    from sievestone.operators import autofix

    return autofix.applied(files, edits).collect()


def test_items_imports_and_calls(spark):
    text = "use std::io::{self, Read};\npub struct A { x: u8 }\npub(crate) trait T { fn f(&self); }\nmod inner { fn g() { h::k(1); A::new(); println!(\"x\"); } }\n"
    rows = braces.rows("a.rs", "rust", text)
    assert {(r["kind"], r["name"], tuple(r["attributes"])) for r in rows if r["kind"] in ("struct", "trait", "mod")} == {("struct", "A", ("pub",)), ("trait", "T", ("pub(crate)",)), ("mod", "inner", ())}
    assert [r["name"] for r in rows if r["kind"] == "call"] == ["h::k", "A::new", "println!"] and [r["name"] for r in rows if r["kind"] == "import"] == ["std::io"]
    script = "import { a } from './a';\nimport b from \"b\";\nexport { c } from 'c';\nexport interface P { q: string }\nexport default class K { }\ntype Z = { a: number };\nlog.info(a.b?.c(1));\n"
    rows = braces.rows("a.ts", "typescript", script)
    assert [r["name"] for r in rows if r["kind"] == "import"] == ["./a", "b", "c"] and [(r["name"], r["attributes"]) for r in rows if r["kind"] in ("interface", "class", "type")] == [("P", ["export"]), ("K", ["export default"]), ("Z", [])]
    assert {r["name"] for r in rows if r["kind"] == "call"} == {"log.info", "a.b?.c"}
    assert [r["name"] for r in braces.rows("a.py", "python", "import os, re\nfrom ..x import y\n") if r["kind"] == "import"] == ["os", "re", "..x"]
    assert {tuple(r) for r in QUERIES["component_graph"](spark, "").collect()} == {("App", "Page"), ("App", "Menu"), ("Page", "Menu")}
    calls = {(r.definition, r.callee, r.n) for r in QUERIES["calls_in_definitions"](spark, "").where("path = 'src/shapes.rs'").collect()}
    assert ("check", "read", 2) in calls and ("open", "File::open", 1) in calls
    groups = {(r.path, r.name, r.detail) for r in QUERIES["code_structural_duplicates"](spark, "").collect()}
    assert {("src/shapes.rs", "from_text", "2"), ("src/shapes.rs", "check", "2"), ("src/shapes.rs", "first", "2")} <= groups


def test_literals_and_validations(spark):
    script = "const a = 'long', b = 'long', c = 'long';\nf('long', 'ab', 'ab', 'ab', 'ab', 1, 1, 1, 1, 1_0, 10, 10, 10);\n"
    python = "if  a < 1:\n    raise ValueError('x')\nif b < 2:\n    raise ValueError('y')\nif c:\n    raise ValueError()\nif d < 3:\n    raise KeyError()\n"
    files = spark.createDataFrame([("a.ts", "typescript", script), ("b.py", "python", python), ("c.py", "python", "if a < 1:\n    raise ValueError()"), ("n.py", "python", None)], "path string, language string, source string")
    assert {(r.path, r.line, r.name, r.detail) for r in rules.literals(braces.extract(files)).collect()} == {("a.ts", 1, "'long'", "4"), ("a.ts", 2, "10", "4")}
    assert [(r.path, r.line, r.detail) for r in rules.validations(files).collect()] == [("b.py", 1, "2")]
