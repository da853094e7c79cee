"""Queries over small inline inputs: operators that no provided table feeds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import autofix, registry, routes, rules, suppressions
from ..sources import braces, config, diagnostics, reports, symbols
from . import code
from .catalog import query
from .findings import BASE, RANK, _findings

FILES = [
    ("app/readers.py", '''
from fastapi import APIRouter
router = APIRouter(prefix="/readers")

@router.get("/{reader_id}", response_model=dict)
async def find_reader(reader_id: int):
    """Reads one."""
    time.sleep(1)
    requests.get("http://example.com")
    return session.query(reader_id)

@router.post("/")
def enrol(name, mail, age, city, zip_code, street, phone):
    try:
        total = name + mail
        return total
    except Exception:
        return None

def may_vote(person):
    if person.age >= 18:
        return True
    return False
'''),
    ("app/admin.py", '''
router = APIRouter(prefix="/readers")

@router.get("/{reader_id}")
def find_staff(reader_id):
    return load(reader_id)

def grown_up(someone):
    return someone.age >= 18

class Basket:
    def total(self, rows):
        result = 0
        for row in rows:
            result += row.price * row.count
        return result
'''),
    ("app/cart.py", '''
def sum_up(self, items):
    amount = 0
    for item in items:
        amount += item.price * item.count
    return amount
'''),
    ("app/broken.py", "def broken(:\n"),
]

OUTPUTS = {
    "eslint": json.dumps([{"filePath": "a.ts", "messages": [{"ruleId": "no-var", "severity": 2, "message": "Unexpected var", "line": 3, "column": 5}, {"ruleId": None, "severity": 1, "message": "odd", "line": 4, "column": 1}]}]),
    "biome": json.dumps({"data": {"diagnostics": [{"category": "lint/x", "severity": "warning", "description": "d", "location": {"path": {"file": "b.ts"}, "start": {"line": 1, "column": 2}}}]}}),
    "ruff": json.dumps([{"filename": "a.py", "code": "F401", "message": "unused", "location": {"row": 1, "column": 8}}]),
    "pyright": json.dumps({"generalDiagnostics": [{"file": "a.py", "severity": "error", "message": "bad", "rule": "reportX", "range": {"start": {"line": 0, "character": 4}}}]}),
    "semgrep": json.dumps({"results": [{"check_id": "py.x", "path": "a.py", "start": {"line": 7, "col": 1}, "extra": {"message": "m", "severity": "WARNING"}}]}),
    "tsc": "src/a.ts(10,5): error TS2304: Cannot find name 'x'.\nnoise\n",
    "mypy": "C:\\w\\a.py:3: error: Bad type  [arg-type]\nb.py:4:2: note: see here\n",
    "cargo": "\n".join(json.dumps({"reason": "compiler-message", "message": {"message": m, "level": lv, "code": {"code": c}, "spans": [{"file_name": "src/l.rs", "line_start": 2, "column_start": 3, "is_primary": True}]}}) for m, lv, c in (("unused", "warning", "unused_variables"), ("clone", "warning", "clippy::clone")) ) + "\nnot json",
}
OUTPUTS["clippy"] = OUTPUTS["cargo"]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, "python", s) for p, s in FILES], "path string, language string, source string")


def parsed(spark: SparkSession) -> DataFrame:
    tables = [diagnostics.PARSERS[tool](spark.createDataFrame([(out,), ("{broken",)], "output string")) for tool, out in OUTPUTS.items()]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


@query()
def external_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark)


@query()
def external_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.findings_of(parsed(spark))


@query()
def python_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.extract(files(spark)).drop("body", "inner", "canonical")


@query()
def structural_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.structural_duplicates(symbols.extract(files(spark)))


@query()
def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.semantic_duplicates(symbols.extract(files(spark)))


@query()
def fastapi_duplicate_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.duplicate_routes(symbols.extract(files(spark)))


@query()
def python_style_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.style_findings(symbols.extract(files(spark)))


@query()
def fastapi_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([(p, "python", s) for p, s in (*FILES, *code.ROUTES)], "path string, language string, source string")
    return routes.fastapi(symbols.extract(sources), braces.extract(sources))


@query()
def syntax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return braces.extract(code.files(spark))


@query()
def style_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.style(braces.extract(code.files(spark)), guard_clauses=True)


@query()
def react_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = code.files(spark)
    return rules.react(braces.extract(sources)).unionByName(rules.unstable_keys(sources))


@query()
def rust_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rust(braces.extract(code.files(spark)))


@query()
def normalised_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark).select("path", F.sha2(text.normalised_body(F.col("source")), 256).alias("body_hash"), text.token_estimate(F.col("source")).alias("tokens"))


@query()
def suppression_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = "# sievestone-ignore-next-line style.large_function -- known\nx\n// sievestone-ignore-start rust.x\ny\n// sievestone-ignore-end rust.x\n# sievestone-ignore-start react.y\nz\n"
    return suppressions.directives(spark.createDataFrame([("a.py", source), ("b.py", None)], "path string, source string"))


@query()
def applied_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("a.py", "if x:\n    return True\nreturn False\n"), ("b.py", "é = 1\n")], "path string, source string")
    edits = spark.createDataFrame([("a.py", 0, 34, "return x"), ("b.py", 0, 2, "e")], "path string, start int, stop int, replacement string")
    return autofix.applied(docs, edits)


JSON_PARTS = "'id', id, 'ruleId', rule, 'severity', severity, 'confidence', confidence, 'message', message, 'location', json_object('path', path, 'startLine', start)"
PLACE = f"row_number() OVER (ORDER BY {RANK} DESC, path, start, rule, id) AS place"


@query(f"WITH {BASE} SELECT {PLACE}, (CASE WHEN framework IS NULL THEN json_object({JSON_PARTS}) ELSE json_object({JSON_PARTS}, 'framework', framework) END)::VARCHAR AS value FROM f")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_rows(_findings(spark, sf_dir))


@query(f"""
WITH {BASE} SELECT {PLACE}, json_object('ruleId', rule, 'level', CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END, 'message', json_object('text', message),
  'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', path), 'region', json_object('startLine', start)))), 'partialFingerprints', json_object('stableKey', id::VARCHAR))::VARCHAR AS value FROM f
""")
def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rows(_findings(spark, sf_dir))


@query(r"""
WITH p(path) AS (VALUES ('package.json'), ('web/tsconfig.app.json'), ('ESLint.config.mjs'), ('a/Cargo.toml'), ('src/main.rs'), ('uv.lock'), (NULL)),
n AS (SELECT path, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM p)
SELECT path, CASE WHEN name = 'package.json' THEN 'package_json' WHEN name = 'uv.lock' THEN 'uv_lock' WHEN name = 'cargo.toml' THEN 'cargo' WHEN regexp_matches(name, '^tsconfig(\..*)?\.json$') THEN 'tsconfig'
  WHEN regexp_matches(name, '^eslint\.config\.(js|cjs|mjs|ts|cts|mts)$') THEN 'eslint' END AS kind FROM n
""")
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["package.json", "web/tsconfig.app.json", "ESLint.config.mjs", "a/Cargo.toml", "src/main.rs", "uv.lock", None]
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", config.kind(F.col("path")).alias("kind"))


@query()
def workspace_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks = spark.createDataFrame([("uv.lock", None, ""), ("Cargo.toml", None, "")], "path string, language string, source string")
    return config.facts(files(spark).unionByName(code.files(spark)).unionByName(locks))


CONFIG = """
[rules]
"style.complex_condition" = "error"
"react.unstable.list_key" = "off"
[rule_options."react.missing_key"]
exclude_paths = ["right.tsx"]
[scanner]
exclude = ["src/**/*.rs", "shapes.rs"]
"""


@query()
def configured_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = code.files(spark)
    rows = braces.extract(sources)
    found = rules.union([rules.style(rows), rules.react(rows), rules.unstable_keys(sources), rules.rust(rows)])
    return config.configured(registry.findings(found), config.parse(CONFIG))


@query()
def component_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("a.tsx", "tsx", "const App = () => <Page><Menu /><div /></Page>;\nconst Page = (p) => <Menu>{p.kids}</Menu>;\nfunction Menu() { return <Other />; }\n")], "path string, language string, source string")
    return rules.render_graph(braces.extract(sources))


@query()
def calls_in_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.calls_within(braces.extract(code.files(spark)))


@query()
def code_structural_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.structural_groups(braces.extract(code.files(spark)))


@query()
def safe_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inline sources after their safe rewrites."""
    sources = code.files(spark).where("source IS NOT NULL")
    return autofix.applied(sources, rules.safe_edits(sources, braces.extract(sources)))
