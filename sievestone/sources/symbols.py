"""Definitions of Python sources, with canonical forms of their bodies; one call per file in Arrow batches.

Structure: identifiers become places of parameters, locals and the receiver, in the order they appear.
Semantics, on top: returns of a condition instead of an if that returns booleans, comparisons turned to
one side, operands of commutative and boolean operators in order where reordering is safe.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUTE_VERBS = ("get", "post", "put", "patch", "delete", "options", "head")
SCHEMA = "path string, kind string, name string, qualified string, start_line int, end_line int, params array<string>, is_async boolean, decorators array<string>, route string, calls array<string>, n_nodes int, canonical string, structural_hash string, semantic_hash string, rewrites array<string>, body string, inner string, syntax_error string"
FIELDS = [p.strip().split(" ")[0] for p in SCHEMA.split(", ")]


class Canon(ast.NodeTransformer):
    """Names to places, annotations and docstrings dropped."""

    def __init__(self, params: list[str]):
        self.names = {p: "RECEIVER" if k == 0 and p in ("self", "cls") else f"PARAM_{k}" for k, p in enumerate(params)}

    def visit_Name(self, node: ast.Name) -> ast.AST:
        if isinstance(node.ctx, ast.Store) and node.id not in self.names:
            self.names[node.id] = f"LOCAL_{sum(v.startswith('LOCAL') for v in self.names.values())}"
        return ast.Name(self.names.get(node.id, node.id), ast.Load())


def literal_number(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool)


def boolean(node: ast.AST) -> bool | None:
    if isinstance(node, ast.Return) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, bool):
        return node.value.value
    return None


class Semantics(ast.NodeTransformer):
    """Rewrites that keep the meaning; `used` names those that applied. Python numbers are safe to turn only as literals."""

    TURN = {ast.Gt: ast.Lt, ast.GtE: ast.LtE}

    def __init__(self) -> None:
        self.used: set[str] = set()

    def visit_Compare(self, node: ast.Compare) -> ast.AST:
        self.generic_visit(node)
        if len(node.ops) == 1:
            left, right, op = node.left, node.comparators[0], node.ops[0]
            if type(op) in self.TURN and literal_number(left) and literal_number(right):
                self.used.add("comparison_inversion")
                return ast.Compare(right, [self.TURN[type(op)]()], [left])
            if isinstance(op, (ast.Eq, ast.NotEq)) and isinstance(left, ast.Constant) and isinstance(right, (ast.Name, ast.Constant)) and ast.dump(right) < ast.dump(left):
                self.used.add("equality_order")
                return ast.Compare(right, [op], [left])
        return node

    def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
        self.generic_visit(node)
        if isinstance(node.op, (ast.Add, ast.Mult)) and literal_number(node.left) and literal_number(node.right) and ast.dump(node.right) < ast.dump(node.left):
            self.used.add("commutative_order")
            return ast.BinOp(node.right, node.op, node.left)
        return node

    def visit_BoolOp(self, node: ast.BoolOp) -> ast.AST:
        self.generic_visit(node)
        pure = all(isinstance(v, ast.Compare) and not any(isinstance(x, (ast.Call, ast.Await)) for x in ast.walk(v)) for v in node.values)
        order = sorted(node.values, key=ast.dump)
        if pure and [ast.dump(v) for v in order] != [ast.dump(v) for v in node.values]:
            self.used.add("boolean_order")
            return ast.BoolOp(node.op, order)
        return node

    def block(self, body: list[ast.stmt]) -> list[ast.stmt]:
        out: list[ast.stmt] = []
        k = 0
        while k < len(body):
            s, after = body[k], body[k + 1] if k + 1 < len(body) else None
            if isinstance(s, ast.If) and len(s.body) == 1 and (first := boolean(s.body[0])) is not None:
                other = s.orelse[0] if len(s.orelse) == 1 else after if not s.orelse else None
                if other is not None and boolean(other) is (not first):
                    self.used.add("boolean_return")
                    out.append(ast.Return(s.test if first else ast.UnaryOp(ast.Not(), s.test)))
                    k += 1 if s.orelse else 2
                    continue
            out.append(s)
            k += 1
        return out

    def generic_visit(self, node: ast.AST) -> ast.AST:
        node = super().generic_visit(node)
        for field in ("body", "orelse", "finalbody"):
            if isinstance(getattr(node, field, None), list):
                setattr(node, field, self.block(getattr(node, field)))
        return node


def parameters(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    a = node.args
    return [p.arg for p in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]


def route_of(node: ast.AST, prefixes: dict[str, str]) -> str | None:
    for d in getattr(node, "decorator_list", []):
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_VERBS and isinstance(d.func.value, ast.Name) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
            parts = [p.strip("/") for p in (prefixes.get(d.func.value.id, ""), d.args[0].value)]
            return f"{d.func.attr.upper()} /{'/'.join(p for p in parts if p)}"
    return None


def digest(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def definitions(path: str, source: str) -> list[dict]:
    """One dict per class, function and method, or one that holds the syntax error."""
    none = dict.fromkeys(FIELDS) | {"path": path}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [none | {"kind": "error", "syntax_error": str(e)}]
    prefixes = {}
    for s in ast.walk(tree):
        if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and getattr(s.value.func, "id", "") == "APIRouter":
            prefix = next((k.value.value for k in s.value.keywords if k.arg == "prefix" and isinstance(k.value, ast.Constant)), "")
            prefixes |= {t.id: prefix for t in s.targets if isinstance(t, ast.Name)}
    out: list[dict] = []

    def walk(node: ast.AST, owners: tuple[str, ...], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                out.append(none | {"kind": "class", "name": child.name, "qualified": ".".join([*owners, child.name]), "start_line": child.lineno, "end_line": child.end_lineno, "params": [], "decorators": [ast.unparse(d) for d in child.decorator_list], "is_async": False, "calls": [], "rewrites": [], "body": ast.get_source_segment(source, child)})
                walk(child, (*owners, child.name), True)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                params = parameters(child)
                body = child.body[1:] if ast.get_docstring(child) is not None else child.body
                text = "\n".join(ast.unparse(s) for s in body)
                canonical = Canon(params).visit(ast.parse(text))
                plain = ast.dump(canonical)
                rewriting = Semantics()
                meant = ast.dump(rewriting.visit(ast.parse(ast.unparse(ast.fix_missing_locations(canonical)))))
                route = route_of(child, prefixes)
                out.append(none | {
                    "kind": "route" if route else "method" if in_class else "function", "name": child.name, "qualified": ".".join([*owners, child.name]), "start_line": child.lineno, "end_line": child.end_lineno,
                    "params": params, "is_async": isinstance(child, ast.AsyncFunctionDef), "decorators": [ast.unparse(d) for d in child.decorator_list], "route": route,
                    "calls": [ast.unparse(c.func) for c in ast.walk(child) if isinstance(c, ast.Call)], "n_nodes": sum(1 for _ in ast.walk(canonical)) - 1, "canonical": plain,
                    "structural_hash": digest("canonical", plain), "semantic_hash": digest("semantic", meant), "rewrites": sorted(rewriting.used), "body": ast.get_source_segment(source, child),
                    "inner": "\n".join(source.splitlines()[body[0].lineno - 1 : child.end_lineno]) if body else "",
                })
                walk(child, (*owners, child.name), in_class)
            else:
                walk(child, owners, in_class)

    walk(tree, (), False)
    return out


def extract(files: DataFrame) -> DataFrame:
    """Definitions of the Python files in (path, language, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, lists, flags = {"start_line", "end_line", "n_nodes"}, {"params", "decorators", "calls", "rewrites"}, {"is_async"}
        kind = lambda f: pa.int32() if f in ints else pa.list_(pa.string()) if f in lists else pa.bool_() if f in flags else pa.string()
        for batch in batches:
            rows = [d for path, source in zip(*[c.to_pylist() for c in batch.columns], strict=True) for d in definitions(path, source or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], kind(f)) for f in FIELDS], names=FIELDS)

    return files.where("language = 'python' AND source IS NOT NULL").select("path", "source").mapInArrow(run, SCHEMA)


def structural_duplicates(defs: DataFrame, least_nodes: int = 5) -> DataFrame:
    callable_ = defs.where("kind IN ('function', 'method', 'route')").where(F.col("n_nodes") >= least_nodes)
    found = callable_.groupBy("structural_hash").agg(F.array_sort(F.collect_set(F.concat_ws(":", "path", "qualified"))).alias("members"))
    return found.where("size(members) > 1")


def semantic_duplicates(defs: DataFrame) -> DataFrame:
    """Equal in meaning, by at least one rewrite, and not all equal in structure."""
    found = defs.where("semantic_hash IS NOT NULL").groupBy("semantic_hash").agg(F.array_sort(F.collect_set(F.concat_ws(":", "path", "qualified"))).alias("members"), F.countDistinct("structural_hash").alias("structures"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rewrites")))).alias("rewrites"))
    return found.where("size(members) > 1 AND structures > 1 AND size(rewrites) > 0").drop("structures")


def style_findings(defs: DataFrame, *, most_lines: int = 80, most_params: int = 6) -> DataFrame:
    """(rule, path, qualified, line) of rules that look at one definition."""
    params = F.size(F.filter("params", lambda p: ~p.isin("self", "cls")))
    rules = {
        "style.large_function": F.col("end_line") - F.col("start_line") + 1 > most_lines,
        "style.high_parameter_count": params > most_params,
        "python.broad_exception": F.col("body").rlike(r"(?m)^\s*except\s*(:|\(?\s*(Base)?Exception\b)"),
    }
    hit = F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull()))
    return defs.where("kind IN ('function', 'method', 'route')").select(hit.alias("rule"), "path", "qualified", F.col("start_line").alias("line"))


def duplicate_routes(defs: DataFrame) -> DataFrame:
    return defs.where("route IS NOT NULL").groupBy("route").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(":", "path", "qualified"))).alias("handlers")).where("n > 1")


