"""Rules on FastAPI routes and models, over definitions of sources/symbols and models of sources/braces.

Every rule gives (rule, path, line, name, detail). Groups give their first place and their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import body_lines, has, one_pass, repeats, union

# Texts that the rules look for.
BLOCKING = ("requests.get", "requests.post", "requests.put", "requests.patch", "requests.delete", "time.sleep", "open(", ".read(", ".write(")
DATABASE = (".query(", ".execute(", ".commit(", ".rollback(", ".add(", "Session(", "sessionmaker(")
INTENT_WORDS = ("create", "update", "patch", "response", "read", "out", "public", "internal")
AUTH_WORDS = "(?i)auth|token|current_user|security|permission|credential"
LEAST_ROUTES, LEAST_FIELDS, LEAST_LINES = 3, 3, 5


def routes(defs: DataFrame) -> DataFrame:
    """Route handlers with what their decorators and signatures say."""
    decorators = F.array_join("decorators", "\n")
    option = lambda name: F.nullif(F.regexp_extract(decorators, rf"{name}=([\w.\[\]]+)", 1), F.lit(""))
    depends = F.array_sort(F.array_distinct(F.regexp_extract_all(F.concat_ws("\n", decorators, "body"), F.lit(r"\b(?:Depends|Security)\(\s*([\w.]+)"), 1)))
    database = F.exists("calls", lambda c: c.contains("session.") | c.contains("db."))
    for text in DATABASE:
        database = database | has(text)
    found = defs.where("route IS NOT NULL").withColumn("line", F.col("start_line")).withColumn("start", F.col("start_line"))
    return found.select(
        "*", F.split_part("route", F.lit(" "), F.lit(1)).alias("method"), F.split_part("route", F.lit(" "), F.lit(2)).alias("template"), option("status_code").alias("status"), option("response_model").alias("model"), depends.alias("depends"), database.alias("uses_database"),
    )


def blocking(found: DataFrame, patterns: tuple[str, ...] = BLOCKING, allowed: tuple[str, ...] = ()) -> DataFrame:
    """One finding per pattern that an async route's text or calls hold."""
    calls = F.array_join("calls", "\n")
    held = F.array(*[F.when(has(p) | F.contains(calls, F.lit(p)), F.lit(p)) for p in patterns if p not in allowed])
    return found.where("is_async").select(F.lit("fastapi.blocking_call_in_async_route").alias("rule"), "path", "line", "name", F.explode(F.filter(held, lambda p: p.isNotNull())).alias("detail"))


def overlapping(templates: DataFrame, name: str, key: str, free: Callable[[Column], Column]) -> DataFrame:
    """(key, l, r): pairs of one key whose parts agree wherever neither is free, l being the smaller name.

    A template's mask tells which parts are free. There are few masks, and for two of them the parts that
    count are those free in neither; with the others blanked out, templates meet by equality.
    """
    rows = templates.select(key, name, "parts", F.array_join(F.transform("parts", lambda p: F.when(free(p), "1").otherwise("0")), "").alias("mask"))
    masks = rows.select(key, "mask").distinct()
    pairs = masks.join(masks.withColumnRenamed("mask", "other"), key).where(F.length("mask") == F.length("other"))
    open_ = lambda i: (F.substr("mask", i + 1, F.lit(1)) == "1") | (F.substr("other", i + 1, F.lit(1)) == "1")
    fixed = F.array_join(F.transform("parts", lambda p, i: F.when(open_(i), F.lit("")).otherwise(p)), "/")
    asked = rows.join(pairs, [key, "mask"]).select(key, name, "mask", "other", fixed.alias("fixed"))
    l, r = asked.alias("l"), asked.alias("r")
    c = F.col
    met = (c(f"l.{key}") == c(f"r.{key}")) & (c("l.mask") == c("r.other")) & (c("l.other") == c("r.mask")) & (c("l.fixed") == c("r.fixed")) & (c(f"l.{name}") < c(f"r.{name}"))
    return l.join(r, met).select(c(f"l.{key}").alias(key), c(f"l.{name}").alias("l"), c(f"r.{name}").alias("r"))


def conflicts(found: DataFrame) -> DataFrame:
    """Pairs of unequal templates of one method that some path fits both, between the first handlers of each."""
    parts = F.filter(F.split("template", "/"), lambda s: s != "")
    first = F.min(F.struct("path", "line", "name")).alias("at")
    templates = found.groupBy("method", "template").agg(first).select("*", parts.alias("parts"))
    pairs = overlapping(templates, "template", "method", lambda s: s.rlike(r"^(\{.*\}|<.*>)$"))
    at = templates.select("method", F.col("template").alias("l"), "at")
    return pairs.join(at, ["method", "l"]).select(F.lit("fastapi.route_conflict").alias("rule"), "at.path", "at.line", "at.name", F.concat_ws(" ", "method", "l", "r").alias("detail"))


def status_issue() -> Column:
    c = F.col
    created = (c("method") == "POST") & c("status").isNull() & c("name").rlike("^(create|add|register)")
    deleted = (c("method") == "DELETE") & c("status").isNull()
    filled = c("status").contains("204") & (c("model").isNotNull() | has("return {") | has("return ["))
    return F.when(created, "post_create_route_without_201_status").when(deleted, "delete_route_without_explicit_status").when(filled, "no_content_status_with_response_body")


def fastapi(defs: DataFrame, rows: DataFrame, *, most_lines: int = 80, least_score: int = 4, patterns: tuple[str, ...] = BLOCKING, allowed: tuple[str, ...] = ()) -> DataFrame:
    found, c = routes(defs), F.col
    word = lambda w: has(f" {w} ") | has(f"\n    {w} ")
    signals = [body_lines() > 20, word("if"), word("for"), word("while"), c("uses_database"), F.size(F.array_distinct("calls")) > 4, has("requests.") | has("httpx.")]
    score = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))
    answered = (c("method") == "DELETE") | c("template").rlike("/health$") | has("Response")
    broad = has("except Exception") | has("except BaseException") | c("body").rlike(r"(?m)^\s*except:")
    single = one_pass(found, {
        "fastapi.missing_response_model": (c("model").isNull() & ~answered, None),
        "fastapi.large_route_handler": (body_lines() > most_lines, body_lines()),
        "fastapi.business_logic_in_route": (score >= least_score, score),
        "fastapi.broad_exception_in_route": (broad, None),
        "fastapi.inconsistent_status_code": (status_issue().isNotNull(), status_issue()),
        "fastapi.sync_db_call_inside_async_route": (c("is_async") & c("uses_database"), None),
        "fastapi.requests_call_inside_async_route": (c("is_async") & has("requests."), None),
    })
    auth = F.get(F.filter("depends", lambda d: d.rlike(AUTH_WORDS)), F.lit(0))
    intent = F.lower("name").rlike("|".join(INTENT_WORDS))
    models = rows.where("kind = 'model'").where((F.size("params") >= LEAST_FIELDS) & ~intent)
    return union([
        single, blocking(found, patterns, allowed), conflicts(found),
        repeats(found, "fastapi.duplicate.route", [c("route")]),
        repeats(found.where(F.size("depends") > 0), "fastapi.repeated_dependency_logic", [F.array_join("depends", "|")], LEAST_ROUTES),
        repeats(found, "fastapi.repeated_auth_logic", [auth], LEAST_ROUTES),
        repeats(found.where(body_lines() >= LEAST_LINES), "fastapi.route_handler_duplicate_logic", [c("structural_hash")]),
        repeats(found, "python.duplicated_route_handler_business_logic", [c("path"), c("structural_hash")]),
        repeats(models, "fastapi.duplicated_pydantic_model", [F.array_join("params", "|")]),
    ])
