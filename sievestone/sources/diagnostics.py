"""Output of external tools as rows: tool, path, line, column, code, message, severity, confidence.

Input is a DataFrame with a string column `output`, one row per run of a tool. Output that isn't valid
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.findings import CONFIDENCES, SEVERITIES, rank

COLUMNS = ("tool", "path", "line", "col", "code", "message", "severity", "confidence")


def severity_of(word: Column) -> Column:
    low = F.lower(F.coalesce(word, F.lit("")))
    return F.when(low.isin("error", "fatal", "critical", "high"), "high").when(low.isin("warning", "warn", "medium"), "medium").when(low.isin("info", "information", "note", "hint"), "info").otherwise("low")


def _rows(df: DataFrame, tool: str, path, line, col, code, message, severity, confidence: str) -> DataFrame:
    values = (F.lit(tool), path, line.cast("long"), col.cast("long"), F.coalesce(code.cast("string"), F.lit("")), message, severity, F.lit(confidence))
    return df.select(*[v.alias(n) for v, n in zip(values, COLUMNS, strict=True)])


def _json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.explode(F.from_json("output", schema)).alias("d"))


def eslint(df: DataFrame) -> DataFrame:
    files = _json(df, "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:long,column:long>>>>")
    m = files.select(F.col("d.filePath").alias("path"), F.explode("d.messages").alias("m"))
    return _rows(m, "eslint", F.col("path"), F.col("m.line"), F.col("m.column"), F.col("m.ruleId"), F.col("m.message"), F.when(F.col("m.severity") == 2, "high").otherwise("medium"), "high")


def biome(df: DataFrame) -> DataFrame:
    d = "array<struct<category:string,severity:string,description:string,location:struct<path:struct<file:string>,start:struct<line:long,column:long>>>>"
    both = F.from_json("output", f"struct<diagnostics:{d},data:struct<diagnostics:{d}>>")
    m = df.select(F.explode(F.coalesce(both["diagnostics"], both["data"]["diagnostics"])).alias("d"))
    return _rows(m, "biome", F.col("d.location.path.file"), F.col("d.location.start.line"), F.col("d.location.start.column"), F.col("d.category"), F.col("d.description"), severity_of(F.col("d.severity")), "high")


def ruff(df: DataFrame) -> DataFrame:
    m = _json(df, "array<struct<filename:string,code:string,message:string,location:struct<row:long,column:long>>>")
    return _rows(m, "ruff", F.col("d.filename"), F.col("d.location.row"), F.col("d.location.column"), F.col("d.code"), F.col("d.message"), F.lit("medium"), "high")


def pyright(df: DataFrame) -> DataFrame:
    """Lines and columns count from 0 there and from 1 here."""
    whole = F.from_json("output", "generalDiagnostics array<struct<file:string,severity:string,message:string,rule:string,range:struct<start:struct<line:long,character:long>>>>")
    m = df.select(F.explode(whole["generalDiagnostics"]).alias("d"))
    return _rows(m, "pyright", F.col("d.file"), F.col("d.range.start.line") + 1, F.col("d.range.start.character") + 1, F.col("d.rule"), F.col("d.message"), severity_of(F.col("d.severity")), "high")


def semgrep(df: DataFrame) -> DataFrame:
    whole = F.from_json("output", "results array<struct<check_id:string,path:string,start:struct<line:long,col:long>,extra:struct<message:string,severity:string>>>")
    m = df.select(F.explode(whole["results"]).alias("d"))
    return _rows(m, "semgrep", F.col("d.path"), F.col("d.start.line"), F.col("d.start.col"), F.col("d.check_id"), F.col("d.extra.message"), severity_of(F.col("d.extra.severity")), "medium")


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("output", r"\r?\n")).alias("text"))


def _matched(df: DataFrame, pattern: str) -> Callable[[int], Column]:
    return lambda k: F.regexp_extract("text", pattern, k)


def tsc(df: DataFrame) -> DataFrame:
    pattern = r"^(.+)\((\d+),(\d+)\): error (TS\d+): (.*)$"
    part = _matched(df, pattern)
    return _rows(_lines(df).where(F.col("text").rlike(pattern)), "tsc", part(1), part(2), part(3), part(4), part(5), F.lit("high"), "certain")


def mypy(df: DataFrame) -> DataFrame:
    """Paths may begin with a drive letter; the code stands in brackets at the end."""
    pattern = r"^((?:[A-Za-z]:)?[^:]+):(\d+):(?:(\d+):)? (error|warning|note): (.*?)(?:\s+\[([^\]]+)\])?$"
    part = _matched(df, pattern)
    column = F.when(part(3) != "", part(3))
    return _rows(_lines(df).where(F.col("text").rlike(pattern)), "mypy", part(1), part(2), column, part(6), part(5), severity_of(part(4)), "high")


def _cargo(df: DataFrame, tool: str, keep) -> DataFrame:
    schema = "reason string, message struct<message:string,level:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:long,column_start:long,is_primary:boolean>>>"
    m = _lines(df).select(F.from_json("text", schema).alias("d")).where("d.reason = 'compiler-message'").select("d.message")
    spans = F.coalesce(F.try_element_at(F.filter("message.spans", lambda s: s["is_primary"]), F.lit(1)), F.try_element_at("message.spans", F.lit(1)))
    m = m.withColumn("span", spans).where(F.col("span").isNotNull() & keep(F.coalesce("message.code.code", F.lit(""))))
    return _rows(m, tool, F.col("span.file_name"), F.col("span.line_start"), F.col("span.column_start"), F.col("message.code.code"), F.col("message.message"), severity_of(F.col("message.level")), "certain")


def cargo_check(df: DataFrame) -> DataFrame:
    return _cargo(df, "cargo", lambda code: ~F.startswith(code, F.lit("clippy::")))


def clippy(df: DataFrame) -> DataFrame:
    return _cargo(df, "clippy", lambda code: F.startswith(code, F.lit("clippy::")))


PARSERS = {"eslint": eslint, "biome": biome, "ruff": ruff, "pyright": pyright, "semgrep": semgrep, "tsc": tsc, "mypy": mypy, "cargo": cargo_check, "clippy": clippy}


def findings_of(diagnostics: DataFrame) -> DataFrame:
    """Distinct findings `external.<tool>.<code>` with their keys.

    Of equal ones (rule, path, line, column, message) the one of the highest severity stays, then the most certain.
    """
    code = F.regexp_replace(F.regexp_replace(F.lower("code"), "[^a-z0-9]+", "."), r"^\.+|\.+$", "")
    rule = F.concat_ws(".", F.lit("external"), "tool", F.when(code != "", code).otherwise(F.lit("unknown")))
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    key = F.sha2(F.concat_ws("|", rule, path, F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce(F.col("col").cast("string"), F.lit("")), "message"), 256)
    keyed = diagnostics.select(rule.alias("rule"), path.alias("path"), "line", "col", "message", "severity", "confidence", key.alias("key"))
    best = F.max_by(F.struct(*keyed.columns), F.struct(rank(F.col("severity"), SEVERITIES).alias("s"), rank(F.col("confidence"), CONFIDENCES).alias("c")))
    return keyed.groupBy("key").agg(best.alias("best")).select("best.*").withColumn("id", F.concat("rule", F.lit(":"), F.substring("key", 1, 12)))


def merged(external: DataFrame, internal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(external findings that no internal one overlaps, (external key, id of the first internal one that absorbs it))."""
    e, i = external.alias("e"), internal.alias("i")
    over = (F.col("e.path") == F.col("i.path")) & F.col("e.line").between(F.col("i.start_line"), F.col("i.end_line"))
    absorbed = e.join(i, over).groupBy(F.col("e.key").alias("key")).agg(F.min_by("i.id", F.struct("i.start_line", "i.id")).alias("absorbed_by"))
    return external.join(absorbed, "key", "left_anti"), absorbed
