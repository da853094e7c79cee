"""Reports of findings: JSON, SARIF, Markdown, text and HTML.

Single results of JSON and SARIF are built by Spark, one string per finding, and can be written by
executors. A whole report is a stream of lines: findings come to the driver one by one, so a report of any
length costs the driver no memory. Findings may have `status` (beside a baseline), `suppressed_by`,
`safe_fix` with a `replacement`, and `related`, an array of (path, line); what they lack is left out.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from contextlib import suppress
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators import registry
from ..operators.findings import ordered, score

SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: Findings that a Markdown report shows before it folds the rest.
SHOWN = 10
GRAVE = ("medium", "high", "critical")


def _if_there(findings: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in findings.columns]


def json_rows(findings: DataFrame) -> DataFrame:
    """(place, value): a JSON object per finding, in report order."""
    placed = ordered(findings)
    more = _if_there(findings, "status", "suppressed_by", "framework", "safe_fix", "related", "snippet")
    return placed.select("place", F.to_json(F.struct("id", F.col("rule").alias("ruleId"), "severity", "confidence", "message", F.struct("path", F.col("start").alias("startLine")).alias("location"), *more)).alias("value"))


def _sarif_place(path: Column, line: Column) -> Column:
    return F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """(place, value): a SARIF result per finding, in report order, with related places and fixes where they are known."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SARIF_LEVELS.items() for x in kv]), F.col("severity"))
    parts = [F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(_sarif_place(F.col("path"), F.col("start"))).alias("locations"), F.struct(F.col("id").cast("string").alias("stableKey")).alias("partialFingerprints")]
    if "related" in findings.columns:
        parts.append(F.transform("related", lambda r: _sarif_place(r["path"], r["line"])).alias("relatedLocations"))
    if "replacement" in findings.columns:
        inserted = F.struct(F.struct(F.col("start").alias("startLine")).alias("deletedRegion"), F.struct(F.col("replacement").alias("text")).alias("insertedContent"))
        change = F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.array(inserted).alias("replacements"))
        parts.append(F.when(F.col("replacement").isNotNull(), F.array(F.struct(F.struct(F.lit("Apply the safe rewrite").alias("text")).alias("description"), F.array(change).alias("artifactChanges")))).alias("fixes"))
    if "suppressed_by" in findings.columns:
        parts.append(F.when(F.col("suppressed_by").isNotNull(), F.array(F.struct(F.lit("inSource").alias("kind")))).alias("suppressions"))
    if "status" in findings.columns:
        parts.append(F.when(F.col("status") == "new", "new").when(F.col("status") == "existing", "unchanged").when(F.col("status") == "changed", "updated").alias("baselineState"))
    return ordered(findings).select("place", F.to_json(F.struct(*parts)).alias("value"))


def _in_order(findings: DataFrame) -> Iterator[Row]:
    return ordered(findings).orderBy("place").toLocalIterator()


def _listed(values: Iterator[str]) -> Iterator[str]:
    """Values with commas between them, a line each."""
    last = None
    for value in values:
        if last is not None:
            yield last + ",\n"
        last = value
    if last is not None:
        yield last + "\n"


def json_report(findings: DataFrame) -> Iterator[str]:
    """The envelope: how many there are by severity, and the findings."""
    counts = {r.severity: r["count"] for r in findings.groupBy("severity").count().orderBy("severity").collect()}
    yield json.dumps({"schemaVersion": "1", "tool": "sievestone", "counts": counts})[:-1] + ', "findings": [\n'
    yield from _listed(r.value for r in json_rows(findings).orderBy("place").toLocalIterator())
    yield "]}\n"


def sarif_report(findings: DataFrame) -> Iterator[str]:
    rules = [{"id": r.rule} for r in findings.select("rule").distinct().orderBy("rule").collect()]
    head = {"version": "2.1.0", "$schema": SARIF_SCHEMA, "runs": [{"tool": {"driver": {"name": "sievestone", "rules": rules}}}]}
    yield json.dumps(head)[:-3] + ', "results": [\n'
    yield from _listed(r.value for r in sarif_rows(findings).orderBy("place").toLocalIterator())
    yield "]}]}\n"


def _marked(text: str) -> str:
    for mark in "\\|*_`<>":
        text = text.replace(mark, "\\" + mark)
    return text


def markdown_report(findings: DataFrame) -> Iterator[str]:
    """Findings of medium severity and above, new ones only where a baseline was compared; the first in full, the rest folded."""
    grave = findings.where(F.col("severity").isin(*GRAVE))
    compared = "status" in findings.columns and not findings.where("status IN ('new', 'existing', 'changed')").isEmpty()
    if compared:
        grave = grave.where("status = 'new'")
    total = grave.count()
    yield f"## {'New findings' if compared else 'Findings'} ({total})\n"
    for k, r in enumerate(_in_order(grave)):
        if k == SHOWN:
            yield f"<details><summary>{total - SHOWN} more</summary>\n\n"
        yield f"- **{r.severity}** `{r.rule}` {r.path}:{r.start} {_marked(str(r.message))}\n"
    if total > SHOWN:
        yield "\n</details>\n"


def text_report(findings: DataFrame) -> Iterator[str]:
    """By severity, and inside it by file."""
    for severity, rows in groupby(_in_order(findings), lambda r: r.severity):
        yield f"{severity.upper()}\n"
        for path, own in groupby(rows, lambda r: r.path):
            yield f"  {path}\n"
            for r in own:
                yield f"    {r.start} [{r.rule}] {r.message} ({r.confidence})\n"
    if "severity" in findings.columns and {"group_key", "penalty_tenths"} <= set(findings.columns):
        yield f"score {score(findings).first().score}\n"


FILTER = "<input placeholder='filter' oninput=\"for(const r of document.querySelectorAll('tr.f'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())\">"


def html_report(findings: DataFrame) -> Iterator[str]:
    """One table of all findings, with a field that filters its rows by any text in them."""
    yield f"<!doctype html><meta charset='utf-8'><title>Findings</title>{FILTER}<table><tr><th>Severity<th>Rule<th>Place<th>Message</tr>\n"
    for r in _in_order(findings):
        yield f"<tr class='f {r.severity}'><td>{r.severity}</td><td>{html.escape(r.rule)}</td><td>{html.escape(str(r.path))}:{r.start}</td><td>{html.escape(str(r.message))}</td></tr>\n"
    yield "</table>\n"


FORMATS = {"json": json_report, "sarif": sarif_report, "markdown": markdown_report, "md": markdown_report, "text": text_report, "html": html_report}


def report(findings: DataFrame, kind: str) -> Iterator[str]:
    """The report of a kind, in pieces."""
    if kind not in FORMATS:
        raise ValueError(f"no report of kind {kind}; there are {', '.join(FORMATS)}")
    return FORMATS[kind](findings)


def write(findings: DataFrame, kind: str, path: str | None = None) -> None:
    """A report into a file, or to the standard output; a reader that goes away ends it."""
    if path is None:
        with suppress(BrokenPipeError):
            for piece in report(findings, kind):
                print(piece, end="")
        return
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(report(findings, kind))


def with_snippets(findings: DataFrame, files: DataFrame, around: int = 2) -> DataFrame:
    """Findings with the lines of their file (path, source) around them."""
    here = F.slice(F.split("__source", "\n"), F.greatest(F.lit(1), F.col("start").cast("int") - around), F.lit(2 * around + 1))
    rows = findings.join(files.select("path", F.col("source").alias("__source")), "path", "left")
    return rows.withColumn("snippet", F.when(F.col("start") > 0, snippet(F.array_join(here, "\n")))).drop("__source")


def explained(spark, rule: str) -> dict:
    """What the catalog says about a rule, by any of its names."""
    code = registry.NAMES.get(rule.strip().lower())
    if code is None:
        raise ValueError(f"unknown rule {rule}")
    return registry.catalog(spark).where(F.col("rule") == code).first().asDict()
