"""Baseline files: what a run found, written as one JSON document, read again and compared with a later run.

A document's entries are as many as findings, which stream through the driver one by one when they are
written. Matching is done by Spark (operators/findings.baseline_matched): first by fingerprint, then by
keys that outlive moves, each entry meeting one finding at most.
"""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines, normalised
from ..operators.findings import baseline_matched

# The version and names of the document's fields.
SCHEMA_VERSION = "1"
ENTRY = "fingerprint string, baselineKey string, ruleId string, path string, normalizedPath string, normalizedSourceContextHash string, line long, firstSeen long, owner string, severity string, confidence string, message string, matchingKeys array<string>"
COMPARED = ("path", "line", "message", "severity", "confidence")
#: Lines before and after a finding's that tell where it is.
AROUND = 3


class BaselineError(ValueError):
    """What is wrong with a baseline, and where."""


def context_hash(source: Column, line: Column) -> Column:
    """Digest of the lines around a line, white space normalised; null if there is no text."""
    first = F.greatest(F.lit(1), line - AROUND).cast("int")
    around = normalised(F.array_join(F.slice(lines(source), first, F.lit(2 * AROUND + 1)), "\n"))
    return F.when(line.isNotNull() & (around != ""), F.sha2(around, 256))


def entries(findings: DataFrame, files: DataFrame, *, owner: str | None = None, first_seen: int | None = None) -> DataFrame:
    """One entry for each finding (id, rule, severity, confidence, path, line, message, fingerprint, and content and route if there are such columns) that nothing suppresses.

    A finding about content or a route is known by that, others by their key and the lines around them.
    """
    for name in ("content", "route", "suppressed_by"):
        if name not in findings.columns:
            findings = findings.withColumn(name, F.lit(None).cast("string"))
    located = findings.where("suppressed_by IS NULL").join(files.select("path", F.col("source").alias("__source")), "path", "left")
    rows = located.withColumn("context", F.coalesce(context_hash(F.col("__source"), F.col("line")), F.lit("unknown"))).drop("__source")
    legacy = F.concat(F.lit("legacy:"), "fingerprint")
    known_by = F.coalesce(F.concat(F.lit("content:"), "content"), F.concat(F.lit("route:"), "route"), F.concat(legacy, F.lit("|context:"), "context"))
    fingerprint = F.sha2(F.concat_ws("|", "rule", known_by), 256)
    of_rule = lambda kind, value: F.concat(F.col("rule"), F.lit(f"|{kind}:"), value)
    keys = F.array(F.concat(F.lit("fingerprint:"), fingerprint), legacy, of_rule("context", F.col("context")), F.concat(F.col("rule"), F.lit("|path:"), F.col("path"), F.lit("|context:"), F.col("context")), of_rule("content", F.col("content")), of_rule("route", F.col("route")))
    slashes = F.replace("path", F.lit("\\"), F.lit("/"))
    return rows.select(
        "id", fingerprint.alias("fingerprint"), F.col("fingerprint").alias("baselineKey"), F.col("rule").alias("ruleId"), "path", slashes.alias("normalizedPath"), F.col("context").alias("normalizedSourceContextHash"), F.col("line").cast("long").alias("line"),
        F.lit(int(time.time()) if first_seen is None else first_seen).cast("long").alias("firstSeen"), F.lit(owner or None).cast("string").alias("owner"), "severity", "confidence", "message", F.array_sort(F.array_compact(keys)).alias("matchingKeys"),
    )


def write(path: str, rows: DataFrame, *, force: bool = False, workspace: str = "", config_hash: str = "", tool_version: str = "1", created_at: int | None = None) -> None:
    """The document, its entries sorted by rule, fingerprint and path. A file that exists stays unless force is given."""
    if os.path.exists(path) and not force:
        raise BaselineError(f"{path} exists; force overwrites it")
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    now = int(time.time())
    head = {"schemaVersion": SCHEMA_VERSION, "toolVersion": tool_version, "workspaceRoot": workspace.replace("\\", "/"), "createdAt": now if created_at is None else created_at, "updatedAt": now, "configHash": config_hash}
    names = [f.split()[0] for f in ENTRY.split(", ")]
    ordered = rows.select(*names).orderBy("ruleId", "fingerprint", "path", "line", "message")
    beside = f"{path}.{os.getpid()}.part"  # a run that dies leaves the old file whole
    with open(beside, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "entries": [')
        for k, row in enumerate(ordered.toLocalIterator()):
            entry = {n: v for n, v in row.asDict().items() if v is not None}
            f.write((",\n" if k else "\n") + json.dumps(entry, ensure_ascii=False))
        f.write("\n]}\n")
    os.replace(beside, path)


def read(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The document's own fields and its entries; a report with findings is accepted too, names in either case."""
    try:
        with open(path, encoding="utf-8") as f:
            document = json.load(f)
    except (OSError, ValueError) as e:
        raise BaselineError(f"{path} can't be read: {e}") from e
    if not isinstance(document, dict) or not isinstance(document.get("entries", document.get("findings")), list):
        raise BaselineError(f"{path} holds neither entries nor findings")
    either = lambda d, name: d.get(name, d.get("".join(f"_{c.lower()}" if c.isupper() else c for c in name)))
    names, rows = [f.split()[0] for f in ENTRY.split(", ")], []
    for given in document.get("entries", document.get("findings")):
        entry = {n: either(given, n) for n in names}
        if "entries" not in document:
            if entry["baselineKey"] is None:
                continue
            place = next(iter(given.get("locations") or [given.get("location") or {}]), {})
            entry |= {"ruleId": entry["ruleId"] or "unknown", "path": place.get("path", ""), "line": either(place, "startLine") or place.get("line"), "severity": entry["severity"] or "info", "confidence": entry["confidence"] or "low", "message": entry["message"] or ""}
        entry["fingerprint"] = entry["fingerprint"] or _digest(f"{entry['ruleId']}|legacy:{entry['baselineKey']}")
        entry["normalizedPath"] = entry["normalizedPath"] or (entry["path"] or "").replace("\\", "/")
        entry["matchingKeys"] = entry["matchingKeys"] or [f"fingerprint:{entry['fingerprint']}", f"legacy:{entry['baselineKey']}"]
        rows.append(tuple(entry[n] for n in names))
    return {k: v for k, v in document.items() if k not in ("entries", "findings")}, spark.createDataFrame(rows, ENTRY)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _numbered(baseline: DataFrame) -> DataFrame:
    """Entries of a baseline have no ids of their own; equal ones are told apart by their number."""
    name = F.concat_ws("|", "fingerprint", "path", F.coalesce(F.col("line").cast("string"), F.lit("")), "message")
    nth = F.row_number().over(W.partitionBy(name).orderBy("firstSeen"))
    return baseline.withColumn("baseline_id", F.concat_ws("#", name, nth.cast("string")))


def _keyed(rows: DataFrame, identity: Column) -> DataFrame:
    """Entries with one column for each kind of key, in the order in which they are tried."""
    one = lambda test: F.get(F.filter("matchingKeys", test), F.lit(0))
    return rows.select(
        identity.alias("id"), "path", "line", "message", "severity", "confidence", "firstSeen", "owner", "fingerprint", one(lambda k: F.contains(k, F.lit("|content:"))).alias("content"), one(lambda k: F.contains(k, F.lit("|route:"))).alias("route"),
        one(lambda k: F.contains(k, F.lit("|path:"))).alias("place"), one(lambda k: F.contains(k, F.lit("|context:")) & ~F.contains(k, F.lit("|path:")) & ~F.endswith(k, F.lit("|context:unknown"))).alias("context"), one(lambda k: F.startswith(k, F.lit("legacy:"))).alias("legacy"),
    )


KEYS = ("fingerprint", "content", "route", "place", "context", "legacy")


def compared(current: DataFrame, baseline: DataFrame | None, *, missing_is_empty: bool = False) -> DataFrame:
    """(id, baseline_id, matched_by, status): new, existing or changed for each current entry, fixed for what is left of the baseline.

    Without a baseline all are not_checked, or new if a missing one counts as empty (as in a pipeline of checks).
    """
    if baseline is None:
        none = F.lit(None).cast("string")
        return current.select(F.col("id").cast("string").alias("id"), none.alias("baseline_id"), none.alias("matched_by"), F.lit("new" if missing_is_empty else "not_checked").alias("status"))
    old = _keyed(_numbered(baseline), F.col("baseline_id"))
    return baseline_matched(_keyed(current, F.col("id").cast("string")), old, KEYS, compared=COMPARED)


def updated(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current entries with the time and owner that the entries they meet were first seen with."""
    old = _numbered(baseline).select("baseline_id", F.col("firstSeen").alias("__seen"), F.col("owner").alias("__owner"))
    met = compared(current, baseline).where("id IS NOT NULL AND baseline_id IS NOT NULL").select(F.col("id").alias("__id"), "baseline_id").join(old, "baseline_id")
    rows = current.join(met, F.col("id").cast("string") == F.col("__id"), "left")
    return rows.withColumn("firstSeen", F.coalesce("__seen", "firstSeen")).withColumn("owner", F.coalesce("__owner", "owner")).select(*current.columns)
