"""What happens to findings: order, filters, policy, suppression, baseline, gate, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .groups import checkpointed

# Ranks and weights of the scales.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_PENALTY = {"info": 0, "low": 1, "medium": 3, "high": 8, "critical": 15}
CONFIDENCES = ("low", "medium", "high", "certain")
CONFIDENCE_PERCENT = {"low": 25, "medium": 50, "high": 80, "certain": 100}
GENERATED_PERCENT, TEST_PERCENT, SOURCE_PERCENT = 25, 50, 100
LANGUAGES = {"py": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "rs": "rust"}
LEVELS = {"off": None, "info": "info", "low": "low", "warn": "medium", "medium": "medium", "error": "high", "high": "high", "critical": "critical"}


def rank(value: Column, scale: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, scale)), value).cast("int")


def worth(value: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with their place in the report: severity from the top, then path, start, rule, id.

    The order cuts them into ranges, which are sorted each in a task of its own; a row's place is its
    place there behind the rows of the ranges before. Rows equal in all five come in any order.
    """
    order = [rank(F.col("severity"), SEVERITIES).desc(), F.asc("path"), F.asc("start"), F.asc("rule"), F.asc("id")]
    ranges = checkpointed(findings.repartitionByRange(*order).sortWithinPartitions(*order))
    # Read back from where they were written, ranges and the order inside them are fixed.
    place = F.monotonically_increasing_id()
    numbered = ranges.withColumn("__range", F.shiftright(place, 33)).withColumn("__nth", place.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy("__range").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    before = F.broadcast(sizes.select("__range", ahead.alias("__ahead")))  # a row for each task
    return numbered.join(before, "__range").withColumn("place", F.col("__ahead") + F.col("__nth") + 1).drop("__range", "__nth", "__ahead")


def allowed(findings: DataFrame, *, min_severity: str | None = None, only_severity: str | None = None, min_confidence: str | None = None, frameworks: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """Findings without a framework pass every framework filter; those without a language have that of their file's extension."""
    if only_severity:
        findings = findings.where(F.col("severity") == only_severity)
    if languages:
        named = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
        own = F.coalesce(F.col("language"), named) if "language" in findings.columns else named
        findings = findings.where(own.isin(*languages))
    if min_severity:
        findings = findings.where(rank(F.col("severity"), SEVERITIES) >= SEVERITIES.index(min_severity) + 1)
    if min_confidence:
        findings = findings.where(rank(F.col("confidence"), CONFIDENCES) >= CONFIDENCES.index(min_confidence) + 1)
    if frameworks:
        findings = findings.where(F.col("framework").isNull() | F.col("framework").isin(*frameworks))
    return findings


def overridden(findings: DataFrame, levels: dict[str, str], overrides: list[tuple[str, str, str]]) -> DataFrame:
    """Level of a rule from the configuration; the last override (path pattern, rule, level) that matches wins; off removes."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), F.col("rule")) if levels else F.lit(None).cast("string")
    for path, rule, to in overrides:
        level = F.when(F.col("path").rlike(path) & (F.col("rule") == rule), F.lit(to)).otherwise(level)
    named = {k: v for k, v in LEVELS.items() if v}
    kept = findings.withColumn("level", level).where(F.coalesce(F.col("level"), F.lit("")) != "off")
    return kept.withColumn("severity", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("level")), F.col("severity"))).drop("level")


def suppressed(findings: DataFrame, ranges: DataFrame, *, place: str = "line") -> DataFrame:
    """findings with `suppressed_by`: the first range (path, rule, from_line, to_line, nth) that covers them."""
    f, r = findings.alias("f"), ranges.alias("r")
    covers = (F.col("f.path") == F.col("r.path")) & (F.col("f.rule") == F.col("r.rule")) & F.col(f"f.{place}").between(F.col("r.from_line"), F.col("r.to_line"))
    first = f.join(r, covers).groupBy(F.col("f.id").alias("id")).agg(F.min("r.nth").alias("suppressed_by"))
    return findings.join(first, "id", "left")


def penalty_tenths(severity: Column, confidence: Column, context_percent: Column) -> Column:
    """Tenths of a point, rounded up."""
    raw = worth(severity, SEVERITY_PENALTY) * 10 * worth(confidence, CONFIDENCE_PERCENT) * context_percent
    return F.ceil(raw / 10000).cast("int")


def context_percent(path: Column, generated: Column) -> Column:
    test = path.rlike(r"(^|/)(tests?|__tests__|fixtures?|specs?)(/|$)|\.(test|spec)\.[^/]*$")
    return F.when(generated, F.lit(GENERATED_PERCENT)).when(test, F.lit(TEST_PERCENT)).otherwise(F.lit(SOURCE_PERCENT))


def scored_groups(findings: DataFrame) -> DataFrame:
    """(group_key, penalty): repeats weigh 1, then a half twice, a quarter seven times, then nothing; 3 times the largest at most."""
    nth = F.row_number().over(W.partitionBy("group_key").orderBy(F.desc("penalty_tenths"), "id"))
    weight = F.when(F.col("nth") == 1, 100).when(F.col("nth") <= 3, 50).when(F.col("nth") <= 10, 25).otherwise(0)
    weighed = findings.withColumn("nth", nth).withColumn("part", F.ceil(F.col("penalty_tenths") * weight / 100))
    total = weighed.groupBy("group_key").agg(F.sum("part").alias("s"), F.max("penalty_tenths").alias("m"))
    return total.select("group_key", F.least("s", 3 * F.col("m"), F.lit(65535)).cast("int").alias("penalty"))


def score(findings: DataFrame) -> DataFrame:
    """One row: points from 100 down, after the penalties of all groups."""
    whole = scored_groups(findings).agg(F.coalesce(F.sum("penalty"), F.lit(0)).alias("tenths"))
    points = F.floor((F.col("tenths") + 9) / 10)
    return whole.select(F.greatest(F.lit(0), 100 - points).cast("int").alias("score"), F.col("tenths").cast("long").alias("penalty_tenths"))


def baseline_status(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fingerprint, nth, status): existing, changed, new or fixed; the nth of equal fingerprints meet."""
    w = W.partitionBy("fingerprint").orderBy("path", "message")
    c = current.withColumn("nth", F.row_number().over(w)).alias("c")
    b = baseline.withColumn("nth", F.row_number().over(w)).alias("b")
    both = c.join(b, (F.col("c.fingerprint") == F.col("b.fingerprint")) & (F.col("c.nth") == F.col("b.nth")), "full")
    same = F.col("c.path").eqNullSafe(F.col("b.path")) & F.col("c.message").eqNullSafe(F.col("b.message"))
    status = F.when(F.col("b.fingerprint").isNull(), "new").when(F.col("c.fingerprint").isNull(), "fixed").when(same, "existing").otherwise("changed")
    return both.select(F.coalesce("c.fingerprint", "b.fingerprint").alias("fingerprint"), F.coalesce("c.nth", "b.nth").alias("nth"), status.alias("status"))


def baseline_matched(current: DataFrame, baseline: DataFrame, keys: tuple[str, ...], *, compared: tuple[str, ...] = ("path", "message")) -> DataFrame:
    """(id, baseline_id, matched_by, status) of current findings, and of baseline entries that none of them meets (fixed; id is null).

    Both sides hold id, the keys, and what is compared to tell changed entries. The keys are tried one after the other: what is open on
    both sides meets by the nth of equal keys in the order of ids, so no pairs are made, and each entry
    meets at most one finding. Null keys meet nothing. A key's round is two windows over one table of
    both sides; rows that are settled, or have no key, are spread by their ids.
    """
    held = [c for c in compared if c not in keys]
    side = lambda df, name: df.select(F.lit(name).alias("side"), "id", *held, *keys)
    both = side(current, "c").unionByName(side(baseline, "b")).withColumn("by", F.lit(None).cast("string"))
    types = dict(current.dtypes)
    both = both.withColumn("other", F.lit(None).cast(f"struct<{','.join(f'{c}:{types[c]}' for c in ('id', *compared))}>"))
    for key in keys:
        bucket = F.when(F.col("by").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat_ws("-", "side", F.col("id").cast("string")))
        both = both.withColumn("bucket", bucket)
        both = both.withColumn("nth", F.row_number().over(W.partitionBy("bucket", "side").orderBy("id")))
        pair = W.partitionBy("bucket", "nth")
        row = F.struct("id", *compared)
        meets = (F.count("*").over(pair) == 2) & F.startswith("bucket", F.lit("k"))
        found = F.when(F.col("side") == "c", F.max(F.when(F.col("side") == "b", row)).over(pair))
        both = both.withColumn("meets", meets).withColumn("found", found)
        both = both.withColumn("other", F.when(F.col("meets"), F.col("found")).otherwise(F.col("other"))).withColumn("by", F.when(F.col("meets"), F.lit(key)).otherwise(F.col("by"))).drop("meets", "found", "nth", "bucket")
    is_current = F.col("side") == "c"
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"other.{c}"))
    status = F.when(~is_current, "fixed").when(F.col("by").isNull(), "new").when(same, "existing").otherwise("changed")
    kept = both.where(is_current | F.col("by").isNull())
    return kept.select(F.when(is_current, F.col("id")).alias("id"), F.when(is_current, F.col("other.id")).otherwise(F.col("id")).alias("baseline_id"), F.col("by").alias("matched_by"), status.alias("status"))


def blocks(findings: DataFrame) -> Column:
    """Whether a finding stops a run by itself: severe, and nearly sure."""
    return F.col("severity").isin("high", "critical") & F.col("confidence").isin("high", "certain")


def gate(findings: DataFrame, threshold: str) -> DataFrame:
    """One row: whether the run fails at `high`, `new-high` or `new-medium`, over findings that aren't suppressed."""
    threshold = threshold.replace("_", "-")
    level = rank(F.col("severity"), SEVERITIES) >= (3 if threshold.endswith("medium") else 4)
    new = (F.col("status") == "new") if threshold.startswith("new") else F.lit(True)
    return findings.where(F.col("suppressed_by").isNull()).agg(F.coalesce(F.bool_or(level & new), F.lit(False)).alias("fails"))
