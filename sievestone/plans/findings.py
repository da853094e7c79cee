"""Findings derived from events, carried through policy, suppression, baseline, gate and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import findings as ops
from ..operators import registry, rules
from ..sources import braces
from . import code
from .catalog import query, table

# What an event type means as a finding.
KINDS = {"error": ("high", "certain"), "purchase": ("medium", "high"), "click": ("low", "medium"), "view": ("info", "low"), "signup": ("critical", "high")}
CASE = lambda k: "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{v[k]}'" for t, v in KINDS.items()) + " END"
PATH = "CASE WHEN user_id % 7 = 0 THEN 'tests/' ELSE 'src/' END || 'u' || user_id"
BASE = f"""
f AS (SELECT event_id AS id, {CASE(0)} AS severity, {CASE(1)} AS confidence, 'rule.' || event_type AS rule, {PATH} AS path, (event_id % 97)::BIGINT AS start,
      CASE WHEN user_id % 3 = 0 THEN 'react' WHEN user_id % 3 = 1 THEN 'fastapi' END AS framework, event_type || ' of ' || (user_id % 5) AS message FROM events)
"""
RANK = "list_position(['info', 'low', 'medium', 'high', 'critical'], severity)"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.element_at(F.create_map(*[F.lit(x) for t, v in KINDS.items() for x in (t, v[k])]), F.col("event_type"))
    path = F.concat(F.when(F.col("user_id") % 7 == 0, "tests/").otherwise("src/"), F.lit("u"), F.col("user_id"))
    framework = F.when(F.col("user_id") % 3 == 0, "react").when(F.col("user_id") % 3 == 1, "fastapi")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind(0).alias("severity"), kind(1).alias("confidence"), F.concat(F.lit("rule."), "event_type").alias("rule"), path.alias("path"), (F.col("event_id") % 97).alias("start"), framework.alias("framework"), F.concat("event_type", F.lit(" of "), F.col("user_id") % 5).alias("message"))


@query(f"WITH {BASE} SELECT id, severity, path, start, row_number() OVER (ORDER BY {RANK} DESC, path, start, rule, id) AS place FROM f")
def findings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ordered(_findings(spark, sf_dir)).select("id", "severity", "path", "start", "place")


@query(f"WITH {BASE} SELECT id, severity, confidence, framework FROM f WHERE {RANK} >= 3 AND confidence IN ('high', 'certain') AND (framework IS NULL OR framework = 'react')")
def findings_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.allowed(_findings(spark, sf_dir), min_severity="medium", min_confidence="high", frameworks=("react",)).select("id", "severity", "confidence", "framework")


@query(f"""
WITH {BASE}, l AS (SELECT *, CASE WHEN regexp_matches(path, '^src/u1') AND rule = 'rule.click' THEN 'error' WHEN regexp_matches(path, '^tests/') AND rule = 'rule.error' THEN 'off'
  WHEN rule = 'rule.view' THEN 'warn' WHEN rule = 'rule.purchase' THEN 'off' END AS level FROM f)
SELECT id, rule, path, CASE level WHEN 'warn' THEN 'medium' WHEN 'error' THEN 'high' ELSE severity END AS severity FROM l WHERE coalesce(level, '') <> 'off'
""")
def policy_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.overridden(_findings(spark, sf_dir), {"rule.view": "warn", "rule.purchase": "off"}, [("^tests/", "rule.error", "off"), ("^src/u1", "rule.click", "error")])
    return kept.select("id", "rule", "path", "severity")


@query("""
WITH r AS (SELECT user_id, ts AS from_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'signup')
SELECT e.event_id, min(r.nth)::INTEGER AS suppressed_by FROM events e LEFT JOIN r ON r.user_id = e.user_id AND e.ts >= r.from_ts AND (r.to_ts IS NULL OR e.ts < r.to_ts)
WHERE e.event_type = 'error' GROUP BY e.event_id
""")
def suppression_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of one user follow one another, so the one in force is the number of signups so far: a window, no join."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    so_far = F.count_if(F.col("event_type") == "signup").over(w).cast("int")
    return e.withColumn("n", so_far).where("event_type = 'error'").select("event_id", F.when(F.col("n") > 0, F.col("n")).alias("suppressed_by"))


PENALTY = """ceil(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 8 ELSE 15 END * 10
  * CASE confidence WHEN 'low' THEN 25 WHEN 'medium' THEN 50 WHEN 'high' THEN 80 ELSE 100 END * CASE WHEN path LIKE 'tests/%' THEN 50 ELSE 100 END / 10000)::BIGINT"""
SCORED = f"""
p AS (SELECT *, rule || '|' || message AS group_key, {PENALTY} AS tenths FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY tenths DESC, id) AS nth FROM p),
g AS (SELECT group_key, rule, least(sum(ceil(tenths * CASE WHEN nth = 1 THEN 100 WHEN nth <= 3 THEN 50 WHEN nth <= 10 THEN 25 ELSE 0 END / 100)), 3 * max(tenths), 65535)::INTEGER AS penalty FROM n GROUP BY group_key, rule)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    tenths = ops.penalty_tenths(F.col("severity"), F.col("confidence"), ops.context_percent(F.col("path"), F.lit(False)))
    return f.withColumn("group_key", F.concat_ws("|", "rule", "message")).withColumn("penalty_tenths", tenths)


@query(f"WITH {BASE}, {SCORED} SELECT greatest(0, 100 - (coalesce(sum(penalty), 0) + 9) // 10)::INTEGER AS score, coalesce(sum(penalty), 0)::BIGINT AS penalty_tenths FROM g")
def score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.score(_scored(spark, sf_dir))


@query(f"WITH {BASE}, {SCORED} SELECT rule AS category, greatest(0, 100 - (sum(penalty) + 9) // 10)::INTEGER AS score, sum(penalty)::BIGINT AS penalty_tenths FROM g GROUP BY rule")
def score_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = ops.scored_groups(_scored(spark, sf_dir)).groupBy(F.substring_index("group_key", "|", 1).alias("category")).agg(F.sum("penalty").alias("penalty_tenths"))
    return per.select("category", F.greatest(F.lit(0), 100 - F.floor((F.col("penalty_tenths") + 9) / 10)).cast("int").alias("score"), "penalty_tenths")


@query(f"WITH {BASE}, {SCORED} SELECT group_key, penalty FROM g ORDER BY penalty DESC, group_key LIMIT 5")
def score_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scored_groups(_scored(spark, sf_dir)).orderBy(F.desc("penalty"), "group_key").limit(5)


SNAPSHOTS = """
c AS (SELECT sha256(text) AS fingerprint, source AS path, lang || ':' || doc_id AS message FROM documents WHERE doc_id % 4 <> 0),
b AS (SELECT sha256(text) AS fingerprint, source AS path, lang || ':' || CASE WHEN doc_id % 10 = 1 THEN doc_id + 1 ELSE doc_id END AS message FROM documents WHERE doc_id % 4 <> 1),
cn AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, message) AS nth FROM c), bn AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path, message) AS nth FROM b),
m AS (SELECT coalesce(cn.fingerprint, bn.fingerprint) AS fingerprint, coalesce(cn.nth, bn.nth)::INTEGER AS nth,
  CASE WHEN bn.fingerprint IS NULL THEN 'new' WHEN cn.fingerprint IS NULL THEN 'fixed' WHEN cn.path = bn.path AND cn.message = bn.message THEN 'existing' ELSE 'changed' END AS status
  FROM cn FULL JOIN bn ON cn.fingerprint = bn.fingerprint AND cn.nth = bn.nth)
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    row = lambda i: [F.sha2("text", 256).alias("fingerprint"), F.col("source").alias("path"), F.concat("lang", F.lit(":"), i).alias("message")]
    moved = F.when(F.col("doc_id") % 10 == 1, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    return ops.baseline_status(d.where("doc_id % 4 <> 0").select(*row(F.col("doc_id"))), d.where("doc_id % 4 <> 1").select(*row(moved)))


@query(f"WITH {SNAPSHOTS} SELECT * FROM m WHERE status <> 'fixed'")
def baseline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).where("status <> 'fixed'")


@query(f"WITH {SNAPSHOTS} SELECT fingerprint, nth FROM m WHERE status = 'fixed'")
def baseline_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).where("status = 'fixed'").select("fingerprint", "nth")


@query(f"""
WITH {BASE}, s AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'existing' END AS status, CASE WHEN id % 5 = 0 THEN 1 END AS suppressed_by FROM f WHERE path LIKE 'src/%')
SELECT rule, bool_or({RANK} >= 4 AND suppressed_by IS NULL) AS high, bool_or({RANK} >= 4 AND status = 'new' AND suppressed_by IS NULL) AS new_high, bool_or({RANK} >= 3 AND status = 'new' AND suppressed_by IS NULL) AS new_medium FROM s GROUP BY rule
""")
def ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _findings(spark, sf_dir).where("path LIKE 'src/%' ").withColumn("status", F.when(F.col("id") % 2 == 0, "new").otherwise("existing"))
    open_, new, level = F.col("id") % 5 != 0, F.col("status") == "new", ops.rank(F.col("severity"), ops.SEVERITIES)
    return s.groupBy("rule").agg(F.bool_or((level >= 4) & open_).alias("high"), F.bool_or((level >= 4) & new & open_).alias("new_high"), F.bool_or((level >= 3) & new & open_).alias("new_medium"))


@query(f"WITH {BASE} SELECT rule, count(*) AS n FROM f WHERE id % 5 = 0 GROUP BY rule")
def suppressed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).where("id % 5 = 0").groupBy("rule").agg(F.count("*").alias("n"))


MATCH_KEYS = ("fingerprint", "content", "context")
SIDE = "SELECT doc_id AS id, {path} AS path, lang AS message, sha256(text || {path}) AS fingerprint, sha256(text) AS content, lang || ':' || (n_chars % 50)::VARCHAR AS context FROM documents WHERE {which}"
MOVED = "CASE WHEN doc_id % 10 = 3 THEN 'moved' ELSE source END"


def _rounds() -> str:
    """A chain of full rounds: what is open on both sides meets by the nth of equal keys."""
    parts = [f"c0 AS ({SIDE.format(path=MOVED, which='doc_id % 4 <> 0')}), b0 AS ({SIDE.format(path='source', which='doc_id % 4 <> 1')})"]
    for k, key in enumerate(MATCH_KEYS):
        nth = f"row_number() OVER (PARTITION BY {key} ORDER BY id) AS nth"
        parts.append(f"m{k} AS (SELECT c.id, b.id AS baseline_id, '{key}' AS matched_by, CASE WHEN c.path IS NOT DISTINCT FROM b.path AND c.message IS NOT DISTINCT FROM b.message THEN 'existing' ELSE 'changed' END AS status FROM (SELECT *, {nth} FROM c{k}) c JOIN (SELECT *, {nth} FROM b{k}) b ON c.{key} = b.{key} AND c.nth = b.nth)")
        parts.append(f"c{k + 1} AS (SELECT * FROM c{k} WHERE id NOT IN (SELECT id FROM m{k})), b{k + 1} AS (SELECT * FROM b{k} WHERE id NOT IN (SELECT baseline_id FROM m{k}))")
    n = len(MATCH_KEYS)
    ends = [f"SELECT * FROM m{k}" for k in range(n)] + [f"SELECT id, NULL, NULL, 'new' FROM c{n}", f"SELECT NULL, id, NULL, 'fixed' FROM b{n}"]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(ends)}"


@query(_rounds())
def baseline_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose path moved meet by content, then by context."""
    d = table(spark, sf_dir, "documents")

    def side(path: Column) -> list[Column]:
        return [F.col("doc_id").alias("id"), path.alias("path"), F.col("lang").alias("message"), F.sha2(F.concat("text", path), 256).alias("fingerprint"), F.sha2("text", 256).alias("content"), F.concat("lang", F.lit(":"), (F.col("n_chars") % 50).cast("string")).alias("context")]

    moved = F.when(F.col("doc_id") % 10 == 3, "moved").otherwise(F.col("source"))
    return ops.baseline_matched(d.where("doc_id % 4 <> 0").select(*side(moved)), d.where("doc_id % 4 <> 1").select(*side(F.col("source"))), MATCH_KEYS)


def _code_findings(spark: SparkSession) -> DataFrame:
    sources = code.files(spark)
    rows = braces.extract(sources)
    return registry.findings(rules.union([rules.style(rows), rules.literals(rows), rules.validations(sources), rules.react(rows), rules.unstable_keys(sources), rules.rust(rows)]))


@query()
def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.catalog(spark)


@query()
def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules found in the inline sources, in the order of a report."""
    return ops.ordered(_code_findings(spark))
