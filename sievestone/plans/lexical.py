"""Text and markup metrics over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .catalog import query, table

TOKENS = r"len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]'))"
COMPLEXITY = r"(1 + len(regexp_extract_all(lower(text), '\b(if|elif|else if|for|while|match|case|except|catch)\b')) + len(regexp_extract_all(text, '&&|\|\|')))"
FILLED = "greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))"


@query(f"""
SELECT lang, count(*) AS n_docs, sum(len(text))::BIGINT AS chars, sum(len(string_split(text, chr(10))))::BIGINT AS lines,
       sum({FILLED})::BIGINT AS filled, sum({TOKENS})::BIGINT AS tokens FROM documents GROUP BY lang
""")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length(t)).alias("chars"), F.sum(F.size(text.lines(t))).alias("lines"), F.sum(text.filled_lines(t)).alias("filled"), F.sum(text.token_estimate(t)).alias("tokens"))


@query(f"SELECT doc_id, {FILLED}::BIGINT AS lines, {TOKENS}::BIGINT AS tokens FROM documents ORDER BY lines DESC, tokens DESC, doc_id LIMIT 5")
def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.filled_lines(F.col("text")).cast("long").alias("lines"), text.token_estimate(F.col("text")).cast("long").alias("tokens"))
    return rows.orderBy(F.desc("lines"), F.desc("tokens"), "doc_id").limit(5)


@query(f"SELECT doc_id, {COMPLEXITY}::BIGINT AS complexity, {FILLED}::BIGINT AS lines FROM documents ORDER BY complexity DESC, lines DESC, doc_id LIMIT 5")
def most_complex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.lexical_complexity(F.col("text")).cast("long").alias("complexity"), text.filled_lines(F.col("text")).cast("long").alias("lines"))
    return rows.orderBy(F.desc("complexity"), F.desc("lines"), "doc_id").limit(5)


@query(r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, lower(text) AS low FROM documents)
SELECT doc_id, CASE WHEN contains(low, 'api_key') OR contains(low, 'apikey') OR contains(low, 'password') OR contains(low, 'secret') OR contains(low, 'token') OR contains(low, 'private_key')
  THEN '[REDACTED]' ELSE substr(array_to_string(list_transform(string_split(t, ' '), lambda w: CASE WHEN strlen(w) > 80 THEN '[LONG_TEXT:' || strlen(w) || ']' ELSE w END), ' '), 1, 512) END AS summary FROM n
""")
def sanitize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted_summary(F.col("text")).alias("summary"))


@query("""
SELECT page_id, CASE WHEN strlen(string_split(html, chr(10))[1]) > 8000 AND len(string_split(html, chr(10))) <= 1 THEN 'long first line'
  WHEN strlen(string_split(html, chr(10))[1]) > 2000 AND contains(string_split(html, chr(10))[1], '{') AND contains(string_split(html, chr(10))[1], ';') THEN 'minified script' END AS minified,
  CASE WHEN contains(lower(html), '@generated') THEN '@generated' WHEN contains(lower(html), 'code generated') THEN 'code generated' WHEN contains(lower(html), 'do not edit') THEN 'do not edit' WHEN contains(lower(html), 'generated by') THEN 'generated by' END AS generated
FROM pages
""")
def generated_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.minified_reason(F.col("html"), F.lit(True)).alias("minified"), text.generated_reason(F.col("html")).alias("generated"))


@query(r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s]+')) AS literal FROM documents)
SELECT doc_id, literal, count(*) AS n FROM words WHERE len(literal) > 4 GROUP BY doc_id, literal HAVING count(*) > 3
""")
def duplicated_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), 0)).alias("literal"))
    return words.where(F.length("literal") > 4).groupBy("doc_id", "literal").agg(F.count("*").alias("n")).where("n > 3")


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '<[A-Za-z]'))::BIGINT AS elements, len(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9.]*)'))::BIGINT AS tags,
       len(list_distinct(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9.]*)', 1)))::BIGINT AS names, len(regexp_extract_all(html, '\bhref='))::BIGINT AS links,
       sha256(array_to_string(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9.]*)', 1), '>')) AS shape FROM pages
""")
def jsx_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    names = F.size(F.array_distinct(F.regexp_extract_all(h, F.lit(r"<([A-Za-z][A-Za-z0-9.]*)"), 1)))
    return table(spark, sf_dir, "pages").select("page_id", text.element_count(h).cast("long").alias("elements"), F.size(text.tags(h)).cast("long").alias("tags"), names.cast("long").alias("names"), F.regexp_count(h, F.lit(r"\bhref=")).cast("long").alias("links"), F.sha2(text.tag_shape(h), 256).alias("shape"))


@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9.]*)', 1)) AS tag, generate_subscripts(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9.]*)', 1), 1) AS i FROM pages),
s AS (SELECT page_id, i, sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM t),
m AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS now FROM s)
SELECT p.page_id, CASE WHEN any_value(p.html) IS NOT NULL THEN coalesce(max(m.now), 0)::INTEGER END AS depth FROM pages p LEFT JOIN m ON m.page_id = p.page_id GROUP BY p.page_id
""")
def tag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.tag_depth(F.col("html")).alias("depth"))


@query(r"""
SELECT page_id, (contains(html, '<script')::INT + contains(html, '<style')::INT + contains(html, '<form')::INT + contains(html, '<nav')::INT + contains(html, 'track(')::INT
  + contains(html, '<footer')::INT + (len(regexp_extract_all(html, '<[A-Za-z]')) > 30)::INT + (len(html) > 3000)::INT + contains(html, 'class="ad"')::INT)::INTEGER AS score FROM pages
""")
def responsibility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    signals = [F.contains(h, F.lit(s)) for s in ("<script", "<style", "<form", "<nav", "track(", "<footer", 'class="ad"')] + [text.element_count(h) > 30, F.length(h) > 3000]
    return table(spark, sf_dir, "pages").select("page_id", sum((s.cast("int") for s in signals[1:]), signals[0].cast("int")).alias("score"))


@query(r"""
WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li[^>]*>')) AS tag FROM pages)
SELECT page_id, count(*) AS items, count(*) FILTER (NOT contains(tag, 'key=')) AS unkeyed FROM li GROUP BY page_id HAVING count(*) FILTER (NOT contains(tag, 'key=')) > 0
""")
def missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<li[^>]*>"), 0)).alias("tag"))
    return li.groupBy("page_id").agg(F.count("*").alias("items"), F.count_if(~F.contains("tag", F.lit("key="))).alias("unkeyed")).where("unkeyed > 0")


PATTERNS = ("time.sleep", "requests.", "token", "password", "secret", "the the", "and and")
ALLOWED = ("and and",)


@query("WITH p(pattern) AS (VALUES " + ", ".join(f"('{p}')" for p in PATTERNS if p not in ALLOWED) + ") SELECT doc_id, pattern FROM documents JOIN p ON contains(lower(text), pattern)")
def blocking_pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in PATTERNS if p not in ALLOWED]), lambda p: p.isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("pattern"))


@query(r"""
WITH t AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '[^\s]+')) AS words, lead(role) OVER w AS next_role, lead(len(regexp_extract_all(text, '[^\s]+'))) OVER w AS next_words
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))
SELECT role || '>' || next_role AS shape, (words > 20) AS long, count(*) AS n FROM t WHERE next_role IS NOT NULL AND next_words > words GROUP BY ALL HAVING count(*) >= 2
""")
def adjacent_validation_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "text")
    words = F.regexp_count("text", F.lit(r"[^\s]+"))
    t = table(spark, sf_dir, "conversations").withColumn("words", words).select("role", "words", F.lead("role").over(w).alias("next_role"), F.lead("words").over(w).alias("next_words"))
    t = t.where("next_role IS NOT NULL AND next_words > words")
    return t.groupBy(F.concat_ws(">", "role", "next_role").alias("shape"), (F.col("words") > 20).alias("long")).agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT source, count(*) AS n_docs, count(*) - count(DISTINCT text) AS surplus FROM documents GROUP BY source ORDER BY surplus DESC, n_docs DESC, source LIMIT 5")
def top_duplicated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), (F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("surplus"))
    return d.orderBy(F.desc("surplus"), F.desc("n_docs"), "source").limit(5)


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '.', 'g'), '^\.+|\.+$', '', 'g') AS code FROM documents")
def rule_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.rule_code(F.col("text")).alias("code"))
