"""Duplicate detection over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import groups, vectors
from .catalog import query, spread, table

NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(rf"""
WITH h AS (SELECT DISTINCT doc_id, sha256({NORM}) AS content_hash FROM documents WHERE {NORM} <> ''),
g AS (SELECT content_hash, count(*) AS n_members, min(doc_id) AS first_doc FROM h GROUP BY content_hash HAVING count(*) > 1)
SELECT content_hash, n_members, first_doc, doc_id FROM h JOIN g USING (content_hash)
""")
def exact_file_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document of a group of equal ones."""
    docs = _documents(spark, sf_dir).where(text.normalised(F.col("text")) != "")
    members, found = groups.duplicate_groups(docs, text.normalised(F.col("text")), F.col("doc_id"))
    return members.join(found, "content_hash").select("content_hash", "n_members", F.col("first_member").alias("first_doc"), F.col("member").alias("doc_id"))


@query(r"""
WITH bodies AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
), normal AS (SELECT doc_id, n, trim(regexp_replace(line, '\s+', ' ', 'g')) AS body FROM bodies)
SELECT sha256(body) AS content_hash, count(*) AS n_members, count(DISTINCT doc_id) AS n_documents, min(doc_id) AS first_doc
FROM normal WHERE len(regexp_extract_all(body, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')) >= 8 GROUP BY body HAVING count(*) > 1
""")
def exact_body_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _documents(spark, sf_dir).select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("n", "line"))
    bodies = bodies.withColumn("body", text.normalised(F.col("line"))).where(text.token_estimate(F.col("body")) >= 8)
    hashed = bodies.groupBy(F.sha2("body", 256).alias("content_hash")).agg(F.count("*").alias("n_members"), F.countDistinct("doc_id").alias("n_documents"), F.min("doc_id").alias("first_doc"))
    return hashed.where("n_members > 1")


@query(rf"""
WITH h AS (SELECT lang, sha256({NORM}) AS k FROM documents)
SELECT (SELECT count(*) FROM (SELECT k FROM h GROUP BY k HAVING count(*) > 1)) AS groups_any,
       (SELECT count(*) FROM (SELECT lang, k FROM h GROUP BY lang, k HAVING count(*) > 1)) AS groups_per_lang
""")
def cross_lang_vs_per_lang_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _documents(spark, sf_dir).select("lang", F.sha2(text.normalised(F.col("text")), 256).alias("k"))
    per = hashed.groupBy("lang", "k").agg(F.count("*").alias("n"))
    whole = per.groupBy("k").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("own"))
    return whole.agg(F.count_if(F.col("n") > 1).alias("groups_any"), F.sum("own").cast("long").alias("groups_per_lang"))


HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(rf"""
WITH p AS (
  SELECT page_id, {HOST} AS scope, regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]+)/', 1) AS lang,
         regexp_extract(regexp_replace(regexp_extract(url, '^[^?#]*'), '(\.html|/)$', ''), '([^/]+)$', 1) AS name,
         regexp_extract({HOST}, '([^.]+\.[^.]+)$', 1) AS owner FROM pages
), g AS (
  SELECT lang, name, count(*) AS n, count(DISTINCT scope) AS scopes, count(DISTINCT owner) AS owners,
         CASE WHEN count(*) > count(DISTINCT scope) THEN 5 ELSE 0 END + CASE WHEN count(DISTINCT scope) > 1 THEN 1 ELSE 0 END
           + least(count(*), 3) + CASE WHEN count(*) > count(DISTINCT owner) THEN 3 ELSE 0 END AS score
  FROM p GROUP BY lang, name HAVING count(*) > 1
)
SELECT lang, name, n, scopes, owners, score::INTEGER AS score,
       CASE WHEN n > scopes OR score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS severity
FROM g WHERE score >= 3
""")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_extract("url", r"^[^?#]*", 0), r"(\.html|/)$", "")
    p = table(spark, sf_dir, "pages").select(host.alias("scope"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([a-z]+)/", 1).alias("lang"), F.regexp_extract(bare, r"([^/]+)$", 1).alias("name"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("owner"))
    g = p.groupBy("lang", "name").agg(F.count("*").alias("n"), F.countDistinct("scope").alias("scopes"), F.countDistinct("owner").alias("owners")).where("n > 1")
    points = lambda c, w: F.when(c, w).otherwise(0)
    score = points(F.col("n") > F.col("scopes"), 5) + points(F.col("scopes") > 1, 1) + F.least("n", F.lit(3)) + points(F.col("n") > F.col("owners"), 3)
    g = g.withColumn("score", score.cast("int")).where("score >= 3")
    return g.withColumn("severity", F.when((F.col("n") > F.col("scopes")) | (F.col("score") >= 7), "high").when(F.col("score") >= 4, "medium").otherwise("low"))


SHAPE = r"array_to_string(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9.]*)', 1), '>')"


@query(rf"""
SELECT sha256({SHAPE}) AS shape_hash, count(*) AS n_members, min(page_id) AS first_page
FROM pages WHERE len(regexp_extract_all(html, '<[A-Za-z]')) >= 3 GROUP BY {SHAPE} HAVING count(*) > 1
""")
def structural_shape_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(text.element_count(F.col("html")) >= 3)
    return pages.groupBy(F.sha2(text.tag_shape(F.col("html")), 256).alias("shape_hash")).agg(F.count("*").alias("n_members"), F.min("page_id").alias("first_page")).where("n_members > 1")


WORDS_SQL = r"""
  SELECT doc_id AS id, lang, regexp_extract_all(lower(text), '[a-z0-9_]+|[^\sA-Za-z0-9_]') AS w FROM documents
"""
LONG_SQL = f"""
  SELECT DISTINCT id, lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS shingle
  FROM ({WORDS_SQL}) WHERE len(w) >= 40
"""


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread(_documents(spark, sf_dir).select("doc_id", "lang", "text")).select(F.col("doc_id").alias("id"), "lang", F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]+|[^\sA-Za-z0-9_])"), 1).alias("w"))
    return words.where(F.size("w") >= 40)


def _runs() -> F.Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))


@query(f"""
WITH long AS ({LONG_SQL}), f AS (SELECT shingle, count(*) AS df FROM long GROUP BY shingle)
SELECT df, count(*) AS n_shingles FROM f GROUP BY df
""")
def shingle_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _shingled(spark, sf_dir).select("id", F.explode(F.array_distinct(_runs())).alias("shingle"))
    return long.groupBy("shingle").agg(F.count("*").alias("df")).groupBy("df").agg(F.count("*").alias("n_shingles"))


#: A shingle is common in this many documents, or this percentage of them where that is more.
COMMON = (20, 5)
CUTOFF_SQL = f"greatest({COMMON[0]}, total * {COMMON[1]} // 100, 2)"


@query(f"""
WITH long AS ({LONG_SQL}), f AS (SELECT shingle, count(*) AS df FROM long GROUP BY shingle),
n AS (SELECT count(DISTINCT id) AS total FROM long)
SELECT least(8, 1 + floor(log2(total // df)))::INTEGER AS weight, count(*) AS n_shingles, min(df) AS lowest, max(df) AS highest
FROM f, n WHERE df < {CUTOFF_SQL} GROUP BY 1
""")
def rare_shingle_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shingled(spark, sf_dir)
    total = docs.count()
    f = docs.select("id", F.explode(F.array_distinct(_runs())).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") < similarity.common_cutoff(F.lit(total), *COMMON))
    return f.groupBy(similarity.rarity(F.lit(total), F.col("df")).cast("int").alias("weight")).agg(F.count("*").alias("n_shingles"), F.min("df").alias("lowest"), F.max("df").alias("highest"))


PAIRS_SQL = f"""
long AS ({LONG_SQL}), n AS (SELECT count(DISTINCT id) AS total FROM long),
f AS (SELECT shingle, count(*) AS df FROM long GROUP BY shingle HAVING count(*) < (SELECT {CUTOFF_SQL} FROM n)),
rare AS (SELECT id, lang, shingle, least(8, 1 + floor(log2(total // df)))::BIGINT AS weight FROM long JOIN f USING (shingle), n),
whole AS (SELECT id, sum(weight)::BIGINT AS w FROM rare GROUP BY id),
shared AS (SELECT a.id AS l, b.id AS r, sum(least(a.weight, b.weight))::BIGINT AS common FROM rare a JOIN rare b ON a.shingle = b.shingle AND a.lang = b.lang AND a.id < b.id GROUP BY a.id, b.id),
pairs AS (SELECT l, r, least(100, (common * 100 + (x.w + y.w - common) // 2) // (x.w + y.w - common))::INTEGER AS score
          FROM shared JOIN whole x ON x.id = l JOIN whole y ON y.id = r)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, classes of equal texts, and pairs of classes."""
    members, rare = groups.shingle_classes(_shingled(spark, sf_dir), F.col("w"), _runs(), *COMMON, "lang")
    return members, *groups.weighted_jaccard_classes(rare, 82, "lang")


@query(f"WITH {PAIRS_SQL} SELECT l, r, score FROM pairs WHERE score >= 82")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.member_pairs(*_pairs(spark, sf_dir), "lang")


@query(f"""
WITH RECURSIVE {PAIRS_SQL}, edges AS (SELECT l AS a, r AS b FROM pairs WHERE score >= 82 UNION SELECT r, l FROM pairs WHERE score >= 82),
walk AS (SELECT a AS id, a AS seen FROM edges UNION SELECT w.id, e.b FROM walk w JOIN edges e ON e.a = w.seen)
SELECT id, min(seen) AS component FROM walk GROUP BY id
""")
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.connected_components(groups.member_edges(*_pairs(spark, sf_dir), "lang"))


def _hash(s: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


SIG_SQL = f"""
words AS ({WORDS_SQL}), sets AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM words WHERE len(w) >= 40),
sig AS (SELECT id, list_transform(range(0, 8), lambda k: list_min(list_transform(s, lambda x: ('0x' || substr(md5(k::VARCHAR || ':' || x), 1, 15))::BIGINT))) AS sig FROM sets),
bands AS (SELECT id, sig, unnest(range(0, 4)) AS band FROM sig),
keyed AS (SELECT id, sig, band, sig[band * 2 + 1]::VARCHAR || ':' || sig[band * 2 + 2]::VARCHAR AS bucket FROM bands),
candidates AS (SELECT DISTINCT a.id AS l, b.id AS r, a.sig AS sa, b.sig AS sb FROM keyed a JOIN keyed b ON a.band = b.band AND a.bucket = b.bucket AND a.id < b.id)
"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _shingled(spark, sf_dir).select("id", F.explode(F.array_distinct(_runs())).alias("x"))
    return sets.groupBy("id").agg(F.array(*[F.min(_hash(F.concat(F.lit(f"{k}:"), F.col("x")))) for k in range(8)]).alias("sig"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = groups.checkpointed(_signatures(spark, sf_dir))
    keyed = signed.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("band"))
    keyed = keyed.withColumn("bucket", F.array_join(F.transform(F.slice("sig", F.col("band") * 2 + 1, 2), lambda x: x.cast("string")), ":"))
    keyed = keyed.select("id", F.xxhash64("band", "bucket").alias("key"))
    sized = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    met = groups.blocked_pairs(sized, F.col("n"), "id", ["key"]).select(F.col("a.id").alias("l"), F.col("b.id").alias("r")).distinct()
    side = lambda c: signed.select(F.col("id").alias(c), F.col("sig").alias(f"s{'a' if c == 'l' else 'b'}"))
    return met.join(side("l"), "l").join(side("r"), "r")


@query(f"WITH {SIG_SQL} SELECT l, r FROM candidates")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("l", "r")


@query(f"WITH {SIG_SQL} SELECT l, r, (len(list_filter(range(1, 9), lambda i: sa[i] = sb[i])) * 100 + 4) // 8 AS estimate FROM candidates")
def minhash_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    return _candidates(spark, sf_dir).select("l", "r", similarity.percent(equal, F.lit(8)).cast("long").alias("estimate"))


def _banded(spark: SparkSession, sf_dir: str, functions: int = 96, rows: int = 4) -> DataFrame:
    """(l, r, estimate): pairs that share a band of `rows` minima, estimated from all `functions` minima."""
    hashed = _shingled(spark, sf_dir).select("id", F.explode(F.array_distinct(F.transform(_runs(), lambda s: F.xxhash64(s)))).alias("x"))
    minima = [F.min(F.xxhash64("x", F.lit(k))) for k in range(functions)]
    signed = groups.checkpointed(hashed.groupBy("id").agg(F.array(*minima).alias("sig")))
    bands = F.transform(F.sequence(F.lit(0), F.lit(functions // rows - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows)))
    keyed = signed.select("id", F.explode(bands).alias("bucket"))
    sized = keyed.join(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    met = groups.blocked_pairs(sized, F.col("n"), "id", ["bucket"]).select(F.col("a.id").alias("l"), F.col("b.id").alias("r")).distinct()
    side = lambda c: signed.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"))
    equal = F.size(F.filter(F.zip_with("sl", "sr", lambda x, y: x == y), lambda e: e))
    return met.join(side("l"), "l").join(side("r"), "r").select("l", "r", similarity.percent(equal, F.lit(functions)).alias("estimate"))


@query()
def minhash_estimate_96(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and their estimates by 96 functions in 24 bands of 4."""
    return _banded(spark, sf_dir)


VEC_SQL = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
pairs AS (SELECT a.vec_id AS l, b.vec_id AS r, round((list_dot_product(a.e, b.e) + 1) * 50)::INTEGER AS score FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)
"""


@query(f"WITH {VEC_SQL} SELECT l, r, score FROM pairs WHERE score >= 65")
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All near pairs of one label."""
    return vectors.near_pairs(table(spark, sf_dir, "embeddings"), 65)


@query(f"""
WITH RECURSIVE {VEC_SQL}, edges AS (SELECT l AS a, r AS b FROM pairs WHERE score >= 65 UNION SELECT r, l FROM pairs WHERE score >= 65),
walk AS (SELECT a AS id, a AS seen FROM edges UNION SELECT w.id, e.b FROM walk w JOIN edges e ON e.a = w.seen)
SELECT id, min(seen) AS component FROM walk GROUP BY id
""")
def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.connected_components(groups.checkpointed(vectors.near_links(table(spark, sf_dir, "embeddings"), 65)))


#: Dimensions of the provided vectors.
WIDTH = 64
SIGNS_SQL = ", ".join("[" + ", ".join(f"{s}" for s in signs) + "]" for signs in similarity.simhash_signs(WIDTH))
SIMHASH_SQL = f"""
signs AS (SELECT [{SIGNS_SQL}] AS s),
hashed AS (SELECT vec_id, label, list_transform(range(0, 8), lambda byte: list_sum(list_transform(range(0, 8), lambda bit: CASE WHEN list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: abs(embedding[i]::DOUBLE) * s[byte * 8 + bit + 1][i])) >= 0 THEN 1 << bit ELSE 0 END))::INTEGER) AS bytes FROM embeddings, signs),
banded AS (SELECT vec_id, label, unnest(range(0, 8))::INTEGER AS band, unnest(bytes) AS bucket FROM hashed)
"""


def _banded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "embeddings").where(F.size("embedding") == WIDTH)
    return wide.select("vec_id", "label", "embedding", F.posexplode(similarity.simhash(F.col("embedding"), WIDTH)).alias("band", "bucket"))


@query(f"WITH {SIMHASH_SQL} SELECT label, band, bucket, count(*) AS n FROM banded GROUP BY label, band, bucket")
def simhash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors of a label fall into each bucket of the eight bands of their simhash."""
    return _banded_vectors(spark, sf_dir).groupBy("label", "band", "bucket").agg(F.count("*").alias("n"))


@query(f"""
WITH {SIMHASH_SQL}, {VEC_SQL}
SELECT DISTINCT p.l, p.r, p.score FROM pairs p JOIN banded x ON x.vec_id = p.l JOIN banded y ON y.vec_id = p.r AND y.band = x.band AND y.bucket = x.bucket WHERE p.score >= 65
""")
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label that share a bucket of their simhash and are near enough."""
    banded = _banded_vectors(spark, sf_dir).groupBy("vec_id").agg(F.collect_set(F.col("band") * 256 + F.col("bucket")).alias("buckets"))
    return vectors.near_pairs(table(spark, sf_dir, "embeddings"), 65, banded).distinct()


@query("""
SELECT a.p_partkey AS l, b.p_partkey AS r,
       (CASE WHEN a.p_size = b.p_size THEN 40 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 30 ELSE 0 END
        + CASE WHEN (a.p_retailprice > 1000) = (b.p_retailprice > 1000) THEN 20 ELSE 0 END + CASE WHEN a.p_name = b.p_name THEN 10 ELSE 0 END)::INTEGER AS similarity
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey
""")
def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "part").alias("a"), table(spark, sf_dir, "part").alias("b")
    equal = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    joined = a.join(b, equal("p_brand") & equal("p_name") & (F.col("a.p_partkey") < F.col("b.p_partkey")))
    dear = (F.col("a.p_retailprice") > 1000) == (F.col("b.p_retailprice") > 1000)
    return joined.select(F.col("a.p_partkey").alias("l"), F.col("b.p_partkey").alias("r"), similarity.signature_similarity(equal("p_size"), equal("p_type"), dear, equal("p_name")).alias("similarity"))
