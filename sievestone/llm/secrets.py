"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio.

DataFrame functions only. Two bigram models over the characters of tokens are trained from labelled
samples that rules make: random strings (digests written in hexadecimal and two base64 alphabets) and
ordinary identifiers and paths (words joined in camel case, with underscores, hyphens, dots, slashes).
A token counts as secret when the mean log-likelihood ratio of its bigrams is positive by a margin. The
ratios are kept in whole thousandths of a bit, so sums are exact and any engine gets the same spans.

Matches get their places without Python: between the matches of a pattern lie the pieces that split()
leaves, and running lengths of both give start and end in code points.

Null and empty texts have no spans. Texts of any length are read whole. Rows are judged one by one, so
ties and repeated rows have equal results; an empty table gives an empty result. The operator reads the
text column only and keeps the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# Kinds in the order that breaks ties, their patterns, and what a match must satisfy.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})$"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_.=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
#: Thousandths of a bit per bigram by which a random token must be the likelier one.
MARGIN = 600

# Ordinary words, of which the labelled identifiers are made.
WORDS = """
about access account action address after again always amount answer archive article author balance before between
block body border branch buffer build button cache call category center change channel check child city class client
close code color column comment company complete config connect content context control count country create current
customer data date default delete detail device display document domain download email enable error event example
export field file filter find first folder format found frame from function group handle header height hello image
import index info input install item key label language last layout length level library line link list load local
location lock login main manager map market message method model module month name network next node number object
offset open option order output owner package page parent part password path payment people person phone place plan
player point policy position price print process product profile project property public query question queue read
record region release remove report request result return right route rule sample save schedule school score search
section server service session setting shape
""".split()
ENDINGS = "the ing tion ed er ly es en ment able ness heit keit ung lich isch schaft ción mente ado idad eaux elle ent ion eur".replace("ó", "o").split()


def labelled(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(token, random): the labelled samples, `rows` of either class, made by rule and equal in every run."""
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    base64 = F.regexp_replace(F.base64(digest("r")), "=", "")
    form = F.col("id") % 4
    token = F.when(form == 0, F.lower(F.hex(digest("r")))).when(form == 1, base64).when(form == 2, F.translate(base64, "+/", "-_"))
    token = token.otherwise(F.regexp_replace(base64, "[+/]", ""))
    drawn = spark.range(0, rows, 1, 4).select(token.alias("token"), F.lit(True).alias("random"))
    words, ends = F.array(*map(F.lit, WORDS)), F.array(*map(F.lit, ENDINGS))
    pick = lambda of, n, k: F.element_at(of, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(n)) + 1).cast("int"))
    word = [pick(words, len(WORDS), k) for k in range(4)]
    tail = pick(ends, len(ENDINGS), 9)
    number = F.pmod(F.xxhash64(F.col("id"), F.lit("n")), F.lit(3000)).cast("string")
    forms = [
        F.concat(word[0], *[F.initcap(x) for x in word[1:]]), F.concat_ws("_", *word), F.concat_ws("-", *word), F.concat_ws(".", *word),
        F.concat_ws("/", *word), F.concat(word[0], tail, pick(ends, len(ENDINGS), 8), tail), F.concat(word[0], F.lit("/"), word[1], F.lit("/"), number),
        F.upper(F.concat_ws("_", *word)), F.concat(word[0], F.lit("-"), number, F.lit("."), word[1]), F.concat(F.initcap(word[0]), tail, pick(ends, len(ENDINGS), 7), tail),
    ]
    chosen = reduce(lambda rest, k: F.when(F.col("id") % len(forms) == k, forms[k]).otherwise(rest), range(1, len(forms)), forms[0])
    return drawn.unionByName(spark.range(0, rows, 1, 4).select(chosen.alias("token"), F.lit(False).alias("random")))


def bigrams(token: Column) -> Column:
    """Places of a token's character pairs in the model's table, from 0."""
    n = len(ALPHABET)
    at = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1))) - 1
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length(token), F.lit(1))), at)
    pairs = F.transform(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(1))), lambda a, i: a * n + F.element_at(places, (i + 2).cast("int")))
    return F.when(F.length(token) > 1, pairs)


def model(samples: DataFrame) -> list[int]:
    """Thousandths of a bit by which each pair of characters speaks for a random string; add-half smoothing."""
    n = len(ALPHABET)
    counts = samples.select("random", F.explode(bigrams(F.col("token"))).alias("pair")).groupBy("random", "pair").count()
    import math

    seen = {(r.random, r.pair): r["count"] for r in counts.collect()}  # 2 * 68 * 68 rows at most
    after = {(c, a): sum(seen.get((c, a * n + b), 0) for b in range(n)) for c in (True, False) for a in range(n)}
    chance = lambda c, a, b: (seen.get((c, a * n + b), 0) + 0.5) / (after[c, a] + 0.5 * n)
    return [round(1000 * math.log2(chance(True, a, b) / chance(False, a, b))) for a in range(n) for b in range(n)]


def let(value: Column, body) -> Column:
    """body(value), the value being computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, zero: Column, step, emit, state: str, result: str, chunk: int = 256) -> Column:
    """emit(state, item) for each item of an array, the state being that of the items before it.

    The states at the starts of chunks come first and each chunk is walked by itself, so that growing an
    array item by item copies a chunk at most. state and result are the types of both.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    cut = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / chunk).cast("int")), lambda j: F.slice(own, j * chunk + 1, F.lit(chunk)))
    starts = lambda chunks: F.aggregate(
        chunks,
        F.struct(zero.alias("state"), none(state).alias("got")),
        lambda a, own: F.struct(F.aggregate(own, a["state"], step).alias("state"), F.concat(a["got"], F.array(a["state"])).alias("got")),
        lambda a: a["got"],
    )
    walked = lambda own, start: F.aggregate(
        own,
        F.struct(start.alias("state"), none(result).alias("got")),
        lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["got"], F.array(emit(a["state"], x))).alias("got")),
        lambda a: a["got"],
    )
    return let(items, lambda own: let(cut(own), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), walked))))


def places(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end>> of the pattern's matches; keep: what a match must satisfy."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.transform(found, lambda m: F.struct(F.length(m).alias("n"), (keep(m) if keep else F.lit(True)).alias("ok"))).alias("m"), F.slice(between, 1, F.greatest(F.size(found), F.lit(1))).alias("g"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def span(at, pair):
        start = at + pair["g"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + pair["m"]["n"]).alias("end"), pair["m"]["ok"].alias("ok"))

    spans = running(pairs, F.lit(0), lambda at, pair: at + pair["g"] + pair["m"]["n"], span, "int", "struct<start:int,kind:int,end:int,ok:boolean>")
    spans = F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, text_col: str = "text", table: list[int] | None = None, margin: int = MARGIN) -> DataFrame:
    """docs with __base and __spans, each array<struct<start, kind, end>> in order. Spans of the models may overlap base spans, but lie in none."""
    table = table or model(labelled(docs.sparkSession))
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    score = lambda m: F.aggregate(bigrams(m), F.lit(0), lambda s, p: s + F.element_at(ratios, (p + 1).cast("int")))
    random = lambda m: score(m) > margin * (F.length(m) - 1)
    base = F.array_sort(F.concat(places(text, ASSIGN, 0, lambda m: m.rlike(ASSIGN_VALUE)), places(text, ACCESS, 1), places(text, HEX, 2)))
    rows = docs.withColumn("__base", base).withColumn("__more", places(text, TOKEN, 3, random))
    beyond = lambda s: ~F.exists(F.col("__base"), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return rows.withColumn("__spans", F.array_sort(F.concat(F.col("__base"), F.filter(F.col("__more"), beyond)))).drop("__more")


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = None, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span of their texts replaced by a mark; overlapping spans by one."""
    rows = scan(docs, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def piece(end, s):  # what lies between the spans so far and this one, if it lies apart
        return F.when(s["start"] >= end, F.concat(F.substr(text, end + 1, s["start"] - end), F.lit(mark))).otherwise(F.lit(""))

    last = F.array_max(F.transform("__spans", lambda s: s["end"]))
    clean = F.concat(F.array_join(running(F.col("__spans"), F.lit(0), lambda end, s: F.greatest(end, s["end"]), piece, "int", "string"), ""), F.substr(text, last + 1, F.length(text)))
    hit = F.size("__spans") > 0
    rows = rows.withColumn("__text", F.when(hit, clean).otherwise(F.col(text_col)))
    rows = rows.withColumn(text_col, F.col("__text"))
    if chars_col:
        rows = rows.withColumn(chars_col, F.when(hit, F.length(text_col).cast("long")).otherwise(F.col(chars_col)))
    return rows.select(*docs.columns)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter(F.col("__base"), lambda s: s["kind"] == k)).cast("long")
    digest = F.sha2(listed(F.col("__base")), 256)
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), digest.alias("base_sha256"), listed(F.col("__spans")).alias("spans"))
