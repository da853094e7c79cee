"""Duplicates among definitions: exact files and bodies, names, structure, meaning, and near copies.

Definitions of all languages are one table (definitions). Every detector gives (rule, path, line, name,
detail) like the other rules, a group by its first place and its number, so no group is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text
from . import groups
from .rules import repeats

CALLABLE = ("function", "method", "component", "hook", "route")
# Names that many types have, and what kinds of definitions are called in rules about names.
COMMON_METHODS = ("new", "default", "from", "into", "fmt", "clone", "drop")
NAME_RULES = {"function": "function", "class": "class", "method": "method", "component": "react_component", "hook": "react_hook", "route": "fastapi_route_handler"}
# The parts of a near score in percent, and the words that stand for nodes of a syntax tree.
PARTS = {"token": 30, "tree": 25, "statement": 15, "statements": 5, "call": 10, "whole": 10, "control": 5}
NODES = ("if", "else", "for", "while", "match", "switch", "try", "return", "await", "function", "fn", "def", "{", "(", "=", ".", "!", "?")


def definitions(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """path, language, kind, name, owner, line, start, inner (the text inside), params, shape, public, calls of rows of sources/braces and Python definitions of sources/symbols."""
    c = F.col
    calls = F.regexp_extract_all("body", F.lit(r"([A-Za-z_$][\w$.]*)\s*\("), 1)
    shown = F.exists("attributes", lambda a: a.rlike("^(pub|export)")) | c("head").rlike(r"^\s*(pub|export)\b")
    kinds = (*CALLABLE, "class", "struct", "enum", "trait", "type", "interface")
    scanned = rows.where(c("kind").isin(*kinds) & (c("language") != "python"))
    scanned = scanned.select("path", "language", "kind", "name", "owner", "line", "start", F.when(c("kind").isin(*CALLABLE), c("body")).alias("inner"), "params", c("shape_hash").alias("shape"), F.coalesce(shown, F.lit(False)).alias("public"), calls.alias("calls"), F.lit(None).cast("int").alias("nodes"))
    owner = F.nullif(F.regexp_extract("qualified", r"^(.*)\.[^.]*$", 1), F.lit(""))
    python = defs.where(c("kind").isin(*kinds))
    python = python.select("path", F.lit("python").alias("language"), "kind", "name", owner.alias("owner"), c("start_line").alias("line"), c("start_line").alias("start"), "inner", "params", c("structural_hash").alias("shape"), (~F.startswith("name", F.lit("_"))).alias("public"), "calls", c("n_nodes").alias("nodes"))
    return scanned.unionByName(python)


def sized(found: DataFrame, least_lines: int, least_tokens: int) -> DataFrame:
    """Callables of so many filled lines and tokens or more, with what is inside them normalised."""
    bodies = found.where(F.col("kind").isin(*CALLABLE) & F.col("inner").isNotNull()).withColumn("plain", text.strip_comments(F.col("inner")))
    return bodies.where((text.filled_lines(F.col("plain")) >= least_lines) & (text.token_estimate(F.col("plain")) >= least_tokens))


def exact_files(files: DataFrame) -> DataFrame:
    """Files of equal normalised text."""
    norm = text.normalised(F.col("source"))
    rows = files.where(norm != "").select("path", F.lit(1).alias("line"), F.lit(0).alias("start"), F.lit(None).cast("string").alias("name"), F.sha2(norm, 256).alias("hash"))
    return repeats(rows, "duplicate.exact.file", [F.col("hash")])


def exact_bodies(found: DataFrame, *, least_lines: int = 5, least_tokens: int = 40) -> DataFrame:
    """Callables with equal bodies but for comments and white space, across languages."""
    return repeats(sized(found, least_lines, least_tokens), "duplicate.exact.body", [F.sha2(text.normalised(F.col("plain")), 256)])


def names(found: DataFrame) -> DataFrame:
    """Names that recur in one language for one kind of definition, by six signs; the detail is score, severity and number."""
    c = F.col
    rust_types = c("kind").isin("struct", "enum", "trait", "type") & (c("language") == "rust")
    rule = F.when(rust_types, "rust_type").when((c("language") == "rust") & (c("kind") == "method"), "rust_impl_method").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in NAME_RULES.items() for x in kv]), c("kind")))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = found.withColumn("rule", F.concat(F.lit("duplicate.name."), rule)).where(c("rule").isNotNull()).withColumn("folder", folder).withColumn("scope", F.concat_ws("|", "path", F.coalesce("owner", F.lit(""))))
    grouped = rows.groupBy("language", "rule", "name").agg(
        F.min(F.struct("path", "start", "line")).alias("first"), F.count("*").alias("n"), F.countDistinct("scope").alias("scopes"), F.countDistinct("folder").alias("folders"), F.countDistinct("path").alias("paths"), F.countDistinct("owner").alias("owners"), F.count("owner").alias("owned"), F.count_if("public").alias("publics"),
    ).where("n > 1")
    framework = c("rule").rlike("react_|fastapi_")
    points = lambda test, n: F.when(test, n).otherwise(0)
    same_scope, same_owner = c("scopes") < c("n"), c("owners") < c("owned")
    score = points(same_scope, 5) + points(c("folders") < c("paths"), 2) + points(c("paths") > 1, 1) + points(framework, 3) + F.least("publics", F.lit(3)) + points(same_owner, 3)
    common = c("rule").rlike("method$") & c("name").isin(*COMMON_METHODS) & ~same_scope & ~same_owner
    scored = grouped.withColumn("score", score).where((c("score") >= F.when(framework, 2).otherwise(3)) & ~common)
    severity = F.when(same_scope | c("rule").rlike("fastapi_") | (c("score") >= 7), "high").when(c("score") >= 4, "medium").otherwise("low")
    return scored.select("rule", "first.path", "first.line", "name", F.concat_ws(":", "score", severity, "n").alias("detail"))


def structural(found: DataFrame, *, least_lines: int = 1, least_tokens: int = 5, least_nodes: int = 5) -> DataFrame:
    """Callables of one language with equal shape."""
    rows = sized(found, least_lines, least_tokens).where(F.coalesce("nodes", F.lit(least_nodes)) >= least_nodes)
    return repeats(rows, "duplicate.structural.function", [F.col("language"), F.col("shape")])


def semantic(defs: DataFrame, *, without: tuple[str, ...] = ()) -> DataFrame:
    """Python callables equal in meaning by some rewrite, and not all equal in structure; those that used a rewrite of `without` take no part."""
    used = F.exists("rewrites", lambda r: r.isin(*without)) if without else F.lit(False)
    rows = defs.where(F.col("semantic_hash").isNotNull() & ~used)
    first = F.min(F.struct("path", F.col("start_line").alias("line"), "name")).alias("first")
    found = rows.groupBy("semantic_hash").agg(first, F.count("*").alias("n"), F.min("structural_hash").alias("low"), F.max("structural_hash").alias("high"), F.max(F.size("rewrites")).alias("rewritten")).where("n > 1 AND low <> high AND rewritten > 0")
    return found.select(F.lit("duplicate.semantic.function").alias("rule"), "first.path", "first.line", "first.name", F.col("n").cast("string").alias("detail"))


def families(found: DataFrame) -> DataFrame:
    """(id, language, shape, statements, family, shingle): the distinct shingles of five families of each callable, as hashes."""
    words, lined = text.tokens(F.col("plain")), F.split("plain", "\n")
    trimmed = F.transform(lined, lambda x: text.normalised(F.regexp_replace(F.regexp_replace(x, r"^[\s{}]+|[\s{}]+$", ""), r";+\s*$", "")))
    rows = found.select("id", "language", "shape", "calls", words.alias("w"), F.filter(trimmed, lambda x: (x != "") & ~x.isin(")", "};", ");")).alias("lines"))
    nodes = F.filter("w", lambda t: t.isin(*NODES))
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(nodes), F.lit(1))), lambda i: F.array_join(F.slice(nodes, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4))), ">"))
    n = F.size("w")
    kinds = {
        "token": text.shingles(F.col("w"), text.shingle_size(n, 3, 5, 7)), "tree": F.when(F.size(nodes) > 0, text.shingles(paths, text.shingle_size(n, 3, 4, 5))).otherwise(F.array().cast("array<string>")),
        "statement": text.shingles(F.col("lines"), text.shingle_size(n, 1, 2, 3)), "call": F.array_distinct("calls"), "control": F.array_distinct(text.control_flow(F.col("w"))),
    }
    code = lambda kind: lambda s: F.shiftleft(F.shiftright(F.xxhash64(F.lit(kind), s), 3), 3)
    hashed = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*[F.transform(own, code(k)) for k, own in kinds.items()]))
    return rows.select("id", "language", "shape", F.size("lines").alias("statements"), F.explode(hashed).alias("family", "own")).select("id", "language", "shape", "statements", "family", F.explode("own").alias("shingle"))


def near_pairs(found: DataFrame, *, threshold: int = 82, least: int = 20, share: int = 5) -> DataFrame:
    """(l, r, score) of callables (id, language, shape, plain, calls) of one language and unequal shape that are near copies.

    The score is the mean of the families' weighted similarities by PARTS. All other parts at their best,
    the tokens must reach a part of the threshold by themselves, so pairs are sought among those; below a
    threshold of 70 they need only have a run of tokens in common.
    """
    rows = groups.checkpointed(families(found).distinct())
    total = found.count()
    frequency = rows.groupBy("family", "shingle").agg(F.count("*").alias("df")).where(F.col("df") < similarity.common_cutoff(F.lit(total), least, share))
    rare = rows.join(frequency, ["family", "shingle"]).withColumn("weight", similarity.rarity(F.lit(total), F.col("df")))
    floor = max(1, -(-100 * (threshold - 100 + PARTS["token"]) // PARTS["token"]))
    token = rare.where("family = 'token'").select(F.col("id").alias("class"), "language", F.lit(1).cast("long").alias("n"), "shingle", "df", "weight")
    _, met = groups.weighted_jaccard_classes(token, floor, "language")
    code = F.col("shingle").bitwiseOR(F.col("weight").cast("long") - 1)
    bags = groups.checkpointed(rare.groupBy("id", "shape", "statements").pivot("family", [k for k in PARTS if k not in ("statements", "whole")]).agg(F.collect_list(code)))
    side = lambda s: bags.select(*[F.col(c).alias(f"{c}_{s}") for c in bags.columns])
    both = met.select("l", "r").join(side("l"), F.col("l") == F.col("id_l")).join(side("r"), F.col("r") == F.col("id_r")).where("NOT shape_l <=> shape_r")
    weigh = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(7).cast("long")) + 1)
    kept = lambda k, s: F.coalesce(f"{k}_{s}", F.array().cast("array<bigint>"))
    kinds = [k for k in PARTS if k not in ("statements", "whole")]
    common = {k: weigh(F.array_intersect(kept(k, "l"), kept(k, "r"))) for k in kinds}
    united = {k: weigh(kept(k, "l")) + weigh(kept(k, "r")) - common[k] for k in kinds}
    of = {k: F.when(united[k] == 0, F.lit(100)).otherwise(similarity.percent(common[k], united[k])) for k in kinds}
    of["whole"] = similarity.percent(reduce(Column.__add__, common.values()), reduce(Column.__add__, united.values()))
    of["statements"] = similarity.count_similarity(F.col("statements_l"), F.col("statements_r"))
    score = similarity.weighted_average(*[(of[k], n) for k, n in PARTS.items()])
    return both.select("l", "r", score.alias("score")).where(F.col("score") >= threshold)


def near(found: DataFrame, *, threshold: int = 82, least_lines: int = 5, least_tokens: int = 40, least: int = 20, share: int = 5) -> DataFrame:
    """Groups of near copies by links, at their first place; the detail is their number and the score of the strongest pair."""
    rows = groups.checkpointed(sized(found, least_lines, least_tokens).withColumn("id", F.xxhash64("path", "start", "name")))
    pairs = groups.checkpointed(near_pairs(rows, threshold=threshold, least=least, share=share))
    labels = groups.connected_components(pairs)
    strong = groups.strongest(pairs.join(labels, F.col("l") == F.col("id")).select("component", "l", "r", "score"), "component")
    first = rows.join(labels, "id").groupBy("component").agg(F.min(F.struct("path", "start", "line", "name")).alias("first"), F.count("*").alias("n"))
    return first.join(strong, "component").select(F.lit("duplicate.near.function").alias("rule"), "first.path", "first.line", "first.name", F.concat_ws(":", "n", "score").alias("detail"))
