"""Rules on the rows of sources/braces: style, React and Rust, as column expressions.

Every rule gives (rule, path, line, name, detail); rules about repeats give the first place in order and
how many there are, so no group is ever collected. Thresholds are parameters with the usual defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Texts that the rules look for.
UNSTABLE_KEYS = ("key={index}", "key={i}", "key={idx}", "key={Math.random()}", "key={Date.now()}")
FETCHING = ("fetch(", "axios.", "useQuery(", "useSuspenseQuery(", "graphql", "supabase.", "client.query(")
VAGUE_MESSAGES = ("", "todo", "fixme", "failed", "error", "invalid", "unwrap")
LEAST_MESSAGE, LEAST_ARM, LEAST_SHAPE = 12, 8, 8
SMALL_MATCH, SMALL_HANDLER = 8, 12


def has(text: str, col: str = "body") -> Column:
    return F.contains(F.col(col), F.lit(text))


def occurrences(*patterns: str, col: str = "body") -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(F.col(col), F.lit(p)) for p in patterns])


def body_lines() -> Column:
    return F.greatest(F.lit(1), F.size(F.split(F.regexp_replace("body", r"\n$", ""), "\n")))


def one_pass(rows: DataFrame, rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """All rules that look at one row, in a single pass over the rows."""
    hits = [F.when(c, F.struct(F.lit(r).alias("rule"), (F.lit(None) if d is None else d).cast("string").alias("detail"))) for r, (c, d) in rules.items()]
    hit = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    return rows.select("path", "line", "name", hit.alias("__hit")).select("__hit.rule", "path", "line", "name", "__hit.detail")


def repeats(rows: DataFrame, rule: str, keys: list[Column], least: int = 2) -> DataFrame:
    """The first row of each group of at least so many rows with equal keys, none of them null."""
    keyed = rows.select("path", "line", "start", "name", *[k.alias(f"__k{n}") for n, k in enumerate(keys)]).dropna(subset=[f"__k{n}" for n in range(len(keys))])
    first = F.min(F.struct("path", "start", "line", "name")).alias("__first")
    groups = keyed.groupBy(*[f"__k{n}" for n in range(len(keys))]).agg(first, F.count("*").alias("__n")).where(F.col("__n") >= least)
    return groups.select(F.lit(rule).alias("rule"), "__first.path", "__first.line", "__first.name", F.col("__n").cast("string").alias("detail"))


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def style(rows: DataFrame, *, most_lines: int = 80, most_params: int = 6, most_terms: int = 3, guard_clauses: bool = False) -> DataFrame:
    """Conditions, arrows and sizes. The detail of a safe rewrite is the text that replaces the node."""
    condition, scripts = F.col("kind") == "if", F.col("language").isin("typescript", "tsx")
    terms = 1 + occurrences(r"&&", r"\|\|", " and ", " or ", col="head")
    callable_ = F.col("kind").isin("function", "method", "component", "hook")
    python, given = F.col("language") == "python", F.filter("params", lambda p: ~p.isin("self", "cls"))
    negated = F.when(python, F.concat(F.lit("not ("), "head", F.lit(")"))).otherwise(F.concat(F.lit("!("), "head", F.lit(")")))
    value = F.when(F.col("yields"), F.col("head")).otherwise(negated)
    statement = F.when(F.col("language") == "rust", value).when(python, F.concat(F.lit("return "), value)).otherwise(F.concat(F.lit("return "), value, F.lit(";")))
    arrow = F.when(F.startswith("head", F.lit("{")), F.concat(F.lit("("), "head", F.lit(")"))).otherwise(F.col("head"))
    return one_pass(rows, {
        "style.boolean_return_simplifiable": (condition & F.col("opposite"), statement),
        "style.expression_arrow_simplifiable": ((F.col("kind") == "arrow") & ~has("this") & ~has("arguments"), arrow),
        "style.unnecessary_else_after_return": (condition & (scripts | python) & F.col("tail").isNotNull() & F.col("returns"), None),
        "style.nested_conditional": (condition & F.col("nests"), None),
        "style.guard_clause": (F.lit(guard_clauses) & condition & F.col("tail").isNull() & ~F.col("returns") & (body_lines() >= 4), None),
        "style.complex_condition": (condition & (terms > most_terms), terms),
        "style.large_function": (callable_ & (body_lines() > most_lines), body_lines()),
        "style.high_parameter_count": (callable_ & (F.size(given) > most_params), F.size(given)),
    })


def components(rows: DataFrame) -> DataFrame:
    """React components with the numbers that the rules compare."""
    hooks = F.regexp_extract_all("body", F.lit(r"(use[A-Z][A-Za-z0-9_]*)\s*\("), 1)
    tags = F.regexp_extract_all("body", F.lit(r"</?[A-Za-z][A-Za-z0-9._]*[^>]*"), 0)
    name = lambda t: F.regexp_replace(F.regexp_extract(t, r"^</?([A-Za-z][A-Za-z0-9._]*)", 1), "^[A-Z].*$", "Component")
    props = lambda t: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z0-9_:-]*)\s*="), 1))), ",")
    shape = F.array_join(F.transform(tags, lambda t: F.when(F.startswith(t, F.lit("</")), F.concat(F.lit("</"), name(t), F.lit(">"))).otherwise(F.concat(F.lit("<"), name(t), F.lit(":"), props(t), F.lit(">")))), "")
    step = lambda s, t: F.struct(
        F.greatest(F.lit(0), s["now"] + F.when(F.startswith(t, F.lit("</")), -1).when(F.endswith(F.rtrim(t), F.lit("/")), 0).otherwise(1)).alias("now"),
        F.greatest(s["most"], s["now"] + F.when(F.startswith(t, F.lit("</")), 0).otherwise(1)).alias("most"),
    )
    depth = F.aggregate(tags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])
    fetches = reduce(lambda a, b: a | b, [has(f) for f in FETCHING])
    provided = F.when(has("value={{"), F.size(F.filter(F.split(F.split_part(F.substring_index("body", "value={{", -1), F.lit("}}"), F.lit(1)), ","), lambda v: F.trim(F.regexp_replace(v, r"\s", " ")) != ""))).otherwise(0)
    forwarded = F.regexp_extract_all("body", F.lit(r"\b([A-Za-z][A-Za-z0-9_]*)\s*=\{\s*(?:[^{}]*\.)?\1\s*\}"), 1)
    most = F.array_max(F.transform(F.array_distinct(forwarded), lambda n: F.size(F.filter(forwarded, lambda m: m == n))))
    called = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_$][\w$.]*)\s*\("), 1))
    outside = F.filter(called, lambda c: ~c.rlike(r"(^|\.)(use[A-Z]\w*|set[A-Z]\w*|map|filter|reduce|forEach)$|^(if|for|while|switch|return|catch|function)$|^React\."))
    handlers = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(on[A-Z][A-Za-z0-9_]*)\s*="), 1))
    children = F.array_distinct(F.filter(F.regexp_extract_all("body", F.lit(r"<([A-Z][A-Za-z0-9_]*)"), 1), lambda t: t != F.col("name")))
    count = lambda hook: occurrences(rf"{hook}\(", rf"React\.{hook}\(")
    elements = occurrences("<[A-Za-z]")
    found = rows.where("kind = 'component'").select(
        "*", hooks.alias("hooks"), shape.alias("shape"), F.size(tags).alias("n_tags"), depth.alias("jsx_depth"), fetches.alias("fetches"), provided.alias("provided"), F.coalesce(most, F.lit(0)).alias("forwards"), count("useState").alias("states"),
        count("useEffect").alias("effects"), count("useContext").alias("contexts"), elements.alias("elements"), body_lines().alias("n_lines"), occurrences("set[A-Z]").alias("setters"), F.size(outside).alias("calls"), F.size(handlers).alias("handlers"), F.size(children).alias("children"), has(".Provider").alias("provides"),
    )
    signals = ["states > 1", "effects > 0", "contexts > 0", "children > 3", "handlers > 3", "calls > 1", "elements > 12", "fetches", "provides"]
    return found.withColumn("responsibilities", F.expr(" + ".join(f"CAST({s} AS INT)" for s in signals)))


def react(rows: DataFrame, *, most_lines: int = 180, most_props: int = 8, most_depth: int = 5, forwards: int = 3, most_values: int = 6, responsibilities: int = 5) -> DataFrame:
    """Rules on TSX files; the detail of a redundant fragment is its only child."""
    rows = rows.where("language IN ('tsx', 'typescript')")
    parts, c = components(rows), F.col
    single = one_pass(parts, {
        "react.large_component": (c("n_lines") > most_lines, c("n_lines")),
        "react.too_many_props": (F.size("params") > most_props, F.size("params")),
        "react.deeply_nested_jsx": (c("jsx_depth") > most_depth, c("jsx_depth")),
        "react.unnecessary_effect_candidate": ((c("effects") > 0) & (c("setters") > 0), None),
        "react.derived_state_candidate": ((c("states") > 0) & (c("effects") > 0) & (c("setters") > 0), None),
        "react.prop_drilling_candidate": (c("forwards") >= forwards, c("forwards")),
        "react.large_context_provider": (c("provides") & (F.greatest("provided", "states") > most_values), F.greatest("provided", "states")),
        "react.mixed_data_fetching_and_rendering": ((c("elements") >= 5) & c("fetches"), None),
        "react.component_too_many_responsibilities": (c("responsibilities") > responsibilities, c("responsibilities")),
    })
    other = one_pass(rows, {
        "react.missing_key": ((c("kind") == "map") & has("<") & ~has("key="), None),
        "react.redundant_fragment": (c("kind") == "fragment", c("head")),
    })
    outer, inner = parts.alias("o"), parts.alias("i")
    within = outer.join(inner, (c("o.path") == c("i.path")) & (c("o.start") < c("i.start")) & (c("i.stop") < c("o.stop"))).select(F.lit("react.inline_component_inside_render").alias("rule"), "i.path", "i.line", "i.name", c("o.name").alias("detail"))
    shapes = repeats(parts.where((c("elements") >= 3) & (c("n_tags") >= 3) & (F.length("shape") >= LEAST_SHAPE)), "react.duplicate_component_shape", [F.sha2("shape", 256)])
    hooks = repeats(parts.where(F.size("hooks") >= 2), "react.repeated_hook_logic", [F.sha2(F.array_join("hooks", "|"), 256)])
    return union([single, other, within, shapes, hooks])


def unstable_keys(files: DataFrame) -> DataFrame:
    """Keys from an index or a value of the moment, over whole files (path, language, source)."""
    pattern = "|".join(k.replace("{", r"\{").replace("}", r"\}").replace("(", r"\(").replace(")", r"\)").replace(".", r"\.") for k in UNSTABLE_KEYS)
    lines = files.where("language IN ('tsx', 'typescript')").select("path", F.posexplode(F.split("source", "\n")).alias("n", "text"))
    keys = F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1))
    return lines.select(F.lit("react.unstable_list_key").alias("rule"), "path", (F.col("n") + 1).alias("line"), F.lit(None).cast("string").alias("name"), keys.alias("detail"))


def literals(rows: DataFrame, most: int = 3) -> DataFrame:
    """Literals of TypeScript and TSX that one file holds more than so many times, at their first place."""
    return repeats(rows.where("kind = 'literal'"), "style.duplicated_literal", [F.col("path"), F.col("name")], most + 1)


def validations(files: DataFrame) -> DataFrame:
    """Lines of a condition with a raise on the next line, of equal shape, twice or more in one Python file."""
    lines = F.split("source", "\n")
    pairs = F.transform(lines, lambda text, n: F.struct((n + 1).alias("line"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("test"), F.trim(F.coalesce(F.get(lines, n + 1), F.lit(""))).alias("then")))
    hits = F.filter(pairs, lambda p: F.startswith(p["test"], F.lit("if ")) & F.startswith(p["then"], F.lit("raise ")))
    found = files.where("language = 'python'").select("path", F.lit(None).cast("string").alias("name"), F.explode(hits).alias("p")).select("path", "name", "p.line", F.col("p.line").alias("start"), "p.test", "p.then")
    return repeats(found, "python.repeated_validation_logic", [F.col("path"), pattern_shape(F.col("test"), 1, ()), F.substring_index("then", "(", 1)])


def pattern_shape(text: Column, least: int = 2, kept: tuple[str, ...] = ("Ok", "Err", "Some", "None", "return", "match")) -> Column:
    """Words as an underscore but for those that carry the pattern, white space as single spaces."""
    core = rf"^([^A-Za-z0-9_]*)([A-Za-z0-9_]{{{least},}})([^A-Za-z0-9_]*)$"
    word = lambda w: F.when(w.rlike(core) & ~F.regexp_extract(w, core, 2).isin(*kept, ""), F.regexp_replace(w, core, "$1_$3")).otherwise(w)
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), word), " ")


def rust(rows: DataFrame, *, most_lines: int = 80, most_params: int = 6, most_unwraps: int = 2, most_depth: int = 4, most_fields: int = 6, least_lines: int = 3, least_words: int = 20) -> DataFrame:
    """Rules on Rust files. Functions that mostly call macros take no part in repeats."""
    rows, c = rows.where("language = 'rust'"), F.col
    functions, matches = rows.where("kind IN ('function', 'method')"), rows.where("kind = 'match'")
    given = F.filter("params", lambda p: p != "self")
    unwraps = occurrences(r"\.unwrap\(\)", r"\.expect\(")
    messages = F.filter(F.regexp_extract_all("body", F.lit(r"""\.expect\(\s*"([^"]*)"""), 1), lambda m: (F.length(F.trim(m)) < LEAST_MESSAGE) | F.lower(F.trim(m)).isin(*VAGUE_MESSAGES))
    optional, fallible = has("Some(") & has("None"), has("Ok(") & has("Err(")
    single = one_pass(rows.where("kind IN ('function', 'method', 'match')"), {
        "rust.large_function": ((c("kind") != "match") & (body_lines() > most_lines), body_lines()),
        "rust.too_many_parameters": ((c("kind") != "match") & (F.size(given) > most_params), F.size(given)),
        "rust.suspicious_unwrap_policy": ((c("kind") != "match") & (unwraps > most_unwraps), unwraps),
        "rust.manual_option_result_pattern_candidate": ((c("kind") == "match") & (optional | fallible) & (body_lines() <= SMALL_MATCH), None),
    })
    vague = functions.select("path", "line", "name", F.explode(messages).alias("detail")).select(F.lit("rust.expect_without_context").alias("rule"), "path", "line", "name", "detail")
    # a nest of matches is reported once, at its outermost, with the depth of its deepest
    depths = matches.alias("o").where("depth = 1").join(matches.alias("i"), (c("o.path") == c("i.path")) & (c("i.start") >= c("o.start")) & (c("i.stop") <= c("o.stop"))).groupBy("o.path", "o.line", "o.start").agg(F.max("i.depth").alias("deepest"))
    nested = depths.where(c("deepest") > most_depth).select(F.lit("rust.deeply_nested_match").alias("rule"), "path", "line", F.lit(None).cast("string").alias("name"), c("deepest").cast("string").alias("detail"))
    widest = rows.where("kind = 'variant'").groupBy("path", "line", "owner").agg(F.max(F.size("params")).alias("n"), F.max_by("name", F.struct(F.size("params"), -F.col("start"))).alias("variant")).where(c("n") > most_fields)
    variants = widest.select(F.lit("rust.large_enum_variant_logic").alias("rule"), "path", "line", c("owner").alias("name"), F.concat_ws(":", "variant", "n").alias("detail"))
    flat = F.trim(F.regexp_replace("body", r"\s+", " "))
    arms = repeats(rows.where("kind = 'arm'").where(F.length(flat) >= LEAST_ARM), "rust.repeated_match_arm_body", [c("path"), c("owner"), F.sha2(flat, 256)])
    macros = F.size(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(\w+)!\s*[(\[{]"), 1)))
    words = F.size(F.filter(F.split("body", r"\s+"), lambda w: w != ""))
    logic = functions.where((body_lines() >= least_lines) & (words >= least_words) & (macros <= 2) & ~has("macro_rules!"))
    trait = F.when(c("owner").contains(" for "), F.split_part("owner", F.lit(" for "), F.lit(1)))
    serde = F.lower("body").rlike("serialize|serde") | F.exists("attributes", lambda a: a.contains("serde"))
    conversion = c("name").rlike("^((from|to|into|as)_.*|from|into)$")
    handled = matches.where(fallible & (body_lines() <= SMALL_HANDLER))
    lined = functions.select("path", "line", "start", "name", F.explode(F.split("body", "\n")).alias("text"))
    shaped = [pattern_shape(c("text"))]
    return union([
        single, vague, nested, variants, arms,
        repeats(logic.where("kind = 'function'"), "rust.duplicate_free_function", [c("shape_hash")]),
        repeats(logic.where("kind = 'method'"), "rust.duplicate_impl_method", [c("shape_hash")]),
        repeats(logic.where("kind = 'method'"), "rust.duplicate_trait_method_implementation", [trait, c("name"), c("shape_hash")]),
        repeats(logic.where(conversion), "rust.repeated_conversion_function", [c("shape_hash")]),
        repeats(logic.where(serde), "rust.repeated_serde_glue", [c("shape_hash")]),
        repeats(handled, "rust.repeated_result_handling", [c("path"), F.sha2(pattern_shape(c("body")), 256)]),
        repeats(lined.where(c("text").contains(".map_err(")), "rust.repeated_error_mapping", [c("path"), *shaped]),
        repeats(lined.where(c("text").contains("return Err(")), "rust.repeated_validation_logic", [c("path"), *shaped]),
    ])


def safe_edits(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Edits (path, start, stop, replacement; byte offsets) of the rewrites that keep the meaning.

    Of rewrites that lie inside one another the outermost is made; the next run finds the others.
    """
    with_place = rows.withColumn("name", F.concat_ws(":", "start", "stop"))
    safe = style(with_place).where("rule IN ('style.boolean_return_simplifiable', 'style.expression_arrow_simplifiable')")
    fragments = react(with_place).where("rule = 'react.redundant_fragment'")
    parts = F.split("name", ":")
    edits = safe.unionByName(fragments).select("path", parts[0].cast("int").alias("from"), parts[1].cast("int").alias("to"), F.col("detail").alias("replacement"))
    before = W.partitionBy("path").orderBy("from", F.desc("to"), "replacement").rowsBetween(W.unboundedPreceding, -1)
    outermost = edits.withColumn("reached", F.max("to").over(before)).where("reached IS NULL OR reached <= from")
    bytes_to = lambda at: F.octet_length(F.substr("source", F.lit(1), at))
    return outermost.join(files.select("path", "source"), "path").select("path", bytes_to(F.col("from")).alias("start"), bytes_to(F.col("to")).alias("stop"), "replacement")


def render_graph(rows: DataFrame) -> DataFrame:
    """(parent, child) of components that render components of the same set of files, each once."""
    parts = rows.where("kind = 'component'")
    children = parts.select(F.col("name").alias("parent"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"<([A-Z][A-Za-z0-9_]*)"), 1))).alias("child"))
    return children.join(parts.select(F.col("name").alias("child")), "child", "left_semi").where("parent <> child").select("parent", "child").distinct()


def calls_within(rows: DataFrame) -> DataFrame:
    """(path, definition, start, callee, n): the calls that each function, method, component or hook holds."""
    d, c = rows.where("kind IN ('function', 'method', 'component', 'hook')").alias("d"), rows.where("kind = 'call'").alias("c")
    inside = (F.col("d.path") == F.col("c.path")) & (F.col("c.start") >= F.col("d.start")) & (F.col("c.stop") <= F.col("d.stop"))
    return d.join(c, inside).groupBy("d.path", F.col("d.name").alias("definition"), "d.start", F.col("c.name").alias("callee")).agg(F.count("*").alias("n"))


def structural_groups(rows: DataFrame, least_lines: int = 1, least_words: int = 5) -> DataFrame:
    """Definitions of one language with equal shape, by their first place."""
    words = F.size(F.filter(F.split("body", r"\s+"), lambda w: w != ""))
    return repeats(rows.where(F.col("shape_hash").isNotNull() & (body_lines() >= least_lines) & (words >= least_words)), "duplicate.structural.function", [F.col("language"), F.col("shape_hash")])
