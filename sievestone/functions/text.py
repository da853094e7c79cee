"""Text as columns: normalisation, tokens, line tools, redaction, markup metrics. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules that these functions evaluate.
GENERATED_MARKERS = ("@generated", "code generated", "do not edit", "generated by")
SECRET_MARKERS = ("api_key", "apikey", "password", "secret", "token", "private_key")
COMPLEXITY_WORDS = r"\b(if|elif|else if|for|while|match|case|except|catch)\b"
CONTROL_TOKENS = ("if", "else", "for", "while", "match", "case", "catch", "except", "try", "return", "await", "?")
MINIFIED_LINE, SCRIPT_LINE, SUMMARY_CHARS, LONG_WORD_BYTES, SAMPLE_BYTES = 8000, 2000, 512, 80, 65536


def normalised(s: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def tokens(s: Column) -> Column:
    """Runs of ASCII letters, digits and underscore in lower case; any other visible character by itself."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(?U)([A-Za-z0-9_]+|[^\sA-Za-z0-9_])"), 1), F.lower)


def token_estimate(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"(?U)[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"))


def lines(s: Column) -> Column:
    return F.split(s, "\n")


def filled_lines(s: Column) -> Column:
    """Lines that are not blank, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(lines(s), lambda x: F.trim(x) != "")))


def strip_comments(s: Column) -> Column:
    """Comments of three syntaxes out, string literals kept; one alternation decides which begins first.

    Literals are matched without a way back, so their length costs no stack.
    """
    pattern = r"""("{3}(?s:.*?)"{3}|'{3}(?s:.*?)'{3}|"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`)|//[^\n]*|#[^\n]*|/\*(?s:.*?)\*/"""
    return F.regexp_replace(s, pattern, "$1 ")


def normalised_body(s: Column) -> Column:
    return normalised(F.replace(strip_comments(s), F.lit("\r\n"), F.lit("\n")))


def shingles(words: Column, k: int | Column) -> Column:
    """Distinct runs of k words (all words, if fewer), sorted."""
    k = F.least(F.lit(k) if isinstance(k, int) else k, F.size(words))
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) > 0, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<string>"))


def shingle_size(n: Column, small: int, middle: int, large: int) -> Column:
    """By the number of tokens: below 80, below 250, from there."""
    return F.when(n < 80, small).when(n < 250, middle).otherwise(large)


def control_flow(words: Column) -> Column:
    return F.filter(words, lambda t: t.isin(*CONTROL_TOKENS))


def identifier_words(name: Column) -> Column:
    """Parts of snake, kebab and camel case, in lower case."""
    return F.filter(F.transform(F.split(F.regexp_replace(name, r"([A-Z])", r"_$1"), "[_-]+"), F.lower), lambda w: w != "")


def generated_reason(sample: Column) -> Column:
    low = F.lower(sample)
    reason = F.lit(None).cast("string")
    for marker in reversed(GENERATED_MARKERS):
        reason = F.when(F.contains(low, F.lit(marker)), F.lit(marker)).otherwise(reason)
    return reason


def minified_reason(sample: Column, script: Column) -> Column:
    """A very long first line, alone; or in a script, a long one that looks like code."""
    first = F.substring_index(sample, "\n", 1)
    long_alone = (F.octet_length(first) > MINIFIED_LINE) & (F.size(lines(sample)) <= 1)
    code = script & (F.octet_length(first) > SCRIPT_LINE) & F.contains(first, F.lit("{")) & F.contains(first, F.lit(";"))
    return F.when(long_alone, F.lit("long first line")).when(code, F.lit("minified script"))


def skip_reason(size: Column, most: Column, binary: Column, generated: Column, minified: Column) -> Column:
    return F.when(size > most, "too_large").when(binary, "binary").when(generated.isNotNull(), "generated").when(minified.isNotNull(), "minified")


def redacted_summary(s: Column) -> Column:
    """Whole texts that name a secret, and single words that are too long, are replaced; 512 characters stay."""
    hides = F.lit(False)
    for marker in SECRET_MARKERS:
        hides = hides | F.contains(F.lower(s), F.lit(marker))
    short = F.transform(F.split(normalised(s), " "), lambda w: F.when(F.octet_length(w) > LONG_WORD_BYTES, F.concat(F.lit("[LONG_TEXT:"), F.octet_length(w).cast("string"), F.lit("]"))).otherwise(w))
    return F.when(hides, "[REDACTED]").otherwise(F.substring(F.array_join(short, " "), 1, SUMMARY_CHARS))


def lexical_complexity(s: Column) -> Column:
    return 1 + F.regexp_count(F.lower(s), F.lit(COMPLEXITY_WORDS)) + F.regexp_count(s, F.lit(r"&&|\|\|"))


def rule_code(s: Column) -> Column:
    """Lower case, other characters than letters and digits as single dots inside."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "."), r"^\.+|\.+$", "")


def escaped_html(s: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(mark), F.lit(name))
    return s


def snippet(s: Column, most_lines: int = 12, most_chars: int = 2000) -> Column:
    return F.substring(F.array_join(F.slice(lines(s), 1, most_lines), "\n"), 1, most_chars)


def tags(html: Column) -> Column:
    """Opening and closing tags in order."""
    return F.regexp_extract_all(html, F.lit(r"<(/?[A-Za-z][A-Za-z0-9.]*)"), 1)


def element_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"<[A-Za-z]"))


def tag_depth(html: Column) -> Column:
    """Deepest nesting by opening and closing tags; it never falls below 0."""
    step = lambda s, t: F.struct(F.greatest(F.lit(0), s["now"] + F.when(F.startswith(t, F.lit("/")), -1).otherwise(1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(F.startswith(t, F.lit("/")), -1).otherwise(1)).alias("most"))
    return F.aggregate(tags(html), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def tag_shape(html: Column) -> Column:
    """Tag sequence with capitalised names as Component."""
    return F.array_join(F.transform(tags(html), lambda t: F.when(t.rlike(r"^/?[A-Z]"), F.regexp_replace(t, "[A-Z].*", "Component")).otherwise(t)), ">")


def path_template(url: Column) -> Column:
    """The path of a URL, numeric segments as a parameter."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(F.regexp_replace(path, r"\.html$", ""), "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lit("{id}")).otherwise(p)), "/"))
