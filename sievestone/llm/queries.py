"""The queries of this subpackage by name, and SQL where an independent engine can answer them."""

from . import html, language, mixing, neardup, neighbours, packing, search, secrets, substrings, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_substrings": substrings.op3_substrings,
    "op4_language": language.op4_language,
    "op5_secrets": secrets.op5_secrets,
    "op6_html": html.op6_html,
    "op7_urls": urls.op7_urls,
    "op8_search": search.op8_search,
    "op9_neardup": neardup.op9_neardup,
    "op10_neighbours": neighbours.op10_neighbours,
}
ORACLES = {"op1_mixing": mixing.OP1_SQL, "op7_urls": urls.OP7_SQL}
