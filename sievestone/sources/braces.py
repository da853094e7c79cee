"""Syntax that rules look at, as rows: definitions, conditions, arrows, matches, callbacks and fragments.

TypeScript, TSX and Rust are read by a scanner that blanks comments and strings and pairs brackets, so
every span ends where its bracket does; Python is read by the standard syntax tree. One call per Arrow
batch; all rules on these rows are column expressions. Limits of the scanner: regular expression
literals that hold quotes or brackets, and text between tags that holds two slashes or unpaired brackets.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, language string, kind string, name string, owner string, params array<string>, attributes array<string>, start int, stop int, line int, end_line int, depth int, head string, body string, tail string, returns boolean, nests boolean, yields boolean, opposite boolean, shape_hash string"
FIELDS = [p.strip().split(" ")[0] for p in SCHEMA.split(", ")]
INTS, FLAGS, LISTS = {"start", "stop", "line", "end_line", "depth"}, {"returns", "nests", "yields", "opposite"}, {"params", "attributes"}

HIDDEN = {
    "rust": re.compile(r"""//[^\n]*|/\*.*?\*/|\br(#*)".*?"\1|"(?:\\.|[^"\\])*"|'(?:\\[^\n]{1,8}?|[^'\\\n])'""", re.S),
    "typescript": re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S),
}
TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|\s+|.""", re.S)
RETURN, CONTINUES, ELSE, SPACE = re.compile(r"\s*return\b"), re.compile(r"\s*(else|catch|finally)\b"), re.compile(r"\s*else\b\s*"), re.compile(r"\s*")
OPENS_VALUE, NEXT_BOOLEAN, ARROW = re.compile(r"(=|=>|return|\(|,|:)\s*$"), re.compile(r"\s*(return\s+(?:true|false)\s*;?)"), re.compile(r"\s*(?::[^={;]+)?=>\s*")
VISIBLE = re.compile(r"(pub(?:\([^)]*\))?|export(?:\s+default)?)\s+(?:async\s+|unsafe\s+|const\s+|abstract\s+|declare\s+)*$")
NOT_CALLED = frozenset("pub if for while switch match return catch function typeof await fn loop in impl where as super constructor Some Ok Err".split())
LITERAL = re.compile(r"""'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|[0-9][0-9._]*""", re.S)
DECLARED = re.compile(r"\b(?:let|const|var|for)\s+(?:mut\s+)?\(?\[?([A-Za-z_$][\w$]*)")


def masked(source: str, language: str) -> str:
    """The source with comments and strings blanked, of the same length and with the same line ends."""
    return HIDDEN["rust" if language == "rust" else "typescript"].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def partners(mask: str) -> dict[int, int]:
    """Where each bracket closes; a bracket that doesn't pair is left out."""
    found, stack, closes = {}, [], {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", mask):
        if m[0] not in closes:
            stack.append((m[0], m.start()))
        elif any(s[0] == closes[m[0]] for s in stack):
            while stack[-1][0] != closes[m[0]]:
                stack.pop()
            found[stack.pop()[1]] = m.start()
    return found


def split_top(text: str, mask: str, at: str = ",") -> list[str]:
    """Parts of text between commas outside brackets; mask is its blanked form."""
    parts, depth, since = [], 0, 0
    for k, c in enumerate(mask):
        depth += (c in "([{<") - (c in ")]}" or c == ">" and mask[k - 1 : k] not in ("=", "-"))
        if c == at and depth <= 0:
            parts.append(text[since:k])
            since = k + 1
    return [p.strip() for p in [*parts, text[since:]] if p.strip()]


def shape(body: str, params: list[str]) -> str:
    """Digest of the tokens, parameters and locals by their order, without comments and white space; names of fields stay."""
    places = {p: f"PARAM_{k}" for k, p in enumerate(p for p in params if p != "self")}
    for name in DECLARED.findall(body):
        places.setdefault(name, f"LOCAL_{len(places)}")
    tokens = [t for t in TOKEN.findall(body) if not t.isspace() and not t.startswith(("//", "/*"))]
    names = lambda k: k and (tokens[k - 1] == "." or tokens[k - 1] in "{," and tokens[k + 1 : k + 2] == [":"])
    kept = [t if names(k) else places.get(t, t) for k, t in enumerate(tokens)]
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def last_returns(text: str) -> bool:
    """Whether the last statement of a block's inside is a return."""
    mask = masked(text, "typescript")
    pairs, cut, k, full = partners(mask), 0, 0, len(mask.rstrip(" \n\t;")) - 1
    while k < len(mask):
        if mask[k] in "([{" and k in pairs:
            closed = mask[k] == "{" and not OPENS_VALUE.search(mask[max(0, k - 60) : k])
            k = pairs[k]
            cut = k + 1 if closed and k < full and not CONTINUES.match(mask, k + 1) else cut
        elif mask[k] == ";" and k < full or mask[k] == "\n" and RETURN.match(mask, k):
            cut = k + 1
        k += 1
    return bool(RETURN.match(mask, cut))


def literal(text: str) -> bool | None:
    """The boolean that a block's inside or a statement returns, if that is all it does."""
    m = re.fullmatch(r"\s*\{?\s*(?:return\s+)?(true|false)\s*;?\s*\}?\s*", text)
    return None if m is None else m[1] == "true"


class Scan:
    """One file: its text, its mask, its bracket pairs, and the rows found so far."""

    def __init__(self, path: str, language: str, source: str):
        self.path, self.language, self.source = path, language, source
        self.mask = masked(source, language)
        self.pairs = partners(self.mask)
        self.breaks = [m.start() for m in re.finditer("\n", source)]
        self.rows: list[dict] = []

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def add(self, kind: str, start: int, stop: int, **rest) -> None:
        none = dict.fromkeys(FIELDS) | {"params": [], "attributes": []}
        self.rows.append(none | {"path": self.path, "language": self.language, "kind": kind, "start": start, "stop": stop, "line": self.line(start), "end_line": self.line(max(start, stop - 1))} | rest)

    def block(self, at: int, stops: str = ";") -> int | None:
        """The next opening brace after `at` outside other brackets, unless a stop comes first."""
        while at < len(self.mask):
            c = self.mask[at]
            if c == "{":
                return at if at in self.pairs else None
            if c in stops or c in ")]}":
                return None
            at = self.pairs.get(at, at) + 1
        return None

    def inside(self, opening: int) -> str:
        return self.source[opening + 1 : self.pairs[opening]]

    def conditions(self) -> None:
        for m in re.finditer(r"\bif\b", self.mask):
            at = SPACE.match(self.mask, m.end()).end()
            if self.language == "rust":
                opening = self.block(at)
                if opening is None:
                    continue
                head, inside, stop = self.source[at:opening], self.inside(opening), self.pairs[opening] + 1
            else:
                if at not in self.pairs or self.mask[at] != "(":
                    continue
                head, after = self.source[at + 1 : self.pairs[at]], self.pairs[at] + 1
                begin = SPACE.match(self.mask, after).end()
                if begin in self.pairs and self.mask[begin] == "{":
                    opening, inside, stop = begin, self.inside(begin), self.pairs[begin] + 1
                else:  # a single statement
                    opening, end = begin, self.mask.find(";", begin)
                    stop = end + 1 if end >= 0 else len(self.mask)
                    inside = self.source[begin:stop]
            other = ELSE.match(self.mask, stop)
            tail, follows, ends = None, "", stop
            if other:
                begin = other.end()
                end = self.pairs[begin] + 1 if begin in self.pairs else self.mask.find(";", begin) + 1 or len(self.mask)
                if self.mask.startswith("if", begin) and (b := self.block(begin + 2)) is not None:
                    end = self.pairs[b] + 1
                tail = follows = self.source[begin:end]
                ends = end
            else:
                nxt = NEXT_BOOLEAN.match(self.mask, stop)
                if nxt and self.language != "rust":
                    follows, ends = nxt[1], nxt.end()
            first, second = literal(inside), literal(follows)
            opposite = first is not None and second is not None and first != second
            self.add(
                "if", m.start(), ends if opposite else stop, head=head.strip(), body=inside, tail=tail, returns=last_returns(inside), yields=first,
                nests=bool(re.search(r"\bif\b", top(masked(inside, self.language)))), opposite=opposite,
            )


def top(mask: str) -> str:
    """A blanked text without what stands in its brackets."""
    pairs, out, k = partners(mask), [], 0
    while k < len(mask):
        out.append(mask[k])
        k = pairs.get(k, k) + 1
    return "".join(out)


def item_rows(scan: Scan, kinds: str) -> None:
    """Types and modules by their keywords, imports, and the names that are called."""
    mask, source = scan.mask, scan.source
    for m in re.finditer(rf"\b({kinds})\s+([A-Za-z_]\w*)", mask):
        opening = scan.block(m.end(), ";=" if m[1] == "type" else ";")
        end = scan.pairs[opening] + 1 if opening is not None else mask.find(";", m.end()) + 1 or len(mask)
        before = VISIBLE.search(mask[max(0, m.start() - 60) : m.start()])
        scan.add(m[1], m.start(), end, name=m[2], attributes=[" ".join(before[1].split())] if before else [], body=source[m.start() : end])
    for m in re.finditer(r"^[ \t]*((?:pub\s+)?use|import|export\s*(?:\*|\{[^}]*\})\s*from)\b[^;\n]*(?:\{[^}]*\}[^;\n]*)?", mask, re.M):
        text = " ".join(source[m.start() : m.end()].split())
        scan.add("import", m.start(), m.end(), head=text, name=(re.search(r"""["']([^"']+)["']""", text) or re.search(r"use\s+([\w:]+\w)", text) or [None, None])[1])
    for m in re.finditer(r"([A-Za-z_$][\w$]*(?:(?:\.|::|\?\.)[A-Za-z_$][\w$]*)*!?)\s*\(", mask):
        if m[1] not in NOT_CALLED and not mask[max(0, m.start() - 12) : m.start()].rstrip().endswith(("fn", "function")):
            scan.add("call", m.start(), scan.pairs.get(m.end() - 1, m.end()) + 1, name=m[1])


def rust_rows(scan: Scan) -> None:
    mask, source = scan.mask, scan.source
    item_rows(scan, "struct|enum|trait|mod|type")
    owners = []
    for m in re.finditer(r"^\s*(?:unsafe\s+)?impl\b([^{;]*)\{", mask, re.M):
        if m.end() - 1 in scan.pairs:
            header = re.sub(r"^<[^>]*>", "", " ".join(m[1].split())).strip()
            owners.append((m.end() - 1, scan.pairs[m.end() - 1], header))
    for m in re.finditer(r"\bfn\s+(\w+)\s*(?:<[^({]*>)?\s*\(", mask):
        opening = m.end() - 1
        if opening not in scan.pairs or (body := scan.block(scan.pairs[opening] + 1)) is None:
            continue
        within = [o for o in owners if o[0] < m.start() < o[1]]
        given = split_top(source[opening + 1 : scan.pairs[opening]], mask[opening + 1 : scan.pairs[opening]])
        params = [re.sub(r"^(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?", "", p.split(":")[0].strip()) for p in given]
        before = source[max(0, m.start() - 2000) : m.start()].rstrip().splitlines()
        attributes = []
        while before and (before[-1].strip().startswith("#[") or before[-1].strip() in ("pub", "async", "unsafe", "pub async")):
            attributes.append(before.pop().strip())
        scan.add("method" if within else "function", m.start(), scan.pairs[body] + 1, name=m[1], owner=within[-1][2] if within else None, params=params, attributes=[a for a in attributes if a.startswith("#")], head=source[m.start() : body].strip(), body=source[body : scan.pairs[body] + 1], shape_hash=shape(source[body : scan.pairs[body] + 1], params))
    for m in re.finditer(r"\benum\s+(\w+)[^{;]*\{", mask):
        if m.end() - 1 in scan.pairs:
            variants = split_top(scan.inside(m.end() - 1), mask[m.end() : scan.pairs[m.end() - 1]])
            for v in variants:
                v = re.sub(r"^(?:#\[[^\]]*\]\s*|//[^\n]*\n\s*)+", "", v)
                fields = re.search(r"[({](.*)[)}]\s*$", v, re.S)
                scan.add("variant", m.start(), scan.pairs[m.end() - 1] + 1, owner=m[1], name=re.split(r"[\s({=]", v)[0], params=split_top(fields[1], masked(fields[1], "rust")) if fields else [], body=v)
    spans = []
    for m in re.finditer(r"\bmatch\b", mask):
        if (opening := scan.block(m.end())) is not None:
            spans.append((m.start(), opening, scan.pairs[opening] + 1))
    for start, opening, stop in spans:
        depth = sum(s < start and stop <= e for s, _, e in spans) + 1
        scan.add("match", start, stop, depth=depth, head=source[start + 5 : opening].strip(), body=source[start:stop])
        at = opening + 1
        while at < stop - 1:  # an arm: up to the arrow, then a block or all up to a comma
            arrow = at
            while arrow < stop - 1 and not mask.startswith("=>", arrow):
                arrow = scan.pairs.get(arrow, arrow) + 1
            if arrow >= stop - 1:
                break
            begin = arrow + 2
            while begin < stop - 1 and mask[begin].isspace():
                begin += 1
            end = begin
            if mask[begin] == "{" and begin in scan.pairs:
                end = scan.pairs[begin] + 1
            else:
                while end < stop - 1 and mask[end] != ",":
                    end = scan.pairs.get(end, end) + 1
            scan.add("arm", begin, end, owner=str(start), head=source[at:arrow].strip(), body=source[begin:end].strip())
            at = end + 1 if mask[end : end + 1] == "," else end


def script_rows(scan: Scan) -> None:
    mask, source = scan.mask, scan.source
    item_rows(scan, "class|interface|type|enum")
    for m in LITERAL.finditer(source):
        text = m[0].replace("_", "") if m[0][0].isdigit() else m[0]
        if text not in ("0", "1") and (m[0][0].isdigit() or len(text.encode()) > 4):
            scan.add("literal", m.start(), m.end(), name=text)
    for m in re.finditer(r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^({]*>)?\s*\(|\b(?:const|let|var)\s+(\w+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:<[^(]*>\s*)?\(", mask):
        name, opening = m[1] or m[2], m.end() - 1
        if opening not in scan.pairs:
            continue
        after = scan.pairs[opening] + 1
        if m[2]:
            arrow = ARROW.match(mask, after)
            if not arrow:
                continue
            begin = arrow.end()
            stop = scan.pairs[begin] + 1 if begin in scan.pairs else (mask.find(";", begin) + 1 or len(mask))
        else:
            found = scan.block(after)
            if found is None:
                continue
            begin, stop = found, scan.pairs[found] + 1
        given = source[opening + 1 : scan.pairs[opening]]
        bound = re.match(r"\s*\{([^}]*)\}", given)
        params = [re.split(r"[:=]", p)[0].strip().lstrip(".") for p in split_top(given if bound is None else bound[1], masked(given if bound is None else bound[1], "typescript"))]
        body = source[begin:stop]
        has_tags = bool(re.search(r"<[A-Za-z>]", body)) and scan.language == "tsx"
        kind = "component" if has_tags and name[:1].isupper() else "hook" if re.match(r"use[A-Z]", name) else "function"
        if kind == "component" and bound is None:
            params = sorted(set(re.findall(rf"\b{re.escape(params[0])}\.(\w+)", body))) if params and re.fullmatch(r"\w+", params[0]) else []
        scan.add(kind, m.start(), stop, name=name, params=params, head=source[m.start() : begin].strip(), body=body, shape_hash=shape(body, params))
    for m in re.finditer(r"=>\s*\{", mask):
        opening = m.end() - 1
        inside = scan.inside(opening) if opening in scan.pairs else ""
        found = re.fullmatch(r"\s*return\b\s*(\S.*?);?\s*", inside, re.S)
        if found and ";" not in top(masked(found[1], "typescript")):
            scan.add("arrow", opening, scan.pairs[opening] + 1, head=found[1].strip(), body=inside)
    for m in re.finditer(r"\.map\(", mask):
        if m.end() - 1 in scan.pairs:
            scan.add("map", m.start(), scan.pairs[m.end() - 1] + 1, body=source[m.start() : scan.pairs[m.end() - 1] + 1])
    if scan.language == "tsx":
        for m in re.finditer(r"<>((?:(?!<>|</>).)*)</>", source, re.S):
            child = m[1].strip()
            if "{/*" not in child and (only := single_tag(child)):
                scan.add("fragment", m.start(), m.end(), head=only, body=m[0])


def single_tag(text: str) -> str | None:
    """The text, if it is one element or one expression in braces and nothing else."""
    if text.startswith("{"):
        return text if partners(masked(text, "typescript")).get(0) == len(text) - 1 else None
    depth, ends = 0, -1
    for m in re.finditer(r"<(/?)([A-Za-z][\w.]*)?(?:[^<>{}]|\{[^{}]*\}|=>)*?(/?)>", text):
        if m.start() > 0 and depth == 0:
            return None
        depth += -1 if m[1] else 0 if m[3] else 1
        if depth == 0:
            ends = m.end()
            break
    return text if text.startswith("<") and ends == len(text) else None


def python_rows(scan: Scan) -> None:
    """Conditions and data models of a Python file; a file with a syntax error has none."""
    try:
        tree = ast.parse(scan.source)
    except (SyntaxError, ValueError):
        return
    starts = [0, *(b + 1 for b in scan.breaks)]
    place = lambda line, col: starts[line - 1] + len(scan.source[starts[line - 1] :].split("\n", 1)[0].encode()[:col].decode(errors="ignore"))
    text = lambda nodes: "\n".join(ast.unparse(n) for n in nodes)
    boolean = lambda nodes: nodes[0].value.value if len(nodes) == 1 and isinstance(nodes[0], ast.Return) and isinstance(nodes[0].value, ast.Constant) and isinstance(nodes[0].value.value, bool) else None
    for parent in ast.walk(tree):
        for block in (getattr(parent, f, None) for f in ("body", "orelse", "finalbody")):
            for k, node in enumerate(block if isinstance(block, list) else []):
                if isinstance(node, ast.If):
                    first, second = boolean(node.body), boolean(node.orelse or block[k + 1 : k + 2])
                    opposite = first is not None and second is not None and first != second
                    last = block[k + 1] if opposite and not node.orelse else node
                    scan.add(
                        "if", place(node.lineno, node.col_offset), place(last.end_lineno, last.end_col_offset), head=ast.unparse(node.test), body=text(node.body), tail=text(node.orelse) if node.orelse else None,
                        returns=isinstance(node.body[-1], ast.Return), nests=any(isinstance(n, ast.If) for n in node.body), yields=first, opposite=opposite,
                    )
                elif isinstance(node, (ast.Import, ast.ImportFrom)):
                    named = [a.name for a in node.names] if isinstance(node, ast.Import) else ["." * node.level + (node.module or "")]
                    for name in named:
                        scan.add("import", place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), name=name, head=ast.unparse(node))
                elif isinstance(node, ast.ClassDef) and any(ast.unparse(b).split(".")[-1] == "BaseModel" for b in node.bases):
                    fields = [f"{s.target.id}:{ast.unparse(s.annotation)}" for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
                    scan.add("model", place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), name=node.name, params=sorted(fields))


def rows(path: str, language: str, source: str) -> list[dict]:
    scan = Scan(path, language, source)
    if language == "python":
        python_rows(scan)
        return scan.rows
    scan.conditions()
    (rust_rows if language == "rust" else script_rows)(scan)
    return scan.rows


def extract(files: DataFrame) -> DataFrame:
    """Rows of the files in (path, language, source); other languages and null sources have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = lambda f: pa.int32() if f in INTS else pa.list_(pa.string()) if f in LISTS else pa.bool_() if f in FLAGS else pa.string()
        for batch in batches:
            found = [r for file in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in rows(*file)]
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in found], kind(f)) for f in FIELDS], names=FIELDS)

    return files.where("language IN ('typescript', 'tsx', 'rust', 'python') AND source IS NOT NULL AND path IS NOT NULL").select("path", "language", "source").mapInArrow(run, SCHEMA)
