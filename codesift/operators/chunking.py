"""Splitting source files by structure, and measures of functions.

Python files are read by the interpreter's parser; in other languages top-level
definitions are found by their heads and the balance of brackets, and functions
are measured from tokens (``braces``).  A file is
one row, so files are spread over tasks and no group is collected.
"""

from __future__ import annotations

import ast
import bisect
import keyword
import re
import textwrap
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.operators import braces

LARGE, APART, RUN, GAP = 50, 10, 30, 2
SPANS = "repo_name STRING, file_path STRING, chunk_index INT, chunk_type STRING, start_line INT, end_line INT, symbol STRING, content STRING, symbols_defined ARRAY<STRING>, symbols_called ARRAY<STRING>, imports ARRAY<STRING>"
METRICS = "repo_name STRING, file_path STRING, name STRING, line INT, end_line INT, params INT, complexity INT, nesting INT, calls ARRAY<STRING>"
_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)
_HEADS = {
    "go": re.compile(r"func\b|type\s+(\w+)\s+(?:struct|interface)"),
    "rs": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|impl|trait|mod)\b"),
    "js": re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\b|class\b|interface\b|enum\b)|(?:export\s+)?(?:const|let|var)\s+\w+\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)[^=]*=>"),
}
_IMPORTS = {"go": re.compile(r"import\b|\)|\s*(?:\w+\s+)?\"[^\"]+\"\s*$"), "rs": re.compile(r"(?:pub\s+)?(?:use|extern crate)\b"), "js": re.compile(r"import\b|(?:const|let|var)\s+.*=\s*require\(")}
_NAME = re.compile(r"\b(?:func|fn|function|class|struct|enum|impl|trait|mod|interface|type|const|let|var)\b\s*(?:\([^)]*\)\s*)?\*?\s*([A-Za-z_$][\w$]*)")

# Heads of methods, and statements that open a block, in the languages with braces.
_METHODS = {
    "js": re.compile(r"\s*(?:(?:public|private|protected|static|async|override|abstract|get|set)\s+)*\*?\s*#?(?!(?:if|for|while|switch|catch|return|function|with|new|await|throw|typeof|else|do)\b)([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\("),
    "rs": re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+([A-Za-z_]\w*)"),
}
_TYPES = {"js": re.compile(r"\bclass\b"), "rs": re.compile(r"\b(?:impl|trait)\b")}
_BLOCK_HEADS = re.compile(r"\s*(?:\}\s*)?(?:'\w+:\s*)?(?:if|for|while|try|match|switch|select|loop|with|do)\b")

Span = tuple[int, int, str, str]


def python_spans(text: str) -> list[Span] | None:
    """(first line, last line, type, symbol) of the structure of a Python file; None if it does not parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return None
    out: list[Span] = []
    imports: list[tuple[int, int]] = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out += _function_spans(node)
        elif isinstance(node, ast.ClassDef):
            out += _class_spans(node)
        elif isinstance(node, ast.Import | ast.ImportFrom):
            imports.append((node.lineno, node.end_lineno))
    out += [(a, b, "imports", "") for a, b in grouped(imports, GAP)]
    return out


def _start(node) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def _function_spans(node) -> list[Span]:
    first, last = _start(node), node.end_lineno
    if last - first + 1 <= LARGE:
        return [(first, last, "function", node.name)]
    cuts = [first]
    for part in node.body:
        if isinstance(part, _BLOCKS) and part.lineno - cuts[-1] > APART:
            cuts.append(part.lineno)
    ends = [c - 1 for c in cuts[1:]] + [last]
    return [(a, b, "function", f"{node.name}_part{i + 1}" if len(cuts) > 1 else node.name) for i, (a, b) in enumerate(zip(cuts, ends, strict=True))]


def _class_spans(node: ast.ClassDef) -> list[Span]:
    out: list[Span] = []
    at = _start(node)
    for part in node.body:
        if isinstance(part, ast.FunctionDef | ast.AsyncFunctionDef):
            if _start(part) > at:
                out.append((at, _start(part) - 1, "class_header", node.name))
            out += _function_spans(part)
            at = part.end_lineno + 1
    if at <= node.end_lineno:
        out.append((at, node.end_lineno, "class_header", node.name))
    return out


def grouped(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Spans joined where at most ``gap`` lines lie between the starts and the end before."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def brace_spans(lines: list[str], family: str) -> list[Span]:
    """Top-level definitions by their heads and the balance of braces."""
    out: list[Span] = []
    imports: list[tuple[int, int]] = []
    depth, opened, name, i = 0, 0, "", 0
    block = False
    before = [0] * (len(lines) + 2)  # braces open before each line
    for i, line in enumerate(lines, 1):
        before[i] = depth
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|`[^`]*`|//.*", "", line)
        if not depth:
            if _HEADS[family].match(line):
                found = _NAME.search(line)
                opened, name = i, found.group(1) if found else ""
            elif _IMPORTS[family].match(line) and (block or not line.startswith((")", " ", "\t"))):
                imports.append((i, i))
                block = line.rstrip().endswith("(") or block and not line.startswith(")")
        depth += bare.count("{") + bare.count("(") * (family == "go" and block) - bare.count("}") - bare.count(")") * (family == "go" and block) if not block else 0
        depth = max(depth, 0)
        if opened and not depth and ("{" in bare or "}" in bare or bare.rstrip().endswith(";")):
            before[i + 1] = 0
            head = lines[opened - 1]
            if re.search(r"\b(?:func|fn|function)\b|=>", head):
                out += _cut_function(opened, i, name, before, lines, 1)
            elif family in _TYPES and _TYPES[family].search(head):
                out += _cut_type(opened, i, name, before, lines, family)
            else:
                out.append((opened, i, "class_header", name))
            opened = 0
    return out + [(a, b, "imports", "") for a, b in grouped(imports, GAP)]


def _cut_function(first: int, last: int, name: str, before: list[int], lines: list[str], depth: int) -> list[Span]:
    """A function, in parts if it is large: cut where a block begins in its body, more than ten lines after the last cut."""
    cuts = [first]
    if last - first + 1 > LARGE:
        for i in range(first + 1, last + 1):
            if before[i] == depth and i - cuts[-1] > APART and _BLOCK_HEADS.match(lines[i - 1]) and not lines[i - 1].lstrip().startswith("}"):
                cuts.append(i)
    ends = [c - 1 for c in cuts[1:]] + [last]
    return [(a, b, "function", f"{name}_part{n + 1}" if len(cuts) > 1 else name) for n, (a, b) in enumerate(zip(cuts, ends, strict=True))]


def _cut_type(first: int, last: int, name: str, before: list[int], lines: list[str], family: str) -> list[Span]:
    """A class, impl or trait: its methods, and as headers what lies between them."""
    out: list[Span] = []
    at, i = first, first + 1
    while i < last:
        head = _METHODS[family].match(lines[i - 1]) if before[i] == 1 else None
        end = i
        while head and end <= last and before[end + 1] > 1:
            end += 1
        # a method has a body: on its line, or up to where the braces close
        if head is None or "{" not in "".join(lines[i - 1 : end]):
            i += 1
            continue
        if i > at:
            out.append((at, i - 1, "class_header", name))
        out += _cut_function(i, end, head.group(1), before, lines, 2)
        at = i = end + 1
    if at <= last:
        out.append((at, last, "class_header", name))
    return out


def file_spans(text: str, extension: str) -> list[Span]:
    """The chunks of a file: structure first, then runs of at most 30 lines of what is left."""
    lines = text.split("\n")
    family = {"py": "py", "go": "go", "rs": "rs", "js": "js", "jsx": "js", "ts": "js", "tsx": "js"}.get(extension)
    if family is None:
        return [(1, len(lines), "unknown", "")]
    spans = python_spans(text) if family == "py" else brace_spans(lines, family)
    spans = spans or []
    covered = [False] * (len(lines) + 2)
    for a, b, _, _ in spans:
        for i in range(a, min(b, len(lines)) + 1):
            covered[i] = True
    start = None
    for i in range(1, len(lines) + 2):
        free = i <= len(lines) and not covered[i]
        if free and start is None and lines[i - 1].strip():
            start = i
        if start is not None and (not free or i - start >= RUN):
            end = i - 1
            while end > start and not lines[end - 1].strip():
                end -= 1
            spans.append((start, end, "top_level", ""))
            start = i if free and lines[i - 1].strip() else None
    return sorted(spans)


_CALL = re.compile(r"(?<!\bdef )(?<!\bclass )\b([A-Za-z_]\w*)\(")
_IMPORT = re.compile(r"\s*(?:from\s+(\.*[\w.]*)\s+import\b|import\s+([\w.]+))")
_PART = re.compile(r"_part(\d+)$")


def file_symbols(text: str, extension: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(line, name) of each call and (line, module) of each import of a file; of a Python file that does not parse, by the look of its lines."""
    if extension in braces.FAMILIES:
        return braces.symbols(text, extension)
    if extension != "py":
        return [], []
    calls: list[tuple[int, str]] = []
    imports: list[tuple[int, str]] = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            for i, line in enumerate(text.split("\n"), 1):
                if not line.lstrip().startswith("#"):
                    calls += [(i, name) for name in _CALL.findall(line) if not keyword.iskeyword(name)]
                    imports += [(i, m.group(1) or m.group(2)) for m in [_IMPORT.match(line)] if m]
            return calls, imports
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            calls.append((node.func.end_lineno, node.func.id if isinstance(node.func, ast.Name) else node.func.attr))
        elif isinstance(node, ast.Import):
            imports += [(node.lineno, name.name) for name in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append((node.lineno, "." * node.level + (node.module or "")))
    return sorted(calls, key=lambda c: c[0]), sorted(imports, key=lambda c: c[0])


def _within(found: list[tuple[int, str]], first: int, last: int) -> list[str]:
    a, b = bisect.bisect_left(found, first, key=lambda c: c[0]), bisect.bisect_right(found, last, key=lambda c: c[0])
    return list(dict.fromkeys(name for _, name in found[a:b]))


def _chunk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, path, text in zip(batch["repo_name"], batch["file_path"], batch["text"], strict=True):
            lines, extension = text.split("\n"), path.rsplit(".", 1)[-1].lower()
            calls, imports = file_symbols(text, extension)
            spans = file_spans(text, extension)
            names = {span[3] for span in spans}
            for n, (a, b, kind, name) in enumerate(spans):
                part = _PART.search(name)
                part = part if part and f"{name[: part.start()]}_part1" in names else None
                defined = [] if not name or part and part.group(1) != "1" else [name[: part.start()] if part else name]
                rows.append((repo, path, n, kind, a, b, name, "\n".join(lines[a - 1 : b]), defined, _within(calls, a, b), _within(imports, a, b)))
        yield pd.DataFrame(rows, columns=["repo_name", "file_path", "chunk_index", "chunk_type", "start_line", "end_line", "symbol", "content", "symbols_defined", "symbols_called", "imports"])


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of (repo_name, file_path, text) with their lines, symbols and SHA-256; calls and imports are those of the chunk's lines."""
    return files.where("text IS NOT NULL").select("repo_name", "file_path", "text").mapInPandas(_chunk_batches, SPANS).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension, ast.IfExp, ast.match_case)


_DEF = re.compile(r"([ \t]*)(?:async[ \t]+)?def[ \t]+\w+")
_TRIPLE = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''")
_REPAIRS = 8


def function_metrics(text: str, extension: str = "py") -> list[tuple[str, int, int, int, int, int, list[str]]]:
    """(name, line, end, parameters, complexity, nesting, calls) of each function of a file."""
    if extension != "py":
        return braces.function_metrics(text, extension)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return _tree_metrics(ast.parse(text), 0)
        except (SyntaxError, ValueError, RecursionError):
            return _metrics_of_parts(text)


def _metrics_of_parts(text: str) -> list[tuple[str, int, int, int, int, int, list[str]]]:
    """The functions of a Python file that does not parse: each outermost one by itself, lines in error passed over."""
    lines = text.replace("\0", " ").split("\n")
    heads = _TRIPLE.sub(lambda m: re.sub(r"[^\n]", "#", m.group()), "\n".join(lines)).split("\n")
    out, i = [], 0
    while i < len(lines):
        m = _DEF.match(heads[i])
        if m is None:
            i += 1
            continue
        indent, end = len(m.group(1).expandtabs()), i + 1
        while end < len(lines) and (not heads[end].strip() or heads[end].lstrip()[0] in "#)" or len(heads[end].expandtabs()) - len(heads[end].expandtabs().lstrip()) > indent):
            end += 1
        part = textwrap.dedent("\n".join(line.expandtabs() for line in lines[i:end])).split("\n")
        for _ in range(_REPAIRS):
            try:
                out += _tree_metrics(ast.parse("\n".join(part)), i)
                break
            except SyntaxError as error:
                at = min(max((error.lineno or 1) - 1, 0), len(part) - 1)
                if not at or part[at].strip() == "pass":
                    at = next((k for k in range(len(part) - 1, 0, -1) if part[k].strip() not in ("", "pass")), 0)
                if not at:
                    break
                part[at] = " " * (len(part[at]) - len(part[at].lstrip())) + "pass"
            except (ValueError, RecursionError):
                break
        i = end
    return out


def _tree_metrics(tree: ast.AST, above: int) -> list[tuple[str, int, int, int, int, int, list[str]]]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            inside = list(ast.walk(node))
            branches = sum(isinstance(n, _BRANCHES) for n in inside) + sum(len(n.values) - 1 for n in inside if isinstance(n, ast.BoolOp))
            names = [n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in inside if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute)]
            args = node.args
            params = len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg)
            out.append((node.name, above + node.lineno, above + node.end_lineno, params, 1 + branches, _nesting(node), list(dict.fromkeys(names))))
    return out


def _nesting(node, depth: int = 0) -> int:
    deepest = depth
    for child in ast.iter_child_nodes(node):
        deepest = max(deepest, _nesting(child, depth + isinstance(child, _BLOCKS)))
    return deepest


def _metric_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(repo, path, *m) for repo, path, text in zip(batch["repo_name"], batch["file_path"], batch["text"], strict=True) for m in function_metrics(text, path.rsplit(".", 1)[-1].lower())]
        yield pd.DataFrame(rows, columns=["repo_name", "file_path", "name", "line", "end_line", "params", "complexity", "nesting", "calls"])


def measure_functions(files: DataFrame) -> DataFrame:
    """Measures of the functions of all seven extensions."""
    extension = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(F.col("text").isNotNull() & extension.isin("py", *braces.FAMILIES)).select("repo_name", "file_path", "text").mapInPandas(_metric_batches, METRICS)
