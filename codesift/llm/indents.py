"""Lexer-state maps, bracket summaries and indentation summaries of Python text.

States: ``code``, the two triple-quoted strings and their formatted forms.
``unsure`` stands where the text alone does not tell (a cut inside a field of
a formatted string); the whole file tells then.

An indentation summary of a run of statements is (asks, levels): the columns
that must be open before it, in falling order, and the columns open at its
end.  Summaries of neighbours compose, and composition is associative.
"""

from __future__ import annotations

import ast
import re
import warnings

from codesift.llm.lexing import CODE, Malformed

UNSURE = "unsure"
QUOTES = ("'''", '"""')
STATES = (*QUOTES, *("f" + q for q in QUOTES))

_MARK = re.compile(r"#[^\n]*|(?:(?<!\w)([fF][rR]?|[rR][fF]))?('''|\"\"\"|'|\")|[()\[\]{}]")
_FIELD = re.compile(r"#[^\n]*|(?:(?<!\w)([fF][rR]?|[rR][fF]))?('''|\"\"\"|'|\")|[()\[\]{}:]")
_ENDS = {
    "'": re.compile(r"(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'"),
    '"': re.compile(r"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\""),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    '"""': re.compile(r"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\""),
}
_LITERAL = re.compile(r"\\N\{[^{}\n]*\}|\\[\s\S]|\{\{|\}\}|[{}'\"\n]|[^\\{}'\"\n]+")


class Lost(Exception):
    """The text does not tell by itself."""


def scan(text: str, state: str = CODE) -> tuple[str, list[str]]:
    """(state at the end, brackets of the code) of text read from ``state``; Malformed for a string that ends with its line, Lost where unsure."""
    brackets: list[str] = []
    at, size = 0, len(text)
    if state != CODE:
        at = _leave(text, state)
        if at < 0:
            return state, brackets
    while at < size:
        m = _MARK.search(text, at)
        if m is None:
            break
        at, quote = m.end(), m.group(2)
        if quote is None:
            if text[m.start()] != "#":
                brackets.append(m.group())
        elif m.group(1) is None:
            end = _ENDS[quote].match(text, at)
            if end is None:
                if len(quote) == 1:
                    raise Malformed("string without end")
                return quote, brackets
            at = end.end()
        else:
            end = _formatted(text, at, quote)
            if end < 0:
                return "f" + quote, brackets
            at = end
    return CODE, brackets


def _leave(text: str, state: str) -> int:
    if state[0] == "f":
        return _formatted(text, 0, state[1:])
    end = _ENDS[state].match(text)
    return end.end() if end else -1


def _formatted(text: str, at: int, quote: str) -> int:
    """The end of a formatted string whose text goes on at ``at``; -1 if it stays open."""
    size = len(text)
    while at < size:
        m = _LITERAL.match(text, at)
        if m is None:
            raise Lost
        piece = m.group()
        if piece[0] in "'\"" and text.startswith(quote, at):
            return at + len(quote)
        if piece == "\n" and len(quote) == 1 or piece == "}":
            raise Lost
        at = _field(text, m.end(), quote) if piece == "{" else m.end()
    if len(quote) == 1:
        raise Lost
    return -1


def _field(text: str, at: int, quote: str) -> int:
    """The end of a field whose opening brace ends at ``at``."""
    depth = 0
    while (m := _FIELD.search(text, at)) is not None:
        at, mark = m.end(), m.group()
        if m.group(2) is not None:
            inner = _formatted(text, at, m.group(2)) if m.group(1) else (end.end() if (end := _ENDS[m.group(2)].match(text, at)) else -1)
            if inner < 0:
                raise Lost
            at = inner
        elif mark in "([{":
            depth += 1
        elif mark in ")]}" and depth:
            depth -= 1
        elif mark == "}":
            return at
        elif mark == ":" and not depth:
            return _format(text, at, quote)
        elif mark in ")]":
            raise Lost
    raise Lost


def _format(text: str, at: int, quote: str) -> int:
    """The end of a field whose format begins at ``at``."""
    while at < len(text):
        if text[at] == "{":
            at = _field(text, at + 1, quote)
        elif text[at] == "}":
            return at + 1
        elif text[at] in "'\"\n\\":
            raise Lost
        else:
            at += 1
    raise Lost


def parses(text: str) -> bool:
    """Whether the interpreter's own parser accepts the text.

    Its stack has a fixed size: what is nested beyond it, without an error up to there, counts as well-formed.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError):
            return True
    return True


_FIRST = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*([ \t\f]*)(?=[^ \t\f\r\n#])")
_TABBED = re.compile(r"(?m)^ *[\t\f]")


def statements(text: str) -> tuple[list[int], list[int]] | None:
    """The indentation summary of a run of whole statements, or None if the text is none."""
    first = _FIRST.match(text)
    if first is None or not text.strip():
        return ([], []) if parses(text) else None
    inner = first.group(1)
    if "\t" in inner or "\f" in inner:
        return None
    column = len(inner)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse("if 1:\n" + text if column else text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
    body = tree.body
    asks = [column]
    if column:
        if len(body) == 1:
            body = body[0].body
            if body[0].col_offset != column:
                return None
        else:
            asks.append(0)
            body = body[1:]
    if _TABBED.search(text):
        return asks, [asks[-1]]
    lines = (("if 1:\n" if column else "") + text).split("\n")
    return asks, [asks[-1], *_open_levels(body[-1], lines)]


def _open_levels(node: ast.stmt, lines: list[str]) -> list[int]:
    """The columns of the blocks that are open after a statement."""
    levels = []
    while True:
        block = getattr(node, "finalbody", None) or getattr(node, "orelse", None)
        if not isinstance(block, list) or not block:
            inner = getattr(node, "handlers", None) or getattr(node, "cases", None)
            block = inner[-1].body if inner else getattr(node, "body", None)
        if not isinstance(block, list) or not block or not isinstance(block[0], ast.stmt):
            return levels
        head = block[0]
        if lines[head.lineno - 1][: head.col_offset].strip(" "):
            return levels
        levels.append(head.col_offset)
        node = block[-1]


def join_indents(one: tuple[list[int], list[int]] | None, other: tuple[list[int], list[int]] | None) -> tuple[list[int], list[int]] | None:
    """The summary of two runs in a row; None if the second does not fit, or either is None.  Associative."""
    if one is None or other is None:
        return None
    if not one[0]:
        return other
    asks, levels = list(one[0]), list(one[1])
    for column in other[0]:
        if column in levels:
            del levels[levels.index(column) + 1 :]
        elif column < levels[0]:
            asks.append(column)
            levels = [column]
        else:
            return None
    return asks, levels + list(other[1][1:])

