"""Lexers for JavaScript, TypeScript, Go and Rust, with states that carry over from chunk to chunk.

A token is its kind: the text of a keyword or mark, or one of ``id num str
tpl re life``.  A lexer state names what is still open at the end of a text:
``code``, a block comment, a template or a raw or multi-line string.

A template or a JSX element is one operand; the tokens of its containers, ``${}``
and ``{}``, are kept beside it, with balanced brackets, for the grammar.
"""

from __future__ import annotations

import re


class Malformed(Exception):
    """The text cannot be part of a well-formed program."""


CODE = "code"
IDENT = r"[^\W\d][\w$]*|\$[\w$]*"
SPACE = r"[ \t\r\f\v\ufeff\u00a0]*"

# Keywords and marks of the languages.
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield await async of get set static as from type interface enum declare namespace module abstract public private protected readonly implements is keyof satisfies infer null true false unique asserts override accessor".split()
)
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
RUST_WORDS = frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while true false union".split())
JS_MARKS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #"
GO_MARKS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ = : ."
RUST_MARKS = "<<= >>= ... ..= :: -> => && || == != <= >= += -= *= /= %= ^= &= |= << >> .. { } ( ) [ ] ; , < > + - * / % & | ^ ! ? = : . @ # $ ~"


def _alternatives(marks: str) -> str:
    return "|".join(re.escape(m) for m in sorted(marks.split(), key=len, reverse=True))


_COMMENTS = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_C_STRING = r'"(?:\\(?:\r\n|[\s\S])|[^"\\\n])*"'
_JS = re.compile(
    SPACE + r"(?:(\n\s*)|(" + IDENT + r")|((?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?)|(" + _C_STRING + r"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*')|(" + _COMMENTS + r")|(`)|(" + _alternatives(JS_MARKS) + r"))"
)
_GO = re.compile(
    SPACE + r"(?:(\n\s*)|([^\W\d]\w*)|((?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)|(" + _C_STRING + r"|'(?:\\[^\n][^'\n]*|[^'\\\n])'|`[^`]*`)|(" + _COMMENTS + r")|()(?!)|(" + _alternatives(GO_MARKS) + r"))"
)
_RUST = re.compile(
    SPACE
    + r"(?:(\n\s*)|(?![bc]?r#*\"|[bc][\"'])((?:r#)?[^\W\d]\w*)|((?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?)"
    + r"|([bc]?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\(?:[^u\n]|u\{[\da-fA-F_]+\}|x[\da-fA-F]{2})|[^'\\\n])')|("
    + _COMMENTS
    + r")|([bc]?r#*\"|'[^\W\d]\w*)|("
    + _alternatives(RUST_MARKS)
    + r"))"
)
_REGEX = re.compile(r"/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_WORDLIKE = re.compile(r"[\w$]")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)", re.M)

_ENDS_OPERAND = frozenset(["id", "num", "str", "tpl", "re", ")", "]", "}", "this", "super", "null", "true", "false"])
_GO_ENDS = frozenset(["id", "num", "str", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {v: k for k, v in OPEN.items()}


class Tokens:
    """Kinds, whether a line ends before each, the state at the end of the text, and (tokens, role) of each container within."""

    __slots__ = ("kinds", "breaks", "state", "match", "embedded", "failed")

    def __init__(self):
        self.kinds: list[str] = []
        self.breaks: list[bool] = []
        self.state = CODE
        self.match: dict[int, int] = {}
        self.embedded: list[tuple[Tokens, str]] = []
        self.failed: set[int] = set()  # where no element begins, so that nested ones are tried once


def lex(text: str, lang: str, state: str = CODE) -> Tokens:
    """The tokens of ``text``, read from ``state``; raises Malformed at what no program holds."""
    out = Tokens()
    at = 0
    if state != CODE:
        at = leave(text, state)
        if at < 0:
            out.state = state
            return out
    if lang in ("js", "jsx", "ts", "tsx"):
        _lex_js(text, at, len(text), out, lang in ("jsx", "tsx", "js"), None)
    elif lang == "go":
        _lex_plain(text, at, out, _GO, GO_WORDS, True)
    else:
        _lex_plain(text, at, out, _RUST, RUST_WORDS, False)
    return out


def leave(text: str, state: str) -> int:
    """Where ``state`` ends in ``text``, or -1 if it holds on: the lexer-state map for one entry."""
    if state == "comment":
        found, width = text.find("*/"), 2
    elif state == "template":
        m = _TEMPLATE.match(text)
        found, width = (m.end(), 1) if m.end() < len(text) and text[m.end()] == "`" else (-1, 0)
    elif state == "goraw":
        found, width = text.find("`"), 1
    elif state == "string":
        m = re.compile(r"(?:\\[\s\S]|[^\"\\])*\"").match(text)
        found, width = (m.end() - 1, 1) if m else (-1, 0)
    else:  # raw"## of Rust
        end = '"' + "#" * state.count("#")
        found, width = text.find(end), len(end)
    return -1 if found < 0 else found + width


def _lex_plain(text: str, at: int, out: Tokens, pattern: re.Pattern, words: frozenset, semicolons: bool) -> None:
    kinds, breaks, match = out.kinds, out.breaks, pattern.match
    size, fresh = len(text), False
    while at < size:
        m = match(text, at)
        if m is None:
            rest = text[at:].lstrip(" \t\r\f\v\ufeff\u00a0")
            if not rest:
                return
            if rest.startswith("/*"):
                out.state = "comment"
                return
            if semicolons and rest[0] == "`":
                out.state = "goraw"
                return
            if not semicolons and rest[0] == '"':
                out.state = "string"
                return
            raise Malformed(f"unexpected {rest[:12]!r}")
        group, at = m.lastindex, m.end()
        if group == 1:
            fresh = True
            if semicolons and kinds and kinds[-1] in _GO_ENDS:
                kinds.append(";")
                breaks.append(False)
            continue
        if group == 2:
            word = m.group(2)
            kinds.append(word if word in words else "id")
        elif group == 3:
            if at < size and _WORDLIKE.match(text, at):
                raise Malformed("number runs into a word")
            kinds.append("num")
        elif group == 4:
            kinds.append("str")
        elif group == 5:
            if "\n" in m.group(5):
                fresh = True
                if semicolons and kinds and kinds[-1] in _GO_ENDS:
                    kinds.append(";")
                    breaks.append(False)
            continue
        elif group == 6:
            mark = m.group(6)
            if mark[0] == "'":
                kinds.append("life")
            else:
                end = text.find('"' + "#" * mark.count("#"), at)
                if end < 0:
                    out.state = 'raw"' + "#" * mark.count("#")
                    return
                at = end + 1 + mark.count("#")
                kinds.append("str")
        else:
            kinds.append(m.group(7))
        breaks.append(fresh)
        fresh = False


def _lex_js(text: str, at: int, size: int, out: Tokens, jsx: bool, until: str | None) -> int:
    """Reads up to ``size``, or, with ``until``, to the brace that closes what the caller opened."""
    kinds, breaks, match = out.kinds, out.breaks, _JS.match
    fresh, depth = False, 0
    if at == 0 and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else size
    while at < size:
        m = match(text, at)
        if m is None:
            rest = text[at:].lstrip(" \t\r\f\v\ufeff\u00a0")
            if not rest:
                break
            if rest.startswith("/*"):
                out.state = "comment"
                return size
            raise Malformed(f"unexpected {rest[:12]!r}")
        group = m.lastindex
        if group == 7:
            mark = m.group(7)
            if mark[0] == "/" and not (kinds and kinds[-1] in _ENDS_OPERAND):
                start = m.start(7)
                r = _REGEX.match(text, start)
                if r is None:
                    raise Malformed("stray slash")
                at = r.end()
                kinds.append("re")
                breaks.append(fresh)
                fresh = False
                continue
            if jsx and mark == "<" and not (kinds and kinds[-1] in _ENDS_OPERAND) and m.start(7) not in out.failed and _ELEMENT.match(text, m.start(7)):
                kept = len(out.embedded)
                try:
                    end = _jsx_element(text, m.start(7), size, out)
                except Malformed:
                    end = -1
                if end < 0:  # type parameters, or an element that no grammar accepts as operators
                    del out.embedded[kept:]
                    out.failed.add(m.start(7))
                else:
                    at = end
                    kinds.append("str")
                    breaks.append(fresh)
                    fresh = False
                    continue
            if until is not None:
                if mark == "{":
                    depth += 1
                elif mark == "}":
                    if not depth:
                        return m.end()
                    depth -= 1
            kinds.append(mark)
        elif group == 1:
            fresh = True
            at = m.end()
            continue
        elif group == 2:
            word = m.group(2)
            kinds.append(word if word in JS_WORDS else "id")
        elif group == 3:
            if m.end() < size and _WORDLIKE.match(text, m.end()):
                raise Malformed("number runs into a word")
            kinds.append("num")
        elif group == 4:
            kinds.append("str")
        elif group == 5:
            fresh = fresh or "\n" in m.group(5)
            at = m.end()
            continue
        else:
            at = _template(text, m.end(), size, out, jsx)
            if at < 0:
                out.state = "template"
                return size
            kinds.append("tpl")
            breaks.append(fresh)
            fresh = False
            continue
        at = m.end()
        breaks.append(fresh)
        fresh = False
    if until is not None:
        raise Malformed("embedded expression without end")
    return at


def _container(text: str, at: int, size: int, out: Tokens, jsx: bool, role: str) -> int:
    """The end of the container whose opening brace ends at ``at``; -1 if a comment or template in it stays open."""
    inner = Tokens()
    inner.failed = out.failed
    at = _lex_js(text, at, size, inner, jsx, "}")
    if inner.state != CODE:
        return -1
    if bracket_summary(inner.kinds, inner.match) != ("", ""):
        raise Malformed("brackets in an embedded expression")
    out.embedded.append((inner, role))
    return at


def _template(text: str, at: int, size: int, out: Tokens, jsx: bool) -> int:
    """The end of a template whose opening mark ends at ``at``; -1 if it stays open."""
    while True:
        at = _TEMPLATE.match(text, at).end()
        if at >= size:
            return -1
        if text[at] == "`":
            return at + 1
        at = _container(text, at + 2, size, out, jsx, "value")
        if at < 0:
            return -1


_ELEMENT = re.compile(r"<(?:>|[A-Za-z_$][\w.:$-]*[\s/><])")
_TAG = re.compile(r"<\s*(?:([A-Za-z_$][\w.:$-]*)(?:<[^<>(){}]*(?:<[^<>(){}]*>[^<>(){}]*)*>)?)?\s*")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w:.$-]*\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|(\{)|(?=<))|(?=[\s/>A-Za-z_${]))")
_TEXT = re.compile(r"[^{}<>]*")
_CLOSING = re.compile(r"<\s*/\s*([\w.:$-]*)\s*>")
_BLANK = re.compile(r"(?:\s|/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*)*")


def _jsx_element(text: str, at: int, size: int, out: Tokens) -> int:
    """The end of the element that begins at ``at``, or -1 if it is none."""
    m = _TAG.match(text, at)
    name, at = m.group(1) or "", _BLANK.match(text, m.end()).end()
    while at < size and text[at] not in "/>":
        if not name:
            return -1
        if text[at] == "{":
            at = _container(text, at + 1, size, out, True, "spread")
        else:
            a = _ATTRIBUTE.match(text, at)
            if a is None:
                return -1
            at = a.end()
            if a.group(1):
                at = _container(text, at, size, out, True, "value")
            elif at < size and text[at] == "<":
                at = _jsx_element(text, at, size, out)
        if at < 0:
            return -1
        at = _BLANK.match(text, at).end()
    if text.startswith("/", at):
        end = re.compile(r"/\s*>").match(text, at)
        return end.end() if end and name else -1
    at += 1
    while (at := _TEXT.match(text, at).end()) < size:
        end = _CLOSING.match(text, at)
        if end:
            return end.end() if end.group(1) == name else -1
        if text[at] == "{":
            at = _container(text, at + 1, size, out, True, "child")
        elif text[at] == "<":
            at = _jsx_element(text, at, size, out)
        else:
            return -1
        if at < 0:
            return -1
    return -1


def bracket_summary(kinds: list[str], match: dict[int, int] | None = None) -> tuple[str, str]:
    """(closers that were opened before, openers left open), or Malformed if brackets cross."""
    stack: list[int] = []
    closers = []
    for i, kind in enumerate(kinds):
        if kind in OPEN:
            stack.append(i)
        elif kind in CLOSE:
            if stack:
                j = stack.pop()
                if kinds[j] != CLOSE[kind]:
                    raise Malformed(f"{kinds[j]} closed by {kind}")
                if match is not None:
                    match[j] = i
            else:
                closers.append(kind)
    return "".join(closers), "".join(kinds[i] for i in stack)


def join_brackets(one: tuple[str, str], other: tuple[str, str]) -> tuple[str, str]:
    """The summary of two texts in a row; associative."""
    (closers, openers), (more_closers, more_openers) = one, other
    m = min(len(openers), len(more_closers))
    for a, b in zip(reversed(openers[len(openers) - m :]), more_closers[:m], strict=True):
        if OPEN[a] != b:
            raise Malformed(f"{a} closed by {b}")
    return closers + more_closers[m:], openers[: len(openers) - m] + more_openers
