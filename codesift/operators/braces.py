"""Measures of functions in JavaScript, TypeScript, Go and Rust, from tokens and the balance of brackets.

Text that is no program is read on: a bracket without partner is passed over,
so one error costs no function elsewhere in the file.  A function has a name:
declarations, methods, and in JavaScript functions bound to a variable or a
field; what is anonymous counts for the function around it.
"""

from __future__ import annotations

import re

FAMILIES = {"js": "js", "jsx": "js", "ts": "js", "tsx": "js", "go": "go", "rs": "rs"}
Metric = tuple[str, int, int, int, int, int, list[str]]

_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_NUMBER = r"\d[\w]*(?:\.\d[\w]*)?(?:(?<=[eE])[+-]\d+)?"
_MARK = r"=>|->|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\.\.\.|::|:=|<-|===|!==|==|!=|<=|>=|[^\s]"
_DOUBLE = r'"(?:\\[\s\S]|[^"\\\n])*"'
_LEXERS = {
    "js": re.compile(rf"({_COMMENT})|(#?[^\W\d][\w$]*|\$[\w$]*)|({_NUMBER})|({_DOUBLE}|'(?:\\[\s\S]|[^'\\\n])*')|({_MARK})"),
    "go": re.compile(rf"({_COMMENT})|([^\W\d]\w*)|({_NUMBER})|({_DOUBLE}|'(?:\\[^\n][^'\n]*|[^'\\\n])'|`[^`]*`)|({_MARK})"),
    "rs": re.compile(rf"({_COMMENT})|(?![bc]?r#*\"|[bc][\"'])((?:r#)?[^\W\d]\w*)|({_NUMBER})|([bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\(?:u\{{[^}}]*\}}|x..|.)|[^'\\\n])')|('[^\W\d]\w*|{_MARK})"),
}
_SPACE = re.compile(r"\s*")
_REGEX = re.compile(r"/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_ELEMENT = re.compile(r"<(?:>|[A-Za-z][\w.:-]*(?:\s(?!\s*extends\b)|[/>]))")
_TAG, _CLOSING = re.compile(r"<([A-Za-z][\w.:-]*)?\s*"), re.compile(r"</\s*([\w.:-]*)\s*>")
_ATTRIBUTE = re.compile(r"[A-Za-z_][\w:.-]*\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|(?=[{<])))?")

# Words after which no operand has ended, that open a block, or that branch.
_WORDS = {
    "js": frozenset("await break case catch class const continue debugger default delete do else export extends finally for function if in instanceof let new of return switch throw try typeof var void while with yield".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "rs": frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while".split()),
}
_BLOCKS = {"js": frozenset(("if", "for", "while", "do", "try", "switch")), "go": frozenset(("if", "for", "switch", "select")), "rs": frozenset(("if", "for", "while", "loop", "match"))}
_BRANCHES = {"js": frozenset(("if", "for", "while", "case", "catch")), "go": frozenset(("if", "for", "case")), "rs": frozenset(("if", "for", "while", "=>"))}
_MODIFIERS = frozenset("async get set static public private protected readonly override *".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def _is_word(t: str) -> bool:
    return t[:1].isalpha() or t[:1] in "_$" or t[:1] == "#" and len(t) > 1


class Source:
    """Tokens with their lines; strings, numbers and regexes are one token each, a template or element is one before its containers in ( )."""

    def __init__(self, text: str, extension: str):
        self.text, self.family, self.jsx = text, FAMILIES[extension], extension != "ts"
        self.t: list[str] = []
        self.at: list[int] = []
        self._lex(0, False)
        # Line numbers, the last line of a token that spans several included.
        self.line, self.last, line, seen = [], [], 1, 0
        for t, at in zip(self.t, self.at, strict=True):
            line, seen = line + text.count("\n", seen, at), at
            self.line.append(line)
            self.last.append(line + t.count("\n"))
        self.pair, self.around = self._pairs()
        self.t += [""] * 3
        self.line += [line + 1] * 3

    def _add(self, t: str, at: int) -> None:
        self.t.append(t)
        self.at.append(at)

    def _ended(self) -> bool:
        """Whether an operand ends before this place."""
        if not self.t:
            return False
        t = self.t[-1]
        return t in (")", "]", "}") or t[0] in "\"'`0123456789" or len(t) > 1 and t[0] in "/<" and t[-1] not in "=-" or _is_word(t) and (t not in _WORDS[self.family] or len(self.t) > 1 and self.t[-2] in (".", "?."))

    def _lex(self, at: int, inner: bool) -> int:
        """Reads to the end, or with ``inner`` behind the brace that closes; -1 if there is none."""
        text, size, match, js, depth = self.text, len(self.text), _LEXERS[self.family].match, self.family == "js", 0
        while (at := _SPACE.match(text, at).end()) < size:
            m = match(text, at)
            group, start = m.lastindex, at
            t, at = m.group(), m.end()
            if group == 1:
                if self.family == "rs" and t[1] == "*":
                    at, open_ = start + 2, 1
                    while open_ and (n := re.compile(r"/\*|\*/").search(text, at)):
                        open_ += 1 if n.group() == "/*" else -1
                        at = n.end()
                    at = size if open_ else at
                continue
            if js and t == "/" and not self._ended() and (m := _REGEX.match(text, start)):
                t, at = m.group(), m.end()
            elif js and t == "`" or js and t == "<" and self.jsx and not self._ended() and _ELEMENT.match(text, start):
                kept = len(self.t)
                end = self._template(start) if t == "`" else self._element(start)
                if end > 0:
                    at = end
                    continue
                del self.t[kept:], self.at[kept:]
                if t == "`":
                    continue
            elif inner and t == "{":
                depth += 1
            elif inner and t == "}":
                if not depth:
                    return at
                depth -= 1
            if not (self.family == "rs" and t[0] == "'" and not t.endswith("'")):
                self._add(t, start)
        return -1 if inner else at

    def _container(self, at: int) -> int:
        """A container whose brace ends at ``at``."""
        self._add("(", at)
        at = self._lex(at, True)
        self._add(")", at - 1)
        return at

    def _template(self, at: int) -> int:
        self._add("``", at)
        at += 1
        while (at := _TEMPLATE.match(self.text, at).end()) < len(self.text):
            if self.text[at] == "`":
                return at + 1
            if self.text[at] != "$" or (at := self._container(at + 2)) < 0:
                return -1
        return -1

    def _element(self, at: int) -> int:
        text, size = self.text, len(self.text)
        self._add("''", at)
        m = _TAG.match(text, at)
        name, at = m.group(1) or "", m.end()
        while at < size and text[at] not in "/>":
            if text[at] == "{":
                at = self._container(at + 1)
            elif text[at] == "<":
                at = self._element(at)
            else:
                a = _ATTRIBUTE.match(text, at)
                at = a.end() if a else -1
            if at < 0:
                return -1
            at = _SPACE.match(text, at).end()
        if text.startswith("/>", at):
            return at + 2
        at += 1
        while (m := re.compile(r"[{<]").search(text, at)) is not None:
            at = m.start()
            if text.startswith("</", at):
                end = _CLOSING.match(text, at)
                return end.end() if end and end.group(1) == name else -1
            at = self._container(at + 1) if text[at] == "{" else self._element(at)
            if at < 0:
                return -1
        return -1

    def _pairs(self) -> tuple[dict[int, int], list[int]]:
        """The partner of each bracket that has one, and the open bracket around each token (-1: none)."""
        pair, around, stack = {}, [], []
        for i, t in enumerate(self.t):
            if t in _CLOSE:
                want = _CLOSE[t]
                if any(self.t[j] == want for j in stack[-4:]):
                    while self.t[j := stack.pop()] != want:
                        pass
                    pair[j], pair[i] = i, j
            around.append(stack[-1] if stack else -1)
            if t in _OPEN:
                stack.append(i)
        return pair, around + [-1] * 3

    # Steps over tokens; each gives the index behind what it reads.

    def over(self, i: int) -> int:
        """Behind the bracket at ``i`` and its partner."""
        return self.pair.get(i, i) + 1

    def angle(self, i: int) -> int:
        """Behind the ``<...>`` at ``i``, or ``i`` if there is none."""
        depth, j = 0, i
        while self.t[j] and self.t[j] not in (";", "}", ")", "]"):
            if self.t[j] == "<":
                depth += 1
            elif self.t[j] == ">":
                depth -= 1
                if not depth:
                    return j + 1
            j = self.over(j) if self.t[j] in _OPEN else j + 1
        return i

    def type_end(self, i: int) -> int:
        """Behind a TypeScript annotation that begins at ``i``."""
        while t := self.t[i]:
            before = self.t[i - 1]
            if t == "{" and before not in (":", "|", "&", "=>", "is", "extends", "?", "keyof", "readonly") or t in (";", ",", "=", ")", "}", "]"):
                return i
            if self.line[i] > self.line[i - 1] and _is_word(t) and (_is_word(before) or before in ("]", ">", "}", ")")):
                return i
            if t == "=>" and self.t[i + 1] == "{":
                return i
            j = self.angle(i) if t == "<" else self.over(i) if t in _OPEN else i + 1
            i = max(j, i + 1)
        return i

    def expression_end(self, i: int) -> int:
        """The last token of the expression or statement of JavaScript that begins at ``i``."""
        first = i
        while (t := self.t[i]) and t not in (";", ",", ")", "]", "}"):
            if i > first and self.line[i] > self.line[i - 1] and (_is_word(t) and t not in ("in", "instanceof", "of") or t[0] in "\"'0{@") and (_is_word(self.t[i - 1]) or self.t[i - 1][-1] in ")]}\"'`0123456789"):
                break
            i = self.over(i) if t in _OPEN else i + 1
        return i if t == ";" else max(i - 1, first)

    def block_end(self, i: int) -> int:
        """The last token of the block, or braceless statement, whose word stands at ``i``."""
        word, t = self.t[i], self.t
        j = i + 1
        if self.family == "js":
            if t[j] == "await":
                j += 1
            if t[j] == "(" and word != "do":
                j = self.over(j)
        else:
            pattern = word == "for" and self.family == "rs"
            while t[j] and t[j] not in ("}", ")", "]") and (t[j] != "{" or pattern):
                if t[j] == "let":
                    pattern = True
                elif t[j] in ("=", "in"):
                    pattern = False
                elif self.family == "go" and t[j] in ("struct", "interface") and t[j + 1] == "{":
                    j += 1
                    j = self.over(j)
                    continue
                j = self.over(j) if t[j] in _OPEN else j + 1
        end = self.statement_end(j)
        while True:
            after = t[end + 1]
            if word == "do" and after == "while":
                return self.over(end + 2) - 1
            if word == "if" and after == "else" or word == "try" and after == "finally":
                end = self.statement_end(end + 2)
                if word == "if":
                    return end
            elif word == "try" and after == "catch":
                end = self.statement_end(self.over(end + 2) if t[end + 2] == "(" else end + 2)
            else:
                return end

    def statement_end(self, i: int) -> int:
        if self.t[i] == "{":
            return self.over(i) - 1
        if self.t[i] in _BLOCKS[self.family]:
            return self.block_end(i)
        return self.expression_end(i) if self.family == "js" else i

    def count_params(self, i: int) -> int:
        """Parameters in the parentheses at ``i``."""
        end, n, filled, depth = self.pair.get(i, i), 0, False, 0
        i += 1
        while i < end:
            t = self.t[i]
            if t == "," and not depth:
                n, filled = n + filled, False
            else:
                filled = True
                depth = max(0, depth + (t == "<") - (t == ">"))
            i = self.over(i) if t in _OPEN else i + 1
        return n + filled

    # Functions: (index of the name, name, first token, index of the parameters or -1 for one name, last token).

    def functions(self) -> list[tuple[int, str, int, int, int]]:
        return sorted(getattr(self, f"_functions_{self.family}")(), key=lambda f: f[2])

    def _functions_go(self):
        t = self.t
        for i, word in enumerate(t):
            if word != "func":
                continue
            name = self.over(i + 1) if t[i + 1] == "(" and self.around[i] < 0 else i + 1
            if not _is_word(t[name]) or t[name] in _WORDS["go"]:
                continue
            params = self.over(name + 1) if t[name + 1] == "[" and name == i + 1 else name + 1
            if t[params] != "(":
                continue
            j = self.over(params)
            while t[j] and t[j] != "{" and self.line[j] == self.line[j - 1]:
                j = self.over(j + 1) if t[j] in ("struct", "interface") and t[j + 1] == "{" else self.over(j) if t[j] in _OPEN else j + 1
            yield name, t[name], i, params, (self.over(j) if t[j] == "{" and self.line[j] == self.line[j - 1] else j) - 1

    def _functions_rs(self):
        t = self.t
        for i, word in enumerate(t):
            if word != "fn" or not _is_word(t[i + 1]):
                continue
            params = self.angle(i + 2) if t[i + 2] == "<" else i + 2
            if t[params] != "(":
                continue
            j = self.over(params)
            while t[j] and t[j] not in ("{", ";", "}"):
                j = self.over(j) if t[j] in _OPEN else j + 1
            if t[j] == "{":
                yield i + 1, t[i + 1].removeprefix("r#"), i, params, self.over(j) - 1

    def _body(self, i: int) -> int:
        """The brace of the body behind parameters that end before ``i``; -1 if there is none."""
        j = self.type_end(i + 1) if self.t[i] == ":" else i
        return j if self.t[j] == "{" else -1

    def _value(self, name: int, i: int, first: int):
        """The function that is bound at ``i`` to the name."""
        t = self.t
        j = i + (t[i] == "async" and t[i + 1] not in ("=>", ","))
        if t[j] == "function":
            j += 1 + (t[j + 1] == "*")
            if _is_word(t[j]):
                return None  # has its own name
            params = self.angle(j) if t[j] == "<" else j
            body = self._body(self.over(params)) if t[params] == "(" else -1
            return (name, t[name], first, params, self.over(body) - 1) if body >= 0 else None
        params = self.angle(j) if t[j] == "<" else j
        if t[params] == "(":
            j = self.over(params)
            if t[j] == ":":
                j = self.type_end(j + 1)
        elif _is_word(t[params]):
            j, params = params + 1, -1
        if t[j] != "=>":
            return None
        return name, t[name], first, params, self.over(j + 1) - 1 if t[j + 1] == "{" else self.expression_end(j + 1)

    def _functions_js(self):
        t, classes = self.t, set()
        for i, word in enumerate(t):
            if word == "class" and t[i - 1 if i else -1] not in (".", "?."):
                j = i + 1
                while t[j] and t[j] not in ("{", ";", ")", "}"):
                    j = max(self.angle(j), j + 1) if t[j] == "<" else self.over(j) if t[j] in _OPEN else j + 1
                if t[j] == "{":
                    classes.add(j)
        for i, word in enumerate(t[:-3]):
            before = t[i - 1] if i else ""
            if word == "function" and before not in (".", "?."):
                name = i + 1 + (t[i + 1] == "*")
                params = self.angle(name + 1) if t[name + 1] == "<" else name + 1
                if _is_word(t[name]) and t[params] == "(" and (body := self._body(self.over(params))) >= 0:
                    yield name, t[name], i - (before == "async"), params, self.over(body) - 1
            elif word in ("const", "let", "var") and _is_word(t[i + 1]) and t[i + 2] == ":":
                at = self.type_end(i + 3)
                while t[at] == "=>":  # a function type whose result is a record
                    at = self.type_end(self.over(at + 1))
                if t[at] == "=" and (found := self._value(i + 1, at + 1, i)):
                    yield found
            elif _is_word(word) or word[0] in "\"'[":
                home = self.around[i]
                member = home in classes
                name, after = word, i + 1
                if word == "[":
                    after = self.over(i)
                    name = "".join(t[i:after])
                elif word[0] in "\"'":
                    name = word[1:-1]
                if not name or t[after] not in ("(", "<", "=", ":"):
                    continue
                if t[after] in ("=", ":"):
                    plain = t[after] == "=" and before not in ("type", ">") and (home < 0 or t[home] == "{") and _is_word(word)
                    at = self.type_end(after + 1) if member and t[after] == ":" else after
                    if t[at] == "=" and (plain or member) and (found := self._value(i, at + 1, i)):
                        yield found
                    continue
                k = i - 1
                while k >= 0 and t[k] in _MODIFIERS:
                    k -= 1
                opened = home >= 0 and t[home] == "{" and (k == home or t[k] == ",")
                params = self.angle(after) if t[after] == "<" else after
                if t[params] != "(" or word in _MODIFIERS and not (opened or member) or before in (".", "?.", "function", "new"):
                    continue
                if (member or opened and (word not in _WORDS["js"] or t[k] == ",")) and (body := self._body(self.over(params))) >= 0:
                    yield i, name, k + 1, params, self.over(body) - 1

    def calls(self, found: list[tuple[int, str, int, int, int]]) -> dict[int, str]:
        """The names that are called, by their token; ``found`` are the functions."""
        t, family, words, out = self.t, self.family, _WORDS[self.family], {}
        named, patterns = {f[0] for f in found}, self._patterns() if family == "rs" else set()
        for i, x in enumerate(t[:-3]):
            before = t[i - 1] if i else ""
            if _is_word(x) and i not in named and i not in patterns and (x not in words or before in (".", "?.")) and before not in ("new", "fn", "function", "func"):
                j = i + 1
                if family == "rs" and t[j] == "::" and t[j + 1] == "<":
                    j = self.angle(j + 1)
                elif family == "js" and t[j] == "<" and self.angle(j) > j:
                    j = self.angle(j)
                elif t[j] == "?." and t[j + 1] == "(":
                    j += 1
                lead = x == "async" and family == "js" and t[j] == "(" and t[self.over(j)] in ("=>", ":") or family == "rs" and x in ("Fn", "FnMut", "FnOnce")
                if (t[j] == "(" or t[j] == "``") and not lead:
                    out[i] = x.removeprefix("r#").removeprefix("#")
        return out

    def imports(self) -> list[tuple[int, str]]:
        """(line, module) of each import."""
        t, out = self.t, []
        for i, x in enumerate(t[:-3]):
            before, j = t[i - 1] if i else "", i + 1
            if self.family == "rs" and (x == "use" or x == "crate" and before == "extern"):
                while t[j] and t[j] != ";":
                    j += 1
                if t[j]:
                    out.append((self.line[i], " ".join(self.text[self.at[i + 1] : self.at[j]].split())))
            elif self.family == "go" and x == "import":
                end = self.over(j) if t[j] == "(" else j + 1 + (t[j][:1] not in ('"', "`"))
                out += [(self.line[k], t[k][1:-1]) for k in range(j, end) if t[k][:1] in ('"', "`") and t[k]]
            elif self.family == "js" and before not in (".", "?.") and (x == "import" and t[j] not in ("(", ".") or x == "require" and t[j] == "("):
                while t[j] and t[j] not in (";", "=", ")") and t[j][0] not in "\"'":
                    j += 1
                if t[j][:1] in ('"', "'") and len(t[j]) > 2:
                    out.append((self.line[i], t[j][1:-1]))
        return out

    def metrics(self) -> list[Metric]:
        t, family = self.t, self.family
        found = self.functions()
        named, calls = {f[0] for f in found}, self.calls(found)
        words, blocks, branches = _WORDS[family], _BLOCKS[family], _BRANCHES[family]
        branch, ends = [0] * len(t), {}
        for i, x in enumerate(t[:-3]):
            before, after = t[i - 1] if i else "", t[i + 1]
            key = before in (".", "?.") or family == "js" and after == ":" or i in named
            if x in ("&&", "||", "??"):
                branch[i] = family != "rs" or before in (")", "]", "}", "?") or _is_word(before) and before not in words or before[:1] in "\"'0123456789" and before != ""
            elif x == "?" and family == "js":
                branch[i] = after not in (":", ")", ",", "=", ";", "(", "]", "}") or after == "(" and self.at[i] > self.at[i - 1] + len(before)
            elif not key and not (x == "for" and family == "rs" and (_is_word(before) or before == ">" or after == "<")):
                branch[i] = x in branches and not (x == "while" and self._closes_do(i))
                if x in blocks:
                    ends[i] = self.block_end(i)
                if x == "while" and family == "js" and self._closes_do(i):
                    branch[i] = 1
                    ends.pop(i, None)
        out = []
        for _, name, first, params, last in found:
            open_, deepest = [], 0
            for i in range(first, last + 1):
                if i in ends:
                    open_ = [e for e in open_ if e >= i] + [ends[i]]
                    deepest = max(deepest, len(open_))
            names = dict.fromkeys(calls[i] for i in range(first, last + 1) if i in calls)
            out.append((name, self.line[first], self.last[min(last, len(self.last) - 1)], 1 if params < 0 else self.count_params(params), 1 + sum(map(int, branch[first : last + 1])), deepest, list(names)))
        return out

    def _closes_do(self, i: int) -> bool:
        """Whether the ``while`` at ``i`` ends a do loop."""
        if self.family != "js" or not i:
            return False
        if self.t[i - 1] == "}" and i - 1 in self.pair:
            return self.t[self.pair[i - 1] - 1] == "do"
        return False

    def _patterns(self) -> set[int]:
        """Tokens of Rust in patterns and attributes, where a name before a parenthesis is no call."""
        t, out = self.t, set()
        for i, x in enumerate(t[:-3]):
            if x == "#" and t[i + 1] == "[" or x == "#" and t[i + 1] == "!" and t[i + 2] == "[":
                out.update(range(i, self.over(i + 1 + (t[i + 1] == "!"))))
            elif x == "let" or x == "for" and not _is_word(t[i - 1] if i else ""):
                j = i + 1
                while t[j] and t[j] not in ("=", "in", ";", "{", "}") or t[j] == "{" and x == "let":
                    j = self.over(j) if t[j] in _OPEN else j + 1
                out.update(range(i, j))
            elif x == "match":
                j = i + 1
                while t[j] and t[j] not in ("{", ";", "}", ")"):
                    j = self.over(j) if t[j] in _OPEN else j + 1
                end = self.pair.get(j, 0) if t[j] == "{" else 0
                j += 1
                while j < end:
                    k, guard = j, 0
                    while k < end and t[k] != "=>":
                        guard = guard or (k if t[k] == "if" else 0)
                        k = self.over(k) if t[k] in _OPEN else k + 1
                    out.update(range(j, guard or k))
                    k += 1
                    if k < end and t[k] == "{":
                        k = self.over(k)
                        k += t[k] == ","
                    else:
                        while k < end and t[k] != ",":
                            k = self.over(k) if t[k] in _OPEN else k + 1
                        k += 1
                    j = k
        return out


def function_metrics(text: str, extension: str) -> list[Metric]:
    """(name, line, end, parameters, complexity, nesting, calls) of each named function.

    Complexity is 1 + conditions, loops, cases, arms, handlers, conditional
    expressions and lazy operators, as for Python; nesting counts conditions,
    loops, switches and tries, and an ``else if`` lies within its ``if``.
    """
    return Source(text, extension).metrics()


def symbols(text: str, extension: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(line, name) of each call, and (line, module) of each import."""
    source = Source(text, extension)
    return [(source.line[i], name) for i, name in source.calls(source.functions()).items()], source.imports()
