"""Local grammars: whether the tokens of a balanced text are statements of its language."""

from __future__ import annotations

from codesift.llm.lexing import Malformed, Tokens

END = "end"


class Grammar:
    """A cursor over tokens."""

    def __init__(self, tokens: Tokens):
        self.k = [*tokens.kinds, END, END, END, END]
        self.nl = [*tokens.breaks, True, True, True, True]
        self.match = tokens.match
        self.i = 0

    def fail(self, what: str = "") -> None:
        raise Malformed(f"unexpected {self.k[self.i]} {what}".strip())

    def eat(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"for {kind}")
        self.i += 1

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False


# Classes of JavaScript tokens.
JS_SOFT = frozenset("async of get set static as from type interface enum declare namespace module abstract public private protected readonly implements is keyof satisfies infer unique asserts override accessor let yield await".split())
JS_BINARY = frozenset("+ - * / % ** == != === !== < > <= >= && || ?? & | ^ << >> >>> instanceof in = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
JS_PREFIX = frozenset("! ~ + - ++ -- typeof void delete await".split())
JS_ATOMS = frozenset("id num str tpl re this super null true false".split())
MODIFIERS = frozenset("static abstract public private protected readonly override declare async get set accessor".split())


class Script(Grammar):
    """JavaScript, and with ``typed`` TypeScript; with ``jsx`` a value in angle brackets is an element, no type assertion."""

    def __init__(self, tokens: Tokens, typed: bool, jsx: bool):
        super().__init__(tokens)
        self.typed, self.jsx, self.inner = typed, jsx, tokens.embedded

    def name(self) -> bool:
        k = self.k[self.i]
        if k == "id" or k in JS_SOFT:
            self.i += 1
            return True
        return False

    def need_name(self) -> None:
        if not self.name():
            self.fail("for a name")

    def key_name(self) -> bool:
        """A property name: any word."""
        k = self.k[self.i]
        if k == "id" or k.isalpha() and k not in ("num", "str", "tpl", "re", END):
            self.i += 1
            return True
        return False

    def program(self) -> None:
        while self.k[self.i] != END:
            self.statement()
        self.containers()

    def containers(self) -> None:
        for tokens, role in self.inner:
            Script(tokens, self.typed, self.jsx).embedded(role)

    def embedded(self, role: str) -> None:
        """The whole of a container: a value, a ``spread`` of attributes, or a ``child`` of an element, which may be empty."""
        if role != "child" or self.k[self.i] != END:
            if role == "spread":
                self.eat("...")
            elif role == "child":
                self.take("...")
            self.expression()
            if self.k[self.i] != END:
                self.fail("in an embedded expression")
        self.containers()

    def block(self) -> None:
        self.eat("{")
        while not self.take("}"):
            if self.k[self.i] == END:
                self.fail()
            self.statement()

    def finish(self) -> None:
        """The end of a simple statement: a semicolon, a line end, or a closing brace."""
        if self.k[self.i] == ";":
            self.i += 1
        elif not (self.k[self.i] in ("}", END) or self.nl[self.i]):
            self.fail("within a statement")

    def head(self) -> None:
        self.eat("(")
        self.expression()
        self.eat(")")

    def statement(self) -> None:
        k = self.k[self.i]
        method = _SCRIPT_STATEMENTS.get(k)
        if method is not None:
            method(self)
            return
        if k in JS_SOFT and self.soft_statement(k):
            return
        if (k == "id" or k in JS_SOFT) and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
            return
        self.expression()
        self.finish()

    def soft_statement(self, k: str) -> bool:
        after, line = self.k[self.i + 1], self.nl[self.i + 1]
        if k == "async" and after == "function" and not line:
            self.i += 1
            self.function(True)
            return True
        if k == "let" and (after in ("id", "{", "[") or after in JS_SOFT):
            self.variables()
            return True
        if not self.typed:
            if k in ("enum", "interface") and after == "id" and not line:
                self.fail("in a script")
            return False
        if line:
            return False
        if k == "interface" and after in ("id", *JS_SOFT):
            self.i += 2
            self.type_parameters()
            if self.take("extends"):
                self.types()
            self.members_type()
            return True
        if k == "type" and after in ("id", *JS_SOFT) and self.k[self.i + 2] in ("=", "<"):
            self.i += 2
            self.type_parameters()
            self.eat("=")
            self.type()
            self.finish()
            return True
        if k == "enum" and after == "id":
            self.i += 2
            self.enumeration()
            return True
        if k in ("namespace", "module") and after in ("id", "str"):
            self.i += 2
            while self.take("."):
                self.need_name()
            self.block()
            return True
        if k in ("declare", "abstract"):
            if after in ("class", "function", "const", "let", "var", "interface", "type", "enum", "namespace", "module", "abstract", "id"):
                self.i += 1
                self.statement()
                return True
        return False

    def enumeration(self) -> None:
        self.eat("{")
        while not self.take("}"):
            if not self.key_name() and not self.take("str"):
                self.fail()
            if self.take("="):
                self.assign()
            if not self.take(",") and self.k[self.i] != "}":
                self.fail()

    def s_if(self) -> None:
        self.i += 1
        self.head()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.head()
        self.statement()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.eat("while")
        self.head()
        self.take(";")

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.eat("(")
        k = self.k[self.i]
        if k in ("const", "let", "var"):
            self.i += 1
            self.declarators(True)
        elif k != ";":
            self.expression(True)
        if self.take("of") or self.take("in"):
            self.expression()
        else:
            self.eat(";")
            if self.k[self.i] != ";":
                self.expression()
            self.eat(";")
            if self.k[self.i] != ")":
                self.expression()
        self.eat(")")
        self.statement()

    def s_switch(self) -> None:
        self.i += 1
        self.head()
        self.eat("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.eat("default")
            self.eat(":")
            while self.k[self.i] not in ("case", "default", "}", END):
                self.statement()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        handled = False
        if self.take("catch"):
            handled = True
            if self.take("("):
                self.parameter()
                self.eat(")")
            self.block()
        if self.take("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail("after try")

    def s_return(self) -> None:
        self.i += 1
        if not (self.k[self.i] in (";", "}", END) or self.nl[self.i]):
            self.expression()
        self.finish()

    def s_throw(self) -> None:
        self.i += 1
        self.expression()
        self.finish()

    def s_jump(self) -> None:
        self.i += 1
        if self.k[self.i] == "id" and not self.nl[self.i]:
            self.i += 1
        self.finish()

    def s_empty(self) -> None:
        self.i += 1

    def variables(self) -> None:
        self.i += 1
        if self.typed and self.k[self.i] == "enum":
            self.soft_statement("enum")
            return
        self.declarators(False)
        self.finish()

    def declarators(self, loop: bool) -> None:
        while True:
            self.pattern()
            if self.typed:
                self.take("!")
                self.annotation()
            if self.take("="):
                self.assign(loop)
            if not self.take(","):
                return

    def pattern(self) -> None:
        k = self.k[self.i]
        if k in ("{", "["):
            self.primary()
        else:
            self.need_name()

    def annotation(self) -> None:
        if self.k[self.i] == ":":
            if not self.typed:
                self.fail("in a script")
            self.i += 1
            self.type()

    def s_import(self) -> None:
        if self.k[self.i + 1] in ("(", "."):
            self.expression()
            self.finish()
            return
        self.i += 1
        if self.take("str"):
            self.finish()
            return
        if self.typed and self.k[self.i] == "type" and self.k[self.i + 1] != "from":
            self.i += 1
        if self.name():
            if self.typed and self.take("="):
                self.expression()
                self.finish()
                return
            if self.take(",") and self.k[self.i] not in ("{", "*"):
                self.fail()
        if self.take("*"):
            self.eat("as")
            self.need_name()
        elif self.k[self.i] == "{":
            self.names()
        self.eat("from")
        self.eat("str")
        if self.take("with") or self.k[self.i] == "id" and not self.nl[self.i]:
            self.primary()
        self.finish()

    def names(self) -> None:
        self.eat("{")
        while not self.take("}"):
            if self.typed and self.k[self.i] == "type" and self.k[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            if not self.key_name():
                self.eat("str")
            if self.take("as") and not self.key_name():
                self.eat("str")
            if not self.take(",") and self.k[self.i] != "}":
                self.fail("in a list of names")

    def s_export(self) -> None:
        self.i += 1
        k = self.k[self.i]
        if k == "default":
            self.i += 1
            k = self.k[self.i]
            if k in ("function", "class") or k == "async" and self.k[self.i + 1] == "function" or k in ("abstract", "interface") and self.typed:
                self.statement()
            else:
                self.assign()
                self.finish()
        elif k == "*":
            self.i += 1
            if self.take("as"):
                self.key_name()
            self.eat("from")
            self.eat("str")
            self.finish()
        elif k == "{" or k == "type" and self.k[self.i + 1] in ("{", "*") and self.typed:
            self.take("type")
            if self.take("*"):
                pass
            else:
                self.names()
            if self.take("from"):
                self.eat("str")
            self.finish()
        elif self.typed and k in ("=", "as", "import"):
            self.i += 1
            self.expression()
            self.finish()
        elif k in ("const", "let", "var", "function", "class", "@") or k in JS_SOFT and k != "async" or k == "async" and self.k[self.i + 1] == "function":
            self.statement()
        else:
            self.fail("after export")

    def s_decorated(self) -> None:
        self.decorators()
        if self.k[self.i] not in ("class", "export", "abstract"):
            self.fail("after a decorator")
        self.statement()

    def decorators(self) -> None:
        while self.take("@"):
            self.postfix(self.primary)

    def function(self, statement: bool) -> None:
        self.eat("function")
        self.take("*")
        named = self.name()
        if statement and not named and self.k[self.i] != "(":
            self.fail("for a function")
        self.signature()
        if self.typed and statement and self.k[self.i] != "{":
            self.finish()
            return
        self.block()

    def s_function(self) -> None:
        self.function(True)

    def signature(self) -> None:
        if self.typed:
            self.type_parameters()
        self.eat("(")
        while not self.take(")"):
            self.parameter()
            if not self.take(",") and self.k[self.i] != ")":
                self.fail("between parameters")
        if self.k[self.i] == ":":
            if not self.typed:
                self.fail("in a script")
            self.i += 1
            self.return_type()

    def return_type(self) -> None:
        if self.k[self.i] == "asserts" and self.k[self.i + 1] in ("id", "this"):
            self.i += 1
        if self.k[self.i] in ("id", "this") and self.k[self.i + 1] == "is":
            self.i += 2
        self.type()

    def parameter(self) -> None:
        self.decorators()
        if self.typed:
            while self.k[self.i] in ("public", "private", "protected", "readonly", "override") and (self.k[self.i + 1] == "id" or self.k[self.i + 1] in JS_SOFT):
                self.i += 1
        self.take("...")
        if not (self.typed and self.take("this")):
            self.pattern()
        if self.typed:
            self.take("?")
        self.annotation()
        if self.take("="):
            self.assign()

    def classes(self) -> None:
        self.eat("class")
        if self.k[self.i] not in ("{", "extends", "implements"):
            self.need_name()
        if self.typed:
            self.type_parameters()
        if self.take("extends"):
            self.postfix(self.primary)
            if self.typed and self.k[self.i] == "<":
                self.type_arguments()
        if self.typed and self.take("implements"):
            self.types()
        self.eat("{")
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        if self.k[self.i] == "static" and self.k[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        while self.k[self.i] in MODIFIERS and self.k[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", ",", "<") and not (self.nl[self.i + 1] and self.k[self.i] not in ("static", "async")):
            if not self.typed and self.k[self.i] not in ("static", "async", "get", "set", "accessor"):
                break
            self.i += 1
        self.take("*")
        if self.typed and self.k[self.i] == "[" and self.k[self.i + 2] == ":":
            self.i += 2
            self.annotation()
            self.eat("]")
            self.annotation()
            self.finish()
            return
        self.key()
        if self.typed and self.k[self.i] in ("?", "!"):
            self.i += 1
        if self.k[self.i] in ("(", "<"):
            self.signature()
            if self.k[self.i] == "{":
                self.block()
            elif self.typed:
                self.finish()
            else:
                self.fail("for a body")
            return
        self.annotation()
        if self.take("="):
            self.assign()
        self.finish()

    def key(self) -> None:
        if self.take("["):
            self.assign()
            self.eat("]")
        elif self.take("#"):
            self.need_name()
        elif not (self.take("str") or self.take("num") or self.key_name()):
            self.fail("for a key")

    def s_class(self) -> None:
        self.classes()

    def expression(self, loop: bool = False) -> None:
        self.assign(loop)
        while self.take(","):
            self.assign(loop)

    def assign(self, loop: bool = False) -> None:
        k = self.k[self.i]
        if k == "yield":
            self.i += 1
            self.take("*")
            if self.k[self.i] in (")", "]", "}", ";", ",", ":", END) or self.nl[self.i]:
                return
            self.assign(loop)
            return
        if self.arrow(loop):
            return
        while True:
            while self.k[self.i] in JS_PREFIX and not (self.k[self.i] == "await" and self.k[self.i + 1] in (")", ";", ",", "=", ".")):
                self.i += 1
            self.postfix(self.primary)
            k = self.k[self.i]
            if k in ("++", "--") and not self.nl[self.i]:
                self.i += 1
                k = self.k[self.i]
            while self.typed and k in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                self.type()
                k = self.k[self.i]
            if k in JS_BINARY:
                if k == "in" and loop:
                    return
                self.i += 1
                if self.arrow(loop):
                    return
                continue
            if k == "?":
                self.i += 1
                self.assign()
                self.eat(":")
                self.assign(loop)
            return

    def arrow(self, loop: bool) -> bool:
        """An arrow function, told by what follows its parameters."""
        start, i = self.i, self.i
        if self.k[i] == "async" and not self.nl[i + 1] and (self.k[i + 1] == "(" or self.k[i + 1] == "id" or self.k[i + 1] == "<"):
            i += 1
        k = self.k[i]
        if (k == "id" or k in JS_SOFT) and self.k[i + 1] == "=>":
            self.i = i + 2
        elif k == "(" or k == "<" and self.typed:
            if k == "<":
                self.i = i
                try:
                    self.type_parameters()
                except Malformed:
                    self.i = start
                    return False
                i = self.i
                if self.k[i] != "(":
                    self.i = start
                    return False
            end = self.match.get(i)
            if end is None:
                self.i = start
                return False
            after = self.k[end + 1]
            if after == "=>":
                self.i = i
                self.signature()
            elif after == ":" and self.typed:
                self.i = i
                try:
                    self.signature()
                except Malformed:
                    self.i = start
                    return False
                if self.k[self.i] != "=>":
                    self.i = start
                    return False
            else:
                self.i = start
                return False
            self.eat("=>")
        else:
            return False
        if self.k[self.i] == "{":
            self.block()
        else:
            self.assign(loop)
        return True

    def primary(self) -> None:
        k = self.k[self.i]
        if k in JS_ATOMS:
            self.i += 1
        elif k == "(":
            self.i += 1
            self.expression()
            self.eat(")")
        elif k == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assign()
                if self.k[self.i] != "]":
                    self.eat(",")
        elif k == "{":
            self.object()
        elif k == "function":
            self.function(False)
        elif k == "async" and self.k[self.i + 1] == "function":
            self.i += 1
            self.function(False)
        elif k == "class":
            self.classes()
        elif k == "new":
            self.i += 1
            if self.take("."):
                self.key_name()
                return
            self.primary()
            while self.k[self.i] in (".", "["):
                if self.take("."):
                    self.key()
                else:
                    self.i += 1
                    self.expression()
                    self.eat("]")
            if self.typed and self.k[self.i] == "<":
                self.type_arguments()
            if self.k[self.i] == "(":
                self.arguments()
        elif k == "import" and self.k[self.i + 1] in ("(", "."):
            self.i += 1
        elif k == "<" and self.typed and not self.jsx:
            self.type_arguments()
            self.postfix(self.primary)
        elif k == "#":
            self.i += 1
            self.need_name()
        elif k in JS_SOFT:
            self.i += 1
        else:
            self.fail("for a value")

    def arguments(self) -> None:
        self.eat("(")
        while not self.take(")"):
            self.take("...")
            self.assign()
            if self.k[self.i] != ")":
                self.eat(",")

    def postfix(self, first) -> None:
        first()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.key()
            elif k == "(":
                self.arguments()
            elif k == "[":
                self.i += 1
                self.expression()
                self.eat("]")
            elif k == "?.":
                self.i += 1
                if self.k[self.i] not in ("(", "["):
                    self.key()
            elif k == "tpl":
                self.i += 1
            elif k == "!" and self.typed and not self.nl[self.i]:
                self.i += 1
            elif k == "<" and self.typed:
                at = self.i
                try:
                    self.type_arguments()
                except Malformed:
                    self.i = at
                    return
                if self.k[self.i] not in ("(", "tpl", ")", "]", ",", ";", ".", "?."):
                    self.i = at
                    return
            else:
                return

    def object(self) -> None:
        self.eat("{")
        while not self.take("}"):
            if self.take("..."):
                self.assign()
            else:
                while self.k[self.i] in ("async", "get", "set", "*") and self.k[self.i + 1] not in (",", ":", "(", "}", "="):
                    self.i += 1
                plain = self.k[self.i] == "id" or self.k[self.i] in JS_SOFT
                self.key()
                if self.k[self.i] in ("(", "<"):
                    self.signature()
                    self.block()
                elif self.take(":"):
                    self.assign()
                elif plain:
                    if self.take("="):
                        self.assign()
                else:
                    self.fail("after a key")
            if self.k[self.i] != "}":
                self.eat(",")

    # types

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def type_parameters(self) -> None:
        if not self.take("<"):
            return
        while not self.close_angle():
            while self.k[self.i] in ("const", "in") and self.k[self.i + 1] == "id":
                self.i += 1
            self.need_name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") and self.k[self.i] not in (">", ">>", ">>>"):
                self.fail("between type parameters")

    def type_arguments(self) -> None:
        self.eat("<")
        while not self.close_angle():
            self.type()
            if not self.take(",") and self.k[self.i][0] != ">":
                self.fail("between types")

    def close_angle(self) -> bool:
        k = self.k[self.i]
        if k == ">":
            self.i += 1
            return True
        if k in (">>", ">>>", ">=", ">>="):
            self.k[self.i] = k[1:]
            return True
        return False

    def type(self) -> None:
        self.take("|")
        self.take("&")
        while True:
            while self.k[self.i] in ("keyof", "readonly", "unique", "infer", "typeof") and self.k[self.i + 1] not in (";", ",", ")", "=", "|", "&", ">", "}", "]"):
                self.i += 1
            self.type_atom()
            while True:
                if self.k[self.i] == "[" and not self.nl[self.i]:
                    self.i += 1
                    if not self.take("]"):
                        self.type()
                        self.eat("]")
                elif self.k[self.i] == "." and self.k[self.i + 1] != ".":
                    self.i += 1
                    if not self.key_name():
                        self.fail("in a type")
                    if self.k[self.i] == "<":
                        self.type_arguments()
                elif self.k[self.i] == "<" and not self.nl[self.i]:
                    self.type_arguments()
                else:
                    break
            if self.k[self.i] in ("|", "&"):
                self.i += 1
                continue
            break
        if self.k[self.i] == "extends" and not self.nl[self.i]:
            self.i += 1
            self.type()
            self.eat("?")
            self.type()
            self.eat(":")
            self.type()

    def type_atom(self) -> None:
        k = self.k[self.i]
        if k == "(":
            end = self.match.get(self.i)
            if end is not None and self.k[end + 1] == "=>":
                self.signature()
                self.eat("=>")
                self.return_type()
            else:
                self.i += 1
                self.type()
                self.eat(")")
        elif k == "<":
            self.type_parameters()
            self.type_atom()
        elif k == "{":
            self.members_type()
        elif k == "[":
            self.i += 1
            while not self.take("]"):
                self.take("...")
                if self.k[self.i + 1] in (":", "?") and self.k[self.i] == "id":
                    self.i += 1
                    self.take("?")
                    self.take(":")
                self.type()
                self.take("?")
                if self.k[self.i] != "]":
                    self.eat(",")
        elif k == "-" and self.k[self.i + 1] == "num":
            self.i += 2
        elif k in ("id", "str", "num", "tpl", "this", "null", "true", "false", "void", "undefined") or k in JS_SOFT:
            self.i += 1
        elif k == "new" or k == "abstract":
            self.i += 1
            self.type_atom()
        elif k == "import":
            self.i += 1
            self.arguments()
        else:
            self.fail("for a type")

    def members_type(self) -> None:
        self.eat("{")
        while not self.take("}"):
            while self.k[self.i] in ("readonly", "get", "set", "+", "-") and self.k[self.i + 1] not in (":", "?", "(", ";", ",", "<"):
                self.i += 1
            if self.take("["):
                self.type()
                if self.take(":") or self.take("in"):
                    self.type()
                if self.take("as"):
                    self.type()
                self.eat("]")
            elif self.k[self.i] in ("(", "<"):
                pass
            else:
                if self.k[self.i] == "new" and self.k[self.i + 1] in ("(", "<"):
                    self.i += 1
                else:
                    self.key()
            if self.k[self.i] in ("+", "-"):
                self.i += 1
            self.take("?")
            if self.k[self.i] in ("(", "<"):
                self.signature()
            else:
                self.annotation()
            if self.k[self.i] in (";", ","):
                self.i += 1
            elif not (self.k[self.i] == "}" or self.nl[self.i]):
                self.fail("between members")


_SCRIPT_STATEMENTS = {
    "{": Script.block, ";": Script.s_empty, "if": Script.s_if, "while": Script.s_while, "with": Script.s_while, "do": Script.s_do, "for": Script.s_for, "switch": Script.s_switch,
    "try": Script.s_try, "return": Script.s_return, "throw": Script.s_throw, "break": Script.s_jump, "continue": Script.s_jump, "debugger": Script.s_jump,
    "const": Script.variables, "var": Script.variables, "import": Script.s_import, "export": Script.s_export, "@": Script.s_decorated, "function": Script.s_function, "class": Script.s_class,
}


# Classes of Go tokens.
GO_BINARY = frozenset("+ - * / % & | ^ << >> &^ && || == != < <= > >= <-".split())
GO_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
GO_PREFIX = frozenset("+ - ! ^ * & <- ~".split())


class Go(Grammar):
    def __init__(self, tokens: Tokens, whole: bool):
        super().__init__(tokens)
        self.whole = whole
        self.header = 0

    def semicolon(self) -> None:
        if self.k[self.i] == ";":
            self.i += 1
        elif self.k[self.i] not in (")", "}", END):
            self.fail("within a statement")

    def program(self) -> None:
        while self.take(";"):
            pass
        if self.whole or self.k[self.i] == "package":
            if self.k[self.i] == END and not self.whole:
                return
            self.eat("package")
            self.eat("id")
            self.semicolon()
        late = False
        while self.k[self.i] != END:
            if self.take(";"):
                continue
            k = self.k[self.i]
            if k == "import":
                if late:
                    self.fail("after declarations")
                self.i += 1
                self.group(self.import_spec)
            elif k in ("const", "var", "type", "func"):
                late = True
                self.declaration()
            else:
                self.fail("at top level")
            self.semicolon()

    def group(self, spec) -> None:
        if self.take("("):
            while not self.take(")"):
                if self.take(";"):
                    continue
                spec()
                self.semicolon()
        else:
            spec()

    def import_spec(self) -> None:
        if self.k[self.i] in ("id", "."):
            self.i += 1
        self.eat("str")

    def declaration(self) -> None:
        k = self.k[self.i]
        self.i += 1
        if k == "func":
            if self.k[self.i] == "(":
                self.parameters()
            self.eat("id")
            if self.k[self.i] == "[":
                self.skip_group()
            self.func_rest()
            if self.k[self.i] == "{":
                self.block()
        elif k == "type":
            self.group(self.type_spec)
        else:
            self.group(self.value_spec)

    def skip_group(self) -> None:
        end = self.match.get(self.i)
        if end is None:
            self.fail()
        self.i = end + 1

    def type_spec(self) -> None:
        self.eat("id")
        if self.k[self.i] == "[" and self.k[self.i + 1] == "id" and self.k[self.i + 2] != "]":
            self.skip_group()
        self.take("=")
        self.type()

    def value_spec(self) -> None:
        self.eat("id")
        while self.take(","):
            self.eat("id")
        if self.k[self.i] not in ("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def func_rest(self) -> None:
        self.parameters()
        if self.k[self.i] == "(":
            self.parameters()
        elif self.starts_type():
            self.type()

    def starts_type(self) -> bool:
        return self.k[self.i] in ("id", "*", "[", "map", "chan", "func", "struct", "interface", "<-", "(")

    def parameters(self) -> None:
        self.eat("(")
        while not self.take(")"):
            self.take("...")
            self.type()
            if self.k[self.i] not in (",", ")"):
                self.take("...")
                self.type()
            if self.k[self.i] != ")":
                self.eat(",")

    def type(self) -> None:
        k = self.k[self.i]
        if k == "id":
            self.i += 1
            if self.take("."):
                self.eat("id")
            if self.k[self.i] == "[" and self.k[self.i + 1] != "]" and self.k[self.i + 1] != "num":
                self.skip_group()
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "[":
            self.skip_group()
            self.type()
        elif k == "map":
            self.i += 1
            self.eat("[")
            self.type()
            self.eat("]")
            self.type()
        elif k == "chan" or k == "<-":
            self.i += 1
            self.take("<-")
            if k == "<-":
                self.eat("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.func_rest()
        elif k == "(":
            self.i += 1
            self.type()
            self.eat(")")
        elif k in ("struct", "interface"):
            self.i += 1
            self.eat("{")
            while not self.take("}"):
                if self.take(";"):
                    continue
                self.field(k == "struct")
                self.semicolon()
        else:
            self.fail("for a type")

    def field(self, record: bool) -> None:
        if not record:
            if self.k[self.i] == "id" and self.k[self.i + 1] == "(":
                self.i += 1
                self.func_rest()
                return
            self.take("~")
            self.type()
            while self.take("|"):
                self.take("~")
                self.type()
            return
        if self.k[self.i] == "*" or self.k[self.i + 1] in (";", ".", "str", "}"):
            self.type()
        else:
            self.eat("id")
            while self.take(","):
                self.eat("id")
            self.type()
        self.take("str")

    def block(self) -> None:
        self.eat("{")
        header, self.header = self.header, 0
        while not self.take("}"):
            if self.k[self.i] == END:
                self.fail()
            if not self.take(";"):
                self.statement()
                self.semicolon()
        self.header = header

    def statement(self) -> None:
        k = self.k[self.i]
        if k in ("const", "var", "type"):
            self.declaration()
        elif k == "{":
            self.block()
        elif k == "if":
            self.i += 1
            self.heading()
            self.block()
            if self.take("else"):
                if self.k[self.i] == "if":
                    self.statement()
                else:
                    self.block()
        elif k == "for":
            self.i += 1
            self.header = 1
            if self.take("range"):
                self.expression()
            else:
                if self.k[self.i] not in ("{", ";"):
                    self.simple()
                if self.take(";"):
                    if self.k[self.i] != ";":
                        self.simple()
                    self.eat(";")
                    if self.k[self.i] != "{":
                        self.simple()
            self.header = 0
            self.block()
        elif k == "switch":
            self.i += 1
            if self.k[self.i] != "{":
                self.heading()
            self.clauses()
        elif k == "select":
            self.i += 1
            self.clauses()
        elif k in ("go", "defer"):
            self.i += 1
            self.expression()
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (";", "}"):
                self.expressions()
        elif k in ("break", "continue", "goto", "fallthrough"):
            self.i += 1
            self.take("id")
        elif k == "id" and self.k[self.i + 1] == ":":
            self.i += 2
            if self.k[self.i] not in ("}", ";"):
                self.statement()
        else:
            self.simple()

    def heading(self) -> None:
        self.header = 1
        if self.k[self.i] != ";":
            self.simple()
        if self.take(";") and self.k[self.i] != "{":
            self.simple()
        self.header = 0

    def clauses(self) -> None:
        self.eat("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.take("case"):
                self.simple(True)
            else:
                self.eat("default")
            self.eat(":")
            while self.k[self.i] not in ("case", "default", "}", END):
                if not self.take(";"):
                    self.statement()
                    self.semicolon()

    def simple(self, clause: bool = False) -> None:
        self.expressions(clause)
        k = self.k[self.i]
        if k in ("++", "--"):
            self.i += 1
        elif k in GO_ASSIGN:
            self.i += 1
            if self.take("range"):
                self.expression()
            else:
                self.expressions()

    def expressions(self, types: bool = False) -> None:
        self.expression(types)
        while self.take(","):
            self.expression(types)

    def expression(self, types: bool = False) -> None:
        while True:
            while self.k[self.i] in GO_PREFIX:
                self.i += 1
            self.operand()
            if self.k[self.i] in GO_BINARY:
                self.i += 1
                continue
            return

    def operand(self) -> None:
        k = self.k[self.i]
        if k in ("id", "num", "str"):
            self.i += 1
        elif k == "(":
            self.i += 1
            header, self.header = self.header, 0
            if self.k[self.i] in ("*", "func", "chan", "map", "[", "struct", "interface") and self.k[self.i] != "*":
                at = self.i
                try:
                    self.type()
                    if self.k[self.i] != ")":
                        raise Malformed("not a type")
                except Malformed:
                    self.i = at
                    self.expression()
            else:
                self.expression()
            self.eat(")")
            self.header = header
        elif k == "func":
            self.i += 1
            self.func_rest()
            if self.k[self.i] == "{":
                self.block()
        elif k in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if self.k[self.i] == "{":
                self.composite()
            elif self.k[self.i] not in ("(", ")", ","):
                self.fail("after a type")
        else:
            self.fail("for a value")
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.eat(")")
                else:
                    self.eat("id")
            elif k == "(":
                self.i += 1
                header, self.header = self.header, 0
                while not self.take(")"):
                    self.expression(True)
                    self.take("...")
                    if self.k[self.i] != ")":
                        self.eat(",")
                self.header = header
            elif k == "[":
                self.i += 1
                header, self.header = self.header, 0
                if self.k[self.i] != ":":
                    self.expression(True)
                while self.k[self.i] in (":", ","):
                    self.i += 1
                    if self.k[self.i] not in ("]", ":"):
                        self.expression(True)
                self.eat("]")
                self.header = header
            elif k == "{" and not self.header and self.k[self.i - 1] in ("id", "]"):
                self.composite()
            else:
                return

    def composite(self) -> None:
        self.eat("{")
        header, self.header = self.header, 0
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if self.k[self.i] != "}":
                self.eat(",")
        self.header = header

    def element(self) -> None:
        if self.k[self.i] == "{":
            self.composite()
        else:
            self.expression()


# Classes of Rust tokens.
RUST_BINARY = frozenset("+ - * / % & | ^ << >> && || == != < <= > >= = += -= *= /= %= &= |= ^= <<= >>= .. ..= ...".split())
RUST_PREFIX = frozenset("- ! * & &&".split())
RUST_BLOCKS = frozenset("if match loop while for unsafe { async".split())
RUST_ITEMS = frozenset("fn struct enum impl trait mod use static type extern pub union".split())


class Rust(Grammar):
    def __init__(self, tokens: Tokens):
        super().__init__(tokens)
        self.bare = 0

    def skip_group(self) -> None:
        end = self.match.get(self.i)
        if end is None:
            self.fail()
        self.i = end + 1

    def attributes(self) -> None:
        while self.k[self.i] == "#" and (self.k[self.i + 1] == "[" or self.k[self.i + 1] == "!" and self.k[self.i + 2] == "["):
            self.i += 1
            self.take("!")
            self.skip_group()

    def program(self) -> None:
        self.attributes()
        while self.k[self.i] != END:
            self.item()
            self.attributes()

    def visible(self) -> None:
        if self.take("pub") and self.k[self.i] == "(" and self.k[self.i + 1] in ("crate", "super", "self", "in"):
            self.skip_group()

    def item(self) -> None:
        self.attributes()
        self.visible()
        while self.k[self.i] in ("unsafe", "async", "extern", "const") and self.k[self.i + 1] in ("fn", "unsafe", "async", "extern", "impl", "trait", "str", "{") and not (self.k[self.i] == "extern" and self.k[self.i + 1] == "{"):
            self.i += 1
            if self.k[self.i] == "str":
                self.i += 1
        k = self.k[self.i]
        if k == "fn":
            self.function()
        elif k == "use":
            self.i += 1
            self.use_tree()
            self.eat(";")
        elif k in ("struct", "union") and self.k[self.i + 1] == "id":
            self.i += 2
            self.generics()
            self.where()
            if self.k[self.i] == "(":
                self.tuple_fields()
                self.where()
                self.eat(";")
            elif not self.take(";"):
                self.fields()
        elif k == "enum":
            self.i += 1
            self.eat("id")
            self.generics()
            self.where()
            self.eat("{")
            while not self.take("}"):
                self.attributes()
                self.eat("id")
                if self.k[self.i] == "(":
                    self.tuple_fields()
                elif self.k[self.i] == "{":
                    self.fields()
                if self.take("="):
                    self.expression()
                if self.k[self.i] != "}":
                    self.eat(",")
        elif k == "impl":
            self.i += 1
            self.generics()
            self.take("!")
            self.type()
            if self.take("for"):
                self.type()
            self.where()
            self.items_block()
        elif k == "trait":
            self.i += 1
            self.eat("id")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            self.items_block()
        elif k == "mod":
            self.i += 1
            self.eat("id")
            if not self.take(";"):
                self.items_block()
        elif k == "extern":
            self.i += 1
            if self.take("crate"):
                while not self.take(";"):
                    if self.k[self.i] == END:
                        self.fail()
                    self.i += 1
            else:
                self.take("str")
                self.items_block()
        elif k in ("const", "static"):
            self.i += 1
            self.take("mut")
            if not self.take("id"):
                self.fail("for a name")
            self.eat(":")
            self.type()
            if self.take("="):
                self.expression()
            self.eat(";")
        elif k == "type":
            self.i += 1
            self.eat("id")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type()
            self.where()
            self.eat(";")
        elif k == "id" and self.k[self.i + 1] in ("!", "::"):
            self.macro_item()
        else:
            self.fail("for an item")

    def macro_item(self) -> None:
        self.path()
        self.eat("!")
        self.take("id")
        if self.k[self.i] == "{":
            self.skip_group()
        elif self.k[self.i] in ("(", "["):
            self.skip_group()
            self.eat(";")
        else:
            self.fail("in a macro")

    def items_block(self) -> None:
        self.eat("{")
        self.attributes()
        while not self.take("}"):
            self.item()
            self.attributes()

    def use_tree(self) -> None:
        self.take("::")
        while True:
            k = self.k[self.i]
            if k == "{":
                self.i += 1
                while not self.take("}"):
                    self.use_tree()
                    if self.k[self.i] != "}":
                        self.eat(",")
                return
            if k == "*":
                self.i += 1
                return
            if k not in ("id", "self", "super", "crate", "Self"):
                self.fail("in use")
            self.i += 1
            if self.take("::"):
                continue
            if self.take("as"):
                self.eat("id")
            return

    def generics(self) -> None:
        if not self.take("<"):
            return
        while not self.close_angle():
            self.attributes()
            if self.take("life"):
                if self.take(":"):
                    self.bounds()
            else:
                self.take("const")
                self.eat("id")
                if self.take(":"):
                    self.bounds()
                if self.take("="):
                    self.type()
            if self.k[self.i][0] != ">":
                self.eat(",")

    def close_angle(self) -> bool:
        k = self.k[self.i]
        if k == ">":
            self.i += 1
            return True
        if k in (">>", ">=", ">>="):
            self.k[self.i] = k[1:]
            return True
        return False

    def bounds(self) -> None:
        while True:
            self.take("?")
            if self.k[self.i] == "life":
                self.i += 1
            elif self.k[self.i] == "(":
                self.skip_group()
            else:
                self.type(True)
            if not self.take("+"):
                return
            if self.k[self.i] in ("{", ",", ">", "="):
                return

    def where(self) -> None:
        if not self.take("where"):
            return
        while self.k[self.i] not in ("{", ";", "=", END):
            if not self.take("life"):
                self.type()
            self.eat(":")
            self.bounds()
            if self.k[self.i] not in ("{", ";", "="):
                self.eat(",")

    def fields(self) -> None:
        self.eat("{")
        while not self.take("}"):
            self.attributes()
            self.visible()
            self.eat("id")
            self.eat(":")
            self.type()
            if self.k[self.i] != "}":
                self.eat(",")

    def tuple_fields(self) -> None:
        self.eat("(")
        while not self.take(")"):
            self.attributes()
            self.visible()
            self.type()
            if self.k[self.i] != ")":
                self.eat(",")

    def function(self) -> None:
        self.eat("fn")
        if self.k[self.i] not in ("id", "union", "async"):
            self.fail("for a name")
        self.i += 1
        self.generics()
        self.eat("(")
        while not self.take(")"):
            self.attributes()
            if self.take("..."):
                continue
            self.pattern()
            if self.take(":"):
                self.type()
            elif self.k[self.i - 1] != "self":
                self.fail("without a type")
            if self.k[self.i] != ")":
                self.eat(",")
        if self.take("->"):
            self.type()
        self.where()
        if not self.take(";"):
            self.block()

    def type(self, bound: bool = False) -> None:
        k = self.k[self.i]
        if k in ("&", "&&"):
            self.i += 1
            self.take("life")
            self.take("mut")
            self.type(True)
        elif k == "*":
            self.i += 1
            if not (self.take("const") or self.take("mut")):
                self.fail("in a pointer type")
            self.type(True)
        elif k == "(":
            self.i += 1
            while not self.take(")"):
                self.type()
                if self.k[self.i] != ")":
                    self.eat(",")
        elif k == "[":
            self.i += 1
            self.type()
            if self.take(";"):
                self.expression()
            self.eat("]")
        elif k == "!" or k == "id" and self.k[self.i] == "_":
            self.i += 1
        elif k in ("dyn", "impl"):
            self.i += 1
            self.bounds()
        elif k == "for":
            self.i += 1
            self.generics()
            self.type(True)
        elif k in ("fn", "unsafe", "extern"):
            while self.k[self.i] in ("unsafe", "extern", "str"):
                self.i += 1
            self.eat("fn")
            self.eat("(")
            while not self.take(")"):
                if self.k[self.i] == "id" and self.k[self.i + 1] == ":":
                    self.i += 2
                self.type()
                if self.k[self.i] != ")":
                    self.eat(",")
            if self.take("->"):
                self.type()
        elif k in ("id", "self", "Self", "super", "crate", "::", "<", "union"):
            self.type_path()
        else:
            self.fail("for a type")
        if not bound and self.k[self.i] == "+":
            self.i += 1
            self.bounds()

    def type_path(self) -> None:
        self.take("::")
        if self.take("<"):
            self.type()
            if self.take("as"):
                self.type()
            if not self.close_angle():
                self.fail()
            self.eat("::")
        while True:
            if self.k[self.i] not in ("id", "self", "Self", "super", "crate", "union"):
                self.fail("in a path")
            self.i += 1
            if self.k[self.i] == "!" and self.k[self.i + 1] in ("(", "["):
                self.i += 1
                self.skip_group()
                return
            if self.k[self.i] == "::" and self.k[self.i + 1] == "<":
                self.i += 1
            if self.k[self.i] == "<":
                self.type_arguments()
            elif self.k[self.i] == "(" and self.k[self.i - 1] == "id" and self.fn_sugar():
                continue
            if not self.take("::"):
                return

    def fn_sugar(self) -> bool:
        end = self.match.get(self.i)
        if end is None or self.k[end + 1] != "->":
            return False
        self.tuple_fields()
        self.eat("->")
        self.type()
        return False

    def type_arguments(self) -> None:
        self.eat("<")
        while not self.close_angle():
            k = self.k[self.i]
            if k == "life":
                self.i += 1
            elif k in ("num", "str", "true", "false", "-"):
                self.take("-")
                self.i += 1
            elif k == "{":
                self.skip_group()
            else:
                self.type()
                if self.take("="):
                    self.type()
                elif self.take(":"):
                    self.bounds()
            if self.k[self.i][0] != ">":
                self.eat(",")

    def pattern(self) -> None:
        self.take("|")
        while True:
            self.pattern_atom()
            if not self.take("|"):
                return

    def pattern_atom(self) -> None:
        k = self.k[self.i]
        if k in ("&", "&&"):
            self.i += 1
            self.take("life")
            self.take("mut")
            self.pattern_atom()
        elif k in ("mut", "ref"):
            self.i += 1
            self.pattern_atom()
        elif k in ("(", "["):
            self.i += 1
            close = ")" if k == "(" else "]"
            while not self.take(close):
                self.pattern()
                if self.k[self.i] != close:
                    self.eat(",")
        elif k in ("..", "..="):
            self.i += 1
            if self.k[self.i] in ("num", "str"):
                self.i += 1
        elif k in ("num", "str", "true", "false", "-"):
            self.take("-")
            self.i += 1
            if self.k[self.i] in ("..", "..=", "..."):
                self.i += 1
                self.take("-")
                if self.k[self.i] in ("num", "str", "id"):
                    self.i += 1
        elif k in ("id", "self", "Self", "crate", "super", "::", "<"):
            self.path()
            if self.k[self.i] == "!":
                self.i += 1
                self.skip_group()
            elif self.k[self.i] == "(":
                self.pattern_atom()
            elif self.k[self.i] == "{":
                self.i += 1
                while not self.take("}"):
                    self.attributes()
                    if not self.take(".."):
                        self.take("ref")
                        self.take("mut")
                        if self.k[self.i] not in ("id", "num"):
                            self.fail("in a pattern")
                        self.i += 1
                        if self.take(":"):
                            self.pattern()
                    if self.k[self.i] != "}":
                        self.eat(",")
            elif self.take("@"):
                self.pattern_atom()
            elif self.k[self.i] in ("..", "..=", "..."):
                self.i += 1
                if self.k[self.i] in ("num", "str", "id"):
                    self.i += 1
        else:
            self.fail("for a pattern")

    def path(self) -> None:
        self.take("::")
        if self.k[self.i] == "<":
            self.i += 1
            self.type()
            if self.take("as"):
                self.type()
            if not self.close_angle():
                self.fail()
            self.eat("::")
        while True:
            if self.k[self.i] not in ("id", "self", "Self", "super", "crate", "union"):
                self.fail("in a path")
            self.i += 1
            if self.k[self.i] != "::":
                return
            self.i += 1
            if self.k[self.i] == "<":
                self.type_arguments()
                if not self.take("::"):
                    return

    def block(self) -> None:
        self.eat("{")
        bare, self.bare = self.bare, 0
        self.attributes()
        while not self.take("}"):
            self.statement()
        self.bare = bare

    def statement(self) -> None:
        self.attributes()
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif k == "let":
            self.i += 1
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
                if self.take("else"):
                    self.block()
            self.eat(";")
        elif k in RUST_ITEMS or k == "const" and self.k[self.i + 1] != "{" or k in ("unsafe", "async") and self.k[self.i + 1] in ("fn", "impl", "extern", "trait"):
            self.item()
        elif k in RUST_BLOCKS or k == "life" and self.k[self.i + 1] == ":":
            self.block_like()
            if self.k[self.i] in (".", "?"):
                self.postfix()
                self.rest()
                if self.k[self.i] != "}":
                    self.eat(";")
            else:
                self.take(";")
        else:
            macro = k == "id" and self.k[self.i + 1] == "!" and self.k[self.i + 2] == "{"
            self.expression()
            if not self.take(";") and self.k[self.i] != "}" and not macro:
                self.fail("within a statement")

    def block_like(self) -> None:
        if self.take("life"):
            self.eat(":")
        k = self.k[self.i]
        if k == "{":
            self.block()
            return
        self.i += 1
        if k == "if":
            self.condition()
            self.block()
            if self.take("else"):
                if self.k[self.i] == "if":
                    self.block_like()
                else:
                    self.block()
        elif k == "while":
            self.condition()
            self.block()
        elif k in ("loop", "unsafe"):
            self.block()
        elif k == "async":
            self.take("move")
            self.block()
        elif k == "for":
            self.pattern()
            self.eat("in")
            self.condition()
            self.block()
        elif k == "match":
            self.condition()
            self.eat("{")
            bare, self.bare = self.bare, 0
            self.attributes()
            while not self.take("}"):
                self.attributes()
                self.pattern()
                if self.take("if"):
                    self.expression()
                self.eat("=>")
                block = self.k[self.i] == "{"
                self.expression()
                if self.k[self.i] != "}" and not self.take(",") and not block and self.k[self.i - 1] != "}":
                    self.fail("between arms")
            self.bare = bare

    def condition(self) -> None:
        bare, self.bare = self.bare, 1
        self.expression()
        self.bare = bare

    def expression(self) -> None:
        self.unary()
        self.rest()

    def rest(self) -> None:
        while True:
            k = self.k[self.i]
            if k in RUST_BINARY:
                self.i += 1
                if k in ("..", "..=") and (self.k[self.i] in (")", "]", "}", ",", ";", "=>", END) or self.k[self.i] == "{" and self.bare):
                    return
                self.unary()
            elif k == "as":
                self.i += 1
                self.type(True)
            else:
                return

    def unary(self) -> None:
        while self.k[self.i] in RUST_PREFIX:
            k = self.k[self.i]
            self.i += 1
            if k in ("&", "&&"):
                self.take("mut")
        k = self.k[self.i]
        if k == "let":
            self.i += 1
            self.pattern()
            self.eat("=")
            self.unary()
            return
        if k in ("..", "..="):
            self.i += 1
            if self.k[self.i] not in (")", "]", "}", ",", ";", END):
                self.unary()
            return
        if k in ("return", "break", "continue"):
            self.i += 1
            self.take("life")
            if self.k[self.i] not in (")", "]", "}", ",", ";", "=>", END):
                self.expression()
            return
        if k in ("|", "||", "move") or k == "async" and self.k[self.i + 1] in ("|", "||") or k == "static" and self.k[self.i + 1] in ("|", "||", "move"):
            self.closure()
            return
        self.atom()
        self.postfix()

    def closure(self) -> None:
        while self.k[self.i] in ("move", "async", "static"):
            self.i += 1
        if self.k[self.i] == "{":
            self.block()
            return
        if not self.take("||"):
            self.eat("|")
            while not self.take("|"):
                self.pattern_atom()
                if self.take(":"):
                    self.type()
                if self.k[self.i] != "|":
                    self.eat(",")
        if self.take("->"):
            self.type()
            self.block()
        else:
            self.expression()

    def atom(self) -> None:
        k = self.k[self.i]
        if k in ("num", "str", "true", "false"):
            self.i += 1
        elif k == "(" or k == "[":
            self.i += 1
            bare, self.bare = self.bare, 0
            close = ")" if k == "(" else "]"
            while not self.take(close):
                self.attributes()
                self.expression()
                if self.k[self.i] != close and not self.take(";"):
                    self.eat(",")
            self.bare = bare
        elif k in RUST_BLOCKS or k == "life" and self.k[self.i + 1] == ":":
            self.block_like()
        elif k == "const" and self.k[self.i + 1] == "{":
            self.i += 1
            self.block()
        elif k in ("id", "self", "Self", "crate", "super", "::", "<", "union"):
            self.path()
            if self.k[self.i] == "!" and self.k[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.skip_group()
            elif self.k[self.i] == "{" and not self.bare:
                self.i += 1
                while not self.take("}"):
                    self.attributes()
                    if self.take(".."):
                        if self.k[self.i] != "}":
                            self.expression()
                    else:
                        if self.k[self.i] not in ("id", "num"):
                            self.fail("in a record")
                        self.i += 1
                        if self.take(":"):
                            self.expression()
                    if self.k[self.i] != "}":
                        self.eat(",")
        else:
            self.fail("for a value")

    def postfix(self) -> None:
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.k[self.i] not in ("id", "num", "await", "union"):
                    self.fail("after a dot")
                self.i += 1
                if self.k[self.i] == "::":
                    self.i += 1
                    self.type_arguments()
            elif k == "(":
                self.i += 1
                bare, self.bare = self.bare, 0
                while not self.take(")"):
                    self.expression()
                    if self.k[self.i] != ")":
                        self.eat(",")
                self.bare = bare
            elif k == "[":
                self.i += 1
                bare, self.bare = self.bare, 0
                self.expression()
                self.eat("]")
                self.bare = bare
            elif k == "?":
                self.i += 1
            else:
                return


def check(tokens: Tokens, lang: str, whole: bool) -> None:
    """Raise Malformed unless the balanced ``tokens`` are a program, or with ``whole`` false a run of top-level statements."""
    if lang == "go":
        Go(tokens, whole).program()
    elif lang == "rs":
        Rust(tokens).program()
    else:
        Script(tokens, lang in ("ts", "tsx"), lang == "tsx").program()
