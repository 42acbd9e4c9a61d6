"""Syntax checks of ECMAScript modules, TypeScript and Go by interned bracket contents.

A text becomes a string of one character per token. The content of each pair of brackets is interned: a dictionary maps
(bracket, content) to a number, and the outer string has a single character with that number in its place. So each
distinct content is parsed once per role it is used in (block, arguments, parameters, object ...), whatever the number
of its occurrences in a worker's files; a file costs its tokens once and a few look-ups.
"""

from __future__ import annotations

import re
import sys


class Bad(Exception):
    """The text is not in the language."""


#: Character codes: tokens of fixed spelling from KEY on, interned groups from GROUP on. Of the MOST codes there the last
#: one says that the two after it stand for one group.
KEY, GROUP, ROOM = 0xE000, 0x10000, 0x80000
MOST = 0x110000 - GROUP


#: Calls that a parser has open at once, for each character of the text, at most.
FRAMES = 64


class Language:
    """Interned groups and remembered results; subclasses have the lexer and the grammar."""

    WORDS: tuple[str, ...] = ()
    PUNCT: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.code = {w: chr(KEY + i) for i, w in enumerate(dict.fromkeys(self.WORDS + self.PUNCT))}
        self.name = {c: w for w, c in self.code.items()} | {c: c for c in "insrtp\n"}
        self.clear()

    def clear(self) -> None:
        self.groups: dict[str, int] = {}
        self.content: list[str] = []
        self.known: dict[tuple, bool] = {}

    def intern(self, bracket: str, content: str) -> str:
        key = bracket + content
        k = self.groups.get(key)
        if k is None:
            k = self.groups[key] = len(self.content)
            self.content.append(key)
        if k < MOST - 1:
            return chr(GROUP + k)
        high, low = divmod(k, MOST - 1)
        return chr(GROUP + MOST - 1) + chr(GROUP + high) + chr(GROUP + low)

    def __call__(self, text: str) -> bool:
        """Whether a text is in the language. What isn't decided raises; only what the grammar refuses is False."""
        if len(self.content) > ROOM or len(self.known) > 4 * ROOM:
            self.clear()
        try:
            return self.parses(text)
        except RecursionError:  # how deep it can go follows from its length; the calls are Python's own, held on the heap
            limit = sys.getrecursionlimit()
            sys.setrecursionlimit(min(limit + FRAMES * len(text), 2**31 - 1))
            try:
                return self.parses(text)
            finally:
                sys.setrecursionlimit(limit)

    def parses(self, text: str) -> bool:
        try:
            return self.fits("file", self.lex(text))
        except Bad:
            return False

    def fits(self, role: str, content: str) -> bool:
        key = (role, content)
        found = self.known.get(key)
        if found is None:
            if role in self.LISTS:
                found = True
                for part in content.split(self.BREAK):
                    if part and not self.whole(role, part):
                        found = self.whole(role, content)
                        break
            else:
                found = self.whole(role, content)
            self.known[key] = found
        return found

    def whole(self, role: str, content: str) -> bool:
        key = (role, content, 0)
        found = self.known.get(key)
        if found is None:
            p = self.PARSER(self, content)
            try:
                getattr(p, role)()
                found = p.i == len(p.t)
            except Bad:
                found = False
            self.known[key] = found
        return found

    LISTS: tuple[str, ...] = ()
    BREAK = "\n"
    PARSER: type

    def lex(self, text: str) -> str:
        raise NotImplementedError


class Parser:
    """A cursor over the tokens of one content; t has their names, g the numbers of groups, nl line breaks before."""

    def __init__(self, lang: Language, content: str):
        self.lang, self.t, self.g, self.nl, self.i = lang, [], [], [], 0
        fresh, name = False, lang.name
        chars = iter(content)
        for c in chars:
            if c == "\n":
                fresh = True
                continue
            k = ord(c) - GROUP
            if k >= 0:
                if k == MOST - 1:
                    k = (ord(next(chars)) - GROUP) * (MOST - 1) + ord(next(chars)) - GROUP
                self.t.append({"(": "()", "[": "[]", "{": "{}", "`": "t"}[lang.content[k][0]])
                self.g.append(k)
            else:
                self.t.append(name[c])
                self.g.append(-1)
            self.nl.append(fresh)
            fresh = False

    def peek(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.t[k] if k < len(self.t) else ""

    def take(self, *names: str) -> str:
        if self.i < len(self.t) and self.t[self.i] in names:
            self.i += 1
            return self.t[self.i - 1]
        return ""

    def need(self, *names: str) -> None:
        if not self.take(*names):
            raise Bad

    def inside(self, bracket: str, *roles: str) -> None:
        """The next token is a group whose content fits one of the roles."""
        if self.peek() != bracket:
            raise Bad
        content = self.lang.content[self.g[self.i]][1:]
        for r in roles:
            if self.lang.fits(r, content):
                self.i += 1
                return
        raise Bad

    def fits(self, role: str, ahead: int = 0) -> bool:
        return self.lang.fits(role, self.lang.content[self.g[self.i + ahead]][1:])

    def empty(self, ahead: int = 0) -> bool:
        return len(self.lang.content[self.g[self.i + ahead]].strip("\n")) == 1

    def attempt(self, f, *args) -> bool:
        at = self.i
        try:
            f(*args)
            return True
        except Bad:
            self.i = at
            return False


class Script(Language):
    """ECMAScript modules and, with ``types``, TypeScript."""

    RESERVED = (
        "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this "
        "throw true try typeof var void while with enum await yield"
    ).split()
    #: Words that are names unless the grammar asks for them.
    SOFT = "let static async of get set as from type interface declare namespace module abstract readonly public private protected override keyof unique infer is asserts satisfies implements undefined".split()
    WORDS = tuple(RESERVED + SOFT)
    PUNCT = tuple(
        "... => === !== == != <= >= **= ** &&= ||= ??= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= <<= << ; , < > + - * / % & | ^ ! ~ ? : = . @".split()
    )
    LISTS = ("file", "block")
    TOKEN = re.compile(
        r"""[ \t\v\f\xa0﻿]*(?:(?P<nl>(?:\r\n|[\n\r  ])[\s﻿]*)|(?P<c>//[^\n\r  ]*|/\*[\s\S]*?\*/)|(?P<w>(?:[^\W\d]|\$)[\w$]*)"""
        r"""|(?P<n>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))"""
        r"""|(?P<s>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')|(?P<b>[(){}\[\]])"""
        r"""|(?P<q>`)|(?P<d>/=?)|(?P<p>\#(?:[^\W\d]|\$)[\w$]*)"""
        r"""|(?P<o>\.\.\.|=>|===|!==|==|!=|<=|>=|\*\*=|\*\*|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<=|<<|[;,<>+\-*%&|^!~?:=.@])|(?P<e>$))"""
    )
    REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
    PLAIN = re.compile(r"`[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*`")
    CHUNK = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*")

    def __init__(self, types: bool):
        self.types = types
        super().__init__()
        self.after_value = set("insrtp") | {self.code[w] for w in ("this", "super", "null", "true", "false", "++", "--", *self.SOFT)}

    def lex(self, text: str) -> str:
        start = 0
        if text.startswith("#!"):
            start = text.find("\n") if "\n" in text else len(text)
        content, at = self.scan(text, start, False)
        return content

    def scan(self, text: str, at: int, inner: bool) -> tuple[str, int]:
        match, code, after = self.TOKEN.match, self.code, self.after_value
        stack: list[tuple[str, list[str]]] = []
        out: list[str] = []
        n = len(text)
        while True:
            m = match(text, at)
            if m is None:
                raise Bad
            kind, at = m.lastgroup, m.end()
            if kind == "w":
                out.append(code.get(m.group("w"), "i"))
            elif kind == "o":
                out.append(code[m.group("o")])
            elif kind == "b":
                b = m.group("b")
                if b in "([{":
                    stack.append((b, out))
                    out = []
                else:
                    if not stack:
                        if inner and b == "}":
                            return "".join(out), at
                        raise Bad
                    o, up = stack.pop()
                    if o + b not in ("()", "[]", "{}"):
                        raise Bad
                    up.append(self.intern(o, "".join(out)))
                    out = up
            elif kind == "nl":
                if out and out[-1] != "\n":
                    out.append("\n")
            elif kind == "s" or kind == "n" or kind == "p":
                out.append(kind)
            elif kind == "c":
                if m.group("c").startswith("/*") and "\n" in m.group("c") and out and out[-1] != "\n":
                    out.append("\n")
            elif kind == "d":
                last = next((c for c in reversed(out) if c != "\n"), "")
                if last in after or last and ord(last[0]) >= GROUP:
                    out.append(code[m.group("d")])
                else:
                    r = self.REGEX.match(text, m.start("d"))
                    if r is None:
                        raise Bad
                    out.append("r")
                    at = r.end()
            elif kind == "q":
                r = self.PLAIN.match(text, at - 1)
                if r is not None:
                    out.append("t")
                    at = r.end()
                else:
                    parts = []
                    while True:
                        at = self.CHUNK.match(text, at).end()
                        if at >= n:
                            raise Bad
                        if text[at] == "`":
                            at += 1
                            break
                        part, at = self.scan(text, at + 2, True)
                        parts.append(part)
                    for part in parts:
                        if not self.fits("paren", part):
                            raise Bad
                    out.append("t")
            else:  # the end
                if at < n:
                    raise Bad
                if stack or inner:
                    raise Bad
                return "".join(out), at


ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "**=", "&=", "|=", "^=", "<<=", "&&=", "||=", "??=")
BINARY = frozenset(("===", "!==", "==", "!=", "<=", ">=", "**", "&&", "||", "??", "<<", "<", ">", "+", "-", "*", "/", "%", "&", "|", "^", "instanceof"))
NAMES = frozenset(["i", *Script.SOFT])
KEYS = frozenset([*Script.WORDS, "i"])


class ScriptParser(Parser):
    @property
    def ts(self) -> bool:
        return self.lang.types

    # statements

    def file(self) -> None:
        while self.i < len(self.t):
            self.statement(True)

    def block(self) -> None:
        while self.i < len(self.t):
            self.statement()

    def end(self) -> None:
        if self.take(";") or self.i >= len(self.t) or self.nl[self.i]:
            return
        raise Bad

    def ident(self) -> None:
        if self.peek() not in NAMES:
            raise Bad
        self.i += 1

    def statement(self, top: bool = False) -> None:
        t, u = self.peek(), self.peek(1)
        if t == "{}":
            self.inside("{}", "block")
        elif t == ";":
            self.i += 1
        elif t in ("var", "const") or t == "let" and (u in NAMES or u in ("[]", "{}")):
            if t == "const" and u == "enum" and self.ts:
                self.i += 1
                self.enum()
                return
            self.i += 1
            self.variables(t == "const")
            self.end()
        elif t == "function" or t == "async" and u == "function" and not self.nl[self.i + 1]:
            self.take("async")
            self.function(True)
        elif t == "class" or t == "@" or self.ts and t == "abstract" and u == "class":
            self.decorators()
            self.take("export") and self.take("default")
            self.take("abstract")
            self.klass()
        elif t == "if":
            self.i += 1
            self.inside("()", "paren")
            self.statement()
            if self.take("else"):
                self.statement()
        elif t == "for":
            self.i += 1
            self.take("await")
            self.inside("()", "loop")
            self.statement()
        elif t == "while":
            self.i += 1
            self.inside("()", "paren")
            self.statement()
        elif t == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.inside("()", "paren")
            self.take(";")
        elif t in ("return", "throw"):
            self.i += 1
            if self.i < len(self.t) and not self.nl[self.i] and self.peek() != ";":
                self.expression()
            elif t == "throw":
                raise Bad
            self.end()
        elif t in ("break", "continue"):
            self.i += 1
            if self.i < len(self.t) and not self.nl[self.i] and self.peek() in NAMES:
                self.i += 1
            self.end()
        elif t == "debugger":
            self.i += 1
            self.end()
        elif t == "try":
            self.i += 1
            self.inside("{}", "block")
            some = False
            if self.take("catch"):
                some = True
                if self.peek() == "()":
                    self.inside("()", "params")
                self.inside("{}", "block")
            if self.take("finally"):
                some = True
                self.inside("{}", "block")
            if not some:
                raise Bad
        elif t == "switch":
            self.i += 1
            self.inside("()", "paren")
            self.inside("{}", "cases")
        elif t == "import" and u not in ("()", "."):
            if not top:
                raise Bad
            self.imports()
        elif t == "export":
            if not top:
                raise Bad
            self.exports()
        elif self.ts and self.declaration(t, u):
            pass
        elif t in NAMES and u == ":":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.end()

    def declaration(self, t: str, u: str) -> bool:
        """A declaration that only TypeScript has; False if there is none here."""
        if self.i + 1 < len(self.t) and self.nl[self.i + 1] and t != "enum":
            return False
        if t == "interface" and u in NAMES:
            self.i += 2
            self.type_parameters()
            if self.take("extends"):
                self.types()
            self.inside("{}", "members")
        elif t == "type" and u in NAMES:
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.take("|", "&")
            self.type()
            self.end()
        elif t == "enum":
            self.enum()
        elif t == "declare" and u in ("const", "let", "var", "function", "class", "type", "interface", "namespace", "module", "enum", "abstract", "async"):
            self.i += 1
            self.statement(True)
        elif t in ("namespace", "module") and (u in NAMES or u == "s"):
            self.i += 2
            while self.take("."):
                self.ident()
            if self.peek() == "{}":
                self.inside("{}", "file")
            else:
                self.end()
        else:
            return False
        return True

    def enum(self) -> None:
        self.need("enum")
        self.ident()
        self.inside("{}", "enum_body")

    def enum_body(self) -> None:
        while self.i < len(self.t):
            if self.peek() not in KEYS and self.peek() != "s":
                raise Bad
            self.i += 1
            if self.take("="):
                self.assign()
            if self.i < len(self.t):
                self.need(",")

    def variables(self, const: bool = False, loop: bool = False) -> None:
        while True:
            plain = self.peek() in NAMES
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assign(loop)
            elif not loop and (const or not plain) and not (self.ts and self.peek() in ("", ";")):
                raise Bad
            if not self.take(","):
                return

    def binding(self) -> None:
        if self.peek() == "[]":
            self.inside("[]", "array_pattern")
        elif self.peek() == "{}":
            self.inside("{}", "object_pattern")
        else:
            self.ident()

    def array_pattern(self) -> None:
        while self.i < len(self.t):
            if self.take(","):
                continue
            if self.take("..."):
                self.binding()
                return
            self.binding()
            if self.take("="):
                self.assign()
            if self.i < len(self.t):
                self.need(",")

    def object_pattern(self) -> None:
        while self.i < len(self.t):
            if self.take("..."):
                self.ident()
                return
            plain = self.peek() in NAMES
            self.property_name()
            if self.take(":"):
                self.binding()
            elif not plain:
                raise Bad
            if self.take("="):
                self.assign()
            if self.i < len(self.t):
                self.need(",")

    def property_name(self) -> None:
        if self.peek() == "[]":
            self.inside("[]", "paren")
        elif self.peek() in KEYS or self.peek() in ("s", "n", "p"):
            self.i += 1
        else:
            raise Bad

    def imports(self) -> None:
        self.need("import")
        if self.ts and self.peek() == "type" and self.peek(1) not in ("from", ",", "="):
            self.i += 1
        if not self.take("s"):
            if self.peek() in NAMES:
                self.i += 1
                if self.ts and self.take("="):
                    self.expression()
                    self.end()
                    return
                if not self.take(","):
                    self.need("from")
                    self.need("s")
                    self.attributes()
                    return
            if self.take("*"):
                self.need("as")
                self.ident()
            else:
                self.inside("{}", "specifiers")
            self.need("from")
            self.need("s")
        self.attributes()

    def attributes(self) -> None:
        if self.take("with"):
            self.inside("{}", "object")
        self.end()

    def specifiers(self) -> None:
        while self.i < len(self.t):
            if self.ts and self.peek() == "type" and self.peek(1) not in ("", ",", "as"):
                self.i += 1
            for k in range(2):
                if self.peek() not in KEYS and self.peek() != "s":
                    raise Bad
                self.i += 1
                if k or not self.take("as"):
                    break
            if self.i < len(self.t):
                self.need(",")

    def exports(self) -> None:
        self.need("export")
        if self.take("default"):
            t = self.peek()
            if t == "function" or t == "async" and self.peek(1) == "function":
                self.take("async")
                self.function(False)
            elif t in ("class", "@", "abstract") or self.ts and t == "interface":
                if not (t == "interface" and self.declaration(t, self.peek(1))):
                    self.decorators()
                    self.take("abstract")
                    self.klass()
            else:
                self.assign()
                self.end()
            return
        if self.ts and self.peek() == "=":
            self.i += 1
            self.expression()
            self.end()
            return
        if self.ts and self.peek() == "type" and self.peek(1) in ("{}", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.i += 1
            self.need("from")
            self.need("s")
            self.attributes()
        elif self.peek() == "{}":
            self.inside("{}", "specifiers")
            if self.take("from"):
                self.need("s")
                self.attributes()
            else:
                self.end()
        elif self.peek() in ("var", "let", "const", "function", "async", "class", "@", "abstract") or self.ts and self.peek() in ("interface", "type", "enum", "declare", "namespace", "module"):
            self.statement(True)
        else:
            raise Bad

    def cases(self) -> None:
        if self.i < len(self.t) and self.peek() not in ("case", "default"):
            raise Bad
        while self.i < len(self.t):
            if self.take("case"):
                self.expression()
                self.need(":")
            elif self.peek() == "default" and self.peek(1) == ":":
                self.i += 2
            else:
                self.statement()

    def loop(self) -> None:
        if self.peek() in ("var", "const") or self.peek() == "let" and self.peek(1) not in ("in", "of", ";", "="):
            self.i += 1
            self.variables(loop=True)
        elif self.peek() != ";":
            self.expression(True)
        if self.take("of"):
            self.assign()
        elif self.take("in"):
            self.expression()
        else:
            self.need(";")
            if self.peek() != ";":
                self.expression()
            self.need(";")
            if self.i < len(self.t):
                self.expression()

    # functions and classes

    def function(self, named: bool) -> None:
        self.need("function")
        self.take("*")
        if named or self.peek() in NAMES or self.peek() in ("yield", "await"):
            self.ident()
        self.signature()
        if self.ts and self.peek() != "{}":
            self.end()
        else:
            self.inside("{}", "block")

    def signature(self) -> None:
        self.type_parameters()
        self.inside("()", "params")
        if self.ts and self.take(":"):
            self.return_type()

    def params(self) -> None:
        while self.i < len(self.t):
            self.decorators()
            if self.ts:
                while self.peek() in ("public", "private", "protected", "readonly", "override") and self.peek(1) in NAMES:
                    self.i += 1
            rest = self.take("...")
            if self.ts and self.peek() == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if not rest and self.take("="):
                self.assign()
            if self.i < len(self.t):
                if rest and not self.ts:
                    raise Bad
                self.need(",")

    def decorators(self) -> None:
        while self.take("@"):
            if self.peek() == "()":
                self.inside("()", "paren")
                continue
            self.ident()
            while self.take("."):
                self.i += 1
            if self.peek() == "()":
                self.inside("()", "args")

    def klass(self) -> None:
        self.need("class")
        if self.peek() in NAMES and not (self.ts and self.peek() == "implements" and self.peek(1) != "{}"):
            self.i += 1
        self.type_parameters()
        if self.take("extends"):
            self.postfix()
            if self.ts and self.peek() == "<":
                self.type_arguments()
        if self.ts and self.take("implements"):
            self.types()
        self.inside("{}", "class_body")

    def class_body(self) -> None:
        ends = ("()", "=", ";", "", "?", "!", ":", "<")
        while self.i < len(self.t):
            if self.take(";"):
                continue
            self.decorators()
            while self.peek() in ("static", "async", "get", "set", "*") or self.ts and self.peek() in ("public", "private", "protected", "readonly", "abstract", "override", "declare"):
                if self.peek() != "*" and (self.peek(1) in ends or self.peek(1) == "{}" and self.peek() != "static"):
                    break
                self.i += 1
                if self.t[self.i - 1] == "static" and self.peek() == "{}":
                    break
            if self.peek() == "{}" and self.t[self.i - 1] == "static":
                self.inside("{}", "block")
                continue
            if self.ts and self.peek() == "[]" and self.fits("index_signature"):
                self.i += 1
                self.need(":")
                self.type()
                self.end()
                continue
            self.property_name()
            if self.ts:
                self.take("?", "!")
            if self.peek() in ("()", "<"):
                self.signature()
                if self.peek() == "{}":
                    self.inside("{}", "block")
                elif self.ts:
                    self.end()
                else:
                    raise Bad
            else:
                if self.ts and self.take(":"):
                    self.type()
                if self.take("="):
                    self.assign()
                self.end()

    # expressions

    def paren(self) -> None:
        self.expression()

    def args(self) -> None:
        while self.i < len(self.t):
            self.take("...")
            self.assign()
            if self.i < len(self.t):
                self.need(",")

    def array(self) -> None:
        while self.i < len(self.t):
            if self.take(","):
                continue
            self.take("...")
            self.assign()
            if self.i < len(self.t):
                self.need(",")

    def object(self, cover: bool = False) -> None:
        while self.i < len(self.t):
            if self.take("..."):
                self.assign()
            else:
                special = False
                while self.peek() in ("async", "get", "set", "*") and self.peek(1) not in (",", ":", "()", "", "=", "<"):
                    special = True
                    self.i += 1
                plain = self.peek() in NAMES
                self.property_name()
                if self.peek() in ("()", "<"):
                    self.signature()
                    self.inside("{}", "block")
                elif special:
                    raise Bad
                elif self.take(":"):
                    self.assign()
                elif not plain:
                    raise Bad
                elif cover and self.take("="):
                    self.assign()
            if self.i < len(self.t):
                self.need(",")

    def cover(self) -> None:
        self.object(True)

    def expression(self, loop: bool = False) -> None:
        self.assign(loop)
        while self.take(","):
            self.assign(loop)

    def arrow_body(self) -> None:
        self.need("=>")
        if self.peek() == "{}":
            self.inside("{}", "block")
        else:
            self.assign()

    def typed_arrow(self) -> None:
        self.type_parameters()
        self.inside("()", "params")
        if self.take(":"):
            self.return_type()
        self.arrow_body()

    def assign(self, loop: bool = False) -> None:
        k = 1 if self.peek() == "async" and (self.peek(1) in NAMES or self.peek(1) == "()" or self.ts and self.peek(1) == "<") and not self.nl[self.i + 1] else 0
        if self.peek(k) in NAMES and self.peek(k + 1) == "=>":
            self.i += k + 1
            self.arrow_body()
            return
        if self.peek(k) == "()" and self.peek(k + 1) == "=>":
            self.i += k
            self.inside("()", "params")
            self.arrow_body()
            return
        if self.ts and (self.peek(k) == "()" and self.peek(k + 1) == ":" or self.peek(k) == "<"):
            at = self.i
            self.i += k
            if self.attempt(self.typed_arrow):
                return
            self.i = at
        if self.take("yield"):
            if self.i < len(self.t) and not self.nl[self.i] and self.peek() not in (",", ";", ":"):
                self.take("*")
                self.assign(loop)
            return
        simple = self.binary(loop)
        if self.peek() in ASSIGN:
            if not simple:
                raise Bad
            self.i += 1
            self.assign(loop)
            return
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign(loop)

    def binary(self, loop: bool = False) -> bool:
        simple = self.unary()
        while True:
            t = self.peek()
            if t in BINARY or t == "in" and not loop:
                self.i += 1
                if t == ">":
                    while self.take(">", ">="):
                        pass
                self.unary()
                simple = False
            elif self.ts and t in ("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not self.take("const"):
                    self.type()
            else:
                return simple

    def unary(self) -> bool:
        if self.take("!", "~", "+", "-", "typeof", "void", "delete", "await"):
            self.unary()
            return False
        if self.take("++", "--"):
            if not self.unary():
                raise Bad
            return False
        if self.ts and self.peek() == "<" and self.attempt(self.assertion):
            return False
        simple = self.postfix()
        if self.peek() in ("++", "--") and not self.nl[self.i]:
            if not simple:
                raise Bad
            self.i += 1
            return False
        return simple

    def assertion(self) -> None:
        self.need("<")
        if not self.take("const"):
            self.type()
        self.need(">")
        self.unary()

    def postfix(self, new: bool = False) -> bool:
        simple = self.primary()
        while True:
            t = self.peek()
            if t == ".":
                self.i += 1
                if self.peek() not in KEYS and self.peek() != "p":
                    raise Bad
                self.i += 1
                simple = True
            elif t == "?." and not new:
                self.i += 1
                if self.peek() == "()":
                    self.inside("()", "args")
                elif self.peek() == "[]":
                    self.inside("[]", "paren")
                elif self.peek() in KEYS or self.peek() == "p":
                    self.i += 1
                else:
                    raise Bad
                simple = False
            elif t == "[]":
                self.inside("[]", "paren")
                simple = True
            elif t == "()":
                if new:
                    return False
                self.inside("()", "args")
                simple = False
            elif t == "t":
                self.i += 1
                simple = False
            elif self.ts and t == "!" and not self.nl[self.i] and self.peek(1) != "=":
                self.i += 1
            elif self.ts and t == "<" and self.attempt(self.call_types):
                if not new:
                    self.inside("()", "args")
                    simple = False
            else:
                return simple

    def call_types(self) -> None:
        self.type_arguments()
        if self.peek() != "()":
            raise Bad

    def primary(self) -> bool:
        t = self.peek()
        if t == "async" and self.peek(1) == "function" and not self.nl[self.i + 1]:
            self.i += 1
            self.function(False)
            return False
        if t in NAMES:
            self.i += 1
            return True
        if t in ("n", "s", "t", "r", "this", "null", "true", "false"):
            self.i += 1
            return False
        if t == "super":
            self.i += 1
            if self.peek() not in (".", "()", "[]"):
                raise Bad
            return False
        if t == "p" and self.peek(1) == "in":
            self.i += 1
            return False
        if t == "()":
            self.inside("()", "paren")
            return True
        if t == "[]":
            self.inside("[]", "array")
            return True
        if t == "{}":
            self.inside("{}", "cover" if self.peek(1) in ("=", "of", "in") else "object")
            return True
        if t == "function":
            self.function(False)
            return False
        if t in ("class", "@"):
            self.decorators()
            self.klass()
            return False
        if t == "new":
            self.i += 1
            if self.take("."):
                self.ident()
                return False
            self.postfix(True)
            if self.peek() == "()":
                self.inside("()", "args")
            return False
        if t == "import" and self.peek(1) == "()":
            self.i += 1
            self.inside("()", "args")
            return False
        if t == "import" and self.peek(1) == ".":
            self.i += 2
            self.ident()
            return False
        raise Bad

    # types

    def type_parameters(self) -> None:
        if not (self.ts and self.peek() == "<"):
            return
        self.i += 1
        while True:
            self.take("const")
            self.ident()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                break
            if self.peek() == ">":
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        self.types()
        self.need(">")

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def return_type(self) -> None:
        if self.peek() == "asserts" and (self.peek(1) in NAMES or self.peek(1) == "this"):
            self.i += 2
            if self.take("is"):
                self.type()
        elif (self.peek() in NAMES or self.peek() == "this") and self.peek(1) == "is":
            self.i += 2
            self.type()
        else:
            self.type()

    def type(self) -> None:
        self.union()
        if self.peek() == "extends" and not self.nl[self.i]:
            self.i += 1
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        self.take("|", "&")
        self.one_type()
        while self.take("|", "&"):
            self.one_type()

    def one_type(self) -> None:
        t = self.peek()
        if t in ("keyof", "unique", "readonly", "infer") and (self.peek(1) in KEYS or self.peek(1) in ("[]", "{}", "()")) and self.peek(1) not in ("extends", "is"):
            self.i += 1
            self.one_type()
            return
        if t == "typeof":
            self.i += 1
            self.i += 1
            while self.take("."):
                self.i += 1
        elif t == "new" or t == "abstract" and self.peek(1) == "new" or t == "<":
            self.take("abstract")
            self.take("new")
            self.type_parameters()
            self.inside("()", "params", "type_params")
            self.need("=>")
            self.return_type()
            return
        elif t == "()":
            if self.peek(1) == "=>":
                self.inside("()", "params", "type_params")
                self.need("=>")
                self.return_type()
                return
            self.inside("()", "type")
        elif t == "[]":
            self.inside("[]", "tuple")
        elif t == "{}":
            self.inside("{}", "members")
        elif t in ("s", "n", "t", "null", "void", "this", "true", "false"):
            self.i += 1
        elif t == "-":
            self.i += 1
            self.need("n")
        elif t == "import":
            self.i += 1
            self.inside("()", "args")
            while self.take("."):
                self.ident()
            if self.peek() == "<":
                self.type_arguments()
        elif t in NAMES:
            self.i += 1
            while self.take("."):
                self.i += 1
            if self.peek() == "<" and not self.nl[self.i]:
                self.type_arguments()
        else:
            raise Bad
        while self.peek() == "[]" and not self.nl[self.i]:
            if self.empty():
                self.i += 1
            else:
                self.inside("[]", "type")

    def type_params(self) -> None:
        self.params()

    def tuple(self) -> None:
        while self.i < len(self.t):
            self.take("...")
            if self.peek() in NAMES and (self.peek(1) == ":" or self.peek(1) == "?" and self.peek(2) == ":"):
                self.i += 1
                self.take("?")
                self.need(":")
            self.type()
            self.take("?")
            if self.i < len(self.t):
                self.need(",")

    def index_signature(self) -> None:
        self.ident()
        if not self.take(":", "in"):
            raise Bad
        self.type()
        if self.take("as"):
            self.type()

    def members(self) -> None:
        while self.i < len(self.t):
            if self.peek() in ("+", "-") and self.peek(1) == "readonly":
                self.i += 1
            while self.peek() in ("readonly", "get", "set", "new") and self.peek(1) not in (":", "?", "()", "<", ";", ",", "") or self.peek() == "new" and self.peek(1) in ("()", "<"):
                self.i += 1
            if self.peek() == "[]" and self.fits("index_signature"):
                self.i += 1
                if self.take("+", "-"):
                    pass
                self.take("?")
                self.need(":")
                self.type()
            else:
                if self.peek() not in ("()", "<"):
                    self.property_name()
                    self.take("?")
                if self.peek() in ("()", "<"):
                    self.signature()
                elif self.take(":"):
                    self.type()
            if not self.take(","):
                self.end()


Script.PARSER = ScriptParser


class Golang(Language):
    WORDS = tuple("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    PUNCT = tuple("... <<= >>= &^= && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ ; , + - * / % & | ^ < > = ! : . ~".split())
    LISTS = ("block",)
    TOKEN = re.compile(
        r"""[ \t\r]*(?:(?P<nl>\n)|(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<w>[^\W\d]\w*)"""
        r"""|(?P<n>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))"""
        r"""|(?P<s>"(?:[^"\\\n]|\\[abfnrtv\\"'xuU0-7])*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))')|(?P<b>[(){}\[\]])"""
        r"""|(?P<o>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[;,+\-*/%&|^<>=!:.~])|(?P<e>\Z))"""
    )

    def __init__(self) -> None:
        super().__init__()
        self.BREAK = self.code[";"]
        self.closers = set("ins") | {self.code[w] for w in ("break", "continue", "fallthrough", "return", "++", "--")}

    def lex(self, text: str) -> str:
        match, code, closers, semi = self.TOKEN.match, self.code, self.closers, self.code[";"]
        stack: list[tuple[str, list[str]]] = []
        out: list[str] = []
        at = 0
        while True:
            m = match(text, at)
            if m is None:
                raise Bad
            kind, at = m.lastgroup, m.end()
            if kind == "w":
                out.append(code.get(m.group("w"), "i"))
            elif kind == "o":
                out.append(code[m.group("o")])
            elif kind == "nl":
                if out and (out[-1] in closers or ord(out[-1][0]) >= GROUP):
                    out.append(semi)
            elif kind == "s" or kind == "n":
                out.append(kind)
            elif kind == "b":
                b = m.group("b")
                if b in "([{":
                    stack.append((b, out))
                    out = []
                else:
                    if not stack:
                        raise Bad
                    o, up = stack.pop()
                    if o + b not in ("()", "[]", "{}"):
                        raise Bad
                    up.append(self.intern(o, "".join(out)))
                    out = up
            elif kind == "c":
                if m.group("c").startswith("/*") and "\n" in m.group("c") and out and (out[-1] in closers or ord(out[-1][0]) >= GROUP):
                    out.append(semi)
            else:
                if stack:
                    raise Bad
                return "".join(out)


GO_ASSIGN = ("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=")
GO_BINARY = frozenset("&& || == != <= >= < > + - * / % & | ^ << >> &^".split())


class GoParser(Parser):
    #: Whether a brace after a name opens a literal (it doesn't in the head of if, for and switch).
    literal = True

    def separated(self, one) -> None:
        while self.i < len(self.t):
            one()
            if self.i < len(self.t):
                self.need(";")

    def commas(self, one) -> None:
        while self.i < len(self.t):
            one()
            if self.i < len(self.t):
                self.need(",")

    def file(self) -> None:
        self.need("package")
        self.need("i")
        first = True
        while self.i < len(self.t):
            self.need(";")
            if self.i >= len(self.t):
                return
            t = self.peek()
            if t == "import" and first:
                self.i += 1
                if self.peek() == "()":
                    self.inside("()", "import_list")
                else:
                    self.import_spec()
                continue
            first = False
            if t == "func":
                self.i += 1
                if self.peek() == "()":
                    self.inside("()", "parameters")
                self.need("i")
                if self.peek() == "[]":
                    self.inside("[]", "type_parameters")
                self.signature()
                if self.peek() == "{}":
                    self.inside("{}", "block")
            elif t in ("var", "const", "type"):
                self.declaration()
            elif t == ";":
                continue
            else:
                raise Bad

    def import_list(self) -> None:
        self.separated(self.import_spec)

    def import_spec(self) -> None:
        self.take("i", ".")
        self.need("s")

    def declaration(self) -> None:
        t = self.peek()
        self.i += 1
        if self.peek() == "()":
            self.inside("()", t + "_list")
        else:
            getattr(self, t + "_spec")()

    def var_list(self) -> None:
        self.separated(self.var_spec)

    def const_list(self) -> None:
        self.separated(self.const_spec)

    def type_list(self) -> None:
        self.separated(self.type_spec)

    def names(self) -> None:
        self.need("i")
        while self.take(","):
            self.need("i")

    def var_spec(self) -> None:
        self.names()
        if self.peek() != "=":
            self.type()
        if self.take("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.peek() in ("", ";"):
            return
        if self.peek() != "=":
            self.type()
        self.need("=")
        self.expressions()

    def type_spec(self) -> None:
        self.need("i")
        if self.peek() == "[]" and not self.empty() and self.fits("type_parameters"):
            self.i += 1
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        def one() -> None:
            self.need("i")
            while self.take(","):
                self.need("i")
            self.constraint()

        self.commas(one)

    def constraint(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    def signature(self) -> None:
        self.inside("()", "parameters")
        if self.peek() == "()":
            self.inside("()", "parameters")
        elif self.peek() in ("i", "*", "[]", "map", "chan", "<-", "func", "struct", "interface"):
            self.type()

    def parameters(self) -> None:
        def one() -> None:
            if self.take("..."):
                self.type()
                return
            plain = self.peek() == "i"
            if plain and self.peek(1) == "[]" and self.peek(2) not in ("", ","):
                self.i += 1
                self.type()
                return
            self.type()
            if self.i < len(self.t) and self.peek() != ",":
                if not plain:
                    raise Bad
                self.take("...")
                self.type()

        self.commas(one)

    def type(self) -> None:
        t = self.peek()
        if t == "i":
            self.i += 1
            if self.take("."):
                self.need("i")
            if self.peek() == "[]" and not self.empty() and self.fits("type_arguments"):
                self.i += 1
        elif t == "*":
            self.i += 1
            self.type()
        elif t == "[]":
            if self.empty():
                self.i += 1
            else:
                self.inside("[]", "length")
            self.type()
        elif t == "map":
            self.i += 1
            self.inside("[]", "type")
            self.type()
        elif t == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif t == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t == "struct":
            self.i += 1
            self.inside("{}", "fields")
        elif t == "interface":
            self.i += 1
            self.inside("{}", "methods")
        elif t == "()":
            self.inside("()", "type")
        else:
            raise Bad

    def type_arguments(self) -> None:
        self.commas(self.type)

    def length(self) -> None:
        if not self.take("..."):
            self.expression()

    def fields(self) -> None:
        def one() -> None:
            if self.peek() == "*" or self.peek() == "i" and self.peek(1) in ("", ";", ".", "s"):
                self.type()
            else:
                self.names()
                self.type()
            self.take("s")

        self.separated(one)

    def methods(self) -> None:
        def one() -> None:
            if self.peek() == "i" and self.peek(1) == "()":
                self.i += 1
                self.signature()
            else:
                self.constraint()

        self.separated(one)

    # statements

    def block(self) -> None:
        while self.i < len(self.t):
            if self.take(";"):
                continue
            self.statement()
            if self.i < len(self.t):
                self.need(";")

    def statement(self) -> None:
        t = self.peek()
        if t in ("var", "const", "type"):
            self.declaration()
        elif t == "{}":
            self.inside("{}", "block")
        elif t == "if":
            self.branch()
        elif t == "for":
            self.i += 1
            self.head(True)
            self.inside("{}", "block")
        elif t == "switch":
            self.i += 1
            self.head(False)
            self.inside("{}", "cases")
        elif t == "select":
            self.i += 1
            self.inside("{}", "cases")
        elif t in ("go", "defer"):
            self.i += 1
            self.expression()
        elif t == "return":
            self.i += 1
            if self.peek() not in ("", ";"):
                self.expressions()
        elif t in ("break", "continue", "goto"):
            self.i += 1
            self.take("i")
        elif t == "fallthrough":
            self.i += 1
        elif t == "i" and self.peek(1) == ":":
            self.i += 2
            if self.peek() not in ("", ";"):
                self.statement()
        else:
            self.simple()

    def branch(self) -> None:
        self.need("if")
        self.head(False, True)
        self.inside("{}", "block")
        if self.take("else"):
            if self.peek() == "if":
                self.branch()
            else:
                self.inside("{}", "block")

    def head(self, loop: bool, must: bool = False) -> None:
        self.literal = False
        try:
            if self.peek() == "{}":
                if must:
                    raise Bad
                return
            if loop and self.take("range"):
                self.expression()
                return
            if self.peek() != ";":
                self.simple(True)
            if self.take(";"):
                if self.peek() not in ("{}", ";"):
                    self.simple(True)
                elif must:
                    raise Bad
                if loop:
                    self.need(";")
                    if self.peek() != "{}":
                        self.simple()
        finally:
            self.literal = True

    def simple(self, head: bool = False) -> None:
        self.expressions()
        if self.peek() in GO_ASSIGN:
            self.i += 1
            self.take("range")
            self.expressions()
        elif self.take("++", "--"):
            pass
        elif self.take("<-"):
            self.expression()

    def cases(self) -> None:
        if self.i < len(self.t) and self.peek() not in ("case", "default"):
            raise Bad
        while self.i < len(self.t):
            if self.take(";"):
                continue
            if self.take("case"):
                if not self.attempt(self.case_types):
                    self.simple()
                    self.need(":")
            elif self.take("default"):
                self.need(":")
            else:
                self.statement()
                if self.i < len(self.t) and self.peek() not in ("case", "default"):
                    self.need(";")

    def case_types(self) -> None:
        self.type()
        while self.take(","):
            self.type()
        self.need(":")

    # expressions

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.take(*GO_BINARY):
            self.unary()

    def unary(self) -> None:
        while self.take("+", "-", "!", "^", "*", "&", "<-", "~"):
            pass
        self.primary()

    def primary(self) -> None:
        t = self.peek()
        if t in ("i", "n", "s"):
            self.i += 1
        elif t == "()":
            self.inside("()", "one", "type")
        elif t == "func":
            self.i += 1
            self.signature()
            if self.peek() == "{}":
                self.inside("{}", "block")
        elif t in ("[]", "map", "struct", "chan", "interface"):
            self.type()
            if self.peek() == "{}":
                self.inside("{}", "elements")
            elif self.peek() != "()":
                if t not in ("[]", "map", "chan", "interface", "struct") or self.peek() not in ("", ","):
                    raise Bad
        else:
            raise Bad
        while True:
            u = self.peek()
            if u == ".":
                self.i += 1
                if self.peek() == "()":
                    self.inside("()", "type", "type_word")
                else:
                    self.need("i")
            elif u == "[]":
                self.inside("[]", "index", "type_arguments")
            elif u == "()":
                self.inside("()", "args")
            elif u == "{}" and t == "i" and self.literal:
                self.inside("{}", "elements")
            else:
                return

    def type_word(self) -> None:
        self.need("type")

    def one(self) -> None:
        self.expression()

    def index(self) -> None:
        if self.i >= len(self.t):
            raise Bad
        for k in range(3):
            if self.peek() not in ("", ":"):
                self.expression()
            if not self.take(":"):
                return

    def args(self) -> None:
        def one() -> None:
            if not self.attempt(self.expression_end):
                self.type()
            self.take("...")

        self.commas(one)

    def expression_end(self) -> None:
        self.expression()
        if self.peek() not in ("", ",", "..."):
            raise Bad

    def elements(self) -> None:
        def one() -> None:
            for k in range(2):
                if self.peek() == "{}":
                    self.inside("{}", "elements")
                else:
                    self.expression()
                if k or not self.take(":"):
                    return

        self.commas(one)


Golang.PARSER = GoParser

JS, TS, GO = Script(False), Script(True), Golang()
