"""TypeScript, JavaScript and Go sources as tokens with matched brackets: definitions, imports and calls, in one forward
scan of a file, nested and unclosed code included.

Comments are dropped. A template string's literal parts are strings, what stands in `${}` are tokens of their own. A
bracket without its partner ends with the file. Rows, as of the Python extractor: the first definition of a name counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

SUFFIXES = {".ts": "ts", ".tsx": "ts", ".js": "ts", ".jsx": "ts", ".go": "go", ".py": "py"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))+")
_ID = re.compile(r"[^\W\d][\w$]*|[$#][\w$]*")
_NUM = re.compile(r"\.?\d[\w.]*")
_STR = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?")
_RAW = re.compile(r"`[^`]*`?")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OP = re.compile(r"\.\.\.|=>|:=|[=!]==?|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|->|<-|\?\.|\S")
#: Words after which a slash begins a regular expression, and which never name what is called.
_BOTH = "return case break continue if else for switch func function import default"
WORDS = {"ts": frozenset(f"{_BOTH} typeof in of delete void throw new await yield while catch export with super const let var".split()), "go": frozenset(f"{_BOTH} go defer select range type struct map chan interface var const".split())}


def language(path: str) -> str | None:
    """py, ts (JavaScript, too) or go by a path's suffix."""
    return SUFFIXES.get("." + path.rsplit(".", 1)[-1].lower())


class Token(NamedTuple):
    kind: str  # id, num, str, op
    text: str
    line: int


class Source:
    """Tokens of a file, and for each bracket the place of its partner (the number of tokens, if it has none)."""

    def __init__(self, code: str, lang: str):
        self.lang, self.words = lang, WORDS[lang]
        self.tokens: list[Token] = []
        self._scan(code)
        self.end = len(self.tokens)
        self.headers: set[int] = set()  # names of methods where they are defined
        self.close: dict[int, int] = {}
        stack: list[int] = []
        waiting = dict.fromkeys(_OPEN, 0)
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in _OPEN:
                stack.append(i)
                waiting[t.text] += 1
            elif t.text in _CLOSE and waiting[_CLOSE[t.text]]:
                while True:
                    k = stack.pop()
                    waiting[self.tokens[k].text] -= 1
                    self.close[k] = i
                    if self.tokens[k].text == _CLOSE[t.text]:
                        break

    def _scan(self, s: str) -> None:
        at, line, n, out = 0, 1, len(s), self.tokens
        braces: list[int] = []  # of each open template's `${`, how many braces are open in it
        no_regex = -1  # up to here a slash is known not to begin a regular expression

        def add(kind: str, end: int) -> None:
            nonlocal at, line
            out.append(Token(kind, s[at:end], line))
            line += s.count("\n", at, end)
            at = end

        def template() -> None:
            """The literal part that begins at `at`, up to the end of the template or its next `${`."""
            nonlocal at
            add("str", _TEMPLATE.match(s, at).end())
            if s.startswith("${", at):
                at += 2
                braces.append(0)
                out.append(Token("op", "+", line))
            else:
                at += 1

        while at < n:
            m = _SPACE.match(s, at)
            if m:
                line += s.count("\n", at, m.end())
                at = m.end()
                continue
            c = s[at]
            if c in "\"'":
                add("str", _STR.match(s, at).end())
            elif c == "`" and self.lang == "go":
                add("str", _RAW.match(s, at).end())
            elif c == "`":
                at += 1
                template()
            elif c == "}" and braces and braces[-1] == 0:
                braces.pop()
                out.append(Token("op", "+", line))
                at += 1
                template()
            elif (m := _ID.match(s, at)) is not None:
                add("id", m.end())
            elif (m := _NUM.match(s, at)) is not None:
                add("num", m.end())
            else:
                if c == "/" and self.lang == "ts" and at >= no_regex:
                    before = out[-1] if out else None
                    if before is None or (before.kind == "op" and before.text not in (")", "]", "}")) or before.text in self.words:
                        m = _REGEX.match(s, at)
                        if m:
                            add("str", m.end())
                            continue
                        no_regex = s.find("\n", at) % (n + 1)
                if braces:
                    braces[-1] += (c == "{") - (c == "}")
                add("op", _OP.match(s, at).end())

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < self.end else ""

    def partner(self, i: int) -> int:
        return self.close.get(i, self.end)

    def line(self, i: int) -> int:
        return self.tokens[min(i, self.end - 1)].line if self.end else 1

    def parts(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """What commas of the outermost level separate between two places; none if there is nothing."""
        out, start, i = [], lo, lo
        while i < hi:
            if self.text(i) in _OPEN and self.tokens[i].kind == "op":
                i = self.partner(i)
            elif self.text(i) == "," and self.tokens[i].kind == "op":
                out.append((start, i))
                start = i + 1
            i += 1
        return [*out, (start, hi)] if start < hi else out


class Definition(NamedTuple):
    name: str
    kind: str
    start: int  # tokens, the last included
    end: int
    body: tuple[int, int]  # what stands inside its braces
    params: list[list[str]]  # names that each parameter binds
    parent: str | None


def _names(src: Source, lo: int, hi: int) -> list[str]:
    """Names that a parameter binds: all of a pattern, else the first that isn't a modifier."""
    if src.text(lo) in ("{", "["):
        return [t.text for t in src.tokens[lo : src.partner(lo)] if t.kind == "id"]
    words = [t.text for t in src.tokens[lo:hi] if t.kind == "id" and t.text not in ("public", "private", "protected", "readonly", "override")]
    return words[:1]


def _params(src: Source, at: int) -> list[list[str]]:
    return [_names(src, lo, hi) for lo, hi in src.parts(at + 1, src.partner(at))]


def _body(src: Source, i: int) -> int:
    """Place of the brace that opens a body after place i, or -1 if a statement ends before."""
    while i < src.end:
        t = src.text(i)
        if t == "{":
            before = src.text(i - 1)
            if before in (":", "|", "&", "<", "interface", "struct") or src.text(src.partner(i) + 1) == "{":  # a type
                i = src.partner(i) + 1
                continue
            return i
        if t in ("(", "["):
            i = src.partner(i)
        elif t == ";":
            return -1
        i += 1
    return -1


def _arrow(src: Source, i: int) -> tuple[list[list[str]], tuple[int, int], int] | None:
    """Parameters, body and last place of the arrow or function that begins at place i."""
    if src.text(i) == "async":
        i += 1
    if src.text(i) == "function":
        while i < src.end and src.text(i) != "(":
            i += 1
        at = _body(src, src.partner(i) + 1)
        return (_params(src, i), (at + 1, src.partner(at)), src.partner(at)) if at >= 0 else None
    if src.text(i) == "(":
        params, k = _params(src, i), src.partner(i) + 1
        while k < src.end and src.text(k) not in ("=>", ";", "{", "}", ")", "=", ","):
            k += 1
    elif i < src.end and src.tokens[i].kind == "id":
        params, k = [[src.text(i)]], i + 1
    else:
        return None
    if src.text(k) != "=>":
        return None
    if src.text(k + 1) == "{":
        return params, (k + 2, src.partner(k + 1)), src.partner(k + 1)
    end = statement_end(src, k + 1, src.end)
    return params, (k + 1, end), end - 1


def statement_end(src: Source, i: int, hi: int) -> int:
    """Where an expression that begins at place i ends: at a comma or semicolon of its level, a closing bracket, or a line
    that neither continues nor is continued."""
    first = i
    while i < hi:
        t = src.tokens[i]
        if i > first and t.line > src.tokens[i - 1].line:
            before = src.tokens[i - 1]
            goes_on = before.kind == "op" and before.text not in (")", "]", "}", "++", "--")
            comes_on = t.kind == "op" and t.text not in ("{", "}", "(", "[", "++", "--", "!")
            if not goes_on and not comes_on:
                return i
        if t.kind == "op":
            if t.text in _OPEN:
                i = src.partner(i)
            elif t.text in _CLOSE or t.text in (";", ","):
                return i
        i += 1
    return hi


def _methods(src: Source, at: int, parent: str) -> list[Definition]:
    """Methods of the class whose braces open at place at."""
    out, i, end = [], at + 1, src.partner(at)
    while i < end:
        t = src.tokens[i]
        if t.kind == "id" and src.text(i + 1) in ("(", "<"):
            k = i + 1
            while k < end and src.text(k) != "(":
                k += 1
            body = _body(src, src.partner(k) + 1)
            if body < 0 or body > end:
                i = src.partner(k) + 1
                continue
            start = i
            src.headers.add(i)
            while src.text(start - 1) in ("async", "static", "public", "private", "protected", "get", "set", "override", "*"):
                start -= 1
            if t.text != "constructor" and not t.text.startswith("#"):
                out.append(Definition(t.text, "method", start, src.partner(body), (body + 1, src.partner(body)), _params(src, k), parent))
            i = src.partner(body) + 1
        elif src.text(i) in _OPEN:
            i = src.partner(i) + 1
        else:
            i += 1
    return out


def _ts(src: Source) -> list[Definition]:
    out, i = [], 0
    while i < src.end:
        word, start = src.text(i), i
        if word in _OPEN and src.tokens[i].kind == "op":
            i = src.partner(i) + 1
            continue
        while start and src.text(start - 1) in ("export", "default", "async", "declare", "abstract"):
            start -= 1
        name = src.text(i + 1) if word != "function" or src.text(i + 1) != "*" else src.text(i + 2)
        named = bool(_ID.fullmatch(name)) and src.tokens[i].kind == "id" and src.text(i - 1) != "."
        if word == "class" and named:
            at = i
            while at < src.end and src.text(at) != "{":
                at += 1
            out.append(Definition(name, "class", start, src.partner(at), (at + 1, src.partner(at)), [], None))
            out += _methods(src, at, name)
            i = src.partner(at) + 1
        elif word == "function" and named:
            at = i
            while at < src.end and src.text(at) != "(":
                at += 1
            body = _body(src, src.partner(at) + 1)
            last = src.partner(body) if body >= 0 else src.partner(at)
            out.append(Definition(name, "function", start, last, (body + 1, last) if body >= 0 else (last, last), _params(src, at), None))
            i = last + 1
        elif word in ("interface", "type") and named and (word == "interface" or src.text(i + 2) in ("=", "<")):
            at = i
            while word == "interface" and at < src.end and src.text(at) != "{":
                at += 1
            last = src.partner(at) if word == "interface" else statement_end(src, i, src.end) - 1
            out.append(Definition(name, word, start, last, (last, last), [], None))
            i = last + 1
        elif word in ("const", "let") and named:
            at = i + 2
            while at < src.end and src.text(at) not in ("=", ";") and src.line(at) == src.line(i):
                at = src.partner(at) + 1 if src.text(at) in _OPEN else at + 1
            made = _arrow(src, at + 1) if src.text(at) == "=" else None
            if made:
                out.append(Definition(name, "function", start, made[2], made[1], made[0], None))
                i = made[2] + 1
            else:
                last = statement_end(src, at + 1, src.end) - 1 if src.text(at) == "=" else at - 1
                out.append(Definition(name, "const", start, last, (last, last), [], None))
                i = at + 1
        else:
            i += 1
    return out


def _go(src: Source) -> list[Definition]:
    out, i = [], 0
    while i < src.end:
        word = src.text(i)
        if word in _OPEN and src.tokens[i].kind == "op":
            i = src.partner(i) + 1
            continue
        if word == "func" and (src.text(i + 1) == "(" or _ID.fullmatch(src.text(i + 1))):
            at, parent = i + 1, None
            if src.text(at) == "(":
                own = [t.text for t in src.tokens[at + 1 : src.partner(at)] if t.kind == "id"]
                parent, at = own[1] if len(own) > 1 else (own or [None])[0], src.partner(at) + 1
            name, k = src.text(at), at
            while k < src.end and src.text(k) != "(":
                k += 1
            body = _body(src, src.partner(k) + 1)
            last = src.partner(body) if body >= 0 else src.partner(k)
            if name:
                out.append(Definition(name, "method" if parent else "function", i, last, (body + 1, last) if body >= 0 else (last, last), _params(src, k), parent))
            i = last + 1
        elif word in ("type", "const", "var"):
            at = i + 2 if src.text(i + 1) == "(" else i + 1
            name, made = src.text(at), src.text(at + 1)
            kind = {"type": {"struct": "class", "interface": "interface"}.get(made, "type"), "const": "const", "var": "variable"}[word]
            last = src.partner(i + 1) if src.text(i + 1) == "(" else src.partner(at + 2) if kind in ("class", "interface") else statement_end(src, i, src.end) - 1
            if _ID.fullmatch(name):
                out.append(Definition(name, kind, i, last, (last, last), [], None))
            i = max(last, i) + 1
        else:
            i += 1
    return out


def definitions(src: Source) -> list[Definition]:
    """Definitions in file order, the first of each name."""
    found: dict[str, Definition] = {}
    for d in _go(src) if src.lang == "go" else _ts(src):
        found.setdefault(d.name, d)
    return list(found.values())


def imports(src: Source) -> list[tuple[str, str]]:
    """(alias, module) of a file's imports; in TypeScript the module stands for both."""
    out = []
    for i, t in enumerate(src.tokens):
        if t.text != "import" or t.kind != "id":
            continue
        if src.lang == "go":
            lo, hi = (i + 2, src.partner(i + 1)) if src.text(i + 1) == "(" else (i + 1, min(i + 3, src.end))
            for k in range(lo, hi):
                if src.tokens[k].kind == "str":
                    module = src.text(k).strip("\"'`")
                    alias = src.text(k - 1) if k > lo and src.tokens[k - 1].line == src.tokens[k].line and src.tokens[k - 1].kind == "id" else module.rsplit("/", 1)[-1]
                    out.append((alias, module))
                    if lo == i + 1:
                        break
        elif src.text(i + 1) != "(":
            k = i + 1
            while k < src.end and src.tokens[k].kind != "str" and src.text(k) not in (";", "("):
                k = src.partner(k) + 1 if src.text(k) == "{" else k + 1
            if k < src.end and src.tokens[k].kind == "str":
                module = src.text(k).strip("\"'`")
                out.append((module, module))
    return out


def is_call(src: Source, i: int) -> bool:
    """Whether the name at place i is called (type arguments aside)."""
    return src.tokens[i].kind == "id" and src.text(i + 1) == "(" and src.text(i) not in src.words and i not in src.headers and src.text(i - 1) not in ("function", "func")


def symbols(path: str, code: str) -> list[tuple]:
    """(path, name, kind, start, end, parent, signature, calls) of a file's definitions."""
    src = Source(code, language(path))
    found, lines, out = definitions(src), code.split("\n"), []
    called = [i for i in range(src.end) if is_call(src, i)]
    for d in found:
        start, end = src.line(d.start), src.line(d.end)
        calls = dict.fromkeys(src.text(i) for i in called[bisect_left(called, d.body[0]) : bisect_left(called, d.body[1])])
        out.append((path, d.name, d.kind, start, end, d.parent, lines[start - 1].strip()[:200], list(calls)))
    return out
