"""A Java text as a flat list of nodes: declarations, statements and expressions, found by balanced brackets; each node has a parent."""

from __future__ import annotations

import re
from bisect import bisect_right

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<lit>\"\"\".*?(?<!\\)\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'|\d[\w.]*|(?:true|false|null)\b)
    |(?P<id>[^\W\d][\w$]*)|(?P<op>->|::|[=!<>]=|&&|\|\||\+\+|--|[-+*/%&|^]=|.)""",
    re.S | re.X,
)
_MODIFIERS = set("public protected private static final abstract default synchronized native strictfp transient volatile sealed".split())
_TYPES = {"class", "interface", "enum", "record"}
_BINARY = set("+ - * / % == != <= >= && || & | ^ < > instanceof".split())
_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: Expressions nested deeper than this are kept as text.
DEEPEST = 150

#: node, parent, method it is in, role, ordinal, kind, name, text, line
Node = tuple[int, int | None, int | None, str | None, int, str, str | None, str | None, int]


class _Scan:
    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.words = [t[1] for t in self.tokens]
        self.ends: dict[int, int] = {}  # the token that closes a bracket
        open_at: list[int] = []
        for i, w in enumerate(self.words):
            if self.tokens[i][0] == "op":
                if w in _CLOSES:
                    open_at.append(i)
                elif w in ")]}" and open_at:
                    self.ends[open_at.pop()] = i
        self.opens = {end: begin for begin, end in self.ends.items()}
        for i in open_at:
            self.ends[i] = len(self.words)
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.out: list[Node] = []
        self.method: int | None = None

    def add(self, parent: int | None, role: str | None, ordinal: int, kind: str, name: str | None, text: str | None, at: int) -> int:
        line = bisect_right(self.starts, self.tokens[at][2]) if at < len(self.tokens) else len(self.starts)
        self.out.append((len(self.out), parent, self.method, role, ordinal, kind, name, text, line))
        return len(self.out) - 1

    def slice(self, i: int, j: int) -> str:
        return re.sub(r"\s+", " ", self.text[self.tokens[i][2] : self.tokens[j - 1][3]]) if i < j else ""

    def at_depth(self, i: int, j: int):
        """The tokens of a stretch outside of all brackets in it."""
        while i < j:
            yield i
            i = self.ends[i] + 1 if i in self.ends else i + 1

    def word(self, i: int) -> str:
        return self.words[i] if i < len(self.words) else ""

    def is_id(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] == "id"

    def type_end(self, i: int) -> int | None:
        """What follows a type that begins here."""
        if not self.is_id(i):
            return None
        i += 1
        while self.word(i) == "." and self.is_id(i + 1):
            i += 2
        if self.word(i) == "<":
            depth = 0
            while i < len(self.words):
                w = self.words[i]
                depth += (w == "<") - (w == ">")
                if not (self.is_id(i) or w in "<>,.?&[]"):
                    return None
                i += 1
                if not depth:
                    break
        while self.word(i) == "[" and self.word(i + 1) == "]":
            i += 2
        return i

    # ---- declarations

    def unit(self) -> list[Node]:
        i = 0
        while i < len(self.words):
            if self.words[i] in ("package", "import"):
                end = next((k for k in range(i, len(self.words)) if self.words[k] == ";"), len(self.words))
                names = [w for w in self.words[i + 1 : end] if w != "static"]
                if names and names[-1] != "*":
                    self.add(None, "static" if self.word(i + 1) == "static" else None, len(self.out), self.words[i], "".join(names), None, i)
                i = end + 1
            else:
                i = self.member(None, None, i, len(self.words))
        return self.out

    def member(self, owner: int | None, outer: str | None, i: int, end: int) -> int:
        """One declaration of a class body, or a type of the file; what follows it."""
        override = False
        while i < end and (self.words[i] in _MODIFIERS or self.words[i] == "@" or (self.words[i] == "non" and self.word(i + 1) == "-")):
            if self.words[i] == "@" and self.word(i + 1) != "interface":
                override |= self.word(i + 1) == "Override"
                i += 2
                while self.word(i) == "." and self.is_id(i + 1):
                    i += 2
                i = self.ends[i] + 1 if self.word(i) == "(" else i
            else:
                i += 3 if self.words[i] == "non" else 1
        if i >= end:
            return end
        if self.words[i] in _TYPES and self.is_id(i + 1):
            name = self.words[i + 1] if outer is None else f"{outer}${self.words[i + 1]}"
            body = next((k for k in self.at_depth(i + 2, end) if self.words[k] == "{"), end)
            heads = [k for k in range(i + 2, body) if self.words[k] == "extends"]
            above = self.word(heads[0] + 1) if heads and self.words[i] == "class" else None
            node = self.add(owner, None, len(self.out), "class", name, above, i)
            k, last = body + 1, self.ends.get(body, end)
            while k < last:
                k = self.member(node, name, k, last)
            return last + 1
        if self.words[i] in "{;}":
            return self.ends[i] + 1 if i in self.ends else i + 1
        if self.words[i] == "<":
            while i < end and self.words[i] != ">":
                i += 1
            i += 1
        kind_end = self.type_end(i)
        name = kind_end if kind_end is not None and self.is_id(kind_end) else i
        stop = next((k for k in self.at_depth(i, end) if self.words[k] in ";{=("), end)
        if owner is None or not self.is_id(name):
            return self.ends[stop] + 1 if stop in self.ends else stop + 1
        if self.word(name + 1) == "(":
            node = self.add(owner, "override" if override else None, len(self.out), "method", self.words[name], self.slice(i, name) or None, name)
            self.method = node
            self.parameters(node, name + 2, self.ends[name + 1])
            body = next((k for k in self.at_depth(self.ends[name + 1] + 1, end) if self.words[k] in "{;"), end)
            last = self.ends.get(body, body)
            if body in self.ends:
                self.statements(node, body + 1, last)
            self.method = None
            return last + 1
        last = next((k for k in self.at_depth(i, end) if self.words[k] == ";"), end)
        if name != i:
            self.add(owner, None, len(self.out), "field", self.words[name], self.slice(i, name), name)
        return last + 1

    def parameters(self, method: int, i: int, end: int) -> None:
        n, begin, depth = 0, i, 0
        for k in [*self.at_depth(i, end), end]:
            w = self.word(k) if k < end else ","
            depth += (w == "<") - (w == ">")
            if w == "," and (depth <= 0 or k == end):
                words = [x for x in range(begin, k) if self.is_id(x) and self.words[x] not in _MODIFIERS]
                if len(words) > 1:
                    self.add(method, None, n, "param", self.words[words[-1]], self.slice(words[0], words[-1]), words[-1])
                    n += 1
                begin = k + 1

    # ---- statements

    def statements(self, method: int, i: int, end: int) -> None:
        n = 0
        while i < end:
            w = self.words[i]
            if w in "{};" or w in ("else", "do", "finally", "final") or w in _MODIFIERS:
                i += 1
            elif w == "@":
                i = self.ends[i + 2] + 1 if self.word(i + 2) == "(" else i + 2
            elif w in ("if", "while", "for", "switch", "synchronized", "catch", "try"):
                if self.word(i + 1) != "(":
                    i += 1
                    continue
                i = self.ends[i + 1] + 1
            elif w in ("case", "default") and w != self.word(i + 1):
                i = next((k for k in self.at_depth(i, end) if self.words[k] in (":", "->")), end) + 1
            elif w in _TYPES and self.is_id(i + 1):
                body = next((k for k in self.at_depth(i, end) if self.words[k] == "{"), end)
                i = self.ends.get(body, end) + 1
            else:
                last = next((k for k in self.at_depth(i, end) if self.words[k] == ";"), end)
                first = i + 1 if w in ("return", "throw", "assert", "yield") else i
                kind_end = self.type_end(first) if first == i else None
                if w == "return" and first < last:
                    self.expression(self.add(method, None, n, "return", None, None, i), "value", 0, first, last)
                elif first == i and kind_end is not None and self.is_id(kind_end) and self.word(kind_end + 1) in ("=", ";", ","):
                    node = self.add(method, None, n, "local", self.words[kind_end], self.slice(i, kind_end), i)
                    if self.word(kind_end + 1) == "=":
                        stop = next((k for k in self.at_depth(kind_end + 2, last) if self.words[k] == ","), last)
                        self.expression(node, "init", 0, kind_end + 2, stop)
                elif first == i and not any(self.words[k] == "=" for k in self.at_depth(i, last)):
                    self.expression(self.add(method, None, n, "statement", None, None, i), "value", 0, i, last)
                n += 1
                i = last + 1

    # ---- expressions

    def expression(self, parent: int, role: str, ordinal: int, i: int, j: int, depth: int = 0) -> None:
        put = lambda kind, name=None: self.add(parent, role, ordinal, kind, name, self.slice(i, j), i)
        go = lambda node, r, n, a, b: self.expression(node, r, n, a, b, depth + 1)
        if self.word(i) == "this" and self.word(i + 1) == "." and i + 2 < j:
            i += 2
        if i >= j or depth > DEEPEST:
            put("other")
            return
        w, outside = self.words[i], list(self.at_depth(i, j))
        here = [self.words[k] for k in outside]
        if j - i == 1:
            put("literal" if self.tokens[i][0] == "lit" else "ident" if self.tokens[i][0] == "id" else "other", w)
        elif "->" in here or "=" in here or "::" in here:
            put("other")
        elif w == "new":
            put("new")
        elif "?" in here:
            q, level, colon = outside[here.index("?")], 0, j
            for k in outside[here.index("?") + 1 :]:
                level += (self.words[k] == "?") - (self.words[k] == ":")
                if level < 0:
                    colon = k
                    break
            node = put("ternary")
            go(node, "then", 0, q + 1, colon)
            go(node, "else", 1, colon + 1, j)
        elif w == "-" and j - i == 2 and self.tokens[i + 1][0] == "lit":
            put("literal")
        elif any(x in _BINARY for x in here[1:]):
            put("binary")
        elif w == "(" and self.ends[i] == j - 1:
            go(put("paren"), "inner", 0, i + 1, j - 1)
        elif w == "(" and self.ends[i] < j - 1 and self.type_end(i + 1) == self.ends[i] and (self.tokens[self.ends[i] + 1][0] != "op" or self.words[self.ends[i] + 1] == "("):
            go(put("cast"), "inner", 0, self.ends[i] + 1, j)
        else:
            self.chain(put, go, i, j)

    def chain(self, put, go, i: int, j: int) -> None:
        """A call or a member, of what stands before its last dot."""
        last = j - 1
        begin = self.opens.get(last) if self.words[last] == ")" else None
        call = begin is not None
        name = begin - 1 if begin is not None else last
        if not self.is_id(name) or (name > i and self.words[name - 1] != "."):
            put("other")
            return
        node = put("call" if call else "member", self.words[name])
        if name > i:
            go(node, "receiver", 0, i, name - 1)
        if begin is not None and begin + 1 < last:
            n, first = 0, begin + 1
            for k in [*self.at_depth(begin + 1, last), last]:
                if k == last or self.words[k] == ",":
                    go(node, "arg", n, first, k)
                    n, first = n + 1, k + 1


def java_nodes(text: str) -> list[Node]:
    """The nodes of a Java text, parents before children; of a text that isn't valid, what is found in it.

    Kinds: package, import (without those of all members); class (``Outer$Inner``; text: what it extends), field, method (text: type; role ``override``),
    param, local; return, statement; and the expressions literal, ident, call, member, ternary, paren, cast, new, binary and other, with the roles value,
    init, receiver, arg, then, else, inner. Lambdas, assignments and anonymous classes are not looked into.
    """
    return _Scan(text.replace("\r", "")).unit()
