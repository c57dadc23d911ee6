"""JSON texts (RFC 8259) as flat lists of nodes, without recursion."""

from __future__ import annotations

import json
import re

STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_TOKEN = re.compile(rf"[ \t\r\n]*(?:([{{}}\[\]:,])|({STRING})|({NUMBER})(?![0-9A-Za-z.+-])|(true|false|null)(?![0-9A-Za-z]))")
_BLANK_END = re.compile(r"[ \t\r\n]*\Z")


def text_of(token: str) -> str:
    """The text that a string token stands for; half a surrogate pair becomes a question mark."""
    if "\\" not in token:
        return token[1:-1]
    value = json.loads(token)
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", value) else value


def nodes(text: str) -> list[tuple[int, int | None, str | None, int, str, str | None]] | None:
    """(node, parent, label, ordinal, kind, scalar) of every value in document order; None if the text isn't valid JSON.

    Of members of one object with the same label, the last counts; the others are left out with all that is in them.
    """
    out: list = []
    stack: list[tuple[int, str]] = []  # open containers
    counts: dict[int, int] = {}
    labels: dict[int, dict[str, int]] = {}
    dead: set[int] = set()
    label: str | None = None
    at, want = 0, "value"  # value | value] | label | label} | colon | end
    match = _TOKEN.match
    while True:
        m = match(text, at)
        if m is None:
            break
        at, which = m.end(), m.lastindex
        token = m[which]
        if which == 1 and token in ":,}]":
            if token == ":":
                if want != "colon":
                    return None
                want = "value"
            elif token == ",":
                if want != "end" or not stack:
                    return None
                want = "label" if stack[-1][1] == "object" else "value"
            else:
                kind = "object" if token == "}" else "array"
                if not stack or stack[-1][1] != kind or want not in ("end", "label}" if token == "}" else "value]"):
                    return None
                stack.pop()
                want = "end"
            continue
        if want in ("label", "label}"):
            if which != 2:
                return None
            label, want = text_of(token), "colon"
            continue
        if want not in ("value", "value]"):
            return None
        node, parent = len(out), stack[-1][0] if stack else None
        if parent is not None:
            ordinal = counts[parent]
            counts[parent] = ordinal + 1
            if stack[-1][1] == "object":
                known = labels[parent]
                if label in known:
                    dead.add(known[label])
                known[label] = node
            else:
                label = None
        else:
            ordinal, label = 0, None
        if which == 1:
            kind, scalar = ("object", None) if token == "{" else ("array", None)
            stack.append((node, kind))
            counts[node] = 0
            if kind == "object":
                labels[node] = {}
            want = "label}" if kind == "object" else "value]"
        else:
            kind = "string" if which == 2 else "number" if which == 3 else "null" if token == "null" else "boolean"
            scalar = text_of(token) if which == 2 else token
            want = "end"
        out.append((node, parent, label, ordinal, kind, scalar))
    if stack or want != "end" or not out or not _BLANK_END.match(text, at):
        return None
    if dead:
        for node, parent, *_ in out:
            if parent in dead:
                dead.add(node)
        out = [x for x in out if x[0] not in dead]
    return out
