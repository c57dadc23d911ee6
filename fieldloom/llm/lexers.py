"""Source texts as tokens (kind, offset). What is no token is one of kind ERROR; ``MARKER`` is a line of a merge conflict."""

from __future__ import annotations

import re

from fieldloom.functions.jsontokens import NUMBER, STRING

_MARK = r"(?m:^)(?:<{7}|={7}|>{7}|\|{7})(?![<=>|])[^\n]*"

# fixed by the language
JAVA_WORDS = set(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto
    if implements import instanceof int interface long native new package private protected public return short static strictfp super switch
    synchronized this throw throws transient try void volatile while _ record sealed permits yield open module requires transitive exports opens
    to uses provides with non-sealed""".split()
)
_ESCAPE = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|[0-3][0-7]{2})"
_DIGITS = r"[0-9](?:[0-9_]*[0-9])?"
_JAVA = re.compile(
    rf"""(?P<skip>[ \t\f\r\n]+|//[^\r\n]*|/\*.*?\*/)
    |(?P<mark>{_MARK})
    |(?P<lit>\"\"\"[ \t\f]*\r?\n(?:[^\\"]|{_ESCAPE}|\\\r?\n|"(?!""))*\"\"\"|"(?!"")(?:[^"\\\r\n]|{_ESCAPE})*"|'(?:[^'\\\r\n]|{_ESCAPE})'
      |0[xX](?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?\.?(?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?[pP][+-]?{_DIGITS}[fFdD]?
      |0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?
      |(?:{_DIGITS}\.(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?[fFdD]?|{_DIGITS}[eE][+-]?{_DIGITS}[fFdD]?|{_DIGITS}[lLfFdD]?)
    |(?P<word>non-sealed(?![\w$])|(?:[^\W\d]|\$)[\w$]*)
    |(?P<op>>(?=[>=]*>)|\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~?:;,.@(){{}}\[\]])
    |(?P<open>/\*.*|\"\"\".*|"[^\r\n]*|'[^\r\n]*)
    |(?P<bad>.)""",
    re.S | re.X,
)
_UNICODE = re.compile(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})")


def only_closing(text: str) -> bool:
    """Whether all lines that look like markers of a conflict are such of seven ``>``."""
    return not re.search(r"(?m:^)(?:<{7}|={7}|\|{7})(?![<=>|])", text)


def java(text: str, markers: bool = True) -> list[tuple[str, int]]:
    """Tokens of a Java text; a ``>`` right before another one is of kind ``>+``. Unicode escapes are read first, as the language has it.

    markers: whether seven ``>`` at the begin of a line are a marker; else they are operators.
    """
    if "\\u" in text:
        text = _UNICODE.sub(lambda m: m[1] + chr(int(m[2], 16)), text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    out = []
    if text.endswith("\x1a"):
        text = text[:-1]
    for m in _JAVA.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "word":
            token = m[0]
            out.append((token if token in JAVA_WORDS else "LIT" if token in ("true", "false", "null") else "ID", m.start()))
        elif kind == "op":
            token = m[0]
            out.append((">+" if token == ">" and text[m.end() : m.end() + 1] in (">", "=") else token, m.start()))
        elif kind == "lit":
            out.append(("LIT", m.start()))
        elif kind == "mark":
            if m[0][0] == ">" and not markers:
                out.extend((">+" if i < m.end() - 1 and text[i + 1] == ">" else ">", i) for i in range(m.start(), m.start() + 7))
                out.extend((k, i + m.start() + 7) for k, i in java(m[0][7:]))
            else:
                out.append(("MARKER", m.start()))
        else:
            out.append(("ERROR", m.start()))
    return out


_JSON = re.compile(rf"(?P<skip>[ \t\r\n]+)|(?P<string>{STRING})|(?P<scalar>(?:{NUMBER}|true|false|null)(?![\w.+-]))|(?P<op>[{{}}\[\]:,])|(?P<mark>{_MARK})|(?P<bad>\"[^\n]*|[\w.+-]+|.)", re.S)


def json(text: str) -> list[tuple[str, int]]:
    """Tokens of a JSON text."""
    out = []
    for m in _JSON.finditer(text):
        kind = m.lastgroup
        if kind != "skip":
            out.append((m[0] if kind == "op" else {"mark": "MARKER", "bad": "ERROR"}.get(kind, kind), m.start()))
    return out


# ranges fixed by the XML recommendation
_START = ":A-Z_a-z\xc0-\xd6\xd8-\xf6\xf8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
_NAME = f"[{_START}][-.0-9\xb7\u0300-\u036f\u203f\u2040{_START}]*"
_CHAR = "\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff"
_S = "[ \t\r\n]"
_XML = re.compile(
    rf"(?P<mark>(?m:^)<{{7}}(?!<)[^\n]*)|(?P<comment><!--(?:(?!--)[{_CHAR}])*-->)|(?P<cdata><!\[CDATA\[(?:(?!\]\]>)[{_CHAR}])*\]\]>)"
    rf"|(?P<doctype><!DOCTYPE{_S}+{_NAME}(?:[^\[\]>\"']|\"[^\"]*\"|'[^']*')*(?:\[(?:[^\]\"'<]|\"[^\"]*\"|'[^']*'|<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)*\]{_S}*)?>)"
    rf"|(?P<pi><\?(?P<target>{_NAME})(?:{_S}(?:(?!\?>)[{_CHAR}])*)?\?>)|(?P<end></(?P<endname>{_NAME}){_S}*>)"
    rf"|(?P<tag><(?P<name>{_NAME})(?P<attributes>(?:{_S}+{_NAME}{_S}*={_S}*(?:\"[^<\"]*\"|'[^<']*'))*){_S}*(?P<empty>/)?>)"
    rf"|(?P<blank>{_S}+(?=<|\Z))|(?P<text>[^<]+)|(?P<bad><)",
    re.S,
)
# what a tag, comment, section, instruction or document type that the end of the text cuts off may look like
_ATTRIBUTES = rf"(?:{_S}+{_NAME}{_S}*={_S}*(?:\"[^<\"]*\"|'[^<']*'))*"
_PREFIXES = "|".join(re.escape(w[:k]) for w in ("!--", "![CDATA[", "!DOCTYPE") for k in range(1, len(w) + 1))
_CUT = re.compile(
    rf"<(?:/?(?:{_NAME}{_S}*)?|{_NAME}{_ATTRIBUTES}(?:{_S}*/?|{_S}+{_NAME}{_S}*(?:={_S}*(?:\"[^<\"]*|'[^<']*)?)?)"
    rf"|\?(?:{_NAME}(?:{_S}(?:(?!\?>)[{_CHAR}])*)?\??)?|{_PREFIXES}|!--(?:(?!--)[{_CHAR}])*-{{0,2}}|!\[CDATA\[(?:(?!\]\]>)[{_CHAR}])*"
    rf"|!DOCTYPE{_S}+(?:[^\[\]>\"']|\"[^\"]*\"|'[^']*')*(?:\[[^\]]*(?:\]{_S}*)?|\"[^\"]*|'[^']*)?)\Z",
    re.S,
)
_DECL = re.compile(
    rf"<\?xml{_S}+version{_S}*={_S}*(?:\"1\.[0-9]+\"|'1\.[0-9]+')(?:{_S}+encoding{_S}*={_S}*(?:\"[A-Za-z][-.\w]*\"|'[A-Za-z][-.\w]*'))?(?:{_S}+standalone{_S}*={_S}*(?:\"(?:yes|no)\"|'(?:yes|no)'))?{_S}*\?>"
)
_ATTRIBUTE = re.compile(rf"({_NAME}){_S}*={_S}*(?:\"([^\"]*)\"|'([^']*)')")
_REFERENCE = re.compile(rf"&(?:(#[0-9]+|#x[0-9a-fA-F]+)|({_NAME}));")
_ILLEGAL = re.compile(f"[^{_CHAR}]")


def _legal(text: str, declared: bool) -> bool:
    """Whether all characters are allowed and all references known."""
    if _ILLEGAL.search(text):
        return False
    if "&" not in text:
        return True
    for m in _REFERENCE.finditer(text):
        if m[1]:
            n = int(m[1][2:], 16) if m[1][1] == "x" else int(m[1][1:])
            if n > 0x10FFFF or _ILLEGAL.match(chr(n)):
                return False
        elif m[2] not in ("amp", "lt", "gt", "quot", "apos") and not declared:
            return False
    return "&" not in _REFERENCE.sub("", text)


def xml(text: str) -> list[tuple[str, int]]:
    """Tokens of an XML text: ``<name`` and ``/name`` for tags, EMPTY, TEXT, CDATA, DOCTYPE, DECL; blanks, comments and instructions may stand anywhere."""
    out, at = [], 0
    if text[:1] == "\ufeff":
        at = 1
    if m := _DECL.match(text, at):
        out.append(("DECL", at))
        at = m.end()
    declared = False
    for m in _XML.finditer(text, at):
        kind, ok = m.lastgroup, True
        if m["tag"]:
            found = _ATTRIBUTE.findall(m["attributes"]) if m["attributes"] else ()
            ok = not found or len({a for a, _, _ in found}) == len(found) and all(_legal(x + y, declared) for _, x, y in found)
            token = "EMPTY" if m["empty"] else "<" + m["name"]
        elif m["end"]:
            token = "/" + m["endname"]
        elif m["pi"]:
            token, ok = "PI", m["target"].lower() != "xml"
        elif kind == "doctype":
            token, declared = "DOCTYPE", True
        elif kind == "text":
            token, ok = "TEXT", "]]>" not in m[0] and _legal(m[0], declared)
        else:
            token = {"mark": "MARKER", "bad": "ERROR"}.get(kind, kind.upper())
        if ok and token in ("BLANK", "COMMENT", "PI"):
            continue
        out.append((token if ok else "ERROR", m.start()))
        if kind == "bad" and _CUT.match(text, m.start()):
            break  # one token up to the end
    return out


def cut_off(language: str, token: str) -> bool:
    """Whether the end of the text may have cut off what is a token of kind ERROR, given as all text from its start on."""
    if language == "xsd":
        return bool(_CUT.match(token) or re.search(r"&(?:#(?:[0-9]*|x[0-9a-fA-F]*)|[\w.:-]*)\Z", token))
    if language == "java":
        return token.startswith(("/*", '"', "'"))
    return token.startswith('"') or any(w.startswith(token) for w in ("true", "false", "null")) or bool(re.fullmatch(r"-?(?:(?:0|[1-9][0-9]*)(?:\.|(?:\.[0-9]+)?[eE][+-]?))?", token))
