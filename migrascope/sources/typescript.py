"""Imports and exports of TypeScript and TSX text.

A lexer turns the text into significant tokens: comments vanish; strings,
templates, regular expressions and JSX text become opaque, so nothing inside
them looks like a statement.  Code inside ``${...}`` of templates and ``{...}``
of JSX is lexed as code.  Two small grammars then read the tokens.  Broken
text never fails: what can't be read is skipped.

Lines count from 1; columns and offsets are bytes of UTF-8, from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

SPACE = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*.*?(?:\*/|\Z))+", re.S)
NAME = re.compile(r"[#@]?(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:\w|\$|\\u\{?[0-9a-fA-F]+\}?|‌|‍)*")
STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"", re.S)
NUMBER = re.compile(r"\.?\d(?:[\w.]|(?<=[eE])[+-])*")
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
JSX_TEXT = re.compile(r"[^<{]*")
JSX_STRING = re.compile(r"'[^']*'|\"[^\"]*\"")
JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
ARROW_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=\s|extends\b)")

# Plain code in one go: neither TSX, nor code in templates, nor a slash that isn't a comment's.
PLAIN = re.compile(
    SPACE.pattern + "|(?P<name>" + NAME.pattern + ")|(?P<string>" + STRING.pattern + r")|(?P<template>`" + TEMPLATE.pattern + "`)|(?P<other>(?:\\d|\\.\\d)" + r"(?:[\w.]|(?<=[eE])[+-])*" + r")|(?P<punct>[^/`'\"])|(?P<stray>['\"])",
    re.S,
)

# After these words an operand follows: a slash opens a regular expression, a less-than sign an element.
OPERAND_NEXT = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())


class Token(NamedTuple):
    kind: str  # name, string, punct, other
    text: str
    at: int


class Location(NamedTuple):
    line: int
    column: int
    byte_offset: int


class Import(NamedTuple):
    path: str
    kind: str
    names: list[str]
    location: Location


class Export(NamedTuple):
    name: str
    kind: str
    location: Location
    reexport_source: str | None


def _operand_next(tokens: list[Token]) -> bool:
    """Whether an operand, not an operator, stands next."""
    if not tokens:
        return True
    kind, text, _ = tokens[-1]
    if kind == "name":
        return text in OPERAND_NEXT
    return kind == "punct" and text not in (")", "]", "}")


def _plain_tokens(text: str) -> list[Token] | None:
    """The tokens of plain code; None if the text needs the full lexer."""
    out: list[Token] = []
    put, at = out.append, 0
    for m in PLAIN.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        kind = m.lastgroup
        if kind is None or kind == "stray":
            continue
        if kind == "template":
            put(Token("other", "`", at - 1))
        elif kind == "other":
            put(Token("other", "0", m.start()))
        else:
            put(Token(kind, m[0], m.start()))
    return out if at == len(text) else None


def tokens_of(text: str, tsx: bool = False) -> list[Token]:
    """The significant tokens."""
    if not tsx and "${" not in text:
        plain = _plain_tokens(text)
        if plain is not None:
            return plain
    return _all_tokens(text, tsx)


def _all_tokens(text: str, tsx: bool) -> list[Token]:
    """The full lexer."""
    out: list[Token] = []
    # What encloses the current place: "{" code braces, "`" a template's code, "<" an element's
    # tag, ">" an element's children, "x" code inside an element.
    modes: list[str] = []
    i, n = 0, len(text)

    def template(i: int) -> int:
        """Past template text; opens a code mode at ``${``."""
        m = TEMPLATE.match(text, i)
        i = m.end()
        if text.startswith("${", i):
            modes.append("`")
            out.append(Token("punct", "(", i))
            return i + 2
        out.append(Token("other", "`", i))
        return i + 1

    while i < n:
        mode = modes[-1] if modes else ""
        if mode == ">":  # children of an element
            i = JSX_TEXT.match(text, i).end()
            if i >= n:
                break
            if text[i] == "{":
                modes.append("x")
                out.append(Token("punct", "(", i))
                i += 1
            elif text.startswith("</", i):
                end = text.find(">", i)
                i = n if end < 0 else end + 1
                modes.pop()
                out.append(Token("other", "</>", i))
            else:
                modes.append("<")
                i += 1
            continue
        m = SPACE.match(text, i)
        if m:
            i = m.end()
            if i >= n:
                break
        c = text[i]
        if mode == "<":  # inside a tag
            if text.startswith("/>", i):
                modes.pop()
                out.append(Token("other", "/>", i))
                i += 2
            elif c == ">":
                modes[-1] = ">"
                i += 1
            elif c == "{":
                modes.append("x")
                out.append(Token("punct", "(", i))
                i += 1
            elif m := JSX_STRING.match(text, i) or JSX_NAME.match(text, i):
                i = m.end()
            else:
                i += 1
            continue
        if m := NAME.match(text, i):
            out.append(Token("name", m[0], i))
            i = m.end()
        elif c in "'\"":
            m = STRING.match(text, i)
            if m:
                out.append(Token("string", m[0], i))
                i = m.end()
            else:
                i += 1
        elif c == "`":
            i = template(i + 1)
        elif c == "{":
            modes.append("{")
            out.append(Token("punct", c, i))
            i += 1
        elif c == "}":
            i += 1
            if mode == "`":
                modes.pop()
                out.append(Token("punct", ")", i - 1))
                i = template(i)
            elif mode == "x":
                modes.pop()
                out.append(Token("punct", ")", i - 1))
            else:
                if mode == "{":
                    modes.pop()
                out.append(Token("punct", c, i - 1))
        elif c.isdigit() or (c == "." and i + 1 < n and text[i + 1].isdigit()):
            m = NUMBER.match(text, i)
            out.append(Token("other", "0", i))
            i = m.end() if m else i + 1
        elif c == "/" and _operand_next(out) and (m := REGEX.match(text, i)):
            out.append(Token("other", "/", i))
            i = m.end()
        elif c == "<" and tsx and _operand_next(out) and i + 1 < n and (text[i + 1] == ">" or text[i + 1].isalpha() or text[i + 1] in "_$") and not ARROW_GENERIC.match(text, i):
            modes.append("<")
            i += 1
        else:
            out.append(Token("punct", c, i))
            i += 1
    return out


class _Places:
    """Byte positions of characters."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.ascii = text.isascii()
        self.known = (0, 0)  # a character and its byte, for those asked in ascending order

    def _bytes(self, a: int, b: int) -> int:
        return b - a if self.ascii else len(self.text[a:b].encode("utf-8", "surrogatepass"))

    def of(self, at: int) -> Location:
        line = bisect_right(self.starts, at)
        char, byte = self.known if self.known[0] <= at else (0, 0)
        byte += self._bytes(char, at)
        self.known = (at, byte)
        return Location(line, self._bytes(self.starts[line - 1], at), byte)


def _is(t: list[Token], i: int, kind: str, text: str | None = None) -> bool:
    return i < len(t) and t[i].kind == kind and (text is None or t[i].text == text)


def _braced(t: list[Token], i: int) -> tuple[list[Token], int]:
    """The names of ``{a, b as c, type d}`` as they are called outside, and the place behind the brace; -1 if it is none."""
    names: list[Token] = []
    i += 1
    while i < len(t) and not _is(t, i, "punct", "}"):
        if _is(t, i, "punct", ","):
            i += 1
            continue
        spec: list[Token] = []
        while i < len(t) and not (t[i].kind == "punct" and t[i].text in ",}"):
            if t[i].kind not in ("name", "string"):
                return [], -1
            spec.append(t[i])
            i += 1
        if len(spec) in (2, 4) and spec[0].text in ("type", "typeof") and (len(spec) == 2 or spec[2].text == "as"):
            spec = spec[1:]
        if spec and spec[0].kind == "name":
            names.append(spec[0])
    return names, i + 1 if i < len(t) else -1


def _static(t: list[Token], i: int) -> tuple[str, list[str], str, int] | None:
    """An import statement at ``t[i]``: its kind without regard to types, names, path, and the place behind it."""
    if _is(t, i + 1, "string"):
        return "side_effect", [], t[i + 1].text, i + 2
    j, names, kind = i + 1, [], ""
    if _is(t, j, "name") and t[j].text in ("type", "typeof") and not (_is(t, j + 1, "punct", ",") or (_is(t, j + 1, "name", "from") and _is(t, j + 2, "string"))):
        j += 1
    while j < len(t):
        if _is(t, j, "name", "from") and _is(t, j + 1, "string") and not _is(t, j - 1, "punct", ","):
            return kind or "side_effect", names, t[j + 1].text, j + 2
        if _is(t, j, "punct", "*") and _is(t, j + 1, "name", "as") and _is(t, j + 2, "name"):
            names.append(t[j + 2].text)
            kind = "namespace"
            j += 3
        elif _is(t, j, "punct", "{"):
            got, j = _braced(t, j)
            if j < 0:
                return None
            names += [g.text for g in got]
            kind = kind or ("named" if got else "")
        elif _is(t, j, "name") and j <= i + 2:
            names.append(t[j].text)
            kind = "default"
            j += 1
        else:
            return None
        if _is(t, j, "punct", ","):
            j += 1
    return None


def _dynamic(t: list[Token], i: int) -> list[Token]:
    """The string arguments of a call at the parenthesis ``t[i]``."""
    depth, out = 0, []
    for j in range(i, len(t)):
        if t[j].kind == "punct":
            if t[j].text in "([{":
                depth += 1
            elif t[j].text in ")]}":
                depth -= 1
                if depth == 0:
                    return out
        elif t[j].kind == "string" and depth == 1 and t[j - 1].text in ("(", ",") and _is(t, j + 1, "punct") and t[j + 1].text in ",)":
            out.append(t[j])
    return out


def imports(text: str, tsx: bool = False) -> list[Import]:
    """All imports by line and column; paths keep their quotes."""
    if "import" not in text:
        return []
    t, places = tokens_of(text, tsx), _Places(text)
    out: list[Import] = []
    for i, tok in enumerate(t):
        if tok.kind != "name" or tok.text != "import" or (i and t[i - 1].kind == "punct" and t[i - 1].text == "."):
            continue
        if _is(t, i + 1, "punct", "("):
            out += [Import(s.text, "dynamic", [], places.of(s.at)) for s in _dynamic(t, i + 1)]
        elif got := _static(t, i):
            kind, names, path, _ = got
            if text.startswith("import type", tok.at):
                kind = "type_only"
            out.append(Import(path, kind, names, places.of(tok.at)))
    return sorted(out, key=lambda x: x.location[:2])


def exports(text: str, tsx: bool = False) -> list[Export]:
    """Exported classes, interfaces and clauses by line and column.

    Other declarations, ``export *`` and default values are none.
    """
    if "export" not in text:
        return []
    t, places = tokens_of(text, tsx), _Places(text)
    out: list[Export] = []
    for i, tok in enumerate(t):
        if tok.kind != "name" or tok.text != "export" or (i and t[i - 1].kind == "punct" and t[i - 1].text == "."):
            continue
        j = i + 1
        if _is(t, j, "name", "type") and _is(t, j + 1, "punct", "{"):
            j += 1
        if _is(t, j, "punct", "{"):
            names, j = _braced(t, j)
            if j >= 0:
                source = t[j + 1].text if _is(t, j, "name", "from") and _is(t, j + 1, "string") else None
                out += [Export(x.text, "re_export" if source else "named", places.of(x.at), source) for x in names]
            continue
        if _is(t, j, "name", "default"):
            j += 1
        if _is(t, j, "name") and t[j].text in ("class", "interface") and _is(t, j + 1, "name") and t[j + 1].text not in ("extends", "implements"):
            out.append(Export(t[j + 1].text, t[j].text, places.of(t[j + 1].at), None))
    return sorted(out, key=lambda x: x.location[:2])
