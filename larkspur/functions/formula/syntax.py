"""Source text to a checked tree of nodes.

Binding powers drive one loop; a node is a small tuple-like object with its kind,
parts and position. Everything that isn't allowed (assignments, loose equality, calls
of unknown functions, forbidden names ...) is refused here with a code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

# Names that formulas may and may not use.
FORBIDDEN_NAMES = set("eval Function AsyncFunction GeneratorFunction WebAssembly globalThis window process require".split())
FORBIDDEN_PROPERTIES = set("__proto__ prototype constructor".split())
RESERVED = {"title", "path"}
GLOBALS = set("Number String parseInt parseFloat isFinite isInteger encodeURIComponent decodeURIComponent".split())
STATICS = {
    "Math": set("abs ceil floor round trunc min max pow sqrt sign exp log log10".split()),
    "Number": set("isFinite isInteger parseInt parseFloat".split()),
    "Array": {"isArray"},
    "Object": set("keys values entries hasOwn".split()),
    "JSON": {"parse", "stringify"},
    "Date": {"parse", "UTC"},
}
METHODS = set(
    "trim trimStart trimEnd toUpperCase toLowerCase includes startsWith endsWith charAt at slice substring indexOf lastIndexOf concat "
    "repeat padStart padEnd split match replace join flat map filter reduce some every find test toString toFixed".split()
)
CALLBACKS = set("map filter reduce some every find".split())


@dataclass(frozen=True)
class Limits:
    source_bytes: int = 8 << 10
    nodes: int = 1024
    depth: int = 64
    steps: int = 50_000
    elements: int = 10_000
    regex_bytes: int = 4 << 10
    output_bytes: int = 1 << 20


class FormulaError(Exception):
    def __init__(self, code: str, message: str, at: int | None = None):
        super().__init__(message)
        self.code, self.message, self.at = code, message, at


@dataclass
class Node:
    kind: str
    at: int
    value: object = None
    parts: list = field(default_factory=list)


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<op>===|!==|\*\*|=>|<=|>=|\?\?|\?\.(?!\d)|&&|\|\||==|!=|[-+*/%<>!?:.,()\[\]{}`])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_BINARY = {"??": 1, "||": 2, "&&": 3, "===": 4, "!==": 4, "<": 5, "<=": 5, ">": 5, ">=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "**": 9}


def unescape(body: str, at: int) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] == "u":
            return chr(int(c.strip("u{}"), 16))
        if c[0] == "x":
            return chr(int(c[1:], 16))
        return "" if c == "\n" else _ESCAPES.get(c, c)

    try:
        return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, body, flags=re.S)
    except (ValueError, OverflowError):
        raise FormulaError("syntax_error", "invalid escape", at) from None


class Parser:
    def __init__(self, source: str, limits: Limits):
        self.source, self.limits, self.at, self.count, self.depth = source, limits, 0, 0, 0
        self.scopes: list[set[str]] = []
        self.names: list[Node] = []
        self.fields: set[str] = set()
        self.token: tuple[str, str, int] = ("", "", 0)
        self.next()

    # tokens

    def next(self) -> None:
        while True:
            if self.at >= len(self.source):
                self.token = ("end", "", len(self.source))
                return
            m = _TOKEN.match(self.source, self.at)
            if not m:
                raise FormulaError("syntax_error", f"unexpected character {self.source[self.at]!r}", self.at)
            start, self.at = self.at, m.end()
            if m.lastgroup != "space":
                self.token = (m.lastgroup, m[0], start)
                return

    def peek(self, *ops: str) -> bool:
        return self.token[0] == "op" and self.token[1] in ops

    def take(self, op: str) -> bool:
        if self.peek(op):
            self.next()
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise FormulaError("syntax_error", f"expected {op}", self.token[2])

    def node(self, kind: str, at: int, value: object = None, parts: list | None = None) -> Node:
        self.count += 1
        if self.count > self.limits.nodes:
            raise FormulaError("ast_limit", f"more than {self.limits.nodes} nodes", at)
        return Node(kind, at, value, parts or [])

    # expressions

    def whole(self) -> Node:
        out = self.expression()
        if self.token[0] != "end":
            code = "unsupported_syntax" if self.token[1] in (";", "=", "++", "--") else "syntax_error"
            raise FormulaError(code, f"unexpected {self.token[1]}", self.token[2])
        return out

    def expression(self) -> Node:
        self.depth += 1
        if self.depth > self.limits.depth:
            raise FormulaError("nesting_limit", f"nested deeper than {self.limits.depth}", self.token[2])
        test = self.binary(0)
        if self.peek("?"):
            at = self.token[2]
            self.next()
            yes = self.expression()
            self.need(":")
            test = self.node("if", at, None, [test, yes, self.expression()])
        self.depth -= 1
        return test

    def binary(self, power: int) -> Node:
        left = self.unary()
        while self.token[0] == "op":
            op, at = self.token[1], self.token[2]
            if op in ("==", "!="):
                raise FormulaError("loose_equality", f"use {op}= instead of {op}", at)
            bound = _BINARY.get(op)
            if bound is None or bound <= power:
                break
            self.next()
            right = self.binary(bound - 1 if op == "**" else bound)
            left = self.node("logic" if op in ("&&", "||", "??") else "binary", at, op, [left, right])
        return left

    def unary(self) -> Node:
        kind, text, at = self.token
        if kind == "op" and text in ("!", "-", "+"):
            self.next()
            return self.node("unary", at, text, [self.nested_unary()])
        if kind == "name" and text == "typeof":
            self.next()
            return self.node("unary", at, "typeof", [self.nested_unary()])
        if kind == "name" and text in ("new", "await", "async", "function", "class", "delete", "void", "yield", "import", "this", "super"):
            raise FormulaError("unsupported_syntax", f"{text} is not supported", at)
        return self.postfix(self.primary())

    def nested_unary(self) -> Node:
        self.depth += 1
        if self.depth > self.limits.depth:
            raise FormulaError("nesting_limit", f"nested deeper than {self.limits.depth}", self.token[2])
        out = self.unary()
        self.depth -= 1
        return out

    def postfix(self, left: Node) -> Node:
        while self.token[0] == "op" and self.token[1] in (".", "?.", "[", "("):
            op, at = self.token[1], self.token[2]
            self.next()
            optional = op == "?."
            if op == "(":
                left = self.call(left, at)
                continue
            if op == "[" or (optional and self.peek("[")):
                if optional:
                    self.next()
                key = self.expression()
                self.need("]")
            else:
                if self.token[0] != "name":
                    raise FormulaError("syntax_error", "expected a property name", self.token[2])
                key = self.node("text", self.token[2], self.token[1])
                self.next()
            if key.kind == "text" and key.value in FORBIDDEN_PROPERTIES:
                raise FormulaError("forbidden_property", f"{key.value} is not available", key.at)
            if left.kind == "name" and left.value == "fields" and key.kind == "text":
                self.fields.add(key.value)
            left = self.node("get", at, optional, [left, key])
        return left

    def call(self, callee: Node, at: int) -> Node:
        args: list[Node] = []
        method = callee.parts[1].value if callee.kind == "get" and callee.parts[1].kind == "text" else None
        while not self.peek(")"):
            if self.token[1] == "...":
                raise FormulaError("unsupported_syntax", "spread is not supported", at)
            arrow = self.arrow()
            if arrow is not None and method not in CALLBACKS:
                raise FormulaError("unsupported_callback", "callbacks only go into array methods", arrow.at)
            args.append(arrow or self.expression())
            if not self.take(","):
                break
        self.need(")")
        if callee.kind == "name" and callee.value in GLOBALS:
            return self.node("global", at, callee.value, args)
        if method is not None:
            owner = callee.parts[0]
            if owner.kind == "name" and owner.value in STATICS and not any(owner.value in s for s in self.scopes):
                if method not in STATICS[owner.value]:
                    raise FormulaError("unsupported_call", f"{owner.value}.{method} is not available", at)
                return self.node("static", at, (owner.value, method), args)
            if method in METHODS:
                if method in CALLBACKS and (not args or args[0].kind != "arrow"):
                    raise FormulaError("unsupported_callback", f"{method} takes an arrow function", at)
                return self.node("method", at, (method, callee.value), [owner, *args])
        raise FormulaError("unsupported_call", "this call is not available", at)

    def arrow(self) -> Node | None:
        """An arrow function, if one starts here."""
        m = re.compile(r"\s*(?:\(([^()]*)\)|([^\W\d][\w$]*))\s*=>").match(self.source, self.token[2])
        if not m or self.token[0] not in ("name", "op"):
            return None
        at = self.token[2]
        params = [p.strip() for p in (m[1] if m[1] is not None else m[2]).split(",") if p.strip()]
        if len(params) > 4 or any(not re.fullmatch(r"[^\W\d][\w$]*", p) for p in params):
            raise FormulaError("unsupported_callback", "callbacks take up to four plain names", at)
        self.at = m.end()
        self.next()
        if self.peek("{"):
            raise FormulaError("unsupported_callback", "a callback is a single expression", self.token[2])
        self.scopes.append(set(params))
        body = self.expression()
        self.scopes.pop()
        return self.node("arrow", at, params, [body])

    def primary(self) -> Node:
        kind, text, at = self.token
        if kind == "number":
            self.next()
            return self.node("number", at, Decimal(text))
        if kind == "string":
            self.next()
            return self.node("text", at, unescape(text[1:-1], at))
        if kind == "name":
            self.next()
            if text in ("true", "false"):
                return self.node("bool", at, text == "true")
            if text == "null":
                return self.node("null", at)
            if text in FORBIDDEN_NAMES:
                raise FormulaError("forbidden_identifier", f"{text} is not available", at)
            out = self.node("name", at, text)
            if text != "undefined" and not any(text in s for s in self.scopes):
                self.names.append(out)
            return out
        if text == "(":
            self.next()
            out = self.expression()
            self.need(")")
            return out
        if text == "[":
            self.next()
            return self.node("list", at, None, self.items("]"))
        if text == "{":
            return self.mapping(at)
        if text == "`":
            return self.template(at)
        if text == "/":
            return self.regex(at)
        raise FormulaError("syntax_error", f"unexpected {text or 'end'}", at)

    def items(self, close: str) -> list[Node]:
        out = []
        while not self.peek(close):
            out.append(self.expression())
            if not self.take(","):
                break
        self.need(close)
        return out

    def mapping(self, at: int) -> Node:
        self.next()
        pairs = []
        while not self.peek("}"):
            kind, text, here = self.token
            if kind not in ("name", "string", "number"):
                raise FormulaError("unsupported_syntax", "objects hold plain keys", here)
            self.next()
            key = unescape(text[1:-1], here) if kind == "string" else text
            if key in FORBIDDEN_PROPERTIES:
                raise FormulaError("forbidden_property", f"{key} is not available", here)
            if self.take(":"):
                pairs.append((key, self.expression()))
            elif kind == "name" and (self.peek(",") or self.peek("}")):
                name = self.node("name", here, key)
                if not any(key in s for s in self.scopes):
                    self.names.append(name)
                pairs.append((key, name))
            else:
                raise FormulaError("unsupported_syntax", "objects hold no methods", here)
            if not self.take(","):
                break
        self.need("}")
        return self.node("object", at, [k for k, _ in pairs], [v for _, v in pairs])

    def template(self, at: int) -> Node:
        parts, chars = [], []
        i = at + 1
        while True:
            if i >= len(self.source):
                raise FormulaError("syntax_error", "unclosed template", at)
            c = self.source[i]
            if c == "`":
                break
            if c == "\\":
                chars.append(self.source[i : i + 2])
                i += 2
            elif self.source.startswith("${", i):
                parts.append(self.node("text", i, unescape("".join(chars), i)))
                chars = []
                self.at = i + 2
                self.next()
                parts.append(self.expression())
                if not self.peek("}"):
                    raise FormulaError("syntax_error", "expected }", self.token[2])
                i = self.token[2] + 1
            else:
                chars.append(c)
                i += 1
        parts.append(self.node("text", i, unescape("".join(chars), i)))
        self.at = i + 1
        self.next()
        return self.node("template", at, None, parts)

    def regex(self, at: int) -> Node:
        m = re.compile(r"/((?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+)/([A-Za-z]*)").match(self.source, at)
        if not m:
            raise FormulaError("syntax_error", "unclosed regex", at)
        body, flags = m[1], m[2]
        if len(body.encode()) > self.limits.regex_bytes:
            raise FormulaError("regex_limit", "regex too long", at)
        if set(flags) - set("gimsu") or len(set(flags)) < len(flags):
            raise FormulaError("invalid_regex", f"flags {flags!r}", at)
        check_regex(body, at)
        self.at = m.end()
        self.next()
        return self.node("regex", at, (body, flags))


def check_regex(body: str, at: int | None = None) -> None:
    """Only what a linear-time engine takes: no look-around, back-references or possessive and atomic parts."""
    bare = re.sub(r"\[(?:[^\]\\]|\\.)*\]", "C", body)
    if re.search(r"\(\?(?:[=!>]|<[=!])", bare) or re.search(r"\\(?:[1-9]|k<)", bare) or re.search(r"(?:[*+?]|\{\d+(?:,\d*)?\})\+", bare):
        raise FormulaError("invalid_regex", "look-around, back-references and possessive quantifiers are not supported", at)
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", body))
    except re.error as e:
        raise FormulaError("invalid_regex", str(e), at) from None


@dataclass(frozen=True)
class Formula:
    tree: Node
    names: frozenset[str]  # free names and fields["..."] keys
    source: str


def parse(source: str, limits: Limits = Limits()) -> Formula:
    if len(source.encode()) > limits.source_bytes:
        raise FormulaError("source_limit", f"more than {limits.source_bytes} bytes")
    p = Parser(source, limits)
    tree = p.whole()
    roots = set(STATICS) | GLOBALS | {"fields", "undefined"}
    return Formula(tree, frozenset({n.value for n in p.names} - roots | p.fields), source)
