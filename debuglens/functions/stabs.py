"""The grammar of STABS strings: text in, a tree of nodes out, and trees flattened into rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Letters before a symbol's type; a digit or a parenthesis there means a local variable.
SYMBOLS = {
    "_": "local_variable",
    "a": "reference_parameter_a",
    "f": "local_function",
    "F": "global_function",
    "G": "global_variable",
    "P": "register_parameter",
    "p": "value_parameter",
    "r": "register_variable",
    "S": "static_global_variable",
    "t": "type_name",
    "T": "type_tag",
    "V": "static_local_variable",
    "v": "reference_parameter_v",
}
VISIBILITY = {"0": "private", "1": "protected", "2": "public", "9": "public_optimized_out"}
FORWARD = {"e": "enum", "s": "struct", "u": "union"}
#: Types that are a letter and one other type.
WRAPPERS = {"f": ("function", "return"), "B": ("volatile", "underlying"), "k": ("const", "underlying"), "&": ("reference", "value"), "*": ("pointer", "value")}
MODIFIERS = {"A": (False, False), "B": (True, False), "C": (False, True), "D": (True, True), "?": None, ".": None}
_NUMBER = re.compile(r"\s*[+-]?[0-9]+")


class StabsError(ValueError):
    """A string that the grammar doesn't cover."""


class Truncated(StabsError):
    """A name that never ends: the compiler cut the string off."""


@dataclass
class Node:
    kind: str
    number: tuple[int, int] | None = None
    name: str | None = None
    attrs: dict = field(default_factory=dict)
    children: list[tuple[str, "Node"]] = field(default_factory=list)

    def child(self, role: str) -> "Node":
        return next(n for r, n in self.children if r == role)

    def numbered(self, found: dict | None = None) -> dict:
        """Type numbers defined in the tree, the first definition of each."""
        found = {} if found is None else found
        if self.number is not None and self.kind != "use":
            found.setdefault(self.number, self)
        for _, n in self.children:
            n.numbered(found)
        return found


@dataclass
class Symbol:
    name: str
    descriptor: str
    type: Node


class Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, wanted: str, where: str) -> None:
        if not self.text.startswith(wanted, self.at):
            raise StabsError(f"expected {wanted!r} in {where} at {self.at}, got {self.peek()!r}")
        self.at += len(wanted)

    def accept(self, wanted: str) -> bool:
        if self.text.startswith(wanted, self.at):
            self.at += len(wanted)
            return True
        return False

    def any(self, where: str) -> str:
        if self.at >= len(self.text):
            raise StabsError(f"unexpected end of input in {where}")
        self.at += 1
        return self.text[self.at - 1]

    def number(self, where: str, bits: int = 32) -> int:
        if not (m := _NUMBER.match(self.text, self.at)):
            raise StabsError(f"no number in {where}")
        self.at = m.end()
        value = max(-(1 << 63), min((1 << 63) - 1, int(m[0])))
        return (value + (1 << 31)) % (1 << 32) - (1 << 31) if bits == 32 else value

    def until(self, end: str, where: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            raise StabsError(f"no {end!r} in {where}")
        out, self.at = self.text[self.at : stop], stop
        return out

    def name(self, end: str) -> str:
        """A name up to end, which may stand inside template arguments and character literals."""
        begin, depth, text = self.at, 0, self.text
        while self.at < len(text):
            c = text[self.at]
            if c == "'":
                body = self.at + (2 if self.peek(2) == "''" else 1)
                stop = text.find("'", body)
                if stop < 0:
                    break
                self.at = stop + 1
                continue
            depth += (c == "<") - (c == ">")
            if c == end and depth == 0:
                return text[begin : self.at]
            self.at += 1
        raise Truncated("a name is cut off; other symbols of its file may be invalid too")

    def at_type(self) -> bool:
        return self.peek().isdigit() or self.peek() == "("


def parse_symbol(text: str) -> Symbol:
    r = Reader(text)
    name = r.name(":")
    r.take(":", "symbol")
    letter = "_" if r.at_type() else r.any("symbol")
    if letter not in SYMBOLS:
        raise StabsError(f"unknown symbol descriptor {letter!r}")
    r.accept("t")
    node = top_type(r)
    if letter in "fF" and r.accept(","):
        r.until(",", "nested function")
    if letter in "tT":
        node.name = name
    node.attrs["is_typedef"] = letter == "t"
    return Symbol(name, SYMBOLS[letter], node)


def top_type(r: Reader) -> Node:
    node = parse_type(r)
    if node.kind == "struct" and r.accept("~%"):
        node.children.append(("first_base", parse_type(r)))
        r.take(";", "first base class")
    if r.accept(";l"):
        r.take("(#", "live range")
        low = r.number("live range")
        r.take(",#", "live range")
        node.attrs["live_range"] = (low, r.number("live range"))
        r.take(")", "live range")
    return node


def parse_type(r: Reader) -> Node:
    number = None
    if r.accept("("):
        first = r.number("type number")
        r.take(",", "type number")
        number = (first, r.number("type number"))
        r.take(")", "type number")
    elif r.peek().isdigit():
        number = (-1, r.number("type number"))
    if number is not None and not r.accept("="):
        return Node("use", number)
    if r.at_type():
        return Node("alias", number, children=[("underlying", parse_type(r))])
    letter = r.any("type")
    if letter in WRAPPERS:
        kind, role = WRAPPERS[letter]
        return Node(kind, number, children=[(role, parse_type(r))])
    if letter not in _TYPES:
        raise StabsError(f"unknown type descriptor {letter!r}")
    node = _TYPES[letter](r)
    node.number = number
    return node


def _array(r: Reader) -> Node:
    return Node("array", children=[("index", parse_type(r)), ("element", parse_type(r))])


def _enum(r: Reader) -> Node:
    constants = []
    while not r.accept(";"):
        name = r.until(":", "enum")
        r.take(":", "enum")
        constants.append((r.number("enum"), name))
        r.take(",", "enum")
    return Node("enum", attrs={"constants": constants})


def _range(r: Reader) -> Node:
    of, bounds = parse_type(r), []
    r.take(";", "range")
    for _ in range(2):
        bounds.append(r.until(";", "range"))
        r.take(";", "range")
    return Node("range", attrs={"low": bounds[0], "high": bounds[1]}, children=[("underlying", of)])


def _visibility(r: Reader) -> str:
    c = r.any("visibility")
    if c not in VISIBILITY:
        raise StabsError(f"unknown visibility {c!r}")
    return VISIBILITY[c]


def _record(kind: str):
    def parse(r: Reader) -> Node:
        node = Node(kind, attrs={"size": r.number(kind, 64)})
        if kind == "struct" and r.accept("!"):
            count = r.number("base classes")
            r.take(",", "base classes")
            for _ in range(count):
                virtual = r.any("base class")
                if virtual not in "01":
                    raise StabsError("bad base class")
                base = Node("base", attrs={"is_virtual": virtual == "1", "visibility": _visibility(r), "offset": r.number("base class")})
                r.take(",", "base class")
                base.children.append(("type", parse_type(r)))
                r.take(";", "base class")
                node.children.append(("base", base))
        node.children += [("field", f) for f in _fields(r)]
        node.children += [("member_function", f) for f in _members(r)]
        return node

    return parse


def _fields(r: Reader):
    while r.at < len(r.text) and not r.accept(";"):
        begin = r.at
        name = r.name(":")
        r.take(":", "field")
        visibility = _visibility(r) if r.accept("/") else None
        if r.peek() == ":":
            r.at = begin  # the member functions begin
            return
        f = Node("field", name=name, attrs={"visibility": visibility, "is_static": False}, children=[("type", parse_type(r))])
        if name.startswith("$"):
            r.take(",", "field")
            f.attrs["offset_bits"] = r.number("field offset")
        elif r.accept(":"):
            f.attrs |= {"is_static": True, "type_name": r.until(";", "static field")}
        else:
            r.take(",", "field")
            f.attrs["offset_bits"] = r.number("field offset")
            r.take(",", "field")
            f.attrs["size_bits"] = r.number("field size")
        r.take(";", "field")
        yield f


def _members(r: Reader):
    if r.peek() in (",", ":"):
        return  # of the enclosing record's field
    while r.at < len(r.text) and not r.accept(";"):
        name = r.until(":", "member function")
        r.take("::", "member function")
        while r.at < len(r.text) and not r.accept(";"):
            f = Node("member_function", name=name, children=[("type", parse_type(r))])
            r.take(":", "member function")
            f.attrs["mangled"] = r.until(";", "member function")
            r.take(";", "member function")
            f.attrs["visibility"] = _visibility(r)
            modifier = r.any("member function")
            if modifier not in MODIFIERS:
                raise StabsError("bad member function modifiers")
            if flags := MODIFIERS[modifier]:
                f.attrs |= dict(zip(("is_const", "is_volatile"), flags))
            flag = r.any("member function")
            if flag == "*":
                f.attrs |= {"modifier": "virtual", "vtable_index": r.number("vtable index")}
                r.take(";", "virtual function")
                f.children.append(("virtual", parse_type(r)))
                r.take(";", "virtual function")
            elif flag in ".?":
                f.attrs["modifier"] = "static" if flag == "?" else "none"
            else:
                raise StabsError("bad member function type")
            yield f


def _cross_reference(r: Reader) -> Node:
    c = r.any("cross reference")
    if c not in FORWARD:
        raise StabsError(f"unknown cross reference {c!r}")
    name = r.name(":")
    r.take(":", "cross reference")
    return Node("cross_reference", name=name, attrs={"forward": FORWARD[c]})


def _float(r: Reader) -> Node:
    numbers = []
    for _ in range(3):
        numbers.append(r.number("float"))
        r.take(";", "float")
    return Node("float", attrs={"class": numbers[0], "bytes": numbers[1]})


def _method(r: Reader) -> Node:
    if r.accept("#"):
        node = Node("method", children=[("return", parse_type(r))])
        r.accept(";")
        return node
    node = Node("method", children=[("class", parse_type(r))])
    r.take(",", "method")
    node.children.append(("return", parse_type(r)))
    while r.at < len(r.text) and not r.accept(";"):
        r.take(",", "method")
        node.children.append(("param", parse_type(r)))
    return node


def _attribute(r: Reader) -> Node:
    if r.at_type():
        node = Node("member_pointer", children=[("class", parse_type(r))])
        r.take(",", "member pointer")
        node.children.append(("value", parse_type(r)))
        return node
    r.take("s", "type attribute")
    size = r.number("type attribute", 64)
    r.take(";", "type attribute")
    return Node("sized", attrs={"size_bits": size}, children=[("underlying", parse_type(r))])


def _builtin(r: Reader) -> Node:
    # the minus sign is the letter, so the number after it is counted down
    node = Node("builtin", attrs={"type_id": r.number("builtin", 64)})
    r.take(";", "builtin")
    return node


_TYPES = {"a": _array, "e": _enum, "r": _range, "s": _record("struct"), "u": _record("union"), "x": _cross_reference, "R": _float, "#": _method, "@": _attribute, "-": _builtin}


def flattened(node: Node, path: tuple = (), role: str = "root", parent: int | None = None, out: list | None = None) -> list[dict]:
    """Rows of a tree in pre-order: node_id, parent_id, path, depth, role, kind, name, number, and the scalar attributes."""
    out = [] if out is None else out
    me = len(out)
    number = node.number or (None, None)
    out.append({"node_id": me, "parent_id": parent, "path": list(path), "depth": len(path), "role": role, "kind": node.kind, "name": node.name, "file_no": number[0], "type_no": number[1], "size": node.attrs.get("size"), "offset_bits": node.attrs.get("offset_bits"), "size_bits": node.attrs.get("size_bits"), "low": node.attrs.get("low"), "high": node.attrs.get("high"), "visibility": node.attrs.get("visibility")})
    for k, (r, child) in enumerate(node.children):
        flattened(child, (*path, k), r, me, out)
    return out
