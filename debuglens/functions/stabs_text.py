"""STABS text written from trees: the inverse of the grammar, for builders of symbol files and round trips."""

from __future__ import annotations

from debuglens.functions.stabs import FORWARD, MODIFIERS, SYMBOLS, VISIBILITY, WRAPPERS, Node, Symbol

_LETTER = {kind: letter for letter, kind in SYMBOLS.items() if kind != "local_variable"} | {"local_variable": ""}
_SHOWN = {name: digit for digit, name in VISIBILITY.items()}
_FORWARD = {kind: letter for letter, kind in FORWARD.items()}
_WRAPPER = {kind: letter for letter, (kind, _) in WRAPPERS.items()}
_MODIFIER = {flags: letter for letter, flags in MODIFIERS.items() if flags}


def symbol(s: Symbol) -> str:
    return f"{s.name}:{_LETTER[s.descriptor]}{type_text(s.type)}"


def _number(number: tuple[int, int]) -> str:
    return str(number[1]) if number[0] == -1 else f"({number[0]},{number[1]})"


def type_text(node: Node) -> str:
    """A type; first base and live range, which only a symbol's own type has, come after it."""
    if node.kind == "use":
        return _number(node.number)
    body = _body(node)
    for role, child in node.children:
        if role == "first_base":
            body += f"~%{type_text(child)};"
    text = body if node.number is None else f"{_number(node.number)}={body}"
    if "live_range" in node.attrs:
        text += ";l(#{},#{})".format(*node.attrs["live_range"])
    return text


def _body(node: Node) -> str:
    kind, attrs = node.kind, node.attrs
    inner = lambda role: type_text(node.child(role))
    if kind == "alias":
        return inner("underlying")
    if kind in _WRAPPER:
        return _WRAPPER[kind] + type_text(node.children[0][1])
    if kind == "array":
        return f"a{inner('index')}{inner('element')}"
    if kind == "enum":
        return "e" + "".join(f"{name}:{value}," for value, name in attrs["constants"]) + ";"
    if kind == "range":
        return f"r{inner('underlying')};{attrs['low']};{attrs['high']};"
    if kind in ("struct", "union"):
        return _record(node)
    if kind == "cross_reference":
        return f"x{_FORWARD[attrs['forward']]}{node.name}:"
    if kind == "float":
        return f"R{attrs['class']};{attrs['bytes']};0;"
    if kind == "method":
        if any(role == "class" for role, _ in node.children):
            params = "".join(f",{type_text(n)}" for role, n in node.children if role == "param")
            return f"#{inner('class')},{inner('return')}{params};"
        return f"##{inner('return')};"
    if kind == "member_pointer":
        return f"@{inner('class')},{inner('value')}"
    if kind == "sized":
        return f"@s{attrs['size_bits']};{inner('underlying')}"
    if kind == "builtin":
        return f"-{attrs['type_id']};"
    raise ValueError(f"no text for {kind}")


def _record(node: Node) -> str:
    bases = [n for role, n in node.children if role == "base"]
    out = ("s" if node.kind == "struct" else "u") + str(node.attrs["size"])
    if bases:
        out += f"!{len(bases)},"
        out += "".join(f"{int(b.attrs['is_virtual'])}{_SHOWN[b.attrs['visibility']]}{b.attrs['offset']},{type_text(b.child('type'))};" for b in bases)
    out += "".join(_field(n) for role, n in node.children if role == "field")
    sets: dict[str, list[Node]] = {}
    for role, n in node.children:
        if role == "member_function":
            sets.setdefault(n.name, []).append(n)
    # without member functions one sign ends the fields and the record
    return out + "".join(f"{name}::" + "".join(map(_member, members)) + ";" for name, members in sets.items()) + ";"


def _field(f: Node) -> str:
    shown = "" if f.attrs["visibility"] is None else "/" + _SHOWN[f.attrs["visibility"]]
    place = f":{f.attrs['type_name']}" if f.attrs["is_static"] else f",{f.attrs['offset_bits']}" if f.name.startswith("$") else f",{f.attrs['offset_bits']},{f.attrs['size_bits']}"
    return f"{f.name}:{shown}{type_text(f.child('type'))}{place};"


def _member(f: Node) -> str:
    flags = _MODIFIER[f.attrs["is_const"], f.attrs["is_volatile"]] if "is_const" in f.attrs else "."
    kind = {"none": ".", "static": "?"}.get(f.attrs["modifier"])
    if kind is None:
        kind = f"*{f.attrs['vtable_index']};{type_text(f.child('virtual'))};"
    return f"{type_text(f.child('type'))}:{f.attrs['mangled']};{_SHOWN[f.attrs['visibility']]}{flags}{kind}"
