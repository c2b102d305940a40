"""Blocks inside DWARF 1 attributes: types, array subscripts, and the trees made of entries."""

from __future__ import annotations

from debuglens.sources.decode import location
from debuglens.sources.layout import Malformed

#: Codes of fundamental types.
FUNDAMENTAL = {
    0x0001: "char",
    0x0002: "signed_char",
    0x0003: "unsigned_char",
    0x0004: "short",
    0x0005: "signed_short",
    0x0006: "unsigned_short",
    0x0007: "integer",
    0x0008: "signed_integer",
    0x0009: "unsigned_integer",
    0x000A: "long",
    0x000B: "signed_long",
    0x000C: "unsigned_long",
    0x000D: "pointer",
    0x000E: "float",
    0x000F: "dbl_prec_float",
    0x0010: "ext_prec_float",
    0x0011: "complex",
    0x0012: "dbl_prec_complex",
    0x0014: "void",
    0x0015: "boolean",
    0x0016: "ext_prec_complex",
    0x0017: "label",
    0x8008: "long_long",
    0x8108: "signed_long_long",
    0x8208: "unsigned_long_long",
    0xA510: "int128",
}
MODIFIERS = {1: "pointer_to", 2: "reference_to", 3: "const", 4: "volatile"}
TYPE_TAGS = ("array_type", "class_type", "enumeration_type", "pointer_type", "reference_type", "string_type", "structure_type", "subroutine_type", "typedef", "union_type", "ptr_to_member_type", "set_type", "subrange_type")


def type_of(attr: str, number: int | None, block: bytes | None) -> dict:
    """mods, fund and ref of a type attribute: fundamental or user-defined, with or without modifiers."""
    if attr == "fund_type":
        return {"mods": [], "fund": _fundamental(number), "ref": None}
    if attr == "user_def_type":
        return {"mods": [], "fund": None, "ref": number}
    width = {"mod_fund_type": 2, "mod_u_d_type": 4}[attr]
    if block is None or len(block) < width:
        raise Malformed("type attribute too short")
    if any(b not in MODIFIERS for b in block[:-width]):
        raise Malformed("unknown type modifier")
    value = int.from_bytes(block[-width:], "little")
    return {"mods": [MODIFIERS[b] for b in block[:-width]], "fund": _fundamental(value) if width == 2 else None, "ref": value if width == 4 else None}


def _fundamental(code: int) -> str:
    if code not in FUNDAMENTAL:
        raise Malformed(f"unknown fundamental type {code:#x}")
    return FUNDAMENTAL[code]


def subscripts(block: bytes) -> list[dict]:
    """Items of an array's subscript data: index type, bounds (numbers, or locations), and the element's type.

    Of the format's bits, 4 means a user-defined index type, 2 and 1 mean that the low and the
    high bound are locations; 8 is the element type, an attribute of its own.
    """
    out, at = [], 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(block):
            raise Malformed("subscript data out of bounds")
        at += n
        return block[at - n : at]

    while at < len(block):
        form = take(1)[0]
        if form == 8:
            code = int.from_bytes(take(2), "little")
            attr = {5: "fund_type", 6: "mod_fund_type", 7: "user_def_type", 8: "mod_u_d_type"}.get(code >> 4)
            if attr is None:
                raise Malformed("element type is no type attribute")
            if attr.startswith("mod"):
                found = type_of(attr, None, take(int.from_bytes(take(2), "little")))
            else:
                found = type_of(attr, int.from_bytes(take(2 if attr == "fund_type" else 4), "little"), None)
            out.append({"format": "ET", "type": found, "low": None, "high": None})
            continue
        if form > 8:
            raise Malformed("unknown subscript format")
        index = {"mods": [], "fund": None, "ref": int.from_bytes(take(4), "little")} if form & 4 else {"mods": [], "fund": _fundamental(int.from_bytes(take(2), "little")), "ref": None}
        bounds = [location(take(int.from_bytes(take(2), "little"))) if form & bit else int.from_bytes(take(4), "little", signed=True) for bit in (2, 1)]
        out.append({"format": f"{'UT' if form & 4 else 'FT'}_{'X' if form & 2 else 'C'}_{'X' if form & 1 else 'C'}", "type": index, "low": bounds[0], "high": bounds[1]})
    return out


def tree(found: dict, arrays: dict[int, bytes] | None = None) -> dict:
    """The type tree of a type attribute: modifiers from the last to the first, arrays from their subscript data.

    Other entries stand as error nodes that say what they are.
    """
    if found["ref"] is not None and found["ref"] in (arrays or {}):
        items = subscripts(arrays[found["ref"]])
        out = tree(items[-1]["type"], arrays)
        for item in reversed(items[:-1]):
            count = item["high"] + 1 if isinstance(item["high"], int) else None
            out = {"kind": "array", "count": count, "element": out}
    else:
        out = {"kind": "error", "message": f"fundamental type {found['fund']}" if found["fund"] else f"entry {found['ref']}"}
    for m in reversed(found["mods"]):
        out = {"kind": "pointer" if m == "pointer_to" else "reference", "value": out} if m.endswith("_to") else out | {f"is_{m}": True}
    return out
