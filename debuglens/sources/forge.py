"""Builders of symbol files for tests and round trips."""

from __future__ import annotations

from debuglens.sources import layout as L
from debuglens.sources.decode import ATTRIBUTES, FORMS, TAGS

_ATTRIBUTE = {v: k for k, v in ATTRIBUTES.items()}
_FORM = {v: k for k, v in FORMS.items()}
_TAG = {v: k for k, v in TAGS.items()}


class Strings:
    """A table of zero-terminated strings; the empty one comes first."""

    def __init__(self):
        self.data, self.at = bytearray(b"\0"), {"": 0}

    def __call__(self, text: str) -> int:
        if text not in self.at:
            self.at[text] = len(self.data)
            self.data += text.encode() + b"\0"
        return self.at[text]


def elf(sections: list[dict], segments: list[dict] = (), entry: int = 0) -> bytes:
    """An ELF file of sections (name, content, and header fields); their bytes follow the header, then the tables."""
    names, body, heads = Strings(), bytearray(), []
    start = L.ELF_HEADER.size
    for s in [{"name": "", "content": b""}, *sections]:
        head = {k: s[k] for k in ("type", "addr", "link", "info") if k in s}
        heads.append(head | {"name_offset": names(s["name"]), "offset": start + len(body), "size": len(s["content"])})
        body += s["content"] + b"\0" * (-len(s["content"]) % 4)
    name_of = names(".shstrtab")
    heads.append({"name_offset": name_of, "offset": start + len(body), "size": len(names.data), "type": 3})
    body += names.data + b"\0" * (-len(names.data) % 4)
    shoff = start + len(body)
    phoff = shoff + len(heads) * L.ELF_SECTION.size
    head = L.ELF_HEADER.write(magic=b"\x7fELF", ident=b"\1\1\1" + b"\0" * 9, type=2, machine=8, version=1, entry=entry, phoff=phoff, shoff=shoff, ehsize=52, phentsize=32, phnum=len(segments), shentsize=40, shnum=len(heads), shstrndx=len(heads) - 1)
    return head + bytes(body) + b"".join(L.ELF_SECTION.write(**h) for h in heads) + b"".join(L.ELF_SEGMENT.write(**s) for s in segments)


def symtab(symbols: list[dict]) -> tuple[bytes, bytes]:
    """(.symtab, .strtab) of symbols (name, value, size, type, bind, visibility)."""
    strings = Strings()
    rows = [L.ELF_SYMBOL.write(name_offset=strings(s["name"]), value=s["value"], size=s["size"], info=s["type"] | s.get("bind", 0) << 4, other=s.get("visibility", 0), shndx=s.get("shndx", 0)) for s in symbols]
    return b"".join(rows), bytes(strings.data)


def sndll(symbols: list[dict], base: int = 0, version: int = 1) -> bytes:
    strings, size = Strings(), L.SNDLL_HEADER.size + 8 * (version == 2)
    table = size
    text = table + len(symbols) * L.SNDLL_SYMBOL.size
    rows = b"".join(L.SNDLL_SYMBOL.write(string=base + text + strings(s["string"]) if s["string"] else 0, value=s["value"], type=s["type"]) for s in symbols)
    head = L.SNDLL_HEADER.write(magic=int.from_bytes(b"SNR%d" % version, "little"), symbols=base + table, symbol_count=len(symbols))
    return head + b"\0" * 8 * (version == 2) + rows + bytes(strings.data)


def mdebug(files: list[dict], externals: list[dict] = (), offset: int = 0, moved: int = 0) -> bytes:
    """An .mdebug section that stands at offset and was written for offset - moved.

    files: path, address, symbols (string, value, symbol_type, symbol_class, index), procedures.
    """

    def bits(s):
        return s["symbol_type"] | s["symbol_class"] << 6 | s["index"] << 12

    at = offset - moved + L.SYMBOLIC_HEADER.size
    symbols, procedures, descriptors, strings = bytearray(), bytearray(), [], bytearray()
    for f in files:
        own = Strings()
        first, first_procedure = len(symbols) // L.MDEBUG_SYMBOL.size, len(procedures) // L.PROCEDURE.size
        path = own(f["path"])
        for s in f["symbols"]:
            symbols += L.MDEBUG_SYMBOL.write(string_offset=own(s["string"]), value=s["value"], bits=bits(s))
        for p in f.get("procedures", ()):
            procedures += L.PROCEDURE.write(**p)
        descriptors.append({"address": f.get("address", 0), "path_offset": path, "strings_offset": len(strings), "symbol_base": first, "symbol_count": len(f["symbols"]), "procedure_first": first_procedure, "procedure_count": len(f.get("procedures", ()))})
        strings += own.data
    outer = Strings()
    outside = b"".join(L.EXTERNAL_SYMBOL.write(string_offset=outer(s["string"]), value=s["value"], bits=bits(s)) for s in externals)
    tables = [("procedure_descriptors", procedures), ("local_symbols", symbols), ("local_strings", bytes(strings) + b"\0" * (-len(strings) % 4)), ("external_strings", bytes(outer.data) + b"\0" * (-len(outer.data) % 4)), ("file_descriptors", b"".join(L.FILE_DESCRIPTOR.write(**d) for d in descriptors)), ("external_symbols", outside)]
    head, body = {"magic": L.MDEBUG_MAGIC, "file_descriptor_count": len(files), "external_symbols_count": len(externals), "local_symbol_count": len(symbols) // L.MDEBUG_SYMBOL.size, "procedure_descriptor_count": len(procedures) // L.PROCEDURE.size}, b""
    for name, data in tables:
        if data:
            head[f"{name}_offset"] = at + len(body)
        body += data
    return L.SYMBOLIC_HEADER.write(**head) + body


def attribute(name: str, form: str, value) -> bytes:
    head = (_ATTRIBUTE[name] << 4 | _FORM[form]).to_bytes(2, "little")
    if form == "string":
        return head + value.encode() + b"\0"
    if form in ("block2", "block4"):
        return head + len(value).to_bytes(2 if form == "block2" else 4, "little") + value
    return head + value.to_bytes({"addr": 4, "ref": 4, "data2": 2, "data4": 4, "data8": 8}[form], "little")


def debug(entries: list[tuple], base: int = 0) -> bytes:
    """A .debug section of (tag, [(attribute, form, value)], children), entries and children any iterables; siblings are filled in."""
    out = bytearray()

    def put(entry: tuple) -> None:
        tag, attrs, children = entry
        own = b"".join(attribute(*a) for a in attrs)
        at, head, any_ = len(out), 6 + 6 + len(own), False
        out.extend(head.to_bytes(4, "little") + _TAG[tag].to_bytes(2, "little") + attribute("sibling", "ref", 0) + own)
        for child in children:
            put(child)
            any_ = True
        if any_:
            out.extend((4).to_bytes(4, "little"))
        out[at + 6 : at + 12] = attribute("sibling", "ref", base + len(out))

    for entry in entries:
        put(entry)
    return bytes(out)
