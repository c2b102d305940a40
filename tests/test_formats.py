"""Decoders on built files, hostile bytes, STABS strings and mangled names."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from debuglens.functions import demangle, stabs
from debuglens.sources import decode, forge
from debuglens.sources import layout as L


def test_elf_round_trip():
    symbols = [{"name": "main", "value": 0x1000, "size": 8, "type": 2, "bind": 1}, {"name": "", "value": 0, "size": 0, "type": 0}]
    data, strings = forge.symtab(symbols)
    image = forge.elf([{"name": ".symtab", "content": data, "type": 2, "link": 2}, {"name": ".strtab", "content": strings}], [{"offset": 52, "vaddr": 0x1000, "filesz": 16}])
    parsed = decode.elf(image)
    assert [s["name"] for s in parsed["sections"]] == ["", ".symtab", ".strtab", ".shstrtab"]
    section = decode.section_named(parsed["sections"], ".symtab")
    assert [(s["name"], s["value"], s["type"], s["bind"]) for s in decode.symtab(image, section, parsed["sections"])] == [("main", 0x1000, 2, 1), ("", 0, 0, 0)]
    assert decode.memory(image, parsed["segments"], 0x1004, 4) == image[56:60]
    assert decode.memory(image, parsed["segments"], 0x100E, 4) is None
    assert [x[1] for x in decode.symbol_tables(parsed["sections"])] == ["symtab", "elf_section_headers"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.binary(max_size=8))
def test_damaged_files_are_errors_and_never_crash(at, junk):
    image = bytearray(forge.elf([{"name": ".mdebug", "content": forge.mdebug([{"path": "a.c", "symbols": [{"string": "x:t1=0", "value": 1, "symbol_type": 0, "symbol_class": 0, "index": 0x8F380}]}], offset=52)}]))
    image[at : at + len(junk)] = junk
    try:
        parsed = decode.elf(bytes(image))
        if section := decode.section_named(parsed["sections"], ".mdebug"):
            decode.mdebug(bytes(image), section["offset"])
    except L.Malformed:
        pass


def test_moved_mdebug_sections_are_put_right():
    symbols = [{"string": "f:F1", "value": 4, "symbol_type": 6, "symbol_class": 1, "index": 3}]
    for moved in (0, 64, -16):
        image = b"\0" * 100 + forge.mdebug([{"path": "a.c", "symbols": symbols}], [{"string": "e", "value": 9, "symbol_type": 1, "symbol_class": 1, "index": 0}], offset=100, moved=moved)
        got = decode.mdebug(image, 100)
        assert got["symbols"][0]["string"] == "f:F1" and got["externals"][0]["string"] == "e" and got["files"][0]["path"] == "a.c"


def test_working_directory_comes_from_the_symbol_before():
    so = lambda text: {"string": text, "value": 0, "symbol_type": 0, "symbol_class": 0, "index": decode.SO}
    other = so("x") | {"index": 5}
    image = forge.mdebug([{"path": "a.c", "symbols": [other, other, so("/work/"), so("a.c")]}])
    assert decode.mdebug(image, 0)["files"][0]["working_dir"] == "/work/"


def test_dwarf_tree_and_attributes():
    data = forge.debug([("compile_unit", [("name", "string", "gold.c")], [("subroutine", [("name", "string", "f"), ("low_pc", "addr", 16)], [])]), ("compile_unit", [("name", "string", "sapphire.c"), ("location", "block2", b"\1\2\0\0\0")], [])])
    entries, attrs = decode.dies(data)
    assert [(e["tag"], e["depth"]) for e in entries] == [("compile_unit", 0), ("subroutine", 1), ("compile_unit", 0)]
    assert entries[1]["parent"] == entries[0]["die"]
    assert [a["text"] for a in attrs if a["attr"] == "name"] == ["gold.c", "f", "sapphire.c"]
    assert decode.location(next(a["block"] for a in attrs if a["attr"] == "location")) == [("reg", 2)]
    assert decode.enumeration(b"\1\0\0\0A\0\xff\xff\xff\xffB\0") == [(1, "A"), (-1, "B")]
    with pytest.raises(L.Malformed):
        decode.dies(data[:20] + b"\xff\xff" + data[22:])


def test_sndll_versions_and_addresses():
    symbols = [{"string": "s", "value": 8, "type": 1}, {"string": "", "value": 9, "type": 2}]
    for version in (1, 2):
        assert [(s["string"], s["value"]) for s in decode.sndll(forge.sndll(symbols, 0x5000, version), 0x5000)] == [("s", 8), (None, 9)]
    with pytest.raises(L.Malformed):
        decode.sndll(b"SNR3" + b"\0" * 100)


@pytest.mark.parametrize("name", ["A<N::B>", "L<'<'>", "G<'>'>", "Q<'''>", "P<'\xff77777777'>"])
def test_hostile_names_stay_whole(name):
    assert stabs.parse_symbol(f"{name}:T(1,1)=s1;").name == name


def test_truncated_names():
    with pytest.raises(stabs.Truncated):
        stabs.parse_symbol("Name<'")


def test_stabs_grammar():
    array = stabs.parse_symbol("Array:t(1,1)=(1,2)=ar(1,3)=r(1,3);0;4294967295;;0;0;(1,4)=ar(1,3);0;1;(0,1)").type.child("underlying")
    assert array.child("index").attrs["high"] == "0" and array.child("element").child("index").attrs["high"] == "1"
    enum = stabs.parse_symbol("E:t(1,1)=eA:0,B:1,C:2147483647,D:-2147483648,;").type
    assert enum.attrs["constants"] == [(0, "A"), (1, "B"), (2147483647, "C"), (-2147483648, "D")]
    nested = stabs.parse_symbol("N:T(1,1)=s8c:(1,2)=u4b:(1,3)=s4a:(0,1),0,32;;,0,32;;,0,32;e:(1,4)=s4d:(0,1),0,32;;,32,32;;").type
    assert [n["name"] for n in stabs.flattened(nested) if n["kind"] == "field"] == ["c", "b", "a", "e", "d"]
    bases = stabs.parse_symbol("M:Tt(1,17)=s1!2,000,(1,1);000,(1,9);operator=::(1,18)=##(0,23);:_ZM;2A.;;").type
    assert [n.child("type").number for r, n in bases.children if r == "base"] == [(1, 1), (1, 9)]
    pointer = stabs.parse_symbol("p:t(1,1)=(1,2)=*(1,3)=@(1,4)=xsStruct:,(0,1)").type.child("underlying").child("value")
    assert pointer.kind == "member_pointer" and pointer.child("class").name == "Struct"


@pytest.mark.parametrize(("mangled", "want"), [("NonMangled", None), ("__op4Type", "operator Type"), ("__nw", "operator new"), ("__apl", "operator+="), ("op$assign_plus", "operator+="), ("op$plus", "operator+"), ("type$4Type", "operator Type")])
def test_operator_names(mangled, want):
    assert demangle.operator_name(mangled) == want


@pytest.mark.parametrize(("mangled", "want"), [("_ZN1A1fEv", "A::f()"), ("_ZN1AC1ERKS_", "A::A(A const&)"), ("_Z1fIiEvi", "void f<int>(int)"), ("_ZNK1A1gEi", "A::g(int) const"), ("_ZTV3Foo", "vtable for Foo"), ("plain", None), ("_Z", None)])
def test_itanium_names(mangled, want):
    assert demangle.demangle(mangled) == want


@pytest.mark.parametrize(("mangled", "want"), [("_ZN1AC1ERKS_", "A::A(A const&)"), ("_Z1fIiEvi", "void f<int>(int)"), ("_ZNK1A1gEi", "A::g(int) const"), ("_ZTV3Foo", "vtable for Foo")])
def test_special_names_templates_and_substitutions(mangled, want):
    assert demangle.demangle(mangled) == want
