"""Symbol sequences of one file through the analyser, and whole files through the importer, on cases of our own."""

import pytest

from debuglens.operators.analyser import STABS_BASE, Fold, MalformedSymbols, analyse, faults
from debuglens.operators.importer import import_files, numbered
from debuglens.sources import forge

LSYM, FUN, GSYM, PSYM, RSYM, SO, SOL, LBRAC, RBRAC, STSYM = 0x80, 0x24, 0x20, 0xA0, 0x40, 0x64, 0x84, 0xC0, 0xE0, 0x26


def stab(text, code=LSYM, value=0, symbol_class=0):
    return {"string": text, "value": value, "symbol_type": 0, "symbol_class": symbol_class, "index": STABS_BASE + code}


def plain(text, kind, value=0, index=0):
    return {"string": text, "value": value, "symbol_type": kind, "symbol_class": 1, "index": index}


def folded(symbols, base=0, path=""):
    f = Fold(1, base, path)
    for k, s in enumerate(symbols):
        f.feed({"sym_idx": k, "frame_size": None, **s})
    f.finish()
    return f


def entities(symbols, entity, *columns, **given):
    return [tuple(r.get(c) for c in columns) for r in folded(symbols, **given).rows if r["entity"] == entity]


BODY = [stab("one:p(0,1)", PSYM, 8), stab("two:P(0,1)", RSYM, 5)]
FUN_FIRST = [stab("walk:F(0,3)", FUN, 64), plain("walk", 6, 64), *BODY, plain("walk", 8, 32), stab("", FUN)]
PROC_FIRST = [plain("walk", 6, 64), stab("walk:F(0,3)", FUN, 64), *BODY, plain("walk", 8, 32), stab("", FUN)]


@pytest.mark.parametrize("symbols", [FUN_FIRST, PROC_FIRST])
def test_either_order_of_string_and_procedure_is_one_function(symbols):
    assert entities(symbols, "function", "name", "address", "size") == [("walk", 64, 32)]
    assert entities(symbols, "parameter", "name", "storage", "number", "owner") == [("one", "stack", 8, 0), ("two", "register", 5, 0)]


def test_functions_end_where_another_name_begins():
    second = [plain("run", 14, 128), stab("run:f(0,3)", FUN, 128), plain("run", 8, 16)]
    assert entities([*PROC_FIRST[:-1], *second], "function", "name", "is_static") == [("walk", False), ("run", True)]
    with pytest.raises(MalformedSymbols):
        folded(PROC_FIRST[:2])


def test_blocks_nest_and_give_live_ranges():
    inner = [stab("b:(0,1)", value=4), stab("", LBRAC, 12), stab("c:r(0,1)", RSYM, 6), stab("", LBRAC, 20), stab("", RBRAC, 24), stab("", RBRAC, 28)]
    symbols = [*PROC_FIRST[:-1], stab("a:(0,1)", value=0), stab("", LBRAC, 8), *inner, stab("", RBRAC, 32), stab("", FUN)]
    assert entities(symbols, "local", "name", "storage", "low", "high", base=1000) == [("a", "stack", 1008, 1032), ("b", "stack", 1012, 1028), ("c", "register", 1020, 1024)]
    with pytest.raises(MalformedSymbols):
        folded([*PROC_FIRST[:-1], stab("", RBRAC, 4)])


@pytest.mark.parametrize(
    ("strings", "want"),
    [
        (["Colour:t(1,1)=eRED:0,BLUE:1,;"], [("Colour", "enum", "typedef")]),
        ([" :T(1,1)=eRED:0,;", "Colour:t(1,2)=(1,1)"], [("", "enum", None), ("Colour", "alias", "typedef")]),
        (["Node:T(1,1)=s4n:(0,1),0,32;;"], [("Node", "struct", None)]),
        (["Node:Tt(1,1)=s4n:(0,1),0,32;;"], [("Node", "struct", None)]),
        (["Both:T(1,1)=u4;", "Both:t(1,1)"], [("Both", "union", None), ("Both", "use", "typedef")]),
        (["Nothing:t7=7"], [("Nothing", "alias", "typedef")]),
    ],
)
def test_types_as_rows(strings, want):
    assert entities([stab(s) for s in strings], "data_type", "name", "type_kind", "storage") == want


def test_strings_that_go_on_and_strings_that_were_cut_off():
    assert entities([stab("Long:T(1,1)=s8a:(0,1),\\"), stab("0,32;;")], "data_type", "name", "size") == [("Long", 8)]
    with pytest.raises(MalformedSymbols):
        folded([stab("half\\"), stab("")])
    with pytest.raises(MalformedSymbols):
        folded([stab("Bad:Z(1,1)=s4;")])
    # after a cut-off string other faults of the file are passed over
    cut = folded([stab("Cut<'"), stab("Bad:Z(1,1)=s4;"), stab("Good:T(1,2)=s4;")])
    assert [r["name"] for r in cut.rows] == ["Good"]


def test_paths_of_included_files():
    symbols = [stab("lib/list.h", SOL), *PROC_FIRST]
    assert entities(symbols, "function", "path") == [("lib/list.h",)]
    symbols = [PROC_FIRST[0], stab("lib/tree.h", SOL, 72), *PROC_FIRST[1:]]
    assert entities(symbols, "sub_source_file", "name", "address") == [("lib/tree.h", 72)]
    assert entities([stab("x", SO), *PROC_FIRST], "function", "path", path="main.c") == [("main.c",)]


INPUT = "file long, sym_idx long, value long, symbol_type long, symbol_class long, index long, string string, base long, frame_size long"


def frame(spark, files):
    rows = [(f, k, s["value"], s["symbol_type"], s["symbol_class"], s["index"], s["string"], 0, None) for f, symbols in files.items() for k, s in enumerate(symbols)]
    return spark.createDataFrame(rows, INPUT)


def test_malformed_files_leave_nothing_behind(spark):
    good, bad = [*PROC_FIRST, stab("g:G(0,1)", GSYM)], [*PROC_FIRST, stab("a:p(0,1)", PSYM)]
    symbols = frame(spark, {1: good, 2: bad, 3: [stab("h:S(0,1)", STSYM, 8, 99)]})
    with pytest.raises(Exception, match="parameter before|no place"):
        analyse(symbols).collect()
    assert {r["file"] for r in analyse(symbols, strict=False).collect()} == {1}
    assert {(r["file"], r["message"]) for r in faults(symbols).collect()} == {(2, "a parameter before the first function"), (3, "symbol class 99 is no place of a variable")}


def test_global_variables_take_the_address_of_their_external_symbol(spark):
    symbols = frame(spark, {1: [stab("g:G(0,1)", GSYM), stab("s:S(0,1)", STSYM, 44, 13), stab("lost:G(0,1)", GSYM)]})
    externals = spark.createDataFrame([("g", 800, 14, 2), ("g", 900, 3, 5), ("s", 700, 14, 3)], "string string, value long, symbol_class long, sym_idx long")
    got = {r["name"]: (r["address"], r["storage"], r["is_static"]) for r in analyse(symbols, externals).collect()}
    assert got == {"g": (800, "sbss", False), "s": (44, "sdata", True), "lost": (None, "nil", False)}


def test_units_of_debug_sections_are_source_files(spark):
    unit = lambda name, low, subs: ("compile_unit", [("name", "string", name), ("low_pc", "addr", low), ("high_pc", "addr", low + 64)], subs)
    sub = lambda tag, *attrs: (tag, list(attrs), [])
    first = unit("a.c", 64, [sub("subroutine", ("name", "string", "f"), ("low_pc", "addr", 64), ("high_pc", "addr", 96)), sub("structure_type", ("name", "string", "S"), ("byte_size", "data4", 12))])
    again = unit("a.c", 128, [sub("global_subroutine", ("name", "string", "g"), ("mangled_name", "string", "_Z1gi"), ("low_pc", "addr", 128)), sub("pointer_type")])
    other = unit("b.c", 512, [])
    debug = forge.debug([first, again, other, first])
    image = forge.elf([{"name": ".debug", "content": debug}, {"name": ".line", "content": b"\0" * 4}])
    db = import_files(spark.createDataFrame([("/x", image), ("/broken", image[:-30]), ("/none", b"text")], "path string, content binary"))
    files = [(r["name"], r["address"], r["size"]) for r in db["source_files"].orderBy("handle").collect()]
    assert files == [("a.c", 64, 128), ("b.c", 512, 64), ("a.c", 64, 64)]
    functions = [(r["name"], r["mangled_name"], r["address"], r["size"], r["is_static"], r["source_file"]) for r in db["functions"].orderBy("handle").collect()]
    assert functions == [("f", None, 64, 32, True, 0), ("g(int)", "_Z1gi", 128, None, False, 0), ("f", None, 64, 32, True, 2)]
    assert [(r["name"], r["size"], r["source_file"]) for r in db["data_types"].orderBy("handle").collect()] == [("S", 12, 0), ("S", 12, 2)]
    assert {r["path"]: r["message"] for r in db["faults"].collect()}.keys() == {"/broken", "/none"}


def test_units_of_overlays(spark):
    def image(first, second):
        return forge.debug([("overlay", [("overlay_id", "data4", 7), ("member", "ref", second), ("member", "ref", second)], []), ("overlay", [("overlay_id", "data4", 9), ("member", "ref", second)], []), ("compile_unit", [("name", "string", "base.c")], []), ("compile_unit", [("name", "string", "over.c")], [])])

    from debuglens.sources import decode

    units = [e["die"] for e in decode.dies(image(0, 0))[0] if e["tag"] == "compile_unit"]
    files = spark.createDataFrame([("/x", forge.elf([{"name": ".debug", "content": image(*units)}, {"name": ".line", "content": b"\0" * 4}]))], "path string, content binary")
    for overlay, want in ((None, ["base.c"]), (7, ["over.c"]), (9, [])):
        assert [r["name"] for r in import_files(files, overlay=overlay)["source_files"].collect()] == want


def test_dynamic_libraries_are_classified_by_section(spark):
    library = forge.sndll([{"string": s, "value": v, "type": 2} for s, v in (("code", 0x1004), ("data", 0x2008), ("far", 0x9000), ("", 0x1008), ("zero", 0), ("dup", 0x1004))], base=0x3000)
    sections = [{"name": ".text", "content": b"\0" * 64, "addr": 0x1000}, {"name": ".data", "content": b"\0" * 64, "addr": 0x2000}, {"name": ".sndata", "content": library, "addr": 0x3000}]
    files = spark.createDataFrame([("/x", forge.elf(sections))], "path string, content binary")
    db = import_files(files)
    assert {k: [r["name"] for r in db[k].orderBy("handle").collect()] for k in ("functions", "global_variables", "labels")} == {"functions": ["code"], "global_variables": ["data"], "labels": ["far"]}
    assert [r["name"] for r in import_files(files, deduplicate=False)["functions"].orderBy("handle").collect()] == ["code", "dup"]


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id AS v").repartition(13)
    assert all(r["handle"] == r["k"] for r in numbered(rows, "k").collect())
    assert numbered(rows.limit(0), "k").count() == 0
