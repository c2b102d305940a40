"""C++ text and source files: the command line on a small forged program, and rules on cases of our own."""

import pytest

from debuglens.__main__ import REPORTS, main
from debuglens.functions import cpp
from debuglens.operators import printing
from debuglens.operators.importer import import_files
from debuglens.operators.reports import JSON_VERSION
from debuglens.plans.printing import _image
from debuglens.sources import tables

INT = {"kind": "builtin", "class": "signed_32", "name": "int"}
POINT = {"kind": "struct", "size": 8, "bases": [], "members": [], "fields": [{"kind": "type_name", "refers": "int", "name": n, "offset": o, "forward": False} for n, o in (("x", 0), ("y", 4))]}


def test_places_of_variables():
    plain, caller, none = cpp.PrinterConfig(), cpp.PrinterConfig(caller_stack_offsets=True), cpp.PrinterConfig(print_storage_information=False)
    at = lambda storage, **v: {"storage": storage, "place": None, "address": None} | v
    assert cpp.place(at("stack", place=-8), 32, plain) == "/* 0x18(sp) */ "
    assert cpp.place(at("stack", place=-8), 32, caller) == cpp.place(at("stack", place=-8), None, plain) == "/* -0x8(caller sp) */ "
    assert cpp.place(at("register", place=29), None, plain) == "/* sp 29 */ "
    assert cpp.place(at("register", place=40), None, plain) == "/* f2 40 */ "
    assert cpp.place(at("bss", address=255), None, plain) == "/* bss ff */ "
    assert cpp.place(at("bss"), None, plain) == "/* bss */ "
    assert cpp.place(at("stack", place=4), 8, none) == cpp.place(at(None), 8, plain) == ""


def test_functions_without_known_parameters_and_with_bodies():
    row = {"name": "run", "address": 16, "size": 4, "frame_size": None, "is_static": True, "is_member": True, "tree": None}
    assert cpp.function(row, cpp.PrinterConfig()) == ("/* 00000010 00000004 */ static run(/* parameters unknown */) {}", False)
    assert cpp.function(row | {"parameters": [], "body": "\t;\n"}, cpp.PrinterConfig(print_storage_information=False)) == ("static run() {\n\t;\n}", True)
    assert cpp.function(row, cpp.PrinterConfig(skip_statics=True)) is None
    assert cpp.function(row, cpp.PrinterConfig(skip_member_functions_outside_types=True)) is None


def test_initialisers_nest():
    data = b"".join(v.to_bytes(4, "little") for v in (1, 2, 3, 4))
    two = {"kind": "array", "count": 2, "element": {"kind": "type_name", "refers": "Point", "name": "Point", "forward": False}}
    point = lambda a, b: f"{{\n\t\t/* .x = */ {a},\n\t\t/* .y = */ {b}\n\t}}"
    assert cpp.literals(two, data, named={"Point": POINT, "int": INT}) == f"{{\n\t/* [0] = */ {point(1, 2)},\n\t/* [1] = */ {point(3, 4)}\n}}"
    assert cpp.literals(two | {"count": 0}, data) == "{\n}"


def test_paths_take_the_next_file_of_their_name(spark):
    files = spark.createDataFrame([(0, h, n) for h, n in enumerate(["/w/a.c", "/w/x.c", "b.c", "a.c", "c.c"])], "module_handle long, handle long, name string")
    paths = spark.createDataFrame([(0, i, p) for i, p in enumerate(["one/a.c", "two/b.c", "gone.c", "three/c.c"])], "module_handle long, idx int, path string")
    assert {(r["path"], r["file"]) for r in printing.paired(files, paths).collect()} == {("one/a.c", 0), ("two/b.c", 2)}


@pytest.fixture(scope="module")
def program(tmp_path_factory):
    folder = tmp_path_factory.mktemp("program")
    (folder / "in").mkdir()
    (folder / "in" / "game.elf").write_bytes(_image([{"module": 0, "k": k, "size": 4 * k} for k in (1, 2, 3)]))
    (folder / "list.txt").write_text("src/m0_0.c\nsrc/m0_1.c src/other.s\n")
    return folder


def test_source_files_are_written_below_their_folder(spark, program):
    out = program / "out"
    (out / "src").mkdir(parents=True)
    (out / "src" / "m0_0.c").write_text("int mine;\n")
    (out / "src" / "m0_1.h").write_text("// STATUS: NOT STARTED\nold\n")
    main(["sources", str(program / "in"), "--list", str(program / "list.txt"), "--out", str(out)])
    assert sorted(p.name for p in (out / "src").iterdir()) == ["m0_0.c", "m0_0.h", "m0_1.c", "m0_1.h"]
    assert (out / "src" / "m0_0.c").read_text() == "int mine;\n"
    assert "struct Both {\n\tint v;\n};" in (out / "src" / "m0_1.h").read_text()
    assert "T3 t3 = {\n\t/* .m = */ 3,\n\t/* .next = */ &t3," in (out / "src" / "m0_1.c").read_text()
    with pytest.raises(ValueError, match="not below"):
        printing.write_sources(spark.createDataFrame([("../escape.c", "x")], "path string, text string"), str(out))


@pytest.fixture(scope="module")
def database(spark, program):
    return import_files(tables.images(spark, str(program / "in")))


@pytest.mark.parametrize("command", REPORTS)
def test_reports(spark, program, database, capsys, monkeypatch, command):
    monkeypatch.setattr("debuglens.__main__.import_files", lambda files: database)
    main([command, str(program / "in")])
    text = capsys.readouterr().out
    want = {"print-functions": "int f2(/* 0x10(caller sp) */ int a) {", "print-globals": "T1 t1;", "print-types": "struct Both { // 0x4", "type-graph": " -> ", "labels": "", "files": "00001000 src/m0_1.c", "json": '"name":"t2"', "faults": ""}
    assert want[command] in text
    if command == "json":
        import json

        document = json.loads(text)
        assert document["version"] == JSON_VERSION and len(document["functions"]) == 3
