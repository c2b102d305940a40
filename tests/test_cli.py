import pytest

from debuglens.__main__ import COMMANDS, main, parser
from debuglens.sources import forge


def test_help_names_every_command():
    assert all(c in parser().format_help() for c in COMMANDS)


@pytest.mark.parametrize(("command", "rows"), [("identify", 2), ("sections", 5), ("symbols", 1), ("functions", 1), ("tables", 3)])
def test_commands(spark, tmp_path, command, rows):
    data, strings = forge.symtab([{"name": "main", "value": 8, "size": 4, "type": 2}])
    symbols = [{"string": "main", "value": 8, "symbol_type": 6, "symbol_class": 1, "index": 0}, {"string": "main", "value": 4, "symbol_type": 8, "symbol_class": 1, "index": 0}]
    head = [{"name": ".symtab", "content": data, "type": 2, "link": 2}, {"name": ".strtab", "content": strings}]
    offset = 52 + len(data) + len(strings) + -len(strings) % 4
    section = forge.mdebug([{"path": "a.c", "symbols": symbols, "procedures": [{"symbol_index": 0, "frame_size": 16}]}], offset=offset)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.elf").write_bytes(forge.elf([*head, {"name": ".mdebug", "content": section}]))
    (tmp_path / "in" / "b.txt").write_text("no symbols")
    main([command, str(tmp_path / "in"), "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows
