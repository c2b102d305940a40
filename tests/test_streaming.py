from debuglens.sources import forge, tables
from debuglens.streaming.follow import follow


def test_files_are_decoded_as_they_arrive(spark, tmp_path):
    folder, out, marks = (tmp_path / n for n in ("in", "out", "marks"))
    folder.mkdir()

    def put(name, symbols):
        data, strings = forge.symtab([{"name": s, "value": k + 1, "size": 4, "type": 2} for k, s in enumerate(symbols)])
        (folder / name).write_bytes(forge.elf([{"name": ".symtab", "content": data, "type": 2, "link": 2}, {"name": ".strtab", "content": strings}]))

    for name, symbols, total in (("a.elf", ["f", "g"], 2), ("b.elf", ["h"], 3)):
        put(name, symbols)
        follow(spark, str(folder), tables.elf_symbols, str(out), str(marks), once=True).awaitTermination()
        assert spark.read.parquet(str(out)).count() == total
