"""From the ordered symbols of a file to entity rows.

A file's symbols are a sequence in which procedures, blocks and variables refer to what came
before. Files are independent, so they are dealt out by file and folded in order; a fold keeps
one function at a time and gives its rows when the function ends.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.functions import ast, stabs
from debuglens.session import by_key, cut, ready

STABS_BASE = 0x8F300
#: Codes of stabs symbols: those whose strings are parsed, and those with a meaning of their own.
PARSED = {0x20, 0x24, 0x26, 0x28, 0x40, 0x80, 0xA0}
FUN, SO, SOL, LBRAC, RBRAC = 0x24, 0x64, 0x84, 0xC0, 0xE0
TEXT = 1
PROC, LABEL, END, STATIC_PROC = 6, 5, 8, 14
#: Symbol classes that are places of global variables.
LOCATIONS = {0: "nil", 2: "data", 3: "bss", 5: "abs", 13: "sdata", 14: "sbss", 15: "rdata", 17: "common", 18: "scommon", 21: "sundefined"}
PARAMETERS = {"value_parameter": (True, False), "register_parameter": (False, False), "reference_parameter_a": (False, True), "reference_parameter_v": (False, True)}

SCHEMA = pa.schema(
    [("file", pa.int64()), ("seq", pa.int64()), ("entity", pa.string()), ("name", pa.string()), ("owner", pa.int64()), ("address", pa.int64()), ("size", pa.int64())]
    + [("storage", pa.string()), ("number", pa.int64()), ("is_by_reference", pa.bool_()), ("is_static", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("path", pa.string()), ("type_kind", pa.string()), ("file_no", pa.int64()), ("type_no", pa.int64()), ("tree", pa.string())]
)
COLUMNS = "file long, seq long, entity string, name string, owner long, address long, size long, storage string, number long, is_by_reference boolean, is_static boolean, low long, high long, path string, type_kind string, file_no long, type_no long, tree string"


class MalformedSymbols(ValueError):
    """A sequence of symbols that no compiler should give."""


class Fold:
    """One file's state; feed() takes symbols in order, and rows are ready after each call."""

    def __init__(self, file: int, base: int = 0, path: str = "", trees: bool = False):
        self.file, self.base, self.path = file, base, path
        #: The file's type definitions by number, if rows are to have the trees of their types.
        self.types: dict | None = {} if trees else None
        #: Whether faults of this file's symbols are errors; not after a string that the compiler cut off.
        self.strict = True
        self.rows: list[dict] = []
        self.function: dict | None = None
        self.beginning = False
        self.inside: list[dict] = []
        self.blocks: list[list[dict]] = []
        self.waiting: list[dict] = []
        self.next_path, self.held = "", ""

    def row(self, entity: str, seq: int, name: str, **more) -> dict:
        return {"file": self.file, "seq": seq, "entity": entity, "name": name} | more

    def feed(self, s: dict) -> None:
        code = s["index"] - STABS_BASE if s["index"] & 0xFFF00 == STABS_BASE else None
        if code is None:
            if s["symbol_class"] == TEXT:
                self.text_symbol(s)
        elif code in PARSED:
            self.string_symbol(s, code)
        elif code == SO:
            self.next_path = self.next_path or self.path
        elif code == SOL:
            if self.function is not None and self.beginning:
                self.rows.append(self.row("sub_source_file", s["sym_idx"], s["string"], owner=self.function["seq"], address=s["value"]))
            else:
                self.next_path = s["string"]
        elif code == LBRAC:
            for v in self.waiting:
                v["low"] = self.base + s["value"]
            self.blocks.append(self.waiting)
            self.waiting = []
        elif code == RBRAC:
            if not self.blocks:
                raise MalformedSymbols("a block ends that never began")
            for v in self.blocks.pop():
                v["high"] = self.base + s["value"]

    def text_symbol(self, s: dict) -> None:
        kind = s["symbol_type"]
        if kind in (PROC, STATIC_PROC):
            self.enter(s["string"], s)
            if kind == STATIC_PROC:
                self.function["is_static"] = True
            if s.get("frame_size") is not None:
                self.function["number"] = s["frame_size"]
        elif kind == LABEL and self.function is not None and s["string"].startswith("$"):
            self.rows.append(self.row("line_number", s["sym_idx"], s["string"], owner=self.function["seq"], address=s["value"], number=s["index"]))
        elif kind == END and self.beginning:
            self.function["size"] = s["value"]
            self.beginning = False

    def string_symbol(self, s: dict, code: int) -> None:
        if not s["string"]:
            if self.held:
                raise MalformedSymbols("a string goes on in an empty one")
            if code == FUN:
                self.leave()
            return
        text = self.held + s["string"]
        if text.endswith("\\"):
            self.held = text[:-1]
            return
        self.held = ""
        try:
            parsed = stabs.parse_symbol(text)
        except stabs.Truncated:
            self.strict = False  # more faults are to be expected in this file
            return
        except stabs.StabsError as e:
            if self.strict:
                raise MalformedSymbols(str(e)) from e
            return
        self.parsed(s, parsed)

    def parsed(self, s: dict, p: stabs.Symbol) -> None:
        seq, number = s["sym_idx"], p.type.number or (None, None)
        shape = {"type_kind": p.type.kind, "file_no": number[0], "type_no": number[1]}
        if self.types is not None:
            p.type.numbered(self.types)
            shape["node"] = p.type
        if p.descriptor in ("local_function", "global_function"):
            if not self.enter(p.name, s) and s["value"] > (self.function["address"] or 0):
                self.function["address"] = s["value"]  # procedures of some files have relative addresses
            self.function |= shape
        elif p.descriptor in PARAMETERS:
            if self.function is None:
                raise MalformedSymbols("a parameter before the first function")
            on_stack, reference = PARAMETERS[p.descriptor]
            self.inside.append(self.row("parameter", seq, p.name, storage="stack" if on_stack else "register", number=signed(s["value"]), is_by_reference=reference, owner=self.function["seq"], **shape))
        elif p.descriptor in ("register_variable", "local_variable", "static_local_variable"):
            if self.function is None:
                return
            local = self.row("local", seq, p.name, owner=self.function["seq"], **shape)
            if p.descriptor == "static_local_variable":
                local |= {"storage": self.place(s["symbol_class"]), "address": s["value"], "is_static": True}
            else:
                local |= {"storage": "register" if p.descriptor == "register_variable" else "stack", "number": signed(s["value"])}
            self.inside.append(local)
            self.waiting.append(local)
        elif p.descriptor in ("global_variable", "static_global_variable"):
            fixed = p.descriptor == "static_global_variable"
            # the address of a variable that isn't static is that of the external symbol of its name
            self.rows.append(self.row("global", seq, p.name, address=s["value"] if fixed else None, storage=self.place(s["symbol_class"]), is_static=fixed, **shape))
        else:
            name = "" if p.name == " " else p.name
            self.rows.append(self.row("data_type", seq, name, size=p.type.attrs.get("size"), is_static=None, storage="typedef" if p.type.attrs["is_typedef"] else None, **shape))

    @staticmethod
    def place(symbol_class: int) -> str:
        if symbol_class not in LOCATIONS:
            raise MalformedSymbols(f"symbol class {symbol_class} is no place of a variable")
        return LOCATIONS[symbol_class]

    def enter(self, name: str, s: dict) -> bool:
        """Whether a new function began; symbols of the current one's name belong to it."""
        if self.function is not None and self.function["name"] == name:
            return False
        self.leave()
        self.function = self.row("function", s["sym_idx"], name, address=s["value"], path=self.next_path or None, is_static=False)
        self.beginning = True
        return True

    def leave(self) -> None:
        if self.function is not None:
            self.rows += [self.function, *self.inside]
        self.function, self.beginning, self.inside, self.blocks, self.waiting = None, False, [], [], []

    def finish(self) -> None:
        if self.beginning:
            raise MalformedSymbols("the symbols end inside a function")
        self.leave()
        for r in self.rows if self.types is not None else ():
            # a type may be used before it is defined
            if (node := r.pop("node", None)) is not None:
                r["tree"] = json.dumps(ast.from_stabs(node, self.types), sort_keys=True)


def signed(value: int) -> int:
    return value - (1 << 32) if value >= 1 << 31 else value


INPUT = ["file", "sym_idx", "value", "symbol_type", "symbol_class", "index", "string", "base", "frame_size"]


def analyse(symbols: DataFrame, externals: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Entity rows of symbols (file, sym_idx, value, symbol_type, symbol_class, index, string, base, frame_size).

    ``index``, ``base`` and ``frame_size`` may be null only where they say nothing; ``path``, if
    there, is each file's own path. Non-static global variables have the address and the place of
    the external symbol of their name: externals are (string, value, symbol_class), with module
    if symbols have it too; of several of a name the first (by sym_idx, if there) counts. Whatever
    the number of files is, a task holds one function of one file. A file whose symbols are
    malformed fails the query if strict; otherwise it gives no rows, like a transaction that is
    taken back, and faults() tells why.
    """
    rows = folded(symbols, strict)
    if externals is not None:
        owners = symbols.groupBy("file").agg(F.first("module", True).alias("module")) if "module" in symbols.columns and "module" in externals.columns else None
        rows = located(cut(rows), externals, owners)
    return rows.filter("entity <> 'fault'")


def faults(symbols: DataFrame) -> DataFrame:
    """(file, message) of the files that analyse(strict=False) leaves out."""
    return folded(symbols, False).filter("entity = 'fault'").select("file", F.col("name").alias("message"))


def folded(symbols: DataFrame, strict: bool, trees: bool = False) -> DataFrame:
    """Entity rows, without the addresses that only external symbols know; entity fault names what is wrong with a file.

    tree is the JSON text of a row's type if trees are wanted; a task then holds the rows of one file.
    """
    ready(symbols.sparkSession)
    placed = symbols.select(*INPUT, F.col("path") if "path" in symbols.columns else F.lit(None).cast("string").alias("path"))

    def run(batches):
        fold, bad = None, False

        def end():
            try:
                fold.finish()
            except MalformedSymbols as e:
                return fault(e)
            return fold.rows

        def fault(e):
            if strict:
                raise e
            return [{"file": fold.file, "entity": "fault", "name": str(e)}]

        held: list[dict] = []
        for batch in batches:
            for s in batch.to_pylist():
                if fold is None or fold.file != s["file"]:
                    if fold is not None and not bad:
                        held += end()
                    fold, bad = Fold(s["file"], s["base"] or 0, s["path"] or "", trees), False
                if bad:
                    continue
                try:
                    fold.feed(s)
                except MalformedSymbols as e:
                    held += fault(e)
                    bad = True
                # what isn't strict may have to take a whole file back
                if strict and not trees and len(fold.rows) > 10_000:
                    held += fold.rows
                    fold.rows = []
                if len(held) > 10_000:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)
                    held = []
        if fold is not None and not bad:
            held += end()
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)

    ordered = placed.repartition("file").sortWithinPartitions("file", "sym_idx")
    return ordered.mapInArrow(run, COLUMNS)


def located(rows: DataFrame, externals: DataFrame, owners: DataFrame | None) -> DataFrame:
    """rows with the address and place of global variables that aren't static; owners has (file, module) if externals have a module."""
    key = ["module_", "name"]
    order = F.col("sym_idx") if "sym_idx" in externals.columns else F.col("value")
    module = F.lit(-1).cast("long") if owners is None else F.coalesce("module", F.lit(-1).cast("long"))
    named = externals.select(module.alias("module_"), F.col("string").alias("name"), F.struct("value", "symbol_class").alias("of_"), order.alias("order_"))
    first = named.groupBy(key).agg(F.min_by("of_", "order_").alias("found_"))
    wanted = F.coalesce((F.col("entity") == "global") & ~F.col("is_static"), F.lit(False))
    sought = rows.filter(wanted)
    sought = sought.withColumn("module_", F.lit(-1).cast("long")) if owners is None else sought.join(by_key(owners.select("file", module.alias("module_"))), "file")
    places = F.create_map(*[F.lit(x) for k, v in LOCATIONS.items() for x in (k, v)])
    told = sought.join(by_key(first), key, "left").withColumn("address", F.coalesce("found_.value", "address"))
    told = told.withColumn("storage", F.coalesce(F.try_element_at(places, F.col("found_.symbol_class").cast("int")), "storage"))
    return rows.filter(~wanted).unionByName(told.drop("found_", "module_"))
