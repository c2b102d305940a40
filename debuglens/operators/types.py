"""Types across files: greedy deduplication in order, and trees, C++ and literals as tables."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from debuglens.functions import ast, stabs
from debuglens.session import by_key, dealt, ready


def tree_of(text: str) -> dict:
    """The tree of a STABS string's type, with the types that the string itself defines."""
    symbol = stabs.parse_symbol(text)
    return ast.from_stabs(symbol.type, symbol.type.numbered()) | {"name": symbol.name}


def trees(rows: DataFrame) -> DataFrame:
    """Adds tree, the JSON text of the type of column stab."""
    ready(rows.sparkSession)

    def run(batches):
        for batch in batches:
            made = [json.dumps(tree_of(s), sort_keys=True) for s in batch.column(batch.schema.names.index("stab")).to_pylist()]
            yield batch.append_column("tree", pa.array(made, pa.string()))

    return dealt(rows).mapInArrow(run, StructType([*rows.schema.fields, StructField("tree", StringType())]))


def deduplicated(types: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, name, representative, shape, files, reason) of types (*within, name, seq, file, tree).

    Equal trees of a name collapse first, by a partial aggregation. The distinct shapes of a
    name then go, in order of first appearance, to the first representative that they match; a
    shape that says more takes its place, and one that matches none is a type of its own with
    the reason. Shapes of a name are few: a task holds one name's at a time, and names follow
    each other in its batches, as a group of Arrow's own for each name takes over a millisecond.
    """
    ready(types.sparkSession)
    keys = (*within, "name")
    shapes = types.groupBy(*keys, "tree").agg(F.min("seq").alias("seq"), F.collect_set("file").alias("files"))

    def one(rows: list[tuple]) -> list[tuple]:
        kept: list[dict] = []
        for *_, text, seq, files in rows:
            tree, reason = json.loads(text), None
            for k in kept:
                found = ast.compare(k["tree"], tree)
                if not found.startswith("differs"):
                    if found == "right":
                        k["tree"], k["representative"] = tree, seq
                    k["files"] |= set(files)
                    break
                reason = found
            else:
                kept.append({"representative": seq, "tree": tree, "files": set(files), "reason": reason})
                if reason:
                    kept[0]["reason"] = kept[0]["reason"] or reason
        return [(*rows[0][: len(keys)], k["representative"], json.dumps(k["tree"], sort_keys=True), sorted(k["files"]), k["reason"]) for k in kept]

    def run(batches):
        held: list[tuple] = []
        name: list[tuple] = []
        kinds = None

        def give():
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*held), [*kinds, pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()])]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "representative", "shape", "files", "reason"])

        for batch in batches:
            kinds = [batch.column(k).type for k in range(len(keys))]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if name and name[0][: len(keys)] != row[: len(keys)]:
                    held += one(name)
                    name = []
                name.append(row)
                if len(held) >= 10_000:
                    yield give()
                    held = []
        if name:
            held += one(name)
        if held:
            yield give()

    given = ", ".join(f"{k} {types.schema[k].dataType.simpleString()}" for k in keys)
    ordered = shapes.select(*keys, "tree", "seq", "files").repartition(*keys).sortWithinPartitions(*keys, "seq")
    return ordered.mapInArrow(run, f"{given}, representative long, shape string, files array<string>, reason string")


def each(rows: DataFrame, of, columns: str) -> DataFrame:
    """of(tree) as rows for each row's tree, keyed by the first column."""
    from debuglens.sources.tables import decoded

    return decoded(rows.select(rows.columns[0], "tree"), lambda t: of(json.loads(t)), columns)


def refined(rows: DataFrame) -> DataFrame:
    """(key, path, value): literals of rows (key, tree, data)."""
    from debuglens.sources.tables import decoded

    return decoded(rows.select(rows.columns[0], "tree", "data"), lambda t, d: [{"path": p, "value": v} for p, v in ast.refined(json.loads(t), d)], "path string, value string")


def map_to_files(types: DataFrame, references: DataFrame) -> DataFrame:
    """(handle, files) of types (module, handle, files) after one pass of reference counting.

    references: (src, dst, n), how often src's tree refers to dst, through chains of type names.
    A type of several candidate files goes to the one whose types refer to it most, ties to the
    earlier candidate, if any does. What types of one file refer to is counted by a join and an
    aggregation; only the types that are still open go, in order of their handles, through a
    loop per module in which a type that has found its file counts for those after it.
    """
    ready(types.sparkSession)
    settled = types.filter(F.size("files") == 1).select(F.col("handle").alias("src"), F.col("files")[0].alias("file"))
    open_ = types.filter(F.size("files") > 1)
    counts = references.join(by_key(settled), "src").groupBy(F.col("dst").alias("handle"), "file").agg(F.sum("n").alias("n"))
    counted = open_.join(by_key(counts), "handle", "left").groupBy("module", "handle", "files").agg(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("file", "n"))).alias("counts"))
    inner = references.join(by_key(open_.select(F.col("handle").alias("src"))), "src", "left_semi").join(by_key(open_.select(F.col("handle").alias("dst"))), "dst", "left_semi")
    uses = inner.groupBy(F.col("src").alias("handle")).agg(F.collect_list(F.struct("dst", "n")).alias("uses"))
    rows = counted.join(by_key(uses), "handle", "left").select("module", "handle", "files", "counts", "uses")

    def one(table: pa.Table) -> pa.Table:
        later: dict[tuple[int, int], int] = {}
        handles, files = [], []
        for row in table.sort_by("handle").to_pylist():
            n = {c["file"]: c["n"] for c in row["counts"]}
            best, most = None, 0
            for f in row["files"]:
                if (total := n.get(f, 0) + later.get((row["handle"], f), 0)) > most:
                    best, most = f, total
            handles.append(row["handle"])
            files.append(row["files"] if best is None else [best])
            for use in row["uses"] or () if best is not None else ():
                key = (use["dst"], best)
                later[key] = later.get(key, 0) + use["n"]
        return pa.table({"handle": pa.array(handles, pa.int64()), "files": pa.array(files, pa.list_(pa.int64()))})

    found = rows.groupBy("module").applyInArrow(one, "handle long, files array<long>")
    return found.unionByName(types.filter(F.size("files") <= 1).select("handle", "files"))
