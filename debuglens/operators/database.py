"""The symbol database: named tables, immutable; every change gives a new database."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The entity lists in the order in which lookups over several kinds search them.
KINDS = ("data_types", "functions", "global_variables", "labels", "local_variables", "modules", "parameter_variables", "sections", "source_files", "symbol_sources")
#: Lists with an address index and with a name index.
ADDRESSED = ("functions", "global_variables", "labels", "local_variables", "sections", "source_files")
NAMED = ("data_types", "functions", "global_variables", "labels", "modules", "sections", "source_files", "symbol_sources")
#: Children that go with their parent: (child list, its column, parent list).
CASCADES = (("functions", "source_file", "source_files"), ("global_variables", "source_file", "source_files"), ("parameter_variables", "function", "functions"), ("local_variables", "function", "functions"))


def in_group(source: Column, module: Column, rows: DataFrame) -> Column:
    """Group membership: both columns equal, null being equal to null."""
    return rows["source_handle"].eqNullSafe(source) & rows["module_handle"].eqNullSafe(module)


@dataclass(frozen=True)
class SymbolDb:
    """The lists that are there, by name."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, kind: str) -> DataFrame:
        return self.tables[kind]

    def with_table(self, kind: str, rows: DataFrame) -> "SymbolDb":
        return SymbolDb({**self.tables, kind: rows})

    def counts(self) -> DataFrame:
        """(kind, n) of each list."""
        out = None
        for kind, rows in self.tables.items():
            part = rows.groupBy().agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
            out = part if out is None else out.unionByName(part)
        return out

    def create(self, kind: str, rows: DataFrame, base: Column | None = None) -> "SymbolDb":
        """Appends rows; base is added to their addresses, a null address stays null."""
        placed = rows if base is None else rows.withColumn("address", F.col("address") + base)
        return self.with_table(kind, self.tables[kind].unionByName(placed, allowMissingColumns=True) if kind in self.tables else placed)

    def move(self, kind: str, moves: DataFrame) -> "SymbolDb":
        """moves (handle, new_address): a null address takes the symbol out of the address index."""
        rows = self.tables[kind].join(moves.withColumn("moved_", F.lit(True)), "handle", "left")
        moved = rows.withColumn("address", F.when(F.col("moved_"), F.col("new_address")).otherwise(F.col("address")))
        return self.with_table(kind, moved.drop("moved_", "new_address"))

    def rename(self, kind: str, names: DataFrame) -> "SymbolDb":
        """names (handle, new_name)."""
        rows = self.tables[kind].join(names, "handle", "left").withColumn("name", F.coalesce("new_name", "name"))
        return self.with_table(kind, rows.drop("new_name"))

    def set_type(self, kind: str, handles: DataFrame) -> "SymbolDb":
        """A new type for the handles: their generation goes up, so older references fail."""
        rows = self.tables[kind].join(handles.select("handle").distinct().withColumn("typed_", F.lit(1)), "handle", "left")
        return self.with_table(kind, rows.withColumn("generation", F.col("generation") + F.coalesce("typed_", F.lit(0))).drop("typed_"))

    def destroy(self, kind: str, doomed: DataFrame) -> "SymbolDb":
        """Destroys the handles of doomed and, transitively, their children."""
        out, gone = dict(self.tables), {kind: doomed.select("handle").distinct()}
        for child, column, parent in CASCADES:
            if parent in gone and child in out:
                lost = out[child].join(gone[parent].withColumnRenamed("handle", column), column, "left_semi").select("handle")
                gone[child] = gone[child].unionByName(lost).distinct() if child in gone else lost
        for name, handles in gone.items():
            out[name] = out[name].join(handles, "handle", "left_anti")
        return SymbolDb(out)

    def destroy_from(self, column: str, handle: int, cascade: bool = True) -> "SymbolDb":
        """Destroys every symbol of a source or a module."""
        out = self
        for kind in self.tables:
            if column in out[kind].columns:
                doomed = out[kind].filter(F.col(column) == handle)
                out = out.destroy(kind, doomed) if cascade else out.with_table(kind, out[kind].join(doomed.select("handle"), "handle", "left_anti"))
        return out

    def merge(self, other: "SymbolDb") -> "SymbolDb":
        """All rows of both; symbol sources of one name become one, the smaller handle's."""
        sources = self["symbol_sources"].select("handle", "name").unionByName(other["symbol_sources"].select("handle", "name"))
        keep = sources.groupBy("name").agg(F.min("handle").alias("handle"))
        renumber = sources.join(keep.withColumnRenamed("handle", "kept"), "name").select(F.col("handle").alias("source_handle"), "kept").distinct()
        out = {"symbol_sources": keep}
        for kind in (set(self.tables) | set(other.tables)) - {"symbol_sources"}:
            both = [db[kind] for db in (self, other) if kind in db.tables]
            rows = both[0] if len(both) == 1 else both[0].unionByName(both[1], allowMissingColumns=True)
            if "source_handle" in rows.columns:
                rows = rows.join(renumber, "source_handle", "left").withColumn("source_handle", F.col("kept")).drop("kept")
            out[kind] = rows
        return SymbolDb(out)

    def get_or_create_sources(self, names: DataFrame, first: int) -> "SymbolDb":
        """Sources of the given names; those that aren't there get handles from first on, by name."""
        from pyspark.sql import Window

        new = names.select("name").distinct().join(self["symbol_sources"], "name", "left_anti")
        numbered = new.withColumn("handle", (F.row_number().over(Window.orderBy("name")) + (first - 1)).cast("long"))
        return self.with_table("symbol_sources", self["symbol_sources"].unionByName(numbered, allowMissingColumns=True))


def live_nodes(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (handle, node_id, generation) whose symbol is there in the same generation."""
    return references.join(symbols.select("handle", "generation"), ["handle", "generation"], "left_semi")


def derived_owner(owners: DataFrame, members: str) -> DataFrame:
    """(member, owner) from each owner's list of members; of several owners the last one holds it."""
    listed = owners.filter(F.col(members).isNotNull()).select("handle", F.explode(members).alias("member"))
    return listed.groupBy("member").agg(F.max("handle").alias("owner"))
