"""Line deduplication with a log-template tree.

A line falls through a tree of fixed depth: first by its number of tokens, then by its ``DEPTH``
leading tokens, where tokens with a digit count as the wildcard. In a leaf, variable fields are
generalised by two rules that look at the leaf's set of lines and at nothing else, so neither the
order of the lines nor the size of the leaf has any influence:

* a token that fewer than ``DOCUMENTS`` (document, line) pairs of the leaf have at its place is
  rare, and its place a wildcard;
* any one other place may be a wildcard as well.

A line's templates are the line itself, its form with rare places wild, and that form with each
other place wild in turn, as long as at most ``1 - ALIKE`` of the places are wild. A template that
recurs in ``DOCUMENTS`` documents or more is dropped from all but the first document that has it.

Lines are counted before anything else: leaves with lines of fewer than ``DOCUMENTS`` documents
can't recur, and no text of theirs is moved. In the other leaves equal lines (numbers aside) are
merged first, by a partial aggregation, so a line that a third of all documents have is one row.
Rows are then dealt by (leaf, place, token) and by template, never by leaf, and every count is a
partial aggregation: a leaf is spread over all tasks, whatever its size is.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.llm.common import attach, cut, ready, text_bytes

DEPTH = 3
ALIKE = 0.8
DOCUMENTS = 5
#: Rows that a task gives at once.
BATCH = 50_000
WILD = b"<*>"
DIGITS = frozenset(b"0123456789")


def _masked(found: list[bytes]) -> list[bytes]:
    return [WILD if not DIGITS.isdisjoint(t) else t for t in found]


def same(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, 13) - (1 << 63)


def _leaves(text: bytes):
    """(number, leaf, tokens) of each line that has tokens."""
    for k, line in enumerate(text.split(b"\n")):
        if found := line.split():
            yield k, xxhash.xxh64_intdigest(b"%d " % len(found) + b" ".join(_masked(found[:DEPTH])), 11) - (1 << 63), found


def _keys(batches):
    for batch in batches:
        docs, leaves = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = {a for _, a, _ in _leaves(text.as_buffer().to_pybytes())}
            docs.extend([doc_id] * len(own))
            leaves.extend(own)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(leaves, pa.int64())], names=["doc_id", "leaf"])


def _texts(batches):
    """The distinct masked lines of each document in its recurring leaves."""
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc_id, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            wanted = set(wanted)
            for a, masked in {(a, b" ".join(_masked(found))) for _, a, found in _leaves(text.as_buffer().to_pybytes()) if a in wanted}:
                rows.append((doc_id, a, same(masked), masked))
                size += len(masked)
            if size > 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "leaf", "line", "masked"])


def most_wild(places: int, alike: float = ALIKE) -> int:
    """How many of a line's places may be wild."""
    return int(places * (1 - alike) + 1e-9)


def _given(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def _field(leaf: int, place: int, token: bytes) -> int:
    return xxhash.xxh64_intdigest(b"%d %d " % (leaf, place) + token, 17)


def _signed(value: int) -> int:
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def _fields(batch_rows: int):
    """(line, place, field, n) for each token behind the leading ones; field names the leaf, the place and the token."""
    names = ["line", "place", "field", "n"]

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for leaf, line, masked, n in zip(*(c.to_pylist() for c in batch.columns)):
                for place, token in enumerate(masked.split(b" ")[DEPTH:], DEPTH):
                    if token != WILD:
                        rows.append((line, place, _signed(_field(leaf, place, token)), n))
                if len(rows) >= batch_rows:
                    yield _given(rows, names)
                    rows = []
        if rows:
            yield _given(rows, names)

    return run


def templates(leaf: int, masked: bytes, rare=(), whole: bool = False) -> list[int]:
    """A line's templates, each as the sum of its fields' hashes; whole: the line is the only one of its leaf."""
    found = masked.split(b" ")
    own = [_field(leaf, k, t) for k, t in enumerate(found)]
    total = leaf + sum(own)
    out = [_signed(total)]
    free = most_wild(len(found)) - len(rare)
    if whole or free < 0:
        return out
    wild = {k: _field(leaf, k, WILD) - own[k] for k in range(DEPTH, len(found)) if found[k] != WILD}
    if rare:
        total += sum(wild.pop(k) for k in rare)
        out.append(_signed(total))
    if free:
        out.extend(_signed(total + change) for change in wild.values())
    return out


def _generalised(batch_rows: int):
    """Rows (leaf, line, masked, only, rare) into (line, template)."""
    names = ["line", "template"]

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for leaf, line, masked, only, rare in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend((line, t) for t in templates(leaf, masked, rare or (), only))
                if len(rows) >= batch_rows:
                    yield _given(rows, names)
                    rows = []
        if rows:
            yield _given(rows, names)

    return run


def line_templates(docs: DataFrame, documents: int = DOCUMENTS, batch_rows: int = BATCH) -> DataFrame:
    """(doc_id, line, template, first) for each document's lines that have a recurring template.

    ``first`` is the smallest doc_id that has one of the line's recurring templates, and
    ``template`` the one that it has.
    """
    ready(docs.sparkSession)
    texts = docs.select("doc_id", text_bytes())
    texts = texts.filter("doc_id IS NOT NULL")
    keys = cut(texts.mapInArrow(_keys, "doc_id long, leaf long"))
    recurring = keys.groupBy("leaf").count().filter(F.col("count") >= documents).select("leaf")
    wanted = attach(keys, recurring, "leaf").groupBy("doc_id").agg(F.collect_set("leaf").alias("wanted"))
    texted = attach(texts, wanted, "doc_id", "inner", F.size("wanted")).select("doc_id", "text", "wanted")
    lines = cut(texted.mapInArrow(_texts, "doc_id long, leaf long, line long, masked binary"))
    distinct = cut(lines.groupBy("leaf", "line").agg(F.min("masked").alias("masked"), F.count("*").alias("n"), F.min("doc_id").alias("least")))
    crowded = distinct.groupBy("leaf").count().filter("count > 1").select("leaf", F.lit(False).alias("only"))
    shared = cut(attach(distinct, crowded, "leaf", "left").withColumn("only", F.coalesce("only", F.lit(True))))
    fields = shared.filter("NOT only").select("leaf", "line", "masked", "n").mapInArrow(_fields(batch_rows), "line long, place long, field long, n long")
    rare = fields.groupBy("field").agg(F.sum("n").alias("n")).filter(F.col("n") < documents).select("field")
    wild = attach(fields.select("line", "place", "field"), rare, "field").groupBy("line").agg(F.collect_set("place").alias("rare"))
    marked = shared.join(wild, "line", "left").select("leaf", "line", "masked", "only", "rare")
    made = cut(marked.mapInArrow(_generalised(batch_rows), "line long, template long"))
    counted = made.join(distinct.select("line", "n", "least"), "line")
    sums = cut(counted.groupBy("template").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.min("least").alias("first")).filter(F.col("total") >= documents))
    # a template of several lines, each of few documents: its documents are told apart
    doubtful = sums.filter(F.col("most") < documents).select("template")
    few = attach(counted.filter(F.col("n") < documents).select("line", "template"), doubtful, "template")
    # only lines of few documents are dealt by line
    told = attach(lines.select("doc_id", "line"), few.select("line").distinct(), "line")
    apart = few.join(told, "line").select("template", "doc_id").distinct().groupBy("template").count().filter(F.col("count") >= documents).select("template")
    often = sums.filter(F.col("most") >= documents).select("template", "first").unionByName(sums.join(apart, "template").select("template", "first"))
    firsts = attach(made, often, "template").groupBy("line").agg(F.min(F.struct("first", "template")).alias("f")).select("line", "f.first", "f.template")
    return attach(lines.select("doc_id", "line"), firsts, "line", "inner", F.lit(2)).select("doc_id", "line", "template", "first")


def _dropped(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])
    for batch in batches:
        rows, size = [], 0
        for doc_id, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data, out = text.as_buffer().to_pybytes(), set(out or ())
            lines = data.split(b"\n")
            gone = {k for k, _, found in _leaves(data) if same(b" ".join(_masked(found))) in out} if out else ()
            kept = b"\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else data
            rows.append((doc_id, len(lines), len(gone), kept.decode("utf-8", "replace")))
            size += len(kept)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def without_templates(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text without the lines of recurring templates.

    A null or empty text has one empty line. Lines without tokens are never dropped, and the
    first document with a template keeps its lines. Rows that repeat a doc_id are each counted
    where templates recur and lose the same lines, those of the first doc_id none. A row without
    a doc_id neither counts nor loses anything. Of equally early documents there is only one, so
    there are no ties. An empty table gives an empty result; other columns are not read.
    """
    found = line_templates(docs, documents).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("line").alias("out"))
    joined = attach(docs.select("doc_id", text_bytes()), found, "doc_id", "left", F.size("out"))
    return joined.select("doc_id", "text", "out").mapInArrow(_dropped, "doc_id long, n_lines long, n_dropped long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of without_templates()."""
    return without_templates(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

