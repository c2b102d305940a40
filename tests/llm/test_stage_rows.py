"""The pipeline's stages on null and repeated ids, empty tables, very long texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("digest", "kept", "finishes", "bucket_", "bit_", "maybe_", "map_", "row_id_", "row_digest_", "one_id_", "virtual_finish_", "component", "key")
A = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
B = "one two three four five six seven eight nine ten"


def documents(spark, rows):
    df = spark.createDataFrame([(d, t, "en", s, None) for d, t, s in rows], SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_exact_stage_by_rows(spark):
    rows = [(5, A, "s"), (5, B, "s"), (7, B, "s"), (7, A + " ", "s"), (None, "lone", "s"), (None, "other", "s"), (None, "l one", "s"), (3, None, "s"), (4, "", "s"), (9, "x y", "s"), (9, "xy ", "s"), (11, "same", "s"), (11, "same", "s")]
    df = documents(spark, rows)
    got = p.exact_stage(spark, df, "")
    assert got.columns == df.columns
    texts = left(got)
    assert len(texts) == 7
    assert {(7, A + " "), (5, B), (None, "other"), (None, "l one"), (3, None), (11, "same")} <= set(texts) and (9, "x y") in texts or (9, "xy ") in texts


def test_near_stage_by_rows(spark):
    near = A + " " + " ".join(f"w{k}" for k in range(60))
    rows = [(5, near + " end", "s"), (5, B, "s"), (7, near, "s"), (None, B + " ", "s"), (None, "a text of its own that is like no other one", "s"), (None, None, "s"), (6, " ", "s"), (8, B, "s"), (8, B, "s"), (20, "L " * 200_000, "s")]
    df = documents(spark, rows)
    got = p.near_stage(spark, df, "")
    assert got.columns == df.columns
    assert left(got) == sorted([(5, near + " end"), (5, B), (None, "a text of its own that is like no other one"), (6, " "), (20, "L " * 200_000)], key=str)


def test_mixing_stage_by_rows(spark):
    rows = [(None, A, "s"), (None, B, "s"), (5, A, "s"), (5, B + " eleven", "s"), (6, A, None), (6, A, None), (7, None, "t"), (8, "", "t"), (9, "word " * 400, "t")]
    df = documents(spark, rows)
    got = p.mixing_stage(spark, df, "")
    assert got.columns == df.columns
    from debuglens.llm import mixing

    taken = {}
    for r in mixing.shares(df).collect():
        if r["size"]:
            taken[r["doc_id"], r["size"]] = max(taken.get((r["doc_id"], r["size"]), 0), int(r["taken"] / r["size"] + 0.5))
    count = {}
    for d, t in left(got):
        count[d, t] = count.get((d, t), 0) + 1
    assert all(n <= 2 for (d, t), n in count.items() if (d, t) != (6, A)) and count.get((6, A), 0) <= 4
    assert {d for d, _ in count} <= {None, 5, 6, 9}
    for (d, t), n in count.items():
        if (d, t) != (6, A) and d is not None:
            assert n == taken[d, len(t.split())]


@pytest.mark.parametrize("stage", [f for _, f in p.STAGES[1:4]])
def test_stages_of_empty_tables(spark, stage):
    df = documents(spark, [(1, A, "s")]).limit(0)
    got = stage(spark, df, "")
    assert got.columns == df.columns and got.count() == 0


def test_the_mix_is_in_order_of_virtual_finish(spark):
    from debuglens.llm import mixing

    df = documents(spark, [(k, "w " * (1 + k * 7 % 13), "ab"[k % 2]) for k in range(200)])
    finish = {r["doc_id"]: r["virtual_finish"] for r in mixing.shares(df).collect()}
    order = [r["doc_id"] for r in mixing.mixed(df).collect()]
    first = [d for k, d in enumerate(order) if d not in order[:k]]
    assert [finish[d] for d in first] == sorted(finish[d] for d in first) and len(first) > 100
