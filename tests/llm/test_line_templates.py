"""Line templates against brute force on random leaves."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from debuglens.llm import linededup

DOCUMENTS = 5


def expected(rows, documents=DOCUMENTS):
    """{doc_id: lines that stay} from the definition, on sets of strings."""
    leaves = defaultdict(lambda: defaultdict(list))  # leaf -> line -> documents, repeats included
    parsed = {}
    for k, (d, text) in enumerate(rows):
        found = []
        for line in (text or "").split("\n"):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))
            found.append((line, tokens))
        parsed[k] = found
        if d is not None:
            for tokens in {t for _, t in found if t}:
                leaves[len(tokens), tokens[:3]][tokens].append(d)
    pairs, holders = defaultdict(int), defaultdict(set)
    for leaf, lines in leaves.items():
        for tokens, docs in lines.items():
            for place, token in enumerate(tokens):
                pairs[leaf, place, token] += len(docs)

    def templates(tokens):
        leaf, n = (len(tokens), tokens[:3]), len(tokens)
        out = {tokens}
        if len(leaves[leaf]) > 1:
            rare = {p for p in range(3, n) if tokens[p] != "<*>" and pairs[leaf, p, tokens[p]] < documents}
            wild = tuple("<*>" if p in rare else t for p, t in enumerate(tokens))
            if 5 * len(rare) <= n:
                out.add(wild)
            if 5 * (len(rare) + 1) <= n:
                out |= {wild[:p] + ("<*>",) + wild[p + 1 :] for p in range(3, n) if wild[p] != "<*>"}
        return out

    counts = defaultdict(list)
    for lines in leaves.values():
        for tokens, docs in lines.items():
            for t in templates(tokens):
                holders[t] |= set(docs)
                counts[t].append(len(docs))
    often = {t: min(ds) for t, ds in holders.items() if len(ds) >= documents or max(counts[t]) >= documents}
    out = []
    for k, (d, _) in enumerate(rows):
        keep = [line for line, tokens in parsed[k] if not tokens or d is None or all(often.get(t, d) >= d for t in templates(tokens))]
        out.append((d, len(parsed[k]), len(parsed[k]) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def random_rows(seed):
    r = random.Random(seed)
    shapes = [["open", "the", "file"], ["close", "a", "door"], ["7", "x", "y"]]
    names = [f"n{c}" for c in "abcdefghijklmnopqrst"]
    rows = [(None, "open the file na na na na na na na"), (None, None), (900, ""), (901, None), (902, "   \n\t\n"), (903, "one"), (904, "one two three")]
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            head = r.choice(shapes)
            tail = ["is"] * r.choice([2, 4, 7, 9])
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                tail[r.randrange(len(tail))] = r.choice([*names[:3], *names, f"v{r.randrange(99)}", f"u{chr(97 + d % 26)}{chr(97 + d // 26)}x"])
            lines.append(r.choice([" ", "  ", "\t"]).join(head + tail))
        rows.append((d * 2, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_templates_against_brute_force(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("leaf", "line", "template", "first", "n", "count", "field", "only", "rare", "out", "maybe_"):
        df = df.withColumn(name, F.lit("x"))
    got = [(x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in linededup.without_templates(df, DOCUMENTS).collect()]
    want = expected(rows)
    assert sorted(got, key=str) == want
    assert sum(x[2] for x in want) > 20
    if seed == 0:
        again = linededup.without_templates(df.repartition(7, F.rand(3)), DOCUMENTS).collect()
        assert sorted(((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in again), key=str) == want


def test_a_leaf_of_many_unlike_lines_is_no_quadratic_work(spark):
    """One leaf of 60,000 lines that have nothing but their leading tokens in common."""
    words = F.concat_ws(" ", F.lit("a b c"), *[F.translate(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256), "0123456789", "ghijklmnop") for k in range(4)])
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(words, F.lit("\nthe same line here and there")).alias("text"))
    got = linededup.without_templates(df).agg(F.sum("n_dropped"), F.max("n_dropped")).first()
    assert tuple(got) == (59_999, 1)


def test_repeated_ids_lose_the_same_lines(spark):
    rows = [(1, "the same line here and there"), (1, "the same line here and there\nmore")] + [(k, "the same line here and there") for k in range(2, 7)]
    got = sorted((x["doc_id"], x["n_dropped"], x["text"]) for x in linededup.without_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, "the same line here and there"), (1, 0, "the same line here and there\nmore")] + [(k, 1, "") for k in range(2, 7)]
