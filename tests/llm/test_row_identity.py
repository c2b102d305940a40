"""Rows without a doc_id, and rows that share one, keep values of their own."""

import hashlib
import re

import pytest

from debuglens.llm import exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("modulus", [exact_dedup.MODULUS, 5])
def test_exact_groups_of_repeated_and_missing_ids(spark, modulus):
    rows = [(3, "aaa bbb"), (5, "aaa bbb"), (5, "zzz"), (7, "zzz"), (None, "q q"), (9, "qq"), (None, "qq"), (None, None), (None, "w"), (11, "e"), (11, "e"), (12, "e"), (13, "f f"), (13, "ff"), (13, "f  f")]
    got = exact_dedup.exact_groups(documents(spark, rows), modulus=modulus, chunk=4).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d))
    want = []
    for d, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))
        want.append((d, best[2], len(groups[key]), (-len(t or ""), d) == (best[0], best[2]), hashlib.sha256(key.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_license_rows_keep_their_own_values(spark):
    from debuglens.llm import licenses

    rows = [(5, "released under the MIT License"), (5, "nothing of note"), (None, "All rights reserved"), (None, None), (None, "apache license"), (5, "nothing of note")]
    got = licenses.scan(documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["base_labels"], r["labels"], round(r["score"], 3)) for r in got) == [("5", "", "", 0.0), ("5", "", "", 0.0), ("5", "mit", "mit", 1.0), ("None", "", "", 0.0), ("None", "", "reserved", 1.0), ("None", "apache", "apache", 0.0)]


def test_only_ascii_letters_are_lower_cased(spark):
    from debuglens.llm import licenses

    rows = [(1, "this worK is licensed under a creative commons attribution license"), (2, "MİT license ÉA MIT LICENSE"), (3, "MIT\x00LICENSE")]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert got[1]["score"] == pytest.approx(0.9) and got[1]["labels"] == "cc"
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["first_word"]) == (5, 1, 3)
    assert (got[3]["n_words"], got[3]["base_labels"]) == (2, "mit")


def test_near_groups_of_repeated_and_missing_ids(spark):
    from debuglens.llm import simhash

    big = (1 << 62) + 1
    rows = [(None, "a b c d"), (big, "a b c d"), (big + 2, "a  b c d"), (None, "q r s t"), (None, "Q r s t"), (4, "x y z"), (4, "u v w"), (9, "u v w"), (None, None)]
    got = simhash.near_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    for (d, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"],)))):
        prints.setdefault(r["fingerprint"], []).append(r)
    parts = sorted(sorted(str((r["doc_id"], r["component_id"])) for r in rs) for rs in prints.values())
    assert parts == sorted([sorted(map(str, [(None, big), (big, big), (big + 2, big)])), ["(None, None)", "(None, None)"], ["(4, 4)"], ["(4, 4)", "(9, 4)"], ["(None, None)"]])
