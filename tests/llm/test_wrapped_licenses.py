"""License notices that are wrapped over lines, against all windows of words."""

import re
import textwrap

import pytest

from debuglens.llm import licenses

LONGEST = max(len(t.split()) for _, t in licenses.TEMPLATES)


@pytest.fixture(scope="module")
def rows():
    out = [(0, None), (1, ""), (2, "all\n\nrights"), (3, "reserved " + "word " * 40 + "\nall rights")]
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        for width in (12, 40, 72):
            notice = "\n * ".join(textwrap.wrap(template.capitalize(), width))
            out.append((100 * k + width, "some words before\n/* " + notice + "\n */\nand after it\n" * 3))
    words = licenses.TEMPLATES[4][1].split()
    for k in range(8):
        kept = [w for i, w in enumerate(words) if i >= k]
        out.append((5000 + k, "\n".join(kept)))
        out.append((6000 + k, "\n".join(words[:k] + ["x"] * (3 * k) + words[k:])))
    return out


def test_wrapped_notices(spark, rows):
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        low = (text or "").lower()
        words = re.findall(licenses.WORD, low)
        blocks = [set(words[i : i + LONGEST]) for i in range(max(1, len(words) - LONGEST + 1))] + [set(re.findall(licenses.WORD, line)) for line in low.split("\n")]
        best, names = 0.0, {n for p, n in licenses.PHRASES if f" {p} " in f" {' '.join(words)} "}
        for have in blocks:
            for name, template in licenses.TEMPLATES:
                share = len(have & set(template.split())) / len(set(template.split()))
                if share >= licenses.CONTAINMENT - 1e-9:
                    names.add(name)
                    best = max(best, share)
        assert (got[d]["labels"], got[d]["score"]) == (",".join(sorted(names)), pytest.approx(best)), d


def test_wrapped_bsd_and_mpl_keep_their_labels(spark):
    notices = {n: "\n".join(textwrap.wrap(t, 72)) for n, t in licenses.TEMPLATES if n in ("bsd", "mpl")}
    df = spark.createDataFrame(list(enumerate(notices.values())), "doc_id long, text string")
    assert [(r["labels"], r["score"]) for r in licenses.scan(df).orderBy("doc_id").collect()] == [(n, 1.0) for n in notices]
