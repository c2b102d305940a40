"""More languages than a mask word has bits."""

import random

import numpy as np
from pyspark.sql import functions as F

from debuglens.llm import langid

N = 130


def test_filter_of_many_languages():
    texts = ["".join(chr(0x4E00 + 9 * k + j) for j in (0, 1, 2, 3, 4, 5)) for k in range(N)]
    f = langid.Filter([f"l{k}" for k in range(N)], [langid.grams([t])[0] for t in texts])
    assert f.slots.shape[0] == 3
    assert f.predict(texts)[0] == f.languages
    assert (np.array(f.predict(texts)[1]) > 0.9).all()


def test_every_language_is_learnt(spark):
    r = random.Random(2)
    rows = []
    for k in range(N):
        letters = [chr(0x4E00 + 12 * k + j) for j in range(12)]
        # the languages with the fewest rows come last
        for i in range(8 if k < 64 else 4):
            rows.append((len(rows), " ".join("".join(r.choices(letters[:3], k=4)) for _ in range(60)), f"l{k:03d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.col("doc_id") % 4 == 3
    got = {x["doc_id"]: x["lang_pred"] for x in langid.predict(df, langid.fit(df, ~held), held).collect()}
    assert all(got[d] == lang for d, _, lang in rows if d % 4 == 3)
