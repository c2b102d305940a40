"""Language counts and document fingerprints against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from debuglens.llm import ctph, langid


def trigrams(text):
    """Trigrams around each letter of the lower-cased text; what is no letter is a space."""
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return [t[i - 1 : i + 2] for i in range(1, len(t) - 1) if t[i] != " "]


def test_languages_against_sets_of_trigrams(spark):
    r = random.Random(11)
    parts = {"en": ["th", "ing", "er"], "de": ["sch", "ung", "er"], "fr": ["eau", "ing", "é"], "xx": ["th", "é", "ung"]}
    rows = [(i, " ".join("".join(r.choices(parts[lang], k=3)) for _ in range(r.randint(3, 30))), lang) for i in range(200) for lang in [r.choice(list(parts))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        counts[lang].update(trigrams(text))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    known = {lang: {g for g, n in c.items() if n >= langid.LEAST and share[lang][g] >= langid.SHARE * max(s.get(g, 0) for s in share.values())} for lang, c in counts.items()}
    from pyspark.sql import functions as F

    model = langid.fit(df, F.lit(True))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(df, model, F.lit(False)).collect()}
    for d, text, _ in rows:
        n = {lang: sum(g in known[lang] for g in trigrams(text)) for lang in model.languages}
        best = max(n.values())
        assert n[got[d][0]] >= best - 0.01 and abs(got[d][1] - best / max(1, sum(n.values()))) < 0.01


def slow_fingerprint(data):
    """The definition, byte by byte: a window of seven bytes, its mixed sum, and pieces that end where low bits are ones."""
    def hashes():
        out = []
        for end in range(len(data)):
            total = sum(int(ctph.NUMBERS[data[end - k]]) * pow(0x01000193, k, 1 << 32) for k in range(ctph.WINDOW) if end - k >= 0) % (1 << 32)
            total ^= total >> 15
            total = total * 0x2C1B3C6D % (1 << 32)
            out.append(total ^ total >> 12)
        return out

    rolled = hashes()
    ends = lambda low: [i + 1 for i, h in enumerate(rolled) if h % (1 << low) == (1 << low) - 1]
    low = max(1, (len(data) // 64).bit_length() - 1)
    while low > 1 and len(ends(low)) < ctph.FEWEST:
        low -= 1
    while len(ends(low)) > ctph.MOST:
        low += 1
    out = [str(low if data else 0)]
    for k in range(ctph.LEVELS):
        cuts = sorted({0, *ends(low + k), len(data)})
        out.append("".join(ctph.LETTERS[xxhash.xxh32_intdigest(data[i:j]) & 63] for i, j in zip(cuts, cuts[1:])))
    return ":".join(out)


def test_fingerprints_against_the_definition():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 6, 7, 8, 50, 333, 900, 2500, 6000):
        for data in (r.integers(97, 123, n, dtype=np.uint8).tobytes(), r.integers(0, 256, n, dtype=np.uint8).tobytes(), b"ab" * (n // 2)):
            assert ctph.fingerprint(data) == slow_fingerprint(data), n
