"""The training-data operators against brute force, on small tables with nulls, ties, repeats and hostile texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from debuglens.llm import bpe, ctph, exact_dedup, langid, licenses, linededup, mixing, quality, simhash, substrings
from debuglens.llm.bktree import Forest, merge
from debuglens.llm.components import components
from debuglens.llm.queries import bpe_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with those that operators make.
CLASHING = ("size", "target", "taken", "best", "part", "code", "template", "count", "own_0_", "core")


def documents(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None) for d, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "the", "of", "licence", "MIT", "license", "Apache", "été", "日本", "x1", "42"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 90))) for _ in range(12)]
    out = [(0, None, "en", "a"), (1, "", "en", None), (2, " \t\n", None, "a"), (3, "A", "de", "b"), (4, "a", "de", "b"), (5, "!!! 123", "fr", "c")]
    for i in range(6, 60):
        t = r.choice(base)
        if r.random() < 0.5:
            t = t.replace(" ", r.choice([" ", "  ", "\n"]), r.randint(0, 3))
        if r.random() < 0.3:
            t += "\nReleased under the MIT License."
        out.append((i * 3, t, r.choice(["en", "de", "fr", None]), r.choice(["a", "a", "a", "b", "c", None])))
    out.append((500, "word " * 3000, "en", "a"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = documents(spark, rows)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dict(df, key="doc_id"):
    got = df.collect()
    out = {r[key]: r.asDict() for r in got}
    assert len(out) == len(got)
    return out


# Exact dedup


def expected_groups(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    return {d: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g}


@pytest.mark.parametrize("modulus", [exact_dedup.MODULUS, 5])
def test_exact_groups(docs, rows, modulus):
    """With a modulus of 5 fingerprints collide all the time, and comparison must tell texts apart."""
    got = as_dict(exact_dedup.exact_groups(docs, modulus=modulus, chunk=16))
    want = expected_groups(rows)
    assert {d: (r["keep_id"], r["group_size"], r["text_sha256"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["keep_id"]) for d, r in got.items())


def test_fingerprints_compose():
    r = random.Random(1)
    for _ in range(50):
        a, b = r.randbytes(r.randint(0, 50)), r.randbytes(r.randint(0, 50))
        assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == exact_dedup.fingerprint(a + b)
        assert exact_dedup.fingerprint(a, chunk=7) == exact_dedup.fingerprint(a)


# BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(bpe_path()), bpe.Codec(bpe_path())
    r = random.Random(2)
    pieces = ["a", "the", " ", "  ", "\n", "'s", "'LL", "é", "日本", "<|endoftext|>", "<|end", "12", "²", "\x1c", "\x85", "_", "!!", "aaaa", "\U0001f600", "x" * 90, "\r\n", "\t", "İ", "ing"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(codec.encode_all(texts)) == want
    assert [codec.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_long_texts_come_in_pieces(monkeypatch):
    codec = bpe.Codec(bpe_path())
    text = "some words, and  more\n\n of them " * 40
    whole = codec.encode(text)
    monkeypatch.setattr(bpe, "PIECE", 17)
    assert bpe.Codec(bpe_path()).encode(text) == whole
    assert list(bpe.Codec(bpe_path()).encode_all([text, "", text])) == [whole, [], whole]


def test_bpe_exact_merging_of_failing_words():
    v = bpe.vocabulary(bpe_path())
    words = [b"a" * k for k in range(1, 90)] + [b"thetheing", b"   ", bytes(range(128, 160))]
    assert v.merged(words) == [v.exact(w) for w in words]
    assert v.encode_words(words) == [v.exact(w) for w in words]


def test_bpe_round_trip(docs, rows):
    ids = bpe.encoded(docs, bpe_path())
    back = as_dict(bpe.decoded(ids, bpe_path()))
    assert {d: r["text"] for d, r in back.items()} == {d: t or "" for d, t, *_ in rows}
    got = as_dict(bpe.digests(docs, bpe_path()))
    assert all(got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for d, t, *_ in rows)


# Document fingerprints


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(0)
    for _ in range(800):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 18))) for _ in "ab")
        assert ctph.edit_distance(a, b) == slow(a, b)


def test_fingerprints_follow_the_order_of_documents(docs, rows):
    got = as_dict(ctph.fingerprints(docs))
    order = sorted(((d, t or "") for d, t, *_ in rows), reverse=True)
    for k, (d, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = ctph.edited(text, following)
        assert got[d]["n_chars"] == len(text)
        assert got[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[d]["fingerprint"] == ctph.fingerprint(text.encode())
        assert got[d]["edited_fingerprint"] == ctph.fingerprint(changed.encode())
        assert got[d]["near_edited"] == ctph.likeness(got[d]["fingerprint"], got[d]["edited_fingerprint"])
        assert got[d]["near_next"] == ctph.likeness(ctph.fingerprint(text.encode()), ctph.fingerprint(following.encode()))


def test_likeness_tells_half_a_text_from_another():
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(["wort", "haus", "blau", "gern", "zeit", "stadt", "ort"], 400)) for _ in range(10)]
    for a, b in zip(texts, texts[1:]):
        same = ctph.likeness(ctph.fingerprint(a.encode()), ctph.fingerprint(ctph.edited(a, b).encode()))
        assert same > 0.3 > ctph.likeness(ctph.fingerprint(a.encode()), ctph.fingerprint(b.encode()))


def test_long_texts_roll_over_stretches(monkeypatch):
    data = np.random.default_rng(5).integers(97, 123, 5000, dtype=np.uint8).tobytes()
    whole = ctph.fingerprint(data)
    monkeypatch.setattr(ctph, "STRETCH", 64)
    assert ctph.fingerprint(data) == whole


# Repeated substrings


def expected_removals(rows, length=substrings.LENGTH):
    data = {d: (t or "").encode() for d, t in rows}
    seen = Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def substring_rows():
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(1000, None), (1001, "a" * 399), (1002, "ab" * 400), (1003, base), (1004, base)]
    for i in range(40):
        text = ""
        for _ in range(r.randint(0, 5)):
            k = r.random()
            if k < 0.5:
                a = r.randint(0, 2500)
                text += base[a : a + r.choice([100, 380, 399, 400, 401, 450, 600, 900])]
            elif k < 0.7:
                text += r.choice(["a", "ab", "xyz "]) * r.randint(1, 300)
            else:
                text += "".join(r.choice("abcdefgh é") for _ in range(r.randint(0, 500)))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("meet", [100_000, 16])
def test_repeated_substrings(spark, monkeypatch, meet):
    """With a limit of 16 rows a key, frequent common parts are counted the other way."""
    monkeypatch.setattr(substrings, "MEET", meet)
    rows = substring_rows()
    got = as_dict(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == expected_removals(rows)


def test_anchors_of_long_texts_join_over_stretches(monkeypatch):
    data = np.random.default_rng(5).integers(97, 100, 6000, dtype=np.uint8).tobytes() + b"z" * 900
    whole = [x.tolist() for x in substrings.anchors(data)]
    monkeypatch.setattr(substrings, "STRETCH", 500)
    assert [x.tolist() for x in substrings.anchors(data)] == whole


# Mixing


def expected_mix(rows):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows}
    by = defaultdict(int)
    for d, _, _, s in rows:
        by[s] += size[d]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, full = {}, 1.5 * sum(by.values()), set()
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * by[s]]
        if not over:
            return size, by, target | share
        for s in over:
            full.add(s)
            target[s] = 2.0 * by[s]
            left -= target[s]


def test_mixing(docs, rows):
    got = as_dict(mixing.shares(docs))
    size, by, target = expected_mix(rows)
    taken = Counter()
    for d, _, _, s in rows:
        r = got[d]
        assert (r["size"], r["source_size"]) == (size[d], by[s])
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in by)
    again = as_dict(mixing.shares(docs.repartition(5)))
    assert {d: r["taken"] for d, r in again.items()} == {d: r["taken"] for d, r in got.items()}
    assert mixing.mixed(docs).columns == docs.columns


# SimHash


def test_bk_forest_finds_all_links():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 20, dtype=np.uint64)
    one = np.uint64(1)
    codes = np.unique(base[r.integers(0, 20, 1500)] ^ (one << r.integers(0, 64, 1500).astype(np.uint64)) ^ (one << r.integers(0, 64, 1500).astype(np.uint64)))
    r.shuffle(codes)
    shards = np.sort(r.integers(0, 3, len(codes)))
    near = np.triu((np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & (shards[:, None] == shards[None, :]), 1)
    found = {(i, j) for a, b in Forest(codes, shards).linked(3) for i, j in zip(a.tolist(), b.tolist())}
    assert {tuple(sorted(x)) for x in found} == set(zip(*(x.tolist() for x in np.nonzero(near))))
    label = merge(np.arange(len(codes)), *np.nonzero(near))
    assert all(label[i] == label[j] for i, j in found)


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_near_groups(spark, rows, tile):
    r = random.Random(9)
    vocabulary = ["w%d" % k for k in range(300)]
    rows = [(d, t) for d, t, *_ in rows]
    for base in range(4):
        words = [r.choice(vocabulary) for _ in range(400)]
        for k in range(12):
            copy = list(words)
            for _ in range(k % 4):
                copy[r.randrange(400)] = r.choice(vocabulary)
            rows.append((1000 + base * 100 + k, " ".join(copy)))
    got = as_dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile))

    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    code = {d: slow(t) for d, t in rows}
    parent = {d: d for d in code}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(code)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (code[a] ^ code[b]).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{code[d]:016x}", find(d)) for d in ids}


def test_masks_cover_every_pair_in_reach():
    r = random.Random(4)
    for n in (10, 10**8, 10**12, 10**15):
        masks = simhash.masks(n)
        for _ in range(300):
            bits = sum(1 << b for b in r.sample(range(64), 3))
            assert any(m & bits == 0 for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# Language, quality, licenses, lines


def test_language_of_held_out_texts(spark):
    r = random.Random(6)
    syllables = {"en": ["th", "ing", "er", "and", "wh"], "de": ["sch", "ung", "ein", "ich", "ö"], "fr": ["eau", "é", "que", "oux", "ai"]}
    rows = []
    for i in range(300):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(60)).upper() if i % 5 == 0 else " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(60)), lang, "s"))
    rows += [(900, None, "en", "s"), (901, "123 !!", "en", "s"), (902, "", None, None)]
    df = documents(spark, rows)
    held = F.col("doc_id") % 3 == 1
    got = as_dict(langid.predict(df, langid.fit(df, ~held), held))
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:300] if i % 3 == 1)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_bloom_filter_answers_for_all_languages_at_once():
    a, b = (langid.grams([t])[0] for t in ("alpha beta gamma", "delta epsilon"))
    f = langid.Filter(["x", "y"], [a, np.r_[a, b]])
    assert (f.masks(a) & 3 == 3).all() and (f.masks(b) & 2 == 2).all()
    assert 0 < f.false[0] < f.false[1] < 1e-6


def quality_rows():
    r = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(60)]
        text = " ".join([words[0]] * 40 + [words[1]] * 20) if bad and i % 2 else " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "en", "s%d" % (i % 4)))
        if i % 4:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    df, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, known)
    got = as_dict(quality.score(df, model))
    right = [got[i]["accepted"] == (i % 3 != 0) for i, *_ in rows if i % 4 == 0]
    assert sum(right) / len(right) > 0.95
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, g in got.items() if g["accepted"]}


def test_quality_without_labels_accepts_all(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    got = as_dict(quality.score(docs, None))
    assert all(g["accepted"] and g["score"] == 1 for g in got.values())
    assert quality.accepted(docs, None).count() == docs.count()


def test_licenses(docs, rows):
    got = as_dict(licenses.scan(docs))
    for d, t, *_ in rows:
        words = re.findall(licenses.WORD, (t or "").lower())
        places = [i for p, _ in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        best, names = 0.0, {n for p, n in licenses.PHRASES if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
        assert got[d]["base_labels"] == ",".join(sorted(names))
        for line in (t or "").lower().split("\n"):
            have = set(re.findall(licenses.WORD, line))
            for name, template in licenses.TEMPLATES:
                share = len(have & set(template.split())) / len(set(template.split()))
                if share >= licenses.CONTAINMENT - 1e-9:
                    names.add(name)
                    best = max(best, share)
        r = got[d]
        assert (r["n_words"], r["n_base"], r["labels"], r["score"]) == (len(words), len(places), ",".join(sorted(names)), pytest.approx(best))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))


def test_line_templates(spark):
    rows = [(i, f"{chr(97 + i)}q wrote {chr(98 + i)}w\nUser {i} logged in from host{i} port {i}\nfooter line of the site", None, None) for i in range(12)]
    rows += [(50, None, None, None), (51, "", None, None), (52, "User 1 logged in from host1 port 2\nanother", None, None)]
    got = as_dict(linededup.without_templates(documents(spark, rows), documents=5))
    assert (got[0]["n_lines"], got[0]["n_dropped"]) == (3, 0)
    for i in range(1, 12):
        assert got[i]["n_dropped"] == 2 and got[i]["text"] == f"{chr(97 + i)}q wrote {chr(98 + i)}w"
    assert got[52]["text"] == "another"
    assert got[50]["text"] == got[51]["text"] == "" and got[51]["n_dropped"] == 0


def test_line_templates_of_large_leaves(spark):
    """A leaf that is dealt out over salts gives the same templates."""
    rows = [(i, "\n".join(f"a b c {'v%sv' % chr(97 + j)} end of this recurring line now {i}" for j in range(3)), None, None) for i in range(8)]
    df = documents(spark, rows)
    drop = lambda n: {r["doc_id"]: r["template"] is not None for r in linededup.line_templates(df, 5, n).collect()}
    assert drop(4096) == drop(2)


# Every operator


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    held = F.col("doc_id") % 3 == 1
    for df in (
        langid.predict(empty, langid.fit(empty, ~held), held),
        exact_dedup.exact_groups(empty),
        bpe.digests(empty, bpe_path()),
        ctph.fingerprints(empty),
        substrings.digests(empty),
        mixing.shares(empty),
        simhash.near_groups(empty),
        quality.score(empty, quality.fit(empty, labels)),
        licenses.scan(empty),
        linededup.digests(empty),
    ):
        assert df.count() == 0


def test_nulls_everywhere_and_repeated_rows(spark):
    df = documents(spark, [(1, None, None, None), (1, None, None, None), (2, "the same text of some words", None, None), (2, "the same text of some words", None, None), (3, "the same text of some words", None, None)])
    held = F.col("doc_id") % 3 == 1
    assert langid.predict(df, langid.fit(df, ~held), held).count() == 5
    groups = exact_dedup.exact_groups(df).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in groups} == {(1, 1, 2), (2, 2, 3), (3, 2, 3)} and len(groups) == 5
    for op in (lambda d: bpe.digests(d, bpe_path()), ctph.fingerprints, mixing.shares, simhash.near_groups, licenses.scan, linededup.digests, substrings.digests, lambda d: quality.score(d, None)):
        assert op(df).count() == 5


def test_rows_without_an_id_are_kept(spark):
    df = documents(spark, [(None, "one text of a few words", "en", "a"), (None, None, None, None), (5, "another text", "en", "a")])
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    for op in (lambda d: langid.predict(d, langid.fit(d, ~held), held), exact_dedup.exact_groups, lambda d: bpe.digests(d, bpe_path()), ctph.fingerprints, substrings.digests, mixing.shares, simhash.near_groups, lambda d: quality.score(d, None), licenses.scan, linededup.digests):
        assert op(df).count() == 3


def test_attaching_with_a_sieve_loses_and_adds_nothing(spark):
    from debuglens.llm.common import attach

    docs = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("v", F.col("doc_id") * 2)
    ids = spark.range(0, 4000, 7).select(F.col("id").alias("doc_id"), (F.col("id") + 1).alias("w"))
    for how in ("inner", "left", "left_anti"):
        want = sorted(map(str, docs.join(ids, "doc_id", how).collect()))
        for small in (True, False):
            got = attach(docs, ids if how != "left_anti" else ids.select("doc_id"), "doc_id", how, small=small)
            assert sorted(map(str, got.select(*docs.join(ids, "doc_id", how).columns).collect())) == want
