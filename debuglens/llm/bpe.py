"""Byte-level BPE, encoded by speculation and verification.

Greedy longest match proposes tokens for each distinct word. A sequence of tokens is the BPE
encoding of its word exactly if every token is the encoding of its own bytes and every adjacent
pair is compatible, that is, no merge would ever have crossed the border between the two. All
pairs of all proposed words are checked at once, with array operations over the merge table.
Words that fail are merged exactly, with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.llm.common import ready, text_bytes

#: The byte-level pre-tokenizer's public split pattern.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Stands between words; no byte is written so.
BORDER = "\u0100"
#: Longer words, in bytes, are merged one by one.
LONG = 64
NONE = np.iinfo(np.int64).max
#: Words of a task that stay known; above it the memory starts anew.
KNOWN = 200_000
#: Code points split into words at once, cut where no word can cross.
PIECE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = byte_letters()
        ids = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.ids = ids
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        raw = [(bytes(letter[c] for c in a), bytes(letter[c] for c in b)) for a, b in merges]
        size = max(ids.values()) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        #: Rank of the merge that makes a token, -1 for single bytes.
        self.made = np.full(size, -1, np.int64)
        self.rank, keys, ranks, made = {}, [], [], []
        for r, (a, b) in enumerate(raw):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank[x, y] = (r, z)
            keys.append(x << 32 | y)
            ranks.append(r)
            made.append(z)
            if self.made[z] < 0:
                self.left[z], self.right[z], self.made[z] = x, y, r
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.pair_id = np.array(made, np.int64)[order]
        self.byte_id = np.array([ids[bytes((c,))] for c in range(256)], np.int64)
        #: One number object for each id, which all known words share.
        self.shared = np.array(range(size), object)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.data = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        #: Longest match from the left, over bytes written as Latin-1.
        self.longest = ahocorasick.Automaton()
        for token, i in ids.items():
            self.longest.add_word(token.decode("latin-1"), i)
        self.longest.make_automaton()
        self.whole = self._whole()

    def _whole(self) -> np.ndarray:
        """Whether a token's own bytes encode to it alone."""
        whole = np.ones(len(self.made), bool)
        made = np.flatnonzero(self.made >= 0)
        ok = self.compatible(self.left[made], self.right[made], self.made[made])
        for t, good in sorted(zip(made.tolist(), ok.tolist()), key=lambda x: self.made[x[0]]):
            whole[t] = good and whole[self.left[t]] and whole[self.right[t]]
        return whole

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens whether no merge of a rank less than below crosses their border.

        The two trees are taken apart backwards in time: of the tokens at the border the one
        made later is undone, and a crossing merge counts only if it would have come first.
        Of two equal ranks the left merge comes first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if below is None else below.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            crossed = (self.pair_key[at] == key) & (self.pair_rank[at] < limit[live])
            good[live[crossed]] = False
            rx, ry = self.made[x], self.made[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            later = rx > ry
            a[live[later]], limit[live[later]] = self.right[x[later]], rx[later]
            b[live[~later]], limit[live[~later]] = self.left[y[~later]], ry[~later] + 1
        return good

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: the tokens, and each one's word."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        text = BORDER.join([w.decode("latin-1") for w in words])
        found = np.fromiter(chain.from_iterable(self.longest.iter_long(text)), np.int64).reshape(-1, 2)
        return found[:, 1], np.searchsorted(ends, found[:, 0], "right")

    def exact(self, word: bytes) -> list[int]:
        """Merging by rank, leftmost first, with a heap over a linked list."""
        token = [self.ids[bytes((c,))] for c in word]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            if (m := rank.get((token[i], token[i + 1]))) is not None:
                heap.append((m[0], i, token[i], token[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i] if token[i] is not None else n
            if j >= n or token[i] != x or token[j] != y:
                continue
            token[i], token[j] = z, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := rank.get((z, token[after[i]]))) is not None:
                    heapq.heappush(heap, (m[0], i, z, token[after[i]], m[1]))
            if (h := before[i]) >= 0 and (m := rank.get((token[h], z))) is not None:
                heapq.heappush(heap, (m[0], h, token[h], z, m[1]))
        return [t for t in token if t is not None]

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once: each round merges every word's pair of least rank.

        All places of that pair merge in one round, from the left. Words of over LONG bytes go
        to the heap, whose steps do not grow with the number of rounds.
        """
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.exact(w)
        token = self.byte_id[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        owner = np.repeat(np.array(short, np.int64), np.fromiter((len(words[k]) for k in short), np.int64, len(short)))
        done_token, done_owner = [], []
        while len(token):
            key = token[:-1] << 32 | token[1:]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where((self.pair_key[at] == key) & (owner[1:] == owner[:-1]), self.pair_rank[at], NONE)
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(owner)])
            least = np.repeat(np.minimum.reduceat(rank, first), count)
            over = least == NONE
            done_token.append(token[over])
            done_owner.append(owner[over])
            hit = (rank == least) & ~over
            # of places that overlap, as in a run of one token, every other one from the left
            run = np.flatnonzero(hit)
            new = np.r_[True, np.diff(run) > 1] if len(run) else np.zeros(0, bool)
            start = run[np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))] if len(run) else run
            run = run[(run - start) % 2 == 0]
            token[run] = self.pair_id[at[run]]
            keep = ~over
            keep[run + 1] = False
            token, owner = token[keep], owner[keep]
        if done_token:
            token, owner = np.concatenate(done_token), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            token, owner = self.shared[token[order]].tolist(), owner[order]
            edge = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
            for k in short:
                out[k] = token[edge[k] : edge[k + 1]]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The encoding of each word: proposals of all, checked together, mended where they fail."""
        flat, owner = self.propose(words)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.whole[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        edge = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        listed = self.shared[flat].tolist()
        out = [listed[i:j] for i, j in zip(edge, edge[1:])]
        failing = np.flatnonzero(bad).tolist()
        for k, tokens in zip(failing, self.merged([words[k] for k in failing])):
            out[k] = tokens
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Codec:
    """Encodes and decodes texts with a vocabulary and a memory of words."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.split = regex.compile(WORDS).findall
        self.known: dict[str, list[int]] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None

    def _words(self, text: str):
        """Lists of words; special tokens stand alone. A long text comes in pieces that end between a non-space and a space."""
        for k, part in enumerate(self.special.split(text) if self.special else (text,)):
            if k % 2:
                yield None, part
                continue
            at = 0
            while at < len(part):
                end = at + PIECE
                if end < len(part):
                    while end < len(part) and not (part[end] == " " and not part[end - 1].isspace()):
                        end += 1
                yield self.split(part[at:end]), None
                at = end

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        if new := list(words.difference(self.known)):
            self.known.update(zip(new, self.vocabulary.encode_words([w.encode() for w in new])))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts):
        """Yield the ids of each text; the new words of texts of about PIECE code points are encoded together."""
        held: list[list] = []
        size = 0
        for text in texts:
            parts: list = []
            held.append(parts)
            for words, special in self._words(text):
                parts.append((words, special))
                size += sum(map(len, words)) if words else 1
                if size > PIECE:
                    self._give(held)
                    yield from held[:-1]
                    held, size = held[-1:], 0
        self._give(held)
        yield from held

    def _give(self, held: list[list]) -> None:
        """Turn the parts of each held text into one list of ids, in place."""
        words: set[str] = set()
        for parts in held:
            for part in parts:
                if type(part) is tuple and part[0]:
                    words.update(part[0])
        self._learn(words)
        known, special = self.known, self.vocabulary.special
        for parts in held:
            ids: list[int] = []
            for part in parts:
                if type(part) is not tuple:
                    ids.append(part)
                elif part[0] is None:
                    ids.append(special[part[1]])
                else:
                    ids.extend(chain.from_iterable(map(known.__getitem__, part[0])))
            parts[:] = ids

    def decode(self, ids) -> str:
        return b"".join(map(self.vocabulary.data.__getitem__, ids)).decode("utf-8", "replace")


def _encoded(path: str):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            ids = list(codec.encode_all(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row's whole text; a null or empty text has no ids."""
    ready(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    ready(ids.sparkSession)
    return ids.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def _digests(path: str, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        codec = Codec(path)
        decimal = {i: b"%d" % i for i in codec.vocabulary.data}
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), codec.encode_all(t.as_py() for t in batch.column(1))):
                joined = hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest()
                rows.append((doc_id, len(ids), joined, hashlib.sha256(codec.decode(ids).encode()).hexdigest(), *[ids] * with_ids))
                size += len(ids) * with_ids
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): each whole text encoded and decoded again in one pass.

    Null and empty texts have 0 tokens and the digests of the empty string. Rows that repeat a
    doc_id each have their row; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_digests(path, with_ids), columns)
