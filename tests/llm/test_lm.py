import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkframe.llm import lm, registry
from larkframe.llm.words import word_hashes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOW) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


class Slow:
    """The automaton with dictionaries: of each state its arcs (weight, next state) and its failure weight."""

    def __init__(self, texts, mu=lm.MU, d=lm.D):
        self.c = collections.Counter()
        for w in texts:
            w = ["<s>", *w]
            for n in (1, 2, 3):
                self.c.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        self.words = {h[0] for h in self.c if len(h) == 1} - {"<s>"}
        self.n, self.v = sum(self.c[(x,)] for x in self.words), len(self.words)
        self.unknown = d * self.v / self.n if self.n else 1.0
        self.arcs = {(): {x: ((self.c[(x,)] - d) / self.n, self.longest((x,))) for x in self.words}}
        self.fail = {}
        for size in (1, 2):
            for h in [h for h in self.c if len(h) == size and h[-1] is not None]:
                self.fail[h] = mu[size - 1] / (self.c[h] + mu[size - 1])
                self.arcs[h] = {}
        for h in [h for h in self.c if len(h) > 1]:
            state, x = h[:-1], h[-1]
            m = mu[len(state) - 1]
            self.arcs[state][x] = ((self.c[h] + m * self.weight(state[1:], x)) / (self.c[state] + m), self.longest(h[-2:]))

    def longest(self, h):
        while h and not (self.c[h] and h[-1] is not None):
            h = h[1:]
        return h

    def weight(self, state, x):
        """Of the way from a state by x, failures included."""
        w = 1.0
        while x not in self.arcs[state]:
            if not state:
                return w * self.unknown
            w *= self.fail[state]
            state = state[1:]
        return w * self.arcs[state][x][0]

    def walk(self, text):
        state, score = self.longest(("<s>",)), 0.0
        for x in text:
            score += math.log10(self.weight(state, x))
            while state and x not in self.arcs[state]:
                state = state[1:]
            state = self.arcs[state][x][1] if x in self.arcs[state] else ()
        return score


def check(docs, rows):
    """Brute force over the same texts, walked token by token."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    slow = Slow([[*words(text), None] for i, text in docs if not held(i)])
    c, n, v = slow.c, slow.n, slow.v
    expect = collections.Counter()
    for i, text in docs:
        w = [*words(text), None]
        base = sum(math.log10((c[(x,)] + 1) / (n + v + 1)) for x in w)
        expect[i, held(i), len(w), sum(c[(x,)] > 0 for x in w), n, round(base, 5), round(slow.walk(w), 5)] += 1
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in rows)
    key = lambda x: tuple(str(y) for y in x[0])
    for a, b in zip(sorted(expect.items(), key=key), sorted(got.items(), key=key), strict=True):
        assert a[0][:5] == b[0][:5] and a[1] == b[1] and a[0][5:] == pytest.approx(b[0][5:], rel=1e-5)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = registry.op9_lm(spark, sf).collect()
    check(docs, rows)
    apart = [r for r in rows if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_chunks_do_not_change_results(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    monkeypatch.setattr(lm, "CHUNK", 300)
    check([(r.doc_id, r.text) for r in docs.collect()], lm.scored(docs.repartition(4)).collect())


def test_odd_rows(odd_docs, no_docs, make_docs):
    check([(r.doc_id, r.text) for r in odd_docs.collect()], lm.scored(odd_docs).collect())
    assert lm.scored(no_docs).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (one,) = lm.scored(make_docs([(held, "only held out")])).collect()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.score, one.base_score) == (4, 0, 0, 0.0, 0.0)


def test_weights_of_a_state_sum_to_one():
    """Over all words and the unknown one, for each state and the root."""
    slow = Slow([[*t.split(), None] for t in ["a b a c", "b a", "c c a"]])
    assert len(slow.arcs) > 8
    for state in slow.arcs:
        assert sum(slow.weight(state, x) for x in [*slow.words, "unknown"]) == pytest.approx(1)


def test_counts_beyond_32_bits():
    """A word that occurs more often than 2^32 times keeps its count on the way back to a chunk."""
    rows = [{"chunk": bytes([k]), "kind": lm._WORDS, "part": 0, "keys": lm.packed(np.array([5, 9], np.uint64)), "data": lm.squeezed(np.array([1 << 32, k], np.int64))} for k in range(3)]
    out = lm._answer((pa.scalar(lm._WORDS), pa.scalar(0)), pa.Table.from_pylist(rows, lm._FIELDS)).to_pylist()
    assert [lm.expanded(r["data"]).tolist() for r in out if r["kind"] == lm._WORDS] == [[3 << 32, 3]] * 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aAbBé \t\n\x0b\x0c\r\x85中")), max_size=12)), max_size=6), st.integers(0, 2))
def test_word_hashes(texts, offset):
    hashes, counts = word_hashes(pa.array(texts, pa.string()).slice(offset))
    own = [words(t) for t in texts[offset:]]
    assert counts.tolist() == [len(w) for w in own]
    flat = [x for w in own for x in w]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=50), st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_blobs(keys, counts):
    x = np.array(sorted(keys), np.uint64)
    assert lm.unpacked(lm.packed(x)).tolist() == x.tolist()
    assert lm.expanded(lm.squeezed(np.array(counts, np.int64))).tolist() == counts
