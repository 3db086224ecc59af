import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkframe.llm import packing
from larkframe.llm.tokens import ByteBpe


@pytest.fixture(scope="module")
def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe()


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.sampled_from(list("ab'sé9 \t\n\r  .中,")), max_size=40))
def test_ids_equal_the_tokenizer(hf, bpe, text):
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x<|endoftext|>", "", " ", "a  b   c", "x \n y"])
def test_special_tokens(hf, bpe, text):
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids


def test_ids_of_the_documents(spark, sf, hf, bpe):
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert np.frombuffer(bpe.encode(r.text), "<u4").tolist() == hf.encode(r.text, add_special_tokens=False).ids


def check(docs, rows, hf):
    """Round trip: pieces tile every document, sequences are gapless and hold at most 1024."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for placed in by_seq.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 1024
    for doc, text in docs:
        ids = hf.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == len(ids)
    return len(by_seq)


def test_whole_table(spark, sf, hf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs).collect()
    made = check([(r.doc_id, r.text) for r in docs.collect()], rows, hf)
    assert made <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_odd_rows(odd_docs, no_docs, hf):
    rows = packing.pack(odd_docs.filter("doc_id is null or doc_id != 4")).collect()
    check([(r.doc_id, r.text) for r in odd_docs.filter("doc_id is null or doc_id != 4").collect()], rows, hf)
    assert sum(r.doc_id == 4 for r in packing.pack(odd_docs).collect()) == 2
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80))
def test_sum_of_squares_is_the_rule(lengths):
    """Each placement makes the sum of squares as small as any would."""
    size, open_gaps = 16, []
    seq, offset = packing.sum_of_squares(np.array(lengths, np.int64), size)
    fill = {}
    for s, q, o in zip(lengths, seq.tolist(), offset.tolist(), strict=True):

        def squares(gaps):
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)

        gaps = [size - f for f in fill.values() if f < size]
        ways = [squares([*gaps, size - s])] + [squares([x for k, x in enumerate(gaps) if k != i] + [g - s]) for i, g in enumerate(gaps) if g >= s]
        assert fill.get(q, 0) == o
        fill[q] = o + s
        assert fill[q] <= size
        assert squares([size - f for f in fill.values() if f < size]) == min(ways) or s == size
    a, b = packing.place(np.array(lengths, np.int64), size)
    if lengths:
        assert a.max() <= seq.max()


def test_cut():
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut(3, 1024) == [(0, 3)]


@pytest.mark.parametrize("unit", [" ", "\n", "a", "中"])
def test_very_long_runs(hf, bpe, unit):
    text = "x" + unit * 2_000_000 + " y"
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids


def test_repeated_rows_are_dealt_to_all_groups(make_docs, monkeypatch, hf):
    monkeypatch.setattr(packing, "GROUP", 50)
    docs = make_docs([(1, "the same text")] * 900 + [(k, "other words " * k) for k in range(2, 40)])
    rows = packing.pack(docs).collect()
    assert sum(r.doc_id == 1 for r in rows) == 900
    groups = [r.sequence_id >> 32 for r in rows]
    assert len(set(groups)) >= 18 and max(map(groups.count, set(groups))) < 120
