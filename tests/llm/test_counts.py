import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkframe.llm import counts, registry
from larkframe.llm.tokens import ByteBpe

PATTERN = counts.pre_tokens()
TEXT = st.text(st.sampled_from(list("ab'srel9 \t\n .,é中\x1c\x85\u2003²")), max_size=60)


@pytest.fixture(scope="module")
def full():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_runs_add_up(full, bpe, text):
    for long in (0, 8, counts.LONG):
        counts.LONG, before = long, counts.LONG
        try:
            own = counts.runs(text, PATTERN)
        finally:
            counts.LONG = before
        assert "".join(own) == text
        assert sum(map(bpe.count_run, own)) == full(text)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-1, 70), st.integers(0, 20), TEXT), max_size=5), st.sampled_from([1, 2, 64]))
def test_edits_count_as_a_full_encoding(full, bpe, text, edits, block):
    counts.BLOCK, before = block, counts.BLOCK
    try:
        tree = counts.TokenCount.of(text, bpe.count_run, PATTERN)
        for e in edits:
            tree.apply(counts.Edit(*e))
            lengths, tokens = tree.leaves()
            assert tree.tokens == tokens.sum() == full(tree.text)
            ends = np.cumsum(lengths)
            assert [bpe.count_run(tree.text[a - n : a]) for a, n in zip(ends, lengths, strict=True)] == tokens.tolist()
            assert tree.tree.sums[0, 1] == lengths.sum() == len(tree.text)
    finally:
        counts.BLOCK = before


def test_only_the_region_is_encoded_again(bpe):
    text = " ".join(f"word{k}" for k in range(5000))
    tree = counts.TokenCount.of(text, bpe.count_run, PATTERN)
    assert tree.apply(counts.Edit(20_000, 3, "abc")) < 60
    assert tree.apply(counts.Edit(len(tree.text), 0, " end")) < 60
    # Over many blocks: sums are updated in place.
    assert tree.apply(counts.Edit(5_000, 10_000, "short")) < 60
    assert tree.rebuilt == 0


def test_text_without_spaces_is_not_one_run(full, bpe):
    text = "".join("中文字" * 5 + "，" for _ in range(2000))
    tree = counts.TokenCount.of(text, bpe.count_run, PATTERN)
    assert tree.apply(counts.Edit(len(text) // 2, 2, "新的")) < 60
    assert tree.tokens == full(tree.text)


def test_trees_are_kept_from_edit_to_edit(make_docs, full):
    """Edits applied in two batches to the table of trees, the second to what the first left."""
    docs = make_docs([(1, "one two three " * 300), (2, None), (3, "x")])
    kept = counts.trees(docs)
    edits = "array(named_struct('position', 5L, 'removed', 3L, 'added', 'new words'), named_struct('position', 900L, 'removed', 4L, 'added', cast(null as string)))"
    once = counts.apply_edits(kept.selectExpr("*", f"{edits} as edits"))
    twice = counts.apply_edits(once.selectExpr("*", f"{edits} as edits"))
    for r in twice.collect():
        assert sum(r.tokens) == full(r.text) and sum(r.lengths) == len(r.text)
        assert r.encoded_again < 200
    assert {r.doc_id: r.text for r in twice.collect()}[2] == "new wnew wordss"


@pytest.mark.parametrize("unit", [" ", "\n", "a", "中", " a"])
def test_very_long_runs(full, bpe, unit):
    text = unit * (2_000_000 // len(unit))
    tree = counts.TokenCount.of(text, bpe.count_run, PATTERN)
    assert tree.tokens == full(text)
    assert len(bpe.encode(text)) == 4 * full(text)


def test_whole_table(spark, sf, full):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op6_counts(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r.doc_id]
        new = text
        n = len(text)
        for at, removed, added in ((n // 3, 17, ""), (n // 2, 0, text[:24]), (2 * n // 3, 9, " New words. "), (n + 64, 0, "\nEnd.")):
            p = min(at, len(new))
            new = new[:p] + added + new[p + removed :]
        assert (r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) == (len(text), full(text), len(new), full(new))


def test_odd_rows(odd_docs, no_docs):
    rows = counts.recounted(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_chars, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    assert counts.recounted(no_docs).count() == 0
