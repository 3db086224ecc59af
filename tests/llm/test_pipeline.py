import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from larkframe.llm import dedup, mixing
from larkframe.llm.common import stage
from tests.llm.test_packing import check


def fewest(lengths: list[int], size: int = 1024) -> int:
    """A bound that no packing is below: pieces over half a sequence never share one, and what is left beside them is known."""
    n = np.array(lengths)
    bounds = []
    for k in range(size // 2 + 1):
        alone, large, small = n[n > size - k], n[(n > size // 2) & (n <= size - k)], n[(n >= k) & (n <= size // 2)]
        beside = len(large) * size - large.sum()
        bounds.append(len(alone) + len(large) + max(0, -(-int(small.sum() - beside) // size)))
    return max(bounds)


def test_stages(spark, sf, tmp_path):
    docs = whole = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        out = stage(function(spark, docs, sf), name)
        if name != "pack":
            assert out.columns == whole.columns
        kept[name] = docs = out
    ids = {n: sorted(r.doc_id for r in kept[n].collect()) for n in ("language_id", "near_dedup", "mix")}
    assert len(ids["language_id"]) >= 0.98 * whole.count()
    classes = {r.class_id for r in dedup.classes(kept["language_id"]).collect()}
    assert set(ids["near_dedup"]) == classes and len(classes) == len(ids["near_dedup"])
    plan = {r.doc_id: r.copies for r in mixing.taken(kept["near_dedup"]).collect()}
    assert ids["mix"] == sorted(d for d, n in plan.items() for _ in range(n))
    packed = kept["pack"].collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == ids["mix"]
    placed = {}
    for r in packed:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 for p in placed.values())
    assert len(placed) <= 1.02 * fewest([r.length for r in packed])


def test_run_on_odd_rows(spark, odd_docs, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    odd_docs.drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    assert pq.read_table(tmp_path / "documents.parquet").num_rows == odd_docs.count()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.text and r.text.strip()}
    first = [r for r in rows if r.piece == 0]
    assert {r.doc_id for r in first} <= set(texts)
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    once = {r.doc_id for r in first if sum(x.doc_id == r.doc_id for x in first) == 1}
    if once == {r.doc_id for r in first}:
        check([(d, texts[d]) for d in once], rows, hf)


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


HELPERS = "whole h doc id key planned at finish lang_pred score size copies copy row block lane class class_id kept n_rows _doc _id _h _k _key _finish _lang_pred held_out piece start length".split()


def test_columns_of_the_caller_never_clash(spark, make_docs):
    """Every name that an operator uses inside, and names in need of quotes, through all stages."""
    rows = [(k, f"some words of text number {k % 30} that stay in this table {k % 30}", "en", f"s{k % 2}") for k in range(40)]
    docs = make_docs(rows)
    for k, name in enumerate([*HELPERS, "a.b", "with space"]):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + k)
    plain = make_docs(rows)
    for name, function in corpus_pipeline.STAGES:
        out, docs, plain = docs, function(spark, docs, ""), function(spark, plain, "")
        if name == "pack":
            assert docs.columns == plain.columns
            break
        assert docs.columns == out.columns
        got, expect = docs.collect(), plain.collect()
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in expect)
        for r in got:
            assert [r[c] for c in docs.columns[5:]] == [r.doc_id * 100 + k for k in range(len(docs.columns) - 5)]
