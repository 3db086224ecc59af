import re

import pytest
from pyspark.sql import functions as F

from larkframe.llm import mixing, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Brute force: capped sources leave, the rest is dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, got, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(got.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return got | share
        got |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return got


def check(docs, out):
    rows = [r.asDict() for r in out.collect()]
    own = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d), n) for d, _, n in own)
    sizes, taken, largest, goal = {}, {}, {}, {}
    for _, s, n in own:
        sizes[s] = sizes.get(s, 0) + n
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        goal[r["source"]] = r["target"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    expect = targets(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(expect[s])
        assert taken[s] <= goal[s] + 1e-6
    return goal, taken


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.taken(docs)
    goal, taken = check(docs, out)
    rows = out.collect()
    for s in goal:  # short by less than the smallest document that could be taken once more
        own = [r for r in rows if r["source"] == s and r["size"]]
        more = [r["size"] for r in own if r["copies"] < max(x["copies"] for x in own)] or [r["size"] for r in own]
        assert goal[s] - taken[s] < min(more)
    assert sum(taken.values()) <= sum(goal.values()) + 1e-6


def test_reruns_agree_whatever_the_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = registry.op1_mixing(spark, sf).orderBy("doc_id").collect()
    b = mixing.taken(docs.repartition(13)).select("doc_id", "size", "source_size", "target", "taken", "copies", "finish").orderBy("doc_id").collect()
    assert a == b


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, mixing.taken(odd_docs))
    assert mixing.taken(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0


def test_all_sources_empty(make_docs):
    rows = mixing.taken(make_docs([(1, None), (2, " ", "en", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_mix_repeats_rows_in_finish_order(make_docs):
    docs = make_docs([(k, "w " * (1 + k % 7), "en", "a" if k < 10 else "b") for k in range(200)])
    plan = {r.doc_id: r.copies for r in mixing.taken(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = [r.doc_id for r in mixed.collect()]
    assert {d: got.count(d) for d in plan} == plan
    assert max(plan.values()) == 3


def test_one_block_and_many_blocks_agree(make_docs, monkeypatch):
    docs = make_docs([(k, "w " * (1 + k % 11), "en", f"s{k % 3}") for k in range(500)])
    a = mixing.taken(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(mixing, "BLOCK", 20)
    assert mixing.taken(docs).orderBy("doc_id").collect() == a


def walk(rows):
    """Copies by walking each source's queue: all up to the cut, then whatever still fits."""
    out = {}
    for lane in {r.lane for r in rows}:
        own = sorted((r for r in rows if r.lane == lane and r.size), key=lambda r: r.start)
        full = int(own[0].target // own[0].source_size) if own else 0
        left, cut = own[0].target - full * own[0].source_size, False
        rest = left
        for r in own:
            unit = r.size * r.n_rows
            cut = cut or r.start + unit > rest
            fits = unit <= left if cut else True
            left -= unit if fits else 0
            out[r.doc_id] = full + fits
    return out


def test_a_very_long_document_at_the_cut(spark, make_docs):
    long = "w " * 20_000
    keys = make_docs([(k, long, "en", "b") for k in range(10_000, 10_040)]).select("doc_id", mixing._shuffle_key(7).alias("key")).collect()
    at_cut = next(r.doc_id for r in keys if 0.35 < r.key / 2**63 < 0.6)
    rows = [(k, "w " * 50, "en", "a") for k in range(1000)] + [(k, "w " * (5 + k % 11), "en", "b") for k in range(1000, 4000)]
    plan = mixing.fair_queue(make_docs(rows + [(at_cut, long, "en", "b")])).collect()
    own = [r for r in plan if r.source == "b"]
    assert next(r.copies for r in own if r.doc_id == at_cut) == 0
    assert {r.doc_id: r.copies for r in plan if r.size} == walk(plan)
    assert own[0].target - sum(r.copies * r.size for r in own) < 5


@pytest.mark.parametrize("block", [20, 20_000])
def test_remainders_are_filled_as_by_walking(make_docs, monkeypatch, block):
    monkeypatch.setattr(mixing, "LOOKAHEAD", 1)
    monkeypatch.setattr(mixing, "BLOCK", block)
    sizes = [1 + (k * k * 7919) % 61 ** (1 + k % 3) % 3000 for k in range(900)]
    docs = make_docs([(k, "w " * n, "en", f"s{k % 5}") for k, n in enumerate(sizes)])
    plan = mixing.fair_queue(docs).collect()
    assert {r.doc_id: r.copies for r in plan} == walk(plan)


def test_whole_table_takes_what_walking_the_queues_takes(spark, sf):
    plan = mixing.fair_queue(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id: r.copies for r in plan if r.size} == walk(plan)


def test_rows_that_are_left_out_are_spread(make_docs):
    docs = make_docs([(k, "w " * 9, "en", "a" if k < 600 else "b") for k in range(2000)])
    plan = mixing.fair_queue(docs).withColumn("finish", F.when(F.col("copies") > 0, mixing.finish_time(F.lit(0))))
    parts = mixing.by_finish(plan, "finish", ["doc_id", "key"]).select("finish", F.spark_partition_id().alias("p")).collect()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = [r.p for r in parts if r.finish is None]
    assert len(out) > 500 and max(out.count(p) for p in range(n)) < 2 * len(out) / n
    ranges = sorted((r.p, r.finish) for r in parts if r.finish is not None)
    assert [f for _, f in ranges] == sorted(f for _, f in ranges)
