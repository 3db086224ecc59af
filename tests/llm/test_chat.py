import duckdb
import pytest

from larkframe.llm import chat, registry

KIND = "conv_id long, turn long, role string, text string, position int"


def brute(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else 0 if k == 0 else "") for k, x in enumerate(t))
    whole = {c: tuple((r, x) for _, r, x in sorted(ts, key=key)) for c, ts in convs.items()}
    out = []
    for ts in set(whole.values()):
        if not any(len(o) > len(ts) and o[: len(ts)] == ts for o in whole.values()):
            own = [c for c, o in whole.items() if o == ts]
            out.append((min(own), len(ts), len(own), "".join(f"<|im_start|>{r if r is not None else 'user'}\n{x or ''}<|im_end|>\n" for r, x in ts)))
    return sorted(out)


def found(df):
    return sorted((r.conv_id, r.n_turns, r.n_logged, r.text) for r in df.collect())


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"), (4, 5, "user", "hi"), (4, 9, "assistant", "hello"),
    (5, 0, "user", None), (5, 0, "user", None), (6, 0, None, ""), (7, None, "user", "x"), (7, 0, "user", "y"), (None, 0, "user", "z"), (8, 0, "user", ""), (9, 0, "user", "w " * 20_000), (10, 0, "user", "hi "), (11, 0, "b", "t"), (11, 0, "a", "t"), (12, 0, "a", "t"),
]


def test_small(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], KIND)
    assert found(chat.formatted(df)) == brute(ROWS)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = [(c, t, "user", f"{t}" if t < n - 1 or c % 2 else "end") for c in range(12) for n in [c + 1] for t in range(n)]
    df = spark.createDataFrame([(*r, 1) for r in rows], KIND)
    assert found(chat.formatted(df)) == brute(rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(registry.op8_chat(spark, sf))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    done = con.execute(chat.SQL)
    names = [c[0] for c in done.description]
    assert sorted(tuple(r[names.index(n)] for n in ("conv_id", "n_turns", "n_logged", "text")) for r in done.fetchall()) == got


def test_no_rows(spark):
    assert chat.formatted(spark.createDataFrame([], KIND)).count() == 0
