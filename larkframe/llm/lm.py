"""LM scoring by a weighted backoff automaton over word trigrams.

States are the root, each word seen in training (and the start of a text), and
each pair seen. A state's arc by word w leads to the state of the longest suffix
that training saw; its weight is the smoothed probability
(c(hw) + MU p(w | h')) / (c(h) + MU), h' being the history without its first word.
Where a state has no arc by w, its failure arc costs MU / (c(h) + MU) and leads to
the state of h', and so on to the root, whose arcs weigh p(w) = (c(w) - D) / N, and
D V / N for any word that was not seen. Each state's weights sum to 1. A text is one
left-to-right walk that carries the state and adds up log10 weights.

The state before a token is the longest suffix that training saw, so it can be
told from the counts of the last pair and word alone: all tokens of a chunk walk at
once, in array steps, one per order.

The vocabulary and the arcs grow with the corpus, so no executor holds them all.
Documents form chunks. A chunk asks for the counts of its own distinct words, pairs
and triples, by ranges of their hashes; a range adds up what all chunks counted and
answers each chunk in the order it asked. So a chunk receives exactly the part of
the automaton that its texts can reach. Only sorted hashes and counts are
shuffled, one row per chunk and range; a frequent word is one entry per chunk.
Words have 64-bit hashes; those of pairs and triples grow with the corpus, so that
SPARE bits more than the number of tokens has keep them apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkframe.llm.common import in_slices, n_words, stage
from larkframe.llm.words import mixed, word_hashes

#: Weight of the lower order for pairs and for triples; what is taken off a word's count for those not seen.
MU, D = (60.0, 20.0), 0.6
#: Words of a chunk (a longer text is a chunk of its own).
CHUNK = 2_000_000
#: Least number of hash ranges, and documents for each further one.
RANGES, PER_RANGE = 128, 8192
END, START = np.uint64(1), np.uint64(2)
#: Bits of the hashes of pairs and triples: those of the number of tokens, and so many more; at least LEAST_BITS.
SPARE, LEAST_BITS = 14, 36
_DOCS, _WORDS, _PAIRS, _TRIPLES, _TOTAL = 0, 1, 2, 3, 4
_ROW = "chunk binary, kind int, part int, keys binary, data binary"
_FIELDS = pa.schema([("chunk", pa.binary()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())])


def held_out(k: int = 7, rest: int = 2) -> Column:
    """crc32 of doc_id as text leaves `rest`; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == rest, F.lit(True))


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers by as many byte planes as the largest needs, compressed; the first 9 bytes tell how many of each."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def expanded(blob: bytes) -> np.ndarray:
    width, size = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(pa.decompress(blob[9:], size, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, :width] = planes.T
    return whole.view("<u8").ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted hashes: the first, and steps."""
    return (int(keys[0]) if len(keys) else 0).to_bytes(8, "little") + squeezed(np.diff(keys)) + bytes([len(keys) > 0])


def unpacked(blob: bytes) -> np.ndarray:
    steps = np.concatenate([np.frombuffer(blob[:8], "<u8"), expanded(blob[8:-1])])
    return np.cumsum(steps, dtype=np.uint64)[: None if blob[-1] else 0]


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each code's distinct value, the distinct values), numbered as they come."""
    return pd.factorize(codes)


class Chunk:
    """Tokens of some documents as numbers of the chunk's distinct words, sorted by hash, and its distinct pairs and triples.

    pair and triple tell of each token the numbers of the pair and triple that end
    with it; a text's first token has a pair with the start and no triple (-1).
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, bits: int):
        self.words, self.tokens, self.lengths = words, tokens, lengths
        self.heads = np.zeros(len(tokens), bool)
        self.heads[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        before = np.concatenate([[0], tokens[:-1]]).astype(np.int64) if len(tokens) else np.zeros(0, np.int64)
        #: Word before each token: its number, len(words) at the start of a text.
        self.word_before = np.where(self.heads, len(words), before)
        shift, n = np.uint64(64 - bits), max(len(words), 1)
        codes, pairs = _places(self.word_before * n + tokens)
        whole = mixed(np.append(words, START)[pairs // n] * np.uint64(0xD6E8FEB86659FD93) ^ words[pairs % n])
        self.pair, self.pairs = self._sorted(codes, whole >> shift)
        inner = np.flatnonzero(~self.heads)
        own, triples = _places(codes[inner - 1] * n + tokens[inner])
        hashes = mixed(whole[triples // n] * np.uint64(0xA0761D6478BD642F) ^ words[triples % n]) >> shift
        self.triple = np.full(len(tokens), -1, np.int64)
        self.triple[inner], self.triples = self._sorted(own, hashes)

    @staticmethod
    def _sorted(codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes renumbered in the order of the hashes, and the hashes in order."""
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place[codes], hashes[order]

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, bits: int) -> Chunk:
        """From word hashes and words per text; the end is a token of each text."""
        lengths = counts + 1
        ends = np.cumsum(lengths) - 1
        tokens = np.empty(len(hashes) + len(counts), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends] = True
        tokens[is_end], tokens[~is_end] = END, hashes
        codes, words = _places(tokens)
        return cls(*cls._sorted(codes, words)[::-1], lengths, bits)


class Automaton:
    """The part of the automaton that a chunk's texts reach, from the counts of its words, pairs and triples."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, texts: int, mu: tuple[float, float] = MU, d: float = D):
        self.n, self.mu, self.d = n, mu, d
        self.known = words > 0
        self.words, self.pairs, self.triples = (x.astype(np.float64) for x in (words, pairs, triples))
        self.texts = float(texts)

    def walk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Log10 weight of the arcs that each token takes and whether it is known; an unknown word's root arc is left out (it needs V)."""
        words, heads = chunk.tokens, chunk.heads
        known = self.known[words]
        root = np.where(known, (self.words[words] - self.d) / max(self.n, 1), 1.0)
        # Counts of the histories: the word before, and the pair before (none at the first token).
        history = [np.append(self.words, self.texts)[chunk.word_before], np.where(heads, 0.0, self.pairs[np.concatenate([[0], chunk.pair[:-1]])] if len(heads) else 0.0)]
        arcs = [self.pairs[chunk.pair], np.where(chunk.triple >= 0, np.append(self.triples, 0.0)[chunk.triple], 0.0)]
        # Weight of the arc by the token, where there is one, of the state of each order.
        lower, weight = root, []
        for mu, h, c in zip(self.mu, history, arcs, strict=True):
            lower = (c + mu * lower) / (h + mu)
            weight.append(lower)
        # The state that is carried: the longest history that training saw. It fails down to the first that has the arc.
        state = np.where(history[1] > 0, 2, np.where(history[0] > 0, 1, 0))
        total, open_ = np.zeros(len(words)), np.ones(len(words), bool)
        for order in (2, 1):
            here = open_ & (state == order)
            arc = here & (arcs[order - 1] > 0)
            total[arc] += np.log10(weight[order - 1][arc])
            open_ &= ~arc
            failed = here & ~arc
            total[failed] += np.log10(self.mu[order - 1] / (history[order - 1][failed] + self.mu[order - 1]))
            state = np.where(failed, order - 1, state)
        total[open_] += np.log10(root[open_])
        return total, known


def _requests(own: Chunk, ids: list, held: np.ndarray, ranges: int, bits: int) -> Iterator[dict]:
    """Rows of a chunk: its documents, and per hash range its distinct words, pairs and triples with their training counts."""
    train = np.repeat(~held, own.lengths)
    names = pa.array(ids, pa.int64())
    docs = pa.record_batch([names, pa.array(held), pa.array(own.lengths)], ["doc_id", "held_out", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_batch(docs)
    head, body = sink.getvalue().to_pybytes(), squeezed(own.tokens)
    name = hashlib.md5(head + body).digest()
    yield {"chunk": name, "kind": _DOCS, "part": -1, "keys": own.words.astype("<u8").tobytes(), "data": len(head).to_bytes(8, "little") + head + body}
    inner = train & ~own.heads
    for kind, keys, codes, among, size in ((_WORDS, own.words, own.tokens, train, 64), (_PAIRS, own.pairs, own.pair, train, bits), (_TRIPLES, own.triples, own.triple, inner, bits)):
        counts = np.bincount(codes[among], minlength=len(keys))
        shift = np.uint64(size - (ranges.bit_length() - 1))
        if not len(keys):
            continue
        part = keys >> shift
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            yield {"chunk": name, "kind": kind, "part": int(part[a]), "keys": packed(keys[a:b]), "data": squeezed(counts[a:b])}


def _chunks(ranges: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            own = Chunk.of(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), bits)
            ids, flags = [i for h in held for i in h[2]], np.concatenate([h[3] for h in held])
            held.clear()
            rows: list = []
            for r in _requests(own, ids, flags, ranges, bits):
                rows.append(r)
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)

        for batch in in_slices(batches, 1):
            hashes, counts = word_hashes(batch.column(1))
            held.append((hashes, counts, batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)))
            size += len(hashes)
            if size >= CHUNK:
                yield from out()
                size = 0
        if held:
            yield from out()

    return run


def _answer(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A range's answers: for each chunk the corpus counts of what it asked, and the range's totals. Documents pass through."""
    kind = key[0].as_py()
    t = t.select(_FIELDS.names)
    if kind == _DOCS:
        return t
    keys = [unpacked(b) for b in t.column("keys").to_pylist()]
    counts = [expanded(b) for b in t.column("data").to_pylist()]
    codes, found = pd.factorize(np.concatenate(keys))
    total = np.bincount(codes, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
    rows, at = [], 0
    for name, own in zip(t.column("chunk").to_pylist(), keys, strict=True):
        rows.append({"chunk": name, "kind": kind, "part": key[1].as_py(), "keys": b"", "data": squeezed(total[codes[at : at + len(own)]])})
        at += len(own)
    if kind == _WORDS:
        part = key[1].as_py()
        rows.append({"chunk": part.to_bytes(4, "little"), "kind": _TOTAL, "part": part, "keys": b"", "data": int((total > 0).sum()).to_bytes(8, "little")})
    return pa.Table.from_pylist(rows, _FIELDS)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, walked double, vocabulary long"
_SCORED_FIELDS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("walked", pa.float64()), ("vocabulary", pa.int64())])


def _score(n: int, texts: int, mu: tuple[float, float], d: float, bits: int):
    def run(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_numpy()
        if (kinds == _TOTAL).all():
            v = sum(int.from_bytes(b, "little") for b in t.column("data").to_pylist())
            return pa.Table.from_pylist([{"vocabulary": v}], _SCORED_FIELDS)
        # The rows of one chunk; equal chunks (repeated rows) have their documents once each.
        rows = sorted(zip(kinds.tolist(), t.column("part").to_pylist(), t.column("keys").to_pylist(), t.column("data").to_pylist(), strict=True), key=lambda r: r[:2])
        docs = [r for r in rows if r[0] == _DOCS]
        counts = {kind: {r[1]: r[3] for r in rows if r[0] == kind} for kind in (_WORDS, _PAIRS, _TRIPLES)}
        blob = docs[0][3]
        cut = 8 + int.from_bytes(blob[:8], "little")
        head = pa.ipc.open_stream(blob[8:cut]).read_all()
        lengths = head.column("n").to_numpy()
        chunk = Chunk(np.frombuffer(docs[0][2], "<u8"), expanded(blob[cut:]).astype(np.int64), lengths, bits)
        seen = [np.concatenate([np.zeros(0, np.uint64), *[expanded(counts[k][p]) for p in sorted(counts[k])]]) for k in (_WORDS, _PAIRS, _TRIPLES)]
        words = seen[0]
        logs, known = Automaton(*seen, n, texts, mu, d).walk(chunk)
        at = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10(words.astype(np.float64) + 1)[chunk.tokens], at)
        out = pa.table([head.column("doc_id"), head.column("held_out"), pa.array(lengths), pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(base), pa.array(np.add.reduceat(logs, at)), pa.nulls(len(lengths), pa.int64())], schema=_SCORED_FIELDS)
        return pa.concat_tables([out] * len(docs))

    return run


def scored(docs: DataFrame, mu: tuple[float, float] = MU, d: float = D) -> DataFrame:
    """Scores every text by the model of the texts that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigrams), score (log10 probability). Null and empty texts are the
    end token alone. Texts are scored whole, however long. Repeated rows are scored
    each; ties do not matter. Other columns, whatever their names, take no part. No
    rows give no rows; with no training text everything is unknown and scores as the
    base does.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    sums = rows.agg(F.count("*"), F.sum((~F.col("held_out")).cast("long")), F.sum(F.when(~F.col("held_out"), n_words(F.col("text")) + 1))).first()
    count, texts, n = (int(x or 0) for x in sums)
    ranges = max(RANGES, 1 << max(0, count // PER_RANGE).bit_length())
    bits = min(64, max(LEAST_BITS, n.bit_length() + SPARE))
    asked = rows.mapInArrow(_chunks(ranges, bits), _ROW)
    answered = asked.withColumn("own", F.when(F.col("kind") == _DOCS, F.col("chunk"))).groupBy("kind", "part", "own").applyInArrow(_answer, _ROW)
    made = stage(answered.groupBy("chunk").applyInArrow(_score(n, texts, mu, d, bits), _SCORED), "lm-scored")
    v = int(made.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0])
    unknown = F.col("n_tokens") - F.col("n_known")
    root = F.log10(F.lit(d * v / n)) if n else F.lit(0.0)
    return made.filter("n_tokens is not null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("walked") + unknown * root).alias("score"),
    )

