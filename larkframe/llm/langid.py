"""Language identification with spans of mixed-language text.

A word is a run of letters. The script ranges of its letters narrow the
candidate languages to those that were seen in that script; each candidate's
score is the sum of log-probabilities of the word's character trigrams. Viterbi
over the words with a penalty for every switch labels spans; the text's
language is the one with most letters.

A constant path is optimal whenever no run of words gains more than the switches
around it cost. That is decided by a running sum, so only texts that really
switch go through Viterbi word by word.

The model is fitted on at most `SAMPLE` labelled documents per language, taken
by hash; every text is scored as a whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from larkframe.llm.common import apart, in_slices, stage, together

UNKNOWN = "und"
#: Labelled documents per language that the model is fitted on; they are read whole.
SAMPLE = 400
#: Rows of the sample's ids (24 bytes each) that are broadcast at most.
BROADCAST = 50_000
SWITCH = 12.0
#: Buckets of trigram hashes.
BUCKETS = 1 << 16
SMOOTH = 0.5
#: A language is a candidate for a script that holds this share of its letters.
SHARE = 0.01
#: Log-probability per word of a language that is no candidate.
OUTSIDE = -40.0
#: First code point of each range and its script; what lies between belongs to the range before it.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB07, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
NAMES = sorted({s for _, s in SCRIPTS})

_TABLES: list = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script."""
    if not _TABLES:
        n = sys.maxunicode + 1
        letter, lower, script = np.zeros(n, bool), np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
        for c in range(n):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                letter[c] = True
                low = chr(c).lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        edges = [a for a, _ in SCRIPTS] + [n]
        for (a, name), b in zip(SCRIPTS, edges[1:], strict=True):
            script[a:b] = NAMES.index(name)
        _TABLES.extend((letter, lower, script))
    return tuple(_TABLES)


def letters_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its start among the grams, letters, script; and per gram its bucket. Grams of a word: one ending at each letter and one at its end."""
    letter, lower, script = tables()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    on = letter[cp]
    low = np.where(on, lower[cp], 0).astype(np.uint64)
    pad = np.concatenate([np.zeros(2, np.uint64), low, np.zeros(1, np.uint64)])
    held = np.concatenate([on, [False]])
    before = np.concatenate([[False], on])
    at = np.flatnonzero(held | before)  # letters, and the place after each word
    c, b, a = pad[at + 2], pad[at + 1], pad[at]
    a = np.where(b == 0, 0, a)
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)) * np.uint64(0xFF51AFD7ED558CCD)
    grams = (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    starts = np.flatnonzero(held & ~before)
    ends = np.flatnonzero(~held & before)
    first = np.searchsorted(at, starts)
    return first, ends - starts, script[cp[starts]] if len(starts) else np.zeros(0, np.uint8), grams


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (BUCKETS, languages)
    allowed: np.ndarray  # (scripts, languages)
    prior: np.ndarray

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) and the letters of each word."""
        first, n, script, grams = letters_of(text)
        if not len(first):
            return np.zeros((0, len(self.langs))), n
        scores = np.add.reduceat(self.logp[grams], first, axis=0).astype(np.float64)
        fits = self.allowed[script]
        # A script that no language was seen in tells nothing.
        return np.where(fits, scores, np.where(fits.any(1, keepdims=True), scores.min(1, keepdims=True) + OUTSIDE, 0.0)), n

    def label(self, text: str, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language of each word, each word's letters, total score of each language."""
        scores, n = self.word_scores(text)
        total = scores.sum(0) + self.prior
        if len(scores):
            scores[0] += self.prior
        best = int(total.argmax())
        if len(self.langs) > 1 and len(scores):
            gain = np.delete(scores, best, axis=1).max(1) - scores[:, best]
            runs = np.concatenate([[0.0], np.cumsum(gain)])
            if (runs - np.minimum.accumulate(runs)).max() > switch:
                return viterbi(scores, switch), n, total
        return np.full(len(scores), best), n, total

    def predict(self, text: str | None, switch: float = SWITCH) -> tuple[str, float]:
        """Language and score: the share of letters in it, times its chance against the others."""
        if not text:
            return UNKNOWN, 0.0
        labels, n, total = self.label(text, switch)
        if not len(labels):
            return UNKNOWN, 0.0
        letters = np.bincount(labels, weights=n, minlength=len(self.langs))
        best = int(letters.argmax())
        # Against the other languages as a whole, where the text does not switch.
        chance = 1.0 if (labels != best).any() else 1 / np.exp(np.clip(total - total[best], -700, 50)).sum()
        return self.langs[best], float(min(1.0, letters[best] / letters.sum() * chance))

    def spans(self, text: str, switch: float = SWITCH) -> list[tuple[str, int]]:
        """(language, words) of each span in order."""
        labels, _, _ = self.label(text, switch)
        edges = np.flatnonzero(np.diff(labels)) + 1 if len(labels) else []
        cuts = [0, *edges, len(labels)]
        return [(self.langs[labels[a]], int(b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best path over (words, languages) where a change of language costs `switch`; ties stay."""
    n, k = scores.shape
    came = np.empty((n, k), np.int16)
    stay = np.arange(k, dtype=np.int16)
    v = scores[0].copy()
    for t in range(1, n):
        top = int(v.argmax())
        moved = v[top] - switch
        move = moved > v
        came[t] = np.where(move, top, stay)
        v = np.where(move, moved, v) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = v.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def held_out(k: int = 5, rest: int = 0) -> Column:
    """crc32 of doc_id as text leaves `rest`; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == rest, F.lit(True))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of (doc_id, text, lang) rows; None where there is no labelled text."""
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # A document's place in [0, 1) is its hash; of each language about twice the sample come near 0, and of these the first.
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / float(1 << 40)
    many = stage(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select(F.col("lang").alias("l"), "n"), "langid-langs")
    small = lambda df, n: F.broadcast(df) if df.count() <= n else df
    # The filter comes before any shuffle: a language that holds most rows is cut down where its rows are read.
    ids = rows.select("lang", "h", place.alias("place")).join(small(many, BROADCAST), F.col("lang") == F.col("l")).filter(F.col("place") < F.lit(2.0 * sample) / F.col("n"))
    ids = ids.groupBy("lang", "h").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))
    chosen = stage(ids.withColumn("rank", rank).filter(F.col("rank") <= sample).select(F.col("lang").alias("l"), F.col("h").alias("k")), "langid-sample")
    # At most `sample` rows a language; sent to all tasks where that is known to be little, so that no text is shuffled.
    # A repeated row counts once.
    rows = rows.join(small(chosen, BROADCAST), (F.col("h") == F.col("k")) & (F.col("lang") == F.col("l")), "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in in_slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, n, script, own = letters_of(text.as_py())
                grams[lang] = grams.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(script, weights=n, minlength=len(NAMES))
                docs[lang] = docs.get(lang, 0) + 1
        names = sorted(grams)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([docs[x] for x in names], pa.int64()), pa.array([grams[x].astype("<i8").tobytes() for x in names], pa.binary()), pa.array([scripts[x].astype("<f8").tobytes() for x in names], pa.binary())],
            ["lang", "docs", "grams", "scripts"],
        )

    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found: dict[str, list] = {}
    for r in rows.coalesce(min(n, 16)).mapInArrow(count, "lang string, docs long, grams binary, scripts binary").collect():
        new = [r.docs, np.frombuffer(r.grams, "<i8"), np.frombuffer(r.scripts, "<f8")]
        found[r.lang] = [a + b for a, b in zip(found[r.lang], new, strict=True)] if r.lang in found else new
    if not found:
        return None
    langs = sorted(found)
    counts = np.stack([found[x][1] for x in langs], 1).astype(np.float64)
    logp = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)).astype(np.float32)
    scripts = np.stack([found[x][2] for x in langs], 1)
    docs = np.array([found[x][0] for x in langs], np.float64)
    return Model(langs, logp, scripts > SHARE * np.maximum(scripts.sum(0), 1), np.log(docs / docs.sum()))


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """`keep` columns of every document with lang_pred and score; `und` and 0 for texts that are null or have no letter.

    The columns kept must not be named text, lang_pred or score. Without a model
    (nothing to learn from) all is `und`.
    """
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    rows, n = docs.select(*keep, "text"), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in in_slices(batches, n):
            got = [own.predict(t.as_py()) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents; learned from rows that are not held out.

    Null, empty and letterless texts are `und` with score 0; repeated rows are
    judged alike; texts are judged whole, however long; ties go to the language
    that sorts first. Other columns, whatever their names, take no part. No rows
    give no rows.
    """
    flagged = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(flagged.filter("not held_out"))
    return identify(flagged, model, ["doc_id", "held_out"])


def clean(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whatever their names, that have a language with a score of `least`; `und` goes.

    Learned from the labelled ones among them. Null, empty and letterless texts
    are `und`; texts are judged whole, however long; repeated rows are judged alike.
    No rows give no rows.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    judged = identify(apart(docs, ["text"]), model, ["whole"])
    return together(judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs.columns)
