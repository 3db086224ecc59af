import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkframe.llm import langid, registry


def test_whole_table(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op10_langid(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    apart = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in apart) >= 0.95 * len(apart)


def test_names_and_ids_are_no_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    a = langid.identify(docs, model, ["doc_id"]).collect()
    b = langid.identify(docs.selectExpr("doc_id", "text", "'x' as lang", "null as source"), model, ["doc_id"]).collect()
    assert a == b


def test_odd_rows(odd_docs, no_docs, make_docs):
    rows = langid.predicted(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 5)} == {("und", 0.0)}
    assert all(r.lang_pred in ("en", "fr", "de") for r in rows if r.doc_id not in (1, 2, 5))
    assert langid.predicted(no_docs).count() == 0
    (one,) = langid.predicted(make_docs([(0, "no labels at all")])).collect()
    assert (one.lang_pred, one.score) == ("und", 0.0)
    assert langid.clean(no_docs).columns == no_docs.columns
    kept = langid.clean(odd_docs)
    assert kept.columns == odd_docs.columns and not {1, 2, 5} & {r.doc_id for r in kept.collect()}


@pytest.fixture(scope="module")
def model(make_docs):
    rows = [(k, "the quick brown fox jumps over the lazy dog and then it sleeps", "en") for k in range(9)]
    rows += [(k, "быстрая лиса прыгает через собаку", "ru") for k in range(10, 19)]
    rows += [(k, "der schnelle braune fuchs springt über den faulen hund und schläft", "de") for k in range(20, 29)]
    rows += [(k, "το γρήγορο καφέ αλεπού", "el") for k in range(30, 39)]
    return langid.fit(make_docs(rows))


def test_scripts_narrow_the_candidates(model):
    assert model.predict("лиса")[0] == "ru" and model.predict("αλεπού")[0] == "el"
    scores, _ = model.word_scores("собаку the")
    assert scores[0].argmax() == model.langs.index("ru") and scores[0].max() > sorted(scores[0])[-2] + 30
    assert scores[1][model.langs.index("ru")] < scores[1].max() - 30
    # A script that no language was seen in tells nothing.
    assert model.predict("中文")[0] in model.langs


def test_spans_of_mixed_text(model):
    text = "the lazy dog sleeps and then it jumps over the fox " * 2 + "der faule hund schläft und springt über den fuchs " * 2 + "быстрая лиса " * 3
    spans = model.spans(text)
    assert [s[0] for s in spans] == ["en", "de", "ru"] and sum(s[1] for s in spans) == len(text.split())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3), st.floats(0, 5), st.data())
def test_viterbi_is_the_best_path(k, switch, data):
    from itertools import product

    n = data.draw(st.integers(1, 6))
    scores = np.array(data.draw(st.lists(st.lists(st.integers(-4, 4), min_size=k, max_size=k), min_size=n, max_size=n)), float)

    def value(path):
        return sum(scores[t, p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))

    got = langid.viterbi(scores.copy(), switch)
    assert value(got) == pytest.approx(max(map(value, product(range(k), repeat=n))))


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_the_short_cut_agrees_with_viterbi(model, data):
    words = ["the", "dog", "hund", "über", "лиса", "den", "fox", "中", "1"]
    text = " ".join(data.draw(st.lists(st.sampled_from(words), min_size=1, max_size=30)))
    switch = data.draw(st.floats(0.5, 30))
    labels, _, _ = model.label(text, switch)
    scores, _ = model.word_scores(text)
    if not len(scores):
        return
    scores[0] += model.prior

    def value(path):
        return scores[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()

    assert value(labels) == pytest.approx(value(langid.viterbi(scores.copy(), switch)))


def test_words_are_runs_of_letters():
    text = "Ab1c d-é 中文x́ 9 ()"
    first, n, _, grams = langid.letters_of(text)
    words = re.findall(r"[^\W\d_]+", text)
    assert n.tolist() == [len(w) for w in words] and len(grams) == sum(len(w) + 1 for w in words)
    alone = langid.letters_of("c")[3].tolist()
    assert grams[first[1] : first[1] + 2].tolist() == alone


class Slow:
    """The whole operator by plain loops over words and their trigrams."""

    def __init__(self, labelled):
        self.langs = sorted({lang for _, lang in labelled})
        self.grams = {x: {} for x in self.langs}
        scripts, docs = {x: {} for x in self.langs}, dict.fromkeys(self.langs, 0)
        for text, lang in labelled:
            docs[lang] += 1
            for word in self.words(text):
                scripts[lang][self.script(word)] = scripts[lang].get(self.script(word), 0) + len(word)
                for g in self.trigrams(word):
                    self.grams[lang][g] = self.grams[lang].get(g, 0) + 1
        self.total = {x: sum(self.grams[x].values()) + langid.SMOOTH * langid.BUCKETS for x in self.langs}
        self.prior = {x: math.log(docs[x] / len(labelled)) for x in self.langs}
        every = {}
        for own in scripts.values():
            for name, n in own.items():
                every[name] = every.get(name, 0) + n
        self.allowed = {name: [x for x in self.langs if scripts[x].get(name, 0) > langid.SHARE * max(n, 1)] for name, n in every.items()}

    @staticmethod
    def words(text):
        out, now = [], ""
        for c in (text or "") + " ":
            if unicodedata.category(c)[0] == "L":
                now += c
            elif now:
                out.append(now)
                now = ""
        return out

    @staticmethod
    def script(word):
        return [name for at, name in langid.SCRIPTS if at <= ord(word[0])][-1]

    @staticmethod
    def trigrams(word):
        codes = [0, 0, *[ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word], 0]
        wrap = (1 << 64) - 1
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) * 0xFF51AFD7ED558CCD & wrap
            yield (h >> 48) % langid.BUCKETS

    def predict(self, text):
        words = self.words(text)
        if not words:
            return "und", 0.0
        rows = []
        for word in words:
            own = {x: sum(math.log((self.grams[x].get(g, 0) + langid.SMOOTH) / self.total[x]) for g in self.trigrams(word)) for x in self.langs}
            fit = self.allowed.get(self.script(word), [])
            rows.append({x: (own[x] if x in fit else min(own.values()) + langid.OUTSIDE) if fit else 0.0 for x in self.langs})
        total = {x: sum(r[x] for r in rows) + self.prior[x] for x in self.langs}
        value, came = {x: rows[0][x] + self.prior[x] for x in self.langs}, []
        for r in rows[1:]:
            best = max(self.langs, key=lambda x: value[x])
            came.append({x: best if value[best] - langid.SWITCH > value[x] else x for x in self.langs})
            value = {x: max(value[x], value[best] - langid.SWITCH) + r[x] for x in self.langs}
        path = [max(self.langs, key=lambda x: value[x])]
        for step in reversed(came):
            path.append(step[path[-1]])
        letters = dict.fromkeys(self.langs, 0)
        for x, word in zip(reversed(path), words, strict=True):
            letters[x] += len(word)
        best = max(self.langs, key=lambda x: letters[x])
        chance = 1.0 if len(set(path)) > 1 else 1 / sum(math.exp(min(50, max(-700, total[x] - total[best]))) for x in self.langs)
        return best, min(1.0, letters[best] / sum(letters.values()) * chance)


def test_whole_prediction(spark, sf):
    """Every row's language and score against plain loops; on this table the sample is all labelled rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    seen = {(r.doc_id, r.text, r.lang) for r in docs if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    assert len(seen) <= langid.SAMPLE
    slow = Slow([(text, lang) for _, text, lang in seen])
    got = {r.doc_id: (r.lang_pred, r.score) for r in registry.op10_langid(spark, sf).collect()}
    for r in docs:
        lang, score = slow.predict(r.text)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=1e-3)


def test_repeated_rows_do_not_pass_the_sample(make_docs):
    """A language that holds nearly all rows, one of them repeated: at most SAMPLE texts a language are read."""
    rows = [(1, "the same words again", "en")] * 400 + [(k, f"some other words {k}", "en") for k in range(2, 40)] + [(k, "und noch ein paar worte", "de") for k in range(50, 53)]
    model = langid.fit(make_docs(rows), 5)
    docs = np.exp(model.prior)
    assert model.langs == ["de", "en"] and docs[0] == pytest.approx(3 / 8)
