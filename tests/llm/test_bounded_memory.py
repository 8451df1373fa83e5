"""Long texts and many languages in bounded memory, with the results of the plain way."""

import sys
import tracemalloc

import numpy as np

from pactlens.llm import common, language_id, parity_join, token_counts


def model(languages: int) -> language_id.LanguageModel:
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 50, (languages, 1 << language_id.BITS)).astype(float)
    return language_id.LanguageModel([f"l{k:02}" for k in range(languages)], counts, np.ones((languages, len(language_id.SCRIPT_NAMES))), 2.0)


def text_of(words: int) -> str:
    rng = np.random.default_rng(words)
    letters = np.array(list("abcdeéßΣж"))
    return " ".join("".join(rng.choice(letters, n)) + " ½"[: 2 * (n == 5)] for n in rng.integers(1, 9, words))


def test_pieces_equal_the_whole():
    whole, texts = model(4), [text_of(n) for n in (0, 1, 127, 128, 129, 1000, 5000)] + ["a²b " * 700, "x" * 3000, ". ½" * 900]
    plain = whole.label(texts)
    for piece in (1, 100, 128, 384):
        whole.piece = piece
        for (lang, score, spans), (lang2, score2, spans2) in zip(plain, whole.label_all(texts)):
            assert (lang, spans) == (lang2, spans2) and abs(score - score2) < 1e-9
        for text, (lang, score, spans) in zip(texts, plain):
            lang2, score2, spans2 = whole.label_long(text)
            assert (lang, spans) == (lang2, spans2) and abs(score - score2) < 1e-9


def test_words_from_any_place():
    text = "Aa½b² ΣΑΣ x_1y".lower()
    found = list(language_id.words_from(text, 0))
    assert [w for _, w in found] == language_id.words_of(text)
    for k, (at, word) in enumerate(found):
        assert text[at:at + len(word)] == word
        assert list(language_id.words_from(text, at)) == found[k:]


def test_sixty_languages_in_a_long_text():
    many, text = model(60), text_of(300_000)
    many.label_all(["warm up"])
    tracemalloc.start()
    found = many.label_all([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b - a for a, b, _ in found[0][2]) == len(language_id.words_of(text))
    assert peak < 250 << 20


def test_cache_of_chunks_is_bounded_by_bytes(monkeypatch):
    counter = token_counts._counter("piece_bpe_32k.model").__self__
    texts = [text_of(400), "word " * 50 + "y" * 5000, *(f"w{k} z{k}" for k in range(300))]
    monkeypatch.setattr(token_counts, "KEPT_BYTES", 20_000)
    counter.clear()
    counter.held = 0
    for text in texts:
        assert counter.count(text) == counter.library(text)
        assert counter.held <= 20_000 and all(len(c) <= token_counts.KEPT_LETTERS for c in counter)


def test_new_words_are_scored_in_slices(monkeypatch):
    words = sorted({f"{w}{chr(0x61 + k % 26)}" * 4 for k, w in enumerate(language_id.words_of(text_of(30_000)))})
    peaks, scores = [], []
    for size in (1 << 20, 1 << 8):
        monkeypatch.setattr(language_id, "GRAM_WORDS", size)
        some = model(4)
        tracemalloc.start()
        scores.append(some.rows(words))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert (scores[0] == scores[1]).all() and peaks[1] * 3 < peaks[0]


def test_a_worker_drops_the_caches_of_other_operators():
    common.worker_cache("one:a", list).append(1)
    common.worker_cache("two:b", list)
    held, ended = [], []
    for _ in common.give_back(iter([1]), "one:", done=lambda: ended.append(True)):
        held = sorted(n for n in vars(sys.modules["_pactlens_worker_cache"]) if not n.startswith("__"))
        assert not ended
    assert held == ["one:a"] and common.worker_cache("one:a", list) == [1] and ended
    list(common.give_back(iter([])))
    assert common.worker_cache("one:a", list) == []


def test_a_task_of_the_representatives_takes_one_python_worker(spark):
    docs = spark.createDataFrame([(k, f"some words of text {k % 2}") for k in range(4)] + [(9, None), (None, " ")], "doc_id long, text string")
    found = parity_join.representatives(docs, width=5, num=80, den=100)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # a branch each: rows with shingles, rows without
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found.collect()) == [(False, 0), (False, 1), (False, 9), (True, 0)]
