"""Repeated passages of 51 words, however they lie in sentences."""

from __future__ import annotations

import random

from linkweave.llm import sentence_spans


def test_passages_of_51_words_go(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=6))
    data, passages = [], []
    for k in range(60):
        passage = [word() for _ in range(51)]  # no commas; some with one stop somewhere
        if k % 2:
            passage[rng.randrange(51)] += "."
        passages.append(" ".join(passage))
        for side in range(2):
            before, after = ([word() for _ in range(rng.randrange(30))] for _ in range(2))
            data.append((2 * k + side, " ".join(before + passage + after)))
    got = {r.doc_id: r.text for r in sentence_spans.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for k, passage in enumerate(passages):
        assert passage in got[2 * k]
        assert passage not in got[2 * k + 1]


def test_pieces_join_to_the_text_and_are_short():
    rng = random.Random(6)
    for _ in range(200):
        t = "".join(rng.choice(["a", "the", "word", "x1", ". ", " ", "  ", "\n", ", ", "。"]) + rng.choice([" ", ""]) for _ in range(rng.randrange(120)))
        pieces = sentence_spans.sentences(t)
        assert "".join(pieces) == t
        assert all(len(p.split()) <= sentence_spans.WINDOW for p in pieces)


def test_texts_with_nothing_to_remove_are_cut_once(spark, monkeypatch):
    """Their pieces were counted when runs were taken: removal cuts only texts that lose some."""
    cut = sentence_spans.sentences
    passage = " ".join(f"word{k}" for k in range(60))
    data = [(0, "alone. " + " ".join(f"other{k}" for k in range(60))), (1, "first. " + passage), (2, "again. " + passage), (3, ""), (4, None)]
    pieces = {i: len(cut(t or "")) for i, t in data}

    def only_third(text):
        assert text.startswith("again.")
        return cut(text)

    only_third.__module__ = "__main__"  # by value, to the workers
    monkeypatch.setattr(sentence_spans, "sentences", only_third)
    got = {r.doc_id: r for r in sentence_spans.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {i: r.n_sentences for i, r in got.items()} == pieces
    assert got[0].text == data[0][1] and got[2].n_removed > 0 and got[3].text == "" and got[4].text is None
