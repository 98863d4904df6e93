"""Quality of texts in groups too small for an estimate of their own."""

from __future__ import annotations

from test_operators import prose

from linkweave.llm import quality


def test_texts_of_small_groups_are_judged(spark):
    data = [(k, prose(k, 60 + k % 90), "en", f"s{k % 30}") for k in range(300)]  # ten a source
    data += [(500 + k, prose(500 + k, 60 + k % 90), f"l{k}", None) for k in range(10)]  # languages of one text
    junk = [(1000 + k, " ".join(w.upper() + "!!" if k % 2 else w + "$$$" for w in prose(k, 120).split()), "en" if k < 10 else "l0", f"s{k}") for k in range(15)]
    df = spark.createDataFrame(data + junk, "doc_id long, text string, lang string, source string")
    rows = quality.quality(df).where("NOT base_failed").collect()
    assert all(r.distance is not None for r in rows)
    assert not any(r.doc_id >= 1000 and r.kept for r in rows)
    clean = [r for r in rows if r.doc_id < 1000]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
