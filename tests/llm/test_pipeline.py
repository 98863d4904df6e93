"""The pipeline's stages on a small corpus, and that a lost subpackage leaves the rest whole."""

from __future__ import annotations

import subprocess
import sys

import pytest

from test_operators import prose

pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    import corpus_pipeline

    data = [(k, prose(k, 80), "en", "s", 1) for k in range(30)]
    data += [(40, data[0][1], "en", "s", 1), (41, "too short", "en", "s", 1), (42, prose(77, 60) + " token = abcdefGHIJK12345", "en", "s", 1), (43, None, None, None, None)]
    flat = " ".join(data[1][1].split())  # one line: no chunk of lines to cut
    data += [(44, flat, "en", "s", 1), (45, flat + " again", "en", "s", 1)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = lambda n: {r.doc_id for r in seen[n].collect()}
    assert 41 not in ids("quality_rules") and 43 not in ids("quality_rules") and 0 in ids("quality_rules")
    assert ids("line_chunks") == ids("quality_rules")
    assert {1, 44, 45} <= ids("line_chunks") and {1, 44, 45} & ids("near_duplicates") == {1}
    texts = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert "[secret]" in texts[42] and "abcdefGHIJK" not in texts[42]
    pieces = seen["packed"].collect()
    assert {p.doc_id for p in pieces} == set(texts)
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, pieces))


def test_rest_works_without_the_subpackage(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('linkweave.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
