"""The pipeline against plain versions of its stages on a small table."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from scoreloom.llm import line_quality, mixing, token_pack
from scoreloom.llm.tables import load
from tests.llm.test_decontaminate import brute as passages
from tests.llm.util import SF, classes


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = load(spark, SF, "documents"), [load(spark, SF, "documents").collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        out.append(rows.collect())
        docs = spark.createDataFrame(out[-1], rows.schema)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    assert all(r[0].__fields__ == stages[0][0].__fields__ for r in stages[1:-1])


def test_quality(spark, stages):
    docs = load(spark, SF, "documents")
    score = line_quality.score(docs, line_quality.train(docs, load(spark, SF, "labels"))).collect()
    good = {r.doc_id for r in score if r.predicted}
    assert sorted(stages[1]) == sorted(r for r in stages[0] if r.doc_id in good)
    labels = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    unseen = [r for r in score if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in unseen]) > 0.9


def test_near_duplicates(stages):
    first = {i for i, (c, _) in classes([(r.doc_id, r.text) for r in stages[1]]).items() if c == i}
    assert sorted(stages[2]) == sorted(r for r in stages[1] if r.doc_id in first)
    assert len(stages[2]) < len(stages[1])


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    bad = {d for d, _ in passages([(r.doc_id, r.text) for r in stages[2]], items)}
    assert bad and sorted(stages[3]) == sorted(r for r in stages[2] if r.doc_id not in bad)


def test_mixture(spark, stages):
    times = {r.doc_id: r.times for r in mixing.mix_counts(spark.createDataFrame(stages[3], load(spark, SF, "documents").schema)).collect()}
    assert sorted(stages[4]) == sorted(r for r in stages[3] for _ in range(times[r.doc_id]))


def test_token_ids(stages):
    tokenizer, want = Tokenizer.from_file(token_pack.default_tokenizer()), []
    at = 0
    for r in sorted(stages[4], key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, stages[5])) == sorted(want)


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5]))


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
