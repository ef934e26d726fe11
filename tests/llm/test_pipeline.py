"""The stages of the pipeline, one after the other, against plain versions."""

import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pandekt.llm.common import cut
from pandekt.llm.tokens import default_path
from tests.llm import brute
from tests.llm.test_edges import plain_lines

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cut(stage(spark, out[-1], SF_DIR), f"test-{name}"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stage_columns(outputs):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    assert all(set(o.columns) == set(outputs[0].columns) for o in outputs[:-1])


def test_toxic_documents_go_and_others_stay_as_they_are(spark, outputs):
    before, after = dict(pairs(outputs[0])), dict(pairs(outputs[1]))
    assert all(before[i] == t for i, t in after.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    known = [i for i in labels if i in before]
    clean = [i for i in known if labels[i] == 0]
    assert np.mean([i in after for i in clean]) >= 0.9


def test_lines(outputs):
    want = plain_lines(pairs(outputs[1]))
    rows = outputs[2].collect()
    assert {r.doc_id: r.text for r in rows} == {i: t for i, (t, _, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_one_of_each_group_stays(outputs):
    want = brute.ngram_components(pairs(outputs[2]), 5, 80)
    assert sorted(i for i, _ in pairs(outputs[3])) == sorted(i for i, (_, c, _) in want.items() if i == c)


def test_mixing_keeps_every_document(outputs):
    before, after = dict(pairs(outputs[3])), pairs(outputs[4])
    uses = {}
    for i, t in after:
        assert before[i] == t
        uses[i] = uses.get(i, 0) + 1
    assert set(uses) == set(before) and max(uses.values()) <= 2


def test_packing_holds_every_token(outputs):
    whole = Tokenizer.from_file(default_path())
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in pairs(outputs[4])}
    got = outputs[5].toPandas()
    assert got.length.sum() == sum(len(ids[i]) for i, _ in pairs(outputs[4]))
    assert all(zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in got.itertuples())
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_near_copies_with_repeated_and_null_ids(spark):
    """Rows are judged one by one: a copy goes, a row that only shares its id stays."""
    t, u = " ".join(f"alpha{i}" for i in range(30)), " ".join(f"beta{i}" for i in range(30))
    rows = [(0, t), (1, t), (1, u), (2, u), (2, u), (None, u), (None, ""), (None, None), (3, "x")]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = cp.drop_near_copies(spark, docs, SF_DIR)
    assert got.columns == cp.COLUMNS
    assert sorted(pairs(got), key=repr) == sorted([(0, t), (None, u), (None, ""), (None, None), (3, "x")], key=repr)
    assert cp.drop_near_copies(spark, docs.limit(0), SF_DIR).count() == 0
