import duckdb  # noqa: F401
import numpy as np
import pyarrow.dataset as ds

import corpus_pipeline as P
from tests.llm import brute
from tests.llm.test_operators import EDGE, _check_packing
from vantage.llm import packing, toxicity
from vantage.llm.store import materialise

SF = "/root/testdata/sf0.001"


def _brute(docs, items, model):
    """Every stage by hand: rows (doc_id, text) in, ids of the packed documents out."""
    rows = [(i, t) for i, t in docs if model.scores([t or ""])[0][0] < 0.5]
    rows = [(i, t if not n else kept) for (i, t), (_, _, n, kept) in zip(rows, brute.dedup_lines(rows), strict=True)]
    best = {i: c for i, _, c in brute.jaccard_classes(rows)}
    rows = [(i, t) for i, t in rows if best[i] == i]
    leaked = {d for d, _, _ in brute.contaminated(rows, items)}
    return [(i, t) for i, t in rows if i not in leaked]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw = [(r["doc_id"], r["text"]) for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()]
    items = [(r["item_id"], r["text"]) for r in ds.dataset(f"{SF}/benchmark.parquet").to_table().to_pylist()]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = _brute(raw, items, model)
    out = docs
    for name, stage in P.STAGES[:-1]:
        out = materialise(stage(spark, out, SF))
        assert out.columns == docs.columns, name
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == dict(want) and 0 < len(got) < len(raw)
    kept = {r["doc_id"]: r for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()}
    assert all((r.lang, r.source) == (kept[i]["lang"], kept[i]["source"]) for i, r in got.items())
    import public_tokenizers

    tok = packing.WordCache(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    ids = {i: np.append(np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4"), np.array([2], "<u4")) for i, t in want}
    _check_packing(P.run(spark, SF).collect(), ids)


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, keys string, component_id long, n long"
    rows = [(i, t, None, "s", None, 7, "k", 3, 4) for i, t in EDGE if not t or len(t) < 5000] + [(None, "some text", None, None, 9, 1, None, None, None)]
    for data in (rows, []):
        out = spark.createDataFrame(data, schema)
        names = out.columns
        for _, stage in P.STAGES[:-1]:
            out = materialise(stage(spark, out, SF))
            assert out.columns == names
        assert out.count() <= len(data) and out.where("n_lines = 7 and keys = 'k'").count() >= min(10, len(data))
        assert P.STAGES[-1][1](spark, out, SF).select("doc_id").distinct().count() == out.select("doc_id").distinct().count()
