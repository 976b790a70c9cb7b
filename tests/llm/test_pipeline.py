from __future__ import annotations

import os
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from gleanspark.llm import queries
from tests.llm.test_search import bag, brute_components, brute_items

pytestmark = pytest.mark.skipif(not os.path.exists(queries.PIECES_FILE), reason="no tokenizer file")


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "sentencepiece"]


def test_same_as_brute_force(spark, tables, small):
    import sentencepiece

    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = defaultdict(list)
    for d, t in rows:
        first[t].append(d)
    rows = [(d, t) for d, t in rows if d == min(first[t])]
    comp = {d: c for d, _, c in brute_components(rows)}
    rows = [(d, t) for d, t in rows if comp[d] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    shared = {s for _, x in items for s in bag(x)}
    dirty = {d for d, _ in brute_items([r for r in rows if shared & set(bag(r[1]))], items)}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES_FILE)
    expected = {d: library.encode(t) for d, t in rows if d not in dirty}
    got = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id: r.ids for r in got} == expected and len(got) == len(expected) and all(r.same_text and r.n_pieces == len(r.ids) for r in got)


def test_stages_keep_columns(spark, edge, tables, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, tables)
        assert out.columns == edge.columns, name
        assert stage(spark, empty, tables).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    rows, texts = last(spark, edge, tables).collect(), [r.text or "" for r in edge.select("text").collect()]
    assert len(rows) == len(texts) and all(r.same_text and r.n_pieces == len(r.ids) for r in rows)
    assert sum(r.n_pieces == 0 for r in rows) == sum(not t for t in texts)
    assert last(spark, empty, tables).count() == 0 and last(spark, empty, tables).columns == ["doc_id", "n_pieces", "ids", "same_text"]
