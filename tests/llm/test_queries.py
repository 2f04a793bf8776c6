"""The corpus queries with an oracle against DuckDB; the others are called on whole small tables."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from tests.test_oracles import SF, _key, duck  # noqa: F401
from waymark.llm import queries as corpus


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):  # noqa: F811
    frame = corpus.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(_key(r[c]) for c in columns) for r in frame.collect())
    found = duck.sql(corpus.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(_key(r[i]) for i in at) for r in found.fetchall())


def test_pipeline_keeps_what_each_stage_should(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    held = collections.defaultdict(list)
    for r in pieces:
        held[r.shard, r.bin].append(r)
    for rows in held.values():
        assert sum(r.n_tokens for r in rows) <= corpus_pipeline.packing.CAPACITY
        sources = [docs[r.doc_id].source for r in rows if docs[r.doc_id].source is not None]
        assert len(sources) == len(set(sources))
    words = {i: len(d.text.split()) for i, d in docs.items() if d.text}
    taken = collections.Counter()
    for r in pieces:
        taken[r.doc_id] += r.n_tokens
    # Whole copies, at most two of each.
    assert all(n in (words[i], 2 * words[i]) for i, n in taken.items())
    assert len({r.doc_id for r in pieces}) >= 0.3 * len(docs)
