import pytest

import __spark_entry__
import corpus_pipeline
from gleanery.llm import classifier, queries
from gleanery.llm.common import table
from gleanery.session import stored
from tests import compare
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, duck, name):
    assert compare.compare(spark, duck, sf, queries.QUERIES[name], queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_gives_every_document(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() == table(spark, sf, "documents").count()


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        result = stored(stage(spark, docs, sf), name)
        if name != "byte_bpe":
            assert result.columns == columns
        ids = sorted(r.doc_id for r in result.select("doc_id").collect())
        kept[name] = ids
        if name == "quality_classifier":
            judged = classifier.score(docs, classifier.fit(docs)).filter("kept").collect()
            assert ids == sorted(r.doc_id for r in judged)
        elif name == "exact_dedup":
            assert ids == sorted(i for i, (keep, _, _) in brute.exact(before).items() if i == keep)
        elif name == "near_dedup":
            assert ids == sorted(i for i, (_, c) in brute.near(before, 5).items() if i == c)
        elif name == "mixing":
            sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
            assert ids == brute.repeated(sources)
        else:
            assert ids == sorted(i for i, _ in before)
            assert result.filter("NOT exact").isEmpty()
        docs = result
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == kept["byte_bpe"]
