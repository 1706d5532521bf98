"""Readers of a JSON corpus: lenient, strict, one date."""

import json

import pytest

from tessera.sources import tables

SCHEMA = "date string, digest struct<sites: array<struct<site: string>>>"


@pytest.fixture
def corpus(tmp_path):
    for i, doc in enumerate([{"date": "2024-01-02", "digest": {"sites": [{"site": "cns"}]}}, {"date": "2024-01-03", "digest": {"sites": []}}, {"date": "2024-01-01", "digest": {"sites": [{"site": None}]}, "more": 1}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=1))
    return tmp_path


def test_lenient_skips_what_does_not_parse(spark, corpus):
    (corpus / "bad.json").write_text('{"date": "2024-01-09", "digest"')
    (corpus / "none.json").write_text('{"digest": {"sites": []}}')
    rows = tables.lenient_corpus(spark, str(corpus), SCHEMA)
    assert [r.date for r in rows.collect()] == ["2024-01-03", "2024-01-02", "2024-01-01"]
    assert [r.date for r in tables.day(rows, "2024-01-02").collect()] == ["2024-01-02"] and tables.day(rows, "2025-01-01").count() == 0


@pytest.mark.parametrize("bad", ['{"date": "2024-01-09", "digest"', '{"digest": {"sites": []}}', '{"date": "2024-01-09", "digest": {}}', '{"date": "2024-01-09", "digest": {"sites": null}}'])
def test_strict_fails(spark, corpus, bad):
    assert [r.date for r in tables.strict_corpus(spark, str(corpus), SCHEMA).collect()] == ["2024-01-03", "2024-01-02", "2024-01-01"]
    (corpus / "bad.json").write_text(bad)
    with pytest.raises(Exception, match="(?s)MALFORMED|FAILED_READ|lacks"):
        tables.strict_corpus(spark, str(corpus), SCHEMA).collect()
