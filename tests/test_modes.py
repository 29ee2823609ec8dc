import pytest

from graphloom import modes


def test_modes(spark, sf_dir):
    scan = modes.scan(spark, sf_dir, 72.5, 5).collect()
    assert [r["rank"] for r in scan] == [1, 2, 3, 4, 5] and all(r.score >= 72.5 for r in scan)
    assert modes.query(spark, sf_dir, "supplier#000000000", 20, 3).count() == 3
    edge = modes.edge(spark, sf_dir, "Supplier#000000000", "Supplier#000000001").first()
    assert edge["direction"] == "none" and 0 <= edge["probability"] <= 1
    sections = {r["section"] for r in modes.report(spark, sf_dir, "Supplier#000000002", depth=2, top_k=3).collect()}
    assert sections == {"query", "scan", "forecast"}


def test_unresolved_text_is_an_error(spark, sf_dir):
    with pytest.raises(LookupError):
        modes.forecast(spark, sf_dir, "no such supplier")
