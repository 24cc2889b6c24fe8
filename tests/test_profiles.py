"""Profiles: inheritance, fragments, checklists, comparison."""

import json

import pytest

from folioscope.operators import profiles


def test_resolve(spark, tmp_path):
    parts = {
        "base": {"profile": "base", "checklist": [{"area": "core", "items": ["reset line is handled"]}], "caution_topics": ["a", "b"], "level": 1},
        "child": {"profile": "child", "extends": "base", "fragments": ["irq"], "checklist": [{"area": "own", "items": ["clock is enabled", "other thing"]}], "caution_topics": ["b", "c"], "level": 2},
    }
    for n, p in parts.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(p))
    found = profiles.read(spark, str(tmp_path))
    got = profiles.resolve("child", found, {"irq": {"fragment": "irq", "checklist": [{"area": "irq", "items": ["interrupt is cleared"]}], "caution_topics": [" d "]}})
    assert [c["area"] for c in got["checklist"]] == ["core", "irq", "own"]
    assert got["caution_topics"] == ["a", "b", "d", "c"] and got["level"] == 2 and got["stack"] == ["base", "child"]
    items = profiles.checklist(spark, got)
    assert [r.req_id for r in items.collect()] == ["A1.1", "A2.1", "A3.1", "A3.2"]
    evidence = spark.createDataFrame([(1, "the reset line handled in probe"), (2, "clock enabled early")], "ev_id long, text string")
    gaps = spark.createDataFrame([(1, "interrupt never cleared")], "ev_id long, text string")
    out = {r.req_id: r.status for r in profiles.compare(items, evidence, gaps).collect()}
    assert out == {"A1.1": "implemented_candidate", "A2.1": "missing", "A3.1": "implemented_candidate", "A3.2": "missing_or_not_reported"}
    assert {r.area: r.percent for r in profiles.completeness(profiles.compare(items, evidence, gaps)).collect()} == {"core": 100, "irq": 0, "own": 50}


def test_errors():
    with pytest.raises(ValueError, match="extend each other"):
        profiles.resolve("a", {"a": {"extends": "b"}, "b": {"extends": "a"}}, {})
    with pytest.raises(ValueError, match="no such profile"):
        profiles.resolve("a", {}, {})
    with pytest.raises(ValueError, match="no such fragment"):
        profiles.resolve("a", {"a": {"fragments": ["x"]}}, {})
