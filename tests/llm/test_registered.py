"""Registered queries against their DuckDB text, and the shape of what the others return."""

import pytest
from parity import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from palisade.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


class Named:
    def __init__(self, name):
        self.name, self.sql = name, ORACLES[name]

    def __call__(self, spark, sf_dir):
        return QUERIES[self.name](spark, sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    assert compare(Named(name), spark, duck, SF_DIR) is None


def test_every_operator_is_registered():
    ours = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in ours) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shard"]


@pytest.mark.parametrize("name", ["op3_scan_licenses", "op7_decontaminate"])
def test_native_plans_hold_no_python(spark, name):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES[name](spark, SF_DIR).explain("formatted")
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
    assert "CartesianProduct" not in out.getvalue() and "NestedLoop" not in out.getvalue()
