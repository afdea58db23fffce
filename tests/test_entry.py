"""The driver contract, with and without the optional subpackage."""

import importlib
import os
import re
import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["match_id", "left", "node", "right"] and df.count() > 0


def test_core_does_without_the_subpackage():
    code = "import sys; sys.modules['tokenloom.llm'] = None; import __spark_entry__ as e; assert 'CON1_kwic' in e.queries() and 'p5_found' not in e.queries(); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr


def test_nothing_outside_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "tokenloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"^\s*(from|import)\s+tokenloom\.llm", open(os.path.join(folder, f)).read(), re.M), f


def test_modules_import():
    for name in ("streaming.frequencies", "sources.xml", "operators.multivariate", "plans.nl_rules"):
        importlib.import_module(f"tokenloom.{name}")


def test_plans_need_no_nested_loops(spark, sf):
    """Contexts, sequences and collocations are planned as equi-joins."""
    for name in ("CON1_kwic", "JN1_sequence", "AGG12_collocations", "CON3_kwic_collocate", "p6_found"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, sf):
    from tokenloom.model import Corpus
    from tokenloom.plans.positions import matches
    from tokenloom.plans.terms import parse_query

    c = Corpus.load(spark, f"{sf}/corpus.parquet")
    plan = matches(c, parse_query("the"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_token_low,the)" in plan and "ReadSchema: struct<id:bigint,_token_low:string>" in plan
