"""The index of literals gives the findings of the rule-by-rule tier."""

import pytest
from pyspark.sql import functions as F

from auditweave.functions.codeview import code_view
from auditweave.functions.rules import RULES, SUPERSEDED
from auditweave.operators.findings import deduplicated
from auditweave.operators.patterns import Rule, pattern_findings
from auditweave.operators.ruleindex import Index, indexed_findings
from auditweave.plans.rulecases import CASES, DOCKER


def files(spark):
    rows = []
    for i, (_, ext, match, miss) in enumerate(CASES):
        for k, text in (("match", match), ("miss", miss), ("tests/match", match)):
            rows.append((f"src/{k}{i}/Dockerfile", "", f"a = 1\n{text}\n", k) if ext == DOCKER else (f"src/{k}{i}{ext}", ext, f"a = 1\n{text}\nb\n{text}", k))
    rows += [("src/x.py", ".py", None, "null"), ("src/y.py", ".py", "", "empty"), ("src/z", None, "eval(x)", "no ext"), (None, ".py", "eval(x)", "no name")]
    df = spark.createDataFrame(rows, "file string, ext string, text string, kind string")
    return df.withColumn("code_view", code_view(F.col("text"), F.col("ext")))


def test_every_rule_has_its_match_and_none_a_near_miss(spark):
    found = deduplicated(indexed_findings(files(spark), RULES, ["kind"]), SUPERSEDED, ["rule_ord", "start"]).filter("line <= 2").collect()
    got = {(r.detector_id, r.file) for r in found if r.kind in ("match", "miss")}
    assert got == {(r, f"src/match{i}/Dockerfile" if e == DOCKER else f"src/match{i}{e}") for i, (r, e, *_) in enumerate(CASES)}
    assert {c[0] for c in CASES} == {r.id for r in RULES}


@pytest.mark.parametrize("rules", [RULES[::6], RULES[1::12], (Rule("X", "x", "CWE-1", "Low", "[a-z]", (".py",), once_per_file=True), Rule("Y", "y", "CWE-1", "Low", r"\\d", (".js", "Dockerfile"), suppress_line_if="md5"))])
def test_equal_to_the_rule_by_rule_tier(spark, rules):
    df = files(spark)
    same = lambda f: sorted(map(str, f(df, rules, ["kind"]).collect()))
    one = same(indexed_findings)
    assert one == same(pattern_findings) and one


def test_candidates_are_few():
    index = Index(RULES)
    assert len(index.candidates("requests.get(u, verify=False)\n", ".py", False)) < 12
    assert index.candidates("requests.get(u, verify=False)\n", ".xyz", False) == []
