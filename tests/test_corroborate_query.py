import os
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from auditweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def brute_force(lines):
    """Takes the closest pair that is left, again and again, in each (file, cwe)."""
    groups = defaultdict(list)
    for r in lines:
        taint = r["l_partkey"] % 2 == 0
        groups[str(r["l_orderkey"]), r["l_returnflag"]].append([r["l_linenumber"], r["l_partkey"], taint, "high" if float(r["l_tax"]) > 0.04 else "medium", str(r["l_suppkey"]) if taint else ""])
    out = []
    for (file, cwe), g in groups.items():
        g.sort(key=lambda r: r[:2])
        patterns, taints = [r for r in g if not r[2]], [r for r in g if r[2]]
        free = list(patterns)
        while near := [(abs(p[0] - t[0]), i, j) for i, p in enumerate(free) for j, t in enumerate(taints) if abs(p[0] - t[0]) <= 3]:
            _, i, j = min(near)
            p, t = free.pop(i), taints.pop(j)
            p[4] = t[4]
            p[3] = "high" if t[3] == "high" else p[3]
        out += [(file, cwe, line, "taint" if taint else "builtin", confidence, path, seq) for line, seq, taint, confidence, path in patterns + taints]
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_all_of_lineitem_is_corroborated(spark):
    lines = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_tax"]).to_pylist()
    got = [(r.file, r.cwe, r.line, r.source, r.confidence, r.taint_path, r.seq) for r in QUERIES["q08_corroborate_nearest"](spark, SF).collect()]
    assert {int(r[0]) for r in got} == {r["l_orderkey"] for r in lines}
    assert Counter(got) == Counter(brute_force(lines))
