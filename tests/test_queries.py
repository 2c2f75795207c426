"""Every registered query against its SQL at the smallest scale; a sample by default, all with ALL_QUERIES=1."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAMPLE = ["b02", "c04", "c14", "d01", "d16", "d19", "e01", "e04", "f02", "g14", "h02", "j26", "k13", "a06"]


def test_queries_match_their_sql():
    prefixes = [] if os.environ.get("ALL_QUERIES") else SAMPLE
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "check.py"), "0.001", *prefixes], capture_output=True, text=True, cwd=ROOT).stdout
    lines = [x.split("\r")[-1] for x in out.splitlines()]
    assert any(x.endswith("bad: 0") for x in lines), "\n".join(x for x in lines if "DIFF" in x or "FAIL" in x or "SQL " in x)
    assert not [x for x in lines if x.rstrip().endswith("EMPTY")]


def test_each_query_has_sql():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    own = {x for x in e.queries() if x != "pipeline" and not re.match(r"op\d", x)}
    assert not own - set(e.oracle_sql())
