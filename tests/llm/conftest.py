import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, empty and long texts, repeats, and columns named like the operators' own."""
    body = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, body), (5, body), (6, body + " end"), (None, "no id here"), (7, "x" * 60_000),
        (8, "ab " * 30_000), (9, "é😀" * 300), (10, "mail a.b@example.org or +1 (499) 555-6503"), (11, "ONE"), (12, "!!! ### 123"),
    ]
    extra = [(d, t, "en", "s", 0, 0.5, True, "k", [1], 7) for d, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score double, whole boolean, tid string, runs array<int>, row long")
