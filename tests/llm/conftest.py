import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from plain import DOCS  # noqa: E402


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, repeats, ties, and ids that are null or met twice."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in the wood "
    rows = [(i, f"{base * 3}number {i}\nshared line here\n{'x' * i}", "en", f"s{i % 3}", 0) for i in range(14)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "  \t\n\n", "fr", None, 3), (103, "É" * 40 + " Ünï \x0b x", "fr", "s1", 2),
             (104, base * 400, "en", "s2", 1), (105, base * 3, "en", "s0", 1), (106, base * 3, "en", "s0", 1), (106, base * 3, "en", "s0", 1),
             (106, "another text under the same id that nothing else holds at all, not one bit", "en", "s0", 1), (None, base, None, "s0", 1), (107, "one two", "en", "s1", 7),
             (108, "one two", "xx", "s1", 7), (109, "▁ literal mark", "en", "s1", 7), (110, "a\r\nb", "en", "s1", 7)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
