import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers_llm import DOCS, prose  # noqa: E402


@pytest.fixture(scope="session")
def edge_rows():
    """NULLs, empty, blank, one-word, very long, repeated and non-ASCII texts."""
    text = "\n".join(prose(k, 30) for k in range(4))
    long = "\n".join(prose(100 + k, 40) for k in range(1500))
    return [(None, text), (None, None), (1, None), (2, ""), (3, " \n\t \n"), (4, "One"), (5, text), (5, text), (6, "ÀÉ ñandú ß Ünder"),
            (7, long), (8, prose(9, 60)), (9, prose(9, 60) + " end"), (2**62, prose(10, 5)), (-3, "a b c d")]


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
