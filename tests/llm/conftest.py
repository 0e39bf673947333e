import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from helpers import CLASHES  # noqa: E402


@pytest.fixture(scope="session")
def bpe_file():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text) rows with further columns whose names the operators use inside."""
    def make(rows):
        types = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
        return spark.createDataFrame([(*r, *CLASHES) for r in rows], types)
    return make
