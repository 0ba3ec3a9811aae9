import os
import tempfile

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
ODD_TEXTS = [
    None, "", " ", "\n\n", "one two three", "the cat sat on the mat " * 12, "the cat sat on the mat " * 12, "x" * 40_000, "wörter sind ünd schön é " * 3_000, "a@b.co or +1 (743) 555-3824 or 10.0.0.1 or 4242 4242 4242 4242",
]


@pytest.fixture(scope="session")
def shared(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp())
    return spark


@pytest.fixture
def odd(shared):
    """Nulls, empty and long texts, copies, a repeated row, and columns whose names operators use."""
    rows = [(k, t, "en" if k % 2 else None, "s", 0, 1, "b", 2) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "the cat sat on the mat " * 12, None, None, None, None, None, None)]
    return shared.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, part string, rank int")


@pytest.fixture
def none(odd):
    return odd.limit(0)
