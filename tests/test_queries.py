"""Registered queries against their SQL, on small tables with rows that the driver's small tables lack."""

import duckdb
import pytest

from check import rows_of
from reviewlake.queries import QUERIES, SQL


@pytest.fixture
def compare(spark, tmp_path):
    """Whether a query and its SQL give the same rows over the given documents, (doc_id, text, source) each."""
    def run(name, documents):
        df = spark.createDataFrame([(i, text, "en", source, len(text or "")) for i, text, source in documents],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
            cursor = con.execute(SQL[name])
            want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
        got = QUERIES[name](spark, str(tmp_path))
        assert rows_of(got.columns, got.collect()) == want
        return want[1]

    return run


def test_line_numbers_of_empty_and_missing_texts(compare):
    assert len(compare("g29_add_line_numbers", [(1, "", "a"), (2, None, "a"), (3, "x\ny", "a"), (4, "\n", "a")])) == 4


def test_stream_of_equal_copies_and_blank_files(compare):
    # 5 and 4295 have one path; 21 to 23 have an empty head, so that a blank text leaves a blank file.
    copies = [(5, "same", "s"), (4295, "same", "s"), (4295 + 4290, "other", "s"), (5 + 3 * 4290, "same", "t")]
    assert len(compare("i2_stream_documents", [*copies, (21, "", "s"), (34, None, "s"), (8, "one", "s")])) == 7
