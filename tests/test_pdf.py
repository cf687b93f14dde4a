"""A PDF beyond the page limit is an error, not a prefix. The reader is a stand-in whose content is the number of pages."""

from __future__ import annotations

import pytest

from tessera.sources import records

READER = """
class Page:
    def extract_text(self):
        return "text"

class PdfReader:
    def __init__(self, stream):
        self.pages = [Page()] * int(stream.read())
"""


def test_pages_are_all_or_an_error(spark, tmp_path):
    (tmp_path / "pypdf.py").write_text(READER)
    spark.sparkContext.addPyFile(str(tmp_path / "pypdf.py"))
    table = lambda n: spark.createDataFrame([("a", str(n).encode())], "path string, content binary")
    assert records.pdf_pages(table(2500)).count() == 2500
    with pytest.raises(Exception, match="3001 pages"):
        records.pdf_pages(table(3001)).collect()
