"""Lines put together: every line keeps its own characters, whatever its number, and blanks go as in SQL."""

import pytest

from compare import compare
from spanwright import registry

TEXTS = [
    "0997 a line\n1219 another one\n2\n the third ends in 3\n4 fourth 4\n 5555 fifth 55 ",
    "Ends.\r\nlower case behind a return\n12\r\n  7  \n　wide blanks \n\n\n\n- item",
    "\x0b kept \x0b\nsoft-\n wrapped",
    " \n \n",
    "",
    None,
]


@pytest.mark.parametrize("name", ["d7_clean_blocks", "d9_display_reflow"])
def test_lines_match_sql(spark, tmp_path, name):
    rows = [(i, text, "en", "x", len(text or "")) for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert not compare_documents(spark, tmp_path, name)


def compare_documents(spark, folder, name):
    """``compare`` over a folder that has the documents only: the other tables are those of the smallest scale."""
    for table in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (folder / f"{table}.parquet").symlink_to(f"/root/testdata/sf0.001/{table}.parquet")
    return compare(spark, str(folder), registry.QUERIES[name], registry.ORACLES[name])
