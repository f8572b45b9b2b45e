import duckdb
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " \
          "id string, size int, fp int, mark int, bin int, length int, label string, part int, kept string"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows; the last columns clash with
    names that operators use."""
    line = "Eine Zeile die sich in vielen Texten findet und lang genug ist um gefunden zu werden, ja wirklich. "
    texts = [None, "", " \t\n", "a", "the of and thing " * 30, "the of and thing " * 30, line * 4, "x" + line * 4,
             "wort " * 40_000, "日本語のテキスト。" * 50, "É" * 500, "12 34 56 #### %%%%", line * 4]
    clash = ("i", 1, 2, 3, 4, 5, "l", 6, "k")
    rows = [(n, t, None if n % 4 == 0 else "de", f"s{n % 3}" if n % 5 else None, len(t or "")) + clash
            for n, t in enumerate(texts)]
    rows.append(rows[6])                                  # a row given twice
    rows.append((6, "another text under an id in use", "en", "s1", 3) + clash)
    rows.append((None, "a row without an id, and nothing else", None, None, None) + (None,) * 9)
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"select * from '{SF}/documents.parquet' order by doc_id").fetchdf()


def utf8(text):
    return (text or "").encode()
