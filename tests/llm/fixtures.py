"""Small documents with every awkward case, and plain versions of texts."""

import duckdb

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, " \
        "copies int, target double, token_ids string, n_tokens int, block int, id int, key int, _t_row int, _t_doc string"


def awkward_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated
    rows, clashing column names."""
    long_text = " ".join(f"word{i % 977} and{i}" for i in range(40000))
    texts = [
        (1, "Some plain words about a river and a hill that nobody has seen before today."),
        (2, "Some  plain words about\ta river and a hill\nthat nobody has seen before today."),
        (3, "some PLAIN words about a river and a hill that nobody has seen before today."),
        (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (7, "one"), (8, "two words"),
        (9, long_text), (10, long_text + " end"), (11, "é😀 日本語 mixed text   with\x85 odd spaces"),
        (12, "a" * 5000), (13, "ab " * 300), (14, "line one here\nline one here\nline one here\n"),
        (15, "nul \x00 byte and <|endoftext|> mark"), (None, "a null id"), (None, "a null id"), (16, "twice"), (16, "twice"), (16, "not the same"),
        (-5, "negative id"), (17, "+1 (212) 555-0100 mail a.b@c-d.org card 4111 1111 1111 1111 host 10.0.0.255 v1.2.3.4"),
    ]
    rows = []
    for i, (d, t) in enumerate(texts):
        lang, source = (None if i % 5 == 0 else "en", None if i % 7 == 3 else f"s{i % 3}")
        rows.append((d, t, lang, source, None if i % 4 == 0 else len(t or ""), 1, True, 0.5, 2, 1.5, "x", 3, 4, 5, 6, 7, "y"))
    rows[18] = rows[17]  # a row repeated in every column
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)


def table(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").df()


def texts(sf=SF):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
