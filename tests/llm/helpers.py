"""Small tables with everything odd in them, and comparison with DuckDB."""

import duckdb
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} the and of" for i in range(6000))
TEXTS = [
    None, "", "   \n\t ", "one", "two words", "the cat sat on the mat and the cat sat on the mat again", LONG, LONG,
    "line one is here and long enough to count\nline one is here and long enough to count\nother line",
    "%%% ### $$$ *** |||| <<<< >>>>", "ünïcödé wörds äre hére tœ stây ❤ 😀 fin", "A B C d\x0be\x0cf",
]
#: Names that operators use inside.
CLASHES = ("fp", "key", "size", "k", "n", "rank", "unit", "digest", "label", "score", "bucket", "range", "level", "target", "count", "taken", "run", "doc", "line", "term", "__id", "__hash", "__copy", "__taken", "__row", "b", "copy", "gram", "words", "fingerprint")


def odd_documents(spark, texts=TEXTS):
    """Nulls in every column, ties, repeated rows, and columns of clashing names."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None if i % 5 else 3) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id", None, None, None), rows[5], rows[5], rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASHES})


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def duck(sql, **tables):
    """Rows of DuckDB SQL over DataFrames, its columns in order of name."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_t", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_t")
    got = con.execute(sql).df()
    got = got[sorted(got.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted((tuple(plain(v) for v in r) for r in got.itertuples(index=False)), key=str)


def plain(v):
    return None if v is None else bool(v) if str(type(v)).find("bool") >= 0 else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v


def named(df):
    """Rows of a DataFrame as ``duck`` gives them."""
    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
