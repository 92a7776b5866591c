"""Inputs that every text operator must take, and small ways to read results."""

from __future__ import annotations

# Column names that operators use inside.
CLASHES = "key mark fp n position curve base spans rank score component label at row tokens id size class".split()

LONG = "one more word " * 40_000 + "end"
TEXTS = {
    1: "The quick brown fox jumps over the lazy dog by the river bank today.\nA second line, with more words.",
    2: None,
    3: "",
    4: "The quick brown fox jumps over the lazy dog by the river bank today.\nA second line, with more words.",
    5: " \t\n \x0b\f\r ",
    6: "Ünïcödé — 漢字かな交じり文 🙂🙂 e\u0301 ﬁ \u00a0\u2028 end",
    7: LONG,
    8: "x" * 30_000,
    9: "!",
    10: "mail a.b+c@x-y.example.com. or 10.0.0.255, 4111 1111 1111 1111 and +1 (555) 555-0100; all rights reserved",
}


def documents(spark, texts=None, repeat=(1,)):
    """documents with clashing extra columns; the ids in ``repeat`` have their row twice."""
    texts = TEXTS if texts is None else texts
    rows = [(i, t) for i, t in texts.items()] + [(i, texts[i]) for i in repeat if i in texts]
    rows = [(i, t, "en", "src", len(t or "")) + tuple("x" for _ in CLASHES) for i, t in rows]
    clashes = ", ".join(f"`{name}` string" for name in CLASHES)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {clashes}"
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return documents(spark, {}, ())


def by(df, key="doc_id"):
    """Rows by key; rows of one key must be equal."""
    found = {}
    for row in df.collect():
        assert found.setdefault(row[key], row) == row
    return found
