import hashlib
import re

import pytest
from helpers import TEXTS, by, documents, empty
from pyspark.sql import functions as F

from tablescope.llm import merkle


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_tree(text):
    lines = [
        [md5(p) for p in re.findall(r"[^ ]*(?: [^ ]*){0,7}", line) if p] for line in (text or "").split("\n")
    ]
    paragraphs = [md5("".join(own)) for own in lines]
    sections = [md5("".join(paragraphs[i : i + 8])) for i in range(0, len(paragraphs), 8)]
    root = hashlib.sha256("".join(sections).encode()).hexdigest()
    leaves = [leaf for own in lines for leaf in own]
    return ":".join([root, "".join(s[:8] for s in sections), "".join(x[:8] for x in leaves)])


def plain_likeness(one, other):
    a, b = one.split(":"), other.split(":")
    if a[0] == b[0]:
        return 1.0
    x, y = (set(re.findall(".{8}", side[2])) for side in (a, b))
    return len(x & y) / (max(len(x), len(y)) + 1)


def plain_edits(texts):
    """The contract, for rows with different ids."""
    order = sorted(texts, reverse=True)
    out = {}
    for place, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(place + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        trees = [plain_tree(t) for t in (own, edited, after)]
        out[i] = (
            len(own), hashlib.sha256(edited.encode()).hexdigest(), trees[0], trees[1],
            pytest.approx(plain_likeness(trees[0], trees[1])), pytest.approx(plain_likeness(trees[0], trees[2])),
        )
    return out


def edits(spark, texts, repeat=()):
    rows = by(merkle.half_replaced(documents(spark, texts, repeat), "doc_id", "text"))
    names = "n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    return {i: tuple(r[n] for n in names) for i, r in rows.items()}


def test_texts_of_all_kinds(spark):
    assert edits(spark, TEXTS) == plain_edits(TEXTS)


def test_many_documents(spark):
    texts = {i * 7 % 101: f"line {i}\n" * (i % 9) + "word " * (i % 40) + "é🙂" * (i % 5) for i in range(101)}
    assert edits(spark, texts) == plain_edits(texts)


def test_one_document_follows_itself(spark):
    assert edits(spark, {5: "some words"}) == plain_edits({5: "some words"})
    assert merkle.half_replaced(empty(spark), "doc_id", "text").count() == 0


def test_repeated_rows_stand_in_one_place(spark):
    texts = {1: "one two three", 2: "four five six", 3: None}
    df = documents(spark, texts, (1, 2, 3))
    assert merkle.half_replaced(df, "doc_id", "text").count() == 6
    assert edits(spark, texts, (1, 2, 3)) == plain_edits(texts)


def test_null_keys_come_last(spark):
    rows = {r.doc_id: r for r in merkle.half_replaced(documents(spark, {None: "abcd", 1: "efgh"}, ()), "doc_id", "text").collect()}
    assert rows[1].edited_sha256 == hashlib.sha256(b"efab").hexdigest()
    assert rows[None].edited_sha256 == hashlib.sha256(b"abef").hexdigest()


def test_rows_with_equal_keys_and_other_texts_all_have_a_result(spark):
    df = spark.createDataFrame([(1, "abcd"), (1, "efgh"), (2, "ijkl")], "doc_id long, text string")
    rows = merkle.half_replaced(df, "doc_id", "text").collect()
    assert len(rows) == 3 and len({r.edited_sha256 for r in rows}) == 3


def compared(spark, one, other):
    df = spark.createDataFrame([(one, other)], "a string, b string").select(
        merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b")
    )
    near = merkle.likeness(F.col("a"), F.col("b"))
    return df.select(near, merkle.differing(F.col("a"), F.col("b"), 2), merkle.differing(F.col("a"), F.col("b"))).first()


def test_differing_branches_locate_edits(spark):
    lines = [f"line number {i} of this text" for i in range(40)]
    other = list(lines)
    other[19] = "another line"
    near, sections, leaves = compared(spark, "\n".join(lines), "\n".join(other))
    assert (sections, leaves) == ([2], [19]) and near == pytest.approx(39 / 41)
    assert compared(spark, "\n".join(lines), "\n".join(lines))[:] == (1.0, [], [])
    near, sections, leaves = compared(spark, "a\nb", "b\na")
    assert near == pytest.approx(2 / 3) and leaves == [0, 1]


def test_line_breaks_count(spark):
    assert compared(spark, "a", "a\n")[0] < 1
    assert compared(spark, None, "")[0] == 1


def test_no_python_in_the_plan(spark):
    plan = merkle.half_replaced(documents(spark), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
