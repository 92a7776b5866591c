import re

import pytest
from helpers import TEXTS, by, documents, empty
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.llm import private_data as p

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        double = digit * (1 + place % 2)
        total += double - 9 * (double > 9)
    return total % 10 == 0


def counts(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(part) <= 255 for part in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [
        (kind, m.start(), m.end()) for kind, regex in PLAIN.items() for m in re.finditer(regex, text or "") if counts(kind, m[0])
    ]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = p.looked_through(df, "doc_id", "text").collect()
    return {r.key: [tuple(s) for s in r.base] for r in rows}


ALPHABET = st.sampled_from(list("a.@-+ ()%1234567890\n é🙂_") + ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-0100", "..", "@@"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(ALPHABET, max_size=60).map("".join), min_size=150, max_size=150))
def test_base_spans_of_any_text(spark, texts):
    assert found(spark, texts) == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_base_spans_of_all_kinds_of_texts(spark):
    texts = [*TEXTS.values(), "a" * 50_000, "1" * 50_000, "a@" * 20_000, "1." * 20_000, "+1" + "(" * 50_000, "x@" + "y." * 9_000]
    texts += ["1 " * 20_000, "10.0.0.1 " * 3_000, "é🙂 10.0.0.1", "000255.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8", "4111-1111-1111-1111"]
    assert found(spark, texts) == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_all_rows_and_clashing_columns(spark):
    rows = by(p.digests(documents(spark), "doc_id", "text"))
    assert set(rows) == set(TEXTS)
    for i, text in TEXTS.items():
        spans = plain_spans(text)
        assert rows[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert rows[i].n_ip == sum(k == "ip" for k, _, _ in spans)
    assert p.find(empty(spark), "doc_id", "text").count() == 0


def corpus():
    texts = {i: f"Some words here. reach me at user{i}@host{i}.example.com today" for i in range(20)}
    texts |= {100 + i: f"nothing of note but the year {1900 + i} came" for i in range(12)}
    texts |= {200 + i: f"both of them at 10.0.0.{i} and the rest" for i in range(4)}
    texts |= {300: "you can reach me at user99[at]host99 instead", 301: "Reach  ME at user98#host98, yes"}
    texts |= {302: "you find user99[at]host99 elsewhere, and me at home 24h"}
    return texts


def test_patterns_of_seeds_discover_unseen_identifiers(spark):
    texts = corpus()
    rows = by(p.find(documents(spark, texts, (300,)), "doc_id", "text"))
    new = {i: [tuple(s) for s in r.spans if s not in r.base] for i, r in rows.items() if r.spans != r.base}
    assert {i: [(k, texts[i][a:b]) for k, a, b in s] for i, s in new.items()} == {
        300: [("email", "user99[at]host99")],
        301: [("email", "user98#host98")],
    }


def test_mixed_contexts_discover_nothing(spark):
    texts = {i: f"with the {i}@x.com" for i in range(8)} | {20 + i: f"with the 10.0.0.{i}" for i in range(8)}
    texts |= {40: "with the 123-xyz"}
    rows = by(p.find(documents(spark, texts, ()), "doc_id", "text"))
    assert all(r.spans == r.base for r in rows.values())


def test_redaction(spark):
    texts = corpus() | {400: None, 401: "", 402: "call +1 (555) 555-0100, card 4111 1111 1111 1111. 1234 5678"}
    df = documents(spark, texts, (1,))
    out = p.redact(df, "doc_id", "text")
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and out.count() == df.count()
    assert rows[1].text == "Some words here. reach me at [EMAIL] today"
    assert rows[300].text == "you can reach me at [EMAIL] instead"
    assert rows[301].text == "Reach  ME at [EMAIL], yes"
    assert rows[200].text == "both of them at [IP] and the rest"
    assert rows[100].text == texts[100]
    assert (rows[400].text, rows[401].text) == (None, "")
    assert rows[402].text == "call [PHONE], card [CARD]. 1234 5678"


def test_overlapping_spans_are_masked_whole(spark):
    texts = {1: "call +33.1.42.68.53.00 now", 2: "+33.1.42.68.53.00", 3: "a1.2.3.4@x.org, 1.2.3.4;+1 (555) 555-0100", 4: "é 4111 1111 1111 1111"}
    rows = {r.doc_id: r.text for r in p.redact(documents(spark, texts, ()), "doc_id", "text").collect()}
    assert rows == {1: "call [PHONE] now", 2: "[PHONE]", 3: "[EMAIL], [IP];[PHONE]", 4: "é [CARD]"}


def test_instances_of_several_groups_and_their_contexts(spark):
    long = "w" * 100
    texts = {
        1: "pay with 4111 1111 1111 1111 now", 2: "phone me (555) 123-4567, or", 3: "To us a@b.co, c@d.co",
        4: "reach" + " " * 60 + "me" + "\n" * 90 + "9@x", 5: f"see {long} b7",
    }
    rows = p.looked_through(documents(spark, texts, ()), "doc_id", "text").collect()
    assert {r.key: [(a.context, a.core, texts[r.key][a.start : a.end], a.seed) for a in r.instances] for r in rows} == {
        1: [("pay with", "4111 1111 1111 1111", "4111 1111 1111 1111", "card")],
        2: [("phone me", "555) 123-4567", "555) 123-4567", None)],
        3: [("to us", "a@b.co", "a@b.co", "email"), ("us a@b.co,", "c@d.co", "c@d.co", "email")],
        4: [("reach me", "9@x", "9@x", None)],
        5: [(f"see {long}", "b7", "b7", None)],
    }


def test_unseen_identifiers_do_not_count_against_their_pattern_and_bring_new_ones(spark):
    texts = {i: f"Please reach me at user{i}@host{i}.example.com today" for i in range(80)}
    texts |= {100 + i: f"Please reach me at user{i}[at]host{i} today" for i in range(25)}
    texts |= {200 + i: f"and ping him on user{i}[at]host{i} as well" for i in range(8)}
    texts |= {300: "and ping him on other1#host1 as well", 301: "but his score is 17x as well"}
    rows = by(p.find(documents(spark, texts, ()), "doc_id", "text"))
    new = {i: [texts[i][s.start : s.end] for s in r.spans if s not in r.base] for i, r in rows.items()}
    assert all(new[100 + i] == [f"user{i}[at]host{i}"] for i in range(25))
    assert all(new[200 + i] == [f"user{i}[at]host{i}"] for i in range(8))
    assert new[300] == ["other1#host1"] and new[301] == []


def test_no_python_in_the_plan(spark):
    plan = p.looked_through(documents(spark), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_matches_in_one_text(spark):
    text = "10.0.0.1 " * 500
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    starts = df.select(p.starts(p.cuts(F.col("text"), p.PATTERNS["ip"]))).first()[0]
    assert starts == [9 * i for i in range(500)]
