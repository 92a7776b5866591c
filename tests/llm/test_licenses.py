import random
import re

import numpy as np
import pytest
from helpers import TEXTS, by, documents, empty

from tablescope.llm import licenses


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.mark.parametrize("text", [t for i, t in TEXTS.items() if i != 7] + ["a_b-c\x00d\x7fE", "É1²Ⅷ\x80x"])
def test_words(text):
    assert [w.decode() for w in licenses.words_of(text)] == plain_words(text)


def longest_runs(words, templates):
    """The longest run of words that ends at each place and stands in some template."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max(n for n in range(end + 1) if n == 0 or tuple(words[end - n : end]) in runs) for end in range(1, len(words) + 1)]


@pytest.mark.parametrize("seed", range(30))
def test_automaton_has_all_runs_and_their_places(seed):
    r = random.Random(seed)
    templates = [[r.randint(1, 3) for _ in range(r.randint(1, 12))] for _ in range(4)]
    words = [r.randint(1, 4) for _ in range(60)]
    statistics = longest_runs(words, templates) + [0]
    expected = {(i, n) for i, n in enumerate(statistics[:-1]) if n >= licenses.LEAST and statistics[i + 1] <= n}
    automaton = licenses.Automaton(templates)
    found = {(end, n) for end, n, _ in automaton.matches(words)}
    assert found == {(i, n) for i, n in expected if statistics[i + 1] != n + 1}
    for end, n, state in automaton.matches(words):
        run = words[end - n + 1 : end + 1]
        places = {(t, i + n - 1) for t, words_ in enumerate(templates) for i in range(len(words_)) if words_[i : i + n] == run}
        assert {(t, place) for t, own in automaton.ends[state].items() for place in own} == places


def scanned(spark, texts, **options):
    return by(licenses.scan(documents(spark, texts, ()), "doc_id", "text", **options))


def test_texts_of_all_kinds(spark):
    rows = by(licenses.scan(documents(spark), "doc_id", "text"))
    for i, text in TEXTS.items():
        assert rows[i].n_words == len(plain_words(text))
    assert (rows[10].base_labels, rows[10].labels, rows[10].score) == ("reserved", "reserved", 1.0)
    assert (rows[2].labels, rows[2].score, rows[2].first_word) == ("", 0.0, None)
    assert licenses.scan(empty(spark), "doc_id", "text").count() == 0


def test_phrases(spark):
    rows = scanned(spark, {1: "All rights RESERVED. CC-BY cc by; general_public license all rights all rights reserved", 2: "cc-bye"})
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word) == (5, 0, 12)
    assert rows[1].base_labels == "cc-by,gpl,reserved"
    assert (rows[2].n_base, rows[2].labels) == (0, "")


def test_templates_with_strange_words_between_and_parts(spark):
    grant = licenses.TEMPLATES[2][1]
    words = grant.split()
    broken = " ".join(words[:8] + ["strange", "words"] + words[8:])
    rows = scanned(
        spark,
        {
            1: "Intro text. " + grant.upper() + " outro",
            2: broken,
            3: " ".join(words[:9]),
            4: "released under the MIT license.",
            5: " ".join(words[:9] + ["filler"] * 40 + words[9:12]),
            6: "the of and to in is by",
            7: "prose " * 30_000 + grant,
        },
    )
    assert [rows[i].labels for i in (1, 2, 3, 4, 5, 6, 7)] == ["mit", "mit", "", "mit", "", "", "mit"]
    assert rows[1].score == 1.0 and rows[2].score == 1.0
    assert rows[3].score == pytest.approx(9 / len(words))
    assert rows[6].score == 0.0
    span = rows[1].spans[0]
    assert (span["first"], span["last"], span["label"]) == (2, 1 + len(words), "mit")


def test_a_text_without_triples_need_not_be_streamed():
    scanner = licenses.Scanner()
    r = random.Random(1)
    vocabulary = [*scanner.numbers][:12]
    for _ in range(200):
        ids = scanner.numbered([r.choice(vocabulary) for _ in range(30)])
        skipped = not np.isin(scanner.triples(ids), scanner.starts).any()
        assert not skipped or not list(scanner.automaton.matches(ids.tolist()))
