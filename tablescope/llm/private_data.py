"""Private data by bootstrapped contextual extraction, in SQL functions only.

Seed entities are what the base patterns find: e-mail and IP addresses, card and phone numbers.
Outside of them every identifier-like run of a text (a word that holds a digit or an at sign, or
groups of digits with blanks and brackets between them) is an unseen instance. The two words
before either are its context, and a pattern is a context read as a kind. Patterns and instances
form a graph with the numbers of times that they meet. Scores go back and forth in rounds: a
pattern that met ``LEAST_SEEDS`` different seeds scores by the share of its kind in its meetings
with instances of any kind, damped for few; an unseen instance scores by the mean of its patterns
and then counts by its score; with ``LEAST_SCORE`` it is a seed to patterns, so that new contexts
enter. Unseen instances without a score are no evidence against a pattern. Instances that score
``LEAST_SCORE`` at the end are private too, wherever a pattern with that score precedes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import free, let, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 5
LEAST_SCORE = 0.8
DAMPING = 1.0

# What the patterns say, written so that no text takes more than linear time: a match starts at
# the edge of a run of its first characters or right after the last match, and no run is re-read.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
GROUPS = r"(?<!\S)\(?[0-9][0-9().-]*+(?:[ \t]++[0-9(][0-9().-]*+)++"
INSTANCE = rf"{PATTERNS['phone']}|{GROUPS}|(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++"
# Marks around an instance that do not belong to it.
AROUND = r"\A[^A-Za-z0-9+]++|[^A-Za-z0-9]++\z"
STEP = 64
# Stands for the characters of seeds where unseen instances are looked for.
SEEN = "\x01"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    if kind == "ip":
        return hit.rlike(rf"\A{PART}(?:\.{PART}){{3}}\z")
    if kind == "card":
        luhn = lambda number: F.call_function("luhn_check", number)
        return let(digits(hit), lambda d: F.length(d).between(13, 19) & luhn(F.substring(d, 1, 19)))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def cuts(text: Column, pattern: str) -> Column:
    """Struct of the matches of a pattern and the pieces of text before, between and after them."""
    return F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("rests")
    )


def starts(cut: Column, measure: Callable[[Column], Column] = F.char_length) -> Column:
    """Where each match starts, in code points; sums in steps of 64 keep many matches cheap.

    With another ``measure``, its sum over all that stands before each match.
    """
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)
    # Entry k is the match before piece k and that piece, so match k starts after entries 0 to k.
    lengths = F.zip_with(
        cut["rests"],
        F.concat(F.array(F.lit("")), cut["hits"]),
        lambda rest, hit: (measure(rest) + measure(hit)).cast("long"),
    )

    def located(lens):
        steps = F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / STEP).cast("int"))
        sums = F.transform(steps, lambda s: add(F.slice(lens, s * STEP + 1, F.lit(STEP))))
        ahead = let(sums, lambda own: F.transform(own, lambda _, s: add(F.slice(own, F.lit(1), s))))
        return let(
            ahead,
            lambda before: F.transform(
                F.slice(lens, F.lit(1), F.size(lens) - 1),
                lambda _, k: F.element_at(before, F.floor(k / STEP).cast("int") + 1)
                + add(F.slice(lens, (F.floor(k / STEP) * STEP + 1).cast("int"), (k % STEP + 1).cast("int"))),
            ),
        )

    return let(lengths, located)


def some(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def spaces(piece: Column) -> Column:
    """How many runs of white space a piece of text has; none goes on into a match."""
    return F.size(F.regexp_extract_all(piece, F.lit(r"\s+"), F.lit(0)))


def met_in(cut: Column, words: Column | None, instance: Callable[[Column, Column, Column], Column]) -> Column:
    """``instance`` of (match, its start, its context) for all matches, without nulls.

    ``words`` are the pieces of the whole text between white space. The context is the last two
    words before the match; what is glued to the match from before counts as one. Without words it is empty.
    """

    def context(before, rest):
        glued = F.reverse(F.regexp_extract(F.reverse(rest), r"\A\S*+", 0))
        own = F.slice(words, F.greatest(before, F.lit(1)), F.least(before + 1, F.lit(2)))
        near = F.filter(F.concat(own, F.array(glued)), lambda word: word != "")
        return let(near, lambda all_of: F.lower(F.array_join(F.slice(all_of, F.greatest(F.size(all_of) - 1, F.lit(1)), F.lit(2)), " ")))

    if words is None:
        return some(F.zip_with(cut["hits"], starts(cut), lambda hit, start: instance(hit, start, F.lit(""))))
    placed = F.arrays_zip(
        cut["hits"].alias("hit"), starts(cut).alias("start"), starts(cut, spaces).alias("spaces"),
        F.slice(cut["rests"], F.lit(1), F.size(cut["hits"])).alias("rest"),
    )
    return some(
        F.transform(placed, lambda at: instance(at["hit"], at["start"], context(at["spaces"].cast("int") - 1, at["rest"])))
    )


INSTANCES = "array<struct<context:string,core:string,start:long,end:long,seed:string>>"
SPANS = "array<struct<kind:string,start:long,end:long>>"


def seeds(text: Column, words: Column | None, kind: str) -> Column:
    """(context, core, start, end, seed) of a kind's valid matches, by start."""

    def seed(hit, start, context):
        end = start + F.char_length(hit)
        found = F.struct(
            context.alias("context"), F.lower(hit).alias("core"), start.alias("start"), end.alias("end"), F.lit(kind).alias("seed")
        )
        return F.when(valid(kind, hit), found)

    found = let(cuts(text, PATTERNS[kind]), lambda cut: met_in(cut, words, seed)).cast(INSTANCES)
    return F.when(text.contains("@"), found).otherwise(F.array().cast(INSTANCES)) if kind == "email" else found


def spans_of(instances: Column) -> Column:
    """(kind, start, end) of seeds."""
    return F.transform(
        instances, lambda at: F.struct(at["seed"].alias("kind"), at["start"].alias("start"), at["end"].alias("end"))
    ).cast(SPANS)


def merged(spans: Column) -> Column:
    """Spans by start, those that overlap as one; its kind is that of the first, then longest."""
    place = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), place(s["kind"]).alias("place"), s["kind"].alias("kind")),
        )
    )

    def joined(found, s):
        one = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end"))
        last = F.element_at(found, -1)
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], -s["back"]).alias("end"))
        overlaps = (F.size(found) > 0) & (F.try_element_at(found, F.lit(-1))["end"] > s["start"])
        return F.when(overlaps, F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(longer))).otherwise(
            F.concat(found, F.array(one))
        )

    return F.aggregate(ordered, F.array().cast(SPANS), lambda found, s: joined(found, s).cast(SPANS))


def replaced(text: Column, spans: Column, name: Callable[[Column, Column], Column]) -> Column:
    """A text with each of its spans, which are merged, replaced by ``name`` of its kind and text."""

    def pieces(own):
        def piece(s, n):
            before = F.when(n > 0, F.get(own, n - 1)["end"]).otherwise(F.lit(0))
            between = F.substring(text, (before + 1).cast("int"), (s["start"] - before).cast("int"))
            hit = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
            return F.concat(between, name(s["kind"], hit))

        rest = F.substring(text, (F.element_at(own, -1)["end"] + 1).cast("int"), F.char_length(text))
        return F.concat(F.array_join(F.transform(own, piece), ""), rest)

    return F.when(F.size(spans) > 0, let(spans, pieces)).otherwise(text)


def core(hit: Column) -> Column:
    """An instance without the marks around it, in lower case."""
    return F.lower(F.regexp_replace(hit, AROUND, ""))


def unseen(text: Column, words: Column) -> Column:
    """(context, core, start, end, seed) of every identifier-like run; the seed is null."""

    def instance(hit, start, context):
        first = start + F.char_length(F.regexp_extract(hit, r"\A[^A-Za-z0-9+]*+", 0))
        return let(
            core(hit),
            lambda own: F.when(
                F.char_length(own) > 0,
                F.struct(
                    context.alias("context"), own.alias("core"), first.alias("start"),
                    (first + F.char_length(own)).alias("end"), F.lit(None).cast("string").alias("seed"),
                ),
            ),
        )

    return let(cuts(text, INSTANCE), lambda cut: met_in(cut, words, instance)).cast(INSTANCES)


def looked_through(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark (a hash of the text), base spans and instances of every row."""
    rows = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("mark"), F.coalesce(df[text], F.lit("")).alias("text"))
    words = F.split(F.col("text"), r"\s+", -1)
    rows = rows.select("*", let(words, lambda own: F.concat(*(seeds(F.col("text"), own, kind) for kind in KINDS))).alias("seeds"))
    rows = rows.select("*", spans_of(F.col("seeds")).alias("base"))
    # White space stays, so that words are counted alike.
    masked = replaced(F.col("text"), merged(F.col("base")), lambda kind, hit: F.regexp_replace(hit, r"\S", SEEN))
    others = let(masked, lambda rest: let(words, lambda own: unseen(rest, own)))
    return rows.select("key", "mark", "base", F.concat("seeds", others).alias("instances"))


def graded(meetings: DataFrame) -> DataFrame:
    """(context, kind, score) of patterns with seeds enough, from (context, kind, hits, seeds)."""
    whole = meetings.groupBy("context", "kind").agg(F.sum("hits").alias("hits"), F.sum("seeds").alias("seeds"))
    totals = meetings.groupBy("context").agg(F.sum("hits").alias("total"))
    grades = whole.filter(F.col("seeds") >= LEAST_SEEDS).join(totals, "context")
    return grades.select("context", "kind", (F.col("hits") / (F.col("total") + DAMPING)).alias("score"))


def discovered(rows: DataFrame) -> DataFrame:
    """(key, mark, kind, core, start, end) of the instances that patterns discover.

    Meetings are counted before anything is shuffled by context, so a context that precedes a
    third of all instances costs one row per different instance and task.
    """
    met = rows.select("key", "mark", F.explode("instances").alias("at")).select("key", "mark", "at.*")
    met = met.filter("context <> ''")
    edges, edges_path = stored(met.groupBy("context", "core", "seed").agg(F.count("*").alias("n")), "meetings")
    known = edges.filter("seed IS NOT NULL").groupBy("context", F.col("seed").alias("kind"))
    known = known.agg(F.sum("n").cast("double").alias("hits"), F.count("*").alias("seeds"))
    known, known_path = stored(known, "known")
    others = edges.filter("seed IS NULL").select("context", "core", "n")
    patterns, path = stored(graded(known), "patterns")
    paths = [edges_path, known_path]
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    for _ in range(ROUNDS):
        scores = others.join(patterns, "context").groupBy("core", "kind")
        scores = scores.agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("own"))
        # An instance counts as the kind that it scores best as, ties to the kind listed first.
        scores = scores.groupBy("core").agg(F.max_by("kind", F.struct("own", -place)).alias("kind"), F.max("own").alias("own"))
        scores, scores_path = stored(scores, "scores")
        gained = others.join(scores, "core").groupBy("context", "kind").agg(
            F.sum(F.col("n") * F.col("own")).alias("hits"), F.count_if(F.col("own") >= LEAST_SCORE).alias("seeds")
        )
        paths += [path, scores_path]
        patterns, path = stored(graded(known.unionAll(gained)), "patterns")
    sure = patterns.filter(F.col("score") >= LEAST_SCORE).select("context", "kind")
    private = scores.filter(F.col("own") >= LEAST_SCORE).select("core", "kind")
    found = met.filter("seed IS NULL").join(sure, "context").join(private, ["core", "kind"])
    found, _ = stored(found.select("key", "mark", "kind", "core", "start", "end").distinct(), "discovered")
    free(rows.sparkSession, *paths, path)
    return found


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark, ``base`` and ``spans`` of every row: arrays of (kind, start, end).

    Positions are code points, the end is exclusive. ``base`` holds the seed entities, by kind
    as listed and then by start, ``spans`` also what patterns discovered. A null or empty text has
    no spans; repeated rows each give a row, an empty frame none; further columns are not read.
    Texts are read once and never shuffled.
    """
    rows, _ = stored(looked_through(df, key, text), "looked-through")
    found = discovered(rows)
    place = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    extra = found.groupBy("key", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    extra = extra.withColumnsRenamed({"key": "_key", "mark": "_mark"})
    both = rows.join(extra, rows["key"].eqNullSafe(extra["_key"]) & (rows["mark"] == extra["_mark"]), "left")
    whole = F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:long,end:long>>")))
    ordered = F.array_sort(
        F.transform(whole, lambda s: F.struct(place(s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return both.select(F.col("key").alias(key), "mark", "base", spans.alias("spans"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return find(df, key, text).select(
        key, *counts, F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans")
    )


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """All rows and columns of ``df``; in its texts private data gives way to ``[KIND]``.

    Null stays null. The spans of ``find`` are replaced in one pass, those that overlap as one.
    Where nothing is discovered, texts are not shuffled.
    """
    rows, _ = stored(looked_through(df, key, text), "looked-through")
    found = discovered(rows)
    out, extra = df, F.array().cast(SPANS)
    if not found.isEmpty():
        marks = found.groupBy(F.col("key").alias("_key"), F.col("mark").alias("_mark"))
        marks = marks.agg(F.collect_set(F.struct("kind", "start", "end")).alias("_found"))
        same = df[key].eqNullSafe(F.col("_key")) & (F.xxhash64(df[text]) == F.col("_mark"))
        out, extra = df.join(marks, same, "left"), F.coalesce(F.col("_found"), extra)
    own = F.col(text)
    base = [spans_of(seeds(own, None, kind)) for kind in KINDS]
    named = let(merged(F.concat(*base, extra)), lambda spans: replaced(own, spans, lambda kind, hit: F.concat(F.lit("["), F.upper(kind), F.lit("]"))))
    return out.withColumn(text, F.when(own.isNotNull(), named)).select(*df.columns)
