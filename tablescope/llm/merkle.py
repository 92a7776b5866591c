"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph is a line of the text; it is cut into pieces of eight words, the leaves. Eight
paragraphs in a row are a section, and the sections hang under the root. A leaf's digest is the
MD5 of its characters, a paragraph's that of its leaves' digests, and so on up to the root
(SHA-256). Equal texts have equal roots, and an edit changes just the nodes above it. The
fingerprint spells the tree: the root's digest, then the sections' and the leaves' digests, cut
to eight digits. Two fingerprints are compared without their texts: ``likeness`` is the share
of different leaves and root that they have in common, ``differing`` says which sections and
leaves differ.

Everything is built of SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import let, stored

WORDS = 8
PARAGRAPHS = 8
DIGITS = 8
# Up to eight words; never empty but at the end of a paragraph.
PIECE = rf"[^ ]*+(?: [^ ]*+){{0,{WORDS - 1}}}+"


def fingerprint(text: Column) -> Column:
    """``root:sections:leaves`` of a text; null counts as empty."""
    paragraphs = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda line: F.transform(
            F.filter(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda piece: piece != ""),
            lambda piece: F.md5(piece.cast("binary")),
        ),
    )

    def spelled(leaves):
        digests = F.transform(leaves, lambda own: F.md5(F.array_join(own, "").cast("binary")))
        return let(digests, lambda of: let(sections(of), lambda own: joined(own, F.flatten(leaves))))

    def sections(digests):
        return F.transform(
            F.sequence(F.lit(0), F.size(digests) - 1, F.lit(PARAGRAPHS)),
            lambda start: F.md5(F.array_join(F.slice(digests, start + 1, PARAGRAPHS), "").cast("binary")),
        )

    def joined(own, leaves):
        root = F.sha2(F.array_join(own, "").cast("binary"), 256)
        return F.concat_ws(":", root, short(own), short(leaves))

    return let(paragraphs, spelled)


def short(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda digest: F.substring(digest, 1, DIGITS)), "")


def root(of: Column) -> Column:
    return F.split_part(of, F.lit(":"), F.lit(1))


def branches(of: Column, level: int) -> Column:
    """The short digests of a fingerprint's sections (2) or leaves (3)."""
    return F.regexp_extract_all(F.split_part(of, F.lit(":"), F.lit(level)), F.lit(f".{{{DIGITS}}}"), F.lit(0))


def likeness(one: Column, other: Column) -> Column:
    """1 for equal roots, else the common share of different leaves, the root counted along."""
    shared = let(
        F.struct(F.array_distinct(branches(one, 3)).alias("a"), F.array_distinct(branches(other, 3)).alias("b")),
        lambda of: F.size(F.array_intersect(of["a"], of["b"])) / (F.greatest(F.size(of["a"]), F.size(of["b"])) + 1),
    )
    return F.when(root(one) == root(other), F.lit(1.0)).otherwise(shared.cast("double"))


def differing(one: Column, other: Column, level: int = 3) -> Column:
    """The positions from 0 at which sections (2) or leaves (3) differ; extra ones differ too."""
    pairs = F.zip_with(
        branches(one, level), branches(other, level), lambda a, b: a.eqNullSafe(b)
    )
    return let(
        pairs,
        lambda same: F.filter(
            F.transform(same, lambda equal, at: F.when(~equal, at)), lambda at: at.isNotNull()
        ),
    )


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, n_chars (code points) and fingerprint of every row.

    A null text counts as empty; an empty text is one empty paragraph. Repeated rows each give
    a row, an empty frame none; further columns are not read. There is no shuffle.
    """
    return df.select(
        df[key],
        F.char_length(F.coalesce(df[text], F.lit(""))).cast("long").alias("n_chars"),
        fingerprint(df[text]).alias("fingerprint"),
    )


def followers(keys: DataFrame) -> DataFrame:
    """For rows (id, name, mark, half) with unique (id, mark): whom each follows in descending order.

    Gives name, mark and (before_name, before_mark, need): the row before it in the order of id
    descending, then mark; the first row follows the last one. ``need`` is that row's ``half``.
    ``name`` spells the id and is never null.
    Only these narrow rows are sorted; of each range partition one row is looked at in one place.
    """
    order = [F.col("id").desc_nulls_last(), F.col("mark")]
    numbered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = numbered.withColumn("at", F.monotonically_increasing_id())
    rows, _ = stored(numbered.withColumn("part", F.shiftright("at", 33).cast("int")), "ids")
    own = F.struct("name", "mark", "half")
    inside = Window.partitionBy("part").orderBy("at")
    linked = rows.withColumn("before", F.lag(own).over(inside))
    ends = rows.groupBy("part").agg(F.max_by(own, "at").alias("end"))
    over = Window.orderBy("part")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("end").over(over), F.last("end").over(whole)).alias("end"))
    # One row per partition of the range partitioning, so its size does not follow the data's.
    linked = linked.join(F.broadcast(ends), "part").withColumn("before", F.coalesce("before", "end"))
    return linked.select(
        "name", "mark", F.col("before.name").alias("before_name"), F.col("before.mark").alias("before_mark"),
        F.col("before.half").alias("need"),
    )


def half_replaced(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of every text, of an edited text, and how alike they are.

    The edit replaces the last floor(n/2) code points by the first as many (or all) of the
    next document's, in the order of descending key, null last; the last row is followed by
    the first. Gives key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and next_key. Rows that repeat key and text stand in one place of the order and all have
    the same result; rows with equal keys and other texts follow each other by a hash of the
    text. A null text counts as empty; further columns are not read.

    Whole texts are shuffled once, by key; each document then sends the start that is asked
    for, and its fingerprint, to the one it follows.
    """
    docs = df.select(df[key].alias("id"), F.coalesce(df[text], F.lit("")).alias("text"))
    # Joins and groups all go by the same columns without nulls, so each side is dealt out once.
    name = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null"))
    docs = docs.withColumn("name", name).withColumn("mark", F.xxhash64("text"))
    half = F.floor(F.char_length("text") / 2).cast("int").alias("half")
    order = followers(docs.select("id", "name", "mark", half).distinct())
    sent = docs.join(order.hint("merge"), ["name", "mark"])
    sent = sent.groupBy("before_name", "before_mark").agg(  # repeated rows send once
        F.first(F.expr("left(text, need)")).alias("start"),
        F.first(fingerprint(F.col("text"))).alias("next"),
        F.first("id").alias("next_key"),
    )
    sent = sent.withColumnsRenamed({"before_name": "name", "before_mark": "mark"})
    both = docs.join(sent.hint("merge"), ["name", "mark"])
    kept = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) AS int))")
    edited = both.select(
        "id", "text", "next", "next_key", F.concat(kept, F.col("start")).alias("edited")
    )
    trees = edited.select(
        "id", "next", "next_key",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
    )
    return trees.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        "next_key",
    )


def oracle() -> str:
    """DuckDB SQL for the query over ``documents``."""
    piece = rf"[^ ]*(?: [^ ]*){{0,{WORDS - 1}}}"

    def tree(text):
        return f"""(SELECT sha256(array_to_string(s, '')) || ':' || array_to_string([x[:{DIGITS}] for x in s], '')
            || ':' || array_to_string([x[:{DIGITS}] for x in flatten(ls)], '')
          FROM (SELECT ls, [md5(array_to_string(ds[i + 1 : i + {PARAGRAPHS}], ''))
              for i in range(0, len(ds), {PARAGRAPHS})] AS s
            FROM (SELECT ls, [md5(array_to_string(l, '')) for l in ls] AS ds
              FROM (SELECT [[md5(p) for p in regexp_extract_all(line, '{piece}') if p <> '']
                for line in string_split({text}, chr(10))] AS ls))))"""

    def near(one, other):
        leaves = lambda of: f"list_distinct(regexp_extract_all(split_part({of}, ':', 3), '.{{{DIGITS}}}'))"
        a, b = leaves(one), leaves(other)
        return f"""CASE WHEN split_part({one}, ':', 1) = split_part({other}, ':', 1) THEN 1.0::DOUBLE
          ELSE len(list_intersect({a}, {b}))::DOUBLE / (greatest(len({a}), len({b})) + 1) END"""

    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    linked AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC),
      first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC),
      first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_key FROM docs),
    edits AS (SELECT doc_id, text, n, next_text, next_key, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM linked),
    trees AS (SELECT doc_id, n, next_key, sha256(edited) AS edited_sha256, {tree('text')} AS fingerprint,
      {tree('edited')} AS edited_fingerprint, {tree('next_text')} AS next FROM edits)
    SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
      {near('fingerprint', 'edited_fingerprint')} AS near_edited, {near('fingerprint', 'next')} AS near_next, next_key FROM trees
    """
