"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A text's set holds the hashes of its distinct shingles. Two sets are linked when ``percent`` of
their union, or more, is shared; links form components.

Signatures. Each shingle flips one bit of a bitmap that is about as wide as its set is large. Two
bitmaps differ in no more bits than the sets differ in shingles, so the count of differing bits
bounds the overlap from above. Widths are powers of two and a wide bitmap folds into a narrow one,
so sets of any two sizes can be compared.

Tiles. Linked sets share one of their first shingles in any common order, where "first" is the
part of a set that the similarity lets miss, and one more (``prefix``). Rare shingles come first in
that order, so passages that many texts share bring few of them together. All sets that have a
shingle among their first make a bucket. Inside a bucket sets lie in order of size. A large one is
cut into tiles of neighbouring sizes, and only pairs of tiles whose sizes allow a link meet.

1. Texts give (shingle, set) rows for the first shingles only. Sets that share none are done.
2. Of the others, those that share half of their first shingles or more are sorted by their smallest
   hash and size, and each is compared with the leaders before it that share its smallest hash. That links most near copies early; it decides nothing,
   because
3. every bucket in which two sets are not yet linked is searched through signatures. Buckets with
   the same members are searched once. A set with a partner that may be linked to it is open.
4. Open sets of one chain of such partners are compared in pairs of tiles, by bound and then by
   exact intersection of the sorted hashes.

Sets are never stored: a step hashes the texts that it needs anew. A set is named by 64 bits of a
hash of all its shingles, so the same text has the same name in every step. Pairs are never listed:
a task merges what it links and sends one row per set at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablescope.llm.common import free, in_order, stored
from tablescope.llm.simhash import components, merged
from tablescope.workspace import new_path

WORDS, PERCENT = 4, 85
# Sets of one task when sets meet their leaders.
SORTED = 5_000
# Sets of one tile, when buckets are searched and when open sets are compared.
TILE, OPEN_TILE = 4096, 512
# Leaders of one smallest hash that a set is compared with; buckets find the links beyond.
LEADERS = 64
# Bits of a signature that travel with a bucket; wider ones are folded.
CARRIED = 2048
# Shingles counted at once, least count there, how many frequent ones the order knows, and from
# what count on a shingle is one (a bucket of fewer sets costs little). These only settle which shingles are looked at first, never what is linked.
COUNTED, OFTEN, FREQUENT, HOT = 2_000_000, 3, 200_000, 500
# Words whose hashes a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
# Up to so many sets are picked out of the texts by a broadcast of their hashes (16 MB), more by a join.
PICKED = 1_000_000


class WordHashes(dict):
    """XXH64 of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


def set_of(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles: the hashes of their words, mixed one after the other."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(words, len(found))
    n = len(found) - size + 1
    mixed = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0x94D049BB133111EB))


def low_of(shingles: np.ndarray) -> int:
    return int(shingles[0].astype(np.int64))


def name_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def linked(common, size, other, percent: int):
    """Whether sets of these sizes that share ``common`` shingles are linked."""
    return (100 + percent) * common >= percent * (size + other)


def may_meet(small, large, percent: int):
    """Whether sets of these sizes can be linked at all."""
    return 100 * small >= percent * large


def prefix_size(n, percent: int):
    """So many of a set's first shingles hold one of every linked set's.

    Linked sets share ``percent`` of the larger one at least. The first shared shingle has all
    other shared ones behind it, so it is not among the last of either.
    """
    return n + percent * n // -100 + 1


def width_of(n: int) -> int:
    """Bits of the signature of n shingles."""
    return max(64, 1 << max(0, n - 1).bit_length())


def signature(shingles: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each bit, as 64-bit words."""
    width = width_of(len(shingles))
    bits = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def carried(shingles: np.ndarray) -> bytes:
    """The signature that travels with a bucket."""
    return folded(signature(shingles), CARRIED // 64).tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Signatures (last axis: 64-bit words) as they would be with ``size`` words."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def most_common(a: np.ndarray, b: np.ndarray, size, other):
    """The most shingles that sets with these signatures can share."""
    return (size + other - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)) // 2


def similar(a, b, percent: int) -> bool:
    """Whether two (shingles, signature) are linked: by size, bound, and exact intersection."""
    n, m = len(a[0]), len(b[0])
    if not may_meet(min(n, m), max(n, m), percent):
        return False
    words = min(len(a[1]), len(b[1]))
    if not linked(most_common(folded(a[1], words), folded(b[1], words), n, m), n, m, percent):
        return False
    return linked(len(np.intersect1d(a[0], b[0], assume_unique=True)), n, m, percent)


def named_sets(rows: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds. ``row``: key, name, n, low and mark of every row of (key, mark, text), and
    the signature where the task meets the set first.
    ``often``: name is a shingle that stands in n sets of a run of about ``COUNTED`` shingles, at
    least ``OFTEN``; one in more sets than there are runs, ``OFTEN`` times over, is never missed."""
    kind = rows.schema["key"].dataType
    key_type = to_arrow_type(kind)
    columns = ["kind", "key", "name", "n", "low", "mark", "sign"]
    # One per task: what was not counted yet.
    held: list[np.ndarray] = []

    def result(keys, marks, sets, names, first):
        held.extend(own for own, new in zip(sets, first) if new and len(own))
        count = len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["row"] * count), keys, pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            + [pa.array([low_of(s) if len(s) else None for s in sets], pa.int64()), marks]
            + [pa.array([carried(s) if new and len(s) else None for s, new in zip(sets, first)], pa.binary())],
            names=columns,
        )
        if sum(map(len, held)) >= COUNTED:
            yield often()

    def often():
        found, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        held.clear()
        keep = times >= OFTEN
        found, times = found[keep].astype(np.int64), times[keep].astype(np.int64)
        none, nulls = pa.nulls(len(found), key_type), pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(["often"] * len(found), pa.string()), none, pa.array(found), pa.array(times), nulls, nulls, pa.nulls(len(found), pa.binary())], names=columns
        )

    def counted(batches):
        held.clear()
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [set_of(t.as_py(), words) for t in part.column(2)]
                names = [name_of(own) for own in sets]
                first = [name not in seen for name in names]
                seen.update(names)
                yield from result(part.column(0), part.column(1), sets, names, first)
        yield often()

    return rows.mapInArrow(counted, f"kind string, key {kind.simpleString()}, name long, n long, low long, mark long, sign binary")


def frequent_shingles(often: DataFrame) -> np.ndarray:
    """Rows (hash, count), by hash, of the ``FREQUENT`` most frequent shingles that were counted."""
    total = often.groupBy("name").agg(F.sum("n").alias("times")).filter(F.col("times") >= HOT)
    top = total.orderBy(F.col("times").desc(), "name").limit(FREQUENT).collect()
    out = np.array([(r["name"], r["times"]) for r in top], dtype=np.int64).reshape(-1, 2)
    return out[np.argsort(out[:, 0].astype(np.uint64))]


def prefix(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set: rare ones before frequent ones, and by hash."""
    size = prefix_size(len(shingles), percent)
    if not len(frequent):
        return shingles[:size]
    hashes = frequent[:, 0].astype(np.uint64)
    at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
    times = np.where(hashes[at] == shingles, frequent[at, 1], 0)
    return shingles[np.argsort(times, kind="stable")[:size]]


def prefix_keys(rows: DataFrame, words: int, frequent: np.ndarray, percent: int) -> DataFrame:
    """(key, row, n): a row per shingle in the prefix of every set; a task gives each set once."""

    def dealt(batches):
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                keys, names, sizes = [], [], []
                for text in batch.slice(start, 256).column(2):
                    own = set_of(text.as_py(), words)
                    name = name_of(own)
                    if len(own) and name not in seen:
                        seen.add(name)
                        keys.append(prefix(own, frequent, percent))
                        names.append(name)
                        sizes.append(len(own))
                if keys:
                    times = [len(k) for k in keys]
                    columns = [np.concatenate(keys).astype(np.int64), np.repeat(names, times), np.repeat(sizes, times)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "row", "n"])

    return rows.mapInArrow(dealt, "key long, row long, n long")


def picked_sets(rows: DataFrame, wanted: DataFrame, words: int, parts: bool = False) -> DataFrame:
    """(row, low, n, shingles) of the sets of ``wanted`` (row, mark), in the texts of those marks.

    With ``parts``, also ``part`` of ``wanted``. A task gives each set once; copies in other tasks
    come again.
    """
    part = F.min("part") if parts else F.lit(0)
    marks = wanted.groupBy("mark").agg(part.alias("part"))
    if wanted.count() <= PICKED:
        marks = F.broadcast(marks)

    def hashed(batches):
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out, some = [], batch.slice(start, 256)
                for text, part in zip(some.column(0), some.column(1).to_pylist()):
                    own = set_of(text.as_py(), words)
                    name = name_of(own)
                    if name not in seen:
                        seen.add(name)
                        out.append((name, low_of(own), len(own), own.tobytes(), part))
                columns = zip(*out) if out else ((),) * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                names = ["row", "low", "n", "shingles", "part"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    found = rows.join(marks, "mark").select("text", F.col("part").cast("long").alias("part"))
    return found.mapInArrow(hashed, "row long, low long, n long, shingles binary, part long")


def with_leaders(sets: DataFrame, percent: int, edges: bool = True) -> DataFrame:
    """Sets (part, low, n, row, shingles), sorted here, next to the leaders before them.

    Sets of one part meet. Gives rows of two kinds. ``set``: a set with its label (its leader's name
    or its own). ``leader``: with ``edges``, the leaders of a part's first and last smallest hash,
    which may go on in another part.
    """
    order = ["part", "low", "n", "row"]
    rows = sets.select(*order, "shingles").repartition("part").sortWithinPartitions(*order)
    names = ["kind", "low", "row", "label", "n", "data"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(out):
        columns = zip(*out) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def compared(batches):
        part, low, last, first = None, None, None, False
        leaders: list[tuple] = []  # name, (shingles, signature)

        def edge():
            return [("leader", low, row, row, len(own[0]), own[0].tobytes()) for row, own in leaders] if edges else []

        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                out = []
                for own_part, own_low, n, row, data in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns)):
                    if row == last:  # a copy of the set before it, from another task
                        continue
                    if (own_part, own_low) != (part, low):
                        if first or own_part != part:
                            out += edge()
                        part, low, leaders, first = own_part, own_low, [], own_part != part
                    last = row
                    shingles = np.frombuffer(data, dtype=np.uint64)
                    own = shingles, signature(shingles)
                    near = [r for r, other in leaders if similar(own, other, percent)]
                    label = near[0] if near else row
                    if not near:
                        leaders = [(row, own), *leaders[: LEADERS - 1]]
                    out.append(("set", None, row, label, n, None))
                    out += [("set", None, r, label, n, None) for r in near[1:]]
                yield batch_of(out)
        yield batch_of(edge())

    return rows.mapInArrow(compared, "kind string, low long, row long, label long, n long, data binary")


def search_bucket(n, label, row, data, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first of each one's chain) of sets that may be linked to one of another label.

    Rows lie by size. The sets of the commonest label are only met by the others.
    """
    wide = np.array([len(d) // 8 for d in data])  # grows with the sizes, so each width is a stretch
    levels = {}  # width -> first row that has it, and the signatures from there on, folded to it
    for words in np.unique(wide).tolist():
        start = int(np.searchsorted(wide, words))
        levels[words] = start, np.stack([folded(np.frombuffer(d, dtype=np.uint64), words) for d in data[start:]])
    names, code, times = np.unique(label, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(code != np.argmax(times))
    chain, open_ = np.arange(len(n)), np.zeros(len(n), dtype=bool)
    for i in rest.tolist():
        first = np.searchsorted(n, -(-percent * n[i] // 100))
        last = np.searchsorted(n, 100 * n[i] // percent, side="right")
        j = np.arange(first, last)
        j = j[(code[j] != code[i]) & ~((chain[j] == chain[i]) & open_[j] & open_[i])]
        for words, (start, signs) in levels.items():
            if words > wide[i]:
                break
            own = j[wide[j] == words] if words < wide[i] else j[wide[j] >= words]
            if len(own):
                own = own[linked(most_common(signs[i - start], signs[own - start], n[i], n[own]), n[i], n[own], percent)]
            if len(own):
                open_[i] = open_[own] = True
                chain = merged(chain, np.full(len(own), i), own)
    found = np.flatnonzero(open_)
    return row[found], row[chain[found]]


def grouped(rows: DataFrame, columns: list[str], compare, schema: str, label: str) -> DataFrame:
    """``compare`` of the columns of each group; rows are dealt by ``group`` and lie by size."""
    dealt = rows.select("group", *columns).repartition("group").sortWithinPartitions("group", "n", "row")
    names = [c.split()[0] for c in schema.split(", ")]

    def searched(batches):
        group, held = None, []

        def result():
            sides = compare(*zip(*held)) if len(held) > 1 else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in sides], names=names)

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if own != group:
                    if len(held) > 1:
                        yield result()
                    group, held = own, []
                held.append(row)
        yield result()

    return dealt.mapInArrow(searched, schema)


def tiled(rows: DataFrame, by: str, size: int, percent: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with a ``group`` per ``by``, or per pair of tiles where ``by`` has over ``size`` rows.

    Tiles are cut in order of the sets' sizes. A pair whose sizes rule out links is left out, and
    so is one whose rows all have one label. A row comes once per pair.
    """
    spark = rows.sparkSession
    counts, counts_path = stored(rows.groupBy(by).count().filter(F.col("count") > size).select(by), "large-groups")
    whole = rows.withColumn("group", F.xxhash64(by))
    if counts.isEmpty():
        free(spark, counts_path)
        return whole, []
    large = in_order(rows.join(counts, by, "left_semi"), [by, "n", "row"], label="sizes")
    # Cut where the whole order is cut, so a tile holds ``size`` rows of one group at most.
    large, large_path = stored(large.withColumn("tile", F.expr(f"position div {size}")), "tiles")
    tiles, tiles_path = stored(
        large.groupBy(by, "tile").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("low"), F.max("label").alias("high")
        ),
        "tile-sizes",
    )
    left = tiles.select(by, *(F.col(c).alias(f"l_{c}") for c in ("tile", "most", "low", "high")))
    right = tiles.select(by, *(F.col(c).alias(f"r_{c}") for c in ("tile", "least", "low", "high")))
    mixed = (F.least("l_low", "r_low") < F.greatest("l_high", "r_high"))
    near = (F.col("l_tile") <= F.col("r_tile")) & (100 * F.col("l_most") >= percent * F.col("r_least"))
    pairs, pairs_path = stored(left.join(right, by).filter(near & mixed).select(by, "l_tile", "r_tile"), "tile-pairs")
    sides = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("l_tile", "r_tile"))))
    group = F.xxhash64(by, "l_tile", "r_tile").alias("group")
    cut = large.join(sides, [by, "tile"]).select(*rows.columns, group)
    return (
        whole.join(counts, by, "left_anti").select(*rows.columns, "group").unionAll(cut),
        [counts_path, large_path, tiles_path, pairs_path],
    )


def open_chains(keys: DataFrame, labels: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(fp, other) of sets that share a prefix shingle, by whose signatures they may be linked."""
    rows = keys.join(labels.select(F.col("fp").alias("row"), "label"), "row", "left")
    rows, rows_path = stored(rows.select("key", "row", "n", F.coalesce("label", "row").alias("label")), "bucket-rows")
    one, two = F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("two")
    mixed = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.min("label").alias("least"), F.max("label").alias("most"), one, two
    )
    # Buckets with the same members: one is enough.
    wanted = mixed.filter("least < most").groupBy("rows", "one", "two").agg(F.min("key").alias("key"))
    wanted, wanted_path = stored(wanted.select("key"), "wanted-keys")
    rows, mixed_path = stored(rows.join(wanted, "key", "left_semi").join(signs, "row"), "mixed-rows")
    free(keys.sparkSession, wanted_path, rows_path)
    dealt, paths = tiled(rows, "key", TILE, percent)

    def compare(n, label, row, data):
        return search_bucket(np.array(n), np.array(label), np.array(row), data, percent)

    found = grouped(dealt, ["n", "label", "row", "data"], compare, "fp long, other long", "open")
    found, _ = stored(found.distinct(), "open")
    free(keys.sparkSession, mixed_path, *paths)
    return found


def compared(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(fp, other) links between open sets (row, chain, label) of one chain and different labels."""
    dealt, paths = tiled(open_, "chain", OPEN_TILE, percent)
    rows = dealt.join(sets.select("row", "shingles"), "row")

    def compare(n, label, row, shingles):
        sets = [np.frombuffer(s, dtype=np.uint64) for s in shingles]
        signs = [signature(s) for s in sets]
        _, group = np.unique(np.array(label), return_inverse=True)
        n, edges = np.array(n), []
        for i in range(len(n)):
            for j in np.flatnonzero(group[i + 1 :] != group[i]) + i + 1:
                if not may_meet(n[i], n[j], percent):
                    break
                if group[j] != group[i] and similar((sets[i], signs[i]), (sets[j], signs[j]), percent):
                    group[group == group[j]] = group[i]
                    edges.append((row[i], row[j]))
        return tuple(zip(*edges)) if edges else ((), ())

    found, _ = stored(grouped(rows, ["n", "label", "row", "shingles"], compare, "fp long, other long", "links"), "links")
    free(open_.sparkSession, *paths)
    return found


def shared_keys(keys: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """The distinct rows of ``keys`` whose shingle several sets have among their first."""
    keys, path = stored(keys, "prefix-keys")
    shared = keys.groupBy("key").agg(
        F.min("row").alias("least"), F.max("row").alias("most"), F.count(F.lit(1)).alias("rows"),
        F.min("n").alias("small"), F.max("n").alias("large"),
    )
    # Two sets alone whose sizes rule out a link need not meet.
    apart = (F.col("rows") == 2) & ~may_meet(F.col("small"), F.col("large"), percent)
    shared = shared.filter((F.col("least") < F.col("most")) & ~apart)
    shared, shared_path = stored(shared.select("key"), "shared-keys")
    out = stored(keys.join(shared, "key", "left_semi").distinct(), "shared-rows")
    free(keys.sparkSession, path, shared_path)
    return out


def set_labels(texts: DataFrame, named: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(fp, label) of the sets that are linked with another one: one label per component."""
    spark = texts.sparkSession
    keys, keys_path = shared_keys(prefix_keys(texts, words, frequent, percent), percent)
    shares = keys.groupBy("row").agg(F.count(F.lit(1)).alias("shared"))
    wanted = named.withColumnRenamed("name", "row").join(shares, "row").groupBy("row")
    wanted = wanted.agg(*(F.min(c).alias(c) for c in ("n", "low", "mark", "shared")), F.max("sign").alias("sign"))
    wanted, wanted_path = stored(wanted, "wanted-sets")
    # Sets that share half of their first shingles or more are likely linked, and meet their leaders.
    # Parts are cut from the order of names and sizes alone, so that a hot smallest hash is split.
    likely = wanted.filter(2 * F.col("shared") >= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).drop("sign")
    likely = in_order(likely, ["low", "n", "row"], label="set-order")
    likely, likely_path = stored(likely.withColumn("part", F.expr(f"position div {SORTED}")), "likely-sets")
    path = new_path(spark, "dealt")
    dealt = with_leaders(picked_sets(texts, likely, words, parts=True), percent)
    dealt.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    found, leaders = (dealt.filter(F.col("kind") == kind).drop("kind") for kind in ("set", "leader"))
    leaders = leaders.withColumnRenamed("data", "shingles").withColumn("part", F.col("low"))
    again = with_leaders(leaders, percent, edges=False)
    early = found.select(F.col("row").alias("fp"), F.col("label").alias("other"))
    early = early.unionAll(again.select(F.col("row").alias("fp"), F.col("label").alias("other")))
    early, early_path = stored(early.filter("fp <> other").distinct(), "early-links")
    labels = components(early)
    chains = components(open_chains(keys, labels, wanted.select("row", F.col("sign").alias("data")), percent))
    chained = wanted.join(chains.select(F.col("fp").alias("row"), F.col("label").alias("chain")), "row")
    chained = chained.join(labels.select(F.col("fp").alias("row"), "label"), "row", "left")
    open_, open_path = stored(chained.select("row", "n", "mark", "chain", F.coalesce("label", "row").alias("label")), "open-sets")
    late = compared(open_, picked_sets(texts, open_, words), percent)
    labels = components(early.unionAll(late))
    free(spark, keys_path, wanted_path, likely_path, path, early_path, open_path)
    return labels


def join(df: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component (the smallest key that links lead to) of every row.

    Words lie between ASCII white space, A-Z in lower case. A text with fewer words than a shingle
    is one shingle as a whole. A null, empty or blank text has no shingles and is linked with
    nothing, so its component is its own key. Rows with equal sets are linked. Null keys count only
    where a component has no other. Repeated rows each give a row, an empty frame none; whole texts
    are read, and further columns are not.
    """
    spark = df.sparkSession
    texts = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("mark"), df[text].alias("text"))
    named, path = named_sets(texts, words), new_path(spark, "named-sets")
    named.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    named = spark.read.schema(named.schema).parquet(path)
    frequent = frequent_shingles(named.filter("kind = 'often'"))
    named = named.filter("kind = 'row'").select("key", "name", "n", "low", "mark", "sign")
    filled = named.filter("n > 0")
    labels = set_labels(texts, filled.drop("key"), frequent, words, percent)
    least = filled.groupBy("name").agg(F.min("key").alias("least"))
    least = least.join(labels.select(F.col("fp").alias("name"), "label"), "name", "left")
    labelled, labelled_path = stored(least.withColumn("label", F.coalesce("label", "name")), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component"))
    smallest, smallest_path = stored(smallest, "smallest")
    classes, classes_path = stored(labelled.select("name", "label").join(smallest, "label").select("name", "component"), "classes")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component")
    out = named.join(classes, "name", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component)
    out, _ = stored(out, "jaccard")
    free(spark, path, labelled_path, smallest_path, classes_path)
    return out


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (SELECT x, y FROM shared WHERE 100 * common >= 85 * (nx + ny - common)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id
FROM sets LEFT JOIN least ON x = doc_id
"""
