"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint bit is set where more than half of a text's shingle hashes have it. Fingerprints
are linked when they differ in ``max_bits`` bits or fewer, and linked ones form components.

Distinct fingerprints are dealt into buckets by bands of their bits. With more bands than
``max_bits`` that cover the fingerprint, two linked fingerprints agree in one band at least, so no
link is lost. Inside a bucket stands the index: fingerprints are sorted by their rank in the
binary-reflected Gray code, runs of neighbours become nodes that hold the bits all of them share
(a mask and a pattern), and runs of nodes become nodes above. A search goes down from the top,
adds up the differences in the bits that each level settles, and leaves a whole group as soon as
the sum exceeds ``max_bits``. A bucket with more than ``BLOCK`` fingerprints is cut into blocks of
Gray neighbours, and the pairs of blocks whose shared bits allow a link become tasks of their own.
Inside a task links are merged at once: at most one row per fingerprint leaves it, never a pair
per link.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import free, in_order, stored

# Most fingerprints of a bucket that one task searches on its own.
BLOCK = 8192
# Fingerprints below one node of the lowest level, and nodes below one further up. A bucket with
# no more fingerprints than a leaf is one leaf, whose fingerprints are compared.
LEAF, FAN = 16, 8
SEED = 42


@dataclass(frozen=True)
class Settings:
    """words: of a shingle; lanes: 64-bit lanes of a fingerprint; bands of band_bits each."""

    words: int = 3
    lanes: int = 1
    max_bits: int = 3
    bands: int = 4
    band_bits: int = 16

    def __post_init__(self):
        if self.bands * self.band_bits > 64 * self.lanes:
            raise ValueError("the bands need more bits than a fingerprint has")

    @property
    def exact(self) -> bool:
        """Whether bands lose no link: some band of two linked fingerprints must be equal."""
        return self.bands > self.max_bits and self.bands * self.band_bits == 64 * self.lanes


# One 64-bit lane, links at three bits: four bands of 16 bits lose nothing.
THREE_BITS = Settings(words=3, lanes=1, max_bits=3, bands=4, band_bits=16)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle: ASCII letters in lower case, words between ASCII white space."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = max(1, len(found) - words + 1)
    ends = starts[min(words, len(found)) : min(words, len(found)) + n] - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())), dtype=np.uint64, count=n
    )


def fingerprint(text: str | None, settings: Settings) -> bytes:
    """The lanes, each as eight bytes, highest bit first; zero for a text without words."""
    return folded(shingle_hashes(text, settings.words), settings)


def folded(hashes: np.ndarray, settings: Settings) -> bytes:
    """The fingerprint of shingle hashes."""
    out = []
    for lane in range(settings.lanes):
        own, counts = hashes, np.zeros(64, dtype=np.int64)
        if lane:  # further lanes mix the hash anew
            own = (hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            own = (own ^ (own >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            own = own ^ (own >> np.uint64(32))
        for start in range(0, len(own), 200):  # sums of up to 200 fit a byte
            bits = np.unpackbits(own[start : start + 200].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
        out.append(np.packbits(counts * 2 > len(own)).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, key: str, text: str, settings: Settings = THREE_BITS) -> DataFrame:
    """key, mark (a hash of the text) and fp (binary) of every row; a null text has no words."""
    rows = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("mark"), df[text].alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = pa.array([fingerprint(t, settings) for t in part.column(2).to_pylist()], type=pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["key", "mark", "fp"])

    return rows.mapInArrow(hashed, f"key {kind}, mark long, fp binary")


def lanes_of(column, lanes: int) -> np.ndarray:
    """An Arrow column of fingerprints as rows of 64-bit lanes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, lanes)


def bytes_of(fps: np.ndarray) -> pa.Array:
    data = fps.astype(">u8").tobytes()
    width = 8 * fps.shape[1]
    return pa.array([data[i : i + width] for i in range(0, len(data), width)], type=pa.binary())


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Where fingerprints stand in the Gray code: each bit is the parity of itself and all above."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    carry = np.zeros(len(fps), dtype=bool)
    for lane in range(fps.shape[1]):
        parity = (rank[:, lane] & np.uint64(1)).astype(bool)
        rank[:, lane] = np.where(carry, ~rank[:, lane], rank[:, lane])
        carry ^= parity
    return rank


def gray_order(fps: np.ndarray) -> np.ndarray:
    rank = gray_rank(fps)
    return np.lexsort([rank[:, lane] for lane in reversed(range(rank.shape[1]))])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class GrayIndex:
    """The hierarchy over fingerprints in Gray order; level 0 are the fingerprints themselves."""

    def __init__(self, fps: np.ndarray):
        shared = np.full_like(fps, ~np.uint64(0))
        self.levels = [(fps, shared)]  # pattern and mask of each node
        fan = LEAF
        while len(self.levels[-1][0]) > FAN:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), fan)
            ones = np.bitwise_and.reduceat(pattern & mask, at)
            zeros = np.bitwise_and.reduceat(~pattern & mask, at)
            self.levels.append((ones, ones | zeros))
            fan = FAN
        self.fans = [LEAF] + [FAN] * len(self.levels)

    def links(self, first: int, last: int, max_bits: int):
        """(i, j) with i in [first, last), i < j, of fingerprints that differ in max_bits or fewer."""
        fps = self.levels[0][0]
        top = len(self.levels) - 1
        queries, nodes = np.meshgrid(np.arange(first, last), np.arange(len(self.levels[top][0])), indexing="ij")
        queries, nodes = queries.ravel(), nodes.ravel()
        above = np.zeros((len(nodes), fps.shape[1]), dtype=np.uint64)  # bits that upper nodes settled
        sums = np.zeros(len(nodes), dtype=np.int64)
        for level in range(top, -1, -1):
            pattern, mask = self.levels[level]
            settled = mask[nodes] & ~above
            sums = sums + np.bitwise_count((fps[queries] ^ pattern[nodes]) & settled).sum(axis=1, dtype=np.int64)
            keep = np.flatnonzero(sums <= max_bits)
            queries, nodes, sums = queries[keep], nodes[keep], sums[keep]
            if level == 0:
                later = nodes > queries
                return queries[later], nodes[later]
            above = above[keep] | settled[keep]
            fan = self.fans[level - 1]
            size = len(self.levels[level - 1][0])
            width = np.minimum(fan, size - nodes * fan)
            from_node = np.repeat(np.arange(len(nodes)), width)
            within = np.arange(len(from_node)) - np.repeat(np.cumsum(width) - width, width)
            nodes = nodes[from_node] * fan + within
            queries, sums, above = queries[from_node], sums[from_node], above[from_node]


def merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j; a label is the smallest number of its component."""
    while True:
        low = np.minimum(labels[i], labels[j])
        if (labels[i] == low).all() and (labels[j] == low).all():
            return labels
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def grouped_links(groups: np.ndarray, fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels of the components that links inside each group make; groups stand together."""
    labels = np.arange(len(fps))
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(groups)]]))
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of <= LEAF))
    for shift in range(1, min(LEAF, len(small))):  # every row with the row ``shift`` places on
        a, b = small[:-shift], small[shift:]
        same = groups[a] == groups[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        near = distance(fps[a], fps[b]) <= max_bits
        labels = merged(labels, a[near], b[near])
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
        order = start + gray_order(fps[start : start + size])
        index = GrayIndex(fps[order])
        for first in range(0, size, 256):
            i, j = index.links(first, min(size, first + 256), max_bits)
            labels = merged(labels, order[i], order[j])
    return labels


def linked_in_groups(rows: DataFrame, group: list[str], settings: Settings) -> DataFrame:
    """(fp, other): a fingerprint and the first of its component in the group, for all but that one.

    ``rows`` has the columns ``group`` and ``fp``; a group never holds more than 2 BLOCK rows.
    """
    dealt = rows.select(*group, "fp").repartition(*group).sortWithinPartitions(*group, "fp")
    narrow = dealt.select(F.xxhash64(*group).alias("group"), "fp") if len(group) > 1 else dealt.toDF("group", "fp")

    def edges(groups, fps):
        labels = grouped_links(groups, fps, settings.max_bits)
        member = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays(
            [bytes_of(fps[member]), bytes_of(fps[labels[member]])], names=["fp", "other"]
        )

    def search(batches):
        groups, fps = np.zeros(0, dtype=np.int64), np.zeros((0, settings.lanes), dtype=np.uint64)
        for batch in batches:
            groups = np.concatenate([groups, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, lanes_of(batch.column(1), settings.lanes)])
            whole = np.flatnonzero(groups != groups[-1]) if len(groups) else []
            if len(whole):  # the last group may go on in the next batch
                cut = whole[-1] + 1
                yield edges(groups[:cut], fps[:cut])
                groups, fps = groups[cut:], fps[cut:]
        if len(groups):
            yield edges(groups, fps)

    return narrow.mapInArrow(search, "fp binary, other binary")


def banded(fps: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, fp): a row per band of every fingerprint."""

    def bands(batches):
        powers = 1 << np.arange(settings.band_bits, dtype=np.int64)[::-1]
        used = settings.bands * settings.band_bits
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                found = lanes_of(part.column(0), settings.lanes)
                bits = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(len(found), -1), axis=1)[:, :used]
                values = bits.reshape(len(found), settings.bands, settings.band_bits) @ powers
                buckets = values + (np.arange(settings.bands, dtype=np.int64) << settings.band_bits)
                rows = np.repeat(np.arange(len(found)), settings.bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets.ravel()), part.column(0).take(pa.array(rows))], names=["bucket", "fp"]
                )

    return fps.select("fp").mapInArrow(bands, "bucket long, fp binary")


def block_pairs(hot: DataFrame, settings: Settings) -> DataFrame:
    """(left, right, fp): rows of hot buckets, once for each pair of blocks that may hold a link."""

    def ranked(batches):
        for batch in batches:
            rank = bytes_of(gray_rank(lanes_of(batch.column(1), settings.lanes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, rank], names=["bucket", "fp", "rank"])

    rows = in_order(hot.mapInArrow(ranked, "bucket long, fp binary, rank binary"), ["bucket", "rank"], label="gray")
    rows = rows.withColumn("block", F.expr(f"position div {BLOCK}"))
    words = [F.conv(F.hex(F.substring("fp", 8 * i + 1, 8)), 16, -10).cast("long") for i in range(settings.lanes)]
    # The node of a block: which bits all of its fingerprints share, and how they are set.
    ones = [F.bit_and(w).alias(f"ones{i}") for i, w in enumerate(words)]
    zeros = [F.bit_and(F.bitwise_not(w)).alias(f"zeros{i}") for i, w in enumerate(words)]
    nodes, _ = stored(rows.groupBy("bucket", "block").agg(*ones, *zeros), "nodes")
    others = nodes.select("bucket", *(F.col(c).alias(f"o_{c}") for c in nodes.columns if c != "bucket"))
    apart = sum(
        F.bit_count(F.col(f"ones{i}").bitwiseAND(F.col(f"o_zeros{i}")))
        + F.bit_count(F.col(f"zeros{i}").bitwiseAND(F.col(f"o_ones{i}")))
        for i in range(settings.lanes)
    )
    pairs = nodes.join(others, "bucket").filter((F.col("block") <= F.col("o_block")) & (apart <= settings.max_bits))
    pairs, _ = stored(pairs.select("bucket", F.col("block").alias("left"), F.col("o_block").alias("right")), "pairs")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("left", "right"))))
    return rows.join(sides, ["bucket", "block"]).select("bucket", "left", "right", "fp")


def links(fps: DataFrame, settings: Settings) -> DataFrame:
    """(fp, other) rows that connect all linked fingerprints of ``fps``, which are distinct."""
    rows = banded(fps, settings)
    rows, path = stored(rows, "bands")
    sizes = rows.groupBy("bucket").count().filter(F.col("count") > BLOCK).select("bucket")
    hot, hot_path = stored(sizes, "hot-buckets")
    if hot.isEmpty():
        found, _ = stored(linked_in_groups(rows, ["bucket"], settings), "links")
    else:
        cold = linked_in_groups(rows.join(hot, "bucket", "left_anti"), ["bucket"], settings)
        pairs = block_pairs(rows.join(hot, "bucket", "left_semi").select("bucket", "fp"), settings)
        found, _ = stored(cold.unionAll(linked_in_groups(pairs, ["bucket", "left", "right"], settings)), "links")
    free(rows.sparkSession, path, hot_path)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(fp, label) for every node of (fp, other) edges: the smallest node that it can reach.

    Each round hooks every node to the smallest among itself and its neighbours, follows one more
    hook, and contracts the edges to those between different labels, which leaves few after the
    first round. Hooks only lead to smaller nodes, so the last label of a component is its
    smallest node. Each step is a stored table, so plans stay short, a lost executor costs one
    step, and both sides of each join can be split where a node is busy.
    """
    spark = edges.sparkSession
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]

    def contracted(ends: DataFrame) -> tuple[DataFrame, str]:
        return stored(ends.filter("u <> v").select(*pair).distinct(), "pairs")

    pairs, path = contracted(edges.select(F.col("fp").alias("u"), F.col("other").alias("v")))
    labels, label_path = None, None
    while True:
        both = pairs.toDF("fp", "near").unionAll(pairs.select(F.col("v").alias("fp"), F.col("u").alias("near")))
        hooked = both.groupBy("fp").agg(F.least("fp", F.min("near")).alias("label"))
        hooked, hooked_path = stored(hooked, "hooked")
        further = hooked.select(F.col("fp").alias("label"), F.col("label").alias("further"))
        step, step_path = stored(hooked.join(further, "label").select("fp", F.col("further").alias("label")), "step")
        old_paths = [path, hooked_path, *([label_path] if label_path else [])]
        if labels is None:
            labels, label_path = stored(step, "labels")
        else:
            more = step.select(F.col("fp").alias("label"), F.col("label").alias("new"))
            moved = labels.join(more, "label", "left").select("fp", F.coalesce("new", "label").alias("label"))
            labels, label_path = stored(moved, "labels")
        ends = pairs.join(step.toDF("u", "lu"), "u").select("lu", "v")
        ends = ends.join(step.toDF("v", "lv"), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
        pairs, path = contracted(ends)
        free(spark, *old_paths, step_path)
        if pairs.isEmpty():
            free(spark, path)
            return labels


def near_duplicates(df: DataFrame, key: str, text: str, settings: Settings = THREE_BITS) -> DataFrame:
    """key, mark, fp, root and component of every row: the smallest key that links lead to.

    ``root`` is the smallest fingerprint of the component and names it even without keys. Texts
    without words have the zero fingerprint, linked like any other. Repeated rows each give a row.
    Null keys count only where a component has no other. An empty frame gives no rows; further
    columns are not read.
    """
    spark = df.sparkSession
    rows = fingerprints(df, key, text, settings)
    rows, _ = stored(rows, "fingerprints")
    labels = components(links(rows.select("fp").distinct(), settings))
    labelled = rows.groupBy("fp").agg(F.min("key").alias("least")).join(labels, "fp", "left")
    labelled, path = stored(labelled.withColumn("label", F.coalesce("label", "fp")), "labelled")
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    least, least_path = stored(least, "components")
    classes, _ = stored(labelled.select("fp", "label").join(least, "label"), "classes")
    free(spark, path, least_path)
    return rows.join(classes, "fp").select(F.col("key").alias(key), "mark", "fp", F.col("label").alias("root"), "component")


def first_of_groups(df: DataFrame, key: str, text: str, settings: Settings = THREE_BITS) -> DataFrame:
    """The rows of ``df`` that have the smallest key of their component; repeated rows stay once.

    Of rows with equal keys and texts, one stays. Where several texts share the smallest key of
    a component, the one of the least hash stays. Rows with a null key stay only in components
    without other keys. All columns are kept.
    """
    found = near_duplicates(df, key, text, settings)
    own = F.struct(F.col(key).alias("key"), F.col("mark"))
    best = found.filter(F.col(key).eqNullSafe(F.col("component")))
    keep = best.groupBy("root").agg(F.min(own).alias("own"), F.count("*").alias("rows"))
    keep, _ = stored(keep.select("own.key", "own.mark", "rows"), "kept")
    marked = df.withColumn("_mark", F.xxhash64(df[text]))
    chosen = marked.join(
        keep.select(F.col("key").alias("_key"), F.col("mark").alias("_kept")),
        marked[key].eqNullSafe(F.col("_key")) & (marked["_mark"] == F.col("_kept")),
        "left_semi",
    )
    if not keep.filter("rows > 1").isEmpty():
        chosen = chosen.dropDuplicates([key, "_mark"])
    return chosen.select(*df.columns)
