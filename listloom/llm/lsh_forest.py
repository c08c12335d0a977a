"""Operator 10: MinHash near-duplicate groups by an LSH forest.

Each text's distinct word shingles are hashed; TREES * DEPTH minima make its signature, DEPTH of them for each tree. Texts
with equal shingle sets are one text from the start (an equality join on a 128-bit digest). In each tree the others are
ordered by their part of the signature; the ones with a common prefix are neighbours. Grouping by the prefix finds the same
neighbours as sorting by it and needs no sort of all texts. The prefix starts at MIN_DEPTH and is lengthened region by
region, while the region is over REGION texts or SHINGLES shingles, so that hot groups are split and thin ones keep their
recall. Regions with the same members in several trees are compared once. A region that the whole signature can't split is
dealt into parts by a hash, and its first text joins every part.

The first FIRST_TREES trees are searched first. What they link is one component from then on, so of the other trees only
regions that hold several components are looked at, and most texts of a group of copies are shuffled a few times only.

Within a region all links are found exactly, on whole shingle sets: shared shingles by matrix products over the shingles
that two or more of its texts have. A region sends on one row for each text, its smallest neighbour in the region, never
pairs. Components are the limit of smallest labels over these links, with pointer jumping, in rounds that are written out.

Splitting may part texts that are linked. So a split region whose members don't end as one component is searched again,
exactly: those outside its largest component are compared with all of its members, in blocks. Regions around the same
component in several trees are one pool, compared once. The blocks cost (texts outside * all texts / REGION) rows.

Two texts with Jaccard similarity s share MIN_DEPTH minima in none of the trees with probability (1 - s^MIN_DEPTH)^TREES:
2e-7 at 0.85, 1e-5 at 0.8. Memory of a task: REGION texts of together SHINGLES shingles (twice that in a block; or one
text and its neighbour, if they are longer), and a matrix of REGION x REGION (or twice that each way).

Defined results: null, empty and blank texts have no shingles and are linked with nothing; with fewer words than a shingle
the whole sequence is the one shingle; every row is a document and has a row in the result, those that repeat another and
those that share its id too; a null id comes last; an empty table gives an empty result. Words and shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, mix64, ship, small, stored, table, text_bytes, word_hashes, word_spans

TREES, DEPTH, MIN_DEPTH, FIRST_TREES = 16, 8, 3, 4
DEPTHS = DEPTH - MIN_DEPTH + 1
REGION, SHINGLES = 1024, 1_000_000
#: Regions' members (16 bytes a row) and groups of equal sets are broadcast up to this many rows; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_random = np.random.default_rng(77)
_A = _random.integers(1, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _random.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
U = np.uint64


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text."""
    data, offsets = text_bytes(column)
    out: list[np.ndarray] = []
    for a, b in blocks(offsets):
        part = offsets[a : b + 1] - offsets[a]
        own = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = word_spans(own, part)
        words = word_hashes(own, starts, ends)
        rolled = np.zeros(len(words), dtype=np.uint64)
        for k in range(n):
            rolled[: len(words) - k] = mix64(rolled[: len(words) - k] * U(31) + words[k:])
        for d in range(b - a):
            i, j = first[d], first[d + 1]
            if j - i >= n:
                out.append(np.unique(rolled[i : j - n + 1]))
            elif j > i:
                h = np.zeros(1, dtype=np.uint64)
                for w in words[i:j]:
                    h = mix64(h * U(37) + w)
                out.append(h + U(j - i))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima, unsigned 32-bit."""
    low = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    folded = (hashes ^ (hashes >> U(32))).astype(np.uint32)
    for k in range(0, len(folded), 2048):
        x = folded[k : k + 2048, None] * _A + _B
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def signed(docs: DataFrame, n: int, depths: int = 1) -> DataFrame:
    """doc, n_shingles, d1, d2 (digest of the set), prefixes (hashes of the signature's prefixes of the first ``depths``
    depths from MIN_DEPTH, tree by tree)."""

    def sign(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), n)
            digests = np.array([(np.bitwise_xor.reduce(mix64(s)), s.sum(dtype=np.uint64) ^ U(len(s))) if len(s) else (0, 0) for s in sets], dtype=np.uint64).reshape(-1, 2)
            sigs = np.stack([signature(s) for s in sets]).reshape(-1, TREES, DEPTH).astype(np.uint64) if sets else np.zeros((0, TREES, DEPTH), np.uint64)
            h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15), sigs.shape[:2]).copy()
            prefixes = []
            for k in range(MIN_DEPTH - 1 + depths):
                h = mix64(h * U(33) + sigs[:, :, k] + U(k + 1))
                if k + 1 >= MIN_DEPTH:
                    prefixes.append(h)
            flat = np.stack(prefixes, axis=2).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TREES * depths), pa.array(flat))
            columns = [batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(digests[:, k].view(np.int64)) for k in (0, 1)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_shingles", "d1", "d2", "prefixes"])

    return docs.mapInArrow(sign, "doc long, n_shingles long, d1 long, d2 long, prefixes array<long>")


def regions_of(rows: DataFrame) -> DataFrame:
    """tree, key, size, weight (shingles), least of the keys that several of ``rows`` (tree, key, doc, n_shingles) have. A
    set of members is one region, whatever the trees it comes from: the first of these."""
    sizes = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), F.min("tree").alias("tree"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who"), F.min("doc").alias("least")
    ).filter("size > 1")
    return sizes.groupBy("size", "who", "least").agg(F.min(F.struct("tree", "key", "weight")).alias("x")).select("x.*", "size", "least")


def too_large() -> Column:
    return (F.col("size") > REGION) | ((F.col("weight") > SHINGLES) & (F.col("size") > 2))


def parted(size: Column, weight: Column) -> Column:
    """Into how many parts to deal texts."""
    return F.least(F.greatest(F.ceil(size / (REGION - 1)), F.ceil(weight / SHINGLES)), size).cast("int")


def deepened(hot: DataFrame, deep: DataFrame) -> DataFrame:
    """region, doc: the regions of ``hot`` (doc, n_shingles, tree, key), which are too large, at the depth that each needs.
    ``deep``: doc, prefixes of all depths."""
    rows, found = hot, []
    for depth in range(1, DEPTHS):
        at_depth = deep.select("doc", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.get("prefixes", t * DEPTHS + depth))).alias("tree", "next"))  # noqa: B023
        rows = stored(rows.join(at_depth, ["doc", "tree"]).select("doc", "n_shingles", "tree", F.col("next").alias("key")), "deeper")
        sizes = stored(regions_of(rows), "deeper-regions")
        found.append(rows.join(sizes.filter(~too_large()).select("key"), "key").select(F.col("key").alias("region"), "doc"))
        rows = rows.join(sizes.filter(too_large()).select("key"), "key", "left_semi")
        if sizes.filter(too_large()).isEmpty():
            break
    else:
        # equal in the whole tree: dealt out, the first text goes to every part
        sizes = sizes.filter(too_large()).withColumn("parts", parted(F.col("size"), F.col("weight")))
        dealt = rows.join(sizes.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
        found.append(dealt.select(F.xxhash64("key", "part").alias("region"), "doc"))
        every = sizes.select("key", "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        found.append(every.select(F.xxhash64("key", "part").alias("region"), F.col("least").alias("doc")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def named(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``members`` with the label of each doc: its component so far, itself at first."""
    if labels is None:
        return members.withColumn("label", F.col("doc"))
    known = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return members.join(small(known, BROADCAST_ROWS), F.col("doc") == F.col("_n"), "left").withColumn("label", F.coalesce("_c", "doc")).drop("_n", "_c")


def unsettled(members: DataFrame, labels: DataFrame | None, region: str = "region") -> DataFrame:
    """The rows of ``members`` in regions that hold several components."""
    if labels is None:
        return members
    several = named(members, labels).groupBy(F.col(region).alias("_r")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("_r")
    return members.join(several, F.col(region) == F.col("_r"), "left_semi")


def pools(split: DataFrame, labels: DataFrame) -> DataFrame:
    """region, doc: what to compare so that no link between different components of a split region (region, doc,
    n_shingles) is missed: in each, texts outside the largest component with all."""
    rows = named(split, labels)
    counts = rows.groupBy("region", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("region").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label"))["label"].alias("pool")).filter("labels > 1").select("region", "pool")
    # regions around one component are one pool
    met = rows.join(small(largest, BROADCAST_ROWS), "region").groupBy("pool", "doc").agg(F.bool_or(F.col("label") != F.col("pool")).alias("other"), F.first("n_shingles").alias("w"))
    met = stored(met, "pools")
    w, other = F.col("w"), F.col("other")
    sizes = met.groupBy("pool").agg(parted(F.count("*"), F.sum("w")).alias("every"), F.greatest(F.lit(1), parted(F.count_if(other), F.sum(F.when(other, w).otherwise(0)))).alias("others"))
    met = met.join(small(sizes, BROADCAST_ROWS), "pool")
    block = lambda parts: F.pmod(F.xxhash64("doc"), F.col(parts)).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    one = met.select("pool", "doc", block("every").alias("a"), upto("others").alias("b"))
    two = met.filter(other).select("pool", "doc", upto("every").alias("a"), block("others").alias("b"))
    return one.unionByName(two).select(F.xxhash64("pool", "a", "b").alias("region"), "doc").distinct()


def region_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest member of the component of each set, by index, over links of at least ``percent`` similarity. Exact."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    group, owner = group[shared], owner[shared]
    inter = np.zeros((m, m), dtype=np.float32)
    if len(group):
        group = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
        width = max(64, (1 << 22) // m)
        edges = np.searchsorted(group, np.arange(0, group[-1] + 1 + width, width))
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j > i:
                incidence = np.zeros((m, min(width, group[-1] + 1 - k * width)), dtype=np.float32)
                incidence[owner[i:j], group[i:j] - k * width] = 1
                inter += incidence @ incidence.T
    linked = np.zeros((m, m), dtype=bool)
    for i in range(0, m, 256):
        both = inter[i : i + 256].astype(np.float64)
        linked[i : i + 256] = 100 * both >= percent * (sizes[i : i + 256, None] + sizes[None, :] - both)
    label = np.arange(m, dtype=np.int32)
    while True:
        least = np.concatenate([np.where(linked[i : i + 256], label[None, :], np.int32(m)).min(axis=1) for i in range(0, m, 256)])
        least = np.minimum(least, label)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def links(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: each text and the smallest text of its component within a region. ``docs``: doc, text."""
    rows = docs.join(small(members, BROADCAST_ROWS), "doc").repartition(F.col("region")).sortWithinPartitions("region", "doc")

    def compare(batches):
        now, ids, sets = None, [], []
        out: tuple[list, list] = ([], [])

        def close():
            if len(ids) > 1:
                label = region_links(sets, percent)
                for i in np.flatnonzero(label != np.arange(len(ids))):
                    out[0].append(ids[i])
                    out[1].append(ids[label[i]])

        for batch in batches:
            for region, doc, s in zip(batch.column("region").to_pylist(), batch.column("doc").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                if region != now:
                    close()
                    now, ids, sets = region, [], []
                ids.append(doc)
                sets.append(s)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
                out = ([], [])
        close()
        yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return rows.select("region", "doc", "text").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest member) of every node of ``edges`` (a, b)."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        # jump: the label of the label
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        step = stored(step.join(jump, F.col("next") == F.col("_n"), "left").select("node", "label", F.least("next", F.coalesce("_l", "next")).alias("next")), "labels")
        labels = step.select("node", F.col("next").alias("label"))
        if step.filter("next <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with a key of each row in ``_key``: the id, or, of null ids, of ids that several rows share and of ids from
    2^62 on, a number from 2^62 on, so that every row has its own. And whether there are any such ids; their rows are
    written to the shared folder, so that a number stays with its row."""
    id_ = F.col(doc_id).cast("long")
    several = stored(docs.groupBy(id_.alias("_id")).count().filter(f"count > 1 OR _id IS NULL OR _id >= {1 << 62}").select("_id"), "shared-ids")
    one = docs.withColumn("_key", id_)
    if several.isEmpty():
        return one, False
    shared, several = id_.eqNullSafe(F.col("_id")), small(several, BROADCAST_ROWS)
    again = docs.join(several, shared, "left_semi").withColumn("_key", F.lit(1 << 62) + F.monotonically_increasing_id())
    return one.join(several, shared, "left_anti").unionByName(stored(again, "rows-of-shared-ids")), True


def grouped(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """doc, n_shingles, label (the smallest doc of its component) of every row of ``rows`` (doc, distinct and not null; text)."""
    ship(rows.sparkSession)
    all_ = stored(signed(rows, n), "signatures")
    full = all_.filter("n_shingles > 0")
    # equal sets are one text; its smallest document stands for it
    equal = full.groupBy("d1", "d2").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    equal = stored(equal, "equal-sets")
    same = full.select("doc", "d1", "d2").join(small(equal, BROADCAST_ROWS), ["d1", "d2"], "left")
    same = stored(same.select("doc", F.coalesce("least", "doc").alias("least")).filter("doc <> least"), "copies")
    first = full.join(small(same.select("doc"), BROADCAST_ROWS), "doc", "left_anti")
    prefixes = first.select("doc", "n_shingles", F.posexplode("prefixes").alias("tree", "key"))
    regions = stored(regions_of(prefixes), "regions")
    members = stored(prefixes.join(small(regions.filter(~too_large()).select("key"), BROADCAST_ROWS), "key").select("tree", F.col("key").alias("region"), "doc"), "members")
    hot = stored(prefixes.join(small(regions.filter(too_large()).select("key"), BROADCAST_ROWS), "key"), "hot")
    split = not hot.isEmpty()
    if split:
        of_hot = rows.join(small(hot.select("doc").distinct(), BROADCAST_ROWS), "doc", "left_semi")
        deep = stored(signed(of_hot, n, DEPTHS).select("doc", "prefixes"), "hot-signatures")
    edges, labels = None, None

    def link(compared: DataFrame) -> None:
        nonlocal edges, labels
        compared = stored(compared, "compared")
        if not compared.isEmpty():
            new = stored(links(rows, compared, n, percent), "links")
            edges = new if edges is None else edges.unionByName(new)
            labels = components(edges)

    for trees in (F.col("tree") < FIRST_TREES, F.col("tree") >= FIRST_TREES):
        now = unsettled(members.filter(trees), labels).select("region", "doc")
        if split:
            now = now.unionByName(deepened(stored(unsettled(hot.filter(trees), labels, "key"), "hot-now"), deep))
        link(now)
    if split:
        link(pools(hot.select(F.col("key").alias("region"), "doc", "n_shingles"), labels if labels is not None else _no_labels(rows)))
    out = all_.select("doc", "n_shingles").join(same.withColumnRenamed("doc", "_d"), F.col("doc") == F.col("_d"), "left").drop("_d").withColumn("least", F.coalesce("least", "doc"))
    if labels is None:
        return out.withColumnRenamed("least", "label")
    known = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return out.join(known, F.col("least") == F.col("_n"), "left").select("doc", "n_shingles", F.coalesce("_c", "least").alias("label"))


def _no_labels(rows: DataFrame) -> DataFrame:
    return rows.limit(0).select(F.col("doc").alias("node"), F.col("doc").alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component), kept (one row of each component) of every row."""
    docs, shared = keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    out = grouped(docs.select(F.col("_key").alias("doc"), "text"), n, percent)
    if not shared:
        return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("label").alias("component_id"), (F.col("doc") == F.col("label")).alias("kept"))
    # keys aren't ids here: the smallest id of the component stands for it, and one of its rows is kept
    ids = docs.select(F.col("_key").alias("_k"), "doc_id")
    out = stored(out.join(ids, F.col("doc") == F.col("_k")).drop("_k"), "by-key")
    first = out.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")).alias("first"))
    return out.join(first, "label").select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("doc") == F.col("first.doc")).alias("kept"))


def op10_lsh_forest(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)
