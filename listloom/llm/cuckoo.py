"""Operator 12: exact dedup by an index of cuckoo filters that takes insertions and deletions.

Texts are equal when they are identical without the white space of ``WORD_SEPARATORS``; a SHA-256 digest of what is left
stands for them. The index has 2^bits buckets by the leading bits of the digest. A bucket holds the live digests with the
number of rows that have each and the row that stays (its content), and a cuckoo filter over them. Arriving digests are
probed in the bucket's filter: a miss is new, a hit is verified against the bucket's content (the filter errs about twice
in 10,000 probes), and what wasn't there is inserted. A filter that overflows is built anew, twice as large, from the
digests stored in its bucket; an index whose buckets have become too full is dealt out to more of them, from the same
digests. Rows that leave the corpus are taken out of the counts; the next best row of the text takes over, and a digest of
which no row is left is deleted from filter and content.

At scale: texts never move, only (id, digest, length), about 60 bytes a row. Equal digests are summed in part before they are
shuffled, in ``ARRIVALS`` portions dealt by a hash of the id, so a text that a third of all rows share reaches its bucket as
``ARRIVALS`` rows; each portion is one vectorised round of insertions. Rows learn about their group by a join on the
digest, in which groups that very many rows share are broadcast (``common.joined_by_key``).
Every table is written to the shared folder, so nothing depends on a lost executor, and an index is never changed in place.

Defined results: null counts as empty, and empty and blank texts are equal; repeated rows are rows of their own, of which
one stays; a null id comes last among rows of one length; other columns are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_by_key, mix64, ship, small, stored, table

#: Buckets at least, and digests in a bucket beyond which the index gets more.
LEAST_BITS, KEYS = 10, 65_536
ARRIVALS = 8
BROADCAST_ROWS = 500_000
SLOTS = 4
ROUNDS = 200
U = np.uint64


class CuckooFilter:
    """A set of 64-bit keys, approximately: 16-bit fingerprints in two possible buckets of SLOTS each."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def of(cls, keys: np.ndarray, least: int = 64) -> CuckooFilter:
        """A filter that holds ``keys``, as small as they let it be (``least`` places or more)."""
        size = max(least, SLOTS)
        while True:
            if size * 0.9 >= len(keys):
                made = cls(np.zeros((size // SLOTS, SLOTS), np.uint16))
                if made.insert(keys):
                    return made
            size *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).astype(np.uint16))

    def to_bytes(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (mix64(mark.astype(U) * U(0x9E3779B97F4A7C15)) & U(len(self.slots) - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(keys.astype(U))
        mark = np.maximum(h >> U(48), U(1)).astype(np.uint16)
        at = (h & U(len(self.slots) - 1)).astype(np.int64)
        return mark, at, self._other(at, mark)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Inserts all keys, in rounds over those still without a place. False: it overflowed and is of no more use."""
        mark, at, _ = self._places(keys)
        for k in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            at, mark = at[order], mark[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            free = self.slots[at] == 0
            fits = rank < free.sum(axis=1)
            slot = (np.cumsum(free[fits], axis=1) == rank[fits, None] + 1).argmax(axis=1)
            self.slots[at[fits], slot] = mark[fits]
            at, mark = at[~fits], mark[~fits]
            if not len(at):
                return True
            if k:  # one of a full bucket's fingerprints gives way
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                out = (k * 7 + at[first]) % SLOTS
                mark[first], self.slots[at[first], out] = self.slots[at[first], out], mark[first]
            at = self._other(at, mark)
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Removes keys that were inserted."""
        mark, a, b = self._places(keys)
        for m, i, j in zip(mark.tolist(), a.tolist(), b.tolist(), strict=True):
            at = i if (self.slots[i] == m).any() else j
            found = np.flatnonzero(self.slots[at] == m)
            if not len(found):
                raise ValueError("a key to remove was never inserted")
            self.slots[at, found[0]] = 0


def filter_keys(digests: list[bytes]) -> np.ndarray:
    """The 64 bits of each digest that its filter sees; the bucket is told by others."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), dtype=">u8").astype(U)


class Bucket:
    """One bucket: content (digest -> number of rows and the row that stays) and the filter over its digests."""

    def __init__(self, content: dict[bytes, tuple[int, tuple]], filter_: CuckooFilter | None = None):
        self.content = content
        self.filter = filter_ or CuckooFilter.of(filter_keys(list(content)))

    def held(self, digests: list[bytes]) -> tuple[np.ndarray, list[bool]]:
        """What the filter says of each digest, and whether the content confirms it."""
        hit = self.filter.contains(filter_keys(digests))
        return hit, [bool(h) and d in self.content for h, d in zip(hit.tolist(), digests, strict=True)]

    def insert(self, rows: list[tuple[bytes, int, tuple]]) -> None:
        """Adds rows (digest, number, best row), each digest once."""
        _, held = self.held([r[0] for r in rows])
        new = []
        for (digest, n, row), there in zip(rows, held, strict=True):
            if there:
                before, best = self.content[digest]
                self.content[digest] = (before + n, min(best, row))
            else:
                self.content[digest] = (n, row)
                new.append(digest)
        if new and not self.filter.insert(filter_keys(new)):
            self.filter = CuckooFilter.of(filter_keys(list(self.content)), 2 * self.filter.slots.size)

    def replace(self, rows: list[tuple[bytes, int, tuple | None]]) -> None:
        """Sets number and best row of live digests; those of which no row is left are deleted."""
        gone = [d for d, n, _ in rows if not n]
        self.content.update({d: (n, row) for d, n, row in rows if n})
        for d in gone:
            del self.content[d]
        self.filter.remove(filter_keys(gone))


#: ``none`` is 1 for a null id, so that rows compare by (-chars, none, doc, batch, row): the least stays.
ROW = ["less", "none", "doc", "batch", "row"]
ROW_TYPES = "less long, none int, doc long, batch int, row long"
LIVE = f"bucket long, digest binary, n long, {ROW_TYPES}, filter binary"
FOUND = f"digest binary, hit boolean, live boolean, n long, {ROW_TYPES}"


def _bucket_of(content: pa.Table) -> Bucket:
    x = content.to_pydict()
    rows = zip(*(x[c] for c in ROW), strict=True)
    live = {d: (n, row) for d, n, row in zip(x["digest"], x["n"], rows, strict=True) if d is not None}
    data = next((f for f in x["filter"] if f is not None), None)
    return Bucket(live, CuckooFilter.from_bytes(data) if data is not None else None)


def _updated(content: pa.Table, arrivals: pa.Table) -> pa.Table:
    """A task's work on one bucket: arrivals by portion; portion -1 replaces."""
    number = (content if content.num_rows else arrivals).column("bucket")[0].as_py()
    bucket = _bucket_of(content)
    x = arrivals.to_pydict()
    portions: dict[int, list] = {}
    for portion, d, n, *row in zip(x["portion"], x["digest"], x["n"], *(x[c] for c in ROW), strict=True):
        portions.setdefault(portion, []).append((d, n, tuple(row) if n else None))
    for portion in sorted(portions):
        (bucket.replace if portion < 0 else bucket.insert)(portions[portion])
    digests = list(bucket.content)
    columns = {"bucket": [number] * (len(digests) + 1), "digest": [*digests, None], "n": [*(bucket.content[d][0] for d in digests), None]}
    for k, c in enumerate(ROW):
        columns[c] = [*(bucket.content[d][1][k] for d in digests), None]
    columns["filter"] = [*([None] * len(digests)), bucket.filter.to_bytes()]
    return pa.table(columns, schema=_schema(LIVE))


def _probed(content: pa.Table, asked: pa.Table) -> pa.Table:
    bucket, digests = _bucket_of(content), asked.column("digest").to_pylist()
    hit, held = bucket.held(digests)
    of = [bucket.content[d] if h else (None, [None] * len(ROW)) for d, h in zip(digests, held, strict=True)]
    columns = {"digest": digests, "hit": hit.tolist(), "live": held, "n": [n for n, _ in of]} | {c: [row[k] for _, row in of] for k, c in enumerate(ROW)}
    return pa.table(columns, schema=_schema(FOUND))


def _schema(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, types[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def digest_of(text: Column) -> Column:
    """SHA-256 of a text without its white space."""
    return F.unhex(F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", ""), "UTF-8"), 256))


def digests(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """digest, less (minus the code points of the text), none, doc of every row, and ``more``."""
    id_, t = F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))
    return docs.select(digest_of(t).alias("digest"), (-F.length(t)).cast("long").alias("less"), id_.isNull().cast("int").alias("none"), id_.alias("doc"), *more)


def bucket_of(digest: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long"), 48 - bits)


@dataclass(frozen=True)
class Index:
    """An index of all rows added and not removed. ``members``: a row of digests() each, with its batch and number in it;
    ``live``: content and filters by bucket."""

    members: DataFrame
    live: DataFrame
    bits: int = LEAST_BITS
    batches: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Index:
        return cls(spark.createDataFrame([], f"digest binary, {ROW_TYPES}"), spark.createDataFrame([], LIVE))

    def _with(self, members: DataFrame, arrivals: DataFrame, **changes) -> Index:
        """``arrivals``: portion, digest, n and the best row."""
        ship(members.sparkSession)
        arrivals = arrivals.select("portion", bucket_of(F.col("digest"), self.bits).alias("bucket"), "digest", "n", *ROW)
        live = self.live.groupBy("bucket").cogroup(arrivals.groupBy("bucket")).applyInArrow(_updated, LIVE)
        return replace(self, members=members, live=stored(live, "live"), **changes)

    def added(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
        """The index with all rows of ``docs``."""
        new = digests(docs, doc_id, text).select("digest", "less", "none", "doc", F.lit(self.batches).alias("batch"), F.monotonically_increasing_id().alias("row"))
        new = stored(new, "digests")
        members = self.members.unionByName(new) if self.batches else new
        full = self._dealt(members.count())
        portion = F.pmod(F.xxhash64("doc", "row"), F.lit(ARRIVALS)).cast("int")
        summed = new.groupBy("digest", portion.alias("portion")).agg(F.count("*").alias("n"), F.min(F.struct(*ROW)).alias("best"))
        return full._with(members, summed.select("portion", "digest", "n", "best.*"), batches=self.batches + 1)

    def _dealt(self, rows: int) -> Index:
        """The index with enough buckets for ``rows`` rows; the filters of new ones are made from the digests."""
        bits = self.bits
        while rows > KEYS << bits:
            bits += 2
        if bits == self.bits:
            return self
        live = self.live.filter("digest is not null").withColumn("bucket", bucket_of(F.col("digest"), bits))
        return replace(self, live=live, bits=bits)

    def removed(self, ids: DataFrame, doc_id: str = "doc_id") -> Index:
        """The index without the rows whose id is in ``ids``."""
        ids = small(ids.select(F.col(doc_id).cast("long").alias("_gone")).distinct(), BROADCAST_ROWS)
        same = F.col("doc").eqNullSafe(F.col("_gone"))
        gone = stored(self.members.join(ids, same, "left_semi").select(F.col("digest").alias("_d")).distinct(), "gone-digests")
        left = stored(self.members.join(ids, same, "left_anti"), "members")
        met = left.join(small(gone, BROADCAST_ROWS), F.col("digest") == F.col("_d"), "left_semi")
        met = met.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*ROW)).alias("best"))
        now = gone.join(met, F.col("_d") == F.col("digest"), "left").select(F.lit(-1).alias("portion"), F.col("_d").alias("digest"), F.coalesce("n", F.lit(0)).alias("n"), "best.*")
        return self._with(left, now)

    def found(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, hit (the filter's answer), live (verified), n, keep_id of every row of ``docs``, which aren't added."""
        ship(docs.sparkSession)
        asked = stored(digests(docs, doc_id, text), "asked")
        bucket = bucket_of(F.col("digest"), self.bits).alias("bucket")
        once = asked.select(bucket, "digest").distinct()
        answers = stored(self.live.groupBy("bucket").cogroup(once.groupBy("bucket")).applyInArrow(_probed, FOUND), "answers")
        sizes = asked.groupBy("digest").agg(F.count("*").alias("asking"))
        told = answers.join(sizes, "digest").select("digest", "asking", F.struct("hit", "live", "n", F.col("doc").alias("keep_id")).alias("told"))
        return joined_by_key(asked, told, "digest", "asking", asked.count(), BROADCAST_ROWS).select(F.col("doc").alias("doc_id"), "told.*")

    def groups(self) -> DataFrame:
        """digest, n, keep (the row that stays) of every live text."""
        return self.live.filter("digest is not null").select("digest", "n", F.struct(*ROW).alias("keep"))

    def decisions(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
        several = joined_by_key(self.members, stored(self.groups().filter("n > 1"), "groups"), "digest", "n", self.members.count(), BROADCAST_ROWS)
        alone = F.col("keep").isNull()
        kept = alone | ((F.col("keep.batch") == F.col("batch")) & (F.col("keep.row") == F.col("row")))
        return several.select(
            F.col("doc").alias("doc_id"), F.when(alone, F.col("doc")).otherwise(F.col("keep.doc")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in text, length and id one of them."""
    index = Index.empty(docs.sparkSession).added(docs, doc_id, text)
    groups = stored(index.groups().filter("n > 1"), "groups")
    # a row is one struct, so that no name of its columns meets one of those made here
    rows = joined_by_key(digests(docs, doc_id, text, F.struct("*").alias("whole")), groups, "digest", "n", index.members.count(), BROADCAST_ROWS)
    stays = F.struct("less", "none", "doc").eqNullSafe(F.struct("keep.less", "keep.none", "keep.doc"))
    several = rows.filter(F.col("keep").isNotNull() & stays).dropDuplicates(["digest"])
    return rows.filter("keep is null").unionByName(several).select(*[F.col("whole")[c].alias(c) for c in docs.columns])


def op12_cuckoo_dedup(spark, sf_dir):
    return Index.empty(spark).added(table(spark, sf_dir, "documents")).decisions()


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
