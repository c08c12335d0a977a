"""Operator 11: alignment of two tokenizers' tokens by bytes, and how often ids are linked in the corpus.

Both tokenizations of a text cover the same bytes: a space and the text. Each byte has a label: none, the end of a token of
A, the end of one of B, or of both. A regular expression scans the label string for spans up to and with each both-label;
the labels in a span say how many tokens of A and B make a group. Two tokens overlap in exactly one stretch between
neighbouring ends, so the links of a text are its labelled bytes, with the tokens that are open there.

Neither tokenizer makes a token that goes on across the beginning of a run of spaces and line feeds, so texts are cut there
and each distinct part is encoded and labelled once; a text's label string is those of its parts, end to end. A text with other white space or control characters is one part. (That no entry of B's vocabulary has a space or line
feed after another character is checked when it is loaded.) A part whose bytes differ from a tokenizer's leaves its text without
tokens.

Counts cover the corpus and are kept by chunk: a run of documents of about ``CHUNK`` bytes lists its distinct pairs with the
number of its documents that hold each. The lists are summed by pair; every chunk asks for the sums of its own pairs, by one
join, and meets the answers in a group of its own. So no task holds the pairs of the corpus, whose number may go to the
product of the vocabularies, and texts are encoded once and never shuffled. Only the highest count of each id of A, at most
one row an entry of its vocabulary, is broadcast.

Defined results: texts null or empty, or whose bytes a tokenizer changes, have no tokens: zeros, and '' for the hash; rows
that share an id, or have none, are documents of their own and count apart; other columns are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, table
from .tokens import _SPACES as OTHER_SPACES
from .tokens import default_path, encoder

CHUNK = 8 << 20
#: Distinct parts kept by a worker, in two generations: bounds its memory (about 500 bytes each).
KEPT = 300_000
SPACE = "▁"
_PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_SPANS = re.compile(rb"[^c]*c")
_LABELS = bytes.maketrans(b"\0\1\2\3", b".abc")
_loaded: dict[tuple[str, str], Aligner] = {}
#: What a part gives: its groups as text, its links (A id * size of B's vocabulary + B id, 8 bytes each), its tokens of A.
Part = tuple[str, bytes, int]


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible in Latin-1, else the next
    one from U+0100 on."""
    out, more = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD):
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


def labels(n: int, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """The label of each of ``n`` bytes: ``.`` none, ``a`` an end in A, ``b`` one in B, ``c`` both."""
    marks = np.zeros(n, np.uint8)
    marks[a_ends - 1] = 1
    marks[b_ends - 1] += 2
    return marks.tobytes().translate(_LABELS)


def groups(string: bytes) -> list[tuple[int, int]]:
    """Numbers of tokens of A and B in each span of a label string up to a both-label."""
    return [(s.count(b"a") + 1, s.count(b"b") + 1) for s in _SPANS.findall(string)]


def links(string: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and B that overlap, in order: how many have ended before each labelled byte."""
    ends = np.frombuffer(string.replace(b".", b""), np.uint8)
    a, b = ends != 98, ends != 97
    return np.cumsum(a) - a, np.cumsum(b) - b


def saying(string: bytes):
    """What turns the ids of A and then B, of a text with these labels, into its groups as text."""
    sizes = groups(string)
    order, i, j = [], 0, sum(n for n, _ in sizes)
    for n, m in sizes:
        order += [*range(i, i + n), *range(j, j + m)]
        i, j = i + n, j + m
    said = ";".join(",".join(["%d"] * n) + "|" + ",".join(["%d"] * m) for n, m in sizes)
    pick = operator.itemgetter(*order)
    return lambda ids: said % pick(ids)


class Aligner:
    """Encodes and aligns texts by parts; a worker keeps the parts it has met."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = encoder(byte_bpe), SentencePieceProcessor(model_file=pieces)
        of = byte_level_alphabet()
        self.a_bytes = {i: bytes(of[c] for c in t) for t, i in self.a.library.get_vocab(with_added_tokens=False).items() if all(c in of for c in t)}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[1:-1], 16)]) if self.b.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(names)]
        # otherwise texts can't be cut before white space
        self.cuts = not any(re.search(rf"[^{SPACE}]{SPACE}|\n", t) for t in names)
        self.space = self.b.piece_to_id(SPACE)
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.shapes: dict[bytes, Callable] = {}
        self.new: dict[str, Part | None] = {}
        self.old: dict[str, Part | None] = {}

    @staticmethod
    def size_b(pieces: str) -> int:
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=pieces).get_piece_size()

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        """B's ids of parts, whose first space it adds by itself."""
        ids = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        # the space that it adds to a part without one is a token of its own; to nothing it adds none
        return [x[1:] if p[0] != " " else x or [self.space] for p, x in zip(parts, ids, strict=True)]

    def aligned(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> list[Part | None]:
        """The alignment of parts with these ids; None if the tokens' bytes aren't those of the part."""
        data = [p.encode() for p in parts]
        bad = {k for k, (d, x, y) in enumerate(zip(data, a, b, strict=True)) if not b"".join([self.a_bytes[i] for i in x]) == d == b"".join([self.b_bytes[i] for i in y])}
        if bad:
            good = iter(self.aligned(*([x for k, x in enumerate(of) if k not in bad] for of in (parts, a, b))))
            return [None if k in bad else next(good) for k in range(len(parts))]
        # the label strings of all parts, end to end
        flat_a, flat_b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (a, b))
        size = np.cumsum([len(d) for d in data])
        string = labels(size[-1] if len(size) else 0, np.cumsum(self.a_sizes[flat_a]), np.cumsum(self.b_sizes[flat_b]))
        at_a, at_b = links(string)
        keys = (flat_a[at_a] * len(self.b_bytes) + flat_b[at_b]).astype("<i8").tobytes()
        ends = np.cumsum(np.frombuffer(string, np.uint8) != ord("."))[size - 1].tolist()
        string, out, done = string.replace(b".", b""), [], 0
        for x, y, end in zip(a, b, ends, strict=True):
            shape = string[done:end]
            say = self.shapes.get(shape)
            if say is None:
                say = saying(shape)
                if len(shape) < 16:
                    self.shapes[shape] = say
            out.append((say(x + y), keys[8 * done : 8 * end], len(x)))
            done = end
        return out

    def _align_all(self, parts: list[str]) -> list[Part | None]:
        a = [e.ids for e in self.a.library.encode_batch_fast(parts, add_special_tokens=False)]
        return self.aligned(parts, a, self.encode_b(parts))

    def align(self, texts: list[str]) -> list[list[Part | None]]:
        """The parts of each text; none of an empty one."""
        cut = [_PARTS.findall(" " + t) if t and self.cuts and not OTHER_SPACES.search(t) else [] for t in texts]
        if len(self.new) > KEPT // 2:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for p in set().union(*cut):
            if p not in new:
                if p in old:
                    new[p] = old[p]
                else:
                    missing.append(p)
        if missing:
            new.update(zip(missing, self._align_all(missing), strict=True))
        out = [list(map(new.__getitem__, parts)) for parts in cut]
        whole = [i for i, t in enumerate(texts) if t and not cut[i]]
        if whole:
            for i, x in zip(whole, self._align_all([" " + texts[i] for i in whole]), strict=True):
                out[i] = [x]
        return out


def aligner(byte_bpe: str, pieces: str) -> Aligner:
    """The worker's aligner, kept from task to task."""
    if (byte_bpe, pieces) not in _loaded:
        _loaded[byte_bpe, pieces] = Aligner(byte_bpe, pieces)
    return _loaded[byte_bpe, pieces]


TOKENS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Chunk:
    """Documents of a chunk as they come: their columns, and the links of all of them."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.columns: dict[str, list] = {x.split()[0]: [] for x in TOKENS.split(", ")}
        self.links: list[bytes] = []

    def add(self, doc: int | None, parts: list[Part | None], size: int) -> None:
        if None in parts:
            parts = []
        said, keys = ";".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        n_a, n_groups, n_links = sum(p[2] for p in parts), said.count(";") + 1 if parts else 0, len(keys) // 8
        row = (doc, n_a, n_links + n_groups - n_a, n_groups, n_links, hashlib.sha256(said.encode()).hexdigest() if parts else "")
        for c, x in zip(self.columns.values(), row, strict=True):
            c.append(x)
        self.links.append(keys)
        self.bytes += size

    def batches(self):
        """A row for each document with its distinct pairs (places in the chunk's list) and how often it links them; then one
        for the chunk, with its pairs and the number of documents that hold each."""
        n = len(self.links)
        pairs, at = np.unique(np.frombuffer(b"".join(self.links), dtype="<i8"), return_inverse=True)
        doc = np.repeat(np.arange(n), self.columns["n_links"])
        keys, times = np.unique(doc * max(1, len(pairs)) + at, return_counts=True)
        offsets = np.searchsorted(keys, np.arange(n + 1) * max(1, len(pairs))).astype(np.int32)
        at = keys % max(1, len(pairs))
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (at, times)]
        holding = np.bincount(at, minlength=len(pairs)).astype(np.int32)
        number = pa.array([self.number] * n, pa.int64())
        types = [pa.string() if c == "groups_sha256" else pa.int64() for c in self.columns]
        docs = [pa.array(x, t) for x, t in zip(self.columns.values(), types, strict=True)]
        yield pa.RecordBatch.from_arrays([number, *docs, *lists, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], names=NAMES)
        one = [pa.array([x], t) for x, t in ((pairs.tolist(), pa.list_(pa.int64())), (holding.tolist(), pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays([number[:1], *(pa.nulls(1, t) for t in types), *(pa.nulls(1, pa.list_(pa.int32())) for _ in lists), *one], names=NAMES)


CHUNKS = f"chunk long, {TOKENS}, at array<int>, times array<int>, pairs array<long>, holding array<int>"
NAMES = [x.split()[0] for x in CHUNKS.split(", ")]


def chunks(docs: DataFrame, byte_bpe: str, pieces: str, doc_id: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of documents and of chunks, as ``Chunk.batches`` says."""

    def align(batches):
        of, task, made = aligner(byte_bpe, pieces), TaskContext.get().partitionId(), 0
        now = Chunk(task << 32)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for k in range(0, len(ids), 256):
                texts = batch.column("text").slice(k, 256).fill_null("").to_pylist()
                for doc, t, parts in zip(ids[k : k + 256], texts, of.align(texts), strict=True):
                    now.add(doc, parts, len(t))
                    if now.bytes >= chunk:
                        yield from now.batches()
                        made += 1
                        now = Chunk(task << 32 | made)
        if now.links:
            yield from now.batches()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(align, CHUNKS)


def pair_counts(chunked: DataFrame, size_b: int) -> DataFrame:
    """pair, count (documents of the corpus that hold it linked), best (no pair of its A id has a higher count)."""
    held = chunked.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holding")).alias("x"))
    sums = stored(held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holding").alias("count")), "pair-counts")
    a = F.expr(f"pair div {size_b}")
    highest = sums.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))  # a row an entry of A's vocabulary
    return sums.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _counted(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links."""
    order = np.argsort(answers.column("place").to_numpy())
    counts, best = (answers.column(c).combine_chunks().cast(pa.int64()).to_numpy()[order] for c in ("count", "best"))
    at, times = (docs.column(c).combine_chunks() for c in ("at", "times"))
    doc = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    out = []
    for x in (best, counts):
        sums = np.zeros(docs.num_rows, np.int64)
        np.add.at(sums, doc, times * x[at])
        out.append(pa.array(sums))
    return pa.table([*(docs.column(x.split()[0]) for x in TOKENS.split(", ")), *out], names=[*(x.split()[0] for x in TOKENS.split(", ")), "n_best", "count_sum"])


def align(docs: DataFrame, byte_bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row of ``docs``."""
    ship(docs.sparkSession)
    chunked = stored(chunks(docs, byte_bpe, pieces, doc_id, text, chunk), "alignment")
    counts = pair_counts(chunked, Aligner.size_b(pieces))
    asked = chunked.filter("pairs is not null").select(F.col("chunk").alias("asker"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select("asker", "place", "count", "best")
    rows = chunked.filter("pairs is null").drop("pairs", "holding")
    return rows.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(_counted, f"{TOKENS}, n_best long, count_sum long")


def links_of(docs: DataFrame, byte_bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, groups (array of struct<a, b>: numbers of tokens) of every row: the alignment itself."""
    ship(docs.sparkSession)

    def align(batches):
        of = aligner(byte_bpe, pieces)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            a, b, sizes = [], [], []
            for parts in of.align(texts):
                said = [] if None in parts else [g.split("|") for p in parts for g in p[0].split(";")]
                each = [([int(x) for x in g.split(",")], [int(x) for x in h.split(",")]) for g, h in said]
                a.append([x for g, _ in each for x in g])
                b.append([x for _, h in each for x in h])
                sizes.append([{"a": len(g), "b": len(h)} for g, h in each])
            columns = [batch.column("doc_id"), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32())), pa.array(sizes, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "groups"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(align, "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a: int, b: int>>")


def op11_alignment(spark, sf_dir):
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), default_path(), public_tokenizers.path("piece_bpe_32k.model"))
