"""Operator 1: language-model scoring by logistic context mixing over bits.

The text's bytes (A-Z lower-cased, then an end byte) are predicted bit by bit. Six predictors look up how often the next
bit was 0 or 1 after the last 0 to 5 bytes and the bits of this byte so far, in hashed tables; their log odds are combined
by weights gated by the longest context known and the bit's place; an adaptive probability map then refines the result.
All of it is learnt from the training rows only, all of them, and all that is gathered grows with the corpus:

1. texts are cut into chunks of about CHUNK bytes; each chunk sends its distinct grams of six bytes and its distinct words,
   with their counts in training rows, to the regions they belong to (a gram's by its last three context bytes);
2. a region adds the counts of all chunks. The tables of orders 3 to 5 are its own, 16 or more slots for each of its
   grams, and are made anew in whatever task needs them; only orders 0 to 2, whose contexts are 2^16 at most, are
   shared by all (17 MB). Regions grow in number with the corpus, so no task or executor holds the model;
3. the weights learn online, gram by gram in small batches: each is predicted from the counts without itself, as it would
   be before it was seen, then the weights move. Regions start from the same weights and are averaged by mass, EPOCHS
   times; the probability map is counted in the same way with the final weights;
4. a byte's probability depends on its gram alone, so regions answer each chunk with the probabilities of its grams and the
   counts of its words, and the chunk's texts are scored with these.

Defined results: a null text is empty and has its end to predict; a null id counts as the text "" for the split; repeated
rows are scored alike, each for itself; without training rows every bit has probability 1/2 and the base score is 0 for
each token's share of an empty corpus; an empty table gives an empty result. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, filesystem, mix64, new_folder, ship, stored, table, text_bytes, word_hashes, word_spans
from .quality import held_out

ORDER = 5
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
END_WORD = 0x5EED  # stands for the end among word hashes
GRAM, WORD = 0, 1
#: Bytes of text that share one table of answers (a text is never cut), and bytes of corpus a region.
CHUNK, REGION_BYTES, LEAST_REGIONS = 24 << 20, 64 << 20, 64
#: Chunks whose counts are added in one task; those of more are added in two steps.
CHUNKS_AT_ONCE = 1024
MERGE_AT = 1 << 21
LOW_BITS, SLOT_BITS = 21, 4  # slots of order 2, and of the higher orders for each gram of a region
BUCKETS = 33  # of the probability map
PRIOR = 0.3
BATCH, RATE, EPOCHS = 512, 0.02, 3
#: Rows of sums (135 KB each) that one task or the driver adds, at most.
GATHERED = 128
U = np.uint64


# ------------------------------------------------------------------- grams and words of texts


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte grams, as int64, that end at each byte and at the end of each document; each document's first gram."""
    n, docs = np.diff(offsets), len(offsets) - 1
    shift = np.arange(docs) * (ORDER + 1)
    buffer = np.full(len(data) + docs * (ORDER + 1), START, dtype=np.uint8)
    buffer[np.arange(len(data)) + np.repeat(shift + ORDER, n)] = data
    buffer[offsets[1:] + shift + ORDER] = END
    wide = buffer.astype(np.int64)
    keys = wide[ORDER:].copy()
    for back in range(1, ORDER + 1):
        keys |= wide[ORDER - back : len(wide) - back] << (8 * back)
    keys = keys[buffer[ORDER:] != START]
    return keys, offsets[:-1] + np.arange(docs)


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs (or the sum of its weights)."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    if weights is None:
        return values[first], np.diff(np.r_[first, len(values)])
    return values[first], np.add.reduceat(weights, first) if len(first) else weights


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends).view(np.int64), first


# ------------------------------------------------------------------- chunks and regions


def region_of(kind: int, keys: np.ndarray, regions: int) -> np.ndarray:
    """Region of grams (all with the same last three context bytes share one) or of words."""
    x = (keys >> 8) & 0xFFFFFF if kind == GRAM else keys
    return (mix64(x.astype(U) + U(7)) % U(regions)).astype(np.int64)


def lists(of: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    """A list for each run of equal ``of``."""
    ends = np.r_[np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, kind))


def chunked(docs: DataFrame, regions: int) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, text, train, p: their chunk), and what chunks ask of regions: kind, r, p, keys, n (how often in
    training rows; 0: in others only). One pass writes both."""
    kind_of_id = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind_of_id}, text string, train boolean, p long, kind int, r int, keys array<long>, n array<long>"

    def cut(batches):
        part, chunk, size = TaskContext.get().partitionId() << 24, 0, 0
        kept: dict[int, list] = {GRAM: [], WORD: []}
        arrow_id = None

        def merged(kind):
            values, weights = (np.concatenate(x) for x in zip(*kept[kind], strict=True))
            kept[kind] = [counted(values, weights)]

        def requests():
            for kind in (GRAM, WORD):
                if not kept[kind]:
                    continue
                merged(kind)
                keys, n = kept[kind].pop()
                r = region_of(kind, keys, regions)
                order = np.argsort(r, kind="stable")
                r, keys, n = r[order], keys[order], n[order].astype(np.int64)
                first = r[np.r_[True, r[1:] != r[:-1]]]
                m = len(first)
                none = [pa.nulls(m, arrow_id), pa.nulls(m, pa.string()), pa.nulls(m, pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [*none, pa.array(np.full(m, part + chunk)), pa.array(np.full(m, kind, np.int32)), pa.array(first.astype(np.int32)), lists(r, keys, pa.int64()), lists(r, n, pa.int64())], names=NAMES
                )

        for batch in batches:
            arrow_id = batch.column("doc_id").type
            m = batch.num_rows
            none = [pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, part + chunk)), *none], names=NAMES)
            train = batch.column("train")
            for learn in (True, False):
                texts = batch.column("text").filter(train if learn else pc.invert(train))
                data, offsets = text_bytes(texts)
                size += len(data)
                data = LOWER[data]
                for a, b in blocks(offsets, 4 << 20):
                    part_offsets = offsets[a : b + 1] - offsets[a]
                    own = data[offsets[a] : offsets[b]]
                    words, _ = words_of(own, part_offsets)
                    for kind, (v, n) in ((GRAM, counted(grams(own, part_offsets)[0])), (WORD, counted(np.append(words, np.full(b - a, END_WORD, dtype=np.int64))))):
                        kept[kind].append((v, n if learn else np.zeros_like(n)))
                        if sum(len(x) for x, _ in kept[kind]) > MERGE_AT and len(kept[kind]) > 4:
                            merged(kind)
            if size >= CHUNK:
                yield from requests()
                chunk, size = chunk + 1, 0
        yield from requests()

    path = new_folder(docs.sparkSession, "chunks")
    docs.mapInArrow(cut, schema).write.option("compression", "zstd").parquet(path)
    both = docs.sparkSession.read.schema(schema).parquet(path)
    return both.filter("kind is null").select("doc_id", "text", "train", "p"), both.filter("kind is not null").select("kind", "r", "p", "keys", "n")


NAMES = ["doc_id", "text", "train", "p", "kind", "r", "keys", "n"]


def added(requests: DataFrame, *by: str) -> DataFrame:
    """kind, r, keys, n (and the other columns ``by``): counts of the same kind and region, added."""
    schema = ", ".join(f"{c} {k}" for c, k in requests.dtypes if c in by) + ", keys array<long>, n array<long>"

    def add(batches):
        now, kept, size = None, [], 0

        def total():
            return counted(*(np.concatenate(x) for x in zip(*kept, strict=True)))

        def row():
            keys, n = total()
            one = np.zeros(len(keys))
            return pa.RecordBatch.from_arrays([*(pa.array([x], requests_types[c]) for c, x in zip(by, now, strict=True)), lists(one, keys, pa.int64()), lists(one, n, pa.int64())], names=[*by, "keys", "n"])

        for batch in batches:
            requests_types = {c: batch.column(c).type for c in by}
            ids = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            for i, id_ in enumerate(ids):
                if id_ != now:
                    if kept:
                        yield row()
                    now, kept, size = id_, [], 0
                kept.append(tuple(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("keys", "n")))
                size += len(kept[-1][0])
                if size > MERGE_AT and len(kept) > 8:
                    kept = [total()]
                    size = len(kept[0][0])
        if kept:
            yield row()

    return requests.select(*by, "keys", "n").repartition(*by).sortWithinPartitions(*by).mapInArrow(add, schema)


def model_of(requests: DataFrame, steps: int) -> DataFrame:
    """kind, r, keys, n: the counts of each region over all chunks."""
    if steps > 1:
        requests = added(requests.withColumn("s", F.pmod("p", F.lit(steps)).cast("int")), "kind", "r", "s")
    return stored(added(requests, "kind", "r"), "model")


# ------------------------------------------------------------------- the model


def bits_of(keys: np.ndarray):
    """(place, node, bit) for the eight bits of the last byte of each gram: arrays."""
    byte = keys & 0xFF
    for place in range(8):
        yield place, (1 << place) | (byte >> (8 - place)), (byte >> (7 - place)) & 1


def slot(order: int, context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slot of the bits so far (``node``) after a context: exact for orders 0 and 1, hashed beyond."""
    if order == 0:
        return node
    if order == 1:
        return (context & 0xFF) << 8 | node
    h = (context & ((1 << 8 * order) - 1)).astype(U) * U(0x9E3779B97F4A7C15) + U(order)
    return (mix64(h + node.astype(U) * U(0xC2B2AE3D27D4EB4F)) >> U(64 - bits)).astype(np.int64)


def filled(orders: range, keys: np.ndarray, n: np.ndarray, bits: int) -> list[np.ndarray]:
    """Counts of zeros and ones (slot, bit) of some orders, from grams and their counts."""
    sizes = [{0: 8, 1: 16}.get(order, bits) for order in orders]
    tables = [np.zeros(2 << b) for b in sizes]
    for _, node, bit in bits_of(keys):
        for t, order in zip(tables, orders, strict=True):
            t += np.bincount(2 * slot(order, keys >> 8, node, bits) + bit, weights=n, minlength=len(t))
    return [t.reshape(-1, 2).astype(np.float32) for t in tables]


class Tables:
    """The counts a region's grams meet: those of orders 0 to 2 of all regions, and its own of the higher ones."""

    def __init__(self, low: list[np.ndarray], keys: np.ndarray, n: np.ndarray):
        self.bits = int(max(10, np.ceil(np.log2(max(1, len(keys)))))) + SLOT_BITS
        self.arrays = [*low, *filled(range(3, ORDER + 1), keys, n, self.bits)]

    def look(self, keys: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        return [a[slot(order, keys >> 8, node, LOW_BITS if order == 2 else self.bits)] for order, a in enumerate(self.arrays)]


class Mixer:
    """Gated weights and the adaptive probability map."""

    def __init__(self):
        self.weights = np.full((ORDER + 2, 8, ORDER + 2), 0.3)
        self.weights[..., -1] = 0  # a bias
        self.squares = np.full(self.weights.shape, 1e-4)
        self.by_node = np.zeros((256, ORDER + 2))
        self.node_squares = np.full(self.by_node.shape, 1e-4)
        self.map = np.zeros((256, BUCKETS, 2))

    @staticmethod
    def inputs(found: list[np.ndarray], bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each predictor and the gate; with ``bit``, from the counts without this one occurrence."""
        x, gate = [], np.zeros(len(found[0]), dtype=np.int64)
        for order, c in enumerate(found):
            n0, n1 = c[:, 0].astype(np.float32), c[:, 1].astype(np.float32)
            if bit is not None:
                n0, n1 = np.maximum(n0 - (bit == 0), 0), np.maximum(n1 - (bit == 1), 0)
            gate[n0 + n1 > 0] = order + 1
            x.append(np.log((n1 + PRIOR) / (n0 + PRIOR)))
        return np.stack([*x, np.ones_like(x[0])], axis=1), gate

    def odds(self, x: np.ndarray, gate: np.ndarray, place: int, node: np.ndarray) -> np.ndarray:
        """Mixed log odds: the weights are those of the gate and the bit's place plus those of the bits so far."""
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate, place] + self.by_node[node]), -12, 12)

    def learn(self, x: np.ndarray, gate: np.ndarray, place: int, node: np.ndarray, bit: np.ndarray, n: np.ndarray, rate: float) -> None:
        error = (bit - 1 / (1 + np.exp(-self.odds(x, gate, place, node)))) * n / n.sum()
        steps = error[:, None] * x
        for of, weights, squares in ((gate, self.weights[:, place], self.squares[:, place]), (node, self.by_node, self.node_squares)):
            step = np.zeros(weights.shape)
            np.add.at(step, of, steps)
            squares += step * step
            weights += rate * step / np.sqrt(squares)

    def refined(self, odds: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one: the mixed one, averaged with the map's, which is interpolated between its buckets."""
        p = 1 / (1 + np.exp(-odds))
        at = (odds + 12) * ((BUCKETS - 1) / 24)
        low = np.minimum(at.astype(np.int64), BUCKETS - 2)
        part = at - low
        middle = 1 / (1 + np.exp(-(np.arange(BUCKETS) * 24 / (BUCKETS - 1) - 12)))
        seen = self.map.sum(axis=2)
        rate = (self.map[..., 1] + 20 * middle) / (seen + 20)
        mapped = rate[node, low] * (1 - part) + rate[node, low + 1] * part
        return np.clip((p + mapped) / 2, 1e-6, 1 - 1e-6)


def log10_bytes(tables: Tables, mixer: Mixer, keys: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others."""
    out = np.zeros(len(keys))
    for k in range(0, len(keys), 1 << 15):
        part = keys[k : k + (1 << 15)]
        for place, node, bit in bits_of(part):
            p = mixer.refined(mixer.odds(*mixer.inputs(tables.look(part, node)), place, node), node)
            out[k : k + len(part)] += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def low_tables(model: DataFrame) -> list[np.ndarray]:
    """Tables of orders 0 to 2 of the whole corpus: a number of contexts that doesn't grow."""
    each = model.filter(F.col("kind") == GRAM).select(F.explode(F.arrays_zip("keys", "n")).alias("x"))
    got = each.groupBy(F.col("x.keys").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).agg(F.sum("x.n").alias("n")).toArrow()
    keys, n = (got.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    return filled(range(3), keys, n, LOW_BITS)


MADE = "mass double, made binary"


def summed(made: DataFrame, tasks: int) -> DataFrame:
    """Rows (mass, made: numbers of one size, as bytes), of which each of ``tasks`` tasks gives one at most, added until there
    are at most ``GATHERED``: what the driver gets doesn't grow with the regions."""

    def add(batches):
        mass, total = 0.0, None
        for batch in batches:
            for m, x in zip(batch.column("mass").to_pylist(), batch.column("made"), strict=True):
                x = np.frombuffer(x.as_buffer())
                mass, total = mass + m, x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"mass": [mass], "made": [total.tobytes()]})

    while tasks > GATHERED:
        tasks = -(-tasks // GATHERED)
        made = made.repartition(tasks).mapInArrow(add, MADE)
    return made


def trained(model: DataFrame, low: Broadcast, regions: int) -> Mixer:
    """The mixer, from the counts of all regions."""
    # dealt out once, for all passes; a region is a row
    own = stored(model.filter(F.col("kind") == GRAM).select("r", "keys", "n").repartition(regions, "r"), "regions")
    mixer = Mixer()

    def passes(start: Mixer, mapping: bool):
        def one(batches):
            mass, made = 0.0, None
            for batch in batches:
                for keys, n in zip(batch.column("keys"), batch.column("n"), strict=True):
                    keys, n = (x.values.to_numpy(zero_copy_only=False) for x in (keys, n))
                    keys, n = keys[n > 0], n[n > 0].astype(np.float64)
                    if not len(keys):
                        continue
                    tables, here = Tables(low.value, keys, n), Mixer()
                    here.weights, here.by_node = start.weights.copy(), start.by_node.copy()
                    weights = np.zeros_like(here.map)
                    for k in range(0, len(keys), BATCH):
                        part, m = keys[k : k + BATCH], n[k : k + BATCH]
                        for place, node, bit in bits_of(part):
                            x, gate = here.inputs(tables.look(part, node), bit)
                            if mapping:
                                at = np.rint((here.odds(x, gate, place, node) + 12) * ((BUCKETS - 1) / 24)).astype(np.int64)
                                np.add.at(weights, (node, at, bit), m)
                            else:
                                here.learn(x, gate, place, node, bit, m, RATE)
                    new = weights.ravel() if mapping else np.concatenate([here.weights.ravel(), here.by_node.ravel()]) * n.sum()
                    mass, made = mass + n.sum(), new if made is None else made + new
            if mass:
                yield pa.RecordBatch.from_pydict({"mass": [mass], "made": [made.astype(np.float64).tobytes()]})

        return summed(own.mapInArrow(one, MADE), regions).collect()

    for _ in range(EPOCHS):
        got = passes(mixer, False)
        if got:
            mean = sum(np.frombuffer(r["made"]) for r in sorted(got, key=lambda r: r["mass"])) / sum(r["mass"] for r in got)
            mixer.weights = mean[: mixer.weights.size].reshape(mixer.weights.shape).copy()
            mixer.by_node = mean[mixer.weights.size :].reshape(mixer.by_node.shape).copy()
    for r in passes(mixer, True):
        mixer.map = mixer.map + np.frombuffer(r["made"]).reshape(mixer.map.shape)
    return mixer


# ------------------------------------------------------------------- scoring


def answered(requests: DataFrame, model: DataFrame, low: Broadcast, mixer: Mixer, steps: int) -> DataFrame:
    """p, kind, keys and their logp (grams) or n (words): the regions' answers to the chunks."""
    shared = requests.sparkSession.sparkContext.broadcast(mixer)
    steps_of = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))

    def answer(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        keys, n = (np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy(zero_copy_only=False) for x in known.column(c))]) for c in ("keys", "n"))
        keys, n = keys[n > 0], n[n > 0]
        wanted = [x.values.to_numpy(zero_copy_only=False) for x in asked.column("keys")]
        flat = np.concatenate([np.zeros(0, np.int64), *wanted])
        offsets = pa.array(np.cumsum([0, *map(len, wanted)]), pa.int32())
        distinct = np.unique(flat)
        if kind == GRAM:
            values = log10_bytes(Tables(low.value, keys, n.astype(np.float64)), shared.value, distinct)
        else:
            at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
            values = np.where(keys[at] == distinct, n[at], 0) if len(keys) else np.zeros(len(distinct))
        values = pa.ListArray.from_arrays(offsets, pa.array(values[np.searchsorted(distinct, flat)].astype(np.float32 if kind == GRAM else np.int64)))
        m = len(wanted)
        return pa.table({
            "p": asked.column("p"), "kind": pa.array([kind] * m, pa.int32()), "keys": asked.column("keys"),
            "logp": values if kind == GRAM else pa.nulls(m, pa.list_(pa.float32())), "n": values if kind == WORD else pa.nulls(m, pa.list_(pa.int64())),
        })

    by = ("kind", "r", "s")
    asked = requests.select("kind", "r", F.pmod("p", F.lit(steps)).cast("int").alias("s"), "p", "keys").groupBy(*by)
    known = model.select("kind", "r", steps_of.alias("s"), "keys", "n").groupBy(*by)
    return asked.cogroup(known).applyInArrow(answer, "p long, kind int, keys array<long>, logp array<float>, n array<long>")


class Lookup:
    """Values by key, for many keys at once; every key asked for is there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = int(max(1, np.ceil(np.log2(max(2, 2 * len(keys))))))
        h = self._hash(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.start = np.searchsorted(h[order], np.arange(1 << self.bits)).astype(np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.astype(U)) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.start[self._hash(keys)]
        left = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return self.values[at]


def score(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row; rows where the Boolean
    column ``training`` holds are learnt from."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    regions = max(LEAST_REGIONS, 1 << int(np.ceil(np.log2(max(1, size / REGION_BYTES)))))
    steps = int(size // (CHUNK * CHUNKS_AT_ONCE)) + 1
    texts, requests = chunked(rows, regions)
    model = model_of(requests, steps)
    total, distinct = model.filter(F.col("kind") == WORD).agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.size(F.filter("n", lambda x: x > 0)))).first()
    total, distinct = total or 0, distinct or 0
    low = spark.sparkContext.broadcast(low_tables(model))
    mixer = trained(model, low, regions)
    folder = new_folder(spark, "answers")
    answered(requests, model, low, mixer, steps).repartition("p").write.partitionBy("p").parquet(folder)
    base = float(np.log10(total + 0.1 * (distinct + 1)))

    def run(batches):
        import pyarrow.dataset as ds

        files, path = filesystem(folder)
        now, gram, word = None, None, None
        for batch in batches:
            chunks = batch.column("p").to_numpy()
            edges = np.r_[0, np.flatnonzero(chunks[1:] != chunks[:-1]) + 1, len(chunks)] if len(chunks) else np.zeros(1, int)
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if chunks[i] != now:
                    now, gram, word = chunks[i], None, None
                    got = ds.dataset(f"{path}/p={now}", filesystem=files, format="parquet").to_table(columns=["kind", "keys", "logp", "n"])
                    gram, word = (Lookup(*(part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("keys", c))) for part, c in ((got.filter(pc.equal(got.column("kind"), k)), c) for k, c in ((GRAM, "logp"), (WORD, "n"))))
                yield scored(batch.slice(i, j - i), gram, word)

    def scored(batch, gram: Lookup, word: Lookup):
        data, offsets = text_bytes(batch.column("text"))
        docs_n = len(offsets) - 1
        data = LOWER[data]
        out = {"n_tokens": np.zeros(docs_n, np.int64), "n_known": np.zeros(docs_n, np.int64), "base": np.zeros(docs_n), "score": np.zeros(docs_n)}
        for a, b in blocks(offsets, 1 << 20):
            part = offsets[a : b + 1] - offsets[a]
            own = data[offsets[a] : offsets[b]]
            g, first = grams(own, part)
            out["score"][a:b] = np.add.reduceat(gram(g).astype(np.float64), first)
            words, at = words_of(own, part)
            words = np.insert(words, np.minimum(at, len(words))[1:], END_WORD)
            at = (at + np.arange(b - a + 1))[:-1]
            n = word(words)
            out["n_tokens"][a:b] = np.diff(np.r_[at, len(words)])
            out["n_known"][a:b] = np.add.reduceat((n > 0).astype(np.int64), at)
            out["base"][a:b] = np.add.reduceat(np.log10(n + 0.1), at)
        columns = {**out, "n_bytes": np.diff(offsets)}
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("train"), *map(pa.array, columns.values())], names=["doc_id", "train", *columns])

    done = texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, train boolean, n_tokens long, n_known long, base double, score double, n_bytes long")
    return done.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op1_context_mixing(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10) != 0)
