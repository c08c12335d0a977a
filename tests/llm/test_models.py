"""Operators 1, 2, 5, 8, 10 and the pipeline: brute force, round trips, held-out accuracy, and odd inputs."""

import collections
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listloom.llm import common, context_mixing, lsh_forest, packing, quality, sstable, tokens

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, "Same text of five words or six"), (1, "Same text of five words or six"), (2, None), (None, "null id"), (3, ""), (4, LONG), (5, " \n\t "), (6, "same TEXT of five words or six")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, 1, "k") for r in ODD], "doc_id long, text string, score double, predicted int, key string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def split(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def test_word_spans_and_hashes():
    random.seed(1)
    texts = ["".join(random.choice(["a", "B", " ", "\n", "é", "\t", "xyz"]) for _ in range(random.randrange(30))) for _ in range(400)] + ["", None, "  "]
    data, offsets = common.text_bytes(pa.array(texts))
    starts, ends, first = common.word_spans(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in split(t)]
    assert np.diff(first).tolist() == [len(split(t)) for t in texts]
    known = collections.defaultdict(set)
    for h, a, b in zip(common.word_hashes(data, starts, ends), starts, ends, strict=True):
        known[data[a:b].tobytes()].add(int(h))
    assert all(len(x) == 1 for x in known.values()) and len({min(x) for x in known.values()}) == len(known)


def test_encoder_is_the_library():
    random.seed(2)
    parts = ["a", "b,", " ", "  ", "\n", "\t", "'s", "1", "é!", " ", "\r", "\x1d", "　", "​", "\0", "word.", "<|endoftext|>"]
    texts = ["".join(random.choices(parts, k=random.randrange(12))) for _ in range(5000)]
    e = tokens.Encoder(tokens.default_path())
    assert e.encode(texts) == e.whole(texts)


def test_table_format():
    random.seed(3)
    keys = [None, -(2**63), *sorted(random.sample(range(-(10**6), 10**12), 3000))]
    values = [np.array([random.randrange(50_257) for _ in range(random.randrange(40))], dtype=np.uint32) for _ in keys]
    for wide in (False, True):
        out = io.BytesIO()
        w = sstable.Writer(out, wide)
        for k, x in zip(keys, values, strict=True):
            w.add(k, x)
        w.finish()
        r = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
        assert [(k, x.tolist()) for k, x in r] == [(k, x.tolist()) for k, x in zip(keys, values, strict=True)]
        assert all(r.lookup(k).tolist() == x.tolist() for k, x in list(zip(keys, values, strict=True))[::37])
        missing = [k + 1 for k in keys[1:] if k + 1 not in set(keys)]
        assert all(r.lookup(k) is None for k in missing[::97]) and len(r.index) > 1
        bad = bytearray(out.getvalue())
        bad[100] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(sstable.Reader(io.BytesIO(bytes(bad)), len(bad)))


def encoded(rows):
    e = tokens.Encoder(tokens.default_path())
    return [x + bytes(4) for x in e.whole([t or "" for _, t in rows])]


def test_shards_round_trip(spark, sf, odd, empty):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    start, want = 0, []
    for (k, _), ids in zip(rows, encoded(rows), strict=True):
        want.append((k, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sstable.op2_sstable(spark, sf).collect()) == want
    for df, n in ((odd, 8), (empty, 0)):
        folder = common.new_folder(spark, "t")
        r = sstable.read_shards(folder, sstable.write_shards(df, folder, tokens.default_path(), shard_bytes=40)).collect()
        assert len(r) == n and sum(x["doc_id"] is None for x in r) == min(n, 1)
        at = 0
        for x in sorted(r, key=lambda x: (x["start"])):
            assert x["start"] == at
            at += x["n_tokens"]
    odd_ids = spark.createDataFrame([(-(2**63), "least"), (None, "none"), (None, "other"), (2**63 - 1, "most")], "doc_id long, text string")
    folder = common.new_folder(spark, "t")
    r = sstable.read_shards(folder, sstable.write_shards(odd_ids, folder, tokens.default_path(), shard_bytes=20)).collect()
    assert [x["doc_id"] for x in sorted(r, key=lambda x: x["start"])] == [None, None, -(2**63), 2**63 - 1]
    # a third of all rows share an id: no shard holds them all
    hot = spark.createDataFrame([(i if i % 3 else 7, f"text {i} " * 5) for i in range(300)], "doc_id long, text string")
    folder = common.new_folder(spark, "t")
    r = sstable.read_shards(folder, sstable.write_shards(hot, folder, tokens.default_path(), shard_bytes=1500)).collect()
    folder = common.new_folder(spark, "t")
    shards = sstable.write_shards(hot, folder, tokens.default_path(), shard_bytes=1500)
    for key in (1, 7, 8, 299, 0, 3, 300, -5):
        found, want = sstable.lookup(folder, shards, key), [x for x, (k, _) in zip(encoded([tuple(y) for y in hot.collect()]), hot.collect(), strict=True) if k == key]
        assert found is None if not want else found.tobytes() in {np.frombuffer(x, "<u4").astype(found.dtype).tobytes() for x in want}
    assert len({x["shard"] for x in r if x["doc_id"] == 7}) > 1 and [x["doc_id"] for x in sorted(r, key=lambda x: x["start"])] == sorted(x["doc_id"] for x in r)


def test_supersteps_are_best_fit_decreasing():
    import bisect

    for seed in range(120):
        random.seed(seed)
        size = random.choice([10, 50, 2048])
        lengths = [random.randint(1, size if seed % 3 else max(1, size // 4)) for _ in range(random.randrange(1, 300))]
        gaps, opened = [], 0
        for n in sorted(lengths, reverse=True):
            i = bisect.bisect_left(gaps, n)
            room = gaps.pop(i) if i < len(gaps) else size
            opened += room == size
            if room > n:
                bisect.insort(gaps, room - n)
        where, sequences = collections.Counter(), collections.defaultdict(list)
        for n, rank, number, first, each, offset in packing.supersteps(collections.Counter(lengths), size):
            for k in range(number):
                where[n, rank + k] += 1
                sequences[first + k // each].append((offset + k % each * n, n))
        assert set(where.values()) == {1} and collections.Counter(n for n, _ in where) == collections.Counter(lengths)
        for s in sequences.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= size
        assert len(sequences) == opened


def test_packing(spark, sf, odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BIN", 5)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    got = packing.op8_best_fit_packing(spark, sf).collect()
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (k, _), ids in zip(rows, encoded(rows), strict=True):
        at = 0
        for i, p in enumerate(sorted(by[k], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"], p["ids_crc32"]) == (i, at, zlib.crc32(ids[4 * at : 4 * (at + p["length"])])) and (i == 0 or p["length"] == 2048)
            at += p["length"]
        assert at * 4 == len(ids)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
    assert packing.pack(odd, tokens.default_path()).select("sequence_id", "offset").distinct().count() == packing.pack(odd, tokens.default_path()).count()
    assert packing.pack(empty, tokens.default_path()).count() == 0
    ties = spark.createDataFrame([(1, "same text", 5, 6)] * 50 + [(None, None, 5, 6)] * 3, "doc_id long, text string, length int, sequence_id int")
    r = packing.pack(ties, tokens.default_path()).collect()
    assert len(r) == 53 and len({(x["sequence_id"], x["offset"]) for x in r}) == 53 and len({x["sequence_id"] for x in r}) == 1


def test_quality_on_rows_held_out(spark):
    folder = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    r = [x for x in quality.op5_quality(spark, folder).collect() if x["held_out"] and x["doc_id"] in label]
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in r)
    assert sum(x["predicted"] == label[x["doc_id"]] for x in r) >= 0.95 * len(r) and len(r) > 100


def test_word_vectors_are_sums_of_contexts(spark):
    texts = ["Red fox, red fox! ran", "a FOX 12 ran", "", None, "one"]
    places, signs = quality.index_vectors()
    vector = lambda k: sum((signs[i, k] * np.eye(quality.DIM)[places[i, k]] for i in range(quality.NONZERO)), np.zeros(quality.DIM))
    want, pooled = np.zeros((quality.VOCABULARY, quality.DIM)), []
    for t in texts:
        data, offsets = common.text_bytes(pa.array([t], pa.string()))
        words, shapes, _ = quality.tokens(data, offsets)
        assert len(words) == len(split(t)) and len(set(words)) == len({lowered(w) for w in split(t)})
        for i, w in enumerate(words):
            want[w] += vector(shapes[i])
            want[shapes[i]] += vector(w)
            for j in range(max(0, i - quality.WINDOW), min(len(words), i + quality.WINDOW + 1)):
                if j != i:
                    want[w] += vector(words[j])
                if j < i:
                    want[shapes[i]] += vector(shapes[j])
        pooled.append((words, shapes))
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    assert np.allclose(got, want, atol=1e-5)
    x = quality.pooled(got, pa.array(texts))
    for row, (words, shapes) in zip(x, pooled, strict=True):
        mean = np.r_[want[words].mean(0), want[shapes].mean(0), np.log1p(len(words)) / 10] if len(words) else np.zeros(2 * quality.DIM + 1)
        assert np.allclose(row, mean, atol=1e-4)


def test_temperature_lowers_the_loss_of_rows_held_out():
    rng = np.random.default_rng(4)

    def some(n):
        x = rng.normal(size=(n, 2 * quality.DIM + 1))
        return x, (rng.random(n) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)  # no network can be sure of these

    network = quality.Network(*some(600))
    x, y = some(4000)
    logits = network._logits((x - network.mean) / network.scale)
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    plain, calibrated = 1 / (1 + np.exp(-np.clip(logits, -30, 30))), network.score(x)
    assert network.temperature > 1 and loss(calibrated) < loss(plain)
    assert np.allclose(calibrated, 1 / (1 + np.exp(-logits / network.temperature)))


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    r = quality.classify(odd, labels).collect()
    assert len(r) == 8 and all(0 <= x["score"] <= 1 for x in r) and r[0]["key"] == "k"
    assert {x["score"] for x in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_language_model(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    words = {k: [*split(lowered(t)), None] for k, t in docs.items()}
    train = {k for k in docs if zlib.crc32(str(k).encode()) % 10}
    counts = collections.Counter(w for k in train for w in words[k])
    total = sum(counts.values())
    r = context_mixing.op1_context_mixing(spark, folder).collect()
    assert len(r) == len(docs)
    for x in r:
        w = words[x["doc_id"]]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in w)
        assert math.isclose(base, x["base_score"], rel_tol=1e-9)
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (x["doc_id"] not in train, len(w), sum(counts[t] > 0 for t in w), total)
    held = [x for x in r if x["held_out"]]
    n = sum(len(docs[x["doc_id"]].encode()) + 1 for x in held)
    assert 0 < -sum(x["score"] for x in held) / math.log10(2) / n < 2.4  # bits a byte on 2 MB of text


def test_probabilities_sum_to_one():
    keys = np.arange(256, dtype=np.int64) | (0x6162636465 << 8)
    n = np.random.default_rng(1).integers(1, 9, 256).astype(float)
    tables = context_mixing.Tables(context_mixing.filled(range(3), keys, n, context_mixing.LOW_BITS), keys, n)
    assert math.isclose((10 ** context_mixing.log10_bytes(tables, context_mixing.Mixer(), keys)).sum(), 1, rel_tol=1e-9)


def test_lookup():
    keys = np.random.default_rng(2).choice(np.arange(-(2**40), 2**40, 2**22 + 1), 5000, replace=False)
    find = context_mixing.Lookup(keys, np.arange(5000))
    assert find(np.r_[keys[::-1], keys[7]]).tolist() == [*range(4999, -1, -1), 7]


def test_scores_are_those_of_plain_counts(spark, monkeypatch):
    """Chunks of a few texts, added in two steps, against counts of single bits in dictionaries."""
    M = context_mixing
    random.seed(8)
    docs = {i: " ".join(random.choice(["ab", "cd", "Abc", "é", "x\ny"]) for _ in range(random.randrange(12))) for i in range(40)} | {40: None, 41: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(M, "CHUNK", 60)
    monkeypatch.setattr(M, "CHUNKS_AT_ONCE", 2)
    got = {r["doc_id"]: r["score"] for r in M.score(frame, F.col("doc_id") % 4 != 0).collect()}

    rows = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 4 != 0).alias("train"))
    regions = M.LEAST_REGIONS
    model = M.model_of(M.chunked(rows, regions)[1], 3)
    mixer = M.trained(model, spark.sparkContext.broadcast(M.low_tables(model)), regions)

    def bits(text):
        seen = [M.START] * M.ORDER
        for byte in [*lowered(text).encode(), M.END]:
            gram = int.from_bytes(bytes(seen[-M.ORDER :]), "big") << 8 | byte
            for place in range(8):
                yield gram, place, 1 << place | byte >> (8 - place), byte >> (7 - place) & 1
            seen.append(byte)

    grams = {g for k, t in docs.items() if k % 4 for g, *_ in bits(t)} | {g for t in docs.values() for g, *_ in bits(t)}
    region = {g: int(M.region_of(M.GRAM, np.array([g]), regions)[0]) for g in grams}
    known = collections.Counter(region[g] for g in {g for k, t in docs.items() if k % 4 for g, *_ in bits(t)})
    place_of = lambda order, g, node: (region[g] if order > 2 else 0, order, int(M.slot(order, np.array([g >> 8]), np.array([node]), M.LOW_BITS if order == 2 else max(10, math.ceil(math.log2(max(1, known[region[g]])))) + M.SLOT_BITS)[0]))
    counts = collections.Counter()
    for k, t in docs.items():
        if k % 4:
            for g, _, node, bit in bits(t):
                for order in range(6):
                    counts[place_of(order, g, node), bit] += 1
    for k, t in docs.items():
        want = 0.0
        for g, place, node, bit in bits(t):
            found = [np.array([[counts[place_of(order, g, node), b] for b in (0, 1)]], dtype=float) for order in range(6)]
            p = mixer.refined(mixer.odds(*mixer.inputs(found), place, np.array([node])), np.array([node]))[0]
            want += math.log10(p if bit else 1 - p)
        assert math.isclose(got[k], want, rel_tol=1e-4), k


def test_weights_are_those_of_a_plain_computation(spark, monkeypatch):
    """One region, one epoch, two batches of grams: weights by scalar steps from dictionaries of counts."""
    M = context_mixing
    monkeypatch.setattr(M, "EPOCHS", 1)
    monkeypatch.setattr(M, "BATCH", 9)
    docs = spark.createDataFrame([(1, "abcab ab"), (2, "abd")], "doc_id long, text string").withColumn("train", F.lit(True))
    model = M.model_of(M.chunked(docs, 1)[1], 1)
    mixer = M.trained(model, spark.sparkContext.broadcast(M.low_tables(model)), 1)
    grams = collections.Counter()
    for text in ("abcab ab", "abd"):
        seen = [M.START] * M.ORDER
        for byte in [*text.encode(), M.END]:
            grams[int.from_bytes(bytes(seen[-M.ORDER :]), "big") << 8 | byte] += 1
            seen.append(byte)
    counts = collections.Counter()
    parts = lambda g: [(place, 1 << place | (g & 255) >> (8 - place), (g & 255) >> (7 - place) & 1) for place in range(8)]
    for g, n in grams.items():
        for place, node, bit in parts(g):
            for order in range(6):
                counts[order, g >> 8 & ((1 << 8 * order) - 1), node, bit] += n
    weights, by_node = collections.defaultdict(lambda: [0.3] * 6 + [0.0]), collections.defaultdict(lambda: [0.0] * 7)
    squares = collections.defaultdict(lambda: 1e-4)
    keys = sorted(grams)
    for k in range(0, len(keys), M.BATCH):
        batch = keys[k : k + M.BATCH]
        mass = sum(grams[g] for g in batch)
        for place in range(8):
            steps = collections.Counter()
            for g in batch:
                _, node, bit = parts(g)[place]
                x, gate = [], 0
                for order in range(6):
                    seen = [max(0, counts[order, g >> 8 & ((1 << 8 * order) - 1), node, b] - (b == bit)) for b in (0, 1)]
                    gate = order + 1 if sum(seen) else gate
                    x.append(math.log((seen[1] + M.PRIOR) / (seen[0] + M.PRIOR)))
                x.append(1.0)
                odds = sum(a * (b + c) for a, b, c in zip(x, weights[gate, place], by_node[node], strict=True))
                error = (bit - 1 / (1 + math.exp(-max(-12, min(12, odds))))) * grams[g] / mass
                for i in range(7):
                    steps["gate", gate, i] += error * x[i]
                    steps["node", node, i] += error * x[i]
            for (kind, at, i), step in steps.items():
                key = (kind, at, place if kind == "gate" else 0, i)
                squares[key] += step * step
                (weights[at, place] if kind == "gate" else by_node[at])[i] += M.RATE * step / math.sqrt(squares[key])
    assert all(np.allclose(mixer.weights[gate, place], w, atol=1e-4) for (gate, place), w in weights.items())
    assert all(np.allclose(mixer.by_node[node], w, atol=1e-4) for node, w in by_node.items()) and len(by_node) > 20


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(context_mixing, "GATHERED", 3)
    rows = [(float(k), np.array([k, 1.0, k * k]).tobytes()) for k in range(50)]
    made = spark.createDataFrame(rows, context_mixing.MADE).repartition(50)
    got = context_mixing.summed(made, 50).collect()
    assert len(got) <= 3 and sum(r["mass"] for r in got) == 1225
    assert sum(np.frombuffer(r["made"]) for r in got).tolist() == [1225, 50, sum(k * k for k in range(50))]


def test_language_model_of_odd_rows(odd, empty):
    r = context_mixing.score(odd, F.col("doc_id") != 6).collect()
    assert len(r) == 8 and all(math.isfinite(x["score"]) and x["score"] < 0 for x in r)
    assert len({x["score"] for x in r if x["n_tokens"] == 1 and x["doc_id"] in (2, 3)}) == 1
    r = context_mixing.score(odd, F.lit(False)).collect()
    assert all(x["train_tokens"] == 0 and math.isfinite(x["base_score"]) for x in r)
    assert context_mixing.score(empty, F.lit(True)).count() == 0


def components_by_hand(docs, n, percent):
    sets, parent = {}, {k: k for k in docs}
    for k, t in docs.items():
        w = split(lowered(t))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ks = sorted(docs)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in docs}


@pytest.mark.parametrize(("n", "percent", "region"), [(3, 85, 1024), (5, 80, 1024), (3, 85, 24)])
def test_near_duplicates_are_brute_force(spark, sf, n, percent, region, monkeypatch):
    random.seed(9)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    base = [f"v{random.randrange(900)}" for _ in range(120)]
    for k in range(1000, 1060):  # a hot group of near copies
        w = list(base)
        for _ in range(random.randrange(3)):
            w[random.randrange(120)] = f"u{k}"
        docs[k] = " ".join(w)
    monkeypatch.setattr(lsh_forest, "REGION", region)
    r = lsh_forest.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), n, percent).collect()
    want = components_by_hand(docs, n, percent)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in r} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in r)


def test_split_regions_lose_no_link(spark, monkeypatch):
    """Chains of texts each linked with its neighbours only, in regions split far below their size."""
    random.seed(4)
    docs = {}
    for c in range(6):
        w = [f"{c % 2}w{i}" for i in range(60)] + [f"c{c}x{i}" for i in range(40)]
        for k in range(40):
            docs[c * 100 + k] = " ".join(w)
            w[random.randrange(100)] = f"c{c}y{k}"
    monkeypatch.setattr(lsh_forest, "REGION", 8)
    r = lsh_forest.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 3, 85).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in r} == components_by_hand(docs, 3, 85)
    # every link across labels is found, though each label is one text
    frame = spark.createDataFrame(list(docs.items()), "doc long, text string")
    members = lsh_forest.pools(frame.selectExpr("1L AS region", "doc", "100L AS n_shingles"), lsh_forest._no_labels(frame))
    labels = {x["node"]: x["component"] for x in lsh_forest.components(lsh_forest.links(frame, members, 3, 85)).collect()}
    assert {k: labels.get(k, k) for k in docs} == {k: v for k, (_, v) in components_by_hand(docs, 3, 85).items()}


def test_near_duplicates_of_rows_that_share_an_id(spark):
    said = lambda c, *more: " ".join([*(f"{c}{i}" for i in range(40)), *more])
    rows = [(5, said("a")), (7, said("a", "x")), (7, said("b")), (None, said("b", "y")), (None, said("c")), (None, said("c", "z")), (None, said("c")), (9, said("d"))]
    r = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    got = sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in r)
    assert got == [(0, 0, False), (0, 0, False), (0, 0, True), (0, 7, False), (5, 5, True), (7, 5, False), (7, 7, True), (9, 9, True)]
    # repeated rows and rows without an id, by brute force on their places
    random.seed(8)
    rows = [(random.choice([1, 2, 3, None, 2**62 + 5]), random.choice([said("a"), said("a", "x"), said("b"), said("b", "y"), "two words", "", " \n", None])) for _ in range(80)]
    r = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    groups = collections.defaultdict(list)
    for k, (_, root) in components_by_hand({k: t for k, (_, t) in enumerate(rows)}, 3, 85).items():
        groups[root].append(rows[k][0])
    least = lambda ids: min(ids, key=lambda i: (i is None, i))
    assert collections.Counter((x["doc_id"], x["component_id"]) for x in r) == collections.Counter((i, least(ids)) for ids in groups.values() for i in ids)
    assert len(r) == 80 and sum(x["kept"] for x in r) == len(groups)


def test_near_duplicates_of_odd_rows(odd, empty):
    r = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in lsh_forest.near_duplicates(odd, 3, 85).collect()}
    rows = lsh_forest.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == 8 and sorted(x["kept"] for x in rows if x["doc_id"] == 1) == [False, True]
    assert r[1][:2] == (5, 1) and r[6] == (5, 1, False) and r[2] == (0, 2, True) and r[5][0] == 0 and r[None][0] == 1
    assert lsh_forest.near_duplicates(empty, 3, 85).count() == 0


def test_labels_spread_along_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in lsh_forest.components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and len(got) == 43


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [len(p.STAGES), p.ORACLE_SQL] == [5, None]
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = set(docs.columns)
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, folder), "t")
        assert set(docs.columns) == columns and 0 < docs.count() <= before.count(), name
    packed = p.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def lines_by_hand(docs):
    """Lines left of each document: those with no earlier line within one edit of them."""
    seen, near, out = set(), collections.defaultdict(list), {}
    for k in sorted(docs):
        kept = []
        for x in docs[k].split("\n"):
            gone = bool(split(x)) and (x in seen or any(within_one(x, y) for n in (-1, 0, 1) for y in near[len(x) + n]))
            if split(x) and x not in seen:
                seen.add(x)
                near[len(x)].append(x)
            if not gone:
                kept.append(x)
        out[k] = "\n".join(kept)
    return out


def within_one(a, b):
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def test_pipeline_stages_are_brute_force(spark, sf):
    """Stages 2 to 4 on what the classifier kept, against plain Python; the last against the token ids of what is left."""
    import corpus_pipeline as p

    docs = common.stored(p.quality_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), "t")
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    cut = lines_by_hand(now)
    now = {k: t for k, t in cut.items() if t == now[k] or split(t)}
    docs = common.stored(p.line_stage(spark, docs, sf), "t")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == now
    groups = components_by_hand(now, 5, 80)
    now = {k: t for k, t in now.items() if groups[k][1] == k}
    docs = common.stored(p.near_stage(spark, docs, sf), "t")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == now

    def shingles(t):
        w = split((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    items = [s for s in (shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if s]
    now = {k: t for k, t in now.items() if not any(100 * len(s & own) >= 80 * len(s) for own in [shingles(t)] for s in items)}
    docs = common.stored(p.benchmark_stage(spark, docs, sf), "t")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == now
    sizes = collections.Counter()
    for r in p.packing_stage(spark, docs, sf).collect():
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {k: len(ids) // 4 for k, ids in zip(now, encoded(list(now.items())), strict=True)}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, shared ids, clashing columns: no stage fails, and each
    keeps what it should."""
    import corpus_pipeline as p

    said = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, said("a"), "en", "s", 1), (1, said("a"), "en", "s", 1), (2, None, None, None, None), (None, said("b"), None, "s", 1), (None, said("c"), "en", "s", 1), (3, "", "en", "s", 0), (4, LONG, "en", "s", 9), (5, " \n\t ", "en", "s", 4)]
    docs = spark.createDataFrame([(*r, 7, 7, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key int, score int, _row int")
    spark.createDataFrame([(1, said("c"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.select(*p.COLUMNS, "_key", "score", "_row")
    kept = p.quality_stage(spark, docs, str(tmp_path))
    assert kept.count() == 8  # labels of one kind: every score is their share
    left = common.stored(p.line_stage(spark, kept, str(tmp_path)), "t")
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in left.collect()) == sorted((r[0] or 0, len(r[1] or "")) for r in rows)
    near = common.stored(p.near_stage(spark, left, str(tmp_path)), "t")
    assert near.count() == 7 and near.columns == list(p.COLUMNS)
    clean = common.stored(p.benchmark_stage(spark, near, str(tmp_path)), "t")
    assert clean.count() == 6 and said("c") not in {r["text"] for r in clean.collect()}
    assert p.packing_stage(spark, clean, str(tmp_path)).select("doc_id").distinct().count() == 6
