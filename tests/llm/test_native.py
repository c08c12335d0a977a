"""Operators 3, 4, 6, 7 and 9: SQL on small tables, brute force, and odd inputs."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from listloom.llm import decontaminate, hilbert, host_rules, line_dedup, perspectives, registry

#: Extra columns whose names the operators use themselves.
CLASHING = ["rank", "_n", "_doc", "_row", "row", "key", "host", "_host", "host_failed", "kept", "hilbert", "shard", "slot", "gone", "line", "item", "shingle", "value", "d0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
LONG = "aa bb cc dd ee " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns whose names clash."""
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x y", "en", "s", 3), (3, "", "en", "s", 0),
            (4, LONG, "en", "s", len(LONG)), (5, " \n\t\n", "en", None, 4), (6, "a b c d e f", "en", "s", 11)]
    rows = [(*r, *[None if r[0] == 2 else 7] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_are_those_of_the_sql(name, same_rows, sf):
    same_rows(registry.QUERIES[name], registry.SQL[name], sf)


def test_host_rules_on_odd_rows(odd, empty):
    r = host_rules.apply_host_rules(odd).collect()
    assert len(r) == 8 and all(x["base_failed"] for x in r) and not any(x["kept"] for x in r)
    assert sorted(r[0].__fields__) == sorted({*odd.columns, *host_rules.MEASURES, "host_rate", "kept"}) and {x["host"] for x in r} == {7, None}
    long = next(x for x in r if x["doc_id"] == 4)
    assert (long["n_words"], long["n_repeat_words"]) == (100_000, 100_000)
    assert host_rules.apply_host_rules(empty).count() == 0 and host_rules.measured_once(empty.select("doc_id", "text", "source")).count() == 0


def test_repeated_windows(spark):
    count = lambda s: spark.createDataFrame([(s,)], "t string").select(host_rules.repeated_words(host_rules.words(F.col("t"))).alias("n")).first()["n"]
    assert count("a b c x a b c") == 6 and count("a b c d") == 0 and count("a a a a") == 4 and count("") == 0 and count("a b a b a b") == 6


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 or i >= 100 else "short", "bad" if i < 100 else f"h{i % 5}") for i in range(300)]
    r = {x["doc_id"]: x["kept"] for x in host_rules.apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(r[i] for i in range(100)) and all(r[i] for i in range(100, 300))
    d = spark.createDataFrame([("https://www.A.com/x",), ("plain",), (None,)], "u string").select(host_rules.domain(F.col("u")).alias("d")).collect()
    assert [x["d"] for x in d] == ["a.com", "plain", None]


def test_items_are_found_at_the_threshold(spark):
    words = [f"w{i}" for i in range(24)]  # 20 shingles
    item = " ".join(words)
    cut = lambda n: "pad " * 3000 + " ".join(words[:n]) + " end" * 3000
    docs = spark.createDataFrame([(1, cut(24)), (2, cut(20)), (3, cut(19)), (4, item.upper()), (5, None), (6, "w0 w1")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "w0 w1"), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.contained(docs, items).collect()}
    assert got == {(1, 7, 20), (2, 7, 16), (4, 7, 20), (6, 9, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()) == [3, 5]


def test_items_that_share_an_id_are_all_searched(spark):
    texts = [" ".join(f"{c}{i}" for i in range(9)) for c in "abcd"]
    docs = spark.createDataFrame([*enumerate(texts), (9, "nothing of the kind is in this one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3])], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.contained(docs, items).collect())
    assert got == [(0, 1, 5, 5), (1, 1, 5, 5), (2, None, 5, 5), (3, None, 5, 5)]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()] == [9]


def test_decontamination_of_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contained(odd, items).collect()} == {1, 6}
    assert decontaminate.decontaminated(odd, items).count() == 5
    assert decontaminate.contained(empty, items).count() == 0 and decontaminate.contained(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 1), (2, 3), (3, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    grid = spark.range(2 ** (n * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND(2**bits - 1).cast("int").alias(f"x{i}") for i in range(n)])
    r = sorted(grid.select("*", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("h")).collect(), key=lambda r: r["h"])
    assert [x["h"] for x in r] == list(range(2 ** (n * bits)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(r, r[1:], strict=False))


def test_shards_differ_by_one_row_at_most(spark, sf, monkeypatch):
    monkeypatch.setattr(hilbert, "ROWS_PER_BIN", 7)
    r = hilbert.op6_hilbert_shards(spark, sf).collect()
    by = {}
    for x in r:
        by.setdefault(x["shard"], []).append(x)
    assert set(by) == set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in by.values())
    ends = [(min(x["hilbert"] for x in by[s]), max(x["hilbert"] for x in by[s])) for s in range(40)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_sharding_of_odd_rows(odd, empty):
    r = hilbert.shard_by_curve(odd, ["lang", "source", "n_chars"], "doc_id", 3).collect()
    assert len(r) == 8 and sorted((x["shard"], x["slot"]) for x in r) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert {x["rank"] for x in r} == {7, None} and sorted(r[0].__fields__) == sorted(odd.columns)
    assert hilbert.shard_by_curve(empty, ["lang", "source"], "doc_id", 3).count() == 0


def test_strings_are_cut_by_their_ranks(spark):
    """Values with one long prefix still spread over all cells, by the share of rows below them."""
    urls = [f"https://www.example.org/{i:03d}" for i in range(64) for _ in range(1 + 5 * (i == 10))]
    got = {r["value"]: r["cell"] for r in hilbert.string_cells(spark.createDataFrame([(u,) for u in [*urls, None]], "u string"), "u", 3).collect()}
    below = lambda u: sum(x < u for x in urls) + sum(x == u for x in urls) / 2
    assert got == {u: int(below(u) * 8 / len(urls)) for u in urls} and set(got.values()) == set(range(8))


def hilbert_by_hand(x, bits):
    """Index of a point: Skilling's transform in plain Python."""
    x, n = list(x), len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        if x[n - 1] & q:
            t ^= q - 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def test_sharding_is_brute_force(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in hilbert.op6_hilbert_shards(spark, sf).collect()}
    assert set(got) == set(docs)
    size = {k: len((d["text"] or "").encode()) + 16 for k, d in docs.items()}
    cells = {}
    for name in ("lang", "source"):
        values = [d[name] for d in docs.values() if d[name] is not None]
        cells[name] = {u: int((sum(x < u for x in values) + values.count(u) / 2) * 8 / len(values)) for u in set(values)}
    number = {"size": size, "doc_id": {k: k for k in docs}}
    # so few numbers are cut at exact quantiles
    cuts = {n: [sorted(v.values())[-(-len(v) * k // 8) - 1] for k in range(1, 8)] for n, v in number.items()}
    for k, d in docs.items():
        point = [cells[n].get(d[n], 0) for n in ("lang", "source")] + [sum(number[n][k] > c for c in cuts[n]) for n in ("size", "doc_id")]
        r = got[k]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"], r["hilbert"]) == (size[k], zlib.crc32((d["text"] or "").encode()), "rows", None, hilbert_by_hand(point, 3))
    order = sorted(got.values(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in order)


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def test_line_dedup_is_brute_force(spark):
    random.seed(5)
    lines = [f"alpha beta gamma delta epsilon zeta {i}" for i in range(6)] + ["word " * 60 + "end", "émile ü ß ñ ö ñandu über"]
    lines += [("ab cd ef gh ij " * 20)[:n] for n in (63, 64, 65, 127, 128, 129)] + ["too few words here", "a", "bc", "No 7", "x y"]

    def edit(x):
        i, c = random.randrange(len(x)), random.choice("abxyz ")
        return random.choice([x[:i] + c + x[i:], x[:i] + x[i + 1 :], x[:i] + c + x[i + 1 :]])

    rows = [(i, "\n".join(edit(x) if random.random() < 0.6 else x for x in random.choices(lines, k=random.randrange(1, 5)))) for i in range(60)] + [(None, lines[0]), (70, None), (71, "")]
    every = [(2**63 - 1 if d is None else d, p, x) for d, t in rows if t for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\f\r")]
    dropped = lambda least: {(d, p) for d, p, x in every if any((e, q) < (d, p) and (x == y or min(len(x), len(y)) >= least and near(x, y)) for e, q, y in every)}
    want = dropped(0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc"], r["pos"]) for r in line_dedup.repeated_lines(docs).collect()} == want
    assert {(r["doc"], r["pos"]) for r in line_dedup.repeated_lines(docs, near_chars=25).collect()} == dropped(25) < want
    text = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    cut = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (2**63 - 1 if d is None else d, p) not in want) for d, t in rows if t is not None}
    assert text == cut | {70: None}


def test_line_dedup_stores_numbers_of_variants_and_joins_only_keys_that_link(spark, monkeypatch):
    kept = {}
    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, label: kept.setdefault(label, stored(df, label)))
    # near copies: each shares its first half with all others, two of them are one edit apart
    lines = ["the same beginning of every line of this template " + random.Random(i).randbytes(20).hex() for i in range(30)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, lines[7] + "."])], "doc_id long, text string")
    assert {(r["doc"], r["pos"]) for r in line_dedup.repeated_lines(docs).collect()} == {(30, 0)}
    assert dict(kept["variants"].dtypes) == {"key": "bigint", "role": "int", "no": "bigint"}
    assert kept["variants"].count() > 1000 > 10 > kept["linking-keys"].count() > 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    long, script = "one line of more than five words", "\u6587" * 30
    rows = [(1, f"Les.\n{long}\n\n{script}\nNo 12"), (2, f"Les.\n{long}\n\n{script}\nNo 12"), (3, f"Des.\n{script[1:]}\nNo 13\n \nLes."), (4, "Les.\nLes.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    copies = {(2, 0), (2, 1), (2, 3), (2, 4), (3, 1), (3, 4), (4, 0), (4, 1)}
    assert {(r["doc"], r["pos"]) for r in line_dedup.repeated_lines(docs).collect()} == copies | {(3, 0), (3, 2)}
    assert {(r["doc"], r["pos"]) for r in line_dedup.repeated_lines(docs, near_chars=25).collect()} == copies

    import corpus_pipeline

    docs = docs.selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS long) AS n_chars")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()} == {1: rows[0][1]}


def test_rows_that_share_an_id_are_documents_of_their_own(spark, tmp_path):
    import corpus_pipeline

    said = lambda c: " ".join(f"{c}{i}" for i in range(20))
    texts = {k: [r["text"] for r in df.collect()] for k, df in {
        "lines": line_dedup.dedup_lines(spark.createDataFrame([(1, said("a")), (None, said("a")), (None, said("b")), (2, said("c")), (2, said("a"))], "doc_id long, text string")),
        "items": decontaminate.decontaminated(spark.createDataFrame([(None, said("a")), (None, said("b")), (2, said("a")), (2, said("c"))], "doc_id long, text string"), spark.createDataFrame([(1, said("a"))], "item_id long, text string")),
        "near": corpus_pipeline.near_stage(spark, spark.createDataFrame([(7, said("a")), (None, said("a") + " x"), (None, said("b")), (None, said("b")), (2, said("c")), (2, said("d")), (3, said("d"))], "doc_id long, text string")
            .selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS long) AS n_chars"), str(tmp_path)),
    }.items()}
    assert sorted(texts["lines"]) == ["", "", said("a"), said("b"), said("c")]
    assert sorted(texts["items"]) == [said("b"), said("c")]
    assert sorted(texts["near"]) == [said("a"), said("b"), said("c"), said("d")]


def test_line_dedup_of_odd_rows(odd, empty):
    r = line_dedup.dedup_lines(odd).collect()
    assert len(r) == 8
    assert sorted((x["doc_id"] or 0, x["text"] is None, len(x["removed_lines"])) for x in r) == [(0, False, 0), (1, False, 0), (1, False, 0), (2, True, 0), (3, False, 0), (4, False, 0), (5, False, 0), (6, False, 1)]
    assert sorted(r[0].__fields__) == sorted([*odd.columns, "removed_lines"]) and {x["_doc"] for x in r} == {7, None}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_rotation(spark, monkeypatch):
    monkeypatch.setattr(perspectives, "BLOCK", 2)
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|end|>"), (1, 3, "ann", None), (1, 3, "cy", "x"), (2, 0, "system", "alone"), (None, None, None, "lost")]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    r = perspectives.rotate(turns)
    j = {(x["conv_id"], x["perspective"]): x for x in perspectives.joined(r).collect()}
    assert set(j) == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "unknown")}
    ann = j[1, "ann"]
    assert ann["rendered"] == "<|system|>\nrules<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo <\\|end|><|end|>\n<|assistant|>\n<|end|>\n<|user name=cy|>\nx<|end|>\n"
    assert [ann["rendered"][m["start"] : m["end"]] for m in ann["mask"]] == ["hi<|end|>\n", "<|end|>\n"]
    assert perspectives.rotate(turns.limit(0)).count() == 0


def test_rotation_of_odd_turns(spark):
    long = "word " * 50_000
    turns = [(1, 0, "ann", long), (1, 1, "bob", ""), (1, 1, "bob", ""), (1, 2, " ", None), (None, None, None, None)]
    frame = spark.createDataFrame([(*t, "mine", 3, 4) for t in turns], "conv_id long, turn long, role string, text string, perspective string, block int, _conv int")
    r = perspectives.rotate(frame).collect()
    assert len(r) == 4 * 3 + 1 and {x["perspective"] for x in r} == {"ann", "bob", "unknown"}
    by = {(x["perspective"], x["seq"]): x for x in r if x["conv_id"] == 1}
    assert all(by[p, k]["start"] == (0 if k == 0 else by[p, k - 1]["mask_end"]) for p, k in by) and len(by["ann", 0]["segment"]) > len(long)
