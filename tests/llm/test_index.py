"""Operators 11, 12 and 13: brute force, plain folds, and odd inputs."""

import collections
import dataclasses
import hashlib
import math
import random
import re

import numpy as np
import pytest

from listloom.llm import alignment, common, cuckoo, registry, tokens, wand

CLASHING = ["score", "rank", "n", "terms", "times", "item", "shard", "digest", "bucket", "keep", "kept", "chunk", "pair", "row", "whole", "_d", "batch"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING)


def table(spark, rows):
    return spark.createDataFrame([(*r, *[7] * len(CLASHING)) for r in rows], SCHEMA)


# ---------------------------------------------------------------- operator 11


def pieces():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows):
    """By whole texts, intervals compared pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(tokens.default_path()), sentencepiece.SentencePieceProcessor(model_file=pieces())
    a_lib.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}

    def b_bytes(i):
        t = b_lib.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if b_lib.is_byte(i) else t.replace("▁", " ").encode()

    def places(ids, data):
        ends = np.cumsum([len(x) for x in data]).tolist()
        return list(zip(ids, [0, *ends], ends, strict=False))

    found, holding = [], collections.Counter()
    for _, text in rows:
        if not text:
            found.append(None)
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        a_of, b_of = [bytes(of[c] for c in a_lib.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if not b"".join(a_of) == b"".join(b_of) == (" " + text).encode():
            found.append(None)
            continue
        a, b = places(a, a_of), places(b, b_of)
        pairs = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        said = ["|".join(",".join(str(x) for x, s, e in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        found.append((len(a), len(b), pairs, said))
        holding.update(set(pairs))
    highest = collections.Counter()
    for (x, _), n in holding.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((doc, 0, 0, 0, 0, "", 0, 0))
        else:
            n_a, n_b, pairs, said = f
            out.append((doc, n_a, n_b, len(said), len(pairs), hashlib.sha256(";".join(said).encode()).hexdigest(), sum(holding[p] == highest[p[0]] for p in pairs), sum(holding[p] for p in pairs)))
    return sorted(out, key=str)


ODD_TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a"), (5, "a"), (None, "a b"), (6, "a▁b c"), (7, "tab\tx  y \n z\n\n\nq "), (8, "<|endoftext|> <s> <0x41> </s> <unk>"), (9, "日本語 テキスト。　全角\xa0y"),
    (10, "  lead"), (11, "\r\n crlf\r\n"), (12, "😀 emoji 👩‍👩‍👧 é é \x00 nul"), (13, "\nline"), (14, "trail "), (15, "trail\n"), (16, " \n \n x \n"), (17, "ﬁ½ don't we'll 123,456.78"),
]


def aligned(docs, **options):
    rows = alignment.align(docs, tokens.default_path(), pieces(), **options)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted([tuple(r) for r in rows.collect()], key=str)


def test_alignment_by_brute_force(spark):
    random.seed(5)
    bits = ["a", "the ", " of", "ing", "\n", "  ", "é", "ño", "123", ", ", "-", "\t", "日", "Xy"]
    rows = ODD_TEXTS + [(100 + k, "".join(random.choices(bits, k=random.randrange(1, 40)))) for k in range(300)] + [(900, "the of it, ing " * 500)]
    # chunks of a few texts, so that counts go over chunks
    assert aligned(table(spark, rows).repartition(3), chunk=200) == aligned(table(spark, rows)) == plain_alignment(rows)


def test_alignment_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    assert aligned(spark.createDataFrame(rows, "doc_id long, text string")) == plain_alignment(rows)
    assert registry.QUERIES["op11_alignment"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_aligned_ids_and_groups(spark):
    r = {x["doc_id"]: x for x in alignment.links_of(table(spark, [(1, "unbelievable news"), (2, None)]), tokens.default_path(), pieces()).collect()}
    assert sum(g["a"] for g in r[1]["groups"]) == len(r[1]["a_ids"]) and sum(g["b"] for g in r[1]["groups"]) == len(r[1]["b_ids"]) and r[2]["a_ids"] == []
    assert aligned(table(spark, []).limit(0)) == []


def test_labels_groups_links():
    s = alignment.labels(6, np.array([2, 3, 6]), np.array([3, 4, 6]))
    assert s == b".acb.c" and alignment.groups(s) == [(2, 1), (1, 2)] and [x.tolist() for x in alignment.links(s)] == [[0, 1, 2, 2], [0, 0, 1, 2]]
    assert alignment.saying(s.replace(b".", b""))([1, 2, 3, 7, 8, 9]) == "1,2|7;3|8,9"
    assert sorted(alignment.byte_level_alphabet().values()) == list(range(256)) and alignment.byte_level_alphabet()["Ġ"] == 32


# ---------------------------------------------------------------- operator 12


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    f = cuckoo.CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.slots.size < 4 * len(keys)
    others = rng.integers(0, 2**63, 100_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.001
    f = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    f.remove(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.001
    small = cuckoo.CuckooFilter(np.zeros((16, 4), np.uint16))
    assert small.insert(keys[:40]) and not small.insert(keys[40:140])  # overflow
    with pytest.raises(ValueError, match="never inserted"):
        f.remove(keys[:1])


def test_bucket_grows_and_verifies():
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    b = cuckoo.Bucket({})
    first = b.filter.slots.size
    for k in range(0, 3000, 100):
        b.insert([(d, 1, (0, 0, k, 0, k)) for d in digests[k : k + 100]])
    assert b.filter.slots.size > first and all(b.held(digests)[1])
    # an equal fingerprint is no equal digest: same 64 bits for the filter, other content
    twin = digests[0][:-1] + bytes([digests[0][-1] ^ 1])
    hit, held = b.held([twin])
    assert hit[0] and held == [False]
    b.insert([(twin, 1, (0, 0, 9, 0, 9)), (digests[1], 2, (-5, 0, 8, 0, 8))])
    assert b.content[twin][0] == 1 and b.content[digests[1]] == (3, (-5, 0, 8, 0, 8)) and b.content[digests[0]][0] == 1
    b.replace([(digests[1], 1, (0, 0, 1, 0, 1)), (digests[2], 0, None)])
    assert b.content[digests[1]][0] == 1 and digests[2] not in b.content


def plain_dedup(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for text, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def decided(index):
    return sorted([tuple(r) for r in index.decisions().collect()], key=str)


def some_texts(seed, n, start=0):
    random.seed(seed)
    return [(start + k, random.choice(["a b", "ab ", "a\tb\n", "c", "c c", "é d", "", " ", None, f"x{random.randrange(n)}", "hot text", "hot  text"])) for k in range(n)]


def test_index_is_a_plain_fold_of_insertions_and_deletions(spark, monkeypatch):
    first, second = some_texts(1, 400), some_texts(2, 300, 1000)
    monkeypatch.setattr(cuckoo, "KEYS", 64)
    index = dataclasses.replace(cuckoo.Index.empty(spark), bits=3).added(table(spark, first))
    assert decided(index) == plain_dedup(first)
    index = index.added(table(spark, second))
    assert index.bits == 5 and decided(index) == plain_dedup(first + second)  # it got more buckets
    gone = {d for d, _ in first + second if d % 3 == 0} | {d for d, t in first if t and "hot" in t}
    left = [r for r in first + second if r[0] not in gone]
    smaller = index.removed(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    assert decided(smaller) == plain_dedup(left)
    third = [*some_texts(4, 50, 3000), (5, "h o t t e x t")]
    assert decided(smaller.added(table(spark, third))) == plain_dedup(left + third)
    # what isn't in the corpus any more is neither live nor in its filters, up to their errors
    texts = sorted({t for _, t in first + second + third if t is not None})
    live = {re.sub(r"\s", "", t or "") for _, t in left}
    for r in smaller.found(table(spark, list(enumerate(texts)))).collect():
        there = re.sub(r"\s", "", texts[r["doc_id"]]) in live
        assert r["live"] == there and (r["hit"] or not there) and (r["n"] is not None) == there


def test_dedup_of_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a  b"), (None, "ab"), (2, None), (3, ""), (4, "w " * 50_000), (5, "w" * 50_000), (6, " \n\t\x0b\x0c\r"), (7, "a\xa0b"), (8, "\x1ca b")]
    docs = table(spark, rows)
    assert decided(cuckoo.Index.empty(spark).added(docs)) == plain_dedup(rows)
    kept = cuckoo.deduplicated(docs)
    assert kept.columns == docs.columns and sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([d for d, _, _, k, _ in plain_dedup(rows) if k], key=str)
    assert kept.filter("rank = 7 and whole = 7").count() == 5
    assert decided(cuckoo.Index.empty(spark).added(docs.limit(0))) == [] and cuckoo.deduplicated(docs.limit(0)).count() == 0


def test_hot_groups_and_others_are_joined_alike(spark, monkeypatch):
    rows = some_texts(9, 500)
    want = plain_dedup(rows)
    for hot in (1, 20, 10_000):
        monkeypatch.setattr(common, "HOT", hot)
        assert decided(cuckoo.Index.empty(spark).added(table(spark, rows))) == want


# ---------------------------------------------------------------- operator 13


def plain_search(docs, items, k=10):
    terms = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, length = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for i, t in items:
        asked, scored = collections.Counter(terms(t)), []
        for d, b, n in bags:
            m = 25 + 75 * n * n_docs // length
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * b[x] // (1000 * b[x] + 8 * m)) for x, r in asked.items() if x in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(docs, items, **options):
    rows = wand.search(docs, items, **options)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in rows.collect()], key=str)


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "A1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, ", ".join(random.choices(words, weights, k=random.randrange(1, 40)))) for k in range(1500)]
    items = [(k, " ".join(random.choices(words, k=random.randrange(1, 25)))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize(("block", "most", "parts"), [(1, 7, 1), (64, 300, 1), (512, 16_384, 1), (16, 64, 9)])
def test_search_by_brute_force(spark, texts, monkeypatch, block, most, parts):
    docs, items = texts
    monkeypatch.setattr(wand, "FIRST_DOCS", block)
    monkeypatch.setattr(wand, "BLOCK_DOCS", most)
    if parts > 1:  # postings end blocks, and items are searched in several passes
        monkeypatch.setattr(wand, "BLOCK_POSTINGS", 100)
    terms = sum(len({w.lower() for w in t.split()}) for _, t in items)
    got = ranked(table(spark, docs).repartition(5), table(spark, items), item_id="doc_id", query_terms=-(-terms // parts))
    assert got == plain_search(docs, items)


def test_pivots_leave_no_better_document_out(texts):
    docs, _ = texts
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, v = 40, 12
        sizes = rng.integers(1, v, n)
        terms = np.concatenate([np.sort(rng.choice(v, s, replace=False)) for s in sizes])
        block = wand.Block(np.arange(n), rng.integers(1, 90, n), terms, rng.integers(1, 9, len(terms)), sizes, rng.integers(0, 900, v), n, 45 * n)
        asked = rng.choice(v, 5, replace=False)
        tops = block.top[asked]
        order = np.argsort(-tops, kind="stable")
        bound = np.array([sum(block.top[t] for t in asked if t in set(terms[s : s + k])) for s, k in zip(np.r_[0, np.cumsum(sizes)[:-1]], sizes, strict=True)])
        threshold = max(1, int(tops.sum() * rng.random()))
        assert block.pivots(asked[order], tops[order], threshold).tolist() == np.flatnonzero(bound >= threshold).tolist()


def test_search_of_odd_rows(spark):
    docs = [(1, "x y z"), (1, "x y z"), (2, None), (None, "x y z"), (3, ""), (4, "x " * 60_000), (5, " \n,;"), (6, "X Y"), (7, "q")] + [(k, "filler text") for k in range(20, 40)]
    items = [(1, "x y"), (1, "x y"), (1, "q q q"), (2, None), (3, ""), (4, "nowhere"), (None, "filler X"), (5, "y " * 30_000)]
    want = plain_search(docs, list(dict.fromkeys(items)))
    assert ranked(table(spark, docs), table(spark, items), item_id="doc_id") == want
    assert ranked(table(spark, docs).limit(0), table(spark, items), item_id="doc_id") == [] == ranked(table(spark, docs), table(spark, items).limit(0), item_id="doc_id")
    named = table(spark, items[:2]).selectExpr("concat('i', doc_id) as name", "text")
    assert {r[0] for r in ranked(table(spark, docs), named, item_id="name")} == {"i1"}
