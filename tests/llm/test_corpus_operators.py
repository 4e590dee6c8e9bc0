"""The corpus operators on tables full of odd rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, suffix_dedup, toxicity
from tessera.llm.common import components, setting, spool
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash import alike, classes, edit, fingerprint_pairs, likeness, shingles, signature
from tessera.llm.mixing import mix, targets
from tessera.llm.packing import encoder, pack, plan
from tessera.llm.sharding import shard_by_bytes
from tessera.llm.simhash import candidates, fingerprint, near_duplicates
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.topk_search import search, term_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, h long, lead long, shard int, fp string, pos int, line string"


def prose(seed, n, words=None):
    r = random.Random(seed)
    words = words or ["the", "of", "and", "Ünder", "straße", "moon", "river", "Stone", "été", "gamma", "delta", "x", "quick", "brown", "fox"]
    return " ".join(r.choice(words) + r.choice(["", "", ",", ".", str(r.randrange(40))]) for _ in range(n))


def corpus():
    """(id, text, lang, source): nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    long = "\n".join(prose(i, 60) for i in range(400))
    shared = "This licence line is held by very many of the documents here."
    rows = [
        (5, None, "en", "a"), (6, "", None, "a"), (7, "   \n\t ", "de", None), (None, prose(1, 50), "en", "b"), (None, None, None, None),
        (8, "word", "en", "b"), (9, "two words", "en", "b"), (10, "12345 !!! 678", "en", "c"), (11, long, "en", "c"), (12, long, "en", "a"),
        (13, long[100:5000] + prose(3, 40), "fr", "a"), (14, prose(4, 30), "en", "zz"), (14, prose(4, 30), "en", "zz"), (15, "é" * 300, "fr", "a"), (16, "ab" * 400, "fr", "a"),
        (17, "Z" * 199, "fr", "b"), (18, "Z" * 200, "fr", "b"), (19, "a\n\nb\n", "en", "b"), (20, "<|endoftext|> 日本語 🙂   end", "ja", "日本"),
    ]
    for k in range(8):
        rows.append((30 + k, f"{prose(50 + k, 25)}\n  {shared.upper() if k % 2 else shared} \t\n{prose(70 + k, 10)}", "en", "d"))
    base = prose(99, 120)
    for k in range(12):
        rows.append((60 + k, base.replace("moon", "moon!", k // 4), "en", "d"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, lang, s, len(t or ""), 1, "k", 2, 3, 4, "f", 5, "l") for i, t, lang, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3, "text").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_empty_tables(spark, empty):
    model = langid.train(empty.where("lang is not null"))
    assert model[0] == [] and langid.identify(empty, model).count() == 0
    for df in (remove_repeats(empty), near_duplicates(empty), near_duplicates(empty, alike=0.8), shard_by_bytes(empty), pack(empty), mix(empty), line_dedup(empty), fingerprint_pairs(empty), search(empty, F.lit(True))):
        assert df.count() == 0
    m = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, m).count() == 0


# suffix dedup


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 80])
def test_remove_repeats(docs, rows, length):
    rows = [(i, t) for i, t, *_ in rows if not t or len(t) < 9000]
    found = remove_repeats(docs.where("text is null or length(text) < 9000"), length=length, with_text=True).collect()
    expected = brute_repeats([t for _, t in rows], length)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == Counter((i, *e) for (i, _), e in zip(rows, expected, strict=True))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_remove_repeats_random(spark):
    r = random.Random(1)
    passages = ["".join(r.choice("abcd ") for _ in range(r.randrange(150, 500))) for _ in range(12)]
    texts = []
    for _ in range(60):
        t = "".join(r.choice("abcd ") for _ in range(r.randrange(300)))
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            t += p[r.randrange(60) : len(p) - r.randrange(60)] + "".join(r.choice("xyz") for _ in range(r.randrange(90)))
        texts.append(t)
    texts += ["q" * 700, "ab" * 350, texts[0], texts[3][:-1]]
    found = {x.doc_id: x for x in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, e in enumerate(brute_repeats(texts, 200)):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == e


def test_remove_repeats_few_files(spark, monkeypatch):
    """A small table's steps are few files each, however many partitions the session has; nothing is lost by that."""
    r = random.Random(2)
    passages = ["".join(r.choice("abcd ") for _ in range(400)) for _ in range(30)]
    texts = ["".join(r.choice("abcd ") for _ in range(250)) + r.choice(passages)[r.randrange(90) :] + "xyz"[r.randrange(3) :] for _ in range(150)]
    files = []

    def counted(df, tag, *more):
        out = spool(df, tag, *more)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(suffix_dedup, "spool", counted)
    with setting(spark, "spark.sql.shuffle.partitions", lambda _: "60"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", lambda _: "false"):
        df = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        found = {x.doc_id: x for x in df.collect()}
        files.append(df.rdd.getNumPartitions())
    for i, e in enumerate(brute_repeats(texts, 200)):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == e
    assert len(files) > 10 and max(files) <= 4 * spark.sparkContext.defaultParallelism


def test_remove_repeats_needs_length(docs):
    with pytest.raises(ValueError):
        remove_repeats(docs, length=79)


# SimHash


def test_fingerprint():
    import xxhash

    for text in (None, "", " \n", "One", "one TWO", prose(5, 300), "É é É é"):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert fingerprint(text) % 2**64 == bits


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_near_duplicates(docs, rows):
    low = -(2**63)
    nodes = {i if i is not None else low for i, *_ in rows}
    prints = [(i if i is not None else low, fingerprint(t) % 2**64) for i, t, *_ in rows]
    linked = [(a, b) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 2]
    want = brute_components(nodes, linked)
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        c = want[r.doc_id if r.doc_id is not None else low]
        assert r.component_id == (None if c == low else c)
    assert Counter((r.doc_id, r.fingerprint) for r in found) == Counter((i, f"{fingerprint(t) % 2**64:016x}") for i, t, *_ in rows)


def test_near_duplicates_alike(docs):
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, alike=0.8).collect()}
    assert {found[60 + k] for k in range(12)} == {60} and found[11] == found[12] == 11 and found[34] == 34


@pytest.mark.parametrize("bits", [2, 3])
@pytest.mark.parametrize("pair_up", [512, 6, 1])
def test_candidates_are_complete(spark, bits, pair_up):
    r = np.random.default_rng(bits)
    centres = r.integers(0, 2**64, 6, dtype=np.uint64)
    flips = [np.uint64(1) << r.integers(0, 64, 120, dtype=np.uint64) for _ in range(3)]
    f = np.unique(np.concatenate([centres, *(np.repeat(centres, 20) ^ flips[0] ^ flips[1], np.repeat(centres, 20) ^ flips[2])]))
    want = {frozenset((int(a), int(b))) for a in f for b in f if a < b and int(a ^ b).bit_count() <= bits}
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    got = [(x.f % 2**64, x.g % 2**64) for x in candidates(df, max_bits=bits, pair_up=pair_up).collect()]
    assert len(got) == len(set(map(frozenset, got))) and {frozenset(p) for p in got if (p[0] ^ p[1]).bit_count() <= bits} == want


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(200)] + [(5000, 5000 + i) for i in range(1, 400)] + [(7, 7), (3, 2)]
    want = brute_components({x for e in edges for x in e}, edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert found == {n: c for n, c in want.items() if n in found} and set(want) - set(found) <= {n for n in want if want[n] == n}
    assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


# sharding


def test_shards(docs, rows):
    found = shard_by_bytes(docs, 4).collect()
    sizes = [len((t or "").encode()) + 1 for _, t, *_ in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, n, zlib.crc32((t or "").encode())) for (i, t, *_), n in zip(rows, sizes, strict=True))
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(4)) and all(r.law == "bytes" and r.grown_shard is None for r in found)
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        assert abs(sum(r.size for r in s) - sum(sizes) / 4) <= 2 * max(sizes)
    groups = {}
    for r in found:
        if r.size > 1:
            groups.setdefault((r.text_crc32, r.size), []).append(r.shard)
    assert all(len(set(g)) == 1 for (_, n), g in groups.items() if n * len(g) <= max(sizes))


def test_shards_balance(spark):
    r = random.Random(8)
    data = [(i, "x" * r.randrange(50)) for i in range(3000)] + [(i, "copy of one text") for i in range(3000, 4500)]
    found = shard_by_bytes(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    sizes = Counter()
    for x in found:
        sizes[x.shard] += x.size
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * 51


# packing


def test_plan_fills_sequences():
    r = random.Random(2)
    for lengths in ([], [1], [1024], [1025, 1023], [r.randrange(1, 4000) for _ in range(300)], [600] * 9):
        pieces, n = plan(lengths, 1024, 1.0, 0.002)
        assert n == -(-sum(lengths) // 1024) or n <= sum(x // 1024 for x in lengths) + -(-sum(x % 1024 for x in lengths) // 1024)
        fill = Counter()
        for d, start, k, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert k > 0 and offset == fill[s]
            fill[s] += k
        assert max(fill.values(), default=0) <= 1024
        for d, x in enumerate(lengths):
            own = sorted((start, k) for e, start, k, *_ in pieces if e == d)
            assert sum(k for _, k in own) == x and all(a + k == b for (a, k), (b, _) in zip(own, own[1:]))


def test_pack_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = pack(docs, window_tokens=5000, with_ids=True).collect()
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for i, x, *_ in rows)
    pieces, got, now = {}, Counter(), {}
    for r in found:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
        now.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for own in pieces.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 1024
    for (i, n), own in now.items():
        starts = Counter(r.start for r in own)
        copies = starts[0]
        if copies == 1:
            got[i, tuple(x for r in sorted(own, key=lambda r: r.start) for x in r.ids)] += 1
        else:  # repeated rows: the same ids as often
            assert sum(r.length for r in own) == copies * n
            got[i, next(k for j, k in want if j == i and len(k) == n)] += copies
    assert got == want


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "<|endoftext|> a", "a b  <|endoftext|>  c", "a<|endoftext|>b", "a  <|endoftext|>", "<|endoftext|><|endoftext|>\n<|endoftext", "  \n\n\t x ", "naïve 🙂🙂 日本", "a" * 5000, "1234567 don't WE'LL", "\x00\x01"])
def test_encoder_is_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder()(text) == t.encode(text, add_special_tokens=False).ids


# mixing


def fill(sizes, weights, share):
    """Water-filling by rounds."""
    total, caps, got, open_ = share * sum(sizes), [2.0 * s for s in sizes], [0.0] * len(sizes), set(range(len(sizes)))
    while open_ and total > 1e-9:
        w = sum(weights[i] for i in open_)
        parts = {i: total * weights[i] / w for i in open_}
        total = 0.0
        for i, x in parts.items():
            got[i] += x
            if got[i] >= caps[i]:
                total += got[i] - caps[i]
                got[i] = caps[i]
        open_ -= {i for i in open_ if got[i] >= caps[i]}
        if not total:
            break
    return got


@pytest.mark.parametrize("sizes", [[10], [1, 1000], [5, 5, 5, 5], [0, 0], [0, 7], [1, 2, 3, 1000, 4, 9], [100, 1, 1, 1]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    found = {r.source: r.target for r in targets(df).collect()}
    order = [*range(1, len(sizes)), 0]  # by name, null last
    want = fill([sizes[i] for i in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5)
    for i, x in zip(order, want, strict=True):
        assert found[f"s{i}" if i else None] == pytest.approx(x)


def test_mix(docs, rows):
    found = mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, count(t)) for i, t, *_ in rows)
    by = Counter()
    for _, t, _, s in rows:
        by[s] += count(t)
    assert sum({(r.source_size, r.target): r.target * sum(v == r.source_size for v in by.values()) for r in found}.values()) == pytest.approx(1.5 * sum(by.values()))
    assert all(0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in found)
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in mix(docs.repartition(7)).collect())
    source_of = {i: s for i, _, _, s in rows if i is not None}
    for s in set(by) - {None}:
        own = [r for r in found if r.doc_id is not None and source_of[r.doc_id] == s]
        largest = max(r.size for r in own)
        if s not in ("b",):  # one of b's rows has no id
            assert abs(sum(r.taken for r in own) - own[0].target) <= largest / 2 + 1


# language ID


LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "éèçüß"}


def test_language(spark, docs):
    r = random.Random(4)
    text = lambda lang: " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randrange(2, 9))) for _ in range(30))
    train = spark.createDataFrame([(text(x), x) for x in LETTERS for _ in range(30)] + [(None, "aa"), ("", "bb")], "text string, lang string")
    model = langid.train(train)
    assert model[0] == ["aa", "bb", "cc"] and np.array_equal(model[1], langid.train(train.repartition(5))[1])
    held = [text(x) for x in LETTERS for _ in range(20)]
    found, score = langid.predict([*held, None, "", "123 !", "É"], *model)
    assert found[:60] == [x for x in LETTERS for _ in range(20)] and found[60:] == ["und"] * 3 + ["cc"]
    assert all(0 < s <= 1 for s in score[:60]) and score[60:63] == [0, 0, 0]
    out = langid.identify(docs, model)
    assert out.columns == [*docs.columns, "__lang", "__score"] and out.count() == docs.count()
    assert {r.doc_id for r in out.where("__lang = 'und'").collect()} == {None, 5, 6, 7, 10}


# toxicity


def test_toxicity(spark, docs):
    r = random.Random(6)
    clean, bad = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)], ["vilest", "rotten", "scummy"]

    def text(toxic):
        words = [r.choice(clean) for _ in range(r.randrange(20, 60))]
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        return " ".join(words)

    labelled = [(i, text(i % 8 == 0), "en", int(i % 8 == 0)) for i in range(1200)]
    d = spark.createDataFrame([x[:3] for x in labelled] + [(9999, None, None)], "doc_id long, text string, lang string")
    y = spark.createDataFrame([(x[0], x[3]) for x in labelled] + [(9999, 0), (9998, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, y, max_rows=900)
    again = toxicity.train(d.repartition(4), y, max_rows=900)
    assert np.array_equal(model.embedding, again.embedding)
    held = [text(k % 2) for k in range(60)]
    feats, numbered = toxicity._number([toxicity.words_of(t) for t in [*held, None, "", "5 5"]], toxicity.Features())
    s = toxicity.scores(model, feats, numbered)
    assert all((s[:60] >= toxicity.CUT) == (np.arange(60) % 2 == 1)) and s[60] == s[61] == s[62] < toxicity.CUT
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "__score"] and out.where("__score between 0 and 1").count() == docs.count()


# line dedup


def brute_lines(rows, min_chars=40, min_docs=5):
    low = -(2**63)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i if i is not None else low)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(held.get(key(x), ())) >= min_docs and (i if i is not None else low) < max(held[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("min_chars, min_docs", [(40, 5), (3, 2), (1, 1)])
def test_lines(docs, rows, min_chars, min_docs):
    rows = [(i, t) for i, t, *_ in rows]
    found = line_dedup(docs, min_chars=min_chars, min_docs=min_docs)
    assert found.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    got = Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text or "") for r in found.collect())
    assert got == Counter(brute_lines(rows, min_chars, min_docs))


def test_lines_over_many_ranges(spark):
    line = "one and the same line, held by every single document"
    data = [(i, "\n".join([line] * (1 + i % 3) + [f"own line {i} " + "x" * 40] + [f"LINE of seven {i % 7} " + "İß" * 20])) for i in range(500)] + [(i, "\n".join([line] * 150)) for i in (500, 501)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in line_dedup(df).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert got == Counter(brute_lines(data))


# fingerprints


def test_fingerprint_pairs(docs, rows):
    some = [(i, t or "") for i, t, *_ in rows if i is not None and i != 14]
    some.sort()
    found = {r.doc_id: r for r in fingerprint_pairs(docs.where("doc_id is not null and doc_id <> 14")).collect()}
    assert len(found) == len(some)
    for k, (i, t) in enumerate(some):
        following = some[(k + 1) % len(some)][1]
        e, r = edit(t, following), found[i]
        half = len(t) // 2
        assert e == (t[: len(t) - half] + following[:half]) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.n_chars == len(t)
        s, x, n = (signature(shingles(y)) for y in (t, e, following))
        assert bytes(r.fingerprint) == s.tobytes() and bytes(r.edited_fingerprint) == x.tobytes()
        assert r.near_edited == likeness(s, x) and r.near_next == likeness(s, n)
    assert fingerprint_pairs(docs).count() == len(rows)


def test_likeness_estimates_jaccard():
    x = np.random.default_rng(1).integers(0, 2**64, 4000, dtype=np.uint64)
    a, b = x[:3000], x[1000:]
    assert abs(likeness(signature(a, 1024), signature(b, 1024)) - 0.5) < 0.06
    assert likeness(signature(a), signature(a)) == 1 and likeness(signature(a), signature(a[:0])) == 0


@pytest.mark.parametrize("pair_up", [512, 3])
def test_classes(spark, pair_up):
    r = random.Random(5)
    base = [prose(500 + k, 300).split() for k in range(6)]
    data = []
    for k, words in enumerate(base):
        for j in range(10):
            near = list(words)
            for _ in range(j % 4):
                near[r.randrange(len(near))] = f"edit{r.random()}"
            data.append((100 * k + j, " ".join(near)))
    data += [(9000 + k, None) for k in range(3)] + [(None, prose(1, 99)), (None, prose(2, 99))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    found = classes(fingerprint_pairs(df), df, pair_up=pair_up).collect()
    assert len(found) == len(data) and all(x.class_id == (None if x.doc_id is None else 9000 if x.doc_id >= 9000 else x.doc_id // 100 * 100) for x in found)
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in [*range(a + 1, 10), 100]] + [(0, 77)], "a long, b long")
    sets = {i: set(shingles(t).tolist()) for i, t in data if t}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs.collect() if b != 77}
    got = {(x.a, x.b): x.jaccard for x in alike(df, pairs, 0.9).collect()}
    assert got == {p: j for p, j in want.items() if j >= 0.9}


def test_classes_of_nothing(empty):
    assert classes(fingerprint_pairs(empty), empty).count() == 0


# search


def test_search(docs, rows):
    k = 4
    kept = [(i, t) for i, t, *_ in rows if i is not None]
    terms = [dict(zip(*(x.tolist() for x in term_counts(t)), strict=True)) for _, t in kept]
    df = Counter(w for t in terms for w in t)
    n = [sum(t.values()) for t in terms]
    mean = sum(n) / len(n)
    idf = {w: math.log(1 + (len(kept) - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    want = {}
    for q in {i for i, _ in kept if i % 3 == 0 or i == 14}:
        words = {w for (i, _), t in zip(kept, terms, strict=True) if i == q for w in t}
        scored = [(-sum(round(idf[w] * (t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * m / mean))) * 1e6) for w in words & t.keys()), i) for (i, _), t, m in zip(kept, terms, n, strict=True)]
        want[q] = [(i, -p / 1e6) for p, i in sorted(scored)[:k] if p]
    for shard_docs in (1000, 5):
        got = {}
        for r in search(docs, (F.col("doc_id") % 3 == 0) | (F.col("doc_id") == 14), k=k, shard_docs=shard_docs, block_queries=1).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
        for q, v in got.items():
            assert [s for _, s in v] == pytest.approx([s for _, s in want[q]], abs=1e-4)


def test_toxicity_languages_are_bounded():
    r = random.Random(9)
    rows = [(prose(i, 20), i % 2, f"lang{i % 200}" if i % 2 else "en") for i in range(600)]
    model = toxicity.fit(rows, epochs=1)
    assert model.langs.shape[1] <= toxicity.MAX_LANGS + 1 and np.isfinite(model.langs).all()
    feats, texts = toxicity._number([toxicity.words_of(r.choice(rows)[0])], toxicity.Features())
    assert 0 <= toxicity.scores(model, feats, texts)[0] <= 1
