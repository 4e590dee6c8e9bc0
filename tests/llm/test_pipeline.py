"""The pipeline's stages on an odd table, each against what its predecessor kept."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import langid, toxicity
from tessera.llm.common import spool
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash import classes, fingerprint_pairs
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdf" for b in "aeiou" for c in "lnrs"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    line = "a line of boilerplate that stands in many of the documents"
    data = [(i, prose(200) + ("\n" + line if i % 3 == 0 else ""), "en" if i % 5 else None, f"s{i % 4}" if i % 11 else None) for i in range(60)]
    base = prose(400).split()
    for k in range(6):
        near = list(base)
        near[17 * (k + 1)] = "changed"
        data.append((100 + k, " ".join(near), "en", "s1"))
    data += [(200, data[0][1], "en", "s2"), (201, None, None, None), (202, "", "en", "s0"), (203, "12 34 !!", "en", "s0"), (None, prose(50), "en", "s3"), (204, prose(80), "en", "s0"), (204, prose(80), "en", "s0"), (205, "ñandú " * 30000, "en", "s9")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "extra") for i, t, lang, s in data], "doc_id long, text string, lang string, source string, n_chars long, size string").cache()


def test_stages(spark, docs):
    now, seen = docs, {}
    for name, stage in cp.STAGES:
        now = spool(stage(spark, now, SF), name)
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    ids = {n: Counter(r.doc_id for r in df.select("doc_id").collect()) for n, df in seen.items()}
    assert Counter(r.doc_id for r in docs.collect()) - ids["language_id"] == Counter([201, 202, 203])
    assert seen["language_id"].where("lang is null").count() == 0 and ids["line_dedup"] == ids["language_id"]
    lines = seen["line_dedup"]
    assert lines.where("text like '%boilerplate%'").count() == 1 and lines.where("n_chars <> length(text)").count() == 0
    gone = ids["line_dedup"] - ids["near_dedup"]
    assert gone == Counter([101, 102, 103, 104, 105, 200]) and ids["near_dedup"][None] == 1
    taken = Counter((r.doc_id, r.text) for r in seen["mixing"].collect())  # unlike texts of one id are documents of their own
    assert set(ids["mixing"]) <= set(ids["near_dedup"]) and max(taken.values()) == 2
    assert set(ids["packing"]) == set(ids["mixing"])
    assert seen["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_on_nothing(spark, docs):
    now = docs.limit(0)
    for name, stage in cp.STAGES:
        now = spool(stage(spark, now, SF), name)
        assert now.count() == 0
    no_lang = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert cp.language_stage(spark, no_lang, SF).count() == docs.count()


@pytest.mark.parametrize("name", QUERIES)
def test_queries(spark, name):
    df = QUERIES[name](spark, SF)
    n = df.count()
    assert n >= 2 if name == "op4_topk_search" else n >= 200


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    q = c.execute(ORACLE_SQL[name])
    columns = [x[0] for x in q.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(q.fetchall())


def close_pairs(texts, least=0.8, width=5):
    """All pairs of different sets of word shingles with that Jaccard likeness, by the rarest shingles of each: two sets so alike share one of them."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset())
    found = {s: k for k, s in enumerate(sets)}
    often = Counter(x for s in found for x in s)
    index, pairs = {}, []
    for s, k in found.items():
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]
        for j in {j for x in rare for j in index.get(x, ())}:
            if len(s & sets[j]) >= least * len(s | sets[j]):
                pairs.append((j, k))
        for x in rare:
            index.setdefault(x, []).append(k)
    return pairs


def test_recall_of_near_copies(spark):
    """Of all pairs of different texts alike by 0.8, nine in ten share a group; the texts of a group hang together by such pairs."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = rows.collect()
    pairs = close_pairs([r.text for r in texts])
    assert len(pairs) >= 40
    group = {r.doc_id: r.component_id for r in near_duplicates(rows, alike=0.8).collect()}
    by_class = {r.doc_id: r.class_id for r in classes(fingerprint_pairs(rows), rows).collect()}
    for found in (group, by_class):
        same = [found[texts[j].doc_id] == found[texts[k].doc_id] for j, k in pairs]
        assert np.mean(same) >= 0.9, np.mean(same)
    linked = {texts[k].doc_id for p in pairs for k in p}
    several = {c for c, n in Counter(group.values()).items() if n > 1}
    text_of = {r.doc_id: " ".join((r.text or "").split()).lower() for r in texts}
    for i, c in group.items():
        assert c not in several or i in linked or any(text_of[i] == text_of[j] for j in group if j != i and group[j] == c)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns with the names that operators give to theirs, in any case."""
    names = "__d __t __k __s __n __lang __score __bits __N_LINES __n_dropped __times __copy __rows __c node component n size key fp".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    return docs.withColumns({n: F.concat(F.lit(f"{n}:"), "doc_id") for n in names}), names


def test_clashing_names(spark, clashing):
    now, names = clashing
    columns = now.columns
    for name, stage in cp.STAGES:
        now = spool(stage(spark, now, SF), name)
        if name != "packing":
            assert now.columns == columns and now.count() > 0
            assert all(r[n] == f"{n}:{r.doc_id}" for r in now.collect() for n in names)


def test_operators_keep_clashing_names(spark, clashing):
    docs, names = clashing
    model = langid.train(docs)
    rows = [toxicity.score(langid.identify(line_dedup(docs), model), toxicity.fit([("a b", 0, "en"), ("c", 1, "en")], epochs=1))]
    for df in rows:
        assert len(set(map(str.lower, df.columns))) == len(df.columns) == len(docs.columns) + 5
        assert all(r[n] == f"{n}:{r.doc_id}" for r in df.collect() for n in names)


def test_language_scores_by_hand(spark):
    """Letter trigrams bound and bundled one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "text", "lang").limit(40)
    rows = docs.collect()
    b = langid.bound()

    def bundle(texts):
        out = np.zeros(langid.DIM)
        for t in texts:
            s = [0] + [langid._symbol(ord(c)) for c in t.lower()] + [0]
            for x, y, z in zip(s, s[1:], s[2:]):
                if y:
                    out += b.parts[0][x].astype(float) * b.parts[1][y] * b.parts[2][z]
        return out

    unit = lambda v: v / np.linalg.norm(v)
    prototypes = {lang: unit(bundle([r.text for r in rows if r.lang == lang and r.text])) for lang in {r.lang for r in rows}}
    found = {r.doc_id: (r["__lang"], r["__score"]) for r in langid.identify(docs, langid.train(docs)).collect()}
    for r in rows[:12]:
        cosine = {lang: unit(bundle([r.text])) @ p for lang, p in prototypes.items()}
        best = max(cosine, key=cosine.get)
        assert found[r.doc_id][0] == best and found[r.doc_id][1] == pytest.approx(max(0, cosine[best]), abs=1e-4)


def test_toxicity_scores_by_hand(spark):
    """The network's layers for one text at a time, place by place."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def score(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        feats = [[zlib.crc32(k.encode()) % toxicity.BUCKETS for k in (w, *(f"{n}|{w[:n]}" for n in (3, 4, 5)))] for w in words]
        e = [sum(model.embedding[k].astype(float) for k in f) for f in feats] or [np.zeros(toxicity.DIM)]
        e += [np.zeros(toxicity.DIM)] * 2  # the padding behind a text
        tops = np.concatenate([np.max([sum(e[p + k] @ f[k] for k in range(len(f)) if p + k < len(e)) for p in range(len(e))], 0) for f in model.filters])
        z = np.maximum(tops + model.bias, 0) @ model.weight + model.offset
        lang = np.argmax(sum(model.langs[f[0]].astype(float) for f in feats)) if feats else 0
        return 1 / (1 + math.exp(-(z - model.threshold[lang] + math.log(0.3 / 0.7))))

    for r in toxicity.score(docs, model).limit(25).collect():
        if len(r.text or "") < 5000:
            assert r["__score"] == pytest.approx(score(r.text), abs=1e-4)


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(i, "vile words " * (1 + i % 50), "en") for i in range(300)] + [(7, "vile words " * 8, "en")] * 500, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 1)] * 400, "doc_id long, toxic int")
    model, seen = None, []
    fit, toxicity.fit = toxicity.fit, lambda rows: seen.extend(rows)
    try:
        model = toxicity.train(docs, labels, max_rows=100, max_bytes=9000)
    finally:
        toxicity.fit = fit
    assert model is None and 0 < len(seen) <= 100 and 8000 < sum(len(t) for t, _, _ in seen) <= 9000


def test_held_out_language_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = QUERIES["op7_language_id"](spark, sf).join(docs, "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() / found.count() > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op8_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    bad, good = (np.array([r.score for r in rows if r.toxic == t]) for t in (1, 0))
    assert (bad[:, None] > good[None]).mean() > 0.8


def test_trigram_vectors_take_memory_as_they_are_met():
    b, r = langid.Bound(), np.random.default_rng(3)
    asked = [np.unique(r.integers(0, langid.CODES, n)) for n in (1, 300, 2000)] + [np.array([5, 5, 0, langid.CODES - 1])]
    for codes in asked * 2:
        x, y, z = codes // langid.SYMBOLS**2, codes // langid.SYMBOLS % langid.SYMBOLS, codes % langid.SYMBOLS
        assert (b[codes] == b.parts[0][x] * b.parts[1][y] * b.parts[2][z]).all()
    assert b.vectors.nbytes < 2 * len(np.unique(np.concatenate(asked))) * langid.DIM
    b[np.arange(langid.CODES)]
    assert b.vectors.nbytes == langid.CODES * langid.DIM
