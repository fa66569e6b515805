"""Filter audit, vector search and importance resampling against brute force, with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import filter_audit, importance_resample, vector_search

DOCS = "doc_id long, text string, lang string, rank string, mask string"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, part, "r", "m") for i, t, part in texts], DOCS)


def odd_texts(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 90, 100, 150, 400]))) for _ in range(40)]
    texts += [" ".join(rng.sample(words, 120)), " ".join(rng.sample(words, 120)).upper(), "", None, "x" * 50_000, "A B\x0bc" + " d$" * 200, "Été " * 130]
    rows = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    rows += [(100 + k, rng.choice(texts), rng.choice(["en", "de"])) for k in range(30)]
    return rows + [rows[3], rows[3], (3, texts[5], "en"), (None, texts[0], "en"), (None, None, None), (None, texts[0], "en")]


def audited(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[x] == 1} for x in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    counts = Counter()
    for i, t, part in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i]
        mine = [f for f, bad in zip("ABCDE", fails, strict=True) if bad]
        for order in itertools.permutations("ABCDE"):
            removed = next((k for k, f in enumerate(order) if f in mine), 5)
            for step, f in enumerate(order):
                key = (part or "", "".join(order), step + 1)
                counts.update({(*key, name): int(x) for name, x in (("kept", step < removed), ("removed", step == removed), ("redundant", step > removed and f in mine), ("unique_fails", mine == [f]), ("good_lost", step == removed and i in good), ("toxic_lost", step == removed and i in toxic))})
                counts[part or "", f, "shapley"] += step == removed
    return {(*key, *(counts[(*key, m)] for m in filter_audit.METRICS[:-1]), counts[key[0], key[1][key[2] - 1], "shapley"]) for key in {k[:3] for k in counts if len(k) == 4}}


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_of_all_orders(spark, seed):
    rows = odd_texts(seed)
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 130, 2)] + [(3, 1, None), (3, 0, 1), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    found = filter_audit.audit_filters(rows_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r) for r in found} == audited(rows, labels)
    assert len(found) == 600 * len({p or "" for _, _, p in rows})


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert not filter_audit.audit_filters(rows_of(spark, []), labels).collect()


# Importance resampling


def resampled(docs, target, percent=25):
    def runs(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [zlib.crc32(x.encode()) % 10_000 for x in [*ws, *(f"{a} {b}" for a, b in itertools.pairwise(ws))]]

    of = [runs(t) for _, t, _ in docs]
    s, t = Counter(b for _, bs in of for b in bs), Counter(b for x in target for b in runs(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, *_), (n, bs) in zip(docs, of, strict=True):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        rows.append((i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((k for k, r in enumerate(rows) if r[4] >= 20), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    rank = {k: at + 1 for at, k in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r[:4], rank.get(k)) for k, r in enumerate(rows))


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_resampling_draws_the_exact_rows(spark, percent):
    rows = odd_texts(3) + [(7, "ÉA b " * 30, "en")] * 9 + [(-5, "q r s " * 9, "en")]
    target = ["w1 w2 w3", None, "", "W4 w5 Éa"]
    found = importance_resample.resample(rows_of(spark, rows), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), percent)
    assert Counter(tuple(r) for r in found.collect()) == resampled(rows, target, percent)


def test_draws_with_wide_keys_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice([rng.randrange(-(2**62), 2**62), 5, 6]), rng.choice([5, 50]), rng.choice([40, 41]), 0, rng.choice([rng.randrange(-(10**6), 10**6), 3])) for _ in range(500)] + [(5, 50, 40, 0, 3)] * 200
    scored = spark.createDataFrame(rows, "doc_id long, n_words int, n_features long, weight long, score long").repartition(7)
    for percent in (1, 37, 90):
        found = importance_resample.draw(scored, percent).collect()
        able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0], r[2]))
        drawn = able[: percent * len(able) // 100]
        assert [tuple(r)[:4] for r in sorted((r for r in found if r.rank), key=lambda r: r.rank)] == [(r[0], *r[2:]) for r in drawn]
        assert sorted(r.rank for r in found if r.rank) == list(range(1, len(drawn) + 1)) and len(found) == len(rows)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not importance_resample.resample(rows_of(spark, []), none).collect()
    assert len(importance_resample.resample(rows_of(spark, [(1, "a b " * 20, "en")] * 4), none).collect()) == 4


# Vector search


def nearest(rows, queries, k=5):
    out = {}
    unit = lambda v: np.array(v) / np.max(np.abs(v))
    for q in queries:
        a = unit(min(v for i, v in rows if i == q))
        scored = sorted((-(a @ unit(v)) / (math.sqrt(a @ a) * math.sqrt(unit(v) @ unit(v))), i) for i, v in set(rows) if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank string, score double")


def search(spark, rows):
    out = {}
    for r in vector_search.search(vectors(spark, rows), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, tuple(rng.standard_normal(7))) for i in range(230)]
    rows += [(300 + i, rows[50][1]) for i in range(20)] + [rows[100]] * 9 + [(50, tuple(2 * x for x in rows[3][1])), (400, tuple(1e200 * x for x in rows[4][1]))]
    bad = [(0, None), (50, (0.0,) * 7), (100, (float("nan"),) * 7), (450, (float("inf"), *[1.0] * 6)), (500, (None, *[1.0] * 6)), (550, (1.0, 2.0)), (600, ()), (None, (1.0,) * 7)]
    found, want = search(spark, rows + bad), nearest(rows, [0, 50, 100, 150, 200, 300, 400])
    assert found.keys() == want.keys()
    for q, best in want.items():
        assert {i for i, _ in found[q]} == {i for i, _ in best}
        assert np.allclose([s for _, s in found[q]], [s for _, s in best], rtol=0, atol=1e-14)


def test_few_and_no_vectors(spark):
    assert search(spark, []) == {} and search(spark, [(0, None)]) == {} and search(spark, [(0, (1.0, 0.0))]) == {}
    assert search(spark, [(0, (1.0, 0.0)), (1, (0.0, 2.0)), (50, (-3.0, 0.0))]) == {0: [(1, 0.0), (50, -1.0)], 50: [(1, 0.0), (0, -1.0)]}


def test_recall_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERIES", 16)
    monkeypatch.setattr(vector_search, "BLOCK", 100)
    rng = np.random.default_rng(2)
    hub = rng.standard_normal(32)
    near = [tuple((hub + 0.05 * rng.standard_normal(32)).tolist()) for _ in range(1500)]
    rows = [(i, v) for i, v in enumerate(near + [tuple(hub.tolist())] * 1500 + [tuple(x) for x in rng.standard_normal((2000, 32)).tolist()])]
    found = search(spark, rows)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, len(rows), 50):
        s = x @ x[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(rows)), -np.round(s, 12)))[:5].tolist()
        hits.append(len({i for i, _ in found[q]} & set(best)) / 5)
        assert len(found[q]) == 5 and np.allclose([v for _, v in found[q]], [s[i] for i, _ in found[q]], atol=1e-12)
    assert len(hits) == 100 and np.mean(hits) >= 0.9
