"""Hard negatives, periodic runs, toxicity."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_TINY
from llm.fixture import by_row, frame, prose, texts
from reportlake.llm import hard_negatives as hn
from reportlake.llm import periodic_runs as pr
from reportlake.llm import toxicity as tx
from reportlake.llm.common import tuned
from reportlake.llm.queries import LLM_QUERIES


# hard negatives

def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) of (id, vector, label) rows, one pair after the other."""
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None
          and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for k, (i, v, y) in enumerate(ok):
        if not is_anchor(i):
            continue
        s = [(-sum(a * b for a, b in zip(v, w)), j, z) for n, (j, w, z) in enumerate(ok) if n != k]
        for ps, p, _ in sorted(t for t in s if t[2] == y)[:positives]:
            fit = sorted(t for t in s if t[2] != y and 30 * -ps <= 100 * -t[0] <= 90 * -ps)[:negatives]
            out += [(i, p, r, j, -ps, -ns) for r, (ns, j, _) in enumerate(fit, 1)]
    return sorted(out)


NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
VECTORS = "vec_id bigint, embedding array<float>, label int, rid bigint, cell string, x int, map map<string,int>"


def vectors(spark, rows):
    return tuned(spark).createDataFrame([(*r, 1, "c", 2, {"a": 1}) for r in rows], VECTORS)


def mined(spark, rows, every=10):
    return sorted(by_row(hn.hard_negatives(vectors(spark, rows), anchor=F.col("vec_id") % every == 0), *NEGATIVE))


def awkward_vectors():
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(6, 10))
    rows = [(i, (heads[i % 6] + 0.4 * rng.normal(size=10)).astype(np.float32).tolist(), int(rng.integers(0, 4)))
            for i in range(300)]
    rows += [(400 + i, rows[20][1], i % 3) for i in range(40)]  # copies: ties in score
    rows += [rows[10], rows[10], rows[33]]  # repeated rows, an anchor among them
    rows += [(None, rows[1][1], 1), (500, None, 1), (510, rows[2][1], None), (520, [None] * 10, 1),
             (530, [float("nan")] * 10, 1), (540, [float("inf")] + [0.0] * 9, 1), (550, [], 1), (560, [1.0] * 4, 2),
             (570, [0.0] * 10, 2), (580, rows[5][1], 77), (590, [3e38] * 10, 1)]
    return rows


def test_hard_negatives_equal_brute_force(spark):
    rows = awkward_vectors()
    got, want = mined(spark, rows), brute_negatives(rows, lambda i: i % 10 == 0)
    assert len({r[0] for r in want}) > 30
    limit = (1 << 63) - 1
    assert [tuple(min(max(x, -limit - 1), limit) for x in r) for r in want if r[0] != 590] == [
        r for r in got if r[0] != 590]


def test_hard_negatives_shards_and_chunks_change_nothing(spark, monkeypatch):
    rows = awkward_vectors()
    want = mined(spark, rows)
    monkeypatch.setattr(hn, "SHARD_ROWS", (16, 16))
    monkeypatch.setattr(hn, "CHUNK", 7)
    monkeypatch.setattr(hn, "STEP", 5)
    monkeypatch.setattr(hn, "FIRST_WAVE", 1)
    assert mined(spark, rows) == want


def test_hard_negatives_without_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(10, [1.0], 1)]) == []
    assert mined(spark, [(11, [1.0, 2.0], 1), (12, [1.0, 2.0], 2)]) == []


def test_cells_are_visited_by_falling_bound():
    rng = np.random.default_rng(1)
    u1, u2 = rng.normal(size=7), rng.normal(size=5)
    got = list(hn.visit(u1, u2))
    assert [b for *_, b in got] == sorted((b for *_, b in got), reverse=True)
    assert sorted((i, j) for i, j, _ in got) == [(i, j) for i in range(7) for j in range(5)]


def test_bounds_hold_and_prune():
    """On clustered vectors the certified search opens a small part of the cells."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(rng.normal(size=(20, 8)), 50, axis=0) * 4 + 0.1 * rng.normal(size=(1000, 8))))
    books = hn.k_means(x[:, :4], 16), hn.k_means(x[:, 4:], 16)
    at = hn.nearest(x[:, :4], books[0]), hn.nearest(x[:, 4:], books[1])
    radii = [np.array([max([0.0, *np.linalg.norm(p[a == c] - b[c], axis=1)]) for c in range(len(b))])
             for p, a, b in ((x[:, :4], at[0], books[0]), (x[:, 4:], at[1], books[1]))]
    rows = np.bincount(at[0] * len(books[1]) + at[1], minlength=len(books[0]) * len(books[1]))
    cells = hn.Cells(8, books, tuple(radii), np.zeros_like(rows), np.ones_like(rows), rows, 10)
    for q in x[::97]:
        s = hn.scores(x, q)
        todo, _ = cells.plan(q, 0, float(np.sort(s)[-5]))
        bound = dict(todo)
        for k in np.nonzero(s >= np.sort(s)[-5])[0]:
            assert bound[at[0][k] * len(books[1]) + at[1][k]] >= s[k]
        assert sum(rows[c] for c in bound) < 300


# periodic runs

def brute_runs(words, least_length=6, least_power=4):
    out = []
    for q in range(1, len(words) // least_power + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            piece = words[i:j + q]
            if len(piece) >= max(least_length, least_power * q) and not any(
                    piece[d:] == piece[:-d] for d in range(1, q)):
                out.append((i, len(piece), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating_text(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        base = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(rng.randint(1, rng.choice([3, 12, 60, 130])))]
        words += base * rng.choice([1, 2, 3, 4, 5]) + base[:rng.randrange(len(base))]
        words += words[-40:] * rng.choice([0, 0, 4])
    return " ".join(words)


def test_runs_equal_brute_force():
    rng = random.Random(4)
    found = 0
    for _ in range(120):
        some = [repeating_text(rng) for _ in range(rng.randint(1, 4))]
        for t, (runs, words, stay) in zip(some, pr.text_runs(some)):
            want = brute_runs(t.split())
            found += len(want)
            assert runs == want
            gone = {k for s, n, q in want for k in range(s + q, s + n)}
            assert stay.tolist() == [k not in gone for k in range(len(words))]
    assert found > 1000


def test_runs_of_long_periods_and_long_texts():
    rng = random.Random(9)
    base = [str(rng.randrange(10**6)) for _ in range(5000)]
    piece = " ".join(base * 4 + base[:17])
    (runs, *_), = pr.text_runs(["x y " + piece + " z"])
    assert runs == [(2, 20_017, 5000)]
    assert pr.text_runs(["a " * 200_000])[0][0] == [(0, 200_000, 1)]
    fib = ["a", "a b"]
    while len(fib[-1]) < 4000:
        fib.append(f"{fib[-1]} {fib[-2]}")
    assert pr.text_runs([fib[-1]])[0][0] == brute_runs(fib[-1].split())


def test_periodic_runs_of_awkward_rows(spark):
    rows = texts() + [(50, "la " * 9 + "end", None), (51, prose(30, 8) + " " + (prose(11, 9) + " ") * 5, None)]
    got = by_row(pr.periodic_runs(frame(spark, rows)), "doc_id", "n_words", "runs", "best", "collapsed")
    want = []
    for i, t, _ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(words) if len(words) < 5000 else pr.text_runs([t])[0][0]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, best, " ".join(w for k, w in enumerate(words) if k not in gone)))
    got = [(i, n, [tuple(r) for r in runs], tuple(best) if best else None, c) for i, n, runs, best, c in got]
    assert got == sorted(want, key=repr)
    assert pr.periodic_runs(frame(spark, [])).count() == 0


def test_op12_query_equals_contract(spark):
    rows = spark.read.parquet(f"{SF_TINY}/documents.parquet").collect()
    cols = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = []
    for r in rows:
        words = [w.decode() for w in (r.text or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(words) if n < 1500 else pr.text_runs([" ".join(words)])[0][0]
        best = pr.strongest(runs) or (None, None, None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
            "".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for k, w in enumerate(words) if k not in gone))]
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha))
    df = LLM_QUERIES["op12_periodic_runs"](spark, SF_TINY)
    assert dict(df.dtypes) == dict.fromkeys(cols[:6], "bigint") | dict.fromkeys(cols[6:], "string")
    assert by_row(df, *cols) == sorted(want, key=repr)
    assert sum(1 for w in want if w[1]) > 10


# toxicity

def brute_vote(index, vectors_, k, without=-1):
    """Cosines with every example, without the lists."""
    v, x = vectors_
    table = np.zeros((len(index.labels), len(index.vocabulary)))
    for t in range(len(index.vocabulary)):
        a, b = index.at[t], index.at[t + 1]
        p = slice(index.first[a], index.first[b])
        table[index.example[p], t] = index.weight[p]
    c = np.round(np.minimum(table[:, v] @ x, 1.0), 9)
    order = [i for i in np.lexsort((np.arange(len(c)), -c)) if c[i] > 0 and i != without][:k]
    return order, c[order]


def example_index(n=700, seed=5):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    examples = [(i, int(rng.random() < 0.3), Counter(rng.choices(words, k=rng.randint(0, 9)))) for i in range(n)]
    return tx.build(examples, sorted(words), np.array([1 + (i % 7) / 3 for i in range(60)])), examples


def test_nearest_examples_are_exact():
    index, examples = example_index()
    assert len(index.labels) > 4 * tx.BLOCK
    for _, _, counts in examples[:200]:
        v = tx.weighted(counts, index.vocabulary, index.idf)
        if not len(v[0]):
            continue
        e, c = index.nearest(*v, k=15)
        want, cosines = brute_vote(index, v, 15)
        assert e.tolist() == list(want) and np.allclose(c, cosines, atol=1e-8)
        out, _ = index.nearest(*v, k=15, without=int(e[0]))
        assert e[0] not in out


def test_index_does_not_depend_on_order():
    index, examples = example_index()
    other = tx.build(examples[::-1], list(index.vocabulary), index.idf)
    assert other.ids == index.ids and np.array_equal(other.curve[1], index.curve[1])


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxicity_of_awkward_rows(spark):
    rng = random.Random(1)
    bad = ["vileword", "nastyness", "hateful"]
    rows = texts() + [(1000 + i, prose(30, 100 + i) + (" " + " ".join(rng.choices(bad, k=3)) if i % 4 == 0 else ""), "en")
                      for i in range(400)]
    known = labels_of(spark, [(1000 + i, 1, int(i % 4 == 0)) for i in range(400)]
                      + [(None, 1, 1), (5, 1, 7), (6, 0, None), (7, 0, 1), (999_999, 1, 1), (1003, 1, 0)])
    got = tx.toxicity(frame(spark, rows), known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted", "evidence"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    for r in out:
        if r.doc_id and r.doc_id >= 1000:
            assert r.predicted == int(r.doc_id % 4 == 0), r
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
            if r.predicted:
                assert all(e.label == 1 for e in r.evidence[:5]) and not tx_held(r.evidence)
    empty = {r.score for r in out if r.doc_id in (6, 7, 8)}
    assert len(empty) == 1 and empty.pop() < 0.3
    assert all(r.held_out for r in out if r.doc_id is None)
    assert [r.score for r in tx.toxicity(frame(spark, texts()), labels_of(spark, [])).collect()] == [0.5] * len(texts())
    assert tx.toxicity(frame(spark, []), known).count() == 0


def tx_held(evidence):
    return [e for e in evidence if zlib.crc32(str(e.doc_id).encode()) % 3 == 1]


def test_op13_finds_held_out_toxic_documents(spark):
    got = LLM_QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.1")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(known, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit = [r.predicted for r in rows if r.toxic == 1]
    alarm = [r.predicted for r in rows if r.toxic == 0]
    assert len(hit) > 100 and sum(hit) / len(hit) > 0.75 and sum(alarm) / len(alarm) < 0.03
    assert sum((r.score - r.toxic) ** 2 for r in rows) / len(rows) < 0.04  # calibrated: 0.095 for the prior alone


def test_op11_and_op13_are_pure(spark):
    """The same rows dealt otherwise give the same results."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    known = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    tuned(spark)
    one = by_row(tx.toxicity(docs, known), "doc_id", "score")
    assert by_row(tx.toxicity(docs.repartition(7), known.repartition(3)), "doc_id", "score") == one
