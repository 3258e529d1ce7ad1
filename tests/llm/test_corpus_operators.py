"""Operators over the whole corpus: near-duplicates, repeats, benchmark items, models, pipeline."""

import hashlib
import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from conftest import SF_SMALL, SF_TINY
from llm.fixture import ascii_lower, by_row, frame, prose, texts
from reportlake.llm.common import tuned
from reportlake.llm import decontaminate, language_id, near_dedup, quality_model
from reportlake.llm.components import components
from reportlake.llm.queries import LLM_ORACLES, LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_TINY}/{table}.parquet'")
    cur = con.execute(LLM_ORACLES[name])
    cols = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    df = LLM_QUERIES[name](spark, SF_TINY)
    assert sorted(df.columns) == cols
    assert by_row(df, *cols) == want


# components

def test_components_of_awkward_graphs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    edges = chain + star + [(7, 7), (3, 2), (2, 3), (9, 560), (None, 4), (161, 100)]
    got = {r.u: r.v for r in components(spark, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {i: 100 for i in range(101, 162)} | {i: 500 for i in range(501, 560)} | {3: 2, 560: 9}
    assert got == want
    assert components(spark, spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# near-duplicates

def shingle_set(text, k):
    w = ascii_lower(text or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows, k):
    sets = [shingle_set(t, k) for _, t, _ in rows]
    root = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, s), (b, t) in itertools.combinations([(r[0], x) for r, x in zip(rows, sets)], 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i)
                   for (i, *_), s in zip(rows, sets)), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    base = prose(60, 20).split()
    chain = []
    for i in range(14):  # each near the next one, ends far apart
        base = base[:3 * i] + [f"w{i}"] + base[3 * i + 1:]
        chain.append((400 + i, " ".join(base), None))
    family = prose(400, 21).split()
    group = [(600 + i, " ".join(family[:(7 * i) % 390] + [f"v{i}"] + family[(7 * i) % 390 + 1:]), None)
             for i in range(40)]
    rows = texts() + chain + group + [(20, prose(50, 30), None), (20, base and " ".join(base), None)]
    got = near_dedup.near_duplicates(frame(spark, rows), words=k)
    assert by_row(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(rows, k)


def family(members, seed=40):
    """Texts of one template, no two linked: 200 common words, a tail of 30 that the first lacks, 22 changed words each."""
    base, tail = prose(200, seed).split(), prose(30, seed + 1).split()
    out = []
    for i in range(members):
        words = list(base) + (tail if i else [])
        for k in range(22):
            words[(37 * i + 9 * k) % 200] = f"m{i}x{k}"
        out.append((i, " ".join(words), None))
    return out


def test_candidates_of_a_family_grow_with_its_members(spark, monkeypatch):
    """Pairs confirmed per member stay level as a family grows."""
    per_member = []
    for members in (100, 200, 400):
        seen = []
        kept = near_dedup.staged

        def counted(session, df, name):
            out = kept(session, df, name)
            if name == "pairs":
                seen.append(out.count())
            return out
        with monkeypatch.context() as m:
            m.setattr(near_dedup, "staged", counted)
            got = near_dedup.near_duplicates(frame(spark, family(members)), words=2)
            assert {r.component_id for r in got.collect()} == set(range(members))
        per_member.append(sum(seen) / members)
    assert per_member[-1] < 6 and per_member[-1] < 1.3 * per_member[0] + 1, per_member


def test_links_between_members_far_from_the_pivot_are_found(spark):
    """Pairs of near copies inside a family whose other members are not linked."""
    rows = family(120)
    for i in range(0, 120, 10):
        words = rows[i][1].split()
        words[3] = f"copy{i}"
        rows.append((1000 + i, " ".join(words), None))
    got = near_dedup.near_duplicates(frame(spark, rows), words=2)
    assert by_row(got, "doc_id", "n_shingles", "component_id", "kept") == brute_near(rows, 2)


def test_keep_one_keeps_columns_of_any_name_and_type(spark):
    names = ("_key", "key", "row", "order", "id", "id_", "text_", "rep", "comp", "p", "m", "_row", "_mark", "_id", "_text")
    schema = "doc_id int, text string, tags map<string,int>, " + ", ".join(f"{n} string" for n in names)
    base, other = prose(40, 50), prose(40, 51)
    ids = [(1, base), (2, base), (3, other), (4, base), (4, other + " more"), (5, base), (5, base), (None, base), (6, None), (6, "")]
    rows = [(i, t, {"k": k}, *[f"{n}-{k}" for n in names]) for k, (i, t) in enumerate(ids)]
    docs = tuned(spark).createDataFrame(rows, schema)
    got = near_dedup.keep_one(docs)
    assert got.schema == docs.schema
    out = [tuple(r) for r in got.collect()]
    assert all(r in rows for r in out)
    assert sorted((r[0], r[1]) for r in out if r[0] is not None and r[1]) == sorted([(1, base), (3, other)])
    assert sorted(r[1] is None for r in out if r[0] == 6) == [False, True] and sum(r[0] is None for r in out) == 1
    alone = docs.where("doc_id < 4")
    assert by_row(near_dedup.keep_one(alone), "doc_id", "_key") == [(1, "_key-0"), (3, "_key-2")]



def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.near_duplicates(frame(spark, [(1, None, None), (None, "", None)])).where("kept").count() == 2


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared in (2950, 2800, 2000):
        sets = [np.sort(pool[:2990]), np.sort(np.concatenate([pool[:shared], pool[2990:]]))]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        m = near_dedup.minhash(sets, near_dedup.SKETCH_SAMPLES)
        bits = near_dedup.odd_sketches(m, near_dedup.SKETCH_SAMPLES, near_dedup.SKETCH_BITS)
        n, k = near_dedup.SKETCH_BITS, near_dedup.SKETCH_SAMPLES
        flips = int(np.bitwise_count(bits[0].view(np.uint64) ^ bits[1].view(np.uint64)).sum())
        assert abs(1 + n / (4 * k) * np.log(1 - 2 * flips / n) - true) < 0.12


# repeated passages

def brute_repeats(rows, window):
    lists = [(t or "").encode().split() for _, t, _ in rows]
    count = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (i, *_), w in zip(rows, lists):
        gone = {j for a in range(len(w) - window + 1) if count[tuple(w[a:a + window])] > 1
                for j in range(a, a + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [35, 12])
def test_repeated_passages_equal_brute_force(spark, window):
    from reportlake.llm.substring_dedup import repeated_passages
    hot = prose(50, 40)
    rows = texts() + [(700 + i, prose(30, 41 + i) + " " + hot + " " + prose(30, 141 + i), None) for i in range(60)]
    rows += [(800, "a b c d e " * 30, None), (801, "same " * 200, None)]
    got = repeated_passages(frame(spark, rows), window)
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, window)
    for r in got.collect():
        assert sum(s["last"] - s["first"] + 1 for s in r["removed"] or []) == r["n_removed"]
    assert repeated_passages(frame(spark, []), window).count() == 0


def test_automata_compare_words_in_blocks(spark, monkeypatch):
    from reportlake.llm import substring_dedup
    for name, size in (("AUTOMATON_WORDS", 60), ("HOME_ANCHORS", 3), ("TASK_ANCHORS", 5)):
        monkeypatch.setattr(substring_dedup, name, size)
    rows = [(i, prose(20, i) + " " + prose(150, 1000 + i % 3), None) for i in range(12)]
    got = substring_dedup.repeated_passages(frame(spark, rows), 20)
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, 20)
    a = substring_dedup.PhraseAutomaton([b"a b c d", b"x y z"], 3)
    assert a.starts(b"q a b c d x y z") == [1, 2, 5]


def test_unlinked_texts_of_one_id_stay(spark):
    one, two, three = prose(80, 31), prose(80, 32), prose(80, 33)
    near = " ".join([*two.split()[:40], "changed", *two.split()[41:]])
    rows = [(1, one), (1, two), (1, two), (1, near), (2, three), (3, two), (3, None), (3, ""), (None, one), (4, one),
            (5, three), (5, one), (5, prose(50, 34)), (0, three), (6, prose(50, 35)), (6, prose(50, 35))]
    got = near_dedup.keep_one(frame(spark, [(i, t, "en") for i, t in rows]))
    assert got.columns == frame(spark, []).columns
    assert by_row(got, "doc_id", "text") == sorted(
        [(1, one), (1, min(two, near)), (3, None), (3, ""), (None, one), (5, prose(50, 34)), (0, three),
         (6, prose(50, 35))], key=repr)


# benchmark items

ITEMS = [(1, "What stands on the quiet hill? A copper lamp and nine grey stones."), (2, prose(45, 60)), (3, None),
         (None, "ignored"), (4, ""), (5, "word"), (2, prose(45, 61)), (6, prose(45, 60))]


def items_frame(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "item_id bigint, text string, doc_id string, score double")


def test_contamination_finds_verbatim_items_only(spark):
    a, b = ITEMS[0][1], ITEMS[1][1]
    rows = texts() + [(50, prose(300, 70) + " " + a.upper() + " " + prose(300, 71), None), (51, b, None),
                      (52, b.replace(" ", "\n"), None), (53, " ".join(b.split()[:20]), None), (None, a, None),
                      (54, prose(500, 72) + ITEMS[6][1], None), (54, prose(500, 72) + ITEMS[6][1], None)]
    got = decontaminate.contamination(frame(spark, rows), items_frame(spark))
    assert by_row(got, "doc_id", "item_id") == sorted(
        [(50, 1), (51, 2), (51, 6), (52, 2), (52, 6), (None, 1), (54, 2), (54, 2)], key=repr)
    assert got.where("score < 0.6 or overlap < 0.8").count() == 0
    kept = decontaminate.drop_contaminated(frame(spark, rows), items_frame(spark))
    assert kept.columns == frame(spark).columns
    assert by_row(kept, "doc_id") == by_row(frame(spark, texts()).unionByName(frame(spark, rows[-4:-3])), "doc_id")
    for d, i in ((frame(spark, []), items_frame(spark)), (frame(spark), items_frame(spark, []))):
        assert decontaminate.contamination(d, i).count() == 0


def test_questions_alone_and_near_copies_are_found(spark):
    q = [f"ask{i}" for i in range(25)]
    a = [f"say{i}" for i in range(13)]
    item = " ".join(q) + ". " + " ".join(a)
    changed = q[:8] + ["other"] + q[9:16] + ["word"] + q[17:]
    items = items_frame(spark, [(1, item), (2, "alpha beta"), (3, "two plus two is four"), (4, "a b c d")])
    rows = [(1, " ".join(q)), (2, " ".join([*changed, *a])), (3, " ".join([*q, *a[:6], "else", *a[7:]])),
            (4, "an alpha beta text a b c d"), (5, "so two plus two is four here"), (6, "two plus two five is four"),
            (7, " ".join(q[:10] + a[:3])), (8, prose(40, 1) + " " + " ".join(q) + " " + prose(300, 2))]
    docs = frame(spark, [(i, t, None) for i, t in rows])
    got = decontaminate.contamination(docs, items)
    assert by_row(got, "doc_id", "item_id") == [(1, 1), (2, 1), (3, 1), (5, 3), (8, 1)]
    assert by_row(decontaminate.drop_contaminated(docs, items), "doc_id") == [(4,), (6,), (7,)]


def test_contamination_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHORT_BYTES", 100)
    rows = texts() + [(50, ITEMS[0][1], None), (51, ITEMS[1][1], None)]
    for index_bytes, pass_bytes in ((200, 1 << 20), (200, 1)):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", index_bytes)
        monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
        got = decontaminate.contamination(frame(spark, rows), items_frame(spark))
        assert by_row(got, "doc_id", "item_id") == [(50, 1), (51, 2), (51, 6)]
        kept = decontaminate.drop_contaminated(frame(spark, rows), items_frame(spark))
        assert by_row(kept, "doc_id") == by_row(frame(spark, texts()), "doc_id")


def test_large_items_make_small_indexes():
    """One very long item, and many items: what is sent grows with their words, not with a product."""
    words = [f"w{i}" for i in range(40_000)]
    items = [(0, " ".join(words))] + [(i, " ".join(words[40 * i:40 * i + 40])) for i in range(1, 500)]
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    index = decontaminate.build_index(items, df, len(items), 100.0, with_questions=True)
    assert index.nbytes() < 40 * sum(len(t) for _, t in items)  # dense tables took 641 MB for such an item
    got = decontaminate.leaks(index, [" ".join(words[400:440]), " ".join(words[:35_000]), "w1 w3 w5"])
    assert set(got[0]) == {10} and set(got[1]) >= {0, 7} and not got[2]


def test_floors_are_parameters(spark):
    items = items_frame(spark, [(1, "alpha beta"), (2, "two plus two is four")])
    docs = frame(spark, [(1, "an alpha beta text", None), (2, "so two plus two is four here", None)])
    assert by_row(decontaminate.contamination(docs, items), "doc_id", "item_id") == [(2, 2)]
    assert by_row(decontaminate.contamination(docs, items, shortest=0), "doc_id", "item_id") == [(1, 1), (2, 2)]
    assert by_row(decontaminate.drop_contaminated(docs, items, least=0, shortest=0), "doc_id") == []


def test_retrieval_keeps_what_the_rule_finds():
    """Fragments that hold just over half of a question: found by the rule alone, and through the index."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnop"))
    word = lambda: "".join(rng.choice(letters, 3 if rng.random() < 0.5 else 7))
    common = [word() for _ in range(60)]
    item = lambda: [common[rng.zipf(1.3) % 60] if rng.random() < 0.5 else word() for _ in range(38)]
    items = [(i, " ".join(w[:28]) + ". " + " ".join(w[28:])) for i, w in ((i, item()) for i in range(200))]
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    index = decontaminate.build_index(items, df, len(items), 38.0, with_questions=True)
    hit = due = 0
    for i, t in items:
        q, _ = decontaminate.question_answer(t)
        k = int(rng.integers(0, len(q) - 17))
        text = " ".join(item()) + " " + " ".join(w.decode() for w in q[k:k + 17]) + " " + " ".join(item())
        have, asked = decontaminate.shingles(decontaminate.words_of(text)), decontaminate.shingles(q)
        if len(asked & have) >= 0.5 * len(asked):
            due += 1
            hit += i in decontaminate.leaks(index, [text])[0]
    assert due > 150 and hit >= 0.98 * due, (hit, due)


def test_wand_retrieves_all_above_threshold():
    """The bounds against exact scores of every passage and item."""
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, 30) % 300)) for i in range(60)]
    df = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    index = decontaminate.build_index(items, df, len(items), 30.0, threshold=0.35)
    rows = [np.unique(rng.integers(0, len(index.term), 80)) for _ in range(200)]
    dense = np.zeros((60, len(index.term)))
    for i in range(60):
        here = slice(index.row_start[i], index.row_start[i + 1])
        dense[i, index.row_terms[here]] = index.row_impacts[here]
    rows += [np.nonzero(dense[i])[0] for i in range(60)]
    got = decontaminate.retrieve(index, np.repeat(np.arange(len(rows)), [len(r) for r in rows]),
                                 np.concatenate(rows), len(rows))
    want = {(p, i): s for p, r in enumerate(rows) for i in range(60)
            if (s := float(dense[i][r].sum())) >= 0.35}
    assert {(p, i) for p, i, _ in got} == set(want) and len(want) > 60
    assert all(abs(s - want[p, i]) < 1e-9 for p, i, s in got)


def test_leaks_of_the_tables_are_found(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    sets = [(r["item_id"], decontaminate.shingles(decontaminate.words_of(r["text"]))) for r in items]
    want = []
    for d in docs:
        have = decontaminate.shingles(decontaminate.words_of(d["text"]))
        want += [(d["doc_id"], i) for i, s in sets if len(s & have) >= 0.8 * len(s)]
    got = LLM_QUERIES["op6_decontamination"](spark, SF_SMALL)
    assert by_row(got, "doc_id", "item_id") == sorted(want, key=repr) and want


# language

def test_viterbi_equals_exhaustive_search(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k = int(rng.integers(1, 7)), 3
        s = -rng.random((n, k)) * 4
        value = lambda p: sum(s[i, p[i]] for i in range(n)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(k), repeat=n)))
        monkeypatch.setattr(language_id, "STRETCH", int(rng.integers(1, 4)))
        got = language_id.viterbi(np.concatenate([s, s]), np.array([n, 0, n]), 1.5)
        assert (got[:n] == got[n:]).all() and abs(value(got[:n]) - best) < 1e-9


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = LLM_QUERIES["op7_language_id"](spark, SF_SMALL).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][0] for r in held) >= 0.97 * len(held)


def test_language_of_mixed_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language_id.fit(docs)
    one = {lang: docs.where(f"lang = '{lang}' and n_chars > 1500").orderBy("doc_id").first()["text"][:1200]
           for lang in ("de", "es")}
    (lang, score, spans), = language_id.label_texts(model, [one["de"] + " " + one["es"]])
    assert [s[2] for s in spans] == ["de", "es"] and 0.4 < score < 0.7
    got = language_id.languages(frame(spark)).collect()
    odd = [r for r in got if r["doc_id"] in (6, 7, 8)]
    assert len(got) == len(texts()) and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in odd)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert language_id.languages(frame(spark, [])).count() == 0


def test_scripts_narrow_the_candidates():
    table = np.zeros((language_id.BUCKETS, 2), dtype=np.float32)
    allowed = np.array([[s == "greek", s == "latin"] for s in language_id.SCRIPTS])
    model = language_id.Model(["el", "en"], table, allowed)
    assert [x[2] for x in language_id.label_texts(model, ["λόγος " * 9 + "word " * 9])[0][2]] == ["el", "en"]


# quality

def test_quality_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    rows = LLM_QUERIES["op9_quality_classifier"](spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_discriminant_equals_its_formula():
    rng = np.random.default_rng(1)
    d = len(quality_model.FEATURES)
    x = {0: rng.normal(0, 1, (200, d)), 1: rng.normal(1, 2, (300, d))}
    model = quality_model.solve_model({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()})
    z = (np.concatenate([x[0], x[1]]) - model.centre) / model.scale
    log = []
    for label in (0, 1):
        own = (x[label] - model.centre) / model.scale
        cov = np.cov(own.T, bias=True)
        s = quality_model.SHRINKAGE
        cov = (1 - s) * cov + s * (np.trace(cov) / d + quality_model.LEAST_VARIANCE) * np.eye(d)
        r = z - own.mean(axis=0)
        log.append(np.log(len(own) / 500) - 0.5 * np.linalg.slogdet(cov)[1]
                   - 0.5 * np.einsum("ij,jk,ik->i", r, np.linalg.inv(cov), r))
    assert np.allclose(model.score(np.concatenate([x[0], x[1]])), 1 / (1 + np.exp(log[0] - log[1])))


@pytest.mark.parametrize("labels, expected", [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, None, 0), (None, 1, 0)], 0.5)])
def test_quality_without_usable_labels(spark, labels, expected):
    df = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality_model.quality_scores(frame(spark), df).collect()
    assert len(got) == len(texts()) and {r["score"] for r in got} == {expected}
    assert quality_model.quality_scores(frame(spark, []), df).count() == 0


# pipeline

def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline
    docs = frame(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_TINY)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert stage(spark, frame(spark, []), SF_TINY).count() == 0, name
    assert docs.where("doc_id = 16").count() <= 1


def test_pipeline_equals_its_parts(spark):
    """Every stage against the rows that brute force leaves."""
    import corpus_pipeline
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = spark.read.parquet(f"{SF_TINY}/labels.parquet")
    good = {r["doc_id"] for r in quality_model.quality_scores(
        spark.read.parquet(f"{SF_TINY}/documents.parquet"), labels).where("predicted = 1").collect()}
    left = [r for r in docs if r[0] in good]
    keep = {r[0] for r in brute_near(left, 5) if r[3]}
    sets = [decontaminate.shingles(decontaminate.words_of(r["text"]))
            for r in spark.read.parquet(f"{SF_TINY}/benchmark.parquet").collect()]
    want = []
    for i, t, _ in left:
        have = decontaminate.shingles(decontaminate.words_of(t))
        if i in keep and not any(len(s & have) >= 0.8 * len(s) for s in sets):
            want.append(i)
    got = corpus_pipeline.run(spark, SF_TINY)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    assert 0 < len(want) < len(docs)
