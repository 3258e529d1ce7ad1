"""Toxicity by the nearest labelled examples.

Terms are the words of letters, lower-cased, and the first letters of longer words
(so that the forms of one stem meet). The vocabulary holds the terms whose
presence tells the two labels apart (by log-likelihood ratio and lift over the
labelled texts); weights are TF-IDF, of length one per text.

The examples lie in blocks, ordered so that similar ones are neighbours. For each
term there is a list of the blocks that hold it, with the greatest weight in
each. A text's terms and these block maxima bound what any example of a block
can score, blocks are opened by falling bound, and the search stops where the
next bound is below the similarity of the last example wanted: the nearest
examples by exact cosine, without scoring the others.

Each of the nearest votes with a weight that grows as its distance shrinks,
against a fixed weight for the share of toxic examples among those that share no
term with the text; the votes found for the examples themselves (each without
itself) calibrate the score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm.common import id_bucket, letter_words, map_rows
from reportlake.llm.components import staged

#: Labelled texts that teach, at most about this many (a sample by a hash of the text).
TRAIN_DOCS = 40_000
#: Terms are kept from this log-likelihood ratio on, if they are ``LEAST_LIFT`` times as
#: frequent under one label as under the other; at most ``MAX_TERMS`` of the highest.
LEAST_RATIO, LEAST_LIFT, LEAST_TEXTS, MAX_TERMS = 30.0, 4.0, 3, 4096
#: Letters of the stems beside the whole words.
STEM = 4
BLOCK = 64
#: Votes remembered by each worker.
MEMO = 20_000
#: Examples whose own votes calibrate the scores, at most about this many (spread over the index).
CALIBRATE = 4_000
#: Examples that vote, and the weight of the prior share beside them.
NEAREST, PRIOR_WEIGHT = 15, 1.0
#: Rows whose id falls into this remainder teach nothing.
HOLD_OUT = (3, 1)
TOXIC = 0.7


def terms(text: str, known: frozenset[str] | None = None) -> Counter:
    """Counts of the words and stems of a text, of those in ``known`` if it is given."""
    listed = letter_words(text)
    if known is not None:
        distinct = set(listed)
        hit = distinct & known
        stems = {w[:STEM] + "-" for w in distinct} & known
        if not hit and not stems:
            return Counter()
        listed = [w for w in listed if w in hit or w[:STEM] + "-" in stems]
        return Counter({t: n for t, n in terms(" ".join(listed)).items() if t in known})
    words = Counter(listed)
    out = Counter(words)
    for w, n in words.items():
        if len(w) > STEM:
            out[w[:STEM] + "-"] += n
    return out


@dataclass
class Index:
    """Examples with their block-max lists. Postings of term v in block b are
    ``example[first[k]:first[k + 1]]`` and ``weight[...]``, k being a place in
    ``at[v]:at[v + 1]`` where ``block[k] == b`` and ``most[k]`` is the greatest weight."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    labels: np.ndarray
    ids: list[int]
    at: np.ndarray
    block: np.ndarray
    most: np.ndarray
    first: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    empty_share: float  # toxic share of the examples without any term
    share: float  # toxic share of all examples
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]),) * 2)
    #: Votes already found, by vector: many texts hold the same one or two terms.
    votes: dict = field(default_factory=dict)

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.vocabulary)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a text, of length one."""
        return weighted(terms(text, self.known), self.vocabulary, self.idf)

    def nearest(self, v: np.ndarray, x: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the highest positive cosine (ties: first in the index)
        and their cosines, the example ``without`` left out."""
        at, weight = _spans(self.at[v], self.at[v + 1], x)  # the lists of the text's terms, one after the other
        block = self.block[at]
        bound = np.bincount(block, weight * self.most[at])
        blocks = np.nonzero(bound)[0]
        blocks = blocks[np.argsort(-bound[blocks], kind="stable")]
        rank = np.empty(len(bound), dtype=np.int64)
        rank[blocks] = np.arange(len(blocks))
        place = rank[block]
        found, cosines, step, done = np.zeros(0, dtype=np.int64), np.zeros(0), 4, 0
        while done < len(blocks):
            if len(found) == k and bound[blocks[done]] < cosines[-1] - 1e-9:
                break
            some = np.nonzero((place >= done) & (place < done + step))[0]
            p, w = _spans(self.first[at[some]], self.first[at[some] + 1], weight[some])
            e = self.example[p]
            table = np.bincount((rank[e // BLOCK] - done) * BLOCK + e % BLOCK, w * self.weight[p])
            e = np.nonzero(table)[0]
            c = np.round(np.minimum(table[e], 1.0), 9)
            e = blocks[done + e // BLOCK] * BLOCK + e % BLOCK
            done, step = done + step, step * 2
            keep = e != without
            e, c = np.concatenate([found, e[keep]]), np.concatenate([cosines, c[keep]])
            if len(c) > 4 * k:
                most = c >= np.partition(c, len(c) - k)[len(c) - k]
                e, c = e[most], c[most]
            best = np.lexsort((e, -c))[:k]
            found, cosines = e[best], c[best]
        return found, cosines

    def vote(self, v: np.ndarray, x: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Distance-weighted share of toxic votes, and the voters with their cosines."""
        if not len(v):
            return self.empty_share, np.zeros(0, dtype=np.int64), np.zeros(0)
        e, c = self.nearest(v, x, without=without)
        w = c / (1.05 - c)
        return float((w @ self.labels[e] + PRIOR_WEIGHT * self.share) / (w.sum() + PRIOR_WEIGHT)), e, c

    def score(self, text: str) -> tuple[float, list[tuple[int, float, int]]]:
        """Calibrated score of a text, and the evidence: (id, cosine, label) of the voters."""
        v, x = self.vector(text)
        key = v.tobytes(), x.tobytes()
        if key not in self.votes:
            if len(self.votes) >= MEMO:
                self.votes.clear()
            self.votes[key] = self.vote(v, x)
        raw, e, c = self.votes[key]
        return float(np.interp(raw, *self.curve)), [
            (self.ids[i], float(s), int(self.labels[i])) for i, s in zip(e.tolist(), c.tolist())]


def _spans(first: np.ndarray, last: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges first..last - 1, and each range's ``x`` for every place."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(x, n)


def weighted(counts: Counter, vocabulary: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = sorted((vocabulary[t], n) for t, n in counts.items() if t in vocabulary)
    v = np.array([t for t, _ in got], dtype=np.int64)
    x = (1 + np.log(np.array([n for _, n in got], dtype=np.float64))) * idf[v] if got else np.zeros(0)
    return v, x / np.linalg.norm(x) if got else x


def log_likelihood(a, b, n_a: float, n_b: float):
    """G-squared of a term in ``a`` of ``n_a`` toxic and ``b`` of ``n_b`` other texts (numbers or Columns)."""
    def part(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    n, df = n_a + n_b, a + b
    return 2 * (part(a, df * (n_a / n)) + part(b, df * (n_b / n))
                + part(n_a - a, (n - df) * (n_a / n)) + part(n_b - b, (n - df) * (n_b / n)))


def pooled(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps from raw votes to the share of toxic examples around them (pool
    adjacent violators), as points to interpolate between."""
    order = np.argsort(scores, kind="stable")
    stack: list[list[float]] = []  # sums of labels, weights, scores
    for s, y, w in zip(scores[order].tolist(), labels[order].tolist(), weights[order].tolist()):
        stack.append([w * y, w, w * s])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            y2, n2, s2 = stack.pop()
            stack[-1] = [stack[-1][0] + y2, stack[-1][1] + n2, stack[-1][2] + s2]
    return (np.array([0.0, *[s / n for _, n, s in stack], 1.0]),
            np.array([stack[0][0] / stack[0][1], *[y / n for y, n, _ in stack], stack[-1][0] / stack[-1][1]]))


def build(examples: list[tuple[int, int, Counter]], vocabulary: list[str], idf: np.ndarray) -> Index:
    """Index of (id, label, counts of terms) examples; equal whatever their order."""
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = [(*weighted(c, number, idf), y, i) for i, y, c in examples]
    blank = [y for v, _, y, _ in rows if not len(v)]
    # Neighbours share their heaviest terms.
    full = sorted((r for r in rows if len(r[0])), key=lambda r: (r[0][np.lexsort((r[0], -r[1]))].tolist(), r[3], r[2]))
    n_toxic = sum(y for _, _, y, _ in rows)
    share = (n_toxic + 0.5) / (len(rows) + 1)
    empty = (sum(blank) + share) / (len(blank) + 1)
    v = np.concatenate([r[0] for r in full]) if full else np.zeros(0, dtype=np.int64)
    x = np.concatenate([r[1] for r in full]) if full else np.zeros(0)
    e = np.repeat(np.arange(len(full)), [len(r[0]) for r in full])
    order = np.lexsort((e, v))
    v, x, e = v[order], x[order], e[order]
    key = v * (len(full) // BLOCK + 1) + e // BLOCK
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    index = Index(number, idf, np.array([r[2] for r in full], dtype=np.float64), [r[3] for r in full],
                  np.searchsorted(v[first], np.arange(len(vocabulary) + 1)), e[first] // BLOCK,
                  np.maximum.reduceat(x, first) if len(x) else x, np.append(first, len(v)), e, x, empty, share)
    if rows:
        some = range(0, len(full), max(1, len(full) // CALIBRATE))
        raw = [index.vote(full[i][0], full[i][1], without=i)[0] for i in some] + [empty]
        index.curve = pooled(np.array(raw), np.append(index.labels[list(some)], empty),
                             np.append(np.full(len(some), len(full) / max(len(some), 1)), max(len(blank), 1)))
    return index


def held_out(doc_id: Column) -> Column:
    """Whether a row teaches nothing; rows without an id never do."""
    return F.coalesce(id_bucket(doc_id, HOLD_OUT[0]) == HOLD_OUT[1], F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_docs: int = TRAIN_DOCS) -> Index:
    """Index of the labelled texts that are not held out, or of a sample of about
    ``train_docs`` of them by a hash of the text. Equal texts count once, as toxic
    if any of them is. Labels other than 0 and 1, null ids and texts are ignored."""
    y = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    y = y.where(F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("h")).where(F.col("text").isNotNull())
    # Ids and hashes alone choose the examples; a broadcast of these (a bounded sample) finds their texts.
    marks = texts.groupBy("id", "h").agg(F.count("*").alias("times")).join(y, F.col("id") == F.col("_id"))
    one = marks.groupBy("h").agg(F.min(F.struct("id", "times")).alias("r"), F.max("_y").alias("y"))
    labelled = staged(docs.sparkSession, one.select("h", "r.id", "r.times", "y"), "labelled")
    n = labelled.count()
    if not n:
        return build([], [], np.zeros(0))
    share = min(1.0, train_docs / n)
    chosen = labelled.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = texts.join(F.broadcast(chosen), ["id", "h"])
    rows = found.where("times = 1").union(found.where("times > 1").dropDuplicates(["h"])).select("id", "y", "text")
    rows = staged(docs.sparkSession, rows, "examples")
    n_y = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    vocabulary, idf = vocabulary_of(rows, float(n_y.get(1, 0)), float(n_y.get(0, 0)))
    known_terms = frozenset(vocabulary)

    def bags(cols: dict[str, list]) -> dict[str, list]:
        counts = [terms(x, known_terms) for x in cols["text"]]
        return {"id": cols["id"], "y": cols["y"], "t": [list(b) for b in counts],
                "n": [list(b.values()) for b in counts]}

    got = map_rows(rows, bags, "id bigint, y int, t array<string>, n array<int>").collect()
    return build([(r["id"], r["y"], Counter(dict(zip(r["t"], r["n"])))) for r in got], vocabulary, idf)


def vocabulary_of(rows: DataFrame, n_toxic: float, n_other: float) -> tuple[list[str], np.ndarray]:
    """The terms that tell the labels of (y, text) rows apart, and their inverse
    document frequencies."""
    def count(cols: dict[str, list]) -> dict[str, list]:
        seen = (Counter(), Counter())
        for y, text in zip(cols["y"], cols["text"]):
            seen[y].update(terms(text).keys())
        every = list(seen[0] | seen[1])
        return {"t": every, "a": [seen[1][t] for t in every], "b": [seen[0][t] for t in every]}

    a, b = F.col("a"), F.col("b")
    counted = map_rows(rows.select("y", "text"), count, "t string, a bigint, b bigint")
    counted = counted.groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(a + b >= LEAST_TEXTS)
    ratio = log_likelihood(a, b, n_toxic, n_other)
    in_toxic, in_other = (a + 0.5) / (n_toxic + 1), (b + 0.5) / (n_other + 1)
    lift = F.greatest(in_toxic / in_other, in_other / in_toxic)
    best = (counted.withColumn("ratio", ratio).where((F.col("ratio") >= LEAST_RATIO) & (lift >= LEAST_LIFT))
            .orderBy(F.desc("ratio"), "t").limit(MAX_TERMS).collect())
    best.sort(key=lambda r: r["t"])
    n = n_toxic + n_other
    return [r["t"] for r in best], np.array([np.log((1 + n) / (1 + r["a"] + r["b"])) + 1 for r in best])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", train_docs: int = TRAIN_DOCS, toxic: float = TOXIC) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` (0 to 1, higher: more
    likely toxic), ``predicted`` (1 from ``toxic`` on) and ``evidence``, the
    labelled examples that voted as (doc_id, cosine, label), nearest first.

    A null or empty text, and one that shares no term with any example, has the
    toxic share of the examples that hold none, and no evidence. A row with a
    null id is held out. Ties between examples go by their terms, then the id.
    Repeated rows get equal results, an empty table an empty one; without usable
    labels every score is 0.5. Other columns are not read, whatever their names.
    Texts are read whole. The index is of at most about ``train_docs`` examples
    and goes to the tasks as a broadcast.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, train_docs))

    def run(cols: dict[str, list]) -> dict[str, list]:
        got = [index.value.score(t or "") for t in cols["_text"]]
        return {"_id": cols["_id"], "score": [g[0] for g in got],
                "evidence": [[{"doc_id": i, "cosine": c, "label": y} for i, c, y in g[1]] for g in got]}

    id_type = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                   f"_id {id_type}, score double, evidence array<struct<doc_id:bigint,cosine:double,label:int>>")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score",
                      F.when(F.col("score") >= toxic, 1).otherwise(0).alias("predicted"), "evidence")
