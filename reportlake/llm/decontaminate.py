"""Benchmark decontamination with a BM25 index and block-max WAND.

The inverted index holds the test items; every training passage (overlapping
stretches of words, twice as long as the longest item of its index) is a query,
and all items that score a given share of what they score against themselves are
retrieved. With impacts divided by the item's own score that share is one fixed
threshold:

* an item can reach it only over one of its pivot terms; its other terms together
  stay below it. Posting lists of pivot terms give candidates;
* rows of the index lie in blocks, and each term has a list of the blocks that
  hold it with its greatest impact in each; a candidate whose block's greatest
  impacts over the passage's terms sum below the threshold is skipped;
* what is left is scored exactly.

This is WAND with a threshold that never moves, for which no cursor has to: the
passages of a batch take each step together, as arrays.

All bounds are never too low, so nothing above the threshold is lost. An item's
question is in the index beside the whole item, so it is retrieved where it stands
alone. Retrieved pairs are verified by the shares of the question's and of the
answer's five-word shingles that stand in the passage (the answer is the item's
last sentence); an item is found where

* half of its question's shingles stand, if these are ``least`` or more;
* or half of the question's and half of the answer's;
* or ``OVERLAP`` of both together;
* but an item of fewer than ``least`` shingles only where it stands whole, and
  one of fewer than ``shortest`` words nowhere: such words stand in any text. Both
  are parameters; 0 means that every item is told by shares, or found at all.

Items are taken in indexes of bounded size, each of items of like length, so one
very long item makes no other's passages long. An index holds one entry for each
distinct term of an item. As many as fit a bound are broadcast together for one
pass over the documents, the next are read when that pass is written; documents
are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reportlake.llm.common import by_size, map_rows
from reportlake.llm.components import staged

K1, B = 1.2, 0.75
#: Share of its own score that an item has to reach.
THRESHOLD = 0.4
#: Shares of an item's shingles, of its question's and of its answer's that have to stand in the passage.
OVERLAP, QUESTION, ANSWER = 0.8, 0.5, 0.5
#: Shingles that a question by itself, or an item, has at least to be told by shares.
LEAST = 5
SHINGLE = 5
#: Bytes of item text in one index, about, and of the indexes that are sent to the tasks for one pass.
INDEX_BYTES, PASS_BYTES = 2 << 20, 64 << 20
#: Items of up to this many bytes share indexes; longer ones are parted by doubling lengths.
SHORT_BYTES = 1 << 10
#: Rows of the index under one block maximum.
POSTING_BLOCK = 8
#: Cells of the tables of one batch of passages, and pairs scored at once.
TABLE_CELLS, PAIRS = 1 << 22, 1 << 14

#: Bytes that part words become blanks, A-Z lower case; other bytes stay.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() and c < 128 or c >= 128 else 32
              for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the last sentence, or the last
    third of the words where there is only one sentence."""
    sentences = [s for s in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if words_of(s)]
    if len(sentences) > 1:
        return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])
    words = words_of(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def shingles(words: list[bytes], k: int = SHINGLE) -> set[tuple]:
    """Distinct runs of ``k`` words; a shorter text is one run."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


Runs = tuple[int, np.ndarray]


def coded(words: list[bytes], k: int = SHINGLE) -> Runs:
    """Length of the shingles of ``words`` and their 64-bit hashes, sorted."""
    import xxhash

    k = max(1, min(k, len(words)))
    return k, np.unique(np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(run)) for run in shingles(words, k)),
                                    dtype=np.uint64))


def _held(runs: Runs, passage: dict[int, np.ndarray], words: list[bytes]) -> int:
    """How many of the runs stand in the passage of ``words``."""
    k, codes = runs
    if not len(codes):
        return 0
    if k not in passage:
        passage[k] = coded(words, k)[1]
    return int(np.isin(codes, passage[k]).sum())


@dataclass
class Index:
    """Impacts of some items, all divided by the items' own scores. With questions,
    these follow the items as rows of their own. Lists of term t lie at
    ``start[t]:start[t + 1]``."""

    items: list[int]
    parent: list[int]          # row of the item that a row stands for
    question: list[Runs]
    answer: list[Runs]
    whole: list[Runs | None]   # the short items as one run, none for others
    words: list[int]           # of each item
    term: dict[bytes, int]
    row_start: np.ndarray      # terms of each row, rising, with their impacts
    row_terms: np.ndarray
    row_impacts: np.ndarray
    pivot_start: np.ndarray    # rows of each pivot term
    pivot_rows: np.ndarray
    block_start: np.ndarray    # blocks of each term, with its greatest impact there
    blocks: np.ndarray
    block_most: np.ndarray
    threshold: float
    length: int                # words of a passage
    least: int
    shortest: int

    def nbytes(self) -> int:
        """About what the index takes when it is sent."""
        runs = sum(x[1].nbytes + 200 for parts in (self.question, self.answer) for x in parts)
        return runs + sum(map(len, self.term)) + 60 * len(self.term) + sum(
            a.nbytes for a in (self.row_start, self.row_terms, self.row_impacts, self.pivot_start, self.pivot_rows,
                               self.block_start, self.blocks, self.block_most))


def build_index(items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_words: float,
                threshold: float = THRESHOLD, with_questions: bool = False, least: int = LEAST,
                shortest: int = SHINGLE) -> Index:
    """Index of (item id, text) rows; ``df``, ``n_items`` and ``mean_words`` are of all items."""
    term: dict[bytes, int] = {}
    questions, answers, whole, longest = [], [], [], 1
    rows, alone = [], []
    for i, (_, text) in enumerate(items):
        words = words_of(text)
        longest = max(longest, len(words))
        q, a = question_answer(text)
        questions.append(coded(q))
        answers.append(coded(a))
        n_runs = len(questions[i][1]) + len(answers[i][1])
        whole.append(coded(words, len(words)) if n_runs < least else None)
        rows.append(words)
        if with_questions and len(questions[i][1]) >= least and a:
            alone.append((i, q))
    parent = [*range(len(items)), *(i for i, _ in alone)]
    postings: list[tuple[int, int, float]] = []
    pivots: list[tuple[int, int]] = []
    for i, words in enumerate([*rows, *(q for _, q in alone)]):
        row = {}
        for t, f in Counter(words).items():
            idf = math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5))
            row[term.setdefault(t, len(term))] = idf * f * (K1 + 1) / (
                f + K1 * (1 - B + B * len(words) / mean_words))
        own, below = sum(row.values()), 0.0
        for t, x in sorted(row.items(), key=lambda z: (z[1], z[0])):
            postings.append((i, t, x / own))
            below += x / own
            if below >= threshold - 1e-9:
                pivots.append((t, i))
    postings.sort()
    pivots.sort()
    r, t, x = (np.array(c, dtype=d) for c, d in zip(zip(*postings) if postings else ((), (), ()),
                                                    (np.int64, np.int64, np.float64)))
    n_blocks = len(parent) // POSTING_BLOCK + 1
    by_block = np.argsort(t * n_blocks + r // POSTING_BLOCK, kind="stable")
    key = (t * n_blocks + r // POSTING_BLOCK)[by_block]
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    of = np.arange(len(term) + 1)
    return Index([items[i][0] for i in parent], parent, questions, answers, whole, [len(w) for w in rows], term,
                 np.searchsorted(r, np.arange(len(parent) + 1)), t, x,
                 np.searchsorted(np.array([p for p, _ in pivots]), of), np.array([i for _, i in pivots], dtype=np.int64),
                 np.searchsorted(key[first] // n_blocks, of), key[first] % n_blocks,
                 np.maximum.reduceat(x[by_block], first) if len(x) else x, threshold, 2 * longest, least, shortest)


def _spans(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists ``of`` (by their starts), and how long each is."""
    n = start[of + 1] - start[of]
    return np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


def retrieve(index: Index, passage: np.ndarray, code: np.ndarray, n: int) -> list[tuple[int, int, float]]:
    """(passage, row, score) at or above the threshold, for ``n`` passages given
    as (passage, term) rows in passage order; terms beyond the index are unknown."""
    known = code < len(index.term)
    width, n_rows = len(index.term) + 1, len(index.items)
    held = np.unique(passage[known] * width + code[known])  # distinct terms of each passage
    if not len(held):
        return []
    passage, code = held // width, held % width
    at, count = _spans(index.pivot_start, code)
    reached = np.unique(np.repeat(passage, count) * n_rows + index.pivot_rows[at])
    if not len(reached):
        return []
    n_blocks = n_rows // POSTING_BLOCK + 1
    at, count = _spans(index.block_start, code)
    bound = np.bincount(np.repeat(passage, count) * n_blocks + index.blocks[at], index.block_most[at], n * n_blocks)
    pair_p, pair_r = reached // n_rows, reached % n_rows
    ok = bound[pair_p * n_blocks + pair_r // POSTING_BLOCK] >= index.threshold - 1e-9
    pair_p, pair_r = pair_p[ok], pair_r[ok]
    out = []
    for k in range(0, len(pair_p), PAIRS):
        p, r = pair_p[k:k + PAIRS], pair_r[k:k + PAIRS]
        at, count = _spans(index.row_start, r)
        want = np.repeat(p, count) * width + index.row_terms[at]
        place = np.minimum(np.searchsorted(held, want), len(held) - 1)
        score = np.bincount(np.repeat(np.arange(len(p)), count), index.row_impacts[at] * (held[place] == want), len(p))
        ok = score >= index.threshold - 1e-9
        out += zip(p[ok].tolist(), r[ok].tolist(), score[ok].tolist())
    return out


def leaks(index: Index, texts: list[str]) -> list[dict[int, tuple[float, float, float, float]]]:
    """For each text, the verified items: index position -> (score, question share, answer share, share)."""
    def verified(i: int, q: int, a: int, words: list[bytes], runs: dict[int, np.ndarray]) -> bool:
        n_q, n_a, short = len(index.question[i][1]), len(index.answer[i][1]), index.whole[i]
        if short is not None:
            return index.words[i] >= index.shortest and _held(short, runs, words) == 1
        asked = q >= QUESTION * n_q
        return asked and (n_q >= index.least or a >= ANSWER * n_a) or q + a >= OVERLAP * (n_q + n_a)

    out: list[dict] = [{} for _ in texts]
    step = index.length // 2
    get, unused = index.term.get, len(index.term)
    lists = [words_of(t) for t in texts]
    codes = [np.fromiter((get(w, unused) for w in ws), dtype=np.int64, count=len(ws)) for ws in lists]
    jobs = [(d, k) for d, ws in enumerate(lists) if ws for k in range(0, max(1, len(ws) - step), step)]
    most = max(1, TABLE_CELLS // (16 * index.length + len(index.items)))
    for j in range(0, len(jobs), most):
        part = jobs[j:j + most]
        stretches = [codes[d][k:k + index.length] for d, k in part]
        number = np.repeat(np.arange(len(part)), [len(s) for s in stretches])
        seen: dict[int, dict[int, np.ndarray]] = {}
        for p, i, score in retrieve(index, number, np.concatenate(stretches), len(part)):
            d, k = part[p]
            words = lists[d][k:k + index.length]
            runs = seen.setdefault(p, {})
            i = index.parent[i]
            q, a = _held(index.question[i], runs, words), _held(index.answer[i], runs, words)
            n_q, n_a = len(index.question[i][1]), len(index.answer[i][1])
            share = (q + a) / (n_q + n_a)
            if (share, score) > out[d].get(i, (0, 0, 0, 0))[3::-3] and verified(i, q, a, words, runs):
                out[d][i] = (score, q / n_q if n_q else 1.0, a / n_a if n_a else 1.0, share)
    return out


def indexes(items: DataFrame, threshold: float, least: int, shortest: int) -> Iterator[list[Index]]:
    """The items' indexes, as many at a time as fit one pass over the documents. Items
    are read one index at a time; what is held is bounded by ``PASS_BYTES``."""
    spark = items.sparkSession
    size = F.octet_length("text")
    level = F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1)) / SHORT_BYTES)), F.lit(0)).cast("int")
    items = staged(spark, items.distinct().withColumn("level", level), "items")
    levels = items.groupBy("level").agg(F.sum(size).alias("bytes")).orderBy("level").collect()  # one a doubling
    pieces = {r["level"]: max(1, math.ceil(r["bytes"] / INDEX_BYTES)) for r in levels}

    def terms(cols: dict[str, list]) -> dict[str, list]:
        lists = [words_of(t) for t in cols["text"]]
        rows = [(i, k, w) for i, k, ws in zip(cols["level"], cols["piece"], lists) for w in sorted(set(ws))]
        return {"level": [r[0] for r in rows], "piece": [r[1] for r in rows], "word": [r[2] for r in rows]}

    def lengths(cols: dict[str, list]) -> dict[str, list]:
        return {"n": [len(words_of(t)) for t in cols["text"]]}

    if not levels:
        return
    mean = map_rows(items.select("text"), lengths, "n bigint").where("n > 0").agg(F.count("*"), F.avg("n")).first()
    piece = F.pmod(F.xxhash64("item_id", "text"), F.element_at(F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv]),
                                                               F.col("level"))).cast("int")
    items = items.withColumn("piece", piece)
    seen = staged(spark, map_rows(items.select("level", "piece", "text"), terms, "level int, piece int, word binary"),
                  "item-terms")
    df = seen.groupBy("word").agg(F.count("*").alias("df"))
    df = staged(spark, seen.distinct().join(df, "word"), "items-df")
    group: list[Index] = []
    held = 0
    for lev, n in pieces.items():
        for k in range(n):
            here = (F.col("level") == lev) & (F.col("piece") == k)
            rows = sorted((r[0], r[1]) for r in items.where(here).select("item_id", "text").collect() if words_of(r[1]))
            if not rows:
                continue
            words = {bytes(r[0]): r[1] for r in df.where(here).select("word", "df").collect()}
            index = build_index(rows, words, mean[0], mean[1] or 1.0, threshold, True, least, shortest)
            if group and held + index.nbytes() > PASS_BYTES:
                yield group
                group, held = [], 0
            group.append(index)
            held += index.nbytes()
    if group:
        yield group


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where(
        "item_id is not null and text is not null")


_FOUND = ("item_id bigint, score double, question_overlap double, answer_overlap double, overlap double")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                  least: int = LEAST, shortest: int = SHINGLE) -> DataFrame:
    """One row per document row and test item found in it: the id, ``item_id``,
    ``score`` (share of the own BM25 score of the item, or of its question where
    that is more), ``question_overlap``, ``answer_overlap`` and ``overlap``
    (shares of shingles, by the rule of this module), each of the passage with
    the greatest overlap.

    Null or empty texts and texts without words hold no item, and such items are
    found nowhere; items with a null id are ignored. A null document id is kept.
    Repeated documents give repeated rows; items of equal text are all reported;
    an item id given twice is found where any of its texts is. Empty tables give
    an empty one; other columns are not read, whatever their names. Texts of any
    length are cut into passages that overlap by half, so a copy of an item lies
    within one.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    out = None
    for group in indexes(_items(benchmark, item_col, item_text_col), threshold, least, shortest):
        shipped = spark.sparkContext.broadcast(group)

        def run(cols: dict[str, list], shipped=shipped) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("_id", "item_id", "score", "question_overlap", "answer_overlap",
                                                    "overlap")}
            for part in by_size([len(t) for t in cols["_text"]]):
                best: list[dict[int, tuple]] = [{} for _ in part]
                for index in shipped.value:
                    for mine, found in zip(best, leaks(index, [cols["_text"][d] for d in part])):
                        for i, x in found.items():
                            item = index.items[i]
                            if item not in mine or x[3] > mine[item][3]:
                                mine[item] = x
                for d, mine in zip(part, best):
                    for item, x in sorted(mine.items()):
                        for name, v in zip(out, (cols["_id"][d], item, *x)):
                            out[name].append(v)
            return out

        here = map_rows(texts, run, f"_id {id_type}, {_FOUND}")
        if out is not None:  # more than one pass: each is written before the next items are read
            out = out.unionByName(staged(spark, here, "found"))
        else:
            out = here
    if out is None:
        out = spark.createDataFrame([], f"_id {id_type}, {_FOUND}")
    return out.withColumnRenamed("_id", id_col)


def _clean(shipped):
    """Column function: whether a text holds no item of the indexes."""
    from pyspark.sql.types import BooleanType

    @F.pandas_udf(BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in texts]
        out: list[bool] = []
        for part in by_size([len(t) for t in texts]):
            some = [texts[i] for i in part]
            ok = [True] * len(some)
            for index in shipped.value:
                ok = [a and not found for a, found in zip(ok, leaks(index, some))]
            out += ok
        return pd.Series(out, dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST,
                      shortest: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, unchanged; rows with a
    null or empty text stay, and all rows where there are no items. The decision is
    made row by row, whatever the ids and other columns; repeated rows stay or go together."""
    spark, passes = docs.sparkSession, 0
    for group in indexes(_items(benchmark, item_col, item_text_col), threshold, least, shortest):
        if passes:  # written before the next items are read
            docs = staged(spark, docs, "kept")
        docs = docs.where(_clean(spark.sparkContext.broadcast(group))(F.col(text_col)))
        passes += 1
    return docs
