"""Removal of passages that repeat, located by phrase automata.

A passage of ``WINDOW`` words that stands twice or more, in one text or in
several, is removed wherever it stands.

1. Anchors. Of the short runs of words inside each window the one with the
   least hash is its anchor (leftmost among equals), so equal windows have equal
   anchors, and a text has about one anchor in fifteen words. Anchors are
   counted over all texts; a window can repeat only if its anchor does.
2. Confirmation. The windows on repeating anchors are counted by a 64-bit hash;
   those found twice or more are the recurring passages.
3. Automata. Each repeating anchor has a home, the least text that holds it (a
   text of very many such anchors is several homes). The words of the recurring
   passages, taken from one text that holds them, go to their anchor's home; the
   passages of a home, in blocks of bounded size, are compiled into one
   Aho-Corasick automaton over word numbers.
4. Location. Every text sends each home its stretches of windows anchored there.
   Sorted behind the passages of their home they stream through its automaton,
   which compares words, not hashes. Homes of very many occurrences are dealt
   over several tasks, each of which compiles the automaton.

Texts are handled once per distinct text; a text that stands twice or more
repeats whole. Anchors and windows meet in aggregates and joins, so a passage
that stands in very many texts is no group in one task. Between steps tables
are written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reportlake.llm.common import by_size, map_rows
from reportlake.llm.components import staged

WINDOW = 35
#: Words of an anchor.
ANCHOR = 8
#: Words of passages compiled into one automaton, and anchors of one home.
AUTOMATON_WORDS, HOME_ANCHORS = 20_000, 500
#: Occurrences of its anchors that one task takes of a home.
TASK_ANCHORS = 4_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = hashlib.sha256(b"").hexdigest()


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII white space."""
    return text.encode().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(lists: list[list[bytes]]) -> list[np.ndarray]:
    import xxhash

    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for ws in lists for w in ws], dtype=np.int64)
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), dtype=np.uint64, count=len(number))
    flat = of_word[codes]
    ends = np.cumsum([len(ws) for ws in lists])
    return [flat[e - len(ws):e] for e, ws in zip(ends.tolist(), lists)]


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * _MIX + h[j:n + j]
    return _mixed(out)


def window_anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all short runs, and for each window the place of its anchor."""
    runs = run_hashes(h, ANCHOR)
    if len(h) < window:
        return runs, np.zeros(0, dtype=np.int64)
    each = np.lib.stride_tricks.sliding_window_view(runs, window - ANCHOR + 1)
    return runs, each.argmin(axis=1) + np.arange(len(each))


def stretches(where: np.ndarray, home: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs (first, last, home) of consecutive windows of one home."""
    if not len(where):
        return []
    cut = np.nonzero((np.diff(where) != 1) | (np.diff(home) != 0))[0] + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(where)]]) - 1
    return [(int(where[a]), int(where[b]), int(home[a])) for a, b in zip(first, last)]


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """One row per row of (doc_id, text, key, check): its words counted, the digest
    of all of them, and its anchors."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        n, digest, anchors = [], [], []
        for part in by_size([len(t) for t in cols["text"]]):
            lists = [words_of(cols["text"][i]) for i in part]
            for ws, h in zip(lists, word_hashes(lists)):
                runs, at = window_anchors(h, window)
                n.append(len(ws))
                digest.append(hashlib.sha256(b" ".join(ws)).hexdigest())
                anchors.append(runs[np.unique(at)].view(np.int64))
        return {"doc_id": cols["doc_id"], "key": cols["key"], "check": cols["check"], "n_words": n,
                "digest": digest, "anchors": anchors}

    return map_rows(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key bigint, check bigint, "
                               "n_words bigint, digest string, anchors array<bigint>")


def _homes_of(cols: dict[str, list], window: int) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray,
                                                                    np.ndarray]]:
    """For each text of a batch: its row, words, word hashes, the windows on
    repeating anchors, and their homes."""
    for part in by_size([len(t) for t in cols["text"]]):
        lists = [words_of(cols["text"][i]) for i in part]
        for i, ws, h in zip(part, lists, word_hashes(lists)):
            runs, at = window_anchors(h, window)
            cols["homes"][i].sort(key=lambda a: a["anchor"])
            anchor = np.array([a["anchor"] for a in cols["homes"][i]], dtype=np.int64)
            home = np.array([a["home"] for a in cols["homes"][i]], dtype=np.int64)
            mine = runs.view(np.int64)[at]
            found = np.minimum(np.searchsorted(anchor, mine), len(anchor) - 1)
            where = np.nonzero(anchor[found] == mine)[0]
            yield i, ws, h, where, home[found[where]]


def _tasks_of(cols: dict[str, list], i: int) -> dict[int, int]:
    """The number of tasks of each home of a text."""
    return {a["home"]: a["tasks"] for a in cols["homes"][i]}


def _windows(held: DataFrame, window: int) -> DataFrame:
    """``key``, ``copies`` and the hashes of the windows on repeating anchors."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: list = [None] * len(cols["key"])
        for i, _, h, where, _ in _homes_of(cols, window):
            out[i] = run_hashes(h, window)[where].view(np.int64)
        return {"key": cols["key"], "copies": cols["copies"], "windows": out}

    return map_rows(held, run, "key bigint, copies bigint, windows array<bigint>")


def _passages(held: DataFrame, window: int) -> DataFrame:
    """``home``, ``tasks``, ``words`` (number) and ``passage`` of the recurring windows
    that a text (with the hashes ``recurring``) brings in, joined where they overlap."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"home": [], "tasks": [], "words": [], "passage": []}
        for i, ws, h, where, home in _homes_of(cols, window):
            ok = np.isin(run_hashes(h, window)[where].view(np.int64), np.array(cols["recurring"][i], dtype=np.int64))
            tasks = _tasks_of(cols, i)
            for a, b, to in stretches(where[ok], home[ok]):
                out["home"].append(to)
                out["tasks"].append(tasks[to])
                out["words"].append(b - a + window)
                out["passage"].append(b" ".join(ws[a:b + window]))
        return out

    return map_rows(held, run, "home bigint, tasks bigint, words bigint, passage binary")


def _candidates(held: DataFrame, window: int) -> DataFrame:
    """``home``, ``task``, ``key``, ``first`` and ``stretch`` for every stretch of windows on a home's anchors."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"home": [], "task": [], "key": [], "first": [], "stretch": []}
        for i, ws, _, where, home in _homes_of(cols, window):
            tasks = _tasks_of(cols, i)
            for a, b, to in stretches(where, home):
                out["home"].append(to)
                out["task"].append(cols["key"][i] % tasks[to])
                out["key"].append(cols["key"][i])
                out["first"].append(a)
                out["stretch"].append(b" ".join(ws[a:b + window]))
        return out

    return map_rows(held, run, "home bigint, task bigint, key bigint, first bigint, stretch binary")


class PhraseAutomaton:
    """Aho-Corasick automaton of all windows of some passages, over word numbers."""

    def __init__(self, passages: list[bytes], window: int):
        import ahocorasick

        self.window = window
        self.number: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in passages:
            text = "".join([self._letter(w) for w in p.split(b" ")])
            for a in range(len(text) - window + 1):
                self.automaton.add_word(text[a:a + window])
        self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        """A character of its own for each word (beyond the surrogates)."""
        return self.number.setdefault(word, chr(len(self.number) + 1 + 2048 * (len(self.number) >= 0xD7FF)))

    def starts(self, stretch: bytes) -> list[int]:
        """Where windows of the passages begin in a stretch of words."""
        text = "".join([self.number.get(w, "\0") for w in stretch.split(b" ")])
        return [end - self.window + 1 for end, _ in self.automaton.iter(text)]


def _located(rows: DataFrame, window: int) -> DataFrame:
    """``key`` and ``starts`` from rows (home, block, task, key, first, words) in which
    the passages of a home and block, without a key, come before its stretches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "key bigint, starts array<bigint>"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, automaton = None, [], None
        for batch in batches:
            keys, starts = [], []
            for home, block, task, key, first, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (home, block, task) != now:
                    now, passages, automaton = (home, block, task), [], None
                if key is None:
                    passages.append(words)
                elif passages:
                    automaton = automaton or PhraseAutomaton(passages, window)
                    if at := automaton.starts(words):
                        keys.append(key)
                        starts.append([first + a for a in at])
            yield pa.RecordBatch.from_arrays([pa.array(keys, fields[0].type), pa.array(starts, fields[1].type)],
                                             schema=fields)

    return rows.mapInArrow(run, schema)


def _cut(held: DataFrame, window: int) -> DataFrame:
    """``key``, ``n_removed``, ``digest`` of what is kept and ``removed`` spans of (key, text, starts)."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": cols["key"], "n_removed": [], "digest": [], "removed": []}
        for text, starts in zip(cols["text"], cols["starts"]):
            ws = words_of(text)
            mark = np.zeros(len(ws) + 1, dtype=np.int64)
            at = np.unique(np.array(starts, dtype=np.int64))
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
            gone = np.cumsum(mark[:-1]) > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            out["n_removed"].append(int(gone.sum()))
            out["digest"].append(hashlib.sha256(b" ".join([w for w, g in zip(ws, gone) if not g])).hexdigest())
            out["removed"].append([{"first": int(a), "last": int(b) - 1}
                                   for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])])
        return out

    return map_rows(held, run, "key bigint, n_removed bigint, digest string, "
                               "removed array<struct<first:bigint,last:bigint>>")


def _keyed(spark: SparkSession, docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with a key each, their scan, and the number of rows of each key.
    Keys are 64-bit hashes of the texts; should two texts share one (their second
    hashes differ), all are hashed anew with another salt."""
    salt = 0
    while True:
        keyed = docs.select("doc_id", "text", F.xxhash64("text", F.lit(salt)).alias("key"),
                            F.xxhash64(F.lit(salt + 1), "text").alias("check"))
        scan = staged(spark, _scan(keyed, window), "anchors")
        copies = staged(spark, scan.groupBy("key").agg(
            F.count("*").alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi")), "copies")
        if copies.where("lo <> hi").isEmpty():
            return keyed, scan, copies.select("key", "copies")
        salt += 2


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_removed``, ``kept_sha256``
    (kept words joined by one blank) and ``removed``, the spans of removed words.

    Removed is each word inside a window of ``window`` consecutive words whose
    sequence also starts anywhere else, in the same text or in another row;
    windows are those of the input. A null or empty text has no words; texts of
    fewer words than a window lose none. A null id is kept. Repeated rows are
    texts that stand twice, so they lose all their words if they hold a window;
    an empty table gives an empty one; other columns are not read, whatever
    their names. Texts are read whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed, scan, copies = _keyed(spark, docs, window)

    anchors = scan.select("key", F.explode("anchors").alias("anchor"))
    repeating = staged(spark, anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("key").alias("least"))
                       .where("n > 1"), "repeating")
    sizes = repeating.groupBy("least").agg(F.count("*").alias("n_anchors"), F.sum("n").alias("n_all"))
    homes = repeating.join(sizes, "least").withColumn("parts", F.ceil(F.col("n_anchors") / HOME_ANCHORS)).select(
        "anchor", F.xxhash64("least", F.pmod(F.xxhash64("anchor"), "parts")).alias("home"),
        F.ceil(F.col("n_all") / F.col("parts") / TASK_ANCHORS).alias("tasks"))
    hits = anchors.join(homes, "anchor").groupBy("key").agg(
        F.collect_set(F.struct("anchor", "home", "tasks")).alias("homes"))
    texts = keyed.select("key", "text").dropDuplicates(["key"])
    held = staged(spark, texts.join(hits, "key").join(copies, "key"), "held")

    counted = _windows(held.select("key", "text", "homes", "copies"), window)
    weight = F.when(F.col("copies") > 1, 2).otherwise(1)
    recurring = (counted.select("key", weight.alias("n"), F.explode("windows").alias("w")).groupBy("w")
                 .agg(F.sum("n").alias("n"), F.min("key").alias("key")).where("n > 1")
                 .groupBy("key").agg(F.collect_list("w").alias("recurring")))
    passages = staged(spark, _passages(held.select("key", "text", "homes").join(recurring, "key"), window), "passages")

    sizes = passages.groupBy("home").agg(F.ceil(F.sum("words") / AUTOMATON_WORDS).alias("blocks"))
    known = passages.join(sizes, "home").select(
        "home", F.pmod(F.xxhash64("passage"), "blocks").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("task"),
        F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("first"),
        F.col("passage").alias("words"))
    once = held.where("copies = 1").select("key", "text", "homes")
    large = sizes.where("blocks > 1")
    streamed = _candidates(once, window).join(large, "home", "left").select(
        "home", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"),
        "task", "key", "first", F.col("stretch").alias("words"))
    rows = (known.union(streamed).repartition("home", "block", "task")
            .sortWithinPartitions("home", "block", "task", F.col("key").asc_nulls_first()))
    starts = _located(rows, window).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = staged(spark, _cut(once.select("key", "text").join(starts, "key"), window), "cut")

    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    all_words = F.when(F.col("n_words") > 0, F.array(F.struct(
        F.lit(0).cast("bigint").alias("first"), (F.col("n_words") - 1).alias("last"))))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    out = scan.select("doc_id", "key", "n_words", F.col("digest").alias("all_words")).join(copies, "key").join(
        cut, "key", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("digest", "all_words")).alias("kept_sha256"),
        F.when(whole, all_words).otherwise(F.coalesce("removed", none)).alias("removed"))
