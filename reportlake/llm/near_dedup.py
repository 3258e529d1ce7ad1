"""MinHash near-duplicates with odd sketches.

1. One pass over the texts makes, per document, the size of its shingle set, a
   128-bit key of the set, band hashes of its MinHash samples and an odd
   sketch: each sample flips one bit of a bitmap, so the XOR of two bitmaps
   holds the samples that differ, and its population count estimates a high
   similarity closely.
2. Equal sets collapse to their smallest document.
3. Each band bucket has a pivot, its member that meets the most others over all
   its buckets: the most central text of a family, so the buckets of a family
   mostly share one. Every member is paired with the pivot only; pairs whose
   sketches tell of a clearly smaller similarity are dropped, the others are
   confirmed on the full sets, and confirmed links become components.
4. In buckets that still hold several components, each member is described by how
   its set differs from the pivot's, the differences that fewest members share
   first. Two members can be linked only if they share many differences, so the
   first one that they share must stand early in both lists; a join on it gives
   every pair that can be linked and few others. These are confirmed as before:
   every candidate pair is confirmed, refused, or already connected.

Buckets are joined, never gathered; no step emits the pairs within a group.
Odds of missing a link at the threshold: (1 - 0.8^5)^44, about 3 in 10^8, for
no shared band, and less than one in 10^8 for the sketch bound.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportlake.llm.common import ARROW_ROWS, by_size
from reportlake.llm.components import components, staged

BANDS, ROWS = 44, 5
SKETCH_SAMPLES, SKETCH_BITS = 200, 1024
#: Members of one pivot that are compared with it in one task, about.
PIECE = 1000
#: Pairs whose estimated similarity is below this are dropped unconfirmed.
SKETCH_LEAST = 0.55

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_bound(samples: int = SKETCH_SAMPLES, bits: int = SKETCH_BITS, least: float = SKETCH_LEAST) -> int:
    """Population count of the XOR that is expected at similarity ``least``."""
    flips = 2 * samples * (1 - least)
    return int(bits / 2 * (1 - (1 - 2 / bits) ** flips))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer
    than ``words`` words has one shingle, its whole sequence; one without words
    has none.
    """
    import xxhash

    lists = [t.encode().lower().split() for t in texts]
    number: dict[bytes, int] = {}
    codes = [number.setdefault(w, len(number)) for ws in lists for w in ws]
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), dtype=np.uint64, count=len(number))
    flat = of_word[np.array(codes, dtype=np.int64)] if codes else np.zeros(0, dtype=np.uint64)
    n = len(flat)
    rolled = np.zeros(max(n - words + 1, 0), dtype=np.uint64)
    for j in range(words):
        rolled = rolled * _MIX + flat[j:n - words + 1 + j] if len(rolled) else rolled
    rolled = _mixed(rolled)
    out, at = [], 0
    for ws in lists:
        m = len(ws)
        if m >= words:
            out.append(np.unique(rolled[at:at + m - words + 1]))
        elif m:
            whole = np.full(1, m, dtype=np.uint64)
            for j in range(m):
                whole = whole * _MIX + flat[at + j]
            out.append(_mixed(~whole))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += m
    return out


def minhash(sets: list[np.ndarray], samples: int, seed: int = 1) -> np.ndarray:
    """One row of 32-bit minima per (non-empty) set, under random odd multipliers."""
    rng = np.random.default_rng(seed)
    mult = (rng.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    out = np.empty((len(sets), samples), dtype=np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = None
        for k in range(0, len(x), 1024):
            m = np.multiply(mult, x[None, k:k + 1024]).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        out[i] = low
    return out


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = minima[:, :bands * rows].reshape(len(minima), bands, rows).astype(np.uint64)
    h = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64)), part.shape[:2])
    for r in range(rows):
        h = _mixed(h * _MIX + part[:, :, r])
    return h.view(np.int64)


def odd_sketches(minima: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Parity bitmaps of the first samples, as 64-bit words."""
    m = minima[:, :samples].astype(np.uint64)
    at = _mixed(m + (np.arange(1, samples + 1, dtype=np.uint64) << np.uint64(32))[None, :]) % np.uint64(bits)
    flat = at.astype(np.int64) + (np.arange(len(m), dtype=np.int64) * bits)[:, None]
    odd = (np.bincount(flat.ravel(), minlength=len(m) * bits) & 1).astype(np.uint8).reshape(len(m), bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _lists(rows: np.ndarray, present: list[bool], width: int) -> pa.ListArray:
    """A list column: one row of ``rows`` for each present entry, else an empty list."""
    ends = np.concatenate([[0], np.cumsum(np.array(present, dtype=np.int64) * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key``, ``bands``, ``sketch`` of each row of (doc_id, text)."""
    import xxhash

    samples = max(BANDS * ROWS, SKETCH_SAMPLES)
    schema = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch array<bigint>"

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for part in by_size([len(t) for t in texts]):
                sets = shingle_sets([texts[i] for i in part], words)
                full = [s for s in sets if len(s)]
                minima = minhash(full, samples)
                present = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in part], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    _lists(band_hashes(minima, BANDS, ROWS), present, BANDS),
                    _lists(odd_sketches(minima, SKETCH_SAMPLES, SKETCH_BITS), present, SKETCH_BITS // 64),
                ], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id`` and ``shingles`` of each row of (doc_id, text)."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ARROW_ROWS):
                rows = batch.slice(start, ARROW_ROWS)
                ids, texts = rows.column(0).to_pylist(), [t or "" for t in rows.column(1).to_pylist()]
                for part in by_size([len(t) for t in texts]):
                    sets = shingle_sets([texts[i] for i in part], words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in part], pa.int64()),
                         pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                        names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _xor_count(a: str, b: str) -> Column:
    out = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and sketches allow the threshold."""
    left = nodes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .where(_xor_count("sa", "sb") <= sketch_bound())
            .select("a", "b").distinct())


def _confirmed(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the pairs: 100 * intersection >= percent * union of the full sets."""
    both = F.size(F.array_intersect("x", "y"))
    return (staged(spark, pairs, "pairs")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("total"))
            .where(100 * F.col("both") >= percent * (F.col("total") - F.col("both")))
            .select(F.col("a").alias("u"), F.col("b").alias("v")))


def _pivots(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(bucket, rep, ``a``): the members of buckets of two and more, with the pivot of each."""
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    multi = staged(spark, rows.join(shared, "bucket"), "buckets")
    central = multi.groupBy("rep").agg(F.sum("n").alias("meets"))
    order = F.struct(F.col("meets"), (-F.col("rep")).alias("low"))
    pivots = multi.join(central, "rep").groupBy("bucket").agg(F.max_by("rep", order).alias("a"))
    return staged(spark, multi.select("bucket", "rep").join(pivots, "bucket"), "pivots")


def _differences(spark: SparkSession, placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(row, p, m, comp, z_p, z_m, differ) of every pivot p and other member m of its
    buckets: the set sizes, and the elements that one of the sets has and the other
    lacks, those that fewest members of p share first. The members of one pivot are
    spread over pieces of about ``PIECE``."""
    members = placed.where("rep <> a").select(F.col("a").alias("p"), F.col("rep").alias("m"), "comp").distinct()
    pieces = members.groupBy("p").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    pivots = (pieces.join(sets, F.col("p") == F.col("doc_id"))
              .select("p", "pieces", F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
                      .alias("piece")))
    members = members.join(pieces, "p").withColumn("piece", F.pmod(F.xxhash64("m"), "pieces")).drop("pieces")
    pairs = members.join(pivots.drop("pieces"), ["p", "piece"]).join(
        sets.select(F.col("doc_id").alias("m"), F.col("shingles").alias("y")), "m")
    both = F.concat(F.array_except("y", "x"), F.array_except("x", "y"))
    # An id may stand for several sets: lists belong to a pivot's set, and are rows of their own.
    rows = staged(spark, pairs.select(
        F.monotonically_increasing_id().alias("row"), F.xxhash64("p", "x").alias("p"), "m", "comp",
        F.size("x").alias("z_p"), F.size("y").alias("z_m"), both.alias("differ")), "differences")
    each = rows.select("row", "p", F.explode("differ").alias("e"))
    common = each.groupBy("p", "e").agg(F.count("*").alias("df"))
    listed = each.join(common, ["p", "e"]).groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("df", "e"))), lambda x: x["e"]).alias("differ"))
    return staged(spark, rows.drop("differ").join(listed, "row"), "ordered")


def _remaining(spark: SparkSession, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that can be linked among the members of divided buckets, apart
    from those with the pivot. ``placed`` has (bucket, rep, a, comp).

    d(m) is the difference of m and the pivot p, Q = 100 + percent, R = 100 -
    percent. m and o are linked if |m diff o| <= (|m| + |o|) R / Q, that is, if they
    share t = (E(m) + E(o)) / 2 Q differences or more, E = Q |d| - R |set|. Among
    the members, ``near`` ones are linked with p (E <= R |p|), the others are ``far``;
    two near ones are in one component already. The first shared difference, at
    places a and b of the two lists, leaves room for 1 + min(|d(m)| - a, |d(o)| - b)
    shared ones. As E(o) > R |p| for a far o, and t >= |d(o)| - |m diff o| with |m| <=
    100 |o| / percent, lists are cut where no such pair can begin.
    """
    q, r = 100 + percent, 100 - percent
    own = _differences(spark, placed, sets)
    n, e = F.size("differ"), q * F.size("differ") - r * F.col("z_m")
    own = own.select("p", "m", "comp", "z_m", "differ", n.alias("n"), e.alias("e"), (r * F.col("z_p")).alias("limit"))
    alone = F.greatest(F.lit(1), n - F.floor(r * F.col("z_m") / percent))
    with_far = F.greatest(alone, F.floor((F.col("e") + F.col("limit")) / (2 * q)) + 1)

    def begun(rows: DataFrame, least: Column, side: str) -> DataFrame:
        """A row for each difference at which a pair can begin, if it shares at least ``least``."""
        early = F.slice("differ", F.lit(1), F.greatest(n - least + 1, F.lit(0)).cast("int"))
        rows = rows.select("p", F.posexplode(early).alias("at", "d"), *[
            F.col(c).alias(c + side) for c in ("m", "comp", "z_m", "n", "e")])
        return rows.withColumn("room" + side, F.col("n" + side) - F.col("at")).drop("at", "n" + side)

    far, near = F.col("e") > F.col("limit"), F.col("e") <= F.col("limit")
    shared = F.greatest(F.lit(1), F.ceil((F.col("e1") + F.col("e2")) / (2 * q)))
    fit = ((F.col("comp1") != F.col("comp2")) & (shared <= F.least("room1", "room2"))
           & (100 * F.least("z_m1", "z_m2") >= percent * F.greatest("z_m1", "z_m2")))
    late = begun(own.where(far), with_far, "2")
    far_far = begun(own.where(far), with_far, "1").join(late, ["p", "d"]).where(fit & (F.col("m1") < F.col("m2")))
    near_far = begun(own.where(near), with_far, "1").join(begun(own.where(far), alone, "2"), ["p", "d"]).where(fit)
    return (far_far.select("m1", "m2").union(near_far.select("m1", "m2"))
            .select(F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b")).distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of
    ``percent`` per cent or more; one row per input row.

    Columns: the id (integer), ``n_shingles``, ``component_id`` (smallest id
    reachable over links, itself included), ``kept`` (the id is that one).

    A null or empty text, or one without words, has an empty set and is linked
    with nothing. Rows with a null id are linked with nothing, have a null
    component and stay kept. Rows that share an id are one node: a link of any
    of them links all. Repeated rows give repeated results, an empty table an
    empty one; other columns are not read, whatever their names. Sets are whole
    texts of any length.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sig = staged(spark, signatures(texts, words), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    reps = staged(spark, full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")

    members = sig.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    nodes = full.join(reps, (full.set_key == reps.set_key) & (full.doc_id == reps.rep)).select(
        "rep", "n_shingles", "sketch", "bands")

    rows = nodes.select(F.explode("bands").alias("bucket"), "rep")
    multi = _pivots(spark, rows)

    ids = multi.select(F.col("rep").alias("doc_id")).distinct()
    whole = texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = staged(spark, _sets(whole, words), "sets")
    star = multi.where("rep <> a").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    links = _confirmed(spark, _likely(star, nodes, percent), sets, percent)
    # Rows of one id with several sets: their sets' first documents belong together.
    shared = members.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v")
    several = members.join(shared.select("doc_id", "u"), "doc_id").select("u", F.col("rep").alias("v"))
    owners = members.join(shared.select("doc_id"), "doc_id").select(F.col("doc_id").alias("u"),
                                                                    F.col("rep").alias("v"))
    links = staged(spark, links.union(several).union(owners).where("u <> v").distinct(), "links")
    first = components(spark, links)

    comp = first.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
    placed = multi.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                         F.count("*").alias("n")).where("lo < hi and n > 2").select("bucket")
    placed = staged(spark, placed.join(open_, "bucket"), "placed")
    rest = _remaining(spark, placed, sets, percent)
    more = _confirmed(spark, _likely(rest, nodes, percent), sets, percent)
    final = components(spark, links.select("u", "v").union(more)).select(
        F.col("u").alias("rep"), F.col("v").alias("comp"))

    out = members.join(final, "rep", "left").withColumn("component_id", F.coalesce("comp", "rep"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that are no column of ``docs``, one for each of ``names``."""
    taken = {c.lower() for c in docs.columns}
    return [next(x for x in (f"{name}{'_' * i}" for i in itertools.count()) if x not in taken) for name in names]


def _one_of(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``docs`` for each value of ``keys`` (nulls are values): the least by its
    columns' JSON text, which orders columns of any type."""
    row, order = _fresh(docs, "row", "order")
    whole = docs.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    least = whole.withColumn(order, F.to_json(row)).groupBy(*[f"`{k}`" for k in keys]).agg(
        F.min_by(row, order).alias(row))
    return least.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def _text_keys(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text, key): distinct texts of repeated ids, each with a key of its own that
    is not among ``ids``, salted anew where one is."""
    spark = texts.sparkSession
    texts = staged(spark, texts.distinct(), "id-texts")
    for salt in itertools.count():
        keys = texts.withColumn("key", F.xxhash64(F.lit(salt), F.lit("id-text"), "id", F.col("text").isNull(), "text"))
        twice = keys.groupBy("key").count().where("count > 1")
        if twice.isEmpty() and keys.join(ids, F.col("key") == F.col("id_"), "left_semi").isEmpty():
            return keys


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with
    the smallest id stays, unchanged.

    Rows that share an id and a text are one document, of which one row stays
    (the least by its columns' JSON text). Rows that share an id but not the text
    are documents of their own, of which those that are linked leave one (the
    least by text). Rows with a null id all stay, as do empty and null texts of
    different ids, which are linked with nothing. An empty table gives an empty one.
    Other columns may have any type and any name.
    """
    spark = docs.sparkSession
    known, nameless = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    plain = known.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    repeated = staged(spark, plain.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    again, = _fresh(docs, "id")
    repeated = repeated.withColumnRenamed("id", again)
    of_repeated = known[id_col].cast("bigint") == repeated[again]
    if repeated.isEmpty():
        gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select(
            F.col(id_col).cast("bigint").alias(again))
        return known.join(gone, known[id_col].cast("bigint") == gone[again], "left_anti").union(nameless)

    # Every text of a repeated id is a document under a key of its own.
    single = plain.join(repeated, plain["id"] == repeated[again], "left_anti")
    keys = _text_keys(plain.join(repeated, plain["id"] == repeated[again], "left_semi"),
                      plain.select(F.col("id").alias("id_")))
    nodes = staged(spark, single.select("id", "text", F.col("id").alias("key")).union(keys.select("id", "text", "key")),
                   "nodes")
    found = near_duplicates(nodes.select("key", "text"), words, percent, "key", "text").select("key", "component_id")
    first = F.min(F.struct("id", "text", "key"))  # the smallest id, which the smallest key need not be
    stay = staged(spark, nodes.join(found, "key").groupBy("component_id").agg(first.alias("o")).select("o.*"), "stay")

    id_, text_ = _fresh(docs, "id", "text")
    stay = stay.select(F.col("id").alias(id_), F.col("text").alias(text_))
    alone = known.join(repeated, of_repeated, "left_anti").join(
        stay.select(id_), F.col(f"`{id_col}`").cast("bigint") == F.col(id_), "left_semi")
    parted = _one_of(known.join(repeated, of_repeated, "left_semi"), [id_col, text_col])
    parted = parted.join(stay, (F.col(f"`{id_col}`").cast("bigint") == F.col(id_))
                         & F.col(f"`{text_col}`").eqNullSafe(F.col(text_)), "left_semi")
    return alone.union(parted).union(nameless)
