"""Token counts without ids.

Each text becomes the frequencies of its pre-tokens, here the stretches
between blanks and line ends: the tokenizers served (lower-cased words with
word ends, white space dropped) never let a token cross white space, so a
stretch has the same pieces wherever it stands.

1. The distinct pre-tokens of the corpus, with their frequencies, are an
   aggregate (each task sums its own first); the pieces of each are counted once.
2. The counts of the most frequent ones, a table of bounded size, are
   broadcast; a document's frequencies meet them where they are made.
3. The document's other frequencies are joined to the distinct table, and all
   are summed per document. No id list is made for a document.

A frequent pre-token is thus never a hot key of the join, and most frequencies
(about six of seven here) are not shuffled.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm.common import by_size, map_rows
from reportlake.llm.components import staged

#: Pre-tokens whose counts are broadcast: at most so many, each of at most so many characters.
FREQUENT, LONGEST_FREQUENT = 200_000, 64
#: Distinct pre-tokens that a task holds before it hands their frequencies on.
HELD = 500_000


def split(text: str | None) -> list[str]:
    return (text or "").replace("\n", " ").split(" ")


def pre_token_frequencies(texts: DataFrame) -> DataFrame:
    """(``token``, ``n``): how often each distinct pre-token stands in the (text) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            held.pop("", None)
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["token", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(split(text))
                if len(held) > HELD:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def piece_counts(tokens: DataFrame, source: bytes) -> DataFrame:
    """(token, n, ``pieces``) of (token, n) rows: the tokenizer's pieces of each."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        tok = _tokenizer(source)
        pieces = [len(e.ids) for e in tok.encode_batch(cols["token"], add_special_tokens=False)]
        return {"token": cols["token"], "n": cols["n"], "pieces": pieces}

    return map_rows(tokens, run, "token string, n bigint, pieces bigint")


def _level() -> Column:
    """Frequencies in eighths of their doublings."""
    return F.floor(F.log2("n") * 8)


def frequent_level(tokens: DataFrame) -> int:
    """The least level from which on there are at most ``FREQUENT`` tokens; only counts
    by level, a few hundred, reach the driver."""
    sizes = sorted(((r["level"], r["count"]) for r in tokens.groupBy(_level().alias("level")).count().collect()),
                   reverse=True)
    total, least = 0, 1 << 20
    for level, n in sizes:
        total += n
        if total > FREQUENT:
            break
        least = level
    return least


_TOKENIZERS: dict[int, object] = {}


def _tokenizer(source: bytes):
    key = hash(source)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_buffer(source)
        tok.no_truncation()
        tok.no_padding()
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = tok
    return _TOKENIZERS[key]


def check_served(source: bytes) -> None:
    """White space has to be dropped by the splitter and no added token may hold any."""
    import json
    doc = json.loads(source)
    steps = doc["pre_tokenizer"].get("pretokenizers", [doc["pre_tokenizer"]])
    drops = any(s["type"] == "Split" and s.get("invert") and s.get("behavior") == "Removed" for s in steps)
    plain = all(not set(a["content"]) & set(" \t\r\n") and not (a["lstrip"] or a["rstrip"] or a["single_word"])
                for a in doc["added_tokens"])
    if not (drops and plain):
        raise ValueError("pieces of this tokenizer can depend on white space")


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each text; one row per input row.

    Columns: the id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (``n_tokens > limit``). A null text counts as empty: 0 bytes, 0 tokens. A
    null id is kept; repeated rows give repeated results, an empty table an
    empty one; other columns are not read, whatever their names. A stretch
    without blanks of any length is counted whole. Tokenizers whose tokens can
    cross white space are refused (``ValueError``).
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:
        source = f.read()
    check_served(source)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = staged(spark, piece_counts(pre_token_frequencies(texts.select("_text")), source), "pre-tokens")
    short = counts.where(F.length("token") <= LONGEST_FREQUENT)
    top = short.where(_level() >= frequent_level(short)).select("token", "pieces").collect()
    frequent = spark.sparkContext.broadcast({r["token"]: r["pieces"] for r in top} | {"": 0})

    def run(cols: dict[str, list]) -> dict[str, list]:
        known = frequent.value
        out: dict[str, list] = {"_row": cols["_row"], "_id": cols["_id"], "n_bytes": [], "here": [], "rest": [], "times": []}
        texts = [x or "" for x in cols["_text"]]
        for part in by_size([len(x) for x in texts]):
            for i in part:
                total, rest, times = 0, [], []
                for token, n in Counter(split(texts[i])).items():
                    pieces = known.get(token)
                    if pieces is None:
                        rest.append(token), times.append(n)
                    else:
                        total += n * pieces
                out["n_bytes"].append(len(texts[i].encode()))
                out["here"].append(total), out["rest"].append(rest), out["times"].append(times)
        return out

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = staged(spark, map_rows(texts.withColumn("_row", F.monotonically_increasing_id()), run,
                                  f"_row bigint, _id {id_type}, n_bytes bigint, here bigint, rest array<string>, "
                                  "times array<int>"), "frequencies")
    each = rows.where(F.size("rest") > 0).select("_row", F.explode(F.arrays_zip("rest", "times")).alias("x"))
    each = each.select("_row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    others = each.join(counts.select("token", "pieces"), "token").groupBy("_row").agg(
        F.sum(F.col("times") * F.col("pieces")).alias("there"))
    total = F.col("here") + F.coalesce("there", F.lit(0))
    out = rows.select("_row", "_id", "n_bytes", "here").join(others, "_row", "left").select(
        F.col("_id").alias(id_col), "n_bytes", total.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
