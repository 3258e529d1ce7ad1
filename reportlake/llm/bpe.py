"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Encoding: a text is cut at the added tokens, each rest into pre-tokens, each
pre-token into its bytes. A segment tree over a pre-token's adjacent pairs
holds in each leaf ``rank * width + position`` (infinite where the pair cannot
merge) and in each inner node the least of its children, so the root names the
leftmost pair of lowest rank. A merge rewrites three leaves (the merged pair,
its left and its right neighbour) and their paths to the root, logarithmic in
the length, until the root is infinite. Trees of equally wide pre-tokens are
kept as rows of one array and advance together, one merge each per step. In a very
long pre-token all merges of the root's rank are done in one step: the leaves
that hold it are found from the root, of a chain of touching ones every second
from the left merges, and their paths are rewritten together. That is the same
order, as a merge's symbol only takes part in merges of higher rank (checked
when the tables are read; else it is one merge a step there too).

Distinct pre-tokens are merged once and remembered (a bounded table per
worker); documents are then joins of remembered id strings. Decoding looks up
the bytes of each id and reads the joined bytes as UTF-8.

The work is one pass over the documents: no shuffle, and a lost task is
simply run again.
"""

from __future__ import annotations

import hashlib
import json
import re as _re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from reportlake.llm.common import by_size, map_rows

#: Pre-tokens remembered by a worker; later ones are merged once per chunk of texts.
REMEMBERED = 400_000
#: Pre-tokens longer than this are merged but not remembered.
LONGEST_REMEMBERED = 64
#: Cells of the arrays that hold one group of trees.
GROUP_CELLS = 1 << 20
#: Pre-tokens of one document worked on at once.
RUN = 200_000

#: Pre-tokens of more bytes than this have a tree of their own.
LONG_WORD = 1 << 10

_INF = np.int64(1) << 62

#: From this character on the Unicode tables of two pattern libraries can differ
#: by version; texts that hold such characters are cut by the tokenizer's own splitter.
_SAFE_BELOW = 0x558
_UNSAFE = _re.compile("[^\\x00-\\u%04x]" % (_SAFE_BELOW - 1))


def _ranges(kind: str) -> str:
    """Character class of one Unicode category below the safe bound."""
    codes = [i for i in range(_SAFE_BELOW) if unicodedata.category(chr(i))[0] == kind]
    runs = [(i, j) for i, j in zip([c for c in codes if c - 1 not in set(codes)],
                                   [c for c in codes if c + 1 not in set(codes)])]
    return "".join("\\u%04x-\\u%04x" % r for r in runs)


def _pre_token_pattern() -> _re.Pattern:
    """The splitting rule of byte-level BPE: contractions; letters, digits or other
    marks with one leading blank; white space, leaving one blank to what follows."""
    letter, digit, white = _ranges("L"), _ranges("N"), "\\t-\\r \\x85\\xa0"
    return _re.compile(f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{digit}]+| ?[^{white}{letter}{digit}]+"
                       f"|[{white}]+(?![^{white}])|[{white}]+")


PRE_TOKEN = _pre_token_pattern()


@dataclass
class BpeTables:
    """What encoding and decoding need of a tokenizer file."""

    name: str
    pair_keys: np.ndarray      # left * size + right, sorted
    pair_ranks: np.ndarray     # rank of each key
    merged: np.ndarray         # id made by the merge of each rank
    byte_ids: np.ndarray       # id of each single byte
    size: int
    id_bytes: list[bytes]
    added: dict[str, int]
    source: str = field(repr=False, default="")

    @cached_property
    def rising(self) -> bool:
        """Whether every symbol is made by a merge of lower rank than those that use it."""
        made = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(made, self.merged, np.arange(len(self.merged)))
        left, right = np.divmod(self.pair_keys, self.size)
        return bool((np.maximum(made[left], made[right]) < self.pair_ranks).all())

    @property
    def added_pattern(self):
        return _re.compile("(" + "|".join(map(_re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary texts:
    printable Latin-1 bytes stand for themselves, the others are numbered from
    256 on in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_tables(path: str) -> BpeTables:
    """Read a byte-level BPE tokenizer file (vocabulary, merges, added tokens)."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    doc = json.loads(source)
    if doc.get("normalizer") is not None or doc["pre_tokenizer"]["type"] != "ByteLevel":
        raise ValueError("a byte-level BPE file without a normalizer is needed")
    vocab = doc["model"]["vocab"]
    added = {a["content"]: a["id"] for a in doc["added_tokens"]}
    size = max([*vocab.values(), *added.values()]) + 1
    alphabet = byte_alphabet()
    to_byte = {c: b for b, c in alphabet.items()}
    id_bytes = [b""] * size
    for tok, i in vocab.items():
        id_bytes[i] = bytes(to_byte[c] for c in tok) if all(c in to_byte for c in tok) else tok.encode()
    for tok, i in added.items():
        id_bytes[i] = tok.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    return BpeTables(hashlib.sha256(source.encode()).hexdigest(), keys[order], order.astype(np.int64), merged,
                     np.array([vocab[alphabet[b]] for b in range(256)], dtype=np.int64), size, id_bytes, added,
                     source)


def _ranks(t: BpeTables, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair, -1 where it cannot merge."""
    key = left * t.size + right
    at = np.searchsorted(t.pair_keys, key)
    at[at == len(t.pair_keys)] = 0
    return np.where(t.pair_keys[at] == key, t.pair_ranks[at], -1)


def _merge_group(t: BpeTables, words: list[bytes], width: int) -> list[bytes]:
    """Merge words of at most ``width + 1`` bytes (``width`` a power of two)."""
    n, w = len(words), width
    lens = np.array([len(x) for x in words])
    sym = np.zeros((n, w + 2), dtype=np.int64)
    cells = np.arange(w + 2)[None, :] < lens[:, None]
    sym[cells] = t.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    nxt = np.broadcast_to(np.arange(1, w + 3), (n, w + 2)).copy()
    prv = np.broadcast_to(np.arange(-1, w + 1), (n, w + 2)).copy()
    alive = cells.copy()
    tree = np.full((n, 2 * w), _INF, dtype=np.int64)

    has = cells[:, 1:w + 1]
    rank = _ranks(t, sym[:, :w][has], sym[:, 1:w + 1][has])
    leaf = np.full(len(rank), _INF, dtype=np.int64)
    pos = np.nonzero(has)[1]
    leaf[rank >= 0] = rank[rank >= 0] * w + pos[rank >= 0]
    tree[:, w:][has] = leaf
    level = w
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half

    def put(rows: np.ndarray, leaves: np.ndarray, left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> None:
        value = np.full(len(rows), _INF, dtype=np.int64)
        r = _ranks(t, left[ok], right[ok])
        value[ok] = np.where(r >= 0, r * w + leaves[ok], _INF)
        set_leaf(rows, leaves, value)

    def set_leaf(rows: np.ndarray, leaves: np.ndarray, value: np.ndarray) -> None:
        node = leaves + w
        tree[rows, node] = value
        while node.size and node[0] > 1:  # all leaves lie equally deep
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    while True:
        rows = np.nonzero(tree[:, 1] < _INF)[0]
        if not rows.size:
            break
        root = tree[rows, 1]
        at = root % w
        right = nxt[rows, at]
        new = t.merged[root // w]
        sym[rows, at] = new
        alive[rows, right] = False
        after = nxt[rows, right]
        nxt[rows, at] = after
        ok_after = after < lens[rows]
        prv[rows[ok_after], after[ok_after]] = at[ok_after]
        inner = right < w  # the last symbol starts no pair
        set_leaf(rows[inner], right[inner], np.full(int(inner.sum()), _INF, dtype=np.int64))
        put(rows, at, new, sym[rows, np.minimum(after, w + 1)], ok_after)
        before = prv[rows, at]
        ok = before >= 0
        if ok.any():
            rb, pb = rows[ok], before[ok]
            put(rb, pb, sym[rb, pb], new[ok], np.ones(len(rb), dtype=bool))

    flat = sym[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _merge_long(t: BpeTables, word: bytes) -> bytes:
    """Merge one long word, all merges of the lowest rank in a step."""
    n = len(word)
    w = 1 << max(1, (n - 2).bit_length())
    sym = t.byte_ids[np.frombuffer(word, dtype=np.uint8)]
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n)
    alive = np.ones(n, dtype=bool)
    tree = np.full(2 * w, _INF, dtype=np.int64)
    rank = _ranks(t, sym[:-1], sym[1:])
    tree[w:w + n - 1] = np.where(rank >= 0, rank, _INF)
    level = w
    while level > 1:
        tree[level // 2:level] = np.minimum(tree[level:2 * level:2], tree[level + 1:2 * level:2])
        level //= 2

    while tree[1] < _INF:
        lowest = tree[1]
        node = np.array([1])
        while node[0] < w:  # down to the leaves that hold the root's rank, from left to right
            node = np.stack([2 * node, 2 * node + 1], axis=1).ravel()
            node = node[tree[node] == lowest]
        at = node - w
        if len(at) > 1:  # of a chain of touching pairs, every second from the left
            k = np.arange(len(at))
            fresh = np.append(True, at[1:] != nxt[at[:-1]])
            at = at[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
        right = nxt[at]
        after = nxt[right]
        sym[at] = t.merged[lowest]
        alive[right] = False
        nxt[at] = after
        prv[after] = at  # the entry behind the last symbol is no symbol
        before = prv[at]
        left = np.unique(np.concatenate([before[before >= 0], at]))
        follows = nxt[left]
        pair = follows < n
        value = np.full(len(left), _INF, dtype=np.int64)
        rank = _ranks(t, sym[left[pair]], sym[follows[pair]])
        value[pair] = np.where(rank >= 0, rank, _INF)
        tree[w + left] = value
        right = right[right < w]
        tree[w + right] = _INF
        node = np.unique(np.concatenate([left, right])) + w
        while node[0] > 1:
            node = node >> 1
            node = node[np.append(True, node[1:] != node[:-1])]
            tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
    return sym[alive].astype("<u4").tobytes()


def merge_words(t: BpeTables, words: list[bytes]) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of each pre-token's bytes."""
    out: list[bytes] = [b""] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) == 1:
            out[i] = int(t.byte_ids[word[0]]).to_bytes(4, "little")
        elif len(word) > LONG_WORD and t.rising:
            out[i] = _merge_long(t, word)
        elif word:
            by_width.setdefault(1 << max(0, (len(word) - 2).bit_length()), []).append(i)
    for width, at in by_width.items():
        step = max(1, GROUP_CELLS // (5 * width))
        for k in range(0, len(at), step):
            part = at[k:k + step]
            for i, ids in zip(part, _merge_group(t, [words[i] for i in part], width)):
                out[i] = ids
    return out


@lru_cache(maxsize=2)
def _splitter(source: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_str(source).pre_tokenizer


def pre_tokens(t: BpeTables, text: str) -> list[str]:
    if _UNSAFE.search(text):
        return [text[a:b] for _, (a, b) in _splitter(t.source).pre_tokenize_str(text)]
    return PRE_TOKEN.findall(text)


class BpeCoder:
    """Encoder and decoder of one worker."""

    def __init__(self, tables: BpeTables):
        self.t = tables
        self.added_pattern = tables.added_pattern
        self.known: dict[str, bytes] = {}

    def parts(self, text: str) -> list[str]:
        """Pre-tokens and added tokens in order."""
        if self.added_pattern is None:
            return pre_tokens(self.t, text)
        out: list[str] = []
        for i, piece in enumerate(self.added_pattern.split(text)):
            if i % 2:
                out.append(piece)
            elif piece:
                out.extend(pre_tokens(self.t, piece))
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words; the first ``REMEMBERED`` short ones are kept."""
        fresh = [x for x in words if x not in self.known]
        if not fresh:
            return self.known
        made = dict(zip(fresh, merge_words(self.t, [x.encode() for x in fresh])))
        for x in made.keys() & self.t.added.keys():
            made[x] = self.t.added[x].to_bytes(4, "little")
        if len(self.known) + len(made) <= REMEMBERED and max(map(len, fresh)) <= LONGEST_REMEMBERED:
            self.known.update(made)
            return self.known
        out = {x: self.known[x] for x in words if x in self.known} | made
        for x in fresh:
            if len(self.known) >= REMEMBERED:
                break
            if len(x) <= LONGEST_REMEMBERED:
                self.known[x] = made[x]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        parts = [self.parts(x) for x in texts]
        ids = self.learn(set().union(*parts)) if parts else {}
        return [b"".join(map(ids.__getitem__, p)) for p in parts]

    def encode_long(self, text: str) -> list[bytes]:
        """Ids of one long text, run by run."""
        parts = self.parts(text)
        out = []
        for k in range(0, len(parts), RUN):
            run = parts[k:k + RUN]
            ids = self.learn(set(run))
            out.append(b"".join(map(ids.__getitem__, run)))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.t.id_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_CODERS: dict[str, BpeCoder] = {}


def coder(tables: BpeTables) -> BpeCoder:
    if tables.name not in _CODERS:
        _CODERS.clear()
        _CODERS[tables.name] = BpeCoder(tables)
    return _CODERS[tables.name]


def bpe_round_trip(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                   keep_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids again; one row per input row.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (ids as little-endian
    unsigned 32-bit integers), ``decoded_sha256`` (decoded text in UTF-8) and,
    with ``keep_ids``, ``ids`` (those bytes).

    A null text counts as empty: no tokens, digests of nothing. A null id is
    kept. Rows are independent, so repeated rows give repeated results and an
    empty table an empty one; other columns are not read, whatever their
    names. Long texts are encoded in runs of pre-tokens.
    """
    tables = load_tables(tokenizer_file)

    def run(cols: dict[str, list]) -> dict[str, list]:
        c = coder(tables)
        texts = [x or "" for x in cols["_text"]]
        n, ids_hash, text_hash, kept = [], [], [], []
        for part in by_size([len(x) for x in texts]):
            many = [texts[i] for i in part]
            coded = [c.encode_long(many[0])] if len(many) == 1 else [[x] for x in c.encode_many(many)]
            for runs in coded:
                h, g = hashlib.sha256(), hashlib.sha256()
                for ids in runs:
                    h.update(ids)
                    g.update(c.decode(ids).encode())
                n.append(sum(map(len, runs)) // 4)
                ids_hash.append(h.hexdigest())
                text_hash.append(g.hexdigest())
                if keep_ids:
                    kept.append(b"".join(runs))
        return {"_id": cols["_id"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash, "ids": kept}

    id_type = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                   f"_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
                   + (", ids binary" if keep_ids else ""))
    return out.withColumnRenamed("_id", id_col)


def bpe_encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_tokens`` and ``ids`` of each row; see :func:`bpe_round_trip` for the defined cases."""
    return bpe_round_trip(docs, tokenizer_file, id_col, text_col, keep_ids=True).select(id_col, "n_tokens", "ids")


def bpe_decode(coded: DataFrame, tokenizer_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and decoded ``text`` of each row of ids, as :func:`bpe_encode` gives them.

    Null or empty ids give an empty text, bytes that are no UTF-8 the replacement
    character. A null id is kept; repeated rows give repeated results, an empty
    table an empty one; other columns are not read, whatever their names.
    """
    tables = load_tables(tokenizer_file)

    def run(cols: dict[str, list]) -> dict[str, list]:
        c = coder(tables)
        return {"_id": cols["_id"], "text": [c.decode(bytes(x or b"")) for x in cols["_ids"]]}

    id_type = coded.schema[id_col].dataType.simpleString()
    return map_rows(coded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")), run,
                    f"_id {id_type}, text string").withColumnRenamed("_id", id_col)
