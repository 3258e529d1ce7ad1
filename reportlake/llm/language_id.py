"""Language identification of mixed-language text.

Each word gets a score per language, from counts of its letter triples in the
labelled texts. The script of its letters narrows the candidates: a language
that the labelled texts hardly ever write in that script is ruled out. Viterbi
over the words, with a penalty for every switch, labels spans of one language;
the language of most words is the document's.

The tables have a fixed number of cells per language, filled by counts that
Spark adds up; texts are scored in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm.common import by_size, id_bucket, letter_words, map_rows

BUCKETS = 1 << 16
#: Log score lost by a switch; greatest log score that one word can add.
SWITCH, WORD_LIMIT = 6.0, 8.0
SMOOTHING = 0.5
#: Words of one stretch of the chained Viterbi search.
STRETCH = 128
#: Labelled documents that teach, at most about this many (a sample by id hash).
TRAIN_DOCS = 20_000
HOLD_OUT = (4, 2)
#: Share of a language's words in a script, below which the script rules it out.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"

#: First code points of script ranges and the script from there on (fixed values).
_SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0F00, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([a for a, _ in _SCRIPTS], dtype=np.uint32)
SCRIPTS = sorted({s for _, s in _SCRIPTS})
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(s) for _, s in _SCRIPTS])


def word_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the letter triples of all words (with a mark before and after
    each), where each word's cells start, and each word's script."""
    lens = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.cumsum(lens + 2) - (lens + 2)
    c = codes.astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(48)
    inside = np.ones(len(h), dtype=bool)
    ends = at + lens  # the triple that would begin with a word's last letter, and the one after it
    inside[ends[ends < len(h)]] = False
    inside[ends[:-1] + 1] = False
    script = _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, codes[at + 1], side="right") - 1]
    return h[inside].astype(np.int64) % BUCKETS, np.cumsum(lens) - lens, script


@dataclass
class Model:
    langs: list[str]
    log: np.ndarray     # cells x languages
    allowed: np.ndarray  # scripts x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score per word and language, 0 for the best candidate and less for the others."""
        cells, starts, script = word_cells(words)
        s = np.add.reduceat(self.log[cells], starts, axis=0)
        allowed = self.allowed[script]
        s = np.where(allowed | ~allowed.any(axis=1, keepdims=True), s, -np.inf)
        return np.maximum(s - s.max(axis=1, keepdims=True), -WORD_LIMIT)


def _runs(scores: np.ndarray, starts: np.ndarray, lens: np.ndarray, first: np.ndarray,
          switch: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best paths through stretches of words, longest stretch first, for each
    language before the stretch: values by (stretch, language before, last
    language), and the language before each word on those paths."""
    k = scores.shape[1]
    enter = np.where(first[:, None, None], 0.0, np.where(np.eye(k, dtype=bool)[None], 0.0, -switch))
    value = enter + scores[starts][:, None, :]
    running = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # stretches longer than t
    same = np.arange(k)
    back = []
    for t in range(1, lens[0]):
        m = running[t]
        v = value[:m]
        top = v.max(axis=2, keepdims=True)
        stay = v >= top - switch
        back.append(np.where(stay, same, v.argmax(axis=2)[..., None]).astype(np.int16))
        value[:m] = np.where(stay, v, top - switch) + scores[starts[:m] + t][:, None, :]
    return value, back


def viterbi(scores: np.ndarray, lens: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language number of every word. ``scores`` has the words of all documents
    one after the other, ``lens`` the words of each.

    Documents are cut into stretches of ``STRETCH`` words. All stretches advance
    together, once for each language that could stand before them; the stretches
    of a document are then chained by their best values.
    """
    k, path = scores.shape[1], np.zeros(len(scores), dtype=np.int64)
    docs = np.nonzero(lens)[0]
    if not len(docs):
        return path
    n = lens[docs]
    pieces = (n + STRETCH - 1) // STRETCH
    head = np.cumsum(pieces) - pieces  # first stretch of each document
    number = np.arange(int(pieces.sum())) - np.repeat(head, pieces)
    starts = np.repeat((np.cumsum(lens) - lens)[docs], pieces) + number * STRETCH
    length = np.minimum(np.repeat(n, pieces) - number * STRETCH, STRETCH)
    order = np.argsort(-length, kind="stable")
    value, back = _runs(scores, starts[order], length[order], (number == 0)[order], switch)
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.arange(len(order))

    total = value[at[head], 0]
    before = np.zeros((len(order), k), dtype=np.int64)  # best language before a stretch, by its last language
    for j in range(1, int(pieces.max())):
        d = np.nonzero(pieces > j)[0]
        ways = total[d][:, :, None] + value[at[head[d] + j]]
        before[head[d] + j] = ways.argmax(axis=1)
        total[d] = ways.max(axis=1)
    last = np.zeros(len(order), dtype=np.int64)
    came = np.zeros(len(order), dtype=np.int64)
    state = total.argmax(axis=1)
    for j in range(int(pieces.max()) - 1, -1, -1):
        d = np.nonzero(pieces > j)[0]
        last[head[d] + j] = state[d]
        state[d] = before[head[d] + j, state[d]]
        came[head[d] + j] = state[d]

    sorted_len, sorted_start = length[order], starts[order]
    state, came = last[order], came[order]
    running = np.searchsorted(-sorted_len, -np.arange(sorted_len[0]), side="left")
    for t in range(int(sorted_len[0]) - 1, -1, -1):
        m = running[t]
        path[sorted_start[:m] + t] = state[:m]
        if t:
            state[:m] = back[t - 1][np.arange(m), came[:m], state[:m]]
    return path


def label_texts(model: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of its words, spans) of each text; spans are (first word,
    last word, language), in words of letters."""
    lists = [letter_words(t) for t in texts]
    lens = np.array([len(ws) for ws in lists], dtype=np.int64)
    if not model.langs or not lens.sum():
        return [(UNKNOWN, 0.0, [])] * len(texts)
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for ws in lists for w in ws])
    path = viterbi(model.word_scores(list(number))[codes], lens)
    out, at = [], 0
    for n in lens.tolist():
        if not n:
            out.append((UNKNOWN, 0.0, []))
            continue
        p = path[at:at + n]
        at += n
        count = np.bincount(p, minlength=len(model.langs))
        cut = np.concatenate([[0], np.nonzero(np.diff(p))[0] + 1, [n]])
        spans = [(int(a), int(b) - 1, model.langs[p[a]]) for a, b in zip(cut[:-1], cut[1:])]
        out.append((model.langs[int(count.argmax())], float(count.max() / n), spans))
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a row teaches nothing; rows without an id never do."""
    return F.coalesce(id_bucket(doc_id, HOLD_OUT[0]) == HOLD_OUT[1], F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_docs: int = TRAIN_DOCS) -> Model:
    """Model of the labelled rows that are not held out, or of a sample of about
    ``train_docs`` of them by a hash of the id. Counts, of a fixed number of cells
    per language, reach the driver."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out(F.col("_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    n = rows.count()
    share = min(1.0, train_docs / max(n, 1))
    rows = rows.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def counts(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"lang": [], "kind": [], "cell": [], "n": []}
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(cols["text"], cols["lang"]):
            by_lang.setdefault(lang, []).extend(letter_words(text))
        for lang, words in by_lang.items():
            if not words:
                out["lang"].append(lang), out["kind"].append(1), out["cell"].append(0), out["n"].append(0)
                continue
            cells, _, script = word_cells(words)
            for kind, x in ((0, cells), (1, script)):
                c = np.bincount(x)
                at = np.nonzero(c)[0]
                out["lang"] += [lang] * len(at)
                out["kind"] += [kind] * len(at)
                out["cell"] += at.tolist()
                out["n"] += c[at].tolist()
        return out

    got = (map_rows(rows.select("text", "lang"), counts, "lang string, kind int, cell int, n bigint")
           .groupBy("lang", "kind", "cell").agg(F.sum("n").alias("n")).collect())
    langs = sorted({r["lang"] for r in got})
    table = np.zeros((BUCKETS, len(langs)))
    words = np.zeros((len(SCRIPTS), len(langs)))
    for r in got:
        (words if r["kind"] else table)[r["cell"], langs.index(r["lang"])] = r["n"]
    log = np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * BUCKETS)
    share_of = words / np.maximum(words.sum(axis=0), 1)
    return Model(langs, log.astype(np.float32), share_of >= SCRIPT_SHARE)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``lang_pred``, ``score`` (share
    of the words so labelled) and ``spans`` of (first, last, lang) in words.

    A null text, one without letters, and any text where nothing was learned is
    ``und`` with score 0. A row with a null id is held out. Ties go to the
    language first in the alphabet. Repeated rows give repeated results, an empty
    table an empty one; other columns are not read, whatever their names. Texts
    of any length are labelled whole.
    """
    model = fit(docs, id_col, text_col, lang_col, train_docs)

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in cols["_text"]]
        got: list[tuple] = []
        for part in by_size([len(t) for t in texts]):
            got += label_texts(model, [texts[i] for i in part])
        return {"_id": cols["_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got],
                "spans": [[{"first": a, "last": b, "lang": c} for a, b, c in g[2]] for g in got]}

    id_type = docs.schema[id_col].dataType.simpleString()
    out = map_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                   f"_id {id_type}, lang_pred string, score double, "
                   "spans array<struct<first:bigint,last:bigint,lang:string>>")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score",
                      "spans")
