"""Periodic runs of words, by minimizers of several scales.

A run is a stretch of words with smallest period q, of length at least
max(``LEAST_LENGTH``, ``LEAST_POWER`` * q), that no neighbouring word extends.
Equal words are ``q`` apart all along it.

Short periods are found directly: the words are compared with themselves at
every lag below the first scale, and stretches of equality are runs.

For longer periods the scales have widths W, each covering the periods from
2 W / 3 to W. Every place gets the hash of the W words that start there; a
place is a minimizer if its hash is the least of some W neighbouring ones.
Inside a run of such a period q the W-word stretches of one period all differ
(q <= W, and q is the smallest period), so the least of them stands once in each
period, and 2 W <= 3 q leaves room for two of its copies: they are minimizers,
equal, and next to each other among the equal ones. So every run holds a pair of
neighbouring equal minimizers at distance q. Each such pair seeds an extension to
both sides, on the words themselves; a stretch is extended once for each period.
Stretches whose period is a multiple of a smaller one are left to that one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm.common import by_size, map_rows

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Periods up to this one are found by comparing at every lag.
DIRECT_LAGS = 8

_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

Run = tuple[int, int, int]  # start, length, period


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def scales(longest: int, least_power: int = LEAST_POWER) -> list[tuple[int, int]]:
    """(least period, width) of every scale needed for texts of ``longest`` words."""
    out, q = [], DIRECT_LAGS + 1
    while least_power * q <= longest:
        width = 3 * q // 2
        out.append((q, width))
        q = width + 1
    return out


def stretch_hashes(codes: np.ndarray, width: int, doubled: list[np.ndarray]) -> np.ndarray:
    """Hash of the ``width`` codes from every place on. ``doubled`` keeps the hashes
    of stretches of 1, 2, 4, ... for the next widths."""
    if not doubled:
        doubled.append(_mixed(codes.astype(np.uint64) + np.uint64(1)))
    level = width.bit_length() - 1
    while len(doubled) <= level:
        h, step = doubled[-1], 1 << (len(doubled) - 1)
        doubled.append(_mixed(h[:-step] * _K1 + h[step:]) if len(h) > step else h[:0])
    h, rest = doubled[level], width - (1 << level)
    if not rest or len(h) <= rest:
        return h if not rest else h[:0]
    return _mixed(h[:-rest] * _K2 + h[rest:])


def sliding(x: np.ndarray, width: int, op: np.ufunc, neutral: int) -> np.ndarray:
    """``op`` over every ``width`` neighbouring values: running from both ends of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, neutral, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n - width + 1], ahead[width - 1:n])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some ``width`` neighbouring ones."""
    least = sliding(hashes, width, np.minimum, (1 << 64) - 1)
    if not len(least):
        return np.zeros(0, dtype=np.int64)
    around = np.zeros(len(hashes) + width - 1, dtype=np.uint64)  # windows that hold place p: p - width + 1 .. p
    around[width - 1:width - 1 + len(least)] = least
    return np.nonzero(sliding(around, width, np.maximum, 0) == hashes)[0]


def _equal_ahead(codes: np.ndarray, a: int, b: int) -> int:
    """How many codes from ``a`` and ``b`` (greater) on are equal, by growing steps."""
    done, step, n = 0, 32, len(codes)
    while b + done < n:
        m = min(step, n - b - done)
        odd = np.nonzero(codes[a + done:a + done + m] != codes[b + done:b + done + m])[0]
        if len(odd):
            return done + int(odd[0])
        done, step = done + m, step * 2
    return done


def _equal_behind(codes: np.ndarray, a: int, b: int) -> int:
    """How many codes before ``a`` and ``b`` (greater) are equal, by growing steps."""
    done, step = 0, 32
    while a - done > 0:
        m = min(step, a - done)
        odd = np.nonzero(codes[a - done - m:a - done] != codes[b - done - m:b - done])[0]
        if len(odd):
            return done + m - 1 - int(odd[-1])
        done, step = done + m, step * 2
    return done


def _prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + ([q] if q > 1 else [])


def _primitive(codes: np.ndarray, start: int, q: int) -> bool:
    """Whether the ``q`` codes from ``start`` on repeat no shorter piece."""
    piece = codes[start:start + q]
    return not any(np.array_equal(piece[q // f:], piece[:-(q // f)]) for f in _prime_factors(q))


def find_runs(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, least_length: int = LEAST_LENGTH,
              least_power: int = LEAST_POWER) -> list[Run]:
    """Runs of several texts at once, as places in ``codes``: text t is
    ``codes[starts[t]:starts[t] + lens[t]]`` and is followed by a code that stands
    nowhere else, so no run crosses texts."""
    out: list[Run] = []
    for q in range(1, min(DIRECT_LAGS, len(codes) - 1) + 1):
        same = np.zeros(len(codes) - q + 2, dtype=np.int8)
        same[1:-1] = codes[q:] == codes[:-q]
        edge = np.diff(same)
        first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        long = last - first + q >= max(least_length, least_power * q)
        out += [(a, b - a + q, q) for a, b in zip(first[long].tolist(), last[long].tolist())
                if _primitive(codes, a, q)]
    longest = int(lens.max()) if len(lens) else 0
    kept: tuple[int, np.ndarray, np.ndarray] | None = None
    doubled: list[np.ndarray] = []
    for least, width in scales(longest, least_power):
        fit = np.nonzero(lens >= least_power * least)[0]
        if kept is None or kept[0] != len(fit):  # fewer texts are long enough: hash those alone
            at = np.concatenate([np.arange(starts[t], starts[t] + lens[t] + 1) for t in fit])
            kept, doubled = (len(fit), at, codes[at]), []
        _, at, own = kept
        hashes = stretch_hashes(own, width, doubled)
        chosen = minimizers(hashes, width)
        order = chosen[np.argsort(hashes[chosen], kind="stable")]
        a, b = order[:-1], order[1:]
        pair = (hashes[a] == hashes[b]) & (b - a >= least) & (b - a <= width)
        a, b = a[pair], b[pair]
        by_lag = np.lexsort((a, b - a))
        done: dict[int, int] = {}  # lag: end of the last stretch extended
        for x, y in zip(a[by_lag].tolist(), b[by_lag].tolist()):
            q = y - x
            if y < done.get(q, 0):
                continue
            start = x - _equal_behind(own, x, y)
            end = y + _equal_ahead(own, x, y)
            done[q] = end
            if end - start >= max(least_length, least_power * q) and _primitive(own, start, q):
                out.append((int(at[start]), end - start, q))
    return out


def text_runs(texts: list[str], least_length: int = LEAST_LENGTH,
              least_power: int = LEAST_POWER) -> list[tuple[list[Run], list[bytes], np.ndarray]]:
    """Per text: its runs by start and period, its words, and which of them stay
    when every run keeps its first period."""
    lists = [t.encode().split() for t in texts]
    lens = np.array([len(ws) for ws in lists], dtype=np.int64)
    starts = np.cumsum(lens + 1) - (lens + 1)
    number: dict[bytes, int] = {}
    codes = np.zeros(int((lens + 1).sum()), dtype=np.int64)
    for t, (ws, at, n) in enumerate(zip(lists, starts.tolist(), lens.tolist())):
        codes[at:at + n] = [number.setdefault(w, len(number)) for w in ws]
        codes[at + n] = -1 - t
    out = [([], ws, np.ones(len(ws), dtype=bool)) for ws in lists]
    for start, length, q in find_runs(codes, starts, lens, least_length, least_power):
        t = int(np.searchsorted(starts, start, side="right")) - 1
        at = start - int(starts[t])
        out[t][0].append((at, length, q))
        out[t][2][at + q:at + length] = False
    for runs, _, _ in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run of most repeats (length / period, exactly); ties: least start, then period."""
    best = None
    for run in runs:  # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                  least_power: int = LEAST_POWER) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``runs`` (array of start, length,
    period in words, by start and period), ``best`` (the run of most repeats, or
    null) and ``collapsed``, the text's words joined by one space without those
    that a run holds after its first period.

    Words are runs without ASCII white space, compared exactly. A null or empty
    text, or one without words, has no runs and an empty ``collapsed``. Null ids
    are rows like any other. Equal repeats: least start, then least period.
    Repeated rows give repeated results, an empty table an empty one; other
    columns are not read, whatever their names. Texts are read whole; the work
    on one grows with its words times the logarithm of their number.
    """
    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in cols["_text"]]
        out: dict[str, list] = {"_id": cols["_id"], "n_words": [], "runs": [], "best": [], "collapsed": []}
        for part in by_size([len(t) for t in texts]):
            for runs, words, stay in text_runs([texts[i] for i in part], least_length, least_power):
                named = [dict(zip(("start", "length", "period"), r)) for r in runs]
                best = strongest(runs)
                out["n_words"].append(len(words))
                out["runs"].append(named)
                out["best"].append(named[runs.index(best)] if best else None)
                out["collapsed"].append(b" ".join(
                    [w for w, s in zip(words, stay.tolist()) if s] if runs else words).decode())
        return out

    id_type = docs.schema[id_col].dataType.simpleString()
    shape = "struct<start:bigint,length:bigint,period:bigint>"
    found = map_rows(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                     f"_id {id_type}, n_words bigint, runs array<{shape}>, best {shape}, collapsed string")
    return found.withColumnRenamed("_id", id_col)


def with_repeats(text: Column, seed: Column) -> Column:
    """The words of ``text`` where the seed is a multiple of ten, with their tail made
    periodic: with g = seed // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8), each
    word i >= a becomes word a + (i - a) % p. Other texts, and null seeds, stay as they are."""
    return F.when(seed % 10 == 0, F.transform(F.array(text), lambda t: _tail(t, seed))[0]).otherwise(text)


def _tail(text: Column, seed: Column) -> Column:
    def repeat(words: Column) -> Column:
        n, g = F.size(words), F.floor(seed / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        made = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.get(words, (a + F.greatest(i - a, F.lit(0)) % p).cast("int"))))
        return F.when(n > 0, F.array_join(made, " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.transform(F.array(words), repeat)[0]


def runs_text(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
