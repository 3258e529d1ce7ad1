"""Licence scans with ordered signature rules, in built-in functions only.

A text is reduced to its lower-cased words joined by single blanks. A gate
pattern over the raw text passes only texts that hold one of the keywords at
all; each signature is tried only where its own keyword stands. Matches become
intervals; sorted by start, longest first, an interval is dropped where one of
its own or a better level holds it, which needs one running maximum per level.
Everything is a projection: no shuffle, no user function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm.license_signatures import BASE_LEVEL, SCORES, Signature, signatures

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Between words of the raw text; the same stretches as in the lower-cased text.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPAN = "struct<start:int,neg_end:int,level:int,rule:int,label:string>"


def _gated(text: Column, lower: Column, rows: tuple[Signature, ...]) -> Column:
    """Whether the text holds the cue of any signature. ``cc`` is frequent inside
    other words, so it is tried with the ``by`` that has to follow it."""
    out = F.contains(lower, F.lit("cc")) & text.rlike("(?i)cc" + _GAP + "by")
    for cue in sorted({s.cue for s in rows} - {"cc"}):
        out = out | F.contains(lower, F.lit(cue))
    return out


def _table(rows: tuple[Signature, ...]) -> Column:
    """The signatures, grouped by keyword so that each keyword is looked for once."""
    groups: dict[str, list[Signature]] = {}
    for s in rows:
        groups.setdefault(s.keyword, []).append(s)
    return F.array(*[F.struct(F.lit(" " + key).alias("keyword"), F.array(*[
        F.struct(F.lit(s.rule).alias("rule"), F.lit(s.level).alias("level"), F.lit(s.label).alias("label"),
                 F.lit(" " + s.cue).alias("cue"), F.lit("(?<= )(?:" + s.pattern + ")(?= )").alias("pattern"))
        for s in group]).alias("rules")) for key, group in groups.items()])


def _spans(norm: Column, rule: Column) -> Column:
    """Intervals of one signature: what stands between matches gives their places."""
    matches = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    gaps = F.split(norm, rule["pattern"], -1)
    steps = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    steps = F.filter(steps, lambda x: x["m"].isNotNull())  # the stretch after the last match has no match
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + x["g"]
        end = at + F.length(x["m"])
        span = F.struct(at.alias("start"), (-end).alias("neg_end"), rule["level"].alias("level"),
                        rule["rule"].alias("rule"), rule["label"].alias("label"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _resolved(found: Column) -> Column:
    """Intervals that no interval of their own or a better level holds."""
    levels = len(SCORES)
    best = [f"e{k}" for k in range(levels)]
    start = F.struct(*[F.lit(-1).alias(b) for b in best], F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["neg_end"]
        held = F.lit(False)
        for k, b in enumerate(best):
            held = held | ((x["level"] >= k) & (acc[b] >= end))
        return F.struct(
            *[F.when(x["level"] == k, F.greatest(acc[b], end)).otherwise(acc[b]).alias(b)
              for k, b in enumerate(best)],
            F.when(held, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["out"])


def _word_at(norm: Column, offset: Column) -> Column:
    """Number of words before an offset of the joined words."""
    head = F.substring(norm, F.lit(1), offset)
    return (F.length(head) - F.length(F.replace(head, F.lit(" "))) - 1).cast("bigint")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence detections of each text; one row per input row.

    Columns: the id; ``n_words``; ``n_base``, ``first_word``, ``last_word`` and
    ``base_labels`` of the contract's phrases; ``labels``, theirs and those of
    the resolved detections; ``score``, how sure the best one is (0 without
    any); ``detections``, the resolved ones as (start, end, level, rule, label),
    offsets into the words joined by single blanks with a blank in front.

    A null or empty text has no words and no detections: labels are ``''`` and
    first and last word null. A null id is kept; repeated rows give repeated
    results, an empty table an empty one; other columns are not read, whatever
    their names. Texts are scanned whole. Equal intervals of one level go to
    the earlier signature.
    """
    rows = signatures()
    base_first = next(s.rule for s in rows if s.level == BASE_LEVEL)
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.select("*", F.lower("_text").alias("_lower"))  # a column of its own: read by every cue
    lowered = F.translate("_text", _UPPER, _UPPER.lower())
    df = df.select("_id", F.size(F.array_remove(F.split("_text", _GAP), "")).cast("bigint").alias("n_words"),
                   F.when(_gated(F.col("_text"), F.col("_lower"), rows), F.concat(
                       F.lit(" "), F.array_join(F.array_remove(F.split(lowered, _GAP), ""), " "), F.lit(" ")))
                   .alias("_norm"))
    norm = F.col("_norm")
    tried = F.flatten(F.transform(F.filter(_table(rows), lambda g: F.contains(norm, g["keyword"])),
                                  lambda g: g["rules"]))
    tried = F.filter(tried, lambda r: F.contains(norm, r["cue"]) & F.rlike(norm, r["pattern"]))
    df = df.withColumn("_found", F.when(norm.isNotNull(), F.flatten(F.transform(tried, lambda r: _spans(norm, r)))))
    df = df.withColumn("_found", F.coalesce("_found", F.array().cast(f"array<{_SPAN}>")))
    df = df.select("_id", "n_words", "_norm",
                   F.filter("_found", lambda x: x["rule"] >= base_first).alias("_base"),
                   _resolved(F.col("_found")).alias("_kept"))
    starts = F.transform("_base", lambda x: x["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(F.transform("_base", lambda x: x["label"]),
                                        F.transform("_kept", lambda x: x["label"])))
    scores = F.array(*[F.lit(x) for x in SCORES])
    best = F.array_min(F.transform("_kept", lambda x: x["level"]))
    return df.select(
        F.col("_id").alias(id_col), "n_words", F.size("_base").cast("bigint").alias("n_base"),
        _word_at(norm, F.array_min(starts)).alias("first_word"),
        _word_at(norm, F.array_max(starts)).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.get(scores, best), F.lit(0.0)).alias("score"),
        F.transform("_kept", lambda x: F.struct(
            x["start"].alias("start"), (-x["neg_end"]).alias("end"), x["level"].alias("level"),
            x["rule"].alias("rule"), x["label"].alias("label"))).alias("detections"))

