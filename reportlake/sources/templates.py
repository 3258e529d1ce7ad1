"""Template documents <-> one row per block.

Documents are YAML text; JSON is valid YAML, so JSON documents go straight to
``from_json``. Only block-style YAML needs the YAML codec, run as an Arrow
batched pandas UDF (YAML -> JSON text) on those rows; everything after that
is in the JVM.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake import constants as K

BLOCK_STRUCT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("days", T.IntegerType()),
    T.StructField("markers", T.BooleanType()), T.StructField("zone_id", T.IntegerType()),
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("show_legend", T.BooleanType()), T.StructField("chart_height", T.IntegerType()),
    T.StructField("width", T.StringType()),
])
GLOBAL_STRUCT = T.StructType([
    T.StructField("customer", T.StringType()), T.StructField("region", T.StringType()),
    T.StructField("orientation", T.StringType()), T.StructField("logo_path", T.StringType()),
])
DOC_SCHEMA = T.StructType([T.StructField("global", GLOBAL_STRUCT),
                           T.StructField("template_blocks", T.ArrayType(BLOCK_STRUCT))])


def _yaml_to_json(text):
    if text is None:
        return None
    import yaml
    try:
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        return json.dumps(yaml.load(text, Loader=loader), default=str)
    except Exception:  # noqa: BLE001 - unreadable document -> null, reported as no blocks
        return None


@F.pandas_udf(T.StringType())
def yaml_to_json(s: pd.Series) -> pd.Series:
    return pd.Series([_yaml_to_json(x) for x in s], dtype=object)


#: JSON text whose strings are printable ASCII: there the YAML library's two emitters write the same.
_PLAIN = re.compile(r'(?:[ -\[\]-~]|\\["\\/])*')


def _json_to_yaml(text):
    """JSON text as block-style YAML, as the library's own emitter writes it. libyaml's emitter
    takes a fraction of the time and writes the same text for printable ASCII; the other texts
    go through the slower one."""
    import yaml
    if text is None:
        return None
    dumper = getattr(yaml, "CSafeDumper", yaml.Dumper) if _PLAIN.fullmatch(text) else yaml.Dumper
    return yaml.dump(json.loads(text), Dumper=dumper, sort_keys=False)


@F.pandas_udf(T.StringType())
def json_to_yaml(s: pd.Series) -> pd.Series:
    return pd.Series([_json_to_yaml(x) for x in s], dtype=object)


def parse_document(doc_col: str = "config_yaml"):
    """Document text -> DOC_SCHEMA struct. JSON text is parsed directly; any
    other text goes through the YAML codec first."""
    txt = F.col(doc_col)
    is_json = F.startswith(F.ltrim(txt), F.lit("{"))
    # The codec is evaluated for every row of the column, so JSON rows hand it null.
    as_json = F.when(is_json, txt).otherwise(yaml_to_json(F.when(~is_json, txt)))
    return F.from_json(as_json, DOC_SCHEMA)


def template_blocks(templates: DataFrame, id_col: str = "id", doc_col: str = "config_yaml") -> DataFrame:
    """One row per block with its position and the template's globals.
    Absent ``template_blocks`` -> no rows; absent region -> 'au1', absent
    orientation -> 'portrait'."""
    d = templates.select(F.col(id_col).alias("template_id"), parse_document(doc_col).alias("_d"))
    g = F.col("_d.global")
    return (d.select("template_id",
                     F.coalesce(g["customer"], F.lit(None)).alias("customer"),
                     F.coalesce(g["region"], F.lit(K.DEFAULT_REGION)).alias("region"),
                     F.coalesce(g["orientation"], F.lit(K.DEFAULT_ORIENTATION)).alias("orientation"),
                     g["logo_path"].alias("logo_path"),
                     F.posexplode(F.col("_d.template_blocks")).alias("block_idx", "_b"))
            .select("template_id", "block_idx", "customer", "region", "orientation", "logo_path", "_b.*"))


def pack_templates(blocks: DataFrame, globals_: DataFrame, fmt: str = "json") -> DataFrame:
    """Inverse of S5 (S6): ordered blocks + globals -> one document per
    template; each block gets its width (default 'full'). Blocks are gathered
    per template (a document is one value), ordered by ``block_idx``.
    ``fmt='yaml'`` writes block-style YAML like the reference's editor."""
    fields = [f.name for f in BLOCK_STRUCT.fields]
    b = blocks
    for f in BLOCK_STRUCT.fields:
        if f.name not in b.columns:
            b = b.withColumn(f.name, F.lit(None).cast(f.dataType))
    b = b.withColumn("width", F.coalesce(F.col("width"), F.lit("full")))
    packed = b.groupBy("template_id").agg(
        F.sort_array(F.collect_list(F.struct("block_idx", *fields))).alias("_bl"))
    packed = packed.select("template_id", F.transform(
        "_bl", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("template_blocks"))
    g = globals_.select(F.col("template_id").alias("_gid"),
                        F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name)
                                   if f.name in globals_.columns else F.lit(None).cast(f.dataType).alias(f.name)
                                   for f in GLOBAL_STRUCT.fields]).alias("global"))
    doc = packed.join(g, packed["template_id"] == g["_gid"], "left")
    text = F.to_json(F.struct("global", "template_blocks"))
    if fmt == "yaml":
        text = json_to_yaml(text)
    return doc.select("template_id", text.alias("config_yaml"))
