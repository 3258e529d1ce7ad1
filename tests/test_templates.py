"""The YAML codec of template documents."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from reportlake.sources import templates as TP

PLAIN = ["half", "", "yes", "null", "~", "1e3", "2024-01-01", "a: b", "# c", " lead", "trail ", "it's", 'say "x" \\ y',
         "<<", "- x", "SELECT severity AS Severity, count(*) AS n FROM rl_vulns WHERE name LIKE 'zzz%' " * 3, "\\n"]
ODD = ["two\nlines", "tab\there", "café", "é " * 60, "\U0001f600", "﻿", "\x85", " ", "\x07", "\ud800"]


def document(text):
    return json.dumps({"global": {"customer": text}, "template_blocks": [
        {"type": text, "days": 3, "show_legend": True, "title": f"x {text}"}, {"type": "table", "query": text}]})


@pytest.mark.parametrize("text", PLAIN + ODD)
def test_yaml_text_is_the_library_s_own(text):
    for ascii_only in (True, False):
        doc = json.dumps(json.loads(document(text)), ensure_ascii=ascii_only)
        assert TP._json_to_yaml(doc) == yaml.dump(json.loads(doc), sort_keys=False)


@pytest.mark.skipif(not yaml.__with_libyaml__, reason="no libyaml")
@pytest.mark.parametrize("text", PLAIN)
def test_plain_documents_are_written_by_libyaml(text, monkeypatch):
    def slow(*_, **__):
        raise AssertionError("emitted in Python")
    monkeypatch.setattr(yaml.emitter.Emitter, "__init__", slow)
    assert json.loads(TP._yaml_to_json(TP._json_to_yaml(document(text)))) == json.loads(document(text))


def test_blocks_come_back_from_yaml(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate((PLAIN + ODD)[:-1])], "template_id bigint, title string")
    blocks = texts.withColumn("block_idx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("type", F.lit("table"))
    docs = TP.pack_templates(blocks, texts.select("template_id", F.col("title").alias("customer")), fmt="yaml")
    back = TP.template_blocks(docs, id_col="template_id").select("template_id", "block_idx", "title", "customer")
    want = blocks.select("template_id", "block_idx", "title", F.col("title").alias("customer"))
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
