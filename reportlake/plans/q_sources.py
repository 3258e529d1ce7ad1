"""Registered source queries.

Envelope fixtures are built from the landed tables, one envelope per bounded
group (an order's line items, a zone-year of history, a customer's zones), so
their number grows with the data while each stays small.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.functions import scalars as S
from reportlake.plans.registry import query
from reportlake.sources import envelopes as E
from reportlake.sources import fixtures as FX
from reportlake.sources import templates as TP
from reportlake.sources.tables import read_table

ISO = "yyyy-MM-dd'T'HH:mm:ss"
ITEM_COLUMNS = {"Severity": "string", "Vulnerabilities": "bigint", "extra": "int"}


def fx_item_envelopes(spark, d):
    li = read_table(spark, d, "lineitem")
    sev = (F.when(F.col("l_returnflag") == "A", "Critical").when(F.col("l_returnflag") == "R", "High")
           .otherwise("Low"))
    g = li.groupBy(F.col("l_orderkey").alias("envelope_id")).agg(F.sort_array(F.collect_list(
        F.struct(F.col("l_linenumber").alias("ln"), "l_partkey", "l_suppkey", "l_extendedprice", sev.alias("s"),
                 F.col("l_quantity").cast("bigint").alias("q"))))
        .alias("xs"))
    items = F.transform("xs", lambda x: F.struct(x["s"].alias("Severity"), x["q"].alias("Vulnerabilities"),
                                                 x["ln"].alias("extra")))
    ents = F.create_map(F.lit("Severity"), F.lit("{}"), F.lit("Vulnerabilities"), F.lit("{}"))
    k = F.col("envelope_id")
    body = (F.when(k % 11 == 0, F.to_json(F.struct(ents.alias("entities"))))
            .when(k % 7 == 0, F.to_json(F.struct(items.alias("items"))))
            .otherwise(F.to_json(F.struct(ents.alias("entities"), items.alias("items")))))
    return g.select("envelope_id", body.alias("body"))


def fx_history_envelopes(spark, d):
    h = FX.fx_history(spark, d)
    g = h.groupBy("zone_id", F.year("timestamp").alias("year")).agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "vuln_severity", "value"))).alias("xs"))
    ts = lambda x: F.date_format(x["timestamp"], ISO)
    recs = F.transform("xs", lambda x: F.struct(ts(x).alias("timestamp"), x["value"].alias("value"),
                                                x["vuln_severity"].alias("vuln_severity")))
    cols = F.struct(F.transform("xs", ts).alias("timestamp"),
                    F.transform("xs", lambda x: x["value"]).alias("value"),
                    F.transform("xs", lambda x: x["vuln_severity"]).alias("vuln_severity"))
    no_value = F.transform("xs", lambda x: F.struct(ts(x).alias("timestamp"),
                                                    x["vuln_severity"].alias("vuln_severity")))
    short = F.struct(F.transform("xs", ts).alias("timestamp"),
                     F.slice(F.transform("xs", lambda x: x["value"]), F.lit(2), F.size("xs")).alias("value"),
                     F.transform("xs", lambda x: x["vuln_severity"]).alias("vuln_severity"))
    z, y = F.col("zone_id"), F.col("year")
    body = (F.when((z == 3) & (y == 1999), F.to_json(F.struct(recs.alias("result"))))
            .when((z == 2) & (y == 1997), F.to_json(F.struct(short.alias("data"))))
            .when((z == 4) & (y == 2000), F.to_json(F.struct(no_value.alias("data"))))
            .when(z % 2 == 1, F.to_json(F.struct(recs.alias("data"))))
            .otherwise(F.to_json(F.struct(cols.alias("data")))))
    return g.select("zone_id", "year", body.alias("body"))


def fx_zone_envelopes(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, d, "region")
    j = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)          # 25-row dim
         .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")))  # 5-row dim
    base = F.array(F.struct((F.col("n_regionkey") + 1).alias("id"), F.col("r_name").alias("name"),
                            F.lit(1).alias("extra")),
                   F.struct((F.col("c_nationkey") + 100).alias("id"), F.col("n_name").alias("name"),
                            F.lit(2).alias("extra")))
    dup = F.when(F.col("c_custkey") % 9 == 0,
                 F.array(F.struct(F.lit(999).alias("id"), F.col("r_name").alias("name"), F.lit(3).alias("extra"))))
    data = F.concat(base, F.coalesce(dup, F.array().cast("array<struct<id:int,name:string,extra:int>>")))
    return j.select(F.col("c_custkey").alias("tenant_id"), F.to_json(F.struct(data.alias("data"))).alias("body"))


def template_globals(spark, d):
    t = FX.fx_templates(spark, d)
    return t.select(F.col("id").alias("template_id"), F.col("name").alias("customer"),
                    F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise("us2").alias("region"),
                    F.when(F.col("id") % 2 == 0, "landscape").alias("orientation"))


@query("entity_items")
def q_entity_items(spark, d):
    return E.entity_items(fx_item_envelopes(spark, d), ITEM_COLUMNS, keys=["envelope_id"])


@query("history_rows")
def q_history_rows(spark, d):
    return E.history_rows(fx_history_envelopes(spark, d), keys=["zone_id", "year"])


@query("normalize_records")
def q_normalize_records(spark, d):
    """Records of every envelope's data, whichever way it holds them, or the error."""
    e = fx_history_envelopes(spark, d)
    recs, err = E.normalize_records(F.get_json_object(F.col("body"), "$.data"), E.HISTORY_ELEMENT)
    n = e.select("zone_id", "year", recs.alias("recs"), err.alias("error"))
    return n.select("zone_id", "year", F.size("recs").alias("n_records"),
                    F.size(F.filter("recs", lambda r: r["value"].isNotNull())).alias("n_values"),
                    F.aggregate("recs", F.lit(0).cast("bigint"),
                                lambda acc, r: acc + F.coalesce(r["value"], F.lit(0))).alias("total"), "error")


@query("zone_rows")
def q_zone_rows(spark, d):
    broken = F.when(F.col("tenant_id") % 11 == 0, F.lit('{"zones": []}')).otherwise(F.col("body"))
    return E.zone_rows(fx_zone_envelopes(spark, d).withColumn("body", broken), keys=["tenant_id"])


@query("zone_dim")
def q_zone_dim(spark, d):
    return E.zone_dim(fx_zone_envelopes(spark, d), keys=["tenant_id"])


@query("zone_by_name")
def q_zone_by_name(spark, d):
    from reportlake.operators.history import zone_by_name
    return zone_by_name(E.zone_dim(fx_zone_envelopes(spark, d), keys=["tenant_id"]), keys=["tenant_id"])


@query("pack_templates")
def q_pack_templates(spark, d):
    return TP.pack_templates(FX.fx_blocks_full(spark, d), template_globals(spark, d))


@query("template_blocks")
def q_template_blocks(spark, d):
    docs = TP.pack_templates(FX.fx_blocks_full(spark, d), template_globals(spark, d), fmt="yaml")
    return TP.template_blocks(docs.withColumnRenamed("template_id", "id"))


@query("template_blocks_json")
def q_template_blocks_json(spark, d):
    docs = TP.pack_templates(FX.fx_blocks_full(spark, d), template_globals(spark, d), fmt="json")
    return TP.template_blocks(docs.withColumnRenamed("template_id", "id"))


@query("catalog_scan")
def q_catalog_scan(spark, d):
    return FX.fx_iso(spark, d).select("event_id", "iso", S.parse_iso_utc("iso").alias("iso_ts"))
