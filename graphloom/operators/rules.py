"""Rules between relations, and questions that a shortcut answers.

A rule says how often a body of one or two relations comes with a head:

* ``inverse``: r1(x, y) with r2(y, x), counted over the pairs of r1
* ``composition``: r1(x, y) and r2(y, z) with r3(x, z), x and z different, counted over all ways x, y, z

Ways are counted by degrees, not listed, and those with a head are triangles. Each triangle is found once, at its node of
least degree, whose edges to nodes of greater degree are at most the square root of twice all edges; so a hub multiplies
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans import Scratch

MIN_SUPPORT, MIN_CONFIDENCE = 2, 0.5


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Different ``src, rel, dst`` without loops and nulls."""
    return edges.select("src", "rel", "dst").dropna().filter("src <> dst").distinct()


def triangles(links: DataFrame) -> DataFrame:
    """``a, b, c``: each triangle of the undirected graph of ``links`` (``src, dst``) once, in any order of its nodes."""
    pairs = links.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).filter("u <> v").distinct()
    degree = pairs.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    at = lambda k: degree.select(F.col("n").alias(k), F.col("d").alias(f"d{k}"))
    both = pairs.join(at("u"), "u").join(at("v"), "v")
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    up = both.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("low"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("high"))
    up = Scratch(links.sparkSession, "triangles").save(up, "up")
    x, y = up.select(F.col("low").alias("a"), F.col("high").alias("b")), up.select(F.col("low").alias("a"), F.col("high").alias("c"))
    wedges = x.join(y, "a").filter("b < c")
    return wedges.join(pairs.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"]).select("a", "b", "c")


def relation_rules(edges: DataFrame) -> DataFrame:
    """``kind, r1, r2, head, support, total, confidence``; ``r2`` is null for inverse rules. Rules without support have no row."""
    spark = edges.sparkSession
    e = Scratch(spark, "rules").save(distinct_edges(edges), "edges")
    sizes = e.groupBy(F.col("rel").alias("r1")).agg(F.count("*").alias("total"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rel").alias("head"))
    mutual = Scratch(spark, "rules-mutual").save(e.withColumnRenamed("rel", "r1").join(back, ["src", "dst"]).groupBy("r1", "head").agg(F.count("*").alias("support")), "mutual")
    inverse = mutual.join(sizes, "r1").select(F.lit("inverse").alias("kind"), "r1", F.lit(None).cast("string").alias("r2"), "head", "support", "total")
    # ways through y are ends times starts at y, less those that lead back to where they began
    into = e.groupBy(F.col("dst").alias("y"), F.col("rel").alias("r1")).agg(F.count("*").alias("n"))
    out = e.groupBy(F.col("src").alias("y"), F.col("rel").alias("r2")).agg(F.count("*").alias("m"))
    ways = into.join(out, "y").groupBy("r1", "r2").agg(F.sum(F.col("n") * F.col("m")).alias("ways"))
    ways = ways.join(mutual.select("r1", F.col("head").alias("r2"), F.col("support").alias("loops")), ["r1", "r2"], "left").select("r1", "r2", (F.col("ways") - F.coalesce("loops", F.lit(0))).alias("total"))
    labels = Scratch(spark, "rules-labels").save(e.groupBy("src", "dst").agg(F.collect_set("rel").alias("rels")), "labels")
    orders = F.array(*[F.struct(*[F.col(c).alias(k) for k, c in zip("xyz", o, strict=True)]) for o in ("abc", "acb", "bac", "bca", "cab", "cba")])
    placed = triangles(e).select(F.explode(orders).alias("t")).select("t.*")
    for name, (a, b) in {"p1": "xy", "p2": "yz", "p3": "xz"}.items():
        placed = placed.join(labels.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("rels").alias(name)), [a, b])
    heads = placed.select(F.explode("p1").alias("r1"), "p2", "p3").select("r1", F.explode("p2").alias("r2"), "p3").select("r1", "r2", F.explode("p3").alias("head"))
    composed = heads.groupBy("r1", "r2", "head").agg(F.count("*").alias("support")).join(ways, ["r1", "r2"])
    composed = composed.select(F.lit("composition").alias("kind"), "r1", "r2", "head", "support", "total")
    return inverse.unionByName(composed).withColumn("confidence", F.col("support") / F.col("total"))


def shortcut_checks(questions: DataFrame, edges: DataFrame, rules: DataFrame, texts: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``question_id, direct, inverse, described, equivalent`` of questions ``question_id, source, target, answer, true_hop``.

    ``direct`` and ``inverse``: an edge leads from source to target, or back. ``described``: the text of one end contains
    that of the other. ``equivalent``: a rule for the answer with enough support and confidence holds between the ends and
    is shorter than ``true_hop``. ``texts``: entity, text. Questions of unknown hop have no equivalent.
    """
    e = Scratch(edges.sparkSession, "shortcuts").save(distinct_edges(edges), "edges")
    q = questions.select("question_id", "source", "target", "answer", "true_hop").distinct()
    ids = ["question_id"]
    forth = q.join(e.select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct(), ["source", "target"], "left_semi").select(*ids, F.lit(True).alias("direct"))
    back = e.select(F.col("src").alias("target"), F.col("dst").alias("source"), F.col("rel").alias("r1"))
    returned = q.join(back.select("source", "target").distinct(), ["source", "target"], "left_semi").select(*ids, F.lit(True).alias("inverse"))
    named = lambda c: texts.select(F.col("entity").alias(c), F.lower("text").alias(f"t_{c}"))
    within = F.contains("t_source", F.col("t_target")) | F.contains("t_target", F.col("t_source"))
    told = q.join(named("source"), "source").join(named("target"), "target").filter("t_source <> '' AND t_target <> ''").filter(within).select(*ids, F.lit(True).alias("described")).distinct()
    good = rules.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)).withColumnRenamed("head", "answer")
    one = q.filter("true_hop > 1").join(back, ["source", "target"]).join(good.filter("kind = 'inverse'").select("r1", "answer"), ["r1", "answer"], "left_semi")
    # a question's first steps are only those that begin a rule for its answer
    firsts = good.filter("kind = 'composition'").select("r1", "r2", "answer")
    start = e.select(F.col("src").alias("source"), F.col("rel").alias("r1"), F.col("dst").alias("y"))
    end = e.select(F.col("src").alias("y"), F.col("rel").alias("r2"), F.col("dst").alias("target"))
    two = q.filter("true_hop > 2").join(firsts, "answer").join(start, ["source", "r1"]).join(end, ["y", "r2", "target"])
    same = one.select(*ids).unionAll(two.select(*ids)).distinct().withColumn("equivalent", F.lit(True))
    out = q.select(*ids).distinct()
    for part in (forth, returned, told, same):
        out = out.join(part.distinct(), "question_id", "left")
    return out.select("question_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("direct", "inverse", "described", "equivalent")])
