"""Derived views on the star-schema tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources import table


def _named(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def kg_small(spark: SparkSession, sf: str) -> DataFrame:
    """Triples ``idx, src, rel, dst`` of customers, suppliers and nations."""
    t = lambda name, base, src, key, rel, dst, to: table(spark, sf, name).select(
        (F.lit(base).cast("long") + F.col(key)).alias("idx"), _named(src, key).alias("src"), F.lit(rel).alias("rel"), _named(dst, to).alias("dst")
    )
    a = t("customer", 0, "C", "c_custkey", "lives_in", "N", "c_nationkey")
    b = t("supplier", 10**12, "S", "s_suppkey", "located_in", "N", "s_nationkey")
    return a.unionAll(b).unionAll(t("nation", 2 * 10**12, "N", "n_nationkey", "part_of", "R", "n_regionkey"))


KG_SMALL = """kg_small AS (
  SELECT c_custkey AS idx, 'C' || c_custkey AS src, 'lives_in' AS rel, 'N' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 1000000000000 + s_suppkey, 'S' || s_suppkey, 'located_in', 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 2000000000000 + n_nationkey, 'N' || n_nationkey, 'part_of', 'R' || n_regionkey FROM nation)"""


def kg_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Edges ``graph_id, edge_id, src, rel, dst`` from orders to parts, with parallel ones; every 7th is a loop."""
    src = _named("O", "l_orderkey")
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10**7 + F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 997).alias("graph_id"), place.alias("edge_id"), src.alias("src"), F.concat(F.lit("contains_"), "l_returnflag").alias("rel"),
        F.when(F.col("l_linenumber") == 7, src).otherwise(_named("P", "l_partkey")).alias("dst"),
    )


KG_MULTI = """kg_multi AS (
  SELECT l_orderkey % 997 AS graph_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS edge_id, 'O' || l_orderkey AS src,
         'contains_' || l_returnflag AS rel, CASE WHEN l_linenumber = 7 THEN 'O' || l_orderkey ELSE 'P' || l_partkey END AS dst FROM lineitem)"""

#: Cleaned edges of ``kg_multi``.
CLEAN = """clean AS (
  SELECT graph_id, edge_id, src, rel, dst FROM kg_multi WHERE src <> dst
  QUALIFY row_number() OVER (PARTITION BY graph_id, src, dst ORDER BY edge_id, rel) = 1)"""


def pred_log(spark: SparkSession, sf: str) -> DataFrame:
    """A prediction log from ``events``."""
    kind = F.col("event_type")
    control = F.when(kind.isin("click", "signup"), "correct").when(kind == "error", "none").when(kind == "purchase", "shuffled")
    k = F.regexp_extract("props", '"k": *(-?[0-9]+)', 1).try_cast("int")
    split = F.when(F.col("event_id") % 3 == 1, "test").when(F.col("event_id") % 3 == 2, "validation")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("question_id"), F.nullif(k % 5, F.lit(0)).alias("true_hop"), (1 + F.col("event_id") % 4).alias("recurrence_k"),
        control.alias("adapter_control"), split.alias("split"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("correct"), F.col("event_id").alias("pos"),
    )


PRED_LOG = """pred_log AS (
  SELECT user_id::VARCHAR AS question_id, nullif(try_cast(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT) % 5, 0) AS true_hop,
         1 + event_id % 4 AS recurrence_k,
         CASE WHEN event_type IN ('click', 'signup') THEN 'correct' WHEN event_type = 'error' THEN 'none' WHEN event_type = 'purchase' THEN 'shuffled' END AS adapter_control,
         CASE event_id % 3 WHEN 1 THEN 'test' WHEN 2 THEN 'validation' END AS split, coalesce(value > 20, false) AS correct, event_id AS pos
  FROM events)"""


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``id, pos, question, prediction, targets`` from user turns and the assistant turns that follow them."""
    c = table(spark, sf, "conversations")
    ask = c.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    say = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("prediction"))
    pairs = ask.join(say, ["conv_id", "turn"])
    both = F.concat_ws(" ", "prediction", "question")
    targets = F.when(F.col("turn") % 3 == 0, F.array("question")).when(F.col("turn") % 3 == 1, F.array("question", both)).otherwise(F.array("prediction"))
    return pairs.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("graph"), F.col("turn").alias("pos"), "question", "prediction", targets.alias("targets"))


QA_PAIRS = """qa_pairs AS (
  SELECT a.conv_id || '-' || b.turn AS id, a.conv_id AS graph, b.turn AS pos, a.text AS question, b.text AS prediction,
         CASE b.turn % 3 WHEN 0 THEN [a.text] WHEN 1 THEN [a.text, concat_ws(' ', b.text, a.text)] ELSE [b.text] END AS targets
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""

#: An article stands between characters that are neither letters nor digits; neighbours share one, hence two passes.
_SQL_NORM = (
    "[CASE t WHEN 'man' THEN 'men' WHEN 'woman' THEN 'women' ELSE t END FOR t IN "
    "regexp_split_to_array(regexp_replace(regexp_replace(translate(lower(coalesce({0}, '')), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '(^|[^\\p{{L}}\\p{{N}}])(a|an|the)($|[^\\p{{L}}\\p{{N}}])', '\\1 \\3', 'g'), '(^|[^\\p{{L}}\\p{{N}}])(a|an|the)($|[^\\p{{L}}\\p{{N}}])', '\\1 \\3', 'g'), '[\\s  ]+') "
    "IF t <> '']"
)


def sql_tokens(expression: str) -> str:
    """SQL for ``answer_tokens``."""
    return _SQL_NORM.format(expression)


def sql_normalized(expression: str) -> str:
    return f"array_to_string({sql_tokens(expression)}, ' ')"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Model responses ``item_id, response`` in the formats that the parsers read."""
    b = table(spark, sf, "benchmark").filter(F.col("text").isNotNull())
    t = F.regexp_replace("text", r"[\n\r]+", " ")
    block = lambda n: F.concat(F.lit(f"Type: {n}\nQuestion: what about "), t, F.lit("\nAnswer: it: "), t)
    pair = F.concat(F.lit("Question: why "), t, F.lit("\n\nAnswer: <answer>"), t, F.lit("</answer> <Answer> x\ny </Answer>"))
    m = F.col("item_id") % 4
    text = F.when(m == 0, F.concat(block(1), F.lit("<|>"), block(2))).when(m == 1, F.concat(block(1), F.lit("\n\n"), block(3), F.lit("\n\nrest"))).when(m == 2, pair)
    return b.select("item_id", text.alias("_r"), t.alias("_t")).select("item_id", F.coalesce("_r", F.concat(F.lit("First. Summary: Summary: "), "_t")).alias("response"))


RESPONSES = r"""responses AS (
  SELECT item_id, CASE item_id % 4
    WHEN 0 THEN 'Type: 1' || chr(10) || 'Question: what about ' || t || chr(10) || 'Answer: it: ' || t || '<|>' ||
                'Type: 2' || chr(10) || 'Question: what about ' || t || chr(10) || 'Answer: it: ' || t
    WHEN 1 THEN 'Type: 1' || chr(10) || 'Question: what about ' || t || chr(10) || 'Answer: it: ' || t || chr(10) || chr(10) ||
                'Type: 3' || chr(10) || 'Question: what about ' || t || chr(10) || 'Answer: it: ' || t || chr(10) || chr(10) || 'rest'
    WHEN 2 THEN 'Question: why ' || t || chr(10) || chr(10) || 'Answer: <answer>' || t || '</answer> <Answer> x' || chr(10) || 'y </Answer>'
    ELSE 'First. Summary: Summary: ' || t END AS response
  FROM (SELECT item_id, regexp_replace(text, '[\n\r]+', ' ', 'g') AS t FROM benchmark WHERE text IS NOT NULL))"""
