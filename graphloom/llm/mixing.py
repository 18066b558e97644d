"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys order its
documents; equal ranges of the key space are the range partitions, so their
bounds need no sampling. Token counts are summed by source and range, a prefix
sum over the ranges finds the one range in which the budget ends, and only that
range is sorted to find the document at which the source is cut, to the word.
A budget above the source's size repeats whole epochs first.

Sources in code point order, null last, take ``weights`` in turn. Targets share
all words by weight; none exceeds ``max_epochs`` times its source's size, and
the excess goes to the others by weight.

Null and empty texts have size 0 and take 0 words. Rows that repeat a document
(same doc_id and text) share a key and are treated alike: where the cut falls
on m such rows, each takes an m-th of what is left, rounded down. The one window
without partition key runs over a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Leading hex digits of the key that name its range: 4096 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Hash-random key of a document."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to ``source, source_size``, a row for each source."""
    rank = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    by_ratio = W.orderBy("ratio", F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("cap").over(all_rows) / max_epochs - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(by_ratio))
        # in order of ratio the sources up to some point are capped; the first that isn't sets the level of the rest
        .withColumn("first", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(all_rows))
        .withColumn("target", F.when(F.col("place") < F.col("first.place"), F.col("cap")).otherwise(F.col("weight") * F.col("first.level")))
        .select("source", "source_size", "target")
    )


def slim(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, key`` of every document."""
    doc_id = F.col("doc_id")
    return docs.select(doc_id, "source", word_count(F.col("text")).alias("size"), mix_key(doc_id, F.col("text"), seed).alias("key"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each source: its size, target, whole ``epochs``, and the key at which the last epoch is cut."""
    scratch = Scratch(rows.sparkSession, "mixing")
    part = F.substring("key", 1, RANGE_DIGITS).alias("part")
    parts = scratch.save(rows.groupBy("source", part).agg(F.sum("size").alias("words")), "ranges")
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    budget = F.least(F.floor("target").cast("long"), F.col("source_size") * max_epochs)
    size = F.greatest("source_size", F.lit(1))
    plan = scratch.save(
        targets.withColumn("epochs", F.floor(budget / size).cast("long"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = F.sum("words").over(W.partitionBy("source").orderBy("part")) - F.col("words")
    p, q = parts.withColumn("before", before).alias("p"), plan.alias("q")
    last = (
        p.join(q, same(parts, plan))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")) & (F.col("rest") > 0))
        .select("p.source", "part", (F.col("rest") - F.col("before")).alias("left"))
    )
    last = scratch.save(last, "last")
    inside = (
        rows.withColumn("part", part)
        .alias("r")
        .join(last.alias("l"), rows["source"].eqNullSafe(last["source"]) & (F.col("r.part") == F.col("l.part")))
        .groupBy("r.source", "key", "left")
        .agg(F.sum("size").alias("words"), F.count("*").alias("copies"))
        .withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("key")) - F.col("words"))
        .filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
        .select("source", F.col("key").alias("cut_key"), F.floor((F.col("left") - F.col("before")) / F.col("copies")).cast("long").alias("cut_words"))
    )
    inside = scratch.save(inside, "cuts")
    return scratch.save(
        plan.join(inside, plan["source"].eqNullSafe(inside["source"]), "left").select(
            plan["source"], "source_size", "target", "epochs",
            F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("cut_words", F.lit(0)).cast("long").alias("cut_words"),
        ),
        "plan",
    )


def last_words(size: Column, key: Column) -> Column:
    """Words that the last, cut epoch takes of a document."""
    return F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), F.col("cut_words")).otherwise(F.lit(0)).cast("long")


def mix_digest(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    rows = Scratch(docs.sparkSession, "mixing-rows").save(slim(docs, seed), "slim")
    plan = mix_plan(rows)
    return rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select(
        "doc_id", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + last_words(F.col("size"), F.col("key"))).alias("taken"),
    )


def mix_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each document as often as its source has epochs, and once
    more, cut to the words that the last epoch takes. A cut copy has its own ``n_chars``."""
    plan = mix_plan(Scratch(docs.sparkSession, "mixing-rows").save(slim(docs, seed), "slim"))
    text = F.col("row.text")
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.source").alias("source"), word_count(text).alias("size"), mix_key(F.col("row.doc_id"), text, seed).alias("key"))
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).withColumn("last", last_words(F.col("size"), F.col("key")))
    # zero-width splits at the ends of words keep the white space
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, 1, F.col("last").cast("int")), "")
    cut_row = F.col("row").withField("text", head)
    if "n_chars" in docs.columns:
        cut_row = cut_row.withField("n_chars", F.length(head).cast(docs.schema["n_chars"].dataType))
    extra = F.when(F.col("last") == 0, F.array_repeat("row", 0)).when(F.col("last") == F.col("size"), F.array("row")).otherwise(F.array(cut_row))
    copies = F.concat(F.array_repeat("row", F.col("epochs").cast("int")), extra)
    return joined.select(F.explode(copies).alias("row")).select("row.*")


ORACLE_MIX = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
      FROM d GROUP BY source),
c AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (3 * source_size)::DOUBLE / w AS ratio FROM s),
l AS (SELECT *, (sum(cap) OVER () / 3 - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
      FROM c WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM l),
m AS (SELECT *, min(CASE WHEN ratio >= level THEN place END) OVER () AS first FROM o),
n AS (SELECT *, max(CASE WHEN place = first THEN level END) OVER () AS lam FROM m),
t AS (SELECT source, source_size, CASE WHEN place < first THEN cap ELSE w * lam END AS target FROM n),
b AS (SELECT *, least(floor(target)::BIGINT, 3 * source_size) AS budget FROM t),
g AS (SELECT source, key, sum(size) AS words, count(*) AS copies FROM d GROUP BY source, key),
p AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key) - words AS prior FROM g),
f AS (SELECT p.source, key, source_size, target, budget // greatest(source_size, 1) AS epochs,
             budget - (budget // greatest(source_size, 1)) * source_size AS rest, prior, words, copies
      FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, f.source_size, f.target,
       (epochs * d.size + CASE WHEN prior + words <= rest THEN d.size WHEN prior <= rest THEN (rest - prior) // copies ELSE 0 END)::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.key = f.key
"""
