"""Importance resampling towards a target distribution by hashed n-grams.

A task counts the features of its documents with DuckDB: SQL unnests the words,
window functions join neighbouring ones to n-grams, and a registered zlib CRC
names the bucket of each different feature. Every chunk of documents leaves its
bucket counts, a row for each document and one for their sum; Spark writes them
as Parquet. Then Spark merges the sums, one short row for each chunk and bucket
and thus summed before the shuffle, for the corpus and for the target texts. The
logarithms of the smoothed ratios are the buckets' gains, a list as long as there
are buckets. A document's weight is the mean gain of its features, and Gumbel
noise from a hash of its id turns the best weights into a draw without
replacement, ranked over range partitions.

A null text is an empty one: no features, weight 0, too short to be drawn. A null
id draws as an empty one and comes first among ties; rows that repeat a document
have equal scores and each its own rank. Chunks hold whole texts, of any length.
An empty table gives an empty one, and an empty target is uniform over the
buckets. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans import Scratch, dense_index

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_GRAM = 1
N_BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Characters of text that DuckDB gets at once; a longer text is a chunk of its own.
CHUNK_CHARS = 4_000_000

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def feature_sql(max_gram: int, n_buckets: int) -> str:
    """DuckDB SQL over ``chunk(place, text)``: ``place, n_words, n_features, buckets, counts``, a row for each text."""
    # a gram that would reach over the end is null
    longer = "".join(
        f"\n  UNION ALL SELECT place, {" || ' ' || ".join(['word', *(f'lead(word, {k}) OVER w' for k in range(1, n))])} FROM words WINDOW w AS (PARTITION BY place ORDER BY pos)"
        for n in range(2, max_gram + 1)
    )
    return f"""
WITH lists AS (SELECT place, regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '{WORD}') AS found FROM chunk),
words AS (SELECT place, unnest(found) AS word{", generate_subscripts(found, 1) AS pos" if max_gram > 1 else ""} FROM lists),
grams AS (SELECT place, word AS feature FROM words{longer}),
counted AS (SELECT place, feature, count(*) AS n FROM grams WHERE feature IS NOT NULL GROUP BY place, feature),
keyed AS (SELECT feature, crc(feature) % {n_buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
hashed AS (SELECT place, bucket, sum(n)::BIGINT AS n FROM counted JOIN keyed USING (feature) GROUP BY place, bucket),
texts AS (SELECT place, list(bucket ORDER BY bucket)::INT[] AS buckets, list(n ORDER BY bucket)::BIGINT[] AS counts, sum(n)::BIGINT AS n FROM hashed GROUP BY place)
SELECT lists.place, len(found)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM lists LEFT JOIN texts USING (place) ORDER BY lists.place"""


def _connection() -> duckdb.DuckDBPyConnection:
    """An in-memory database of one thread: Spark's tasks are the parallelism."""
    c = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    c.create_function("crc", lambda feature: zlib.crc32(feature.encode()), ["VARCHAR"], "BIGINT")
    return c


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows regrouped so that texts of a chunk have ``limit`` bytes or one row."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy())
        first = 0
        while first < len(table):
            before = ends[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield table.slice(first, stop - first)
            first = stop


_COUNTS = "whole boolean, id {id}, n_words long, n_features long, buckets array<int>, counts array<long>"


def bucket_counts(docs: DataFrame, id_col: str = "doc_id", max_gram: int = MAX_GRAM, n_buckets: int = N_BUCKETS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Bucket counts of every text, and of every chunk (``whole``), whose id is null."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sql, base = feature_sql(max_gram, n_buckets), _connection()
        for chunk in _chunks(batches, chunk_chars):
            texts = chunk.column("text").combine_chunks().fill_null("")
            base.register("chunk", pa.table({"place": pa.array(range(len(chunk)), pa.int64()), "text": texts}))
            found = base.sql(sql).to_arrow_table().combine_chunks()
            base.unregister("chunk")
            buckets, counts = (found.column(c).combine_chunks() for c in ("buckets", "counts"))
            total = np.bincount(buckets.flatten().to_numpy(), weights=counts.flatten().to_numpy().astype(float), minlength=n_buckets).astype(np.int64)
            some = np.flatnonzero(total)
            lists = lambda kind, own, sums: pa.array(own.to_pylist() + [sums], pa.list_(kind))
            ids = pa.concat_arrays([chunk.column("id").combine_chunks(), pa.nulls(1, chunk.schema.field("id").type)])
            longs = lambda name: pa.array(found.column(name).to_pylist() + [int(sum(found.column(name).to_pylist()))], pa.int64())
            whole = pa.array([False] * len(chunk) + [True])
            columns = [whole, ids, longs("n_words"), longs("n_features"), lists(pa.int32(), buckets, some.tolist()), lists(pa.int64(), counts, total[some].tolist())]
            yield pa.RecordBatch.from_arrays(columns, ["whole", "id", "n_words", "n_features", "buckets", "counts"])
        base.close()

    return docs.select(F.col(f"`{id_col}`").alias("id"), "text").mapInArrow(run, _COUNTS.format(id=id_type.simpleString()))


def merged(counts: DataFrame, n_buckets: int = N_BUCKETS) -> list[int]:
    """Features in each bucket over all chunks; as many numbers as there are buckets."""
    pairs = counts.filter("whole").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    rows = pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n")).collect()
    out = [0] * n_buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and the corpus."""
    n, s_all, t_all = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw, target, strict=True)]


def noise(doc_id: object, seed: int = SEED) -> int:
    """Thousandths of the Gumbel noise of a document."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(counts: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    table = np.array(gain, np.int64)
    id_type = counts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, n = b.column("buckets"), b.column("counts")
            worth = np.concatenate([[0], np.cumsum(table[buckets.flatten().to_numpy()] * n.flatten().to_numpy())])
            ends = np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy())])
            features = b.column("n_features").to_numpy()
            weight = (worth[ends[1:]] - worth[ends[:-1]]) // np.maximum(features, 1)
            score = weight + np.array([noise(i, seed) for i in b.column("id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_words"), b.column("n_features"), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return counts.filter("not whole").select("id", "n_words", "n_features", "buckets", "counts").mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, target_id: str, percent: int = PERCENT, min_words: int = MIN_WORDS, max_gram: int = MAX_GRAM, n_buckets: int = N_BUCKETS, seed: int = SEED, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` counts the drawn from 1, others have none."""
    scratch = Scratch(docs.sparkSession, "resampling")
    counts = scratch.save(bucket_counts(docs, "doc_id", max_gram, n_buckets, chunk_chars), "counts")
    wanted = scratch.save(bucket_counts(target, target_id, max_gram, n_buckets, chunk_chars), "target")
    rows = scratch.save(scored(counts, gains(merged(counts, n_buckets), merged(wanted, n_buckets)), seed), "scores")
    scratch.drop("counts", "target")
    long_enough = F.col("n_words") >= min_words
    n_drawn = rows.filter(long_enough).count() * percent // 100
    numbered = dense_index(rows, "_place", [long_enough.desc(), F.desc("score"), F.asc("doc_id")])
    return numbered.withColumn("rank", F.when(F.col("_place") < n_drawn, F.col("_place") + 1)).drop("_place")


def resample_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document, drawn towards the texts of ``benchmark``."""
    return resample(docs, benchmark, "item_id").select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by a table that SQL computes itself, over the bytes of each different word.
ORACLE_RESAMPLE = f"""
WITH RECURSIVE crc_steps AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{WORD}') AS l FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{WORD}') AS l FROM benchmark),
dw AS (SELECT row, unnest(l) AS w FROM d), bw AS (SELECT unnest(l) AS w FROM b),
names AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(w), '..')]),
           lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
         FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
dn AS MATERIALIZED (SELECT row, bucket, count(*) AS n FROM dw JOIN names USING (w) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS n FROM dn GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN names USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
                  / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS g FROM dn JOIN gain USING (bucket) GROUP BY row),
f AS (SELECT doc_id, d.row, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
             floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise
      FROM d LEFT JOIN w USING (row)),
r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS place,
             count(*) FILTER (n_features >= {MIN_WORDS}) OVER () * {PERCENT} // 100 AS drawn FROM f)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= {MIN_WORDS} AND place <= drawn THEN place END::BIGINT AS rank FROM r
"""
