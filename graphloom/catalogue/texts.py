"""Queries on training texts, prompts, parsers and the inference cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graph as G
from graphloom.operators import infer as I
from graphloom.operators import orchestrate as O
from graphloom.operators import sample as S
from graphloom.operators import tasks as T
from graphloom.plans import Scratch
from graphloom.sources import table

from .graph import UPSAMPLED
from .questions import _unit
from .registry import query
from .views import CLEAN, KG_MULTI, KG_SMALL, QA_PAIRS, RESPONSES, kg_multi, kg_small, qa_pairs, responses

SYSTEM_PROMPTS = ["Answer briefly.", "Answer precisely. Do not guess.", "Answer from the context only."]


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned edges weighted by whole numbers, so that cumulative sums are exact in any order."""
    e = G.clean_edges(kg_multi(spark, sf))
    return e.withColumn("weight", (1 + F.col("edge_id") % 3).cast("long"))


def _draws_sql(scope: str, k: int) -> str:
    return f"""cum AS (SELECT *, 1 + edge_id % 3 AS w, sum(1 + edge_id % 3) OVER (PARTITION BY graph_id ORDER BY edge_id, rel, dst) AS upto, sum(1 + edge_id % 3) OVER (PARTITION BY graph_id) AS total FROM clean),
dr AS (SELECT graph_id, draw, md5('2026:{scope}:' || graph_id || ':' || draw) AS h FROM (SELECT DISTINCT graph_id FROM clean), (SELECT unnest(range({k})) AS draw)),
draws AS (SELECT c.graph_id, edge_id, src, rel, dst, draw::INT AS draw FROM cum c JOIN dr d ON c.graph_id = d.graph_id AND upto - w <= (1 - {_unit('h')}) * total AND (1 - {_unit('h')}) * total < upto)"""


@query(f"""{UPSAMPLED}, eup AS (SELECT *, min(weight) OVER (PARTITION BY graph_id) AS lo, max(weight) OVER (PARTITION BY graph_id) AS hi FROM ew),
eu AS (SELECT *, (CASE WHEN lo = hi THEN 3 ELSE greatest(1, least(3, round_even((weight - lo) / (hi - lo) * 2 + 1, 0))) END)::INT AS copies FROM eup)
SELECT graph_id, 'node' AS kind, node AS sample_id, 'In context graph ' || graph_id || ', there is a node ' || node || '.' AS text, unnest(range(1, copies + 1))::INT AS copy FROM up
UNION ALL SELECT graph_id, 'edge', edge_id::VARCHAR, 'In context graph ' || graph_id || ', the node ' || src || ' is ' || rel || ' the node ' || dst || '.', unnest(range(1, copies + 1))::INT FROM eu""")
def context_samples(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = G.weights(G.clean_edges(kg_multi(spark, sf), by_source=True))
    return T.context_samples(G.upsample_counts(nodes, ["graph_id"]), G.upsample_counts(edges, ["graph_id"]))


def _hex8(key: str) -> str:
    return "(" + " + ".join(f"(strpos('0123456789abcdef', substr({key}, {i + 1}, 1)) - 1)::BIGINT * {16 ** (7 - i)}" for i in range(8)) + ")"


@query(f"""WITH {KG_MULTI}, {CLEAN}, {_draws_sql('cqa', 3)}, k AS (SELECT *, {_hex8("md5('2026:kind:' || graph_id || ':' || draw)")} % 3 AS kind FROM draws)
SELECT graph_id, draw, CASE kind WHEN 0 THEN 'what is the relation between ' || src || ' and ' || dst || '?' WHEN 1 THEN 'which entity has the relation ' || rel || ' to ' || dst || '?' ELSE 'Which entity has the relation ' || rel || ' from ' || src || '?' END AS question,
  CASE kind WHEN 0 THEN rel WHEN 1 THEN src ELSE dst END AS answer FROM k""")
def context_qa(spark: SparkSession, sf: str) -> DataFrame:
    draws = S.sample_weighted_replace(_weighted(spark, sf), ["graph_id"], ["edge_id", "rel", "dst"], "weight", 3, 2026, "cqa")
    return T.context_qa(draws, 2026)


@query(f"""WITH {KG_MULTI}, {CLEAN}, {_draws_sql('reason', 30)}
SELECT graph_id, (draw // 6)::INT AS sample, ['global', 'multihop', 'binary', 'kshot'][(draw // 6) % 4 + 1] AS prompt_kind, string_agg('the ' || src || ' is ' || rel || ' the ' || dst || '; ', '' ORDER BY draw) AS context FROM draws GROUP BY graph_id, draw // 6""")
def reasoning_context(spark: SparkSession, sf: str) -> DataFrame:
    return T.reasoning_contexts(_weighted(spark, sf), 5, 2026)


@query(f"""WITH {QA_PAIRS} SELECT graph AS graph_id, (row_number() OVER (PARTITION BY graph ORDER BY pos) - 1)::INT AS place, 'Question: ' || question || chr(10) || 'Answer: ' || prediction AS text FROM qa_pairs""")
def reference_qa(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("pos", "question", "prediction")))
    g = qa_pairs(spark, sf).groupBy(F.col("graph").alias("graph_id")).agg(turns.alias("t"))
    return T.reference_qa(g.select("graph_id", F.col("t.question").alias("questions"), F.col("t.prediction").alias("answers")))


@query(f"""WITH {KG_SMALL}, h1 AS (SELECT 'N' || n_nationkey AS query, 'R' || n_regionkey AS node FROM nation), n AS (SELECT 'N' || n_nationkey AS query, 'N' || n_nationkey AS node FROM nation UNION SELECT * FROM h1),
s AS (SELECT a.query, string_agg('the source node ' || src || ' is ' || rel || ' the target node ' || dst || '; ', '' ORDER BY idx) AS p FROM kg_small JOIN n a ON a.node = src JOIN n b ON b.query = a.query AND b.node = dst GROUP BY a.query)
SELECT 'N' || n_nationkey AS query, 'The root node is N' || n_nationkey || '. The subgraph including edges: ' || coalesce(p, '') AS context FROM nation LEFT JOIN s ON s.query = 'N' || n_nationkey""")
def subgraph_context(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    return T.subgraph_contexts(kg_small(spark, sf).withColumnRenamed("idx", "edge_id"), table(spark, sf, "nation").select(name.alias("query"), name.alias("node")))


@query(f"""WITH {KG_MULTI}, {CLEAN}, {_draws_sql('sum', 2)}, n AS (SELECT graph_id, node, count(*) AS w FROM (SELECT graph_id, src AS node FROM clean UNION ALL SELECT graph_id, dst FROM clean) GROUP BY graph_id, node),
nc AS (SELECT *, sum(w) OVER (PARTITION BY graph_id ORDER BY node) AS upto, sum(w) OVER (PARTITION BY graph_id) AS total FROM n),
nd AS (SELECT graph_id, draw, md5('2026:sumn:' || graph_id || ':' || draw) AS h FROM (SELECT DISTINCT graph_id FROM clean), (SELECT unnest(range(2)) AS draw))
SELECT graph_id, 'edge' AS kind, draw, 'the ' || src || ' is ' || rel || ' the ' || dst || '; ' AS context FROM draws
UNION ALL SELECT c.graph_id, 'node', d.draw::INT, node FROM nc c JOIN nd d ON c.graph_id = d.graph_id AND upto - w <= (1 - {_unit('h')}) * total AND (1 - {_unit('h')}) * total < upto""")
def summary_contexts(spark: SparkSession, sf: str) -> DataFrame:
    edges = S.sample_weighted_replace(_weighted(spark, sf), ["graph_id"], ["edge_id", "rel", "dst"], "weight", 2, 2026, "sum")
    d = G.degrees(G.clean_edges(kg_multi(spark, sf))).withColumn("w", F.col("n_in") + F.col("n_out"))
    nodes = S.sample_weighted_replace(d, ["graph_id"], ["node"], "w", 2, 2026, "sumn")
    parts = {"edge": T.edge_contexts(edges), "node": T.node_contexts(nodes)}
    out = [df.select("graph_id", F.lit(k).alias("kind"), "draw", "context") for k, df in parts.items()]
    return out[0].unionAll(out[1])


@query(f"""WITH {QA_PAIRS}, {KG_MULTI}, {CLEAN}, {_draws_sql('reason', 24)}, shots AS (SELECT string_agg(question, '; ' ORDER BY md5('2026:shots:' || question), question) AS s FROM (SELECT question FROM qa_pairs ORDER BY md5('2026:shots:' || question), question LIMIT 8))
SELECT graph_id, (draw // 6)::INT AS sample, CASE WHEN draw // 6 = 3 THEN any_value(s) END AS sample_questions, string_agg('the ' || src || ' is ' || rel || ' the ' || dst || '; ', '' ORDER BY draw) AS context FROM draws, shots GROUP BY graph_id, draw // 6""")
def reasoning_prompts(spark: SparkSession, sf: str) -> DataFrame:
    shots = T.shot_questions(qa_pairs(spark, sf), 2026)
    return T.reasoning_prompts(T.reasoning_contexts(_weighted(spark, sf), 4, 2026), shots).drop("prompt_kind")


BLOCKS = f"""WITH {RESPONSES}, pieces AS (SELECT item_id, CASE WHEN contains(response, '<|>') THEN string_split(response, '<|>') ELSE string_split(response, chr(10) || chr(10)) END AS ps FROM responses),
lines AS (SELECT item_id, generate_subscripts(ps, 1) AS i, string_split(trim(unnest(ps), E' \\n'), chr(10)) AS b FROM pieces)"""


@query(f"""{BLOCKS} SELECT item_id, trim(string_split(b[1], ':')[-1]) AS type, trim(string_split(b[2], ':')[-1]) AS question, trim(string_split(b[3], ':')[-1]) AS answer FROM lines WHERE len(b) = 3""")
def parse_qa_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = responses(spark, sf).select("item_id", F.explode(X.qa_blocks(F.col("response"))).alias("b"))
    return rows.select("item_id", "b.type", "b.question", "b.answer")


@query(f"""WITH {RESPONSES}, p AS (SELECT item_id, string_split(response, chr(10) || chr(10)) AS b FROM responses)
SELECT item_id, trim(string_split(b[1], ':')[-1]) AS question, trim(string_split(b[2], ':')[-1]) AS answer FROM p WHERE len(b) = 2""")
def parse_qa_pair(spark: SparkSession, sf: str) -> DataFrame:
    rows = responses(spark, sf).select("item_id", X.qa_pair(F.col("response")).alias("b")).filter("b is not null")
    return rows.select("item_id", "b.question", "b.answer")


@query(f"""WITH {RESPONSES}, s AS (SELECT item_id, trim(string_split(response, 'Summary:')[-1]) AS summary FROM responses) SELECT * FROM s WHERE length(summary) > 5""")
def parse_summary(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("item_id", X.summary(F.col("response")).alias("summary")).filter("summary is not null")


@query(f"""WITH {RESPONSES} SELECT item_id, array_to_string(regexp_extract_all(response, '<answer>(.*?)</answer>', 1), '; ') AS strict, array_to_string([trim(x, E' \\n') FOR x IN regexp_extract_all(response, '(?is)<answer>(.*?)</answer>', 1)], '; ') AS loose FROM responses""")
def response_answers(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("response")
    return responses(spark, sf).select("item_id", X.tag_contents(r, "answer").alias("strict"), F.array_join(X.tag_list(r, "answer"), "; ").alias("loose"))


@query("SELECT item_id, CASE WHEN text LIKE '%.' THEN text ELSE text || '.' END AS text FROM benchmark")
def end_token(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", X.append_end(F.col("text"), ".").alias("text"))


@query(f"""WITH {QA_PAIRS} SELECT id, ['{"', '".join(SYSTEM_PROMPTS)}'][{_hex8("md5('1:chat:' || id)")} % 3 + 1] AS system, question AS "user", prediction AS assistant FROM qa_pairs""")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    key = S.hash_key(1, "chat", F.col("id"))
    m = qa_pairs(spark, sf).select("id", T.chat_message(SYSTEM_PROMPTS, key, F.col("question"), F.col("prediction")).alias("m"))
    return m.select("id", *[F.col("m")[i]["content"].alias(n) for i, n in enumerate(("system", "user", "assistant"))])


_PROMPT = "'Given the context graph titled ' || {0} || ', please answer the following question: ' || {1} || ' Response in the following format:<answer>[answer]</answer>'"


@query(f"WITH {QA_PAIRS} SELECT id, {_PROMPT.format('graph', 'question')} AS prompt FROM qa_pairs")
def closed_book_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return qa_pairs(spark, sf).select("id", T.eval_question(F.col("graph"), F.col("question")).alias("prompt"))


@query(f"""WITH {QA_PAIRS} SELECT id AS question_id, {_PROMPT.format('graph', 'question')} AS prompt, '<answer>' || prediction || '</answer>' || '<eos>' AS target FROM qa_pairs WHERE pos % 2 = 0""")
def recurrent_samples(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("pos") % 2 == 0, "train").otherwise("test")
    q = qa_pairs(spark, sf).select(F.col("id").alias("question_id"), F.col("graph").alias("graph_id"), "question", F.col("prediction").alias("answer"), split.alias("split"))
    return T.recurrent_samples(q, "<eos>")


_SEQUENCE = "'<graph>' || string_agg('<node>' || src || '</node><rel>' || rel || '</rel><node>' || dst || '</node>' || chr(10), '' ORDER BY edge_id) || '</graph>'"


@query(f"""WITH {KG_MULTI}, {CLEAN}, g AS (SELECT graph_id, {_SEQUENCE} AS s FROM clean GROUP BY graph_id)
SELECT o_orderkey AS question_id, 'This is the graph contains relevant context that can answer the question: ' || coalesce(s, '') || chr(10) || {_PROMPT.format('(o_orderkey % 997)', "('What is in order ' || o_orderkey || '?')")} AS prompt FROM orders LEFT JOIN g ON graph_id = o_orderkey % 997""")
def graph_prompt(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    q = table(spark, sf, "orders").select((key % 997).alias("graph_id"), key.alias("question_id"), F.concat(F.lit("What is in order "), key.cast("string"), F.lit("?")).alias("question"))
    return T.graph_prompts(q, G.clean_edges(kg_multi(spark, sf)))


@query(f"""WITH {KG_SMALL}, n AS (SELECT c_custkey AS q, 'C' || c_custkey AS node FROM customer UNION ALL SELECT c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT c_custkey, 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT a.q, idx AS edge_id, src, rel, dst FROM kg_small JOIN n a ON a.node = src JOIN n b ON b.q = a.q AND b.node = dst), g AS (SELECT q, {_SEQUENCE} AS s FROM e GROUP BY q)
SELECT c_custkey AS question_id, 'This is the graph contains relevant context that can answer the question: ' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE s END || chr(10) || {_PROMPT.format("'kg'", "'Where?'")} AS prompt FROM customer LEFT JOIN g ON q = c_custkey""")
def subgraph_prompt(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    roots = F.when(key % 4 != 0, F.array(F.concat(F.lit("C"), key.cast("string"))))
    q = table(spark, sf, "customer").select(F.lit("kg").alias("graph_id"), key.alias("question_id"), F.lit("Where?").alias("question"), roots.alias("roots"))
    return T.subgraph_prompts(q, kg_small(spark, sf).withColumnRenamed("idx", "edge_id"))


@query(f"""WITH {KG_SMALL}, o AS (SELECT c_custkey AS q, 'C' || c_custkey AS c, 'N' || c_nationkey AS n, 'R' || n_regionkey AS r, c_custkey AS i, c_nationkey AS j FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT q AS question_id, 'This is the graph contains relevant context that can answer the question: <graph><node>ID: 0. ' || c || '</node>' || chr(10) || '<node>ID: 1. ' || n || '</node>' || chr(10) || '<node>ID: 2. ' || r || '</node>' || chr(10) ||
  '<rel>Node 0 and node 1 has relation lives_in</rel>' || chr(10) || '<rel>Node 1 and node 2 has relation part_of</rel>' || chr(10) || '</graph>' || chr(10) || {_PROMPT.format("'kg'", "'Where?'")} AS prompt FROM o""")
def indexed_subgraph_prompt(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    q = table(spark, sf, "customer").select(F.lit("kg").alias("graph_id"), key.alias("question_id"), F.lit("Where?").alias("question"), F.array(F.concat(F.lit("C"), key.cast("string"))).alias("roots"))
    return T.eval_prompts("standard", q, kg_small(spark, sf).withColumnRenamed("idx", "edge_id"), subgraph=True, indexed=True)


@query(f"WITH {QA_PAIRS} SELECT id AS question_id, {_PROMPT.format('graph', 'question')} AS prompt FROM qa_pairs")
def adapter_prompt(spark: SparkSession, sf: str) -> DataFrame:
    q = qa_pairs(spark, sf).select(F.col("id").alias("question_id"), F.col("graph").alias("graph_id"), "question")
    return T.eval_prompts("adapter", q, kg_multi(spark, sf))


_JUDGE_HEAD = """Decide whether a model''s answer matches one of the true answers. An answer that includes a true one, or says the same in other words, matches. Reply with yes or no, without quotes.

--Example 1--
Question: What is in the box?
Candidate answer: a pizza slice.
Ground truth: [pizza, pizza slice]
Evaluation: yes

--Example 2--
Question: On which side of the image are the chairs?
Candidate answer: The chairs are on the left side of the image.
Ground truth: [right]
Evaluation: no

--Example 3--
Question: Who is wearing the hat?
Candidate answer: the guy at coordinate (410, 163)
Ground truth: [guy]
Evaluation: yes

--Real task--
Question: """


@query(f"""WITH {QA_PAIRS} SELECT id, '{_JUDGE_HEAD}' || question || chr(10) || 'Candidate answer: ' || prediction || chr(10) || 'Ground truth: [' || array_to_string(targets, ', ') || ']' || chr(10) || 'Evaluation: ' AS prompt FROM qa_pairs""")
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return qa_pairs(spark, sf).select("id", I.judge_prompt(F.col("question"), F.col("prediction"), F.col("targets")).alias("prompt"))


@query("SELECT round(avg(len([t FOR t IN regexp_split_to_array(text, '[\\s ]+') IF t <> ''])), 9) AS avg_tokens FROM conversations")
def average_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return T.average_tokens(table(spark, sf, "conversations"), "text").withColumn("avg_tokens", F.round("avg_tokens", 9))


#: Prompts are conversation turns; the cache holds those of users, in one to three versions.
CACHE = """prompts AS (SELECT conv_id * 100 + turn AS index, text AS prompt, sha256(text) AS prompt_sha256 FROM conversations WHERE text IS NOT NULL),
cache AS (SELECT conv_id * 100 + turn AS index, sha256(text) AS prompt_sha256, unnest(range(1 + length(text) % 3)) AS pos, 'r' || unnest(range(1 + length(text) % 3)) AS response FROM conversations WHERE text IS NOT NULL AND role = 'user'),
latest AS (SELECT index, prompt_sha256, arg_max(response, pos) AS response FROM cache GROUP BY index, prompt_sha256)"""


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "conversations").filter("text is not null")
    prompt = [(F.col("conv_id") * 100 + F.col("turn")).alias("index"), F.col("text").alias("prompt")]
    versions = F.sequence(F.lit(0).cast("long"), (F.length("prompt") % 3).cast("long"))
    cache = I.with_prompt_hash(c.filter("role = 'user'").select(*prompt)).withColumn("pos", F.explode(versions))
    return c.select(*prompt), cache.select("index", "prompt_sha256", "pos", F.concat(F.lit("r"), F.col("pos").cast("string")).alias("response"))


@query(f"WITH {CACHE} SELECT p.index, p.prompt_sha256, p.prompt, response FROM prompts p JOIN latest l ON l.index = p.index AND l.prompt_sha256 = p.prompt_sha256")
def prompt_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    return I.cache_hits(*_cache(spark, sf))


@query(f"WITH {CACHE} SELECT p.index, p.prompt_sha256, p.prompt FROM prompts p WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.index = p.index AND l.prompt_sha256 = p.prompt_sha256)")
def prompt_cache_missing(spark: SparkSession, sf: str) -> DataFrame:
    return I.cache_missing(*_cache(spark, sf))


@query(f"""WITH {CACHE} SELECT p.index, p.prompt_sha256, p.prompt, coalesce(response, 'Answer: ' || p.prompt) AS response, NULL::VARCHAR AS error FROM prompts p LEFT JOIN latest l ON l.index = p.index AND l.prompt_sha256 = p.prompt_sha256""")
def infer_cached(spark: SparkSession, sf: str) -> DataFrame:
    return I.infer_cached(*_cache(spark, sf), I.backend("echo-1"))


@query(f"""WITH {CACHE} SELECT p.index, p.prompt_sha256, p.prompt, 'Answer: ' || p.prompt AS response FROM prompts p""")
def infer_with_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the prompts are answered and written to the cache, then all."""
    prompts, _ = _cache(spark, sf)
    path = f"{Scratch(spark, 'prompt-cache').base}/cache.jsonl"
    I.infer_with_cache(prompts.filter("index % 2 = 0"), path, I.backend("echo-1")).count()
    return I.infer_with_cache(prompts, path, I.backend("echo-1")).drop("error", "pos")


@query("""WITH j AS (SELECT CASE event_type WHEN 'click' THEN ' Yes.' WHEN 'view' THEN 'the yes!' ELSE 'no' END AS response, event_type FROM events)
SELECT round(avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END), 9) AS llm FROM j""")
def judged_share(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    r = F.when(kind == "click", " Yes.").when(kind == "view", "the yes!").otherwise("no")
    return I.judged_share(table(spark, sf, "events").select(r.alias("response"))).withColumn("llm", F.round("llm", 9))


def _busy(prompts: list[str]):
    """Answers one by one until a batch comes to a prompt that it is asked to send alone."""
    for p in prompts:
        if len(prompts) > 1 and len(p) % 7 == 0:
            raise I.RateLimited("429")
        yield f"Answer: {p}"


@query("SELECT item_id, text AS prompt, 'Answer: ' || text AS response, NULL::VARCHAR AS error FROM benchmark WHERE text IS NOT NULL")
def infer_retries(spark: SparkSession, sf: str) -> DataFrame:
    """A back end that breaks off most batches: what it gave counts, the rest is asked again."""
    prompts = table(spark, sf, "benchmark").filter("text IS NOT NULL").select("item_id", F.col("text").alias("prompt"))
    return I.infer(prompts, "prompt", _busy, first_wait=0.001)


@query("SELECT item_id, round(length(text) / sqrt(length(text) * length(text) + 144), 9) AS x, round(12 / sqrt(length(text) * length(text) + 144), 9) AS y FROM benchmark WHERE text IS NOT NULL")
def encoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors of a text's length and a constant."""
    texts = table(spark, sf, "benchmark").filter("text IS NOT NULL")
    v = I.encode(texts, "text", lambda some: [[float(len(t)), 12.0] for t in some])
    return v.select("item_id", F.round(F.col("vector")[0], 9).alias("x"), F.round(F.col("vector")[1], 9).alias("y"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('7:fixed:' || c_custkey), c_custkey LIMIT 25")
def fixed_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample whose size is checked."""
    return S.sample_exactly(table(spark, sf, "customer").select("c_custkey", "c_name"), 7, "fixed", ["c_custkey"], 25)


@query("SELECT c_custkey::VARCHAR AS value FROM customer")
def fallback_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of the validation file, where the training file isn't there."""
    base = Scratch(spark, "reference").base
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("value")).write.text(f"{base}/val.txt")
    return spark.read.text(O.reference_file(spark, f"{base}/train.txt", f"{base}/val.txt"))


@query("""WITH c AS (SELECT event_type, count(*) FILTER (value > 50) AS wanted, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, n FROM c WHERE wanted > 0""")
def active_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of events with a positive number of wanted ones."""
    e = table(spark, sf, "events")
    counts = {r.event_type: r.n for r in e.groupBy("event_type").agg(F.count(F.when(F.col("value") > 50, 1)).alias("n")).collect()}
    return e.filter(F.col("event_type").isin(T.active_tasks(counts, 1))).groupBy("event_type").agg(F.count("*").alias("n"))
