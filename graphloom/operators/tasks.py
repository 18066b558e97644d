"""Training texts, prompts and retrieval contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.graph import edge_sequence, indexed_sequence, qa_subgraph
from graphloom.operators.paths import khop_subgraph
from graphloom.operators.sample import hash_key, sample_rows, sample_weighted_replace

# Wordings of samples and prompts.
NODE_CONTEXT = "In context graph %s, there is a node %s."
EDGE_CONTEXT = "In context graph %s, the node %s is %s the node %s."
EDGE_PHRASE = "the %s is %s the %s; "
QUESTION = "Given the context graph titled %s, please answer the following question: %s Response in the following format:<answer>[answer]</answer>"
CONTEXT = "This is the graph contains relevant context that can answer the question: %s"
SUBGRAPH_HEAD = "The root node is %s. The subgraph including edges: "
SUBGRAPH_PHRASE = "the source node %s is %s the target node %s; "
LINK_QUESTION = "what is the relation between %s and %s?"
SOURCE_QUESTION = "which entity has the relation %s to %s?"
TARGET_QUESTION = "Which entity has the relation %s from %s?"
SHOTS = 8
CONTEXT_EDGES, PROMPT_KINDS = 6, ("global", "multihop", "binary", "kshot")


def context_samples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, kind, sample_id, text`` of node and edge sentences, repeated ``copies`` times."""
    node_text = F.format_string(NODE_CONTEXT, F.col("graph_id").cast("string"), "node")
    edge_text = F.format_string(EDGE_CONTEXT, F.col("graph_id").cast("string"), "src", "rel", "dst")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    a = nodes.select("graph_id", F.lit("node").alias("kind"), F.col("node").alias("sample_id"), node_text.alias("text"), copies)
    b = edges.select("graph_id", F.lit("edge").alias("kind"), F.col("edge_id").cast("string").alias("sample_id"), edge_text.alias("text"), copies)
    return a.unionAll(b)


def context_qa(draws: DataFrame, seed: int) -> DataFrame:
    """A question on the relation, source or target of each drawn edge."""
    kind = F.conv(F.substring(hash_key(seed, "kind", F.col("graph_id"), F.col("draw")), 1, 8), 16, 10).cast("long") % 3
    question = F.when(kind == 0, F.format_string(LINK_QUESTION, "src", "dst")).when(kind == 1, F.format_string(SOURCE_QUESTION, "rel", "dst")).otherwise(F.format_string(TARGET_QUESTION, "rel", "src"))
    answer = F.when(kind == 0, F.col("rel")).when(kind == 1, F.col("src")).otherwise(F.col("dst"))
    return draws.select("graph_id", "draw", question.alias("question"), answer.alias("answer"))


def reasoning_contexts(weighted: DataFrame, n: int, seed: int, with_reference: bool = True) -> DataFrame:
    """``graph_id, sample, prompt_kind, context``: phrases of 6 edges drawn by weight with replacement."""
    draws = sample_weighted_replace(weighted, ["graph_id"], ["edge_id", "rel", "dst"], "weight", n * CONTEXT_EDGES, seed, "reason")
    phrase = F.format_string(EDGE_PHRASE, "src", "rel", "dst")
    phrases = F.transform(F.array_sort(F.collect_list(F.struct("draw", phrase.alias("p")))), lambda x: x["p"])
    rows = draws.groupBy("graph_id", F.floor(F.col("draw") / CONTEXT_EDGES).cast("int").alias("sample")).agg(F.array_join(phrases, "").alias("context"))
    kinds = PROMPT_KINDS if with_reference else PROMPT_KINDS[:3]
    kind = F.get(F.array(*map(F.lit, kinds)), F.col("sample") % len(kinds))
    return rows.select("graph_id", "sample", kind.alias("prompt_kind"), "context")


def shot_questions(questions: DataFrame, seed: int, n: int = SHOTS) -> DataFrame:
    """One row: ``n`` sampled ``question`` texts of the reference data, joined by '; '."""
    some = sample_rows(questions.select("question"), seed, "shots", ["question"], n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(hash_key(seed, "shots", F.col("question")).alias("k"), "question"))), lambda x: x["question"])
    return some.agg(F.array_join(ordered, "; ").alias("sample_questions"))


def reasoning_prompts(contexts: DataFrame, shots: DataFrame) -> DataFrame:
    """Adds ``sample_questions`` to the contexts of kind ``kshot``; ``shots`` has one row."""
    joined = contexts.join(F.broadcast(shots))
    return joined.withColumn("sample_questions", F.when(F.col("prompt_kind") == "kshot", F.col("sample_questions")))


def node_contexts(drawn: DataFrame) -> DataFrame:
    """``graph_id, draw, context`` for summaries of drawn nodes ``node``."""
    return drawn.select("graph_id", "draw", F.col("node").alias("context"))


def edge_contexts(drawn: DataFrame) -> DataFrame:
    """``graph_id, draw, context`` for summaries of drawn edges ``src, rel, dst``."""
    return drawn.select("graph_id", "draw", F.format_string(EDGE_PHRASE, "src", "rel", "dst").alias("context"))


def subgraph_contexts(edges: DataFrame, roots: DataFrame, hops: int = 3, cap: int | None = 3, seed: int = 0) -> DataFrame:
    """``query, context`` for summaries of the neighbourhood of one root for each query."""
    sub = khop_subgraph(edges, roots, hops, cap, seed)
    phrase = F.format_string(SUBGRAPH_PHRASE, "src", "rel", "dst")
    phrases = F.transform(F.array_sort(F.collect_list(F.struct("edge_id", phrase.alias("p")))), lambda x: x["p"])
    found = sub.groupBy("query").agg(F.array_join(phrases, "").alias("phrases"))
    head = F.format_string(SUBGRAPH_HEAD, "node")
    return roots.join(found, "query", "left").select("query", F.concat(head, F.coalesce("phrases", F.lit(""))).alias("context"))


def _filled(wording: str, *values: Column) -> Column:
    """A wording with its marks %s filled in; texts of any length are only copied."""
    parts = wording.split("%s")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value, F.lit(part)]
    return F.concat(*out)


def eval_question(title: Column, question: Column) -> Column:
    """Prompt without context."""
    return _filled(QUESTION, title.cast("string"), question)


def with_context(context: Column, prompt: Column) -> Column:
    return F.concat(_filled(CONTEXT, context), F.lit("\n"), prompt)


def graph_text(edges: DataFrame, indexed: bool = False) -> DataFrame:
    """``graph_id, sequence`` in one of the two encodings."""
    return indexed_sequence(edges, qa_subgraph(edges)[1]) if indexed else edge_sequence(edges)


def graph_prompts(questions: DataFrame, edges: DataFrame, indexed: bool = False) -> DataFrame:
    """``question_id, prompt`` with the whole graph as context.

    Prompts are far larger than what is joined to make them, so their number of tasks is given: by the size of the
    joined tables Spark would merge them into one task.
    """
    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = questions.repartition(n, "graph_id").join(graph_text(edges, indexed), "graph_id", "left")
    prompt = with_context(F.coalesce("sequence", F.lit("")), eval_question(F.col("graph_id"), F.col("question")))
    return rows.select("question_id", prompt.alias("prompt"))


def subgraph_prompts(questions: DataFrame, edges: DataFrame, hops: int = 3, cap: int | None = 5, seed: int = 0, indexed: bool = False) -> DataFrame:
    """``question_id, prompt`` with each question's own neighbourhood as context, blank for questions without roots.
    ``questions``: graph_id, question_id, question, roots (array). ``indexed`` chooses the encoding by node numbers."""
    roots = questions.select(F.col("question_id").alias("query"), F.explode("roots").alias("node"))
    sub = khop_subgraph(edges, roots, hops, cap, seed).withColumnRenamed("query", "graph_id")
    rows = questions.join(graph_text(sub, indexed).withColumnRenamed("graph_id", "question_id"), "question_id", "left")
    none = F.coalesce(F.size("roots"), F.lit(0)) < 1
    context = F.when(none, "").otherwise(F.coalesce("sequence", F.lit("<graph></graph>")))
    return rows.select("question_id", with_context(context, eval_question(F.col("graph_id"), F.col("question"))).alias("prompt"))


def closed_book_prompts(questions: DataFrame) -> DataFrame:
    """``question_id, prompt`` without context."""
    return questions.select("question_id", eval_question(F.col("graph_id"), F.col("question")).alias("prompt"))


EVAL_MODES = ("adapter", "standard")


def eval_prompts(mode: str, questions: DataFrame, edges: DataFrame, graph_context: bool | None = None, subgraph: bool = False, indexed: bool = False, seed: int = 0) -> DataFrame:
    """``question_id, prompt`` of an evaluation mode: 'adapter' asks without context unless told otherwise, as the graph is
    in the adapter; 'standard' has the graph, or each question's neighbourhood, in the prompt."""
    if mode not in EVAL_MODES:
        raise ValueError(f"unknown evaluation mode: {mode}")
    if not (graph_context if graph_context is not None else mode == "standard"):
        return closed_book_prompts(questions)
    return subgraph_prompts(questions, edges, seed=seed, indexed=indexed) if subgraph else graph_prompts(questions, edges, indexed)


def chat_message(system_prompts: list[str], key: Column, user: Column, assistant: Column | None = None) -> Column:
    """array of struct(role, content) with the system prompt that the key chooses."""
    pick = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % len(system_prompts)
    turns = [("system", F.get(F.array(*map(F.lit, system_prompts)), pick.cast("int"))), ("user", user)]
    if assistant is not None:
        turns.append(("assistant", assistant))
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def reference_qa(records: DataFrame) -> DataFrame:
    """``graph_id, place, text`` of parallel arrays ``questions`` and ``answers``; of a question that is the JSON of
    [text, [roots]] the text counts."""
    rows = records.select("graph_id", F.posexplode(F.arrays_zip("questions", "answers")).alias("place", "qa"))
    q = F.col("qa.questions")
    text = F.when(q.startswith("["), F.coalesce(F.get_json_object(q, "$[0]"), q)).otherwise(q)
    return rows.select("graph_id", "place", X.qa_text(text, F.col("qa.answers")).alias("text"))


def recurrent_samples(questions: DataFrame, end: str = "") -> DataFrame:
    """``question_id, prompt, target`` of the train split; an error if it is empty."""
    train = questions.filter(F.col("split") == "train")
    if train.isEmpty():
        raise ValueError("the train split is empty")
    target = F.concat(F.lit("<answer>"), "answer", F.lit("</answer>"))
    target = X.append_end(target, end) if end else target
    return train.select("question_id", eval_question(F.col("graph_id"), F.col("question")).alias("prompt"), target.alias("target"))


def average_tokens(df: DataFrame, column: str) -> DataFrame:
    """One row: mean number of white-space tokens."""
    return df.agg(F.coalesce(F.avg(F.size(X.tokens(F.col(column)))), F.lit(0.0)).alias("avg_tokens"))


def active_tasks(counts: dict[str, int], epochs: float) -> list[str]:
    """Names of the tasks to generate: those with a positive count, if any epoch is trained."""
    return [name for name, n in counts.items() if n > 0] if epochs > 0 else []
