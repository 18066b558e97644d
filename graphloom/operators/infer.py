"""Inference hook, prompt cache and judge.

A back end is a function from a batch of prompts, with an optional system prompt and histories, to responses.
"""

from __future__ import annotations

import math
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import normalize_answer
from graphloom.operators.metrics import l2_normalized
from graphloom.plans import Scratch

Model = Callable[..., list[str]]
BACKENDS: dict[str, Callable[[str], Model]] = {}


def register_backend(prefix: str, factory: Callable[[str], Model]) -> None:
    """``factory(model_name)`` serves model names that start with ``prefix``."""
    BACKENDS[prefix] = factory


def backend(model_name: str) -> Model:
    for prefix in sorted(BACKENDS, key=len, reverse=True):
        if model_name.startswith(prefix):
            return BACKENDS[prefix](model_name)
    raise ValueError(f"no back end for {model_name}")


def _echo(prompts: list[str], system: str | None = None, histories: list | None = None) -> list[str]:
    head = f"{system} " if system else ""
    return [f"Answer: {head}{p}" for p in prompts]


register_backend("echo", lambda name: _echo)


class RateLimited(Exception):
    """A back end that asks for fewer requests."""


#: Errors of a back end that may pass; others are a row's error at once.
PASSING_ERRORS = (RateLimited, ConnectionError, TimeoutError)


class Pace:
    """Grants requests of several threads evenly, ``per_second`` of them."""

    def __init__(self, per_second: float):
        self.step, self.next, self.lock = 1.0 / per_second, 0.0, threading.Lock()

    def wait(self, before: float) -> bool:
        """Waits for a turn; False at once if it comes after the time ``before``."""
        with self.lock:
            turn = max(self.next, time.monotonic())
            if turn > before:
                return False
            self.next = turn + self.step
        time.sleep(max(0.0, turn - time.monotonic()))
        return True


def infer(
    prompts: DataFrame, column: str, model: Model, attempts: int = 10, system: str | None = None, histories: str | None = None,
    passing: tuple[type[Exception], ...] = PASSING_ERRORS, first_wait: float = 0.1, longest_wait: float = 10.0, threads: int = 8,
    single: bool = False, per_second: float | None = None, deadline: float | None = None,
) -> DataFrame:
    """Adds ``response`` and ``error`` by batches of ``model(prompts)``.

    A model may give its responses one by one: if it fails, those it gave count, and only the other prompts are asked
    again, each by itself and ``threads`` at a time. With ``single`` all prompts are, from the start. Errors of
    ``passing`` are tried up to ``attempts`` times, after waits that double and vary; what still fails, or fails
    otherwise, has an error and no response. So has a batch with another number of responses than prompts. Rows keep
    their order. ``per_second`` requests are made by all tasks that can run at a time together, and none is begun
    ``deadline`` seconds after its batch: what is left then has an error. ``system`` is a system prompt, ``histories`` a
    column with the turns before; they are passed on only if given.
    """
    share = per_second / prompts.sparkSession.sparkContext.defaultParallelism if per_second else None
    schema = T.StructType([*prompts.schema, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def call(asked: list[str], before: list | None, into: list[str]) -> None:
        """Responses go to ``into`` as they come."""
        extra = ({"system": system} if system is not None else {}) | ({"histories": before} if before is not None else {})
        into.extend(model(asked, **extra))
        if len(into) != len(asked):
            n, into[:] = len(into), []
            raise RuntimeError(f"{n} responses to {len(asked)} prompts")

    def one(prompt: str, before: list | None, pace: Pace | None, end: float) -> tuple[str | None, str | None]:
        error = None
        for k in range(attempts):
            if time.monotonic() > end or (pace and not pace.wait(end)):
                return None, error or "TimeoutError: deadline"
            try:
                out: list[str] = []
                call([prompt], None if before is None else [before], out)
                return out[0], None
            except passing as e:
                error = f"{type(e).__name__}: {e}"
                if k + 1 < attempts:
                    time.sleep(max(0.0, min(min(longest_wait, first_wait * 2**k) * random.uniform(0.5, 1.0), end - time.monotonic())))
            except Exception as e:  # noqa: BLE001  any failure of a back end is a row's error
                return None, f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(share) if share else None
        for b in batches:
            asked = b.column(column).to_pylist()
            before = b.column(histories).to_pylist() if histories else None
            end = time.monotonic() + deadline if deadline is not None else math.inf
            got: list[str] = []
            if not single and (pace is None or pace.wait(end)):
                try:
                    call(asked, before, got)
                except Exception:  # noqa: BLE001  what it gave before counts
                    pass
            out: list = [(r, None) for r in got]
            if len(got) < len(asked):
                left = slice(len(got), None)
                with ThreadPoolExecutor(threads) as pool:
                    out += pool.map(lambda p, h: one(p, h, pace, end), asked[left], before[left] if before else [None] * (len(asked) - len(got)))
            extra = [pa.array([r for r, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "response", "error"])

    return prompts.mapInArrow(run, schema)


def with_prompt_hash(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("prompt_sha256", F.sha2("prompt", 256))


def latest_entries(cache: DataFrame) -> DataFrame:
    """The last entry by ``pos`` for each ``index, prompt_sha256``; entries without a key are skipped."""
    valid = cache.filter(F.col("index").isNotNull() & F.col("prompt_sha256").isNotNull() & F.col("response").isNotNull())
    return valid.groupBy("index", "prompt_sha256").agg(F.max_by("response", "pos").alias("response"))


def cache_hits(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    return with_prompt_hash(prompts).join(latest_entries(cache), ["index", "prompt_sha256"])


def cache_missing(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    return with_prompt_hash(prompts).join(latest_entries(cache), ["index", "prompt_sha256"], "left_anti")


def infer_cached(prompts: DataFrame, cache: DataFrame, model: Model) -> DataFrame:
    """Responses of the cache, and of the model for what it lacks."""
    new = infer(cache_missing(prompts, cache), "prompt", model)
    return cache_hits(prompts, cache).withColumn("error", F.lit(None).cast("string")).unionByName(new)


CACHE_SCHEMA = "index long, prompt_sha256 string, response string, pos long"


#: Prompts that are asked before their responses are appended to the cache.
WAVE_ROWS = 100_000


def infer_with_cache(prompts: DataFrame, path: str, model: Model, wave_rows: int = WAVE_ROWS, **how) -> DataFrame:
    """As ``infer_cached`` with the cache in JSON lines at ``path``, to which new responses are appended in waves of about
    ``wave_rows`` prompts. ``how`` is passed to ``infer``.

    The waves that a job wrote before it broke off are reused by the next one. Lines that aren't entries are skipped.
    ``pos`` is the time of a wave's beginning, so a later wave's or job's entry counts.
    """
    spark = prompts.sparkSession
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = path_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path_)
    read = lambda: spark.read.schema(CACHE_SCHEMA).json(path)
    cache = read() if there else spark.createDataFrame([], CACHE_SCHEMA)
    scratch = Scratch(spark, "answers")
    todo = scratch.save(cache_missing(prompts, cache), "todo")
    waves = max(1, math.ceil(todo.count() / wave_rows))
    todo = scratch.save(todo.withColumn("_wave", F.pmod(F.xxhash64("index", "prompt_sha256"), F.lit(waves)).cast("int")), "waves", ["_wave"])
    failed = None
    for k in range(waves):
        began = time.time_ns()
        asked = infer(todo.filter(F.col("_wave") == k).drop("_wave"), "prompt", model, **how)
        new = scratch.save(asked, f"new-{k}")
        new.filter(F.col("error").isNull()).select("index", "prompt_sha256", "response", F.lit(began).alias("pos")).write.mode("append").json(path)
        wrong = new.filter(F.col("error").isNotNull())
        failed = wrong if failed is None else failed.unionByName(wrong)
    return cache_hits(prompts, read()).withColumn("error", F.lit(None).cast("string")).unionByName(failed)


# The judge's task, in this library's own words.
JUDGE_TASK = (
    "Decide whether a model's answer matches one of the true answers. An answer that includes a true one, or says the same "
    "in other words, matches. Reply with yes or no, without quotes."
)
# The judge's examples and the answer that counts.
JUDGE_EXAMPLES = (
    ("What is in the box?", "a pizza slice.", "[pizza, pizza slice]", "yes"),
    ("On which side of the image are the chairs?", "The chairs are on the left side of the image.", "[right]", "no"),
    ("Who is wearing the hat?", "the guy at coordinate (410, 163)", "[guy]", "yes"),
)


def judge_head() -> str:
    """The judge's prompt up to the question."""
    shown = lambda q, p, t, e: f"Question: {q}\nCandidate answer: {p}\nGround truth: {t}\nEvaluation: {e}"
    examples = [f"--Example {k}--\n{shown(*x)}" for k, x in enumerate(JUDGE_EXAMPLES, 1)]
    return "\n\n".join([JUDGE_TASK, *examples, "--Real task--\nQuestion: "])


def judge_prompt(question: Column, prediction: Column, targets: Column) -> Column:
    """Asks a judge whether ``prediction`` matches one of ``targets``."""
    truth = F.concat(F.lit("["), F.array_join(targets, ", "), F.lit("]"))
    return F.concat(F.lit(judge_head()), question, F.lit("\nCandidate answer: "), prediction, F.lit("\nGround truth: "), truth, F.lit("\nEvaluation: "))


def judge(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``prompt``, ``response`` and ``error`` of a judge to ``question, prediction, targets``."""
    return infer(rows.withColumn("prompt", judge_prompt(F.col("question"), F.col("prediction"), F.col("targets"))), "prompt", model)


def encode(texts: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Adds ``vector``: what ``model`` makes of each batch of texts, scaled to length 1."""
    schema = T.StructType([*texts.schema, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = list(model(b.column(column).to_pylist()))
            if len(vectors) != b.num_rows:
                raise ValueError(f"{len(vectors)} vectors for {b.num_rows} texts")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], [*b.schema.names, "vector"])

    return texts.mapInArrow(run, schema).withColumn("vector", l2_normalized(F.col("vector")))


def judged_share(judgements: DataFrame) -> DataFrame:
    """One row: share of responses that are 'yes' after normalisation."""
    yes = (normalize_answer(F.col("response")) == "yes").cast("double")
    return judgements.agg(F.coalesce(F.avg(yes), F.lit(0.0)).alias("llm"))

