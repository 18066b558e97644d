import json

import pytest

from graphloom.operators import infer as I
from graphloom.operators import orchestrate as O
from graphloom.operators import tasks as T


def prompts(spark, n=6):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "index long, prompt string")


def test_passing_errors_are_tried_again(spark):
    seen = {}

    def model(asked):
        if len(asked) > 1:
            raise ConnectionError("busy")
        seen[asked[0]] = seen.get(asked[0], 0) + 1
        if asked[0] == "p1" and seen["p1"] < 3:
            raise TimeoutError("later")
        if asked[0] == "p2":
            raise ValueError("never")
        if asked[0] == "p3":
            raise ConnectionError("always")
        return [f"{asked[0]} x{seen[asked[0]]}"]

    rows = {r.prompt: r for r in I.infer(prompts(spark).coalesce(1), "prompt", model, first_wait=0.001).collect()}
    assert rows["p0"].response == "p0 x1" and rows["p1"].response == "p1 x3"
    assert rows["p2"].error == "ValueError: never" and rows["p2"].response is None and rows["p3"].error == "ConnectionError: always"


def test_a_wrong_number_of_responses_is_an_error(spark):
    rows = I.infer(prompts(spark), "prompt", lambda asked: [], first_wait=0.001).collect()
    assert len(rows) == 6 and all(r.error == "RuntimeError: 0 responses to 1 prompts" for r in rows)


def test_system_prompt_and_histories(spark):
    df = spark.createDataFrame([(0, "q", ["a", "b"])], "index long, prompt string, turns array<string>")
    model = lambda asked, system, histories: [f"{system}|{h}|{p}" for p, h in zip(asked, histories)]
    assert I.infer(df, "prompt", model, system="S", histories="turns").first().response == "S|['a', 'b']|q"
    assert I.infer(df, "prompt", I.backend("echo"), system="S").first().response == "Answer: S q"
    with pytest.raises(ValueError, match="no back end"):
        I.backend("other")


def test_the_cache_is_appended_to(spark, tmp_path):
    path = str(tmp_path / "cache")

    def failing(asked):
        if any(p == "p4" for p in asked):
            raise ValueError("no")
        return [f"one {p}" for p in asked]

    first = {r.prompt: r for r in I.infer_with_cache(prompts(spark, 5), path, failing).collect()}
    assert first["p4"].error and first["p0"].response == "one p0"
    (tmp_path / "cache" / "part-x.json").write_text("no json\n" + json.dumps({"index": 1}) + "\n")
    second = {r.prompt: r.response for r in I.infer_with_cache(prompts(spark), path, lambda asked: [f"two {p}" for p in asked]).collect()}
    assert second == {"p0": "one p0", "p1": "one p1", "p2": "one p2", "p3": "one p3", "p4": "two p4", "p5": "two p5"}


def test_only_what_failed_is_asked_again(spark, tmp_path):
    """A batch that gives some responses and then breaks off; every request is noted in a file."""
    notes = str(tmp_path / "notes")

    def model(asked):
        with open(notes, "a") as f:
            f.write("|".join(asked) + "\n")
        for p in asked:
            if p == "p4" and len(asked) > 1:
                raise I.RateLimited("429")
            yield f"to {p}"

    rows = I.infer(prompts(spark).coalesce(1), "prompt", model, first_wait=0.001).collect()
    assert [r.response for r in rows] == [f"to p{i}" for i in range(6)] and not any(r.error for r in rows)
    assert sorted(open(notes).read().split()) == ["p0|p1|p2|p3|p4|p5", "p4", "p5"]


def test_a_server_with_limits(spark):
    """Threads are bounded, order is kept, 429s are tried again, and the pace is kept by all."""
    import threading
    import time

    state = {"now": 0, "most": 0, "n": 0, "times": []}

    def model(asked):
        lock = state.setdefault("lock", threading.Lock())
        with lock:
            state["now"] += 1
            state["n"] += 1
            state["most"] = max(state["most"], state["now"])
            state["times"].append(time.monotonic())
            busy = state["n"] % 3 == 0
        time.sleep(0.01)
        with lock:
            state["now"] -= 1
            n, most, spread = state["n"], state["most"], state["times"][-1] - state["times"][0]
        if busy:
            raise I.RateLimited("429")
        return [f"{asked[0]},{n},{most},{spread}"]

    per_task = 100.0
    rows = I.infer(prompts(spark, 40).coalesce(1), "prompt", model, first_wait=0.001, single=True, threads=4, per_second=per_task * spark.sparkContext.defaultParallelism).collect()
    out = [r.response.split(",") for r in rows]
    assert [o[0] for o in out] == [f"p{i}" for i in range(40)]
    assert max(int(o[2]) for o in out) <= 4 and max(int(o[1]) for o in out) >= 58
    assert max(float(o[3]) for o in out) >= 57 / per_task


def test_deadline(spark):
    import time

    def model(asked):
        time.sleep(0.2)
        return asked

    rows = I.infer(prompts(spark, 20).coalesce(1), "prompt", model, single=True, threads=2, deadline=0.5).collect()
    done = [r.response is not None for r in rows]
    assert 2 <= sum(done) <= 8 and all(r.error == "TimeoutError: deadline" for r in rows if r.response is None)


def test_a_job_that_breaks_off_keeps_its_waves(spark, tmp_path, monkeypatch):
    path, waves = str(tmp_path / "cache"), []
    inner = I.infer

    def breaking(df, *a, **k):
        waves.append(1)
        if len(waves) == 3:
            raise KeyboardInterrupt
        return inner(df, *a, **k)

    monkeypatch.setattr(I, "infer", breaking)
    with pytest.raises(KeyboardInterrupt):
        I.infer_with_cache(prompts(spark, 40), path, lambda asked: [f"one {p}" for p in asked], wave_rows=10)
    kept = {r["index"] for r in spark.read.schema(I.CACHE_SCHEMA).json(path).collect()}
    assert 0 < len(kept) < 40
    monkeypatch.setattr(I, "infer", inner)
    rows = {r["index"]: r.response for r in I.infer_with_cache(prompts(spark, 40), path, lambda asked: [f"two {p}" for p in asked], wave_rows=10).collect()}
    assert rows == {i: f"{'one' if i in kept else 'two'} p{i}" for i in range(40)}


def test_encode(spark):
    v = I.encode(prompts(spark, 2), "prompt", lambda texts: [[3.0, 4.0]] * len(texts)).first().vector
    assert list(v) == [0.6, 0.8]


def test_tasks_modes_and_files(spark, tmp_path):
    assert T.active_tasks({"a": 1, "b": 0}, 1) == ["a"] and T.active_tasks({"a": 1}, 0) == []
    with pytest.raises(ValueError, match="mode"):
        T.eval_prompts("other", None, None)
    (tmp_path / "val.json").write_text("x")
    assert O.reference_file(spark, str(tmp_path / "train.json"), str(tmp_path / "val.json")) == str(tmp_path / "val.json")
    assert O.reference_file(spark, str(tmp_path / "none")) is None
