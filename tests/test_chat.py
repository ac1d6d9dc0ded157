"""The chat seam: failing and slow clients, concurrency, and what is not sent twice."""

import time

from pyspark.sql import functions as F

from lodestone.operators import chat
from lodestone.operators.embed import CallPolicy

MESSAGES = "array<struct<role:string,content:string>>"


def rows(spark, *asked):
    made = [(k, q if q is None else [("system", "s"), ("user", q)], "fixed" if q is None else None) for k, q in enumerate(asked)]
    return spark.createDataFrame(made, f"question_id int, messages {MESSAGES}, answer string").coalesce(1)


def client(path, pause=0.0):
    def connect():
        def answer(messages):
            asked = messages[1]["content"]
            with open(path, "a") as f:
                f.write(asked + "\n")
            time.sleep(pause)
            if "bad" in asked or ("once" in asked and open(path).read().count(asked) == 1):
                raise OSError("no")
            return " " if "blank" in asked else f"to {asked}"

        return answer

    return connect


def test_each_prompt_has_its_own_outcome_and_is_sent_once(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), f"file://{tmp_path}/ledger"
    policy = CallPolicy(attempts=2, pause=0.01)
    given = rows(spark, "a", "bad", "once", None, "a", "blank")
    got = {r["question_id"]: (r["answer"], r["error"]) for r in chat.chat_answers(given, client(log), ledger, policy=policy, batch_requests=2).collect()}
    assert got == {0: ("to a", None), 1: (None, "OSError: no"), 2: ("to once", None), 3: ("fixed", None), 4: ("to a", None), 5: (None, "no text")}
    assert sorted(open(log).read().split()) == ["a", "bad", "bad", "blank", "blank", "once", "once"]
    again = rows(spark, "a", "once", "new", "bad")
    got = {r["question_id"]: r["answer"] for r in chat.chat_answers(again, client(log), ledger, policy=CallPolicy(attempts=1)).collect()}
    assert got == {0: "to a", 1: "to once", 2: "to new", 3: None}
    assert sorted(open(log).read().split()[7:]) == ["bad", "new"]
    other = chat.chat_answers(rows(spark, "a"), client(log), ledger, model="other").collect()
    assert other[0]["answer"] == "to a" and open(log).read().split()[-1] == "a"
    assert chat.chat_answers(given.where(F.lit(False)), client(log), f"file://{tmp_path}/none").collect() == []


def test_calls_of_a_partition_run_side_by_side_and_come_in_order(spark, tmp_path):
    asked = rows(spark, *[f"q{k}" for k in range(16)]).withColumn("request", F.col("question_id").cast("string"))
    chat.called(asked.limit(1), client(str(tmp_path / "warm"))).collect()
    began = time.perf_counter()
    got = chat.called(asked, client(str(tmp_path / "log"), pause=0.5), window=8).collect()
    assert time.perf_counter() - began < 6, "one after the other takes eight seconds"
    assert [r["request"] for r in got] == [str(k) for k in range(16)] and [r["answer"] for r in got] == [f"to q{k}" for k in range(16)]
