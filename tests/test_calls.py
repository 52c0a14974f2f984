"""Runs of calls against providers that refuse and count what they are asked."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from notemill.operators import calls


class Counting:
    """Writes a line (key, time, prompt) for each call, and refuses as the prompt says."""

    max_input_tokens = 100

    def __init__(self, folder, key="-"):
        self.folder, self.key = str(folder), key

    def estimate_tokens(self, text):
        return len(text)

    def generate_text(self, prompt, system=""):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{self.key}\t{time.time()}\t{prompt}")
        if prompt.startswith("refuse"):
            raise RuntimeError("HTTP 429: slow down")
        if prompt.startswith(f"only not {self.key}"):
            raise calls.RateLimited("later")
        if prompt.startswith("busy"):
            raise calls.Overloaded
        if prompt.startswith("gone"):
            raise OSError("404")
        if prompt.startswith("bug"):
            raise TypeError("a mistake in the code")
        return prompt.upper()

    def seen(self):
        return sorted((k, float(t), p) for name in os.listdir(self.folder) for k, t, p in [open(f"{self.folder}/{name}").read().split("\t")])


def no_sleep(seconds):
    pass


def prompts(spark, decks):
    rows = [(d, i, p) for d, ps in decks.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "deck_id string, slide_num int, prompt string").repartition(5)


def test_no_call_after_the_third_refusal(spark, tmp_path):
    decks = {"a": ["ok", "refuse 1", "gone", "refuse 2", "busy", "refuse 3", "never", "never"], "b": ["refuse 1", "refuse 2", "ok", "refuse 3", "refuse 4", "ok"], "c": ["never mind"] * 3}
    slides, totals = calls.slide_run(prompts(spark, decks), Counting(tmp_path), sleep=no_sleep)
    slides = slides.collect()
    asked = [p for _, _, p in Counting(tmp_path).seen()]
    assert "never" not in asked and asked.count("never mind") == 3
    assert [asked.count(p) for p in ("refuse 1", "busy", "gone")] == [4, 2, 1]  # one retry each, none of what is gone
    assert sorted((r.deck_id, r.slide_num, r.outcome) for r in slides if r.deck_id == "a") == [("a", i, o) for i, o in enumerate(["success", "rate_limit", "fatal", "rate_limit", "overload", "rate_limit"])]
    assert sum(r.deck_id == "b" for r in slides) == 6
    got = {r.deck_id: r for r in totals.collect()}
    assert (got["a"].n_slides, [e.slide_num for e in got["a"].errors], len(got["a"].per_slide_wall_time_ms)) == (1, [1, 2, 3, 4, 5], 6)


@pytest.mark.parametrize("after", [1, 2])
def test_a_deck_goes_on_over_batches(spark, tmp_path, after):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        decks = {"a": ["ok", "ok", "ok", "refuse", "refuse", "no", "no"], None: ["ok", "refuse", "refuse", "no"]}
        said = calls.generated(prompts(spark, decks), Counting(tmp_path), ["deck_id", "slide_num"], in_order=("deck_id", "slide_num"), after=after, sleep=no_sleep).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.deck_id or "", r.slide_num) for r in said) == [("", i) for i in range(1 + after)] + [("a", i) for i in range(3 + after)]


@pytest.mark.parametrize("keys,lanes", [(["k1"], None), (["k1", "k2", "k3"], None), (["k1", "k2", "k3"], 1), (["k1", "k2", "k3"], 2)])
def test_calls_of_a_key_keep_their_distance(spark, tmp_path, keys, lanes):
    df = spark.createDataFrame([(i, "p" if i % 5 else "only not k1") for i in range(12)], "id int, prompt string").repartition(4)
    model = lambda key: Counting(tmp_path, key)
    said = calls.generated(df, model, ["id"], keys=keys, delay_s=0.15, lanes=lanes, sleep=time.sleep if len(keys) > 1 and lanes == 1 else no_long_sleep, stamps=True)
    rows = said.filter("wall_ms >= 0").coalesce(1).orderBy("id").collect()  # whatever follows
    assert len(rows) == 12
    seen = Counting(tmp_path).seen()
    assert {k for k, _, _ in seen} <= set(keys)
    for key in keys:
        times = [t for k, t, _ in seen if k == key]
        assert all(b - a > 0.145 for a, b in zip(times, times[1:], strict=False))
    if lanes == 1:  # what one key refuses another answers
        assert all(r.answer for r in rows)
    assert sorted((c.key, c.called_at) for r in rows for c in r.calls) == sorted((c.key, c.called_at) for r in rows for c in r.calls if c.key in keys)


def no_long_sleep(seconds):
    time.sleep(min(seconds, 0.2))


def test_keys_with_decks_and_errors_of_the_code(spark, tmp_path):
    decks = {f"d{k}": ["ok", "refuse", "refuse", "refuse", "never"] for k in range(4)}
    said = calls.slide_run(prompts(spark, decks), lambda key: Counting(tmp_path, key), keys=["k1", "k2"], delay_s=0.0, sleep=no_sleep)[0].collect()
    assert len(said) == 16 and "never" not in {p for _, _, p in Counting(tmp_path).seen()}
    with pytest.raises(Exception, match="a mistake in the code"):
        calls.generated(prompts(spark, {"x": ["bug"]}), Counting(tmp_path), ["deck_id"]).collect()


def test_keep_makes_one_run(spark, tmp_path):
    (tmp_path / "calls").mkdir()

    def keep(df):
        df.write.parquet(str(tmp_path / "said"))
        return spark.read.parquet(str(tmp_path / "said"))

    slides, totals = calls.slide_run(prompts(spark, {"a": ["x", "y"]}), Counting(tmp_path / "calls"), keep=keep)
    assert slides.count() == 2 and totals.select(F.sum("n_slides")).first()[0] == 2
    assert len(Counting(tmp_path / "calls").seen()) == 2


def test_keys_without_a_delay_need_no_lanes(spark, tmp_path):
    df = spark.createDataFrame([(i, "p" if i % 5 else "only not k1") for i in range(40)], "id int, prompt string").repartition(8)
    made = lambda **how: calls.generated(df, lambda key: Counting(tmp_path, key), ["id"], keys=["k1", "k2"], sleep=no_sleep, **how)
    assert made(delay_s=0.0).rdd.getNumPartitions() == 8 and made(delay_s=0.1).rdd.getNumPartitions() == made(delay_s=0.0, lanes=2).rdd.getNumPartitions() == 2
    rows = made(delay_s=0.0).collect()
    assert sorted(r.id for r in rows) == list(range(40)) and all(r.answer for r in rows)
