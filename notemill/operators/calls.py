"""Calls to a language model: spacing, rotation and breaking computed from logs (WIN-3 to WIN-5), and a pluggable provider (EXT-1 to EXT-8)."""

from __future__ import annotations

import hashlib
import json
import math
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions import text as texts
from notemill.functions.text import error_kind, kind_of_error
from notemill.operators.chunk import chunked_parts
from notemill.operators.ranks import SALTS, numbered, running

for module in (sys.modules[__name__], texts):
    cloudpickle.register_pickle_by_value(module)  # workers needn't have this package

# Retries, waits, limits and shares.
BREAK_AFTER, JSON_ATTEMPTS = 3, 3
RATE_LIMIT_WAIT_S, OVERLOAD_WAIT_S = 65.0, 8.0
CHUNK_FROM, CHUNK_TO = 0.8, 0.6
CHARS_PER_TOKEN = 4
CODES = {"rate_limit": 429, "overload": 503}


def until_break(calls: DataFrame, key: str, order: str, keep: Callable[[DataFrame], DataFrame], limited: str = "rate_limit", success: str = "success", after: int = BREAK_AFTER) -> DataFrame:
    """WIN-3: the calls (key, order, outcome) up to the one that breaks the run: so many rate limits without a success between them; other errors don't count. Adds stopped.

    How many limits came since the last success is how many came at all, less how many had come then: a running sum and a running maximum over ranges (see ranks.running), so a key may have any number of calls.
    """
    hit = (F.col("outcome") == limited).cast("long")
    rows = running(calls.withColumn("__hit", hit), [key], [order], keep, {"__hits": ("sum", "__hit")})
    rows = rows.withColumn("__then", F.when(F.col("outcome") == success, F.col("__hits")))
    rows = running(rows, [key], [order], keep, {"__since": ("max", "__then")})
    stop = rows.where(F.col("__hits") - F.coalesce("__since", F.lit(0)) >= after).groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__stop"))
    salted = rows.drop("__hit", "__hits", "__then", "__since").withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(SALTS)).cast("int"))
    stop = stop.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = salted.join(stop, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__salt") == F.col("__s")), "left")
    return both.where(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).withColumn("stopped", F.col("__stop").isNotNull()).drop("__k", "__s", "__salt", "__stop")


def spaced(calls: DataFrame, key: str, arrival: str, delay: int, ties: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """WIN-4: calls with start: no earlier than arrival, and delay after the start before it. The recursion has a closed form, a running maximum, and is worked out over ranges."""
    rows = numbered(calls, [key], [arrival, ties], keep, "__i").withColumn("__early", F.col(arrival) - F.col("__i") * delay)
    rows = running(rows, [key], [arrival, ties], keep, {"__latest": ("max", "__early")})
    return rows.withColumn("start", F.col("__i") * delay + F.col("__latest")).drop("__i", "__early", "__latest")


def rotated(calls: DataFrame, key: str, order: str, n_keys: int, keep: Callable[[DataFrame], DataFrame], limited: str = "rate_limit") -> DataFrame:
    """WIN-5: calls with key_index: how many rate limits came before, modulo the keys."""
    rows = running(calls.withColumn("__hit", (F.col("outcome") == limited).cast("long")), [key], [order], keep, {"__hits": ("sum", "__hit")})
    return rows.withColumn("key_index", F.pmod(F.col("__hits") - F.col("__hit"), F.lit(n_keys)).cast("int")).drop("__hit", "__hits")


class Provider(Protocol):
    """EXT-1: what a language model must offer."""

    max_input_tokens: int

    def estimate_tokens(self, text: str) -> int: ...

    def generate_text(self, prompt: str, system: str = "") -> str: ...

    def generate_multimodal(self, prompt: str, images: list[bytes], system: str = "") -> str: ...


class CallFailed(RuntimeError):
    """A call that the provider didn't answer; kind says why, else its message does."""

    kind: str | None = None


class RateLimited(CallFailed):
    """The provider refuses for now."""

    kind = "rate_limit"


class Overloaded(CallFailed):
    """The provider fails for now."""

    kind = "overload"


#: What becomes an error in a row: a failed call, an unreachable provider, an answer that isn't valid. Other exceptions are errors of the code and fail the task.
DATA_ERRORS = (OSError, ValueError, RuntimeError)


def kind_of(error: Exception) -> str:
    """rate_limit, overload, fatal or other."""
    return getattr(error, "kind", None) or kind_of_error(str(error))


@dataclass(frozen=True)
class OfflineProvider:
    """EXT-3: deterministic, without a network: the first words of the prompt and a digest of all of it."""

    max_input_tokens: int = 8192
    words: int = 24

    def estimate_tokens(self, text: str) -> int:
        return -(-len(text) // CHARS_PER_TOKEN)

    def generate_text(self, prompt: str, system: str = "") -> str:
        digest = hashlib.sha1(f"{system}\0{prompt}".encode()).hexdigest()[:8]
        return f"{' '.join(prompt.split()[: self.words])} #{digest}"

    def generate_multimodal(self, prompt: str, images: list[bytes], system: str = "") -> str:
        return self.generate_text(prompt + "".join(hashlib.sha1(i).hexdigest()[:8] for i in images), system)


PROVIDERS: dict[str, Callable[[], Provider]] = {"offline": OfflineProvider}


def provider(name: str) -> Provider:
    """EXT-2: a provider by name."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return PROVIDERS[name]()


def generate_json(model: Provider, prompt: str, validate: Callable[[Any], Any], attempts: int = JSON_ATTEMPTS) -> Any:
    """EXT-4: a validated answer; an answer that can't be parsed or isn't valid is asked for again, a failing call isn't."""
    last: Exception | None = None
    for _ in range(attempts):
        answer = model.generate_text(prompt)
        try:
            return validate(json.loads(answer.replace("```json", "").replace("```", "").strip()))
        except (ValueError, TypeError, KeyError) as e:
            last = e
    raise ValueError("no valid answer") from last


def with_retry(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
    """EXT-5: one more try after a wait that fits the error."""
    try:
        return call()
    except DATA_ERRORS as e:
        waits = {"rate_limit": RATE_LIMIT_WAIT_S, "overload": OVERLOAD_WAIT_S}
        if kind_of(e) not in waits:
            raise
        sleep(waits[kind_of(e)])
    return call()


@dataclass
class RotatingKeys:
    """EXT-6: calls with one key after the other when refused, each once a call, and a delay between the calls of a key."""

    keys: list[str]
    delay_s: float = 4.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    at: int = 0
    last: dict[str, float] = field(default_factory=dict)

    def call(self, ask: Callable[[str], str]) -> str:
        for turn in range(len(self.keys)):
            key = self.keys[self.at]
            wait = self.last.get(key, -math.inf) + self.delay_s - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last[key] = self.clock()
            try:
                return ask(key)
            except DATA_ERRORS as e:
                if kind_of(e) != "rate_limit" or turn == len(self.keys) - 1:
                    raise
                self.at = (self.at + 1) % len(self.keys)
        raise RateLimited


@dataclass
class Breaker:
    """WIN-3 while calls are made: one deck's calls stop at so many refusals without a success between them; other errors don't count."""

    after: int = BREAK_AFTER
    deck: Any = None
    refusals: int = 0

    def open_for(self, deck: Any) -> bool:
        """Whether a call for deck may be made; a deck's calls come one after the other."""
        if deck != self.deck:
            self.deck, self.refusals = deck, 0
        return self.refusals < self.after

    def saw(self, outcome: str) -> None:
        self.refusals = 0 if outcome == "success" else self.refusals + (outcome == "rate_limit")


def lane_of(df: DataFrame, by: Sequence[str], lanes: int) -> DataFrame:
    """df dealt to so many partitions, rows of one value of by to one of them; the partition's number is in lane."""
    return df.withColumn("lane", F.pmod(F.xxhash64(*by), F.lit(lanes)).cast("int")).repartitionById(lanes, F.col("lane"))


def generated(
    prompts: DataFrame,
    model: Provider | Callable[[str], Provider],
    id_cols: list[str],
    prompt_col: str = "prompt",
    images_col: str | None = None,
    validate: Callable[[Any], Any] | None = None,
    keys: Sequence[str] = (),
    delay_s: float = 4.0,
    lanes: int | None = None,
    in_order: tuple[str, str] | None = None,
    after: int = BREAK_AFTER,
    sleep: Callable[[float], None] = time.sleep,
    stamps: bool = False,
) -> DataFrame:
    """SRC-10, SRC-11: (ids, answer, error, wall_ms): one call for each row, in batches; a failing call is an error in its row and doesn't fail the task, so a retried task repeats few calls.

    images_col is an array of bytes that goes with the prompt. validate makes the answer a checked one, kept as JSON (EXT-4). A refused or overloaded call is tried once more after a wait (EXT-5).

    With keys, model makes a provider from a key (EXT-6). A key belongs to one lane, and a lane is one partition with one clock, so a key's calls are delay_s apart in every plan; a refused call goes on to the lane's next
    key. lanes is how many calls may be made side by side, one for each key where it isn't given; with one lane all keys rotate. Rows are dealt to lanes by the hash of their ids.
    (A task that Spark starts twice, by speculation or after a loss, has a clock of its own.)
    Without a delay nothing has to be kept apart: where lanes isn't given either, rows stay in their partitions and every task rotates all keys, so that no task reads a key's share of the whole input.

    in_order = (deck, slide) makes each deck's calls in one task, in order, and stops a deck's calls at the refusal that breaks it (WIN-3): later slides have no row. A deck is then in one lane.

    stamps adds calls: key and called_at (seconds since the epoch) of each attempt. The result should be written before it is used twice: answers needn't be the same when asked for again.
    """
    types = {c: prompts.schema[c].dataType.simpleString() for c in id_cols}
    images = [images_col] if images_col else []
    names = [*id_cols, "answer", "error", "wall_ms", *(["calls"] if stamps else [])]
    count = max(1, min(lanes or len(keys), len(keys))) if keys and (delay_s > 0 or lanes is not None) else None

    def answer(own: Provider, prompt: str, pictures: list[bytes]) -> str:
        if validate is not None:
            return json.dumps(generate_json(own, prompt, validate), ensure_ascii=False)
        return own.generate_multimodal(prompt, pictures) if pictures else own.generate_text(prompt)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        rotating: dict[int, RotatingKeys] = {}
        breaker = Breaker(after)
        for batch in batches:
            out: list[tuple[Any, ...]] = []
            asked: list[int] = []
            values = lambda c, batch=batch: batch.column(c).to_pylist() if c else [None] * batch.num_rows
            decks, lane = values(in_order and in_order[0]), values(count and "lane")
            for i, (p, pictures) in enumerate(zip(values(prompt_col), values(images_col), strict=True)):
                if in_order and not breaker.open_for(decks[i]):
                    continue
                began, calls = time.monotonic(), []
                shown = [bytes(b) for b in pictures] if pictures is not None else []

                def ask(own: Provider, key: str | None = None, p: Any = p, shown: list[bytes] = shown, calls: list[Any] = calls) -> str:
                    calls.append((key, time.time()))
                    return answer(own, p or "", shown)

                def with_key(key: str, ask: Callable[..., str] = ask) -> str:
                    return ask(model(key), key)

                if keys and lane[i] not in rotating:
                    rotating[lane[i]] = RotatingKeys(list(keys if count is None else keys[lane[i] :: count]), delay_s, sleep=sleep)
                try:
                    text, error = with_retry((lambda r=rotating[lane[i]], f=with_key: r.call(f)) if keys else (lambda f=ask: f(model)), sleep), None
                except DATA_ERRORS as e:
                    text, error, kind = None, str(e) or type(e).__name__, kind_of(e)
                    if kind != kind_of_error(error):  # a message that doesn't say what it is
                        error = f"{CODES.get(kind, kind)} {error}"
                breaker.saw("success" if error is None else kind)
                asked.append(i)
                out.append((text, error, int(1000 * (time.monotonic() - began)), calls))
            columns = [batch.column(c).take(pa.array(asked, pa.int64())) for c in id_cols]
            columns += [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            if stamps:
                columns.append(pa.array([[{"key": k, "called_at": t} for k, t in o[3]] for o in out], pa.list_(pa.struct([("key", pa.string()), ("called_at", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = prompts.select(*id_cols, prompt_col, *images)
    if count:
        rows = lane_of(rows, [in_order[0]] if in_order else id_cols, count)
    elif in_order:
        rows = rows.repartition(in_order[0])
    if in_order:
        rows = rows.sortWithinPartitions(*in_order)
    ddl = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", answer string, error string, wall_ms long" + ", calls array<struct<key: string, called_at: double>>" * stamps
    return rows.mapInArrow(run, ddl)


def slide_run(prompts: DataFrame, model: Provider | Callable[[str], Provider], deck: str = "deck_id", slide: str = "slide_num", keep: Callable[[DataFrame], DataFrame] | None = None, **how: Any) -> tuple[DataFrame, DataFrame]:
    """The run over decks' slides: (slides, totals).

    slides: (deck, slide, answer, error, outcome, wall_ms), up to the call that breaks a deck's run (WIN-3); a deck's calls are made in order by one task, and none is made after that one. totals (AGG-14): (deck, n_slides, errors:
    array of slide and reason, per_slide_wall_time_ms in order, total_wall_time_ms). keep writes the answers and reads them back, so that both results rest on one run; without it each action asks anew.
    """
    said = generated(prompts, model, [deck, slide], in_order=(deck, slide), **how)
    said = keep(said) if keep else said
    said = said.withColumn("outcome", F.when(F.col("error").isNull(), "success").otherwise(error_kind(F.col("error"))))
    slides = said  # what comes after a break was never asked
    in_order = lambda x, on=None: F.transform(F.sort_array(F.collect_list(F.struct(slide, x.alias("x")) if on is None else F.when(on, F.struct(slide, x.alias("x"))))), lambda s: s)
    totals = slides.groupBy(deck).agg(
        F.count("answer").cast("int").alias("n_slides"),
        F.transform(in_order(F.col("error"), F.col("error").isNotNull()), lambda s: F.struct(s[slide].alias("slide_num"), s["x"].alias("reason"))).alias("errors"),
        F.transform(in_order(F.col("wall_ms")), lambda s: s["x"]).alias("per_slide_wall_time_ms"),
        F.sum("wall_ms").alias("total_wall_time_ms"),
    )
    return slides, totals


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Any]:
    """EXT-8: rows, and an observation of how many were made and failed (column error), which is there when an action on rows has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("done"), F.count("error").alias("failed")), seen


def summarized(texts: DataFrame, model: Provider, key: str, text: str = "text", gap: str = "\n\n") -> DataFrame:
    """AGG-13: (key, summary): a text that fills the model's input to 8 tenths is cut to chunks of 6 tenths, which are summarised one by one and then together."""
    from notemill.functions.text import token_estimate
    from notemill.operators.chunk import chunks

    limit = model.max_input_tokens
    rows = texts.select(F.col(key), F.posexplode(F.when(token_estimate(F.col(text)) > int(CHUNK_FROM * limit), chunks(F.col(text), int(CHUNK_TO * limit))).otherwise(F.array(F.col(text)))).alias("chunk", "prompt"))
    parts = generated(rows, model, [key, "chunk"])
    whole = parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "answer"))), lambda x: x["answer"]), gap).alias("prompt"))
    return generated(whole, model, [key]).select(key, F.col("answer").alias("summary"), "error")


def summarized_parts(parts: DataFrame, model: Provider, key: str, order: str, keep: Callable[[DataFrame], DataFrame], text: str = "text", gap: str = "\n\n", levels: int = 8, **how: Any) -> DataFrame:
    """AGG-5, AGG-13: (key, summary, error, n_levels, n_failed) for texts whose parts are rows, however long a text is.

    As long as a key's parts fill the model's input to more than 8 tenths, they are cut to chunks of 6 tenths, which are summarised one by one; the summaries are the parts of the next level. No row holds more than
    an input. n_failed counts the chunks without a summary, which are left out. Levels that don't make a text shorter end in an error.
    """
    limit = model.max_input_tokens
    rows = parts.select(F.col(key).alias("key"), F.col(order).cast("long").alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = keep(rows.groupBy("key").agg(F.lit(0).alias("n_levels"), F.lit(0).cast("long").alias("n_failed")))
    for _ in range(levels):
        n = F.greatest(F.count_if(F.col("text") != "") - 1, F.lit(0))
        sizes = keep(rows.groupBy("key").agg((F.ceil((F.sum(F.length("text")) + F.lit(len(gap)) * n) / CHARS_PER_TOKEN) > int(CHUNK_FROM * limit)).alias("long")).where("long").select(F.col("key").alias("k")))
        if sizes.limit(1).count() == 0:
            break
        mine = F.col("key").eqNullSafe(F.col("k"))
        cut = chunked_parts(rows.join(sizes, mine, "left_semi"), "key", "ord", "text", int(CHUNK_TO * limit), keep, gap=gap)
        said = keep(generated(cut.withColumnRenamed("text", "prompt"), model, ["key", "chunk"], **how))
        failed = said.groupBy("key").agg(F.count("error").alias("f")).select(F.col("key").alias("k"), "f")
        counts = keep(counts.join(failed, mine, "left").select("key", (F.col("n_levels") + F.col("f").isNotNull().cast("int")).alias("n_levels"), (F.col("n_failed") + F.coalesce("f", F.lit(0))).alias("n_failed")))
        rows = keep(rows.join(sizes, mine, "left_anti").unionByName(said.where("error IS NULL").select("key", F.col("chunk").alias("ord"), F.col("answer").alias("text"))))
    else:
        raise ValueError(f"texts are still too long after {levels} levels of summaries")
    whole = rows.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.nullif(x["text"], F.lit(""))), gap).alias("prompt"))
    answers = generated(whole, model, ["key"], **how).select(F.col("key").alias("k"), "answer", "error")
    return counts.join(answers, F.col("key").eqNullSafe(F.col("k")), "left").select(F.col("key").alias(key), F.col("answer").alias("summary"), "error", "n_levels", "n_failed")
