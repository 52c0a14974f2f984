"""Repair of conversation structure by error-correcting Earley parsing (operator 11).

A conversation is well formed if its roles' initials are `(s?(ua)+)?`. The grammar

    S -> nothing | P        P -> u a | s u a | P u a

has productions for errors besides: a row may be deleted before any symbol, a `u` or `a` may be a row of another role (rerole) or no row at all (insert). The chart after each row holds, for
each dotted rule, the least (cost, audit) of the rows read so far, where the audit is the edits' initials in order. All rules begin at the first row (the grammar is recursive on the left), so an item needs no origin,
and predictions are made once. The completed S at the end gives the repair: how many rows are left decides every one's role.

Two audits of the same rows never begin each other once both end in a row's own edit, so an item holds the order number of its audit among those of the chart, the inserts since, and a link to the edit before. That makes the
parse linear in the rows, however long a conversation is.

Python sees two letters for each row (role, fault); texts stay in the JVM, are sorted once by ranges and are joined to the edits by row number. What comes together for one conversation is as long as its audit, which the result
holds anyway; texts of a conversation never come together: its digest is taken from a stream.

Defined results: a null role or text is one space, so a null text is blank and a null role isn't one of the grammar; a null conv_id is a conversation of its own; null turns come first. Rows of equal turn are put in order of role and
then of a hash of both; repeated rows are neighbours, and the later ones are duplicates. Empty texts are blank. An empty table gives no rows. Columns but the four are left behind, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, kept, reachable, sql_crc32, table, to_salts

#: Costs of edits; a truncated row that stays costs TRUNCATED more.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3

#: Rules by name and symbols; lower-case symbols are initials of roles.
RULES = (("S", ""), ("S", "P"), ("P", "ua"), ("P", "sua"), ("P", "Pua"))
_BY_NAME = {name: [r for r, (n, _) in enumerate(RULES) if n == name] for name in "SP"}
_EMPTY = hashlib.sha256(b"").hexdigest()

Item = tuple[int, int]  # rule, symbols read
Weight = tuple[int, int, str, tuple | None]  # cost, order number of the audit up to the last row, inserts since, that audit as (audit before, edits)


def _closed(kernel: dict[Item, Weight]) -> dict[Item, Weight]:
    """kernel with what follows from it without reading a row: completed rules move those that wait for them on, and missing rows are inserted."""
    chart = dict(kernel)
    agenda = list(kernel)
    while agenda:
        item = agenda.pop()
        rule, dot = item
        name, symbols = RULES[rule]
        weight = chart[item]
        if dot == len(symbols):  # complete: all rules begin at the first row, where those that wait cost nothing
            follow = [((r, 1), weight) for r, (_, s) in enumerate(RULES) if s[:1] == name]
        elif symbols[dot] in "ua":  # insert
            follow = [((rule, dot + 1), (weight[0] + INSERT, weight[1], weight[2] + "I", weight[3]))]
        else:
            follow = []
        for to, new in follow:
            if to not in chart or new[:3] < chart[to][:3]:
                chart[to] = new
                agenda.append(to)
    return chart


def _predicted() -> dict[Item, Weight]:
    """The chart before the first row: the start symbol's rules, and those of what their first symbols name."""
    names, wanted = set(), ["S"]
    while wanted:
        name = wanted.pop()
        if name not in names:
            names.add(name)
            wanted += [s[0] for r in _BY_NAME[name] for s in [RULES[r][1]] if s and s[0] in _BY_NAME]
    return _closed({(r, 0): (0, 0, "", None) for name in names for r in _BY_NAME[name]})


_START = _predicted()


def parsed(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; rows has two letters for each row: its role's initial (any but s, u and a is none of the grammar's) and its fault, b and d (has to go), t (truncated) or another.

    Of repairs of equal cost the one whose audit comes first is taken.
    """
    chart = _START
    for at in range(0, len(rows), 2):
        initial, fault = rows[at], rows[at + 1]
        stays = fault not in "bd"
        extra = TRUNCATED if fault == "t" else 0
        kernel: dict[Item, tuple[int, int, str, tuple | None]] = {}

        def offer(item: Item, cost: int, weight: Weight, edit: str, kernel=kernel) -> None:
            new = (cost, weight[1], weight[2] + edit, weight[3])
            if item not in kernel or new[:3] < kernel[item][:3]:
                kernel[item] = new

        for item, weight in chart.items():
            rule, dot = item
            symbols = RULES[rule][1]
            offer(item, weight[0] + DELETE, weight, "D")
            if stays and dot < len(symbols):
                if symbols[dot] == initial:
                    offer((rule, dot + 1), weight[0] + extra, weight, "K")
                if symbols[dot] in "ua":
                    offer((rule, dot + 1), weight[0] + extra + REROLE, weight, "R")
        order = {key: k for k, key in enumerate(sorted({w[1:3] for w in kernel.values()}))}
        chart = _closed({item: (w[0], order[w[1:3]], "", (w[3], w[2])) for item, w in kernel.items()})
    best = min(w[:3] + (w[3],) for item, w in chart.items() if RULES[item[0]][0] == "S" and item[1] == len(RULES[item[0]][1]))
    edits, node = [best[2]], best[3]
    while node is not None:
        node, edit = node
        edits.append(edit)
    return best[0], "".join(reversed(edits))


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, row, same, blank, cut): rows with their number in order, a hash that equal rows of a conversation share, and whether they are blank or don't end as a sentence."""
    spark = rows.sparkSession
    reachable(spark)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    same = F.sha2(F.concat_ws(":", F.coalesce(F.length(F.col("conv_id").cast("string")), F.lit(-1)).cast("string"), F.col("conv_id").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumn("same", F.unhex(same)).withColumn("any", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "role", "same", "any"]  # the last one lets a range end among equal rows
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).drop("any")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return kept(rows.withColumns({"row": F.monotonically_increasing_id(), "blank": blank, "cut": cut}), "conversation-rows")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, row, letters) of what in_order() gives, without texts: the role's initial (- for one that isn't the grammar's) and the first fault: b (blank), d (duplicate), t (truncated) or - for none."""
    again = rows.groupBy("same").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    fault = F.when(F.col("blank"), "b").when(F.col("row") > F.col("first"), "d").when(F.col("cut"), "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv_id", "turn", "row", "same", "blank", "cut", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    return narrow.join(to_salts(again), ["same", "salt"], "left").select("conv_id", "turn", "row", F.concat("initial", fault).alias("letters"))


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): one row per conversation with its faults, cost and audit; and what is left of each: conv_id, place, role, text, edit (K, R or I).

    rows has conv_id, turn, role and text. Faults: gaps (turns missing between the first and the last), blank, duplicate, truncated, illegal (neighbouring initials that aren't su, ua or au).
    """
    texts = in_order(rows)
    rows = kept(faults(texts), "conversation-faults")
    count = lambda fault: F.count_if(F.substring("letters", 2, 1) == fault).alias({"b": "blank", "d": "duplicate", "t": "truncated"}[fault])  # noqa: E731
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1))).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("row", "letters"))).alias("r"), *map(count, "bdt"))
    each = each.select("conv_id", "blank", "duplicate", "truncated", F.array_join(F.col("r.letters"), "").alias("letters"), F.col("r.row").alias("row"))
    out = pa.schema([("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("place", pa.list_(pa.int32())), ("at", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, audits, illegal, places, at = [], [], [], [], []
            for letters, numbers in zip(batch.column("letters"), batch.column("row"), strict=True):
                letters, numbers = letters.as_py(), iter(numbers.as_py())
                cost, audit = parsed(letters)
                initials = letters[::2]
                costs.append(cost)
                audits.append(audit)
                illegal.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)))
                left = iter(range(len(audit)))
                places.append([None if e == "D" else next(left) for e in audit])
                at.append([None if e == "I" else next(numbers) for e in audit])
            made = [pa.array(v, t) for v, t in zip((costs, audits, illegal, places, at), out.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=pa.schema([*batch.schema, *out]))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.schema.fields) + ", cost long, audit string, illegal long, place array<int>, at array<long>"
    each = kept(each.mapInArrow(run, ddl), "conversation-repairs")
    conversations = each.join(turns.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    conversations = conversations.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    left = F.size(F.filter("place", lambda p: p.isNotNull()))
    edits = each.select("conv_id", left.alias("n"), F.explode(F.arrays_zip(F.split("audit", "").alias("edit"), "place", "at")).alias("e")).select("conv_id", "n", "e.*").where("place IS NOT NULL")
    role = F.when((F.col("n") % 2 == 1) & (F.col("place") == 0), "system").when(F.pmod(F.col("place") - F.col("n") % 2, F.lit(2)) == 0, "user").otherwise("assistant")
    made = edits.where("edit = 'I'").select("conv_id", "place", role.alias("role"), F.lit("").alias("text"), "edit")
    stay = edits.where("edit <> 'I'").withColumnRenamed("at", "row").join(texts.select("row", F.col("role").alias("own"), "text"), "row")
    return conversations, stay.select("conv_id", "place", F.when(F.col("edit") == "K", F.col("own")).otherwise(role).alias("role"), "text", "edit").unionByName(made)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows: of `role:text`, joined by newlines in order of place. Rows are read as a sorted stream, so no conversation's texts are held together."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done = []
            for c, place, line in zip(*(batch.column(k) for k in ("conv_id", "place", "line")), strict=True):
                c, line = c.as_py(), line.as_py().encode("utf-8")
                if place.as_py() == 0:  # every conversation begins at place 0
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], schema.types[k]) for k in (0, 1)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)

    lines = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "place", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by the hash of their conversation and turn; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every conversation, damaged and repaired."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    conversations, rows = repaired(damaged(given))
    ids = given.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id")
    same = lambda right: ids.conv_id.eqNullSafe(right)  # noqa: E731
    found = ids.join(conversations.withColumnRenamed("conv_id", "c"), same(F.col("c")), "left").join(digests(rows).withColumnRenamed("conv_id", "d"), same(F.col("d")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))


def _step(state: str, cost: str, edit: str) -> str:
    """A state (ten digits of cost, then the audit) after one more edit; such strings compare as (cost, audit)."""
    return f"lpad((substring({state}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substring({state}, 11) || '{edit}'"


def _read(to: str, initial: str, sources: str) -> str:
    """The best of deleting a row and of reading it as initial from one of the sources."""
    extra = f"(CASE WHEN e.fault = 't' THEN {TRUNCATED} ELSE 0 END)"
    ways = [f"CASE WHEN e.fault NOT IN ('b', 'd') AND e.initial = '{initial}' THEN {_step(f'a.q{q}', extra, 'K')} END" for q in sources]
    ways += [f"CASE WHEN e.fault NOT IN ('b', 'd') THEN {_step(f'a.q{q}', f'{REROLE} + {extra}', 'R')} END" for q in sources if initial != "s"]
    return f"least({', '.join([_step(f'a.q{to}', str(DELETE), 'D'), *ways])})"


#: The same rows by the shortest path over four states (nothing, after s, after u, after a), row by row, each followed by the inserts of u and of a.
OP11_SQL = rf"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM base, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM after),
rows AS (
  SELECT *, substring(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN n > min(n) OVER (PARTITION BY conv_id, role, text) THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '-' END AS fault, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
best AS (
  SELECT conv_id, least(f.q0, f.q3) AS best FROM (SELECT conv_id, list_reduce(list({{'fault': fault, 'initial': initial, 'step': step}} ORDER BY n, step), lambda a, e: CASE e.step
      WHEN 0 THEN {{'q0': {_step("a.q0", str(DELETE), "D")}, 'q1': {_read("1", "s", "0")}, 'q2': {_read("2", "u", "013")}, 'q3': {_read("3", "a", "2")}}}
      WHEN 1 THEN {{'q0': a.q0, 'q1': a.q1, 'q2': least(a.q2, {", ".join(_step(f"a.q{q}", str(INSERT), "I") for q in "013")}), 'q3': a.q3}}
      ELSE {{'q0': a.q0, 'q1': a.q1, 'q2': a.q2, 'q3': least(a.q3, {_step("a.q2", str(INSERT), "I")})}} END,
    {{'q0': '0000000000', 'q1': NULL::VARCHAR, 'q2': '0000000003I', 'q3': '0000000006II'}}) AS f FROM rows, (SELECT unnest([0, 1, 2]) AS step) GROUP BY conv_id)),
edits AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS n, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS place, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS m
  FROM (SELECT conv_id, unnest(string_split(substring(best, 11), '')) AS edit, generate_subscripts(string_split(substring(best, 11), ''), 1) AS j FROM best)),
made AS (
  SELECT e.conv_id, string_agg(CASE WHEN edit = 'K' THEN r.role WHEN m % 2 = 1 AND place = 1 THEN 'system' WHEN (place - m) % 2 <> 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY j) AS text
  FROM edits e JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.n = greatest(e.n, 1) WHERE edit <> 'D' GROUP BY e.conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substring(best, 1, 10)::BIGINT, 0) AS cost, coalesce(substring(best, 11), '') AS audit, sha256(coalesce(made.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM i.conv_id
"""
