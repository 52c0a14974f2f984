"""Document fingerprints by Order MinHash (operator 5), in DataFrame functions only.

A text's words give one k-mer for each word (the last ones are shorter). Equal k-mers are numbered by occurrence. For each of REGISTERS tuples the TUPLE numbered k-mers that are smallest by the tuple's
own order are selected, put in the order in which they stand in the text, and hashed. The hashes are the signature: it changes when the same words come in another order, as edit
distance does and plain MinHash doesn't. The likeness of two signatures is the share of tuples in which they agree.

A tuple's own order comes from arrivals: in each of REGISTERS slots of time a numbered k-mer arrives in one register, at a hashed moment; over all slots it comes into every register once, by a hashed
start and an odd step. A register takes those that arrive first. So each register has an order of its own on all k-mers, in which any is as likely to be first as any other, and yet a text of n words
needs only about MEAN * REGISTERS arrivals, not n * REGISTERS: n words fill every register with MEAN k-mers within MEAN * REGISTERS / n slots, and later arrivals can't be selected. (A register
holds fewer than two by then with a probability of MEAN * exp(-MEAN), and its tuple is then of what it holds; texts of up to MEAN words run through all slots.)

All of it is arithmetic on arrays of longs: a k-mer's hash stands in the upper bits and its position in the lower, so that one
sort groups equal k-mers in text order, and the occurrence number is found by a binary search that only repeated k-mers run. An arrival has its register, slot, moment and position in one long, so one sort
brings each register's first ones together.

Defined results: words are what white space parts; a word of more than LONG characters (a text without spaces) is taken character by character. A null text is the empty text; the empty text has one empty
word, so a fingerprint of its own, equal to that of other empty texts. A table of one row is its own next document. Rows of equal id follow each other in order of their texts' hashes; rows without id
come after all others, in the same order. Columns other than the id and the text are ignored. Texts are read whole; beyond 2**POSITION_BITS words, positions begin anew at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, texts

#: Words in a k-mer, characters of the longest word, tuples in a signature, and k-mers that a register gets in the mean before later ones are left out.
K, LONG, REGISTERS, MEAN = 3, 32, 64, 12
#: Bits for the position of a word in a text, and for the moment of an arrival; six are the slot's and six the register's.
POSITION_BITS, MOMENT_BITS = 26, 26
#: Ranges of documents for each shuffle partition when a document looks for the next one, and most ranges.
RANGES, MOST_RANGES = 4, 50_000

_LOW = (1 << POSITION_BITS) - 1
_MOMENT = ((1 << MOMENT_BITS) - 1) << POSITION_BITS
_FIRST = _MOMENT - (1 << 58)  # register and moment of an arrival in slot 0


def words_of(text: Column) -> Column:
    """The words of a text; those too long are taken apart."""
    words = F.split(text, r"\s")
    apart = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))
    return F.when(F.exists(words, lambda w: F.length(w) > LONG), apart).otherwise(words)


def with_signature(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with the column out (array<int>): the Order MinHash signature of the column text."""
    high = lambda x: F.shiftright(x, POSITION_BITS)

    def occurrence(s: Column, x: Column, j: Column) -> Column:
        """How many equal k-mers stand before index j of the sorted array s."""
        same = lambda back: (j >= back) & (high(F.get(s, j - back)) == high(x))
        steps = F.array(*[F.lit(1 << b) for b in range(POSITION_BITS - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(same(n + step), n + step).otherwise(n))

    def first_arrival(s: Column, x: Column, j: Column) -> Column:
        """That of a k-mer in slot 0; the k-th copy of a k-mer is one of its own."""
        seed = F.when((j > 0) & (high(F.get(s, j - 1)) == high(x)), F.xxhash64(high(x), occurrence(s, x, j))).otherwise(high(x))
        return F.xxhash64(seed).bitwiseAND(F.lit(_FIRST)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))

    def later_arrival(x: Column, slot: Column) -> Column:
        step = high(x).bitwiseAND(F.lit(31)) * 2 + 1
        register = F.shiftleft(F.shiftrightunsigned(x, 58) + slot * step, 58)
        moment = F.xxhash64(x.bitwiseAND(F.lit(~_LOW)), slot).bitwiseAND(F.lit(_MOMENT))
        return register.bitwiseOR(F.shiftleft(slot, 52)).bitwiseOR(moment).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))

    a, b = f"__{out}_a", f"__{out}_b"
    keep = [F.col(f"`{c}`") for c in df.columns]
    c, d = F.col(a), F.col(b)
    df = df.select(*keep, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias(a))
    kmers = F.transform(c, lambda h, i: F.shiftleft(high(F.xxhash64(h, *[F.get(c, i + n) for n in range(1, k)])), POSITION_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_LOW))))
    df = df.select(*keep, F.sort_array(kmers).alias(b))
    df = df.select(*keep, F.transform(d, lambda x, j: first_arrival(d, x, j)).alias(a))
    wanted, n = MEAN * REGISTERS, F.size(c)
    early = F.filter(c, lambda x: x.bitwiseAND(F.lit(_MOMENT)) <= F.floor(F.lit(float(_MOMENT)) * wanted / n))
    slots = F.sequence(F.lit(0).cast("long"), F.least(F.lit(REGISTERS), F.ceil(F.lit(wanted) / n)).cast("long") - 1)
    more = F.flatten(F.transform(slots, lambda slot: F.when(slot == 0, c).otherwise(F.transform(c, lambda x: later_arrival(x, slot)))))
    df = df.select(*keep, F.sort_array(F.when(n >= wanted, early).otherwise(more)).alias(b))
    register = lambda x: F.shiftright(x, 58)
    begins = F.filter(F.transform(d, lambda x, j: F.when((j == 0) | (register(x) != register(F.get(d, j - 1))), j)), lambda j: j.isNotNull())
    df = df.select(*keep, d, begins.alias(a))

    def selected(j: Column) -> Column:
        """The hash of the two that came first in a register, in the order of the text."""
        x, y = F.get(d, j), F.get(d, j + 1)
        place, name = (lambda v: v.bitwiseAND(F.lit(_LOW))), (lambda v: v.bitwiseAND(F.lit(~_LOW)))
        alone = y.isNull() | (register(x) != register(y))
        return F.when(alone, F.hash(name(x))).when(place(x) < place(y), F.hash(name(x), name(y))).otherwise(F.hash(name(y), name(x)))

    return df.select(*keep, F.transform(c, selected).alias(out))


def as_text(signature: Column) -> Column:
    """A signature as one string: eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of tuples in which two signatures agree, 0 to 1; a tuple's hash holds its register."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def with_next(df: DataFrame, columns: dict[str, str], ranges: int | None = None) -> DataFrame:
    """df (doc_id, text, ...) with columns of the next document in descending doc_id; after the last comes the first.

    Documents are dealt in ranges of doc_id that hold about equally many (cut at quantiles); an id that several ranges would be filled with, and what has no id, is dealt on by the hash
    of the text. The head of each range is also sent to the one before it in order, so that one window in each range finds every next document. Only the cuts
    and one head for each range come to the driver.
    """
    spark = df.sparkSession
    ranges = ranges or min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / ranges for k in range(1, ranges)]
    cuts, n, with_id = df.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 10 * ranges))) if shares else F.lit(None), F.count(F.lit(1)), F.count("doc_id")).first()
    cuts = F.array(*[F.lit(c).cast("long") for c in cuts or ()]).cast("array<long>")
    steps = F.array(*[F.lit(1 << b) for b in range(max(1, ranges).bit_length(), -1, -1)])
    count = lambda test: F.aggregate(steps, F.lit(0), lambda k, step: F.when(F.coalesce(test(F.get(cuts, k + step - 1)), F.lit(False)), k + step).otherwise(k))
    part = F.col("__hash") / F.lit(2.0**64) + 0.5  # of 1
    low, high = count(lambda c: c < F.col("doc_id")), count(lambda c: c <= F.col("doc_id"))
    inside = lambda k: F.least(F.floor(part * k), k - 1).cast("int")
    nameless = max(1, (n - with_id) * ranges // max(n, 1))
    own = F.when(F.col("doc_id").isNull(), inside(F.lit(nameless)) - nameless).otherwise(low + inside(high - low + 1))
    rows = df.withColumn("__hash", F.xxhash64("text")).withColumn("__own", own)
    # one row for each range
    first = sorted((r["__own"], r.h.doc_id, r.h["__hash"]) for r in rows.groupBy("__own").agg(F.max(F.struct("doc_id", "__hash")).alias("h")).collect())
    heads = [(at, i, h, first[(k + 1) % len(first)][0]) for k, (at, i, h) in enumerate(first)]
    heads = spark.createDataFrame(heads, "__own int, __id long, __head long, __above int")
    rows = rows.join(F.broadcast(heads), "__own", "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__head"))
    places = F.filter(F.array(F.struct(F.lit(False).alias("ghost"), F.col("__own").alias("at")), F.struct(F.lit(True).alias("ghost"), F.when(is_head, F.col("__above")).alias("at"))), lambda p: p["at"].isNotNull())
    rows = rows.select(*df.columns, "__hash", F.explode(places).alias("__place"))
    there = Window.partitionBy("__at").orderBy(F.col("__place.ghost").asc(), F.col("doc_id").desc_nulls_last(), F.col("__hash").desc(), F.col("text").asc())
    rows = rows.withColumn("__at", F.col("__place.at"))
    return rows.select(*df.columns, F.col("__place.ghost").alias("__ghost"), *[F.lead(c).over(there).alias(out) for c, out in columns.items()]).filter(~F.col("__ghost")).drop("__ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: its fingerprint, that of its edited text, and how like they and the next document's are."""
    rows = texts(docs)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.length("text").cast("long").alias("n_chars"))
    rows = with_next(with_signature(rows, "text", "sig"), {"text": "next_text", "sig": "next_sig"})
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "sig", "next_sig", edited.alias("edited"))
    rows = with_signature(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: fingerprints of every whole text of documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
