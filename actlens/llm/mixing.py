"""Mixing sources to target weights by a low-discrepancy source schedule.

The mix is a sequence of slots. Slot ``t`` looks at the golden-ratio point
``frac(t * 0.618...)``; the cumulative weights of the sources map that point to
a source, so every prefix of the schedule is close to the target weights. The
slots of a source are ranked; its documents, shuffled by a hash, lie on a line
of tokens that is cut into blocks of equal token count; the slot of rank ``r``
takes block ``r`` of the line, and starts over when the line is used up.

Everything is DataFrame code. No step works on a whole source at once: ranks
and token offsets are prefix sums in two levels (a total per bucket or slice,
then a window inside it), so a source with a third of all rows is spread over
many tasks. Slices of documents are ranges of all order columns down to the
row, so rows without an id, or with one and the same, are spread too.

Defined cases: a null text has size 0; a null source is a source of its own
(last in order); repeated rows are documents of their own; a document of size 0
takes nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.llm.common import count_words, materialize
from actlens.operators.ordering import slice_rows

GOLDEN = 0.6180339887498949
BLOCK_TOKENS = 1024
MAX_REPEATS = 3
ROWS_PER_SLICE = 20_000
GRID = 4096


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: its size, weight and target.

    Sources by code point (null last) weigh 1, 2, 3, repeating. The targets
    share the total by weight; a target stops at ``max_repeats`` times its
    source's size and the excess is shared again. The fixed point is found at
    once: ordered by (limit / weight), the stopped sources are a prefix, and
    the level of the others is (total - stopped limits) / (other weights). The
    windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", (F.pmod(rank, F.lit(3)) + 1).cast("long"))
    limit = F.col("source_size") * F.lit(max_repeats)
    every = Window.partitionBy(F.lit(0))
    # sources are compared by limit / weight without division
    by_ratio = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("_left", F.sum("source_size").over(every)
                          - F.coalesce(F.sum(limit).over(before), F.lit(0)))
           .withColumn("_weights", F.sum("weight").over(every)
                       - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           # stopped: its limit is below its share of what is left
           .withColumn("_stopped", limit * F.col("_weights") < F.col("weight") * F.col("_left")))
    per = (per.withColumn("_level_n", F.min(F.when(~F.col("_stopped"), F.struct(
               limit / F.col("weight"), F.col("source").isNull(), "source",
               F.col("_left").alias("left"), F.col("_weights").alias("weights")))).over(every)))
    share = F.col("weight") * F.col("_level_n.left") / F.col("_level_n.weights")
    return per.select("source", "source_size", "weight",
                      F.when(F.col("_stopped"), limit.cast("double"))
                      .otherwise(share).cast("double").alias("target"))


def _bucket_offsets(totals: DataFrame, keys: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier buckets of the same key."""
    w = (Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def source_plan(sizes: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source (by number): length of its line, words to take, and
    how many slots (blocks) that needs."""
    t = source_targets(sizes).withColumn("quota", F.round("target").cast("long"))
    n_blocks = F.ceil(F.col("source_size") / F.lit(block_tokens)).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0)
    rest = F.col("quota") - F.col("full") * F.col("source_size")
    return (t.withColumn("n_blocks", n_blocks).withColumn("full", full.cast("long"))
            .withColumn("n_slots", (F.col("full") * F.col("n_blocks")
                                    + F.ceil(rest / F.lit(block_tokens))).cast("long"))
            .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))


def schedule(plan: DataFrame, n_slots: int, slots_per_bucket: int = 1 << 16) -> DataFrame:
    """(slot, sid, rank): the source of every slot and its rank among the slots
    of that source, restricted to the slots that the source needs.

    A slot finds its source through a grid over [0, 1): each source is listed
    in the cells that its interval touches, and the golden-ratio points fall
    into the cells evenly."""
    spark = plan.sparkSession
    run = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n_slots").over(Window.partitionBy(F.lit(0)))
    arcs = (plan.filter("n_slots > 0")
            .withColumn("hi", F.sum("n_slots").over(run) / total)
            .withColumn("lo", F.col("hi") - F.col("n_slots") / total)
            .withColumn("hi", F.when(F.sum("n_slots").over(run) == total, F.lit(2.0)).otherwise(F.col("hi")))
            .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
            .select("sid", "n_slots", "lo", "hi", F.explode(F.sequence(
                F.floor(F.col("lo") * GRID),
                F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))).alias("cell")))
    point = F.col("slot") * F.lit(GOLDEN)
    slots = (spark.range(n_slots).withColumnRenamed("id", "slot")
             .withColumn("u", point - F.floor(point))
             .withColumn("cell", F.floor(F.col("u") * GRID)))
    hit = (slots.join(arcs, "cell").filter("u >= lo and u < hi")
           .select("slot", "sid", "n_slots",
                   F.floor(F.col("slot") / F.lit(slots_per_bucket)).alias("part")))
    counts = _bucket_offsets(hit.groupBy("sid", "part").count(), ["sid"], "part", "count", "before")
    ranked = (hit.join(counts.select("sid", "part", "before"), ["sid", "part"])
              .withColumn("rank", F.col("before") - 1 + F.row_number().over(
                  Window.partitionBy("sid", "part").orderBy("slot")))
              .filter("rank < n_slots").select("slot", "sid", "rank"))
    # the few ranks that the finite schedule leaves open come at its end
    got = counts.groupBy("sid").agg(F.sum("count").alias("got"))
    open_ranks = (plan.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
                  .filter("n_slots > got")
                  .select("sid", F.explode(F.expr("sequence(got, n_slots - 1)")).alias("rank"))
                  .select(F.lit(n_slots).cast("long").alias("slot"), "sid", "rank"))
    return ranked.unionByName(open_ranks)


def place_documents(docs: DataFrame, n_docs: int, seed: str) -> DataFrame:
    """Adds ``begin``: the document's place on the token line of its source,
    in the order of a hash of its id (ties by id and size; what is left are rows
    of one id and size, whose order among each other changes no result).

    ``docs`` has a number ``row`` that is the same whenever it is read."""
    order = ["sid", "key", "doc_id", "size", "row"]
    shuffled = docs.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    sliced = slice_rows(shuffled, [F.col(c) for c in order], max(1, -(-n_docs // ROWS_PER_SLICE)), "slice")
    offsets = _bucket_offsets(sliced.groupBy("sid", "slice").agg(F.sum("size").alias("total")),
                              ["sid"], "slice", "total", "offset")
    inside = (Window.partitionBy("sid", "slice").orderBy(*order[1:])
              .rowsBetween(Window.unboundedPreceding, -1))
    return (sliced.join(offsets.select("sid", "slice", "offset"), ["sid", "slice"])
            .withColumn("begin", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("key", "slice", "offset"))


def _overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))


def mix_sources(docs: DataFrame, seed: str = "mix-1:", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, n_slots_used."""
    slim = materialize(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"))
                       .withColumn("row", F.monotonically_increasing_id()), "mix-size")
    plan = materialize(source_plan(slim, block_tokens), "mix-plan")
    total = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
    n_docs = slim.count()
    keyed = slim.join(plan.select("source", "sid", "source_size", "target"),
                      slim["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = materialize(place_documents(keyed, n_docs, seed), "mix-placed")

    slots = schedule(plan, int(total))
    per = plan.select("sid", "source_size", "n_blocks", "quota")
    length = F.least(F.lit(block_tokens), F.col("source_size") - F.col("block") * block_tokens)
    # what a slot takes: its block, cut where the source's quota ends
    takes = (slots.join(per, "sid")
             .withColumn("block", F.pmod("rank", "n_blocks"))
             .withColumn("taken_before", F.floor(F.col("rank") / F.col("n_blocks")) * F.col("source_size")
                         + F.col("block") * block_tokens)
             .withColumn("len", F.least(length, F.col("quota") - F.col("taken_before")))
             .filter("len > 0").groupBy("sid", "block", "len").agg(F.count("*").alias("times")))
    pieces = (placed.filter("size > 0")
              .select("row", "sid", "begin", "size", F.explode(F.sequence(
                  F.floor(F.col("begin") / block_tokens),
                  F.floor((F.col("begin") + F.col("size") - 1) / block_tokens))).alias("block")))
    start = F.col("block") * block_tokens
    words = _overlap(F.col("begin"), F.col("begin") + F.col("size"), start, start + F.col("len"))
    taken = (pieces.join(takes, ["sid", "block"])
             .groupBy("row").agg(F.sum(words * F.col("times")).cast("long").alias("taken"),
                                 F.sum("times").alias("n_slots_used")))
    return (placed.join(taken, "row", "left")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source",
                    F.coalesce("n_slots_used", F.lit(0)).cast("long").alias("n_slots_used")))
