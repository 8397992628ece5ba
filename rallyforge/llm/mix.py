"""Problem 7: mix sources to target weights.

The size of a record is its number of tokens. Every available source (wanted with a positive weight, able to repeat, and
with at least one token) gets its weight, relative to the available sources, of the whole; the whole is the largest for
which no record occurs more than ``max_repeats`` times, so one scarce source bounds it, unless a smaller total is asked
for. Within a source, records come in the order of a hash; all of them occur once before any occurs twice.

Method: Pfair scheduling. A source is a task of rate weight, its work a sequence of blocks of ``BLOCK`` tokens. Block j
is released at floor(j / rate) and due at ceil((j + 1) / rate), in slots; earliest deadline first fills the slots, so at
any slot no source is off its share by a block or more. Rates are whole numbers over their sum H, so the schedule repeats
every H slots: it is made once for H slots, whatever the size of the data, and a record finds its slot from its position by
arithmetic. H is that of the exact weights where it is at most ``MOST_SLOTS``; else the weights are rounded to parts of
``MOST_SLOTS`` by largest remainder, every source keeping at least one, so no share is off by more than 1 / ``MOST_SLOTS`` for
each source, and p7_shares shows by how much. A record belongs to the block where it starts, so in tokens a
source can be ahead by its longest record besides.

Scale: records are reduced to id, source and size where they are read. Positions are prefix sums: a window within hash
buckets of bounded size, one over the sums of ``STRETCH`` buckets at a time, and one over the sums of those; so a source with
a third of all rows is spread over as many tasks as it needs. Only the target table and one total per wanted source reach the driver.

Defined results: sources are equal when equal after trimming and lower-casing. Records without a token (NULL or empty
text) are never drawn, nor are records of sources that are not wanted or have no source. NULL, NaN, infinite or negative weight,
NULL max_repeats or one below 1 mean that a source is not available; of copies of a target the weights add up. The
record that crosses a source's end is drawn if more than half of it fits. No available source: no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.llm.encode import BYTE_BPE_50K, SLICE, encoder, sent_along
from rallyforge.session import cut_lineage

BLOCK, BUCKET_ROWS, STRETCH, MOST_TARGETS, MOST_SLOTS = 1_024, 20_000, 1_000, 10_000, 100_000


def source_name(c: str | Column) -> Column:
    name = F.lower(F.btrim(c, F.lit(" \t\r\n")))
    return F.when(name != "", name)


def token_sizes(documents: DataFrame, path: str = BYTE_BPE_50K, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep..., n_tokens of each text; NULL and empty texts have 0."""
    rows = sent_along(documents, path).select(*keep, F.col("text").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                n = [len(x) // 4 for x in enc.encode_batch(batch.column("__text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, f"{kinds}, n_tokens bigint")


def pfair(rates: list[int]) -> list[list[int]]:
    """Slots of one period, for tasks of whole rates: the period has sum(rates) slots, task i gets rates[i] of them. Earliest
    deadline first among released blocks (ties: the task with the larger rate, then the first)."""
    period = sum(rates)
    slots: list[list[int]] = [[] for _ in rates]
    waiting = [(0, i) for i, r in enumerate(rates) if r > 0]  # (release, task)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # (deadline, -rate, task)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * period // rates[i]), -rates[i], i))
        _, _, i = heapq.heappop(ready)
        slots[i].append(t)
        if len(slots[i]) < rates[i]:
            heapq.heappush(waiting, (len(slots[i]) * period // rates[i], i))
    return slots


def whole_rates(weights: dict[str, float], most: int = MOST_SLOTS) -> dict[str, int]:
    """Whole numbers in the proportion of the (finite, positive) weights, exactly if their sum is at most `most`; else parts of
    `most` by largest remainder, at least one each."""
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*parts.values())
    total = sum(parts.values())
    if total // common <= most:
        return {s: p // common for s, p in parts.items()}
    rates = {s: max(1, p * most // total) for s, p in parts.items()}
    left = most - sum(rates.values())
    if left > 0:
        for s in sorted(parts, key=lambda s: (-(parts[s] * most % total), s))[:left]:
            rates[s] += 1
    while left < 0:  # those that were raised to one take from the largest
        s = max(rates, key=rates.get)
        taken = min(-left, max(1, rates[s] // 2))
        rates[s] -= taken
        left += taken
    return rates


def plan(totals: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, dict]:
    """For each available source: rate (whole number), its tokens in the mix, passes over its records."""
    able = {s: (w, r) for s, (w, r) in available(targets).items() if totals.get(s, 0) > 0}
    if not able:
        return {}
    rates = whole_rates({s: w for s, (w, _) in able.items()})
    period = sum(rates.values())
    whole = min(Fraction(able[s][1] * totals[s] * period, rates[s]) for s in rates)
    if total_tokens is not None:
        whole = min(whole, Fraction(total_tokens))
    out = {}
    for s in rates:
        tokens = int(whole * rates[s] / period)
        out[s] = {"rate": rates[s], "period": period, "tokens": tokens, "passes": min(able[s][1], -(-tokens // totals[s])), "total": totals[s]}
    return out


def available(targets: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    return {s: (w, r) for s, (w, r) in targets.items() if 0 < w < math.inf and r >= 1}


def wanted(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = (
        targets.select(source_name("source").alias("source"), "weight", "max_repeats").filter("source IS NOT NULL")
        .groupBy("source").agg(F.sum(F.when(~F.isnan("weight") & (F.col("weight") > 0), F.col("weight"))).alias("w"), F.max("max_repeats").alias("r"))
        .orderBy("source").limit(MOST_TARGETS + 1).collect()
    )
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return {r["source"]: (r["w"] or 0.0, r["r"] or 0) for r in rows}


def sized_records(documents: DataFrame, targets: DataFrame, path: str = BYTE_BPE_50K, drawn_only: bool = False) -> DataFrame:
    """doc_id, source (normalised), n_tokens of the records of wanted sources, stored; drawn_only: of those only that a mix
    can draw from, which is all that it needs."""
    goals = wanted(targets)
    names = documents.sparkSession.createDataFrame([(s,) for s in (available(goals) if drawn_only else goals)], "source string")
    rows = documents.select("doc_id", source_name("source").alias("source"), "text")
    return cut_lineage(token_sizes(rows.join(F.broadcast(names), "source", "left_semi"), path))  # at most MOST_TARGETS names


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """slot, source, block_no, position (tokens of the source before it), doc_id, repeat_no (from 1), n_tokens. The mix is
    read in the order of slot, then position."""
    spark = sized.sparkSession
    usable = sized.filter("n_tokens > 0")
    goals = wanted(targets)
    per = usable.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n")).collect()  # one row per wanted source
    made = plan({r["source"]: r["total"] for r in per}, goals, total_tokens)
    slots = pfair([p["rate"] for p in made.values()])
    rows = [(s, p["rate"], p["period"], p["tokens"], p["passes"], p["total"], at) for (s, p), at in zip(made.items(), slots)]
    plans = spark.createDataFrame(rows, "source string, rate bigint, period bigint, goal bigint, passes int, total bigint, at array<bigint>")
    buckets = max(1, -(-max([r["n"] for r in per], default=1) // bucket_rows))
    keyed = usable.withColumn("h", F.xxhash64("doc_id", "source")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s")).withColumn("stretch", F.floor(F.col("bucket") / STRETCH))
    stretches = sums.groupBy("source", "stretch").agg(F.sum("s").alias("s"))
    stretches = stretches.select("source", "stretch", (F.sum("s").over(Window.partitionBy("source").orderBy("stretch")) - F.col("s")).alias("base"))
    in_stretch = F.sum("s").over(Window.partitionBy("source", "stretch").orderBy("bucket")) - F.col("s")
    offsets = sums.withColumn("before", in_stretch).join(stretches, ["source", "stretch"]).select("source", "bucket", (F.col("base") + F.col("before")).alias("before"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("within", F.sum("n_tokens").over(inner) - F.col("n_tokens")).join(offsets, ["source", "bucket"])
    drawn = (
        placed.join(F.broadcast(plans), "source")
        .withColumn("pass", F.explode(F.expr("CASE WHEN passes > 0 THEN sequence(0, passes - 1) ELSE array() END")))
        .withColumn("position", F.col("pass") * F.col("total") + F.col("before") + F.col("within"))
        .filter("2 * (goal - position) > n_tokens")
        .withColumn("block_no", F.floor(F.col("position") / block))
    )
    slot = F.floor(F.col("block_no") / F.col("rate")) * F.col("period") + F.element_at("at", (F.col("block_no") % F.col("rate") + 1).cast("int"))
    return drawn.select(slot.alias("slot"), "source", "block_no", "position", "doc_id", (F.col("pass") + 1).alias("repeat_no"), "n_tokens")


def shares(sized: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per wanted source: its weight, what there is of it, what the mix has of it."""
    spark = sized.sparkSession
    goals = wanted(targets)
    wished = spark.createDataFrame([(s, float(w), int(r)) for s, (w, r) in goals.items()], "source string, weight double, max_repeats int")
    there = sized.groupBy("source").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("tokens"))
    taken = mixed.groupBy("source").agg(F.count("*").alias("mix_records"), F.sum("n_tokens").alias("mix_tokens"), F.max("repeat_no").alias("most_repeats"))
    rows = wished.join(there, "source", "left").join(taken, "source", "left").na.fill(0)
    able = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0), F.col("weight"))
    whole = rows.agg(F.sum("mix_tokens").alias("all_tokens"), F.sum(able).alias("all_weights"))
    return rows.join(F.broadcast(whole)).select(  # one row
        "source", "weight", "max_repeats", "records", "tokens", "mix_records", "mix_tokens", "most_repeats",
        F.coalesce(able / F.col("all_weights"), F.lit(0.0)).alias("target_share"),
        F.when(F.col("all_tokens") > 0, F.col("mix_tokens") / F.col("all_tokens")).alias("actual_share"),
    )
