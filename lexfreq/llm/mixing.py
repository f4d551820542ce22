"""Operator 1, mixing sources to target weights by Sainte-Lague apportionment.

The size of a text is its number of words (runs of characters other than ASCII white space). Sources in
code-point order, null last, weigh 1, 2, 3, repeating, and share 100 % of all sizes; no target is more
than 3 times the size of its source, the excess goes to the others by weight.

Quotas: all sizes make equal blocks of words, which go one by one to the source with the highest
quotient target / (2 k + 1), k being the blocks it has. The blocks of a source go the same way to its
groups of shards and to the shards in them, by their sizes; a shard holds about a thousand documents
in seeded order, dealt by doc_id and text. So every quota is a whole number of blocks, decided from one row per shard.

Selection: the words of a shard form a line of blocks. The quota is taken as whole passes over
the shard plus the blocks that a seeded permutation puts first; words of a document are taken as
often as their blocks are. No document is taken more than 3 times, since no target is.

The block is the largest power of two up to BLOCK words of which every source's target holds
at least 64 (1 if none does), so a source misses its target by under a block for a rounded quota.

Defined cases: null and empty texts have size 0 and nothing taken; a source of size 0 has target 0. A null
source is a source. Repeated rows and doc_ids count each; rows alike in doc_id, source and size share
what is taken in some order. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfreq.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK = 64
SHARD_ROWS = 1024
SHARD_WORDS = 1 << 20
GROUP_SHARDS = 1024


def targets(sizes: list[int], weights: list[float], repeats: float = MOST_REPEATS) -> list[float]:
    """Shares of all sizes by weight, none above `repeats` times its size."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(votes: list[float], seats: int) -> list[int]:
    """Sainte-Lague for one list, on the driver: one entry per source."""
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    v = np.array(votes, float)
    ideal, reach = v * seats / total, v * len(v) / (2 * total)
    low = np.maximum(0, np.ceil(ideal - reach - 0.5) - 1).astype(int)
    high = (np.floor(ideal + reach + 0.5) + 1).astype(int)
    party = np.repeat(np.arange(len(v)), high - low)
    k = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
    order = np.lexsort((party, -v[party] / (2 * k + 1)))[:seats - int(low.sum())]
    return (low + np.bincount(party[order], minlength=len(v))).tolist()


def apportioned(shares: DataFrame, parent: list[str], child: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague in every group of `parent`: column `out` adds up to the group's `seats`.

    A group's seats come from the divisor method's bounds: with m children, n / total of the votes and Q
    seats, a child gets Q n / total, give or take m n / (2 total) + 1/2. Only quotients between the bounds
    are ranked, some four for each child.
    """
    group = Window.partitionBy(*parent)
    total = F.sum(votes).over(group)
    ideal, reach = F.col(votes) * F.col(seats) / total, F.col(votes) * F.count("*").over(group) / (2 * total)
    bounds = shares.withColumn("_ideal", F.when(total > 0, ideal).otherwise(0.0)).withColumn("_reach", F.when(total > 0, reach).otherwise(0.0))
    bounds = bounds.select(*shares.columns,
                           F.greatest(F.lit(0), F.ceil(F.col("_ideal") - F.col("_reach") - 0.5) - 1).cast("bigint").alias("_low"),
                           (F.floor(F.col("_ideal") + F.col("_reach") + 0.5) + 1).cast("bigint").alias("_high"))
    bounds = bounds.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    ranked = bounds.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*parent).orderBy(
            (F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(child), F.col("_k"))))
    won = F.sum((F.col("_rank") <= F.col("_left")).cast("bigint"))
    keys = shares.columns
    return ranked.groupBy(*keys, "_low").agg(won.alias("_won")).select(
        *keys, F.when(F.col(votes) > 0, F.col("_low") + F.col("_won")).otherwise(0).alias(out))


def _extra(block: int) -> Column:
    """Word ranges of a document, which covers the words [start, start + size) of its shard, in the chosen blocks."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)

    def words(j: Column) -> Column:
        place = F.pmod(F.col("stride") * j + F.col("offset"), F.col("blocks"))
        # The last block of the choice is taken only as far as the quota goes.
        reach = F.when(place < F.col("extra_blocks"), F.lit(block)).when(place == F.col("extra_blocks"), F.col("extra_words")).otherwise(0)
        begin = F.greatest(F.lit(0).cast("bigint"), j * block - F.col("start"))
        end = F.least(F.col("size"), j * block + reach - F.col("start"))
        return F.struct(begin.alias("from"), end.cast("bigint").alias("to"))

    ranges = F.filter(F.transform(F.sequence(first, last), words), lambda r: r["from"] < r["to"])
    return F.when(F.col("size") > 0, ranges).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>"))


def mix(docs: DataFrame, keep: list[str] = ["doc_id"], weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK,
        seed: int = 0) -> DataFrame:
    """The mix as one row per document.

    row holds the columns to keep; size, source_size and target are as described; the mix takes the document
    `passes` times as a whole and the word ranges `extra` once more, `taken` words in all.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                        F.struct(*keep).alias("row"), F.xxhash64("text").alias("text_key"))
    # Rows without words take no part in the choice; they may be many with one text and no doc_id.
    dealt = F.when(F.col("size") > 0, F.xxhash64("doc_id", "text_key", F.lit(seed))).otherwise(
        F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    sized = written(sized.withColumn("dealt", dealt).drop("text_key"), "sizes")
    # One row per source: as many as the weights are stated for.
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    totals = sorted(totals, key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.n for r in totals], [weights[i % len(weights)] for i in range(len(totals))])
    least = min((g for g in goal if g > 0), default=0)
    while block > 1 and least < 64 * block:
        block //= 2
    quotas = apportion(goal, round(sum(goal) / block))
    plan = written(spark.createDataFrame(
        [(r.source, r.n, g, q, max(1, -(-r.rows // SHARD_ROWS), -(-r.n // SHARD_WORDS)))
         for r, g, q in zip(totals, goal, quotas)],
        "source string, source_size bigint, target double, quota bigint, shards bigint"), "mixing_plan")
    placed = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = placed.withColumn("shard", F.pmod("dealt", "shards"))
    shares = placed.groupBy("source", "quota", "shard").agg(F.sum("size").alias("words")).withColumn(
        "batch", F.floor(F.col("shard") / GROUP_SHARDS))
    groups = shares.groupBy("source", "quota", "batch").agg(F.sum("words").alias("batch_words"))
    groups = apportioned(groups, ["source"], "batch", "batch_words", "quota", "batch_quota")
    shares = shares.join(groups.select(F.col("source").alias("s"), F.col("batch").alias("b"), "batch_quota"),
                         F.col("source").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b"))).drop("s", "b", "quota")
    shares = apportioned(shares, ["source", "batch"], "shard", "words", "batch_quota", "shard_quota")
    due = F.least(F.col("shard_quota") * block, F.lit(MOST_REPEATS) * F.col("words"))
    shares = (shares.withColumn("due", due)
              .withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("due") / F.col("words"))).otherwise(0))
              .withColumn("extra", F.col("due") - F.col("passes") * F.col("words"))
              .withColumn("blocks", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("words") / block))))
    # An odd step that shares no factor with the number of blocks walks over all of them.
    stride = F.pmod(F.xxhash64("source", "shard", F.lit(seed), F.lit("stride")), F.greatest(F.lit(1), F.col("blocks")))
    shares = shares.select(
        F.col("source").alias("s"), F.col("shard").alias("d"), "passes", "extra", "blocks", "words",
        _coprime(stride, F.col("blocks")).alias("stride"),
        F.pmod(F.xxhash64("source", "shard", F.lit(seed), F.lit("offset")), F.col("blocks")).alias("offset"))
    # The short block at the end of the line: where it is used up, the next one makes up for what it lacks.
    short = F.col("blocks") * block - F.col("words")
    place_of_last = F.pmod(F.col("stride") * (F.col("blocks") - 1) + F.col("offset"), F.col("blocks"))
    used_up = place_of_last * block + (block - short) < F.col("extra")
    shares = shares.withColumn("extra_full", F.when(used_up, F.col("extra") + short).otherwise(F.col("extra")))
    shares = shares.withColumn("extra_blocks", F.floor(F.col("extra_full") / block)).withColumn(
        "extra_words", F.col("extra_full") - F.col("extra_blocks") * block)
    line = Window.partitionBy("source", "shard").orderBy("dealt", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0).cast("bigint")))
    joined = lined.join(shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("d")))
    joined = joined.select("row", "source", "size", "source_size", "target", F.col("passes").cast("int").alias("passes"),
                           _extra(block).alias("extra"))
    words = F.aggregate("extra", F.lit(0).cast("bigint"), lambda a, r: a + r["to"] - r["from"])
    return joined.withColumn("taken", F.col("passes") * F.col("size") + words)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of `docs`.

    A document comes as often as the mix takes all of it, and once more with the words taken beyond that, each with
    the white space after it; n_chars, if there is such a column, follows the text.
    """
    numbered = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered_documents")
    sizes = numbered.select("row.doc_id", "row.source", "row.text", "number")
    # Texts are shuffled once, to the rows that say what is taken of them.
    taken = numbered.join(mix(sizes, ["number"], **options).select("row.number", "passes", "extra"), "number")
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    rows = taken.withColumn("pieces", F.when(F.size("extra") > 0, pieces))
    part = F.array_join(F.flatten(F.transform(
        "extra", lambda r: F.slice("pieces", (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), "")
    texts = F.concat(F.array_repeat(F.col("row.text"), F.col("passes")), F.when(F.size("extra") > 0, F.array(part)).otherwise(
        F.array().cast("array<string>")))
    rows = rows.select("row", F.explode(texts).alias("taken"))
    own = {"text": F.col("taken"), "n_chars": F.length("taken").cast("bigint")}
    return rows.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _coprime(step: Column, n: Column) -> Column:
    """The first number from `step` on that has no factor in common with n.

    There is one among 60 consecutive numbers for every n below 2^37 (Jacobsthal's function).
    """
    def factor(a: Column, b: Column) -> Column:
        # Euclid's algorithm; 60 steps are enough for numbers below 2^37.
        pair = F.struct(a.alias("a"), b.alias("b"))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(60)), pair, lambda p, _: F.struct(
            F.when(p["b"] == 0, p["a"]).otherwise(p["b"]).alias("a"),
            F.when(p["b"] == 0, p["b"]).otherwise(p["a"] % p["b"]).alias("b")))
        return done["a"]

    tries = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: step + i)
    return F.element_at(F.filter(tries, lambda s: factor(s, n) == 1), 1)
