"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame operations only.

Shares: a source's tokens over all tokens; a text's tokens are its runs of characters other than
space, tab, newline and carriage return. Weights are shares to the power ``tau``, normalised. The
exponent is bisected between 0 (all sources alike) and 1 (shares as they are):

* ``target_entropy``: the largest exponent whose weights have at least this share of the highest
  entropy possible; 1 if the shares have it already, 0 if it is only met there;
* ``max_repetition``: the exponent is then raised as far as needed so that no source is read more
  often than this; a budget above ``max_repetition`` times the corpus can't be met and is an error.

Realisation: ``budget`` tokens (default: the least at which every source is read whole once) are dealt
to sources by weight. A source is read in passes; the order of a pass is the order of a hash of
(seed, pass, document). Whole passes are read whole, the last one until its budget is reached, so it
ends with the document that crosses the budget. ``blocks`` slices of equal budget each hold every
source in proportion to its weight: a document's block follows from the tokens of its source before
it. Within a block the order is that of the hash, across sources.

No key is gathered: tokens are summed per (source, pass, hash bucket), buckets are so many that each
stays small, prefix sums over buckets give the offsets, and only a bucket's rows are sorted together.
Hash ties are read together, repeated rows are separate documents. A null source is a source of its
own. Null and empty texts have no tokens: they are read in whole passes, and in the last one if their
turn comes before the budget is reached. Sources without tokens have weight 0 and are read once. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.operators.ordered import join_hot
from keystride.params import MAX_BROADCAST_ROWS
from keystride.session import materialize

SEED = "mix"
ROUNDS, CUTS = 12, 8      # each round narrows the exponent to one of CUTS + 1 parts
TAU_DIGITS = 6
WEIGHT_DIGITS = 12        # significant ones, so that no source is too small for a weight
BUCKET_ROWS = 1_000       # rows of a hash bucket, on average
BLOCKS = 64


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def order_key(seed: str, turn: Column, doc_id: Column, salt: Column) -> Column:
    """Hexadecimal hash that orders a pass."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed), part(turn), part(doc_id), part(salt)).cast("binary"))


def source_key(source: Column) -> Column:
    """Text that is never null and tells a null source from all others."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def significant(weight: Column) -> Column:
    """A weight above 0, rounded to its first digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(weight)))
    return F.round(weight / unit, WEIGHT_DIGITS - 1) * unit


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join on ``_source``: the source table is sent out if it is small, else hot sources are salted."""
    return join_hot(rows, sources, ["_source"], max_broadcast=MAX_BROADCAST_ROWS)


def _search(shares: DataFrame, meets: Callable[[float], bool], low: float, high: float, value: Callable[[Column], list[Column]],
            rising: bool) -> float:
    """The end of the range of exponents that meet a condition, by repeated cutting.

    Each round computes the measure at CUTS exponents in one job over the sources; CUTS numbers reach
    the driver.
    """
    for _ in range(ROUNDS):
        step = (high - low) / (CUTS + 1)
        taus = [low + step * (i + 1) for i in range(CUTS)]
        row = shares.agg(*[c.alias(f"v{i}_{j}") for i, t in enumerate(taus) for j, c in enumerate(value(F.lit(t)))]).first()
        for i, t in enumerate(taus):
            if meets(*[row[f"v{i}_{j}"] for j in range(len(value(F.lit(t))))]) == rising:
                high = t
                break
            low = t
    return high if rising else low


def exponent(shares: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> float:
    """The exponent for sources with ``share`` > 0; ``budget`` in units of the corpus."""
    n = shares.count()
    if n < 2:
        return 1.0
    s = F.col("share")
    power = lambda t: F.pow(s, t)
    # Entropy of p / sum(p): log(sum p) - sum(p log p) / sum p.
    entropy = lambda t: [F.log(F.sum(power(t))) - F.sum(power(t) * F.log(power(t))) / F.sum(power(t))]
    repeats = lambda t: [F.max(power(t) / s) / F.sum(power(t)), F.max(s / power(t)) * F.sum(power(t))]
    tau = 1.0
    if target_entropy is not None:
        goal = target_entropy * math.log(n) - 1e-9
        at_one = shares.agg(entropy(F.lit(1.0))[0].alias("h")).first().h
        if at_one < goal:
            tau = _search(shares, lambda h: h >= goal, 0.0, 1.0, entropy, False)
    if max_repetition is not None:
        # Without a budget the rarest-read source is read once.
        most = lambda r, once: r * (budget if budget is not None else once) <= max_repetition + 1e-9
        row = shares.agg(*[c.alias(f"r{i}") for i, c in enumerate(repeats(F.lit(tau)))]).first()
        if not most(row.r0, row.r1):
            if budget is not None and budget > max_repetition + 1e-9:
                raise ValueError("the budget is larger than max_repetition times the corpus")
            tau = _search(shares, most, tau, 1.0, repeats, True)
    return tau


def plan(counted: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None,
         budget: int | None = None) -> DataFrame:
    """Per source: ``_source, tokens, docs, weight, passes`` (whole ones) ``, rest`` (tokens of the last).

    ``counted`` has a row per document: ``_source``, ``n_tokens``.
    """
    sources = materialize(counted.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = materialize(sources.withColumn("share", F.col("tokens") / F.lit(float(total or 1))))
    real = shares.where("share > 0")
    relative = None if budget is None else budget / max(1, total)
    tau = round(exponent(real, target_entropy, max_repetition, relative), TAU_DIGITS)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(tau))).otherwise(0.0)
    norm = shares.agg(F.sum(power)).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.when(F.col("share") > 0, significant(power / F.lit(norm))).otherwise(0.0))
    if budget is None:
        budget = weighted.where("weight > 0").agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0] or 0
        # Rounding may take a token from a source that is to be read just once.
        goal = F.greatest(F.round(F.col("weight") * F.lit(float(budget))).cast("bigint"), F.col("tokens"))
    else:
        goal = F.round(F.col("weight") * F.lit(float(budget))).cast("bigint")
    full = F.when(F.col("tokens") > 0, F.expr("goal div tokens")).otherwise(F.lit(1).cast("bigint"))
    return weighted.withColumn("goal", goal).withColumn("passes", full).select(
        "_source", "tokens", "docs", "weight", "goal", "passes",
        F.when(F.col("tokens") > 0, F.col("goal") - F.col("passes") * F.col("tokens")).otherwise(F.lit(0)).alias("rest"))


def counted_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``_id, _source, _text, n_tokens`` of every row; ``_text`` tells rows of one id apart by their text."""
    words = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.col(f"`{doc_id}`").alias("_id"), source_key(F.col(f"`{source}`")).alias("_source"),
        F.md5(words.cast("binary")).alias("_text"), count_tokens(words).alias("n_tokens"))


def _in_order(read: DataFrame, buckets: int) -> DataFrame:
    """Add ``before``: tokens of the same source and pass ahead of a row, ties not counted.

    A bucket is a range of the hash, so it is a stretch of the order.
    """
    width = max(1, math.ceil(math.log2(max(2, buckets)) / 4))
    keyed = read.withColumn("_bucket", F.substring("_key", 1, width))
    sums = keyed.groupBy("_source", "pass", "_bucket").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy("_source", "pass").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket: rows over BUCKET_ROWS of them in a window.
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("t").over(ahead), F.lit(0))).drop("t")
    within = Window.partitionBy("_source", "pass", "_bucket").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy("_source", "pass", "_bucket", "_key")
    upto = keyed.withColumn("_upto", F.sum("n_tokens").over(within)).withColumn("_same", F.sum("n_tokens").over(peers))
    placed = upto.join(offsets, ["_source", "pass", "_bucket"])
    return placed.withColumn("before", F.col("_offset") + F.col("_upto") - F.col("_same")).drop("_upto", "_same", "_offset")


def schedule(counted: DataFrame, sources: DataFrame, seed: str = SEED, blocks: int = BLOCKS) -> DataFrame:
    """One row for each time a document is read: ``_id, _source, pass, before, block, _key, n_tokens``."""
    largest = sources.agg(F.max("docs")).first()[0] or 0
    slim = sources.select("_source", "tokens", "goal", "passes", "rest")
    joined = join_sources(counted, slim)
    last = F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)
    turns = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last))
    read = joined.withColumn("pass", F.explode(turns)).withColumn(
        "_key", order_key(seed, F.col("pass"), F.col("_id"), F.col("_text")))
    placed = _in_order(read, largest // BUCKET_ROWS)
    taken = placed.where((F.col("pass") < F.col("passes")) | (F.col("before") < F.col("rest")))
    offset = F.col("pass") * F.col("tokens") + F.col("before")
    block = F.when(F.col("goal") > 0, F.least(F.expr(f"({blocks} * offset) div goal"), F.lit(blocks - 1))).otherwise(F.lit(0))
    return taken.withColumn("offset", offset).withColumn("block", block.cast("bigint")).select(
        "_id", "_source", "pass", "offset", "block", "_key", "n_tokens")


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: int | None = None,
        doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """``docs`` itself with each row as often as it is read; texts are not shuffled.

    Documents of the last pass are those whose key is at most the source's last key taken.
    """
    counted = materialize(counted_documents(docs, doc_id, source, text))
    sources = materialize(plan(counted, target_entropy, max_repetition, budget))
    taken = schedule(counted, sources, seed)
    cut = taken.join(F.broadcast(sources.select("_source", "passes")), "_source") \
        if sources.count() <= MAX_BROADCAST_ROWS else taken.join(sources.select("_source", "passes"), "_source")
    cut = cut.where("pass = passes").groupBy("_source").agg(F.max("_key").alias("_last"))
    limits = materialize(sources.join(cut, "_source", "left").select("_source", "passes", "_last"))
    words = F.col(f"`{text}`").cast("string")
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), source_key(F.col(f"`{source}`")).alias("_source"),
        F.col(f"`{doc_id}`").alias("_id"), F.md5(words.cast("binary")).alias("_text_hash"))
    joined = join_sources(named, limits)
    key = order_key(seed, F.col("passes"), F.col("_id"), F.col("_text_hash"))
    times = F.col("passes") + F.when(key <= F.col("_last"), 1).otherwise(0)
    return joined.where(times > 0).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), times))).select("_row.*")
