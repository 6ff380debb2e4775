"""Every registered query, by name. Each takes the test views and returns a frame.

Doubles are rounded and times are given in microseconds, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import StreamingQueryException

from keystride.functions import scoring, sql, text
from keystride.operators import expiry, fold, merge, prefix, reports, replay, ring, serving, trending, upkeep
from keystride.session import materialize, work_dir
from keystride.sources import events as event_log
from keystride.sources import lines
from keystride.sources.dictionary import DictionaryStore
from keystride.sources.lists import ListStore
from keystride.sources.polls import EventLog
from keystride.sources.ranges import DictionaryRanges
from keystride.sources.scores import ScoreStore
from keystride.sources.sketches import DistinctSketches, LatencySketches, distinct_bound, rank_bound
from keystride.sources.views import AS_OF, HALF_LIFE, NODES_3, NODES_4, TestViews, as_requests, searched_queries
from keystride.streaming import entries, jobs, rankings, sessions

QUERIES: dict[str, Callable[[TestViews], DataFrame]] = {}

# The settings under which the queries are compared. Test events lie minutes apart.
PREFIX = "th"
WILDCARD_PREFIX = "of%"
BEFORE_ALL = "2023-12-31 00:00:00"
MIDDLE = "2024-01-15 00:00:00"
CHANGED_SINCE = "2024-01-30 00:00:00"
LOADED_AT = "2024-01-01 00:00:00"
FLUSH_EVENTS, FLUSH_SECONDS = 100, 86_400
DEBOUNCE = 3600
TTL_MS = 6 * 3600 * 1000
REPLICAS = (1, 10, 50, 150)
SNAPSHOTS = ("2023-12-31 00:00:00", "2024-01-31 00:00:00")
# Long after the last event, at a half-life of an hour.
MUCH_LATER, HOUR = "2024-03-31 00:00:00", 3600.0
LOG_FILES = 4
SMALL_GROUP = 500  # rows beyond which the large queries cut a group
DAY = 86_400
RANGE_ROWS = 20_000  # rows of a stored key range
POLL = 5_000         # events of a poll; the test log comes at once
BACKLOG_POLLS = 200  # full polls that a micro-batch takes of it
KLL_CHECKED = 200    # the bound of sketches of this size is asked of larger ones


def query(fn: Callable[[TestViews], DataFrame]) -> Callable[[TestViews], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def micros(name: str, alias: str) -> Column:
    return F.unix_micros(name).alias(alias)


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def scores(v: TestViews) -> DataFrame:
    return trending.decayed_scores(v.search_event, AS_OF, HALF_LIFE)


def prefix_keys(v: TestViews) -> DataFrame:
    """Distinct keys of all prefixes of all normal forms."""
    spread = prefix.explode_prefixes(v.search_query.select("query_norm").distinct())
    return spread.select(text.suggest_key(F.col("prefix")).alias("key")).distinct()


def supplier_nodes(v: TestViews) -> DataFrame:
    """A ring member per supplier."""
    spec = F.concat_ws(":", F.lit("host"), F.lit("6379"), F.col("s_nationkey").cast("string"))
    index = F.col("s_suppkey").cast("int")
    return v.table("supplier").select(index.alias("node_index"), ring.node_label(index, spec).alias("node"))


def flushed(v: TestViews) -> DataFrame:
    return fold.fold(fold.assign_flushes(v.search_event, FLUSH_EVENTS, FLUSH_SECONDS), fold.FLUSH)


def labelled(v: TestViews) -> DataFrame:
    """The searches as requests for their own text, each labelled as served or computed."""
    asked = v.search_event.select(F.col("event_id").alias("req_id"), "ts", "user_id", "query_norm")
    return expiry.label_hits(asked, "query_norm", TTL_MS)


# -- dictionary ---------------------------------------------------------------------------------

@query
def dictionary(v):
    return v.search_query


@query
def table_statistics(v):
    return reports.table_statistics(v.search_query)


@query
def best_of_norm(v):
    return trending.best_of_norm(v.search_query)


@query
def escape_like(v):
    escaped = text.escape_like(F.col("query"))
    return v.search_query.select("query", escaped.alias("escaped"))


@query
def overlong_words(v):
    """Words that are too long to be searches, by document."""
    length = text.utf16_length(F.col("w"))
    return v.all_words.where(v.overlong).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rejected"), F.sum(length).cast("bigint").alias("units"))


# -- completions --------------------------------------------------------------------------------

@query
def prefix_topk(v):
    return prefix.prefix_top(v.search_query, PREFIX)


@query
def wildcard_prefix_topk(v):
    return prefix.prefix_top(v.search_query, WILDCARD_PREFIX)


@query
def global_topk(v):
    return prefix.global_top(v.search_query)


@query
def norm_topk(v):
    both = [prefix.norm_top(v.search_query, PREFIX, how=how).withColumn("how", F.lit(how)) for how in ("max", "sum")]
    return both[0].unionByName(both[1])


@query
def all_prefix_topk(v):
    return prefix.all_prefix_top(v.search_query, cluster=not v.laid_out)


@query
def all_prefix_norm_topk(v):
    return prefix.all_prefix_norm_top(v.search_query, how="sum", cluster=True)


@query
def prefix_recency(v):
    top = prefix.prefix_recency(v.search_query, scores(v), PREFIX)
    return top.select("rank", "query", "count", r6("score"), r6("blended"))


@query
def prefix_recency_unpooled(v):
    top = prefix.prefix_recency(v.kept_query, scores(v), PREFIX, pool=None)
    return top.select("rank", "query", "count", r6("score"), r6("blended"))


@query
def all_prefix_recency(v):
    top = prefix.all_prefix_recency(v.search_query, scores(v), cluster=not v.laid_out)
    return top.select("prefix", "rank", "query", "count", r6("score"), r6("blended"))


@query
def all_prefix_recency_unpooled(v):
    top = prefix.all_prefix_recency(v.search_query, scores(v), pool=None, cluster=not v.laid_out)
    return top.select("prefix", "rank", "query", "count", r6("score"), r6("blended"))


def old_scores(v: TestViews) -> DataFrame:
    return trending.decayed_scores(v.search_event, MUCH_LATER, HOUR)


@query
def prefix_recency_old(v):
    """All scores have faded from a double's range; their order has not."""
    top = prefix.prefix_recency(v.search_query, old_scores(v), PREFIX)
    return top.select("rank", "query", "count", r6("blended"))


# -- scores and trending ------------------------------------------------------------------------

@query
def decayed_score(v):
    return scores(v).select("query_norm", r6("score"))


@query
def score_store(v):
    """Two halves of the log added to the stored scores one after the other, the second one twice."""
    store = ScoreStore(v.spark, work_dir(v.spark, "score-store"))
    store.add(v.search_event.where(F.col("ts") <= at(MIDDLE)), MIDDLE, HALF_LIFE, batch_id=0)
    for _ in range(2):
        store.add(v.search_event.where(F.col("ts") > at(MIDDLE)), AS_OF, HALF_LIFE, batch_id=1)
    return store.read().select("query_norm", r6("score"))


@query
def score_partials(v):
    partials = trending.score_partials(v.search_event, "1 day", HALF_LIFE)
    return partials.select("query_norm", micros("window_end", "window_end_us"), r6("partial"))


@query
def score_from_partials(v):
    partials = trending.score_partials(v.search_event, "1 hour", HALF_LIFE)
    return trending.scores_from_partials(partials, AS_OF, HALF_LIFE).select("query_norm", r6("score"))


@query
def score_reanchor(v):
    """Scores of two halves of the history, moved to one reference time and added."""
    early = trending.decayed_scores(v.search_event.where(F.col("ts") <= at(MIDDLE)), MIDDLE, HALF_LIFE)
    late = trending.decayed_scores(v.search_event.where(F.col("ts") > at(MIDDLE)), AS_OF, HALF_LIFE)
    return trending.add_scores(early, late, AS_OF, HALF_LIFE).select("query_norm", r6("score"))


def _list(df: DataFrame) -> DataFrame:
    return df.select("rank", "query", "display", "count", r6("score"), r6("blended"), "mode", "source")


@query
def trending_popularity(v):
    return trending.trending_popularity(v.search_query)


@query
def trending_recency(v):
    return _list(trending.trending_recency(v.search_query, scores(v)))


@query
def trending_recency_old(v):
    top = trending.trending_recency(v.search_query, old_scores(v))
    return top.select("rank", "query", "display", "count", r6("level"), r6("blended"), "mode", "source")


@query
def trending_cold_start(v):
    nothing = trending.decayed_scores(v.search_event, BEFORE_ALL, HALF_LIFE)
    return _list(trending.trending_recency(v.search_query, nothing))


@query
def trending_snapshots(v):
    partials = trending.score_partials(v.search_event, "1 day", HALF_LIFE)
    lists = trending.trending_snapshots(partials, v.search_query, *SNAPSHOTS, DAY, half_life=HALF_LIFE)
    return lists.select(
        micros("as_of", "as_of_us"), "rank", "query", "count", r6("score"), r6("blended"), "source"
    )


# -- events and counters ------------------------------------------------------------------------

@query
def validate_events(v):
    """Every line of every document as a search request."""
    asked = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "query"))
    checked = fold.check_requests(asked)
    return checked.select(
        "doc_id", "line_no", text.utf16_length(F.col("query")).alias("units"), F.coalesce("error", F.lit("")).alias("error")
    )


@query
def usable_events(v):
    """Events with some queries and displays missing."""
    raw = fold.to_event(v.raw_event.select("event_id", "ts", F.col("raw").alias("query")))
    holed = raw.withColumns({
        "q": F.when(F.col("event_id") % 17 != 0, F.col("q")), "d": F.when(F.col("event_id") % 5 != 0, F.col("d")),
    })
    return fold.usable_events(holed).select("event_id", "query_norm", "display")


@query
def event_log_days(v):
    """Searches appended to the log, partitioned by day, and read back."""
    path = work_dir(v.spark, "event-log")
    logged = v.search_event.select("event_id", "ts", F.col("query_norm").alias("q"), F.col("display").alias("d"))
    event_log.append_events(logged, path)
    back = event_log.read_events(v.spark, path)
    return back.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("q").alias("norms")
    )


@query
def flush_fold(v):
    return flushed(v).select(
        "flush_window", "flush_chunk", "query_norm", "delta", "display", micros("last_ts", "last_us")
    )


@query
def write_reduction(v):
    return fold.write_reduction(flushed(v))


@query
def requeue_merge(v):
    """The first flush of every window fails and is put back into the second one."""
    flushes = flushed(v)
    failed = flushes.where(F.col("flush_chunk") == 0).withColumn("flush_chunk", F.lit(1).cast("bigint"))
    waiting = flushes.where(F.col("flush_chunk") >= 1)
    merged = fold.requeue(waiting, failed, fold.FLUSH)
    return merged.select("flush_window", "flush_chunk", "query_norm", "delta", "display", micros("last_ts", "last_us"))


def _base(v: TestViews) -> DataFrame:
    return merge.as_dictionary(v.kept_query, at(LOADED_AT))


def _rows(stored: DataFrame) -> DataFrame:
    return stored.select(
        "query", "query_norm", "count", micros("last_searched_at", "last_us"), micros("created_at", "created_us")
    )


@query
def upsert_merge(v):
    return _rows(merge.upsert(_base(v), merge.deltas_as_rows(flushed(v))))


DAY_BATCHES = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


def _day_deltas(v: TestViews) -> list[DataFrame]:
    """The events of three spans of days, each folded to one batch of deltas."""
    bounds = [None, *map(at, DAY_BATCHES), None]
    spans = [(F.lit(True) if low is None else F.col("ts") >= low) & (F.lit(True) if high is None else F.col("ts") < high)
             for low, high in zip(bounds, bounds[1:])]
    return [materialize(merge.deltas_as_rows(fold.fold(v.search_event.where(span)))) for span in spans]


def _ranges(v: TestViews, root: str) -> DictionaryRanges:
    table = DictionaryRanges(v.spark, f"{root}/dictionary", target_rows=RANGE_ROWS)
    table.load(_base(v))
    return table


@query
def upsert_ranges(v):
    """Three batches merged into a dictionary kept in key ranges; each rewrites the ranges it meets."""
    table = _ranges(v, work_dir(v.spark, "upsert-ranges"))
    for batch_id, deltas in enumerate(_day_deltas(v)):
        table.upsert(deltas, batch_id)
    return _rows(table.read())


@query
def lists_after_changes(v):
    """The best completions of every prefix, kept up over three batches instead of ranked again."""
    root = work_dir(v.spark, "lists-after-changes")
    table = _ranges(v, root)
    lists = upkeep.PrefixLists(v.spark, f"{root}/lists", target_rows=10 * RANGE_ROWS)
    lists.build(table)
    for batch_id, deltas in enumerate(_day_deltas(v)):
        table.upsert(deltas, batch_id)
        lists.update(table, deltas, batch_id)
    return lists.lists()


@query
def load_last_wins(v):
    return merge.last_line_wins(v.query_line, ["line_no"]).select("query", "count", "line_no")


# -- query-count lines --------------------------------------------------------------------------

def _lines(v: TestViews) -> DataFrame:
    """Lines of all documents, and the dictionary written as lines."""
    written = lines.render(v.search_query).select(F.lit("rendered").alias("origin"), "line")
    prose = v.table("documents").select(F.lit("text").alias("origin"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.drop_blank(written.unionByName(prose))


@query
def missing_file(v):
    """Lines of a folder that is there and of one that is not."""
    root = work_dir(v.spark, "missing-file")
    lines.render(v.search_query).select("line").write.text(f"{root}/there")
    found = [lines.read_lines(v.spark, f"{root}/{name}").agg(F.count("line").alias("lines")).select(F.lit(name).alias("folder"), "lines")
             for name in ("there", "missing")]
    return found[0].unionByName(found[1])


@query
def parse_lines(v):
    return lines.accepted(lines.parse(_lines(v))).select("origin", "query", "count")


@query
def parse_rejects(v):
    left = lines.rejected(lines.parse(_lines(v)))
    return left.groupBy("origin").agg(
        F.count(F.lit(1)).alias("rejected"), F.sum(F.char_length("line")).cast("bigint").alias("characters")
    )


@query
def csv_round_trip(v):
    path = work_dir(v.spark, "csv")
    lines.write_query_counts(v.search_query, path)
    return lines.read_query_counts(v.spark, path).select("query", "count")


# -- stored lists -------------------------------------------------------------------------------

def _arcs(v: TestViews) -> DataFrame:
    return ring.build_arcs(ring.build_ring(ring.nodes_from_spec(v.spark, NODES_3)))


def _stored(v: TestViews, mode: str = "POPULARITY") -> DataFrame:
    if mode == "RECENCY":
        top = prefix.all_prefix_recency(v.kept_query, scores(v), cluster=not v.laid_out)
    else:
        top = prefix.all_prefix_top(v.kept_query, cluster=not v.laid_out)
    return serving.materialize_lists(top, _arcs(v), at(AS_OF), mode)


@query
def materialize_lists(v):
    return _stored(v).select("cache_key", "node", "value", micros("expires_at", "expires_us"))


@query
def materialize_lists_recency(v):
    return _stored(v, "RECENCY").select("cache_key", "node", "value", micros("expires_at", "expires_us"))


@query
def invalidate_keys(v):
    changed = v.search_event.where(F.col("ts") >= at(CHANGED_SINCE)).select("query_norm")
    return serving.invalidate(_stored(v), changed).select("cache_key", "value")


def _requests(v: TestViews) -> DataFrame:
    """The request log with modes in mixed spelling and some blank prefixes."""
    turn = F.col("req_id") % 4
    mode = F.when(turn == 0, "Recency").when(turn == 1, "popularity").when(turn == 2, "other")
    asked = F.when(F.col("req_id") % 11 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.upper("prefix")))
    return v.request_log.select("req_id", asked.alias("q"), mode.alias("mode"))


@query
def resolve_requests(v):
    asked = _requests(v).withColumn("trending_mode", text.trending_mode(F.col("mode")))
    return serving.resolve(asked).select(
        "req_id", "prefix", "mode", "trending_mode", F.coalesce("cache_key", F.lit("-")).alias("cache_key")
    )


@query
def materialized_else_compute(v):
    """All lists of both modes are stored; those with keys of odd length have run out."""
    stored = _stored(v).unionByName(_stored(v, "RECENCY"))
    odd = F.char_length("cache_key") % 2 == 1
    stored = stored.withColumn("expires_at", F.when(odd, at(AS_OF)).otherwise(F.col("expires_at")))
    answered = serving.answer(_requests(v), stored, v.kept_query, scores(v), at(AS_OF))
    return answered.select("req_id", "prefix", "mode", "source", "value")


@query
def list_store_answers(v):
    """As ``materialized_else_compute``, the lists being stored by key and read from there."""
    stored = _stored(v).unionByName(_stored(v, "RECENCY"))
    odd = F.char_length("cache_key") % 2 == 1
    store = ListStore(v.spark, work_dir(v.spark, "list-store"), buckets=8)
    store.write(stored.withColumn("expires_at", F.when(odd, at(AS_OF)).otherwise(F.col("expires_at"))))
    answered = serving.answer(_requests(v), store.read(), v.kept_query, scores(v), at(AS_OF))
    return answered.select("req_id", "prefix", "mode", "source", "value")


@query
def suggest_batch(v):
    answered = serving.suggest_batch(_requests(v), v.search_query, scores(v), _arcs(v))
    return answered.select("req_id", "prefix", "mode", "source", F.coalesce("node", F.lit("-")).alias("node"), "value")


@query
def ttl_refresh(v):
    return labelled(v).select("req_id", "query_norm", "source")


@query
def hit_rate(v):
    return reports.hit_rate(labelled(v))


@query
def store_traffic(v):
    return reports.store_traffic(labelled(v), flushed(v))


# -- placement ----------------------------------------------------------------------------------

@query
def ring_table(v):
    return ring.build_ring(supplier_nodes(v)).select("pos", "node_index", "node")


@query
def ring_arcs(v):
    return ring.build_arcs(ring.build_ring(supplier_nodes(v))).select("lo", "hi", "closed", "node")


@query
def ring_assign(v):
    arcs = ring.build_arcs(ring.build_ring(supplier_nodes(v)))
    return ring.assign(prefix_keys(v), arcs).select("key", "pos", "node")


@query
def keys_per_node(v):
    nodes = supplier_nodes(v)
    assigned = ring.assign(prefix_keys(v), ring.build_arcs(ring.build_ring(nodes)))
    return ring.keys_per_node(assigned, nodes)


@query
def ring_balance(v):
    spread = ring.balance(prefix_keys(v), ring.nodes_from_spec(v.spark, NODES_3), REPLICAS)
    return spread.select(
        "replicas", "nodes", "keys", "max_keys", "min_keys", r6("relative_spread"), r6("max_over_mean")
    )


@query
def ring_remap(v):
    old, new = ring.nodes_from_spec(v.spark, NODES_3), ring.nodes_from_spec(v.spark, NODES_4)
    return ring.remap(prefix_keys(v), old, new).select(
        "keys", "ring_moved", "modulo_moved", r6("ring_share"), r6("modulo_share")
    )


@query
def placement_report(v):
    asked = v.request_log.select("prefix").distinct()
    report = ring.placement(asked, ring.nodes_from_spec(v.spark, NODES_3), _stored(v), at(AS_OF))
    return report.withColumn("ring", F.to_json("ring"))


# -- request replays and latency ----------------------------------------------------------------

@query
def debounce(v):
    return replay.debounce(v.request_log, DEBOUNCE).select("req_id", "user_id", "prefix")


@query
def superseded(v):
    """Latencies are taken as minutes, as the test requests lie minutes apart."""
    slow = v.request_log.withColumn("took_ms", F.col("took_ms") * 60_000)
    return replay.mark_superseded(slow).select("req_id", "superseded")


@query
def latency_percentiles(v):
    log = v.request_log.withColumn("phase", F.when(F.col("req_id") % 2 == 0, "cold").otherwise("warm"))
    both = reports.latencies(log, ["floor_n", "floor_n_1"], by=["phase"])
    return both.select("rule", "phase", "n", "p50", "p95", "p99", r6("mean"))


# Groups beyond the bound, some with a null key.

def _nulled(v: TestViews, column: str) -> DataFrame:
    return v.request_log.withColumn(column, F.when(F.col("req_id") % 3 != 0, F.col(column)))


@query
def debounce_large(v):
    kept = replay.debounce(_nulled(v, "user_id"), DEBOUNCE, max_group_rows=SMALL_GROUP)
    return kept.select("req_id", F.coalesce("user_id", F.lit(-1).cast("bigint")).alias("user_id"), "prefix")


@query
def latency_large(v):
    log = v.request_log.withColumn("phase", F.when(F.col("req_id") % 3 == 0, "cold").when(F.col("req_id") % 3 == 1, "warm"))
    both = reports.latencies(log, ["floor_n", "floor_n_1"], by=["phase"], max_group_rows=SMALL_GROUP)
    return both.select("rule", F.coalesce("phase", F.lit("-")).alias("phase"), "n", "p50", "p95", "p99", r6("mean"))


@query
def ttl_large(v):
    filled = expiry.refills(_nulled(v, "prefix"), "prefix", TTL_MS, task_entries=SMALL_GROUP)
    return filled.select(F.coalesce("prefix", F.lit("-")).alias("prefix"), "filled_ms", "req_id")


# -- streams ------------------------------------------------------------------------------------

def _event_stream(v: TestViews, late: bool = False, closing: bool = False) -> DataFrame:
    """The event table as a log of several files in order of time, one to a micro-batch.

    Searches are named from the dictionary as in the views. With ``late`` every tenth event comes in the
    last file, with ``closing`` two files with an event of user -1, a year and two years later, end the log.
    """
    table = v.table("events")
    path = work_dir(v.spark, "event-files")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = table.agg(F.min(at), F.max(at)).first()
    for part in range(LOG_FILES):
        low, high = (first + (last + 1 - first) * n // LOG_FILES for n in (part, part + 1))
        inside = (at >= low) & (at < high)
        if late:
            held = F.col("event_id") % 10 == 0
            inside = (inside | held) if part == LOG_FILES - 1 else inside & ~held
        table.where(inside).coalesce(1).write.mode("append").parquet(f"{path}/part={part}")
    if closing:
        # A watermark holds from the batch after the one that moved it.
        end = table.orderBy(F.desc("ts")).limit(1).withColumn("user_id", F.lit(-1).cast("bigint"))
        for year in (1, 2):
            later = end.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {365 * year} DAYS"))
            later.coalesce(1).write.parquet(f"{path}/part={LOG_FILES + year}")
    stream = v.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    return searched_queries(stream, materialize(v.search_query))


@query
def stream_fold(v):
    """Dictionary loaded, events streamed in, base and deltas compacted, all read back."""
    root = work_dir(v.spark, "stream-fold")
    store = DictionaryStore(v.spark, f"{root}/dictionary")
    store.load_if_empty(_base(v))
    events = fold.to_event(_event_stream(v).select("event_id", "ts", F.col("raw").alias("query")))
    jobs.maintain_counts(events, store, f"{root}/checkpoint", drain=True).awaitTermination()
    store.compact()
    merged = store.read()
    # Which variant a fold credits depends on the batches; its normal form's total does not.
    return merged.groupBy("query_norm").agg(
        F.sum("count").alias("count"), F.max(F.unix_micros("last_searched_at")).alias("last_us"),
        F.min(F.unix_micros("created_at")).alias("created_us"),
    )


@query
def stream_fold_replayed(v):
    """All batches run twice, as after the loss of a checkpoint."""
    root = work_dir(v.spark, "stream-replay")
    store = DictionaryStore(v.spark, f"{root}/dictionary")
    events = fold.to_event(_event_stream(v).select("event_id", "ts", F.col("raw").alias("query")))
    for run in range(2):
        jobs.maintain_counts(events, store, f"{root}/checkpoint-{run}", drain=True).awaitTermination()
    return store.read().groupBy("query_norm").agg(F.sum("count").alias("count"))


@query
def stream_retry(v):
    """A batch that fails when it is published, and the same stream started again."""
    root = work_dir(v.spark, "stream-retry")
    store, broken = (kind(v.spark, f"{root}/dictionary") for kind in (DictionaryStore, FailingStore))
    events = fold.to_event(_event_stream(v).select("event_id", "ts", F.col("raw").alias("query")))
    try:
        jobs.maintain_counts(events, broken, f"{root}/checkpoint", drain=True).awaitTermination()
    except StreamingQueryException as problem:
        if FailingStore.MESSAGE not in str(problem):
            raise
    jobs.maintain_counts(events, store, f"{root}/checkpoint", drain=True).awaitTermination()
    return store.read().groupBy("query_norm").agg(F.sum("count").alias("count"))


class FailingStore(DictionaryStore):
    """Publishes the first batch and no other."""

    MESSAGE = "the second batch is lost"

    def commit(self, deltas: DataFrame, batch_id: int) -> None:
        if batch_id:
            raise RuntimeError(self.MESSAGE)
        super().commit(deltas, batch_id)


@query
def stream_score(v):
    root = work_dir(v.spark, "stream-score")
    store = jobs.PartialStore(v.spark, f"{root}/partials")
    events = fold.to_event(_event_stream(v).select("event_id", "ts", F.col("raw").alias("query")))
    jobs.maintain_scores(
        events, store, f"{root}/checkpoint", half_life=HALF_LIFE, drain=True
    ).awaitTermination()
    return trending.scores_from_partials(store.read(), AS_OF, HALF_LIFE).select("query_norm", r6("score"))


@query
def stream_refills(v):
    root = work_dir(v.spark, "stream-refills")
    store = jobs.EntryStore(v.spark, root)
    asked = as_requests(_event_stream(v)).select("req_id", "ts", "prefix")
    jobs.track_entries(asked, store, f"{root}/checkpoint", "prefix", TTL_MS, drain=True).awaitTermination()
    return store.filled("prefix string, filled_ms bigint, req_id bigint").select("prefix", "filled_ms", "req_id")


@query
def stream_refills_state(v):
    """As ``stream_refills``, with the entries' ends in Spark's state."""
    root = work_dir(v.spark, "stream-refills-state")
    asked = as_requests(_event_stream(v)).select("req_id", "ts", "prefix")
    filled = entries.refills_in_state(asked, "prefix", TTL_MS)
    filled.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet").start(
        f"{root}/filled").awaitTermination()
    return v.spark.read.schema(filled.schema).parquet(f"{root}/filled")


@query
def stream_debounce(v):
    """As ``debounce``, by sessions over several micro-batches."""
    root = work_dir(v.spark, "stream-debounce")
    asked = as_requests(_event_stream(v, closing=True))
    kept = sessions.debounce_stream(asked, DEBOUNCE, "1 hour").select("req_id", "user_id", "prefix")
    kept.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet").start(
        f"{root}/kept").awaitTermination()
    # Only now: a filter on the stream would be pushed below the watermark, which the last events must move.
    return v.spark.read.schema(kept.schema).parquet(f"{root}/kept").where("user_id <> -1")


@query
def stream_superseded(v):
    root = work_dir(v.spark, "stream-superseded")
    store = sessions.HeldRequests(v.spark, root)
    asked = as_requests(_event_stream(v)).withColumn("took_ms", F.col("took_ms") * 60_000)
    sessions.maintain_superseded(asked, store, f"{root}/checkpoint", 3600.0, drain=True).awaitTermination()
    return store.read(ended=True).select("req_id", "superseded")


def _late_sums(v: TestViews) -> rankings.WindowSums:
    root = work_dir(v.spark, "stream-late")
    store = rankings.WindowSums(v.spark, root)
    events = fold.to_event(_event_stream(v, late=True).select("event_id", "ts", F.col("raw").alias("query")))
    rankings.maintain_sums(events, store, f"{root}/checkpoint", "1 hour", 3600.0, HALF_LIFE, drain=True).awaitTermination()
    return store


@query
def stream_late_events(v):
    """Events that came after their window had been closed, by query."""
    late = _late_sums(v).late.read()
    return late.groupBy("query_norm").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query
def stream_late_scores(v):
    """Scores of a log with late events, after their windows have been reopened."""
    store = _late_sums(v)
    store.backfill("1 hour", HALF_LIFE)
    store.compact()
    return trending.scores_from_partials(store.read(), AS_OF, HALF_LIFE).select("query_norm", r6("score"))


@query
def stream_snapshots(v):
    """As ``trending_snapshots``, written while events stream in, some of them late."""
    root = work_dir(v.spark, "stream-snapshots")
    store = rankings.SnapshotStore(v.spark, root)
    events = fold.to_event(_event_stream(v, late=True).select("event_id", "ts", F.col("raw").alias("query")))
    rankings.maintain_snapshots(
        events, materialize(v.search_query), store, f"{root}/checkpoint", SNAPSHOTS[0], DAY, half_life=HALF_LIFE, drain=True, last=SNAPSHOTS[1])
    # Sums of sums differ in their last bits, and by 1e-8 in shares made of levels with eight places.
    return store.read().select(
        micros("as_of", "as_of_us"), "rank", "query", "count", r6("score"), F.round("blended", 4).alias("blended"), "source")


@query
def polled_flushes(v):
    """The event table as a numbered log, read in polls and folded by flushes of two polls."""
    root = work_dir(v.spark, "polled-flushes")
    log = EventLog(v.spark, f"{root}/log")
    log.append(v.search_event.select("event_id", "ts", F.col("query_norm").alias("q"), F.col("display").alias("d")), 0)
    store = jobs.FlushStore(v.spark, f"{root}/flushes")
    jobs.maintain_flushes(log.stream(max_events=POLL, max_polls=BACKLOG_POLLS), store, f"{root}/checkpoint", 2 * POLL, drain=True)
    return store.read().select("flush", "query_norm", "delta", "display", micros("last_ts", "last_us"))


# -- sketches and SQL functions -----------------------------------------------------------------

def _quarters(v: TestViews) -> list[DataFrame]:
    return [v.request_log.where(F.col("req_id") % LOG_FILES == n) for n in range(LOG_FILES)]


@query
def latency_sketch(v):
    """Whether quantiles merged from sketches of four batches are within their bound of the exact ones."""
    store = LatencySketches(v.spark, work_dir(v.spark, "latency-sketches"), ["phase"])
    phase = F.when(F.col("req_id") % 3 == 0, "cold").otherwise("warm")
    for batch_id, part in enumerate(_quarters(v)):
        store.add(part.withColumn("phase", phase), batch_id)
    found = store.quantiles().select("phase", "n", F.explode(F.map_from_arrays(
        F.array(*[F.lit(q) for q in reports.QUANTILES]), F.array(*[f"p{round(q * 100)}" for q in reports.QUANTILES]))).alias("q", "estimate"))
    met = v.request_log.withColumn("phase", phase).join(F.broadcast(found), "phase").groupBy("phase", "n", "q").agg(
        F.avg((F.col("took_ms") < F.col("estimate")).cast("double")).alias("below"),
        F.avg((F.col("took_ms") <= F.col("estimate")).cast("double")).alias("upto"))
    bound = rank_bound(KLL_CHECKED)
    return met.select("phase", "q", "n", ((F.col("below") <= F.col("q") + bound) & (F.col("upto") >= F.col("q") - bound)).alias("within"))


@query
def distinct_sketch(v):
    """Whether distinct words merged from sketches of four batches are within their bound of the exact count."""
    store = DistinctSketches(v.spark, work_dir(v.spark, "distinct-sketches"))
    words = v.doc_word.select("doc_id", text.normalize(F.col("w")).alias("query_norm"))
    for n in range(LOG_FILES):
        store.add(words.where(F.col("doc_id") % LOG_FILES == n), n)
    spans = [("first two", None, 1), ("last two", 1, None), ("all", None, None)]
    parts = []
    for name, after, through in spans:
        part = F.col("doc_id") % LOG_FILES
        inside = words.where((part > (-1 if after is None else after)) & (part <= (LOG_FILES if through is None else through)))
        exact = inside.agg(F.count_distinct("query_norm").alias("exact"))
        off = F.abs(F.col("n_distinct") - F.col("exact")) <= F.col("exact") * distinct_bound()
        parts.append(store.count(after, through).join(exact).select(F.lit(name).alias("span"), "n", "exact", off.alias("within")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def sql_suggest(v):
    """The table function over several prefixes and both modes."""
    sql.register(v.spark, materialize(v.search_query), materialize(scores(v)))
    calls = [(p, m) for p in (PREFIX, WILDCARD_PREFIX, " Th ", "") for m in ("popularity", "RECENCY")]
    return v.spark.sql(" UNION ALL ".join(
        f"SELECT '{p}' AS prefix, '{m}' AS mode, * FROM suggest('{p}', '{m}', 10)" for p, m in calls))


@query
def sql_trending(v):
    sql.register(v.spark, materialize(v.search_query), materialize(scores(v)))
    return v.spark.sql("SELECT * FROM trending() UNION ALL SELECT * FROM trending('popularity', 5)")
