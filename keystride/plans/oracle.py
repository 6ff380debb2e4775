"""The same questions in DuckDB's SQL, written independently of the Spark code."""

from __future__ import annotations

# -- shared pieces ------------------------------------------------------------------------------

ENDS = r"'^[\x00-\x20]+|[\x00-\x20]+$'"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {ENDS}, '', 'g')"


def norm(text: str) -> str:
    return "lower(" + trimmed(f"coalesce({text}, '')") + ")"


def position(key: str) -> str:
    """First 64 bits of MD5 as a signed integer."""
    bits = f"('0x' || substr(md5({key}), 1, 16))::UBIGINT::HUGEINT"
    return f"(CASE WHEN {bits} >= 9223372036854775808 THEN {bits} - 18446744073709551616 ELSE {bits} END)::BIGINT"


PIECES = {
    "doc_word": r"""
        SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n\t]+')) AS w FROM documents)
        WHERE w <> '' AND NOT (length(w) + length(regexp_replace(w, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) > 512""",
    "search_query": f"""
        SELECT w AS query, {norm('w')} AS query_norm, count(*) AS "count" FROM doc_word GROUP BY w""",
    "frequent": """
        SELECT query, row_number() OVER (ORDER BY "count" DESC, query) - 1 AS k FROM search_query""",
    "raw_event": """
        SELECT e.event_id, e.ts, epoch_us(e.ts) AS us, e.user_id, e.value,
               CASE e.event_id % 3 WHEN 0 THEN upper(f.query) WHEN 1 THEN '  ' || f.query ELSE f.query END AS raw
        FROM events e JOIN frequent f ON f.k = json_extract_string(e.props, '$.k')::INT""",
    "search_event": f"""
        SELECT event_id, ts, us, user_id, {norm('raw')} AS query_norm, {trimmed('raw')} AS display FROM raw_event""",
    "request_log": f"""
        SELECT event_id AS req_id, ts, us, user_id, substr({norm('raw')}, 1, (1 + event_id % 3)::INT) AS prefix,
               value AS took_ms FROM raw_event""",
    "query_line": """
        SELECT doc_id AS line_no, w AS query, count(*) AS "count" FROM doc_word GROUP BY doc_id, w""",
    "score": """
        SELECT query_norm, sum(exp(-((epoch_us(TIMESTAMP '2024-01-31') - us) / 1e6) * ln(2) / 259200.0)) AS score
        FROM search_event WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY query_norm""",
    "settled": "SELECT query_norm, score, round(log2(score), 8) AS level FROM score",
    # As seen 60 days later at a half-life of an hour: relative to each query's newest search.
    "settled_old": """
        SELECT query_norm, 0.0::DOUBLE AS score, round(log2(sum(pow(2, -((top - us) / 1e6) / 3600.0)))
               - (epoch_us(TIMESTAMP '2024-03-31') - max(top)) / 1e6 / 3600.0, 8) AS level
        FROM (SELECT *, max(us) OVER (PARTITION BY query_norm) AS top FROM search_event) GROUP BY query_norm""",
    "spread": """
        SELECT substr(query_norm, 1, i::INT) AS prefix, q.* EXCLUDE (i)
        FROM (SELECT *, unnest(range(1, length(query_norm) + 1)) AS i FROM search_query) q""",
    "all_top": """
        SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY "count" DESC, query)::INT AS rank, query, "count"
        FROM spread QUALIFY rank <= 10""",
    "all_pooled": """
        SELECT s.prefix, s.query, s."count", coalesce(r.score, 0) AS score, r.level FROM (
            SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY "count" DESC, query) AS n FROM spread QUALIFY n <= 50
        ) s LEFT JOIN settled r USING (query_norm)""",
    "all_unpooled": """
        SELECT s.prefix, s.query, s."count", coalesce(r.score, 0) AS score, r.level
        FROM spread s LEFT JOIN settled r USING (query_norm)""",
    "all_recency": None,
    "flush": """
        SELECT *, (row_number() OVER (PARTITION BY flush_window ORDER BY ts, event_id) - 1) // 100 AS flush_chunk
        FROM (SELECT *, (us - us % 86400000000) // 1000000 AS flush_window FROM search_event)""",
    "folded": """
        SELECT flush_window, flush_chunk, query_norm, count(*) AS delta,
               arg_min(display, (us, event_id)) AS display, max(us) AS last_us
        FROM flush GROUP BY flush_window, flush_chunk, query_norm""",
    "nodes3": "SELECT i::INT AS node_index, 'node-' || i || ' (localhost:6379/' || i || ')' AS node FROM range(3) t(i)",
    "nodes4": "SELECT i::INT AS node_index, 'node-' || i || ' (localhost:6379/' || i || ')' AS node FROM range(4) t(i)",
    "supplier_nodes": """
        SELECT s_suppkey::INT AS node_index, 'node-' || s_suppkey || ' (host:6379/' || s_nationkey || ')' AS node
        FROM supplier""",
    "prefix_keys": """
        SELECT DISTINCT 'suggest:' || substr(query_norm, 1, i::INT) AS key
        FROM (SELECT query_norm, unnest(range(1, length(query_norm) + 1)) AS i FROM search_query)""",
    "hits": """
        SELECT event_id AS req_id, query_norm, CASE WHEN event_id IN (SELECT req_id FROM refill) THEN 'COMPUTED'
               ELSE 'CACHE' END AS source FROM search_event""",
}


def blended(source: str, by: str, columns: str, tie: str, size: int, extra: str = "") -> str:
    """Blend, rank and cut a candidate set; ``by`` is a PARTITION BY clause or empty."""
    return f"""
        SELECT *, row_number() OVER ({by} ORDER BY blended DESC, {tie})::INT AS rank FROM (
            SELECT {columns}, round(0.5 * ("count"::DOUBLE / greatest(1, max("count") OVER ({by})))
                + 0.5 * coalesce(round(pow(2, level - max(level) OVER ({by})), 12), 0), 12) AS blended
            FROM {source} {extra}) QUALIFY rank <= {size}"""


PIECES["all_recency"] = blended("all_pooled", "PARTITION BY prefix", 'prefix, query, "count", score, level', '"count" DESC, query', 10)


def ring_of(nodes: str, replicas: str = "150") -> str:
    return f"""
        SELECT pos, arg_max(node_index, node_index * 100000 + v) AS node_index,
               arg_max(node, node_index * 100000 + v) AS node
        FROM (SELECT {position("node || '#vn' || v")} AS pos, node_index, node, v
              FROM {nodes}, range({replicas}) t(v)) GROUP BY pos"""


def owners(keys: str, ring: str) -> str:
    """``key, pos, node`` for a table of keys."""
    return f"""
        SELECT k.*, coalesce(r.node, (SELECT arg_min(node, pos) FROM {ring})) AS node
        FROM (SELECT *, {position('key')} AS pos FROM {keys}) k ASOF LEFT JOIN {ring} r ON k.pos <= r.pos"""


def refill_of(requests: str, key: str, same: str = "=") -> str:
    """Recursive: next pointers by a range frame, then the chain from each key's first request."""
    return f"""
        once AS (SELECT {key} AS key, us // 1000 AS ms, min(req_id) AS req_id FROM {requests} GROUP BY ALL),
        pointer AS (SELECT key, ms, min(ms) OVER (PARTITION BY key ORDER BY ms
                    RANGE BETWEEN 21600000 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM once),
        chain AS (SELECT key, min(ms) AS ms FROM once GROUP BY key
                  UNION ALL
                  SELECT c.key, p.following FROM chain c JOIN pointer p ON p.key {same} c.key AND p.ms = c.ms
                  WHERE p.following IS NOT NULL),
        refill AS (SELECT c.key, c.ms, o.req_id FROM chain c JOIN once o ON o.key {same} c.key AND o.ms = c.ms)"""


def sql(body: str, pieces: str = "", tail: str = "", recursive: str = "") -> str:
    """A statement with the named shared pieces in front, ``tail`` holding CTEs of its own."""
    named = [f"{name} AS ({PIECES[name]})" for name in pieces.split()]
    parts = [p for p in (*named, recursive, tail) if p]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


WORDS = "doc_word search_query"
EVENTS = f"{WORDS} frequent raw_event search_event"
SCORES = f"{EVENTS} score settled"
REQUESTS = f"{WORDS} frequent raw_event request_log"
FLUSHES = f"{EVENTS} flush folded"
REFILL = refill_of("(SELECT event_id AS req_id, * FROM search_event)", "query_norm")

BEST = """SELECT query_norm, arg_min(query, (-"count", query)) AS display, max("count") AS "count"
          FROM search_query GROUP BY query_norm"""
DAY_FOLDS = """
    day_fold AS (
        SELECT (ts >= TIMESTAMP '2024-01-10')::INT + (ts >= TIMESTAMP '2024-01-20')::INT AS batch, query_norm,
               count(*) AS delta, arg_min(display, (us, event_id)) AS display, max(us) AS last_us
        FROM search_event GROUP BY ALL),
    merged AS (
        SELECT query, arg_min(query_norm, created_us) AS query_norm, sum("count")::BIGINT AS "count",
               max(last_us) AS last_us, min(created_us) AS created_us
        FROM (SELECT query, query_norm, "count", epoch_us(TIMESTAMP '2024-01-01') AS last_us,
                     epoch_us(TIMESTAMP '2024-01-01') AS created_us FROM search_query
              UNION ALL SELECT display, query_norm, delta, last_us, last_us FROM day_fold) GROUP BY query)"""
LIST_JSON = """to_json(list({'query': query, 'count': "count"} ORDER BY rank))::VARCHAR"""


def prefix_top(prefix: str, source: str = "search_query", name: str = "query", column: str = "query_norm") -> str:
    return f"""SELECT row_number() OVER (ORDER BY "count" DESC, {name})::INT AS rank, {name} AS query, "count"
        FROM {source} WHERE starts_with({column}, '{prefix}') QUALIFY rank <= 10"""


def prefix_blend(pool: int | None, settled: str = "settled") -> str:
    cut = f'QUALIFY row_number() OVER (ORDER BY "count" DESC, query) <= {pool}' if pool else ""
    cands = f"""cands AS (SELECT * FROM search_query WHERE starts_with(query_norm, 'th') {cut}),
        scored AS (SELECT query, "count", coalesce(score, 0) AS score, level FROM cands LEFT JOIN {settled} USING (query_norm)),
        done AS ({blended('scored', '', 'query, "count", score, level', '"count" DESC, query', 10)})"""
    if settled != "settled":
        return sql("""SELECT rank, query, "count", round(blended, 6) AS blended FROM done""", f"{EVENTS} {settled}", cands)
    return sql("""SELECT rank, query, "count", round(score, 6) AS score, round(blended, 6) AS blended FROM done""",
               SCORES, cands)


def trending_with(score_filter: str, settled: str = "settled") -> str:
    tail = f"""
        visible AS (SELECT * FROM {settled} WHERE {score_filter}),
        leaders AS (SELECT query_norm, score, level FROM visible ORDER BY level DESC, query_norm DESC LIMIT 30),
        best AS ({BEST}),
        scored AS (SELECT l.query_norm, b.display, coalesce(b."count", 0) AS "count", l.score, l.level
                   FROM leaders l LEFT JOIN best b USING (query_norm)),
        hot AS ({blended('scored', '', 'query_norm, display, "count", score, level', 'level DESC, query_norm DESC', 10)}),
        cold AS (SELECT row_number() OVER (ORDER BY "count" DESC, query)::INT AS rank, query, "count" FROM search_query
                 WHERE NOT EXISTS (SELECT 1 FROM visible) QUALIFY rank <= 10)"""
    if settled != "settled":
        return sql("""SELECT rank, query_norm AS query, display, "count", round(level, 6) AS level, round(blended, 6) AS blended,
            'RECENCY' AS mode, 'COMPUTED' AS source FROM hot""", f"{EVENTS} {settled}", tail)
    return sql("""
        SELECT rank, query_norm AS query, display, "count", round(score, 6) AS score, round(blended, 6) AS blended,
               'RECENCY' AS mode, 'COMPUTED' AS source FROM hot
        UNION ALL
        SELECT rank, query, query, "count", 0.0::DOUBLE, 0.0::DOUBLE, 'RECENCY', 'FALLBACK_POPULARITY' FROM cold
        """, SCORES, tail)


def percentile(rule: str, pick: str) -> str:
    cols = ", ".join(
        f"coalesce(max(CASE WHEN i = {pick.format(q=q)} THEN took_ms END), 0) AS {name}"
        for q, name in ((0.50, "p50"), (0.95, "p95"), (0.99, "p99"))
    )
    return f"""SELECT '{rule}' AS rule, phase, max(n) AS n, {cols}, round(avg(took_ms), 6) AS mean
               FROM numbered GROUP BY phase"""


TEXT_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"
QUOTED = """CASE WHEN contains(query, ',') OR contains(query, '"') THEN '"' || replace(query, '"', '""') || '"'
            ELSE query END"""
PARSED = f"""
    line AS (
        SELECT 'rendered' AS origin, {QUOTED} || ',' || "count" AS line FROM search_query
        UNION ALL SELECT 'text', line FROM ({TEXT_LINES})),
    cut AS (SELECT origin, line, contains(line, ',') AS comma, regexp_extract(line, '([^,]*)$', 1) AS tail
            FROM line WHERE regexp_matches(line, '\\S')),
    head AS (SELECT *, left(line, length(line) - length(tail) - 1) AS head, {trimmed('tail')} AS number FROM cut),
    bare AS (SELECT *, {trimmed('head')} AS b,
                    CASE WHEN regexp_full_match(number, '[+-]?[0-9]+') THEN try_cast(number AS BIGINT) END AS n FROM head),
    parsed AS (SELECT origin, line, n, comma AND length(head) > 0 AND n IS NOT NULL AS good,
                      CASE WHEN length(b) >= 2 AND starts_with(b, '"') AND ends_with(b, '"')
                           THEN replace(substr(b, 2, length(b) - 2), '""', '"') ELSE b END AS query FROM bare)"""

ASKED = f"""
    asked AS (
        SELECT req_id, CASE WHEN req_id % 11 = 0 THEN '' ELSE prefix END AS prefix,
               CASE WHEN req_id % 4 = 0 THEN 'RECENCY' ELSE 'POPULARITY' END AS mode,
               CASE WHEN req_id % 4 = 1 THEN 'POPULARITY' ELSE 'RECENCY' END AS trending_mode FROM request_log)"""

ORACLE: dict[str, str] = {
    "dictionary": sql('SELECT query, query_norm, "count" FROM search_query', WORDS),
    "table_statistics": sql("""SELECT count(*) AS rows, count(DISTINCT query_norm) AS norms,
        sum("count")::BIGINT AS total FROM search_query""", WORDS),
    "best_of_norm": sql(BEST, WORDS),
    "escape_like": sql(r"""SELECT query, replace(replace(replace(query, '\', '\\'), '%', '\%'), '_', '\_') AS escaped
        FROM search_query""", WORDS),
    "overlong_words": r"""SELECT doc_id, count(*) AS rejected, sum(units)::BIGINT AS units
        FROM (SELECT doc_id, length(w) + length(regexp_replace(w, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units
              FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n\t]+')) AS w FROM documents))
        WHERE units > 512 GROUP BY doc_id""".replace("\\\\", "\\"),
    "prefix_topk": sql(prefix_top("th"), WORDS),
    "wildcard_prefix_topk": sql(prefix_top("of%"), WORDS),
    "global_topk": sql(prefix_top(""), WORDS),
    "norm_topk": sql(f"""
        SELECT *, 'max' AS how FROM ({prefix_top('th', 'm')}) UNION ALL
        SELECT *, 'sum' AS how FROM ({prefix_top('th', 's')})""", WORDS, """
        m AS (SELECT query_norm AS query, query_norm, max("count") AS "count" FROM search_query GROUP BY query_norm),
        s AS (SELECT query_norm AS query, query_norm, sum("count")::BIGINT AS "count" FROM search_query GROUP BY query_norm)"""),
    "all_prefix_topk": sql("SELECT * FROM all_top", f"{WORDS} spread all_top"),
    "all_prefix_norm_topk": sql("""
        SELECT substr(query, 1, i::INT) AS prefix,
               row_number() OVER (PARTITION BY substr(query, 1, i::INT) ORDER BY "count" DESC, query)::INT AS rank,
               query, "count" FROM (SELECT *, unnest(range(1, length(query) + 1)) AS i FROM s) QUALIFY rank <= 10""", WORDS, """
        s AS (SELECT query_norm AS query, sum("count")::BIGINT AS "count" FROM search_query GROUP BY query_norm)"""),
    "prefix_recency": prefix_blend(50),
    "prefix_recency_unpooled": prefix_blend(None),
    "prefix_recency_old": prefix_blend(50, "settled_old"),
    "trending_recency_old": trending_with("true", "settled_old"),
    "all_prefix_recency": sql("""SELECT prefix, rank, query, "count", round(score, 6) AS score,
        round(blended, 6) AS blended FROM all_recency""", f"{SCORES} spread all_pooled all_recency"),
    "all_prefix_recency_unpooled": sql(
        """SELECT prefix, rank, query, "count", round(score, 6) AS score, round(blended, 6) AS blended FROM done""",
        f"{SCORES} spread all_unpooled", "done AS (" + blended(
            "all_unpooled", "PARTITION BY prefix", 'prefix, query, "count", score, level', '"count" DESC, query', 10) + ")"),
    "decayed_score": sql("SELECT query_norm, round(score, 6) AS score FROM score", f"{EVENTS} score"),
    "score_partials": sql("""
        SELECT query_norm, (day + 1) * 86400000000 AS window_end_us,
               round(sum(pow(2, -(((day + 1) * 86400000000 - us) / 1e6) / 259200.0)), 6) AS partial
        FROM (SELECT *, us // 86400000000 AS day FROM search_event) GROUP BY query_norm, day""", EVENTS),
    "score_from_partials": sql("SELECT query_norm, round(score, 6) AS score FROM score", f"{EVENTS} score"),
    "score_reanchor": sql("SELECT query_norm, round(score, 6) AS score FROM score", f"{EVENTS} score"),
    "trending_popularity": sql(f"SELECT *, 'POPULARITY' AS mode, 'COMPUTED' AS source FROM ({prefix_top('')})", WORDS),
    "trending_recency": trending_with("true"),
    "trending_cold_start": trending_with("false"),
    "trending_snapshots": sql("""
        SELECT as_of_us, rank, query_norm AS query, "count", round(score, 6) AS score, round(blended, 6) AS blended,
               'COMPUTED' AS source FROM done
        UNION ALL
        SELECT as_of_us, rank, query, "count", 0.0::DOUBLE, 0.0::DOUBLE, 'FALLBACK_POPULARITY' FROM moment, top
        WHERE as_of_us NOT IN (SELECT as_of_us FROM seen)""", EVENTS, f"""
        moment AS (SELECT epoch_us(TIMESTAMP '2023-12-31') + i * 86400000000 AS as_of_us FROM range(32) t(i)),
        top AS ({prefix_top('')}),
        seen AS (SELECT as_of_us, query_norm, sum(pow(2, -((as_of_us - us) / 1e6) / 259200.0)) AS score,
                        round(log2(sum(pow(2, -((as_of_us - us) / 1e6) / 259200.0))), 8) AS level
                 FROM moment JOIN search_event ON us < as_of_us GROUP BY ALL),
        leaders AS (SELECT * FROM seen
                    QUALIFY row_number() OVER (PARTITION BY as_of_us ORDER BY level DESC, query_norm DESC) <= 30),
        best AS ({BEST}),
        scored AS (SELECT as_of_us, query_norm, coalesce("count", 0) AS "count", score, level
                   FROM leaders LEFT JOIN best USING (query_norm)),
        done AS ({blended('scored', 'PARTITION BY as_of_us', 'as_of_us, query_norm, "count", score, level',
                          'level DESC, query_norm DESC', 10)})"""),
    "validate_events": sql(f"""
        SELECT doc_id, line_no, units, concat_ws('; ',
            CASE WHEN {trimmed('line')} = '' THEN 'query: must not be blank' END,
            CASE WHEN units > 512 THEN 'query: length must be at most 512' END) AS error
        FROM (SELECT *, (length(line) + length(regexp_replace(line, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::INT AS units
              FROM (SELECT doc_id, unnest(l) AS line, (generate_subscripts(l, 1) - 1)::INT AS line_no
                    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""),
    "usable_events": sql("""
        SELECT event_id, query_norm, CASE WHEN event_id % 5 <> 0 THEN display ELSE query_norm END AS display
        FROM search_event WHERE event_id % 17 <> 0""", EVENTS),
    "event_log_days": sql("""
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT query_norm) AS norms
        FROM search_event GROUP BY 1""", EVENTS),
    "flush_fold": sql("SELECT * FROM folded", FLUSHES),
    "write_reduction": sql("""
        SELECT sum(delta)::BIGINT AS events, count(*) AS rows_written,
               count(DISTINCT (flush_window, flush_chunk)) AS flushes,
               floor(sum(delta)::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS reduction_ratio,
               floor(100.0::DOUBLE * (1 - count(*)::DOUBLE / sum(delta)::DOUBLE) * 10000 + 0.5) / 10000 AS reduction_percent
        FROM folded""", FLUSHES),
    "requeue_merge": sql("""
        SELECT flush_window, greatest(flush_chunk, 1)::BIGINT AS flush_chunk, query_norm, sum(delta)::BIGINT AS delta,
               arg_max(display, flush_chunk) AS display, max(last_us) AS last_us
        FROM folded GROUP BY flush_window, greatest(flush_chunk, 1), query_norm""", FLUSHES),
    "upsert_merge": sql("""
        SELECT query, arg_min(query_norm, created_us) AS query_norm, sum("count")::BIGINT AS "count",
               max(last_us) AS last_us, min(created_us) AS created_us
        FROM (SELECT query, query_norm, "count", epoch_us(TIMESTAMP '2024-01-01') AS last_us,
                     epoch_us(TIMESTAMP '2024-01-01') AS created_us FROM search_query
              UNION ALL SELECT display, query_norm, delta, last_us, last_us FROM folded) GROUP BY query""", FLUSHES),
    "upsert_ranges": sql('SELECT query, query_norm, "count", last_us, created_us FROM merged', EVENTS, DAY_FOLDS),
    "lists_after_changes": sql("""
        SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY "count" DESC, query)::INT AS rank, query, "count"
        FROM (SELECT substr(query_norm, 1, i::INT) AS prefix, query, "count"
              FROM (SELECT *, unnest(range(1, length(query_norm) + 1)) AS i FROM merged)) QUALIFY rank <= 10""", EVENTS, DAY_FOLDS),
    "load_last_wins": sql("""SELECT query, "count", line_no FROM query_line
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY line_no DESC) = 1""", "doc_word query_line"),
    "parse_lines": sql("""SELECT origin, query, n AS "count" FROM parsed WHERE good AND query <> ''""", WORDS, PARSED),
    "parse_rejects": sql("""SELECT origin, count(*) AS rejected, sum(length(line))::BIGINT AS characters
        FROM parsed WHERE NOT (good AND query <> '') GROUP BY origin""", WORDS, PARSED),
    "csv_round_trip": sql('SELECT query, "count" FROM search_query', WORDS),
    "materialize_lists": sql("SELECT cache_key, node, value, expires_us FROM placed",
        f"{WORDS} spread all_top nodes3", f"""
        lists AS (SELECT 'suggest:' || prefix AS key, {LIST_JSON} AS value FROM all_top GROUP BY prefix),
        ring AS ({ring_of('nodes3')}),
        placed AS (SELECT key AS cache_key, node, value, epoch_us(TIMESTAMP '2024-01-31') + 60000000 AS expires_us
                   FROM ({owners('lists', 'ring')}))"""),
    "materialize_lists_recency": sql("SELECT cache_key, node, value, expires_us FROM placed",
        f"{SCORES} spread all_pooled all_recency nodes3", f"""
        lists AS (SELECT 'suggest:recency:' || prefix AS key, {LIST_JSON} AS value FROM all_recency GROUP BY prefix),
        ring AS ({ring_of('nodes3')}),
        placed AS (SELECT key AS cache_key, node, value, epoch_us(TIMESTAMP '2024-01-31') + 15000000 AS expires_us
                   FROM ({owners('lists', 'ring')}))"""),
    "invalidate_keys": sql("""SELECT 'suggest:' || prefix AS cache_key, value FROM lists
        WHERE prefix NOT IN (SELECT p FROM touched)""", f"{EVENTS} spread all_top", f"""
        lists AS (SELECT prefix, {LIST_JSON} AS value FROM all_top GROUP BY prefix),
        touched AS (SELECT DISTINCT substr(query_norm, 1, i::INT) AS p
                    FROM (SELECT query_norm, unnest(range(1, length(query_norm) + 1)) AS i FROM search_event
                          WHERE ts >= TIMESTAMP '2024-01-30'))"""),
    "resolve_requests": sql("""SELECT req_id, prefix, mode, trending_mode, CASE WHEN prefix = '' THEN '-'
        WHEN mode = 'RECENCY' THEN 'suggest:recency:' || prefix ELSE 'suggest:' || prefix END AS cache_key
        FROM asked""", REQUESTS, ASKED),
    "materialized_else_compute": sql("""
        SELECT req_id, a.prefix, a.mode, CASE WHEN a.prefix = '' THEN 'EMPTY' WHEN l.value IS NOT NULL AND length(l.key) % 2 = 0
                    THEN 'MATERIALIZED' ELSE 'COMPUTED' END AS source,
               coalesce(l.value, '[]') AS value
        FROM asked a LEFT JOIN lists l USING (prefix, mode)""",
        f"{WORDS} frequent raw_event search_event request_log score settled spread all_top all_pooled all_recency",
        ASKED + f""",
        lists AS (SELECT prefix, 'POPULARITY' AS mode, 'suggest:' || prefix AS key, {LIST_JSON} AS value
                  FROM all_top GROUP BY prefix
                  UNION ALL SELECT prefix, 'RECENCY', 'suggest:recency:' || prefix, {LIST_JSON} FROM all_recency GROUP BY prefix)"""),
    "suggest_batch": sql("""
        SELECT req_id, a.prefix, a.mode,
               CASE WHEN a.prefix = '' THEN 'EMPTY' WHEN a.mode = 'RECENCY' THEN 'DB+RECENCY' ELSE 'DB' END AS source,
               coalesce(o.node, '-') AS node, coalesce(l.value, '[]') AS value
        FROM asked a LEFT JOIN lists l USING (prefix, mode) LEFT JOIN owned o USING (prefix, mode)""",
        f"{WORDS} frequent raw_event search_event request_log score settled spread all_top all_pooled all_recency nodes3",
        ASKED + f""",
        lists AS (SELECT prefix, 'POPULARITY' AS mode, {LIST_JSON} AS value FROM all_top GROUP BY prefix
                  UNION ALL SELECT prefix, 'RECENCY', {LIST_JSON} FROM all_recency GROUP BY prefix),
        ring AS ({ring_of('nodes3')}),
        needed AS (SELECT DISTINCT prefix, mode, CASE WHEN mode = 'RECENCY' THEN 'suggest:recency:' ELSE 'suggest:' END || prefix AS key
                   FROM asked WHERE prefix <> ''),
        owned AS ({owners('needed', 'ring')})"""),
    "ttl_refresh": sql("SELECT * FROM hits", EVENTS, f"hits AS ({PIECES['hits']})", REFILL),
    "hit_rate": sql("""SELECT count(*) FILTER (source = 'CACHE') AS hits, count(*) FILTER (source = 'COMPUTED') AS misses,
        floor(count(*) FILTER (source = 'CACHE')::DOUBLE / count(*) * 10000 + 0.5) / 10000 AS hit_rate FROM hits""",
        EVENTS, f"hits AS ({PIECES['hits']})", REFILL),
    "store_traffic": sql("SELECT (SELECT count(*) FROM refill) AS reads, (SELECT count(*) FROM folded) AS writes",
        FLUSHES, "", REFILL),
    "ring_table": sql(ring_of("supplier_nodes"), "supplier_nodes"),
    "ring_arcs": sql("""
        SELECT lag(pos) OVER (ORDER BY pos) AS lo, pos AS hi, false AS closed, node FROM ring
        QUALIFY lo IS NOT NULL
        UNION ALL SELECT -9223372036854775808, min(pos), true, arg_min(node, pos) FROM ring
        UNION ALL SELECT max(pos), 9223372036854775807, false, arg_min(node, pos) FROM ring""",
        "supplier_nodes", f"ring AS ({ring_of('supplier_nodes')})"),
    "ring_assign": sql(owners("prefix_keys", "ring"), f"{WORDS} supplier_nodes prefix_keys",
        f"ring AS ({ring_of('supplier_nodes')})"),
    "keys_per_node": sql("""SELECT n.node_index, n.node, count(o.key) AS keys FROM supplier_nodes n
        LEFT JOIN owned o USING (node) GROUP BY ALL""", f"{WORDS} supplier_nodes prefix_keys",
        f"ring AS ({ring_of('supplier_nodes')}), owned AS ({owners('prefix_keys', 'ring')})"),
    "ring_balance": sql("""
        SELECT replicas, count(*) AS nodes, sum(keys)::BIGINT AS keys, max(keys) AS max_keys, min(keys) AS min_keys,
               round(stddev_pop(keys) / avg(keys), 6) AS relative_spread, round(max(keys) / avg(keys), 6) AS max_over_mean
        FROM (SELECT r.replicas, n.node, count(o.key) AS keys
              FROM nodes3 n CROSS JOIN (VALUES (1), (10), (50), (150)) r(replicas)
              LEFT JOIN owned o ON o.node = n.node AND o.replicas = r.replicas GROUP BY ALL) GROUP BY replicas""",
        f"{WORDS} nodes3 prefix_keys", ",\n".join(
            f"r{n} AS ({ring_of('nodes3', str(n))})" for n in (1, 10, 50, 150)) + ",\nowned AS (" + " UNION ALL ".join(
            f"SELECT {n} AS replicas, key, node FROM ({owners('prefix_keys', f'r{n}')})" for n in (1, 10, 50, 150)) + ")"),
    "ring_remap": sql("""
        SELECT count(*) AS keys, count(*) FILTER (a.node <> b.node) AS ring_moved,
               count(*) FILTER (((a.pos % 3) + 3) % 3 <> ((a.pos % 4) + 4) % 4) AS modulo_moved,
               round(avg((a.node <> b.node)::INT), 6) AS ring_share,
               round(avg((((a.pos % 3) + 3) % 3 <> ((a.pos % 4) + 4) % 4)::INT), 6) AS modulo_share
        FROM a JOIN b USING (key)""", f"{WORDS} nodes3 nodes4 prefix_keys", f"""
        r3 AS ({ring_of('nodes3')}), r4 AS ({ring_of('nodes4')}),
        a AS ({owners('prefix_keys', 'r3')}), b AS ({owners('prefix_keys', 'r4')})"""),
    "placement_report": sql("""
        SELECT o.prefix, o.key AS cache_key, o.node AS owner, o.pos AS position,
               CASE WHEN l.prefix IS NULL THEN 'MISS' ELSE 'HIT' END AS status,
               CASE WHEN l.prefix IS NULL THEN -2 ELSE 60 END::BIGINT AS ttl_seconds,
               (SELECT to_json(list({'node_index': node_index, 'node': node, 'virtual_nodes': 150, 'live_keys': keys}
                                    ORDER BY node_index))::VARCHAR
                FROM (SELECT n.node_index, n.node, count(s.key) AS keys FROM nodes3 n LEFT JOIN live s USING (node) GROUP BY ALL)
               ) AS ring
        FROM owned o LEFT JOIN stored l ON l.prefix = o.prefix""",
        f"{REQUESTS} spread nodes3", f"""
        ring AS ({ring_of('nodes3')}),
        stored AS (SELECT DISTINCT prefix, 'suggest:' || prefix AS key FROM spread),
        live AS ({owners('stored', 'ring')}),
        asked AS (SELECT DISTINCT prefix, 'suggest:' || prefix AS key FROM request_log),
        owned AS ({owners('asked', 'ring')})"""),
    "debounce": sql("""SELECT req_id, user_id, prefix FROM (
        SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY ts, req_id) AS following FROM request_log)
        WHERE (following IS NULL OR following - us >= 3600000000) AND prefix <> ''""", REQUESTS),
    "superseded": sql("""SELECT req_id, coalesce(following < us + took_ms * 60000 * 1000, false) AS superseded FROM (
        SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY ts, req_id) AS following FROM request_log)""", REQUESTS),
    "latency_percentiles": sql(
        percentile("floor_n", "floor({q}::DOUBLE * n)") + " UNION ALL "
        + percentile("floor_n_1", "floor({q}::DOUBLE * (n - 1)) + 1"), REQUESTS, """
        numbered AS (SELECT *, CASE WHEN req_id % 2 = 0 THEN 'cold' ELSE 'warm' END AS phase,
            count(*) OVER (PARTITION BY req_id % 2) AS n,
            row_number() OVER (PARTITION BY req_id % 2 ORDER BY took_ms, req_id) AS i FROM request_log)"""),
    "debounce_large": sql("""SELECT req_id, coalesce(u, -1) AS user_id, prefix FROM (
        SELECT *, lead(us) OVER (PARTITION BY u ORDER BY ts, req_id) AS following
        FROM (SELECT *, CASE WHEN req_id % 3 <> 0 THEN user_id END AS u FROM request_log))
        WHERE (following IS NULL OR following - us >= 3600000000) AND prefix <> ''""", REQUESTS),
    "latency_large": sql(
        percentile("floor_n", "floor({q}::DOUBLE * n)") + " UNION ALL "
        + percentile("floor_n_1", "floor({q}::DOUBLE * (n - 1)) + 1"), REQUESTS, """
        numbered AS (SELECT *, CASE req_id % 3 WHEN 0 THEN 'cold' WHEN 1 THEN 'warm' ELSE '-' END AS phase,
            count(*) OVER (PARTITION BY req_id % 3) AS n,
            row_number() OVER (PARTITION BY req_id % 3 ORDER BY took_ms, req_id) AS i FROM request_log)"""),
    "ttl_large": sql("SELECT coalesce(key, '-') AS prefix, ms AS filled_ms, req_id FROM refill", REQUESTS, "",
        refill_of("(SELECT * REPLACE (CASE WHEN req_id % 3 <> 0 THEN prefix END AS prefix) FROM request_log)", "prefix",
                  "IS NOT DISTINCT FROM")),
    "stream_fold": sql("""
        SELECT query_norm, sum("count")::BIGINT AS "count", max(us) AS last_us, min(us) AS created_us
        FROM (SELECT query_norm, "count", epoch_us(TIMESTAMP '2024-01-01') AS us FROM search_query
              UNION ALL SELECT query_norm, 1, us FROM search_event) GROUP BY query_norm""", EVENTS),
    "stream_fold_replayed": sql('SELECT query_norm, count(*) AS "count" FROM search_event GROUP BY query_norm', EVENTS),
    "stream_score": sql("SELECT query_norm, round(score, 6) AS score FROM score", f"{EVENTS} score"),
    "stream_refills": sql("SELECT key AS prefix, ms AS filled_ms, req_id FROM refill", REQUESTS, "",
        refill_of("request_log", "prefix")),
}


def _sql_suggest() -> str:
    parts, ctes = [], []
    for i, (asked, wanted) in enumerate((("th", "th"), ("of%", "of%"), (" Th ", "th"))):
        ctes += [
            f"""p{i} AS ({prefix_top(wanted)})""",
            f"""c{i} AS (SELECT query, "count", coalesce(score, 0) AS score, level FROM (SELECT * FROM search_query
                WHERE starts_with(query_norm, '{wanted}') QUALIFY row_number() OVER (ORDER BY "count" DESC, query) <= 50)
                LEFT JOIN settled USING (query_norm))""",
            f"""r{i} AS ({blended(f'c{i}', '', 'query, "count", score, level', '"count" DESC, query', 10)})"""]
        parts += [f"SELECT '{asked}' AS prefix, 'popularity' AS mode, rank, query, \"count\", 'DB' AS source FROM p{i}",
                  f"SELECT '{asked}', 'RECENCY', rank, query, \"count\", 'DB+RECENCY' FROM r{i}"]
    return sql(" UNION ALL ".join(parts), SCORES, ",\n".join(ctes))


# The same questions put to streams, sketches and SQL functions.
ORACLE |= {
    "missing_file": sql("""SELECT 'there' AS folder, count(*) AS lines FROM search_query
        UNION ALL SELECT 'missing', 0""", WORDS),
    "score_store": ORACLE["decayed_score"],
    "stream_retry": ORACLE["stream_fold_replayed"],
    "list_store_answers": ORACLE["materialized_else_compute"],
    "stream_refills_state": ORACLE["stream_refills"],
    "stream_debounce": ORACLE["debounce"],
    "stream_superseded": ORACLE["superseded"],
    "stream_snapshots": ORACLE["trending_snapshots"].replace("round(blended, 6)", "round(blended, 4)"),
    "stream_late_scores": ORACLE["decayed_score"],
    "stream_late_events": sql("""
        SELECT query_norm, count(*) AS n, min(event_id) AS first_id FROM filed, mark
        WHERE file = 3 AND (us // 3600000000 + 1) * 3600000000 <= newest - 3600000000 GROUP BY query_norm""", EVENTS, """
        bounds AS (SELECT min(us) AS low, max(us) AS high FROM search_event),
        filed AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 3 ELSE
                      (us >= low + (high + 1 - low) // 4)::INT + (us >= low + (high + 1 - low) * 2 // 4)::INT
                      + (us >= low + (high + 1 - low) * 3 // 4)::INT END AS file FROM search_event, bounds),
        mark AS (SELECT max(us) AS newest FROM filed WHERE file < 3)"""),
    "polled_flushes": sql("""
        SELECT flush, query_norm, count(*) AS delta, arg_min(display, (us, event_id)) AS display, max(us) AS last_us
        FROM (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 10000 AS flush FROM search_event)
        GROUP BY flush, query_norm""", EVENTS),
    "latency_sketch": sql("""
        SELECT phase, q, count(*) AS n, true AS "within" FROM (SELECT CASE WHEN req_id % 3 = 0 THEN 'cold' ELSE 'warm' END AS phase
        FROM request_log), (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(q) GROUP BY phase, q""", REQUESTS),
    "distinct_sketch": sql(f"""
        SELECT span, count(*) AS n, count(DISTINCT {norm('w')}) AS exact, true AS "within" FROM doc_word,
        (VALUES ('first two', 0, 1), ('last two', 2, 3), ('all', 0, 3)) t(span, low, high)
        WHERE doc_id % 4 BETWEEN low AND high GROUP BY span""", "doc_word"),
    "sql_suggest": _sql_suggest(),
    "sql_trending": sql("""
        SELECT rank, query_norm AS query, "count", 'RECENCY' AS mode, 'COMPUTED' AS source FROM hot
        UNION ALL SELECT row_number() OVER (ORDER BY "count" DESC, query)::INT AS rank, query, "count", 'POPULARITY', 'COMPUTED'
        FROM search_query QUALIFY rank <= 5""", SCORES, f"""
        leaders AS (SELECT query_norm, score, level FROM settled ORDER BY level DESC, query_norm DESC LIMIT 30),
        best AS ({BEST}),
        scored AS (SELECT l.query_norm, coalesce(b."count", 0) AS "count", l.score, l.level
                   FROM leaders l LEFT JOIN best b USING (query_norm)),
        hot AS ({blended('scored', '', 'query_norm, "count", score, level', 'level DESC, query_norm DESC', 10)})"""),
}
