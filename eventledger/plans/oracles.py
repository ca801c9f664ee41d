"""SQL twins of the queries in ``catalog``, for DuckDB on the same tables.

Written from the rules by which the inputs are made, with windows and
self-joins where the Spark side uses aggregations, so that the two do not share
a way of computing.
"""

from .. import schemas as S
from . import catalog as C


def _uuid(digest: str) -> str:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "||'-'||".join(f"substr({digest},{a},{n})" for a, n in cuts)


_BOUNDS = ", ".join(f"({float(b)}::DOUBLE)" for b in S.END_TO_END_BUCKETS)
_PRODUCE = ", ".join(f"({float(b)}::DOUBLE)" for b in S.PRODUCE_BUCKETS)
_NS = S.ID_NAMESPACE.replace("-", "")


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('{_NS}')||encode({name}))"
    variant = f"substr('89ab', CAST(('0x'||substr({h},17,1)) AS INTEGER) % 4 + 1, 1)"
    return (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"{variant}||substr({h},18,3)||'-'||substr({h},21,12)"
    )


_RFC = "strftime({}, '%Y-%m-%dT%H:%M:%S.%fZ')"
_WINDOW = f"to_microseconds({C.WINDOW_US})"

# Shared steps: name -> (steps it reads, body).
_STEPS: dict[str, tuple[list[str], str]] = {
    "ev": ([], "SELECT event_id AS n, ts, event_type, value FROM events"),
    "arrivals": (
        ["ev"],
        "SELECT *, 2*n AS arrival FROM ev UNION ALL SELECT *, 2*n+101 AS arrival FROM ev WHERE n % 16 = 0",
    ),
    "named": (
        ["arrivals"],
        f"""SELECT n, ts, event_type, value, arrival,
            {_uuid("md5('event:'||n)")} AS event_id,
            {_uuid("md5('order:'||(CASE WHEN n % 250 = 8 THEN n-1 ELSE n END))")} AS order_id,
            CAST(floor(value*100) AS BIGINT) AS cents
        FROM arrivals""",
    ),
    "log": (
        ["named"],
        f"""SELECT *, CAST(ascii(substr(order_id,1,1)) % 3 AS INTEGER) AS part,
            row_number() OVER (PARTITION BY ascii(substr(order_id,1,1)) % 3 ORDER BY arrival) - 1 AS off,
            CASE WHEN n % 97 = 0 THEN '{{not json' ELSE
                '{{"event_id":"'||event_id||'","event_type":"order.created","order_id":"'||
                CASE WHEN n % 89 = 0 THEN 'NOT-A-UUID' ELSE order_id END||'","occurred_at":"'||{_RFC.format('ts')}||
                '","customer_id":"'||event_type||'-'||n||'","items":[{{"sku":"SKU-'||(n % 1000)||
                '","quantity":1,"unit_price_cents":'||cents||'}}],"total_cents":'||cents||'}}' END AS value_text,
            CASE WHEN n % 3 = 0 THEN CASE WHEN n % 15 = 0 THEN 'rubbish' ELSE CAST(n % 4 AS VARCHAR) END END AS count_header
        FROM named""",
    ),
    "judged": (
        ["log"],
        """SELECT *, CASE WHEN n % 97 = 0 THEN 'undecodable' WHEN n % 500 IN (3, 5) THEN 'sink_fault'
            WHEN n % 89 = 0 THEN 'malformed_id' END AS pre FROM log""",
    ),
    "ruled": (
        ["judged"],
        """SELECT *, CASE
                WHEN row_number() OVER w = 1 THEN 'persisted'
                WHEN event_id = first_value(event_id) OVER w THEN 'duplicate'
                ELSE 'order_id_collision' END AS verdict
        FROM judged WHERE pre IS NULL WINDOW w AS (PARTITION BY order_id ORDER BY part, off)
        UNION ALL SELECT *, NULL AS verdict FROM judged WHERE pre IS NOT NULL""",
    ),
    "outcomes": (
        ["ruled"],
        """SELECT *, coalesce(pre, CASE WHEN verdict = 'order_id_collision' THEN verdict END) AS cause,
            CASE WHEN pre IS NOT NULL OR verdict = 'order_id_collision' THEN 'dead_letter' ELSE verdict END AS outcome,
            CASE WHEN n % 97 = 0 THEN 'poison' WHEN pre = 'sink_fault' AND n % 500 = 3 THEN 'retries_exhausted'
                WHEN pre IS NOT NULL OR verdict = 'order_id_collision' THEN 'poison' END AS reason,
            CASE WHEN n % 97 = 0 THEN 0 WHEN n % 500 = 3 THEN 6 WHEN n % 500 = 4 THEN 3 ELSE 1 END AS attempts
        FROM ruled""",
    ),
    "dead": (
        ["outcomes"],
        """SELECT *, row_number() OVER (PARTITION BY part ORDER BY off) - 1 AS dlq_off,
            n % 35 <> 0 AS has_reason,
            CASE cause WHEN 'undecodable' THEN 'value is not a readable event'
                WHEN 'malformed_id' THEN 'invalid input syntax for type uuid (SQLSTATE 22P02)'
                WHEN 'order_id_collision' THEN 'duplicate key value violates unique constraint on order_id (SQLSTATE 23505)'
                ELSE 'write failed (SQLSTATE '||CASE WHEN n % 500 = 3 THEN '08006' ELSE '23514' END||')' END AS error,
            CASE WHEN n % 3 = 0 AND n % 15 <> 0 THEN n % 4 ELSE 0 END AS replays
        FROM outcomes WHERE outcome = 'dead_letter'""",
    ),
    "decided": (
        ["dead"],
        """SELECT *, CASE WHEN NOT has_reason THEN 'no_dlq_reason' WHEN reason <> 'retries_exhausted' THEN 'reason:'||reason
                WHEN replays >= 2 THEN 'replay_limit' ELSE 'replay' END AS by_default,
            CASE WHEN NOT has_reason THEN 'no_dlq_reason' WHEN replays >= 2 THEN 'replay_limit' ELSE 'replay' END AS with_all
        FROM dead""",
    ),
    "store": (
        ["ev"],
        f"""SELECT n, {_uuid("md5('order:'||n)")} AS order_id, {_uuid("md5('event:'||n)")} AS event_id,
            event_type AS tag, event_type||'-'||n AS customer_id, 'SKU-'||(n % 1000) AS sku,
            CAST(floor(value*100) AS BIGINT) AS total_cents, ts AS occurred_at,
            CAST(floor(value*1000) AS BIGINT) AS took_us,
            ts + to_microseconds(CAST(floor(value*1000) AS BIGINT)) AS processed_at
        FROM ev""",
    ),
    "requests": (
        ["ev"],
        """SELECT n, event_type AS run, row_number() OVER w - 1 AS seq,
            epoch_us(min(ts) OVER (PARTITION BY event_type)) + (row_number() OVER w - 1) * 1000000 AS due_us,
            (n % 7) * 1000000 // 3 AS late_us, CAST(floor(value*1000) AS BIGINT) AS work_us,
            CASE WHEN n % 41 = 0 THEN 503 WHEN n % 43 = 0 THEN NULL ELSE 202 END AS status
        FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY n)""",
    ),
    "answered": (
        ["requests"],
        """SELECT *, late_us + work_us AS latency_us,
            row_number() OVER (PARTITION BY run ORDER BY late_us + work_us) AS place,
            count(*) OVER (PARTITION BY run) AS answers
        FROM requests WHERE status IS NOT NULL""",
    ),
    "runs": (
        ["requests"],
        """SELECT run, count(*) AS sent, count(*) FILTER (status = 202) AS accepted, count(*) FILTER (status = 503) AS refused,
            count(*) FILTER (status IS NULL) AS failed, count(*) FILTER (late_us > 1000000) AS behind,
            (max(CASE WHEN status IS NOT NULL THEN due_us + late_us + work_us END) - min(due_us)) / 1e6 AS wall
        FROM requests GROUP BY run""",
    ),
    "accepts": (
        ["answered"],
        """SELECT run, count(*) AS answered, max(latency_us)/1e6 AS slowest,
            min(latency_us) FILTER (place >= greatest(ceil(0.5::DOUBLE*answers), 1))/1e6 AS p50,
            min(latency_us) FILTER (place >= greatest(ceil(0.95::DOUBLE*answers), 1))/1e6 AS p95,
            min(latency_us) FILTER (place >= greatest(ceil(0.99::DOUBLE*answers), 1))/1e6 AS p99
        FROM answered GROUP BY run""",
    ),
    "lines": (
        [],
        """SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i,
            'SKU-'||l_partkey AS sku, CAST(l_quantity AS BIGINT) AS qty, CAST(floor(l_extendedprice) AS BIGINT) AS price
        FROM lineitem""",
    ),
    "items": (
        ["lines"],
        """SELECT k, i, CASE WHEN i = 0 AND k % 107 = 0 THEN '' ELSE sku END AS sku,
            CASE WHEN i = 0 AND k % 103 = 0 THEN 0 ELSE qty END AS qty,
            CASE WHEN i = 0 AND k % 109 = 0 THEN -1 ELSE price END AS price
        FROM lines""",
    ),
    "per_order": (
        ["items"],
        """SELECT k, count(*) AS n_items, CAST(sum(price*qty) AS BIGINT) AS total,
            string_agg('{"sku":"'||sku||'","quantity":'||qty||',"unit_price_cents":'||price||'}', ',' ORDER BY i) AS json,
            string_agg(concat_ws('; ',
                CASE WHEN sku = '' THEN 'items['||i||'].sku is required' END,
                CASE WHEN qty <= 0 THEN 'items['||i||'].quantity must be > 0' END,
                CASE WHEN price < 0 THEN 'items['||i||'].unit_price_cents must be >= 0' END), '; ' ORDER BY i)
                FILTER (sku = '' OR qty <= 0 OR price < 0) AS bad
        FROM items GROUP BY k""",
    ),
    "asked": (
        ["per_order"],
        """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN '   ' ELSE 'cust-'||o_custkey END AS customer,
            CASE WHEN o_orderkey % 10 <= 1 THEN 'checkout-'||(o_orderkey - o_orderkey % 2) ELSE '' END AS idk,
            o_orderdate AS asked_at, coalesce(n_items, 0) AS n_items, coalesce(total, 0) AS total, coalesce(json, '') AS json,
            concat_ws('; ', CASE WHEN o_orderkey % 101 = 0 THEN 'customer_id is required' END,
                CASE WHEN n_items IS NULL THEN 'at least one item is required' END, bad) AS problems
        FROM orders LEFT JOIN per_order ON k = o_orderkey""",
    ),
    "bodies": (
        ["asked"],
        """SELECT *, k % 113 = 0 OR k % 127 = 0 OR (k % 131 = 0 AND n_items > 0) OR (k % 137 = 0 AND k % 131 <> 0) AS malformed,
            CASE WHEN k % 113 = 0 THEN '{' ELSE
                '{"customer_id":'||CASE WHEN k % 137 = 0 AND k % 131 <> 0 AND k % 127 <> 0 THEN '7' ELSE '"'||customer||'"' END||
                ',"items":['||CASE WHEN k % 131 = 0 AND k % 127 <> 0
                    THEN regexp_replace(json, '"quantity":[0-9]+', '"quantity":1.5', 'g') ELSE json END||']'||
                CASE WHEN k % 127 = 0 THEN ',"discount":5' ELSE '' END||'}' END AS body
        FROM asked""",
    ),
    "hourly": (
        ["store"],
        """SELECT date_trunc('hour', processed_at) AS ts, 'worker-'||(n % 2) AS instance, tag, took_us/1e6 AS seconds,
            CAST(ascii(substr(order_id,1,1)) % 3 AS INTEGER) AS part FROM store""",
    ),
    "counter": (
        ["hourly"],
        f"""SELECT ts, instance, tag AS label, CAST(sum(count(*)) OVER (PARTITION BY instance, tag,
                ts >= TIMESTAMP '2024-01-11' ORDER BY ts) AS DOUBLE) AS value
        FROM hourly GROUP BY ts, instance, tag""",
    ),
    "buckets": (
        ["hourly"],
        f"""SELECT ts, instance, le, CAST(sum(c) OVER (PARTITION BY instance, le, ts >= TIMESTAMP '2024-01-11' ORDER BY ts)
                AS DOUBLE) AS value
        FROM (SELECT ts, instance, le, count(*) FILTER (seconds <= le) AS c
            FROM hourly, (VALUES {_BOUNDS}, ('infinity'::DOUBLE)) AS b(le) GROUP BY ts, instance, le)""",
    ),
    "gauge": (
        ["hourly"],
        """SELECT ts, CAST(part AS VARCHAR) AS label, greatest(0.0::DOUBLE, sum(count(*)) OVER (PARTITION BY part ORDER BY ts)
                - 4 * ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE + 1)) AS value
        FROM hourly GROUP BY ts, part""",
    ),
    "pairs": (
        ["counter"],
        """SELECT ts, instance, label, value, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev FROM counter
        WINDOW w AS (PARTITION BY instance, label ORDER BY ts)""",
    ),
    "growth": (
        ["pairs"],
        f"""SELECT t.ts, t.instance, t.label, count(*) AS pairs, min(p.prev_ts) AS first_ts,
            arg_min(p.prev, p.prev_ts) AS first_value,
            sum(CASE WHEN p.value < p.prev THEN p.value ELSE p.value - p.prev END) AS increase
        FROM counter t JOIN pairs p ON p.instance = t.instance AND p.label = t.label
            AND p.ts <= t.ts AND p.prev_ts > t.ts - {_WINDOW}
        GROUP BY t.ts, t.instance, t.label""",
    ),
    "bucket_pairs": (
        ["buckets"],
        """SELECT ts, instance, le, value, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev FROM buckets
        WINDOW w AS (PARTITION BY instance, le ORDER BY ts)""",
    ),
    "bucket_growth": (
        ["bucket_pairs"],
        f"""SELECT t.ts, t.le, sum(CASE WHEN p.value < p.prev THEN p.value ELSE p.value - p.prev END) AS upto
        FROM buckets t JOIN bucket_pairs p ON p.instance = t.instance AND p.le = t.le
            AND p.ts <= t.ts AND p.prev_ts > t.ts - {_WINDOW}
        GROUP BY t.ts, t.le""",
    ),
    "quantiles": (
        ["bucket_growth"],
        """SELECT ts, arg_min(CASE WHEN le = 'infinity'::DOUBLE THEN lower
                ELSE lower + (le - lower) * (0.99::DOUBLE * total - below) / (upto - below) END, le) AS p99
        FROM (SELECT *, coalesce(lag(le) OVER w, 0) AS lower, coalesce(lag(upto) OVER w, 0) AS below,
                max(upto) OVER (PARTITION BY ts) AS total
            FROM bucket_growth WINDOW w AS (PARTITION BY ts ORDER BY le))
        WHERE total > 0 AND upto >= 0.99::DOUBLE * total AND upto > below GROUP BY ts""",
    ),
    "backlog": (["gauge"], "SELECT ts, sum(value) AS total FROM gauge GROUP BY ts"),
    "rejected": (
        ["bodies"],
        """SELECT k, CASE WHEN malformed THEN 'malformed_body' WHEN problems <> '' THEN 'validation' ELSE 'accepted' END AS reason
        FROM bodies""",
    ),
}

def _with(body: str, *steps: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in _STEPS[name][0]:
                add(needed)
            ordered.append(name)

    for step in steps:
        add(step)
    if not ordered:
        return body
    defined = ",\n".join(f"{name} AS ({_STEPS[name][1]})" for name in ordered)
    # a body that starts with a comma brings further steps of its own
    return f"WITH {defined}{body}" if body.startswith(",") else f"WITH {defined}\n{body}"


_ORDER_COLUMNS = (
    "order_id, event_id, customer_id, sku, total_cents, epoch_us(occurred_at) AS occurred_us, "
    "epoch_us(processed_at) AS processed_us"
)
_READ_IDS = (
    "CASE WHEN n % 97 = 0 THEN '' ELSE event_id END AS event_id, "
    "CASE WHEN n % 97 = 0 OR n % 89 = 0 THEN '' ELSE order_id END AS order_id"
)
_DLQ_HEADERS = (
    "concat_ws(';', 'replay_count='||count_header, CASE WHEN has_reason THEN 'dlq_reason='||reason END, "
    "'dlq_error='||error, 'dlq_attempts='||attempts, 'dlq_source_topic=orders', 'dlq_source_partition='||part, "
    f"'dlq_source_offset='||off, 'dlq_failed_at='||{_RFC.format('ts')})"
)
_LENIENT_BAD = "(n % 97 = 0 OR n % 11 IN (1, 4, 5, 7, 8, 9))"


def _case_of(tags: dict[str, int]) -> str:
    return "CASE tag " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in tags.items()) + " END"


def _quantile_columns(value: str, unit: float, digits: int, suffix: str) -> str:
    parts = [
        f"round(quantile_cont({value}, {q}) / {unit}, {digits}) AS {name}_{suffix}"
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    ]
    return ", ".join([*parts, f"round(max({value}) / {unit}, {digits}) AS max_{suffix}"])


def _failure_case(i: str) -> str:
    whens = " ".join(f"WHEN {j} THEN ['{k}', '{s}']" for j, (k, s) in enumerate(C.FAILURE_CASES))
    return f"CASE {i} {whens} END"


def _extrapolated() -> str:
    w = C.WINDOW_US / 1e6
    return f"""SELECT epoch_us(ts) AS ts_us, instance, label, round(increase * ((covered + least(CASE WHEN to_start >= gap * 1.1 THEN gap / 2 ELSE to_start END,
            CASE WHEN increase > 0 THEN covered * first_value / increase ELSE 'infinity'::DOUBLE END)) / covered) / {w}, 9) AS rate
    FROM (SELECT *, (epoch_us(ts) - epoch_us(first_ts))::DOUBLE AS covered,
            (epoch_us(ts) - epoch_us(first_ts))::DOUBLE / pairs AS gap,
            ({C.WINDOW_US} - (epoch_us(ts) - epoch_us(first_ts)))::DOUBLE AS to_start FROM growth)"""


_AT = f"TIMESTAMP '{C.TILES_AT}'"


def _tiles() -> str:
    at, w = _AT, C.WINDOW_US
    seconds = w / 1e6
    done = "due_us + late_us + work_us"
    in_window = f"status IS NOT NULL AND {done} <= epoch_us({at}) AND {done} > epoch_us({at}) - {w}"
    fresh = f"ts <= {at} AND ts > {at} - to_microseconds(300000000)"
    between = f"ts <= {at} AND prev_ts > {at} - to_microseconds({w})"
    accepted = f"""(SELECT min(CASE WHEN le = 'infinity'::DOUBLE THEN lower ELSE lower + (le - lower) * (0.99::DOUBLE * total - below) / (upto - below) END)
        FROM (SELECT *, coalesce(lag(le) OVER (ORDER BY le), 0) AS lower, coalesce(lag(upto) OVER (ORDER BY le), 0) AS below, max(upto) OVER () AS total
            FROM (SELECT le, count(*) FILTER (work_us / 1e6 <= le) AS upto FROM requests, (VALUES {_PRODUCE}, ('infinity'::DOUBLE)) AS b(le)
                WHERE {in_window} GROUP BY le))
        WHERE total > 0 AND upto >= 0.99::DOUBLE * total AND below < 0.99::DOUBLE * total)"""
    tiles = {
        "accepted": "(SELECT count(*) FROM requests WHERE status = 202)",
        "accept_rate": f"(SELECT count(*) / {seconds} FROM requests WHERE status = 202 AND {in_window})",
        "persisted": "(SELECT count(*) FROM outcomes WHERE outcome = 'persisted')",
        "duplicate": "(SELECT count(*) FROM outcomes WHERE outcome = 'duplicate')",
        "rejected": "(SELECT count(*) FROM rejected WHERE reason <> 'accepted')",
        "dlq": "(SELECT count(*) FROM outcomes WHERE outcome = 'dead_letter')",
        "retries": "(SELECT sum(CASE n % 500 WHEN 3 THEN 5 WHEN 4 THEN 2 ELSE 0 END) FROM log WHERE n % 500 IN (3, 4, 5))",
        "throughput": f"(SELECT sum(CASE WHEN value < prev THEN value ELSE value - prev END) / {seconds} FROM pairs WHERE {between})",
        "lag": f"(SELECT sum(value) FROM (SELECT label, arg_max(value, ts) AS value FROM gauge WHERE {fresh} GROUP BY label))",
        "partitions_owned": "(SELECT count(DISTINCT part) FROM log)",
        "partitions_paused": "(SELECT count(DISTINCT part) FROM log WHERE n % 1000 = 503)",
        "p99_accept": accepted,
        "p99_persist": "NULL",
        "p99_e2e": f"""(SELECT min(CASE WHEN le = 'infinity'::DOUBLE THEN lower ELSE lower + (le - lower) * (0.99::DOUBLE * total - below) / (upto - below) END)
        FROM (SELECT *, coalesce(lag(le) OVER (ORDER BY le), 0) AS lower, coalesce(lag(upto) OVER (ORDER BY le), 0) AS below, max(upto) OVER () AS total
            FROM (SELECT le, sum(CASE WHEN value < prev THEN value ELSE value - prev END) AS upto FROM bucket_pairs WHERE {between} GROUP BY le))
        WHERE total > 0 AND upto >= 0.99::DOUBLE * total AND upto > below)""",
    }
    return "SELECT " + ", ".join(
        f"round(coalesce(CAST({sql} AS DOUBLE), -1), 9) AS {name}" for name, sql in tiles.items()
    )


def all_sql() -> dict[str, str]:
    r9 = lambda x, name: f"round({x}, 9) AS {name}"
    frontier = """SELECT part, min(CASE WHEN n % 1000 = 503 THEN off END) AS stop, max(off) AS last FROM log GROUP BY part"""
    return {
        "record_log_scan": _with(
            """SELECT part AS partition, count(*) AS records, min(off) AS first_offset, max(off) AS last_offset,
                CAST(sum(strlen(value_text)) AS BIGINT) AS value_bytes, min(md5(value_text)) AS least_md5,
                max(md5(value_text)) AS greatest_md5,
                CAST(sum(CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS headers
            FROM log GROUP BY part""", "log"),
        "log_append_offsets": _with(
            """SELECT arrival, part AS partition, off + count(*) OVER (PARTITION BY part) AS "offset", order_id AS key FROM log""",
            "log"),
        "key_stickiness": _with(
            "SELECT count(*) AS records, count(DISTINCT order_id) AS keys, 0::BIGINT AS split_keys FROM log", "log"),
        "dead_letter_write": _with(
            f"""SELECT part AS partition, dlq_off AS "offset", order_id AS key, md5(value_text) AS value_md5,
                {_DLQ_HEADERS} AS headers FROM dead""", "dead"),
        "dlq_scan": _with(
            """SELECT part AS partition, CASE WHEN has_reason THEN reason ELSE '' END AS reason, count(*) AS records,
                max(dlq_off) AS last_offset FROM dead GROUP BY ALL""", "dead"),
        "strict_decode": _with(
            """SELECT k AS order_key, malformed, CASE WHEN malformed THEN '' ELSE customer END AS customer_id,
                CASE WHEN malformed THEN 0 ELSE n_items END AS items, CASE WHEN malformed THEN 0 ELSE total END AS total_cents,
                md5(body) AS body_md5 FROM bodies""", "bodies"),
        "lenient_decode": _with(
            f"""SELECT part AS partition, off AS "offset", NOT {_LENIENT_BAD} AS readable,
                CASE WHEN {_LENIENT_BAD} OR n % 11 = 6 THEN '' ELSE event_id END AS event_id,
                CASE WHEN {_LENIENT_BAD} THEN '' ELSE event_type||'-'||n END AS customer_id,
                CAST(CASE WHEN {_LENIENT_BAD} THEN -1 WHEN n % 11 = 3 THEN 0 ELSE 1 END AS BIGINT) AS items,
                CASE WHEN {_LENIENT_BAD} THEN -1 ELSE cents END AS total_cents,
                CASE WHEN {_LENIENT_BAD} THEN 0 ELSE epoch_us(ts) END AS occurred_us FROM log""", "log"),
        "validate_requests": _with(
            "SELECT k AS order_key, CASE WHEN problems = '' THEN '' ELSE 'invalid order: '||problems END AS message FROM asked",
            "asked"),
        "validate_idempotency_key": "SELECT o_orderkey AS order_key, o_orderkey % 7 IN (0, 2, 6) AS ok FROM orders",
        "order_totals": _with("SELECT k AS order_key, total AS total_cents FROM asked", "asked"),
        "derive_ids": _with(
            f"""SELECT k AS order_key, CASE WHEN idk = '' THEN '' ELSE {_uuid5("'event:'||idk")} END AS event_id,
                CASE WHEN idk = '' THEN '' ELSE {_uuid5("'order:'||idk")} END AS order_id, true AS well_formed,
                customer AS customer_id, total AS total_cents, epoch_us(asked_at) AS occurred_us FROM asked""", "asked"),
        "rejections_by_reason": _with("SELECT reason, count(*) AS n FROM rejected GROUP BY reason", "rejected"),
        "order_json": _with(
            f"""SELECT order_id, '{{"order_id":"'||order_id||'","event_id":"'||event_id||'","customer_id":"'||customer_id||
                '","items":[{{"sku":"'||sku||'","quantity":1,"unit_price_cents":'||total_cents||'}}],"total_cents":'||total_cents||
                ',"occurred_at":"'||{_RFC.format('occurred_at')}||'","processed_at":"'||{_RFC.format('processed_at')}||'"}}' AS body
            FROM store""", "store"),
        "classify_failures": f"""SELECT kind, sqlstate, count(*) AS n,
                count(*) FILTER (kind IN ('transport', 'timeout')
                    OR (kind = 'server' AND sqlstate[1:2] IN ('08', '53', '57', '58', '40'))) AS retryable,
                count(*) FILTER (kind = 'invalid_argument' OR sqlstate[1:2] = '22') AS caller_errors
            FROM (SELECT c[1] AS kind, c[2] AS sqlstate FROM (SELECT {_failure_case(f'event_id % {len(C.FAILURE_CASES)}')} AS c FROM events))
            GROUP BY kind, sqlstate""",
        "backoff_schedule": _with(
            """SELECT part AS partition, off AS "offset", CAST(a AS INTEGER) AS attempt, least(5000.0::DOUBLE, 100.0 * 2 ** a) AS ceiling_ms
            FROM log, range(0, 5) AS r(a) WHERE (n % 500 = 3 AND a < 5) OR (n % 500 = 4 AND a < 2)""", "log"),
        "generate_orders": _with(
            """SELECT run||'-'||seq AS customer_id, 'SKU-'||(seq % 1000) AS sku, 1::BIGINT AS quantity,
                1999::BIGINT AS unit_price_cents FROM requests""", "requests"),
        "due_latency": _with(
            """SELECT n, CASE WHEN status IS NULL THEN -1 ELSE late_us + work_us END AS latency_us, late_us > 1000000 AS behind
            FROM requests""", "requests"),
        "idempotent_insert": _with(
            """SELECT order_id, event_id, event_type||'-'||n AS customer_id, 'SKU-'||(n % 1000) AS sku, cents AS unit_price_cents,
                cents AS total_cents, epoch_us(ts) AS occurred_us FROM outcomes WHERE outcome = 'persisted'""", "outcomes"),
        "record_outcomes": _with(
            f"""SELECT part AS partition, off AS "offset", {_READ_IDS}, outcome, coalesce(reason, '') AS reason,
                coalesce(cause, '') AS cause, CAST(attempts AS INTEGER) AS attempts FROM outcomes""", "outcomes"),
        "order_id_collisions": _with(
            """SELECT part AS partition, off AS "offset", event_id, order_id, '23505' AS sqlstate, 'poison' AS reason
            FROM outcomes WHERE cause = 'order_id_collision'""", "outcomes"),
        "poison_isolation": _with(
            f"""SELECT part AS partition, off // {C.CHUNK} AS chunk, count(*) AS records,
                count(*) FILTER (outcome = 'dead_letter') AS parked, count(*) FILTER (outcome <> 'dead_letter') AS applied
            FROM outcomes GROUP BY ALL""", "outcomes"),
        "outcome_counters": _with(
            "SELECT outcome AS status, coalesce(reason, '') AS reason, count(*) AS n FROM outcomes GROUP BY ALL", "outcomes"),
        "reconcile": _with(
            """, known AS (SELECT *, CASE WHEN n % 97 = 0 THEN part||':'||off ELSE event_id END AS id FROM outcomes),
            stored AS (SELECT DISTINCT id FROM known WHERE outcome = 'persisted'),
            parked AS (SELECT DISTINCT id FROM known WHERE outcome = 'dead_letter')
            SELECT (SELECT count(DISTINCT id) FROM known) AS accepted_events,
                (SELECT count(*) FROM outcomes WHERE outcome = 'persisted') AS stored_rows,
                (SELECT count(*) FROM stored) AS stored_events,
                (SELECT count(*) FROM parked WHERE id NOT IN (SELECT id FROM stored)) AS parked_events,
                (SELECT count(DISTINCT id) FROM known WHERE id NOT IN (SELECT id FROM stored)
                    AND id NOT IN (SELECT id FROM parked)) AS missing,
                0::BIGINT AS unexpected""", "outcomes"),
        "replay_is_noop": _with(
            """, p AS (SELECT CAST(('0x'||substr(md5(order_id),1,8)) AS BIGINT) AS x FROM outcomes WHERE outcome = 'persisted')
            SELECT count(*) AS rows_once, CAST(sum(x) AS BIGINT) AS print_once, count(*) AS rows_twice,
                CAST(sum(x) AS BIGINT) AS print_twice, count(*) AS resent FROM p""",
            "outcomes"),
        "attempt_counters": _with(
            """, c AS (SELECT count(*) FILTER (outcome = 'persisted') AS persisted, count(*) FILTER (outcome = 'duplicate') AS duplicate,
                count(*) FILTER (outcome = 'dead_letter') AS dead_letter, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries
            FROM outcomes) SELECT *, persisted + duplicate + dead_letter + retries AS attempts FROM c""", "outcomes"),
        "rejection_counters": _with(
            f"""SELECT CASE WHEN reason = 'accepted' AND k % {C.T.PRODUCE_FAILS_EVERY} = 0 THEN 'produce_failed' ELSE reason END AS reason,
                count(*) AS n FROM rejected GROUP BY ALL""", "rejected"),
        "commit_frontier": _with(
            f"""SELECT part AS partition, coalesce(stop, last + 1) AS next_offset, coalesce(stop, last + 1) - 1 AS last_offset,
                stop IS NOT NULL AS blocked FROM ({frontier})""", "log"),
        "frontier_write_set": _with(
            f"""SELECT part AS partition, off AS "offset", n % 1000 <> 503 AS ok FROM log JOIN ({frontier}) USING (part)
            WHERE stop IS NULL OR off < stop""", "log"),
        "consumer_lag": _with(
            f"""SELECT part AS partition, last + 1 AS log_end, coalesce(stop, last + 1) AS committed,
                last + 1 - coalesce(stop, last + 1) AS lag FROM ({frontier})""", "log"),
        "offset_chunks": _with(
            f"""SELECT part AS partition, off AS "offset", off // {C.CHUNK} AS chunk FROM log""", "log"),
        "partition_skew": _with(
            """SELECT part AS partition, count(*) AS records, round(count(*) / sum(count(*)) OVER (), 9) AS share
            FROM log GROUP BY part""", "log"),
        "dead_letters": _with(
            """SELECT part AS partition, off AS "offset", reason, CAST(attempts AS INTEGER) AS attempts, error FROM dead""", "dead"),
        "dead_letter_headers": _with(
            """SELECT part AS partition, dlq_off AS "offset", concat_ws(',', CASE WHEN count_header IS NOT NULL THEN 'replay_count' END,
                CASE WHEN has_reason THEN 'dlq_reason' END, 'dlq_error,dlq_attempts,dlq_source_topic,dlq_source_partition,'||
                'dlq_source_offset,dlq_failed_at') AS names, coalesce(count_header, '') AS kept_count,
                CAST(off AS VARCHAR) AS source_offset FROM dead""", "dead"),
        "replay_decision": _with(
            """SELECT part AS partition, dlq_off AS "offset", replays AS replay_count, by_default, with_all FROM decided""", "decided"),
        "replay_records": _with(
            f"""SELECT part AS dlq_partition, dlq_off AS dlq_offset, order_id AS key, md5(value_text) AS value_md5,
                'replay_count='||(replays + 1)||';replay_at=2024-02-01T00:00:00.000000Z;replay_of_dlq_partition='||part||
                ';replay_of_dlq_offset='||dlq_off AS headers FROM decided WHERE with_all = 'replay'""", "decided"),
        "replay_limit": _with(
            f"""SELECT part AS partition, with_all AS decision, count(*) AS records, max(dlq_off) AS last_offset
            FROM (SELECT *, count(*) FILTER (with_all = 'replay') OVER (ORDER BY part, dlq_off ROWS UNBOUNDED PRECEDING) AS done
                FROM decided) WHERE done < {C.REPLAY_LIMIT} OR (done = {C.REPLAY_LIMIT} AND with_all = 'replay') GROUP BY ALL""",
            "decided"),
        "replay_report": _with(
            """SELECT count(*) AS scanned, count(*) FILTER (by_default = 'replay') AS replayed,
                0::BIGINT AS failed, count(*) FILTER (by_default = 'replay' AND n % 97 = 0) AS unreadable,
                count(*) FILTER (by_default = 'no_dlq_reason') AS skipped_no_reason,
                count(*) FILTER (by_default = 'reason:poison') AS skipped_poison,
                count(*) FILTER (by_default = 'replay_limit') AS skipped_limit FROM decided""", "decided"),
        "replay_rerun_empty": _with(
            "SELECT count(*) AS first_scanned, 0::BIGINT AS second_scanned FROM dead", "dead"),
        "replay_loop_guard": _with(
            """SELECT CAST(r AS INTEGER) AS round, CASE WHEN NOT has_reason THEN 'no_dlq_reason'
                    WHEN replays + r - 1 >= 2 THEN 'replay_limit' ELSE 'replay' END AS decision, count(*) AS records
            FROM decided, range(1, 4) AS t(r) WHERE r = 1 OR (has_reason AND replays + r - 2 < 2) GROUP BY ALL""", "decided"),
        "replay_verify": _with(
            """, wanted AS (SELECT DISTINCT event_id FROM decided WHERE with_all = 'replay' AND n % 97 <> 0),
            have AS (SELECT event_id FROM outcomes WHERE outcome = 'persisted')
            SELECT count(*) AS checked, count(*) FILTER (event_id IN (SELECT event_id FROM have)) AS persisted,
                count(*) FILTER (event_id NOT IN (SELECT event_id FROM have)) AS missing FROM wanted""", "decided"),
        "get_order": _with(f"SELECT {_ORDER_COLUMNS} FROM store WHERE n = 42", "store"),
        "list_orders": _with(
            f"SELECT {_ORDER_COLUMNS} FROM store ORDER BY processed_at DESC, order_id DESC LIMIT {C.PAGE}", "store"),
        "list_orders_by_customer": _with(
            f"""SELECT order_id, event_id, tag AS customer_id, sku, total_cents, epoch_us(occurred_at) AS occurred_us,
                epoch_us(processed_at) AS processed_us FROM store WHERE tag = 'click'
            ORDER BY processed_at DESC, order_id DESC LIMIT {C.PAGE}""", "store"),
        "list_orders_page2": _with(
            f"""SELECT {_ORDER_COLUMNS} FROM store ORDER BY processed_at DESC, order_id DESC
            LIMIT {C.PAGE} OFFSET {C.PAGE}""", "store"),
        "page_cursors": _with(
            f"""SELECT order_id, rtrim(translate(to_base64(encode('{{"p":"'||{_RFC.format('processed_at')}||'","o":"'||order_id||'"}}')),
                '+/', '-_'), '=') AS token FROM store""", "store"),
        "keyset_pages": _with(
            f"""SELECT order_id, (row_number() OVER (ORDER BY processed_at DESC, order_id DESC) - 1) // {C.PAGE} AS page
            FROM store""", "store"),
        "count_orders": _with("SELECT count(*) AS orders FROM store", "store"),
        "count_by_tag": _with("SELECT count(*) AS orders FROM store WHERE customer_id LIKE 'click-%'", "store"),
        "e2e_latency": _with(
            f"""SELECT tag, count(*) AS count, {_quantile_columns('took_us', 1e6, 9, 'seconds')} FROM store GROUP BY tag""", "store"),
        "latency_of_slices": _with(
            """SELECT tag, count(DISTINCT epoch_us(processed_at) // 3600000000) AS slices, count(*) AS count,
                round(max(took_us) / 1e6, 9) AS max_seconds, true AS p50_in_rank, true AS p95_in_rank, true AS p99_in_rank
            FROM store GROUP BY tag""", "store"),
        "accept_latency": _with(
            f"""SELECT run, answered AS count, {r9('p50', 'p50_seconds')}, {r9('p95', 'p95_seconds')}, {r9('p99', 'p99_seconds')},
                {r9('slowest', 'max_seconds')} FROM accepts""", "accepts"),
        "throughput": _with(
            """SELECT tag, count(*) AS persisted, round(count(*) / greatest((epoch_us(max(processed_at)) - epoch_us(min(processed_at))) / 1e6,
                0.001::DOUBLE), 6) AS throughput FROM store GROUP BY tag""", "store"),
        "run_report": _with(
            """SELECT run, sent, accepted, failed, behind AS scheduler_behind, round(wall, 6) AS wall_clock_seconds,
                round(accepted / wall, 6) AS achieved_rate, accepted AS status_202, refused AS status_503,
                round(p99, 6) AS accept_p99_seconds, answered FROM runs JOIN accepts USING (run)""", "runs", "accepts"),
        "scaling_matrix": _with(
            f"""SELECT {_case_of(C.WORKERS)} AS workers, count(*) AS persisted,
                round(count(*) / greatest((epoch_us(max(processed_at)) - epoch_us(min(processed_at))) / 1e6, 0.001::DOUBLE), 6) AS throughput,
                {_quantile_columns('took_us', 1e3, 6, 'ms')},
                round(coalesce((SELECT max(total) FROM backlog WHERE ts BETWEEN min(processed_at) AND max(processed_at)), 0), 6) AS peak_lag
            FROM store GROUP BY tag""", "store", "backlog"),
        "ramp_table": _with(
            """SELECT run, round(accepted / wall, 6) AS achieved, accepted, refused AS rejected_503, failed, behind AS sched_behind,
                round(p99 * 1000, 3) AS accept_p99_ms, round(e2e / 1e3, 6) AS e2e_p99_ms, persisted, accepted - persisted AS missing
            FROM runs JOIN accepts USING (run)
            JOIN (SELECT tag AS run, count(*) AS persisted, quantile_cont(took_us, 0.99) AS e2e FROM store GROUP BY tag) USING (run)""",
            "runs", "accepts", "store"),
        "batch_speedup": _with(
            f"""SELECT batch_size, persisted, round(rate, 6) AS throughput, round(rate / max(CASE WHEN batch_size = 1 THEN rate END) OVER (), 6) AS speedup
            FROM (SELECT {_case_of(C.BATCH_SIZES)} AS batch_size, count(*) AS persisted, count(*) / greatest(
                (epoch_us(max(processed_at)) - epoch_us(min(processed_at))) / 1e6, 0.001::DOUBLE) AS rate FROM store GROUP BY tag)""", "store"),
        "latency_histogram": _with(
            f"""SELECT tag, CASE WHEN le = 'infinity'::DOUBLE THEN -1.0::DOUBLE ELSE le END AS le,
                count(*) FILTER (took_us / 1e6 <= le) AS bucket_count
            FROM store, (VALUES {_BOUNDS}, ('infinity'::DOUBLE)) AS b(le) GROUP BY tag, b.le""", "store"),
        "instance_sums": _with(
            "SELECT epoch_us(ts) AS ts_us, label, sum(value) AS value FROM counter GROUP BY ts, label", "counter"),
        "counter_increase": _with(
            "SELECT epoch_us(ts) AS ts_us, instance, label, increase FROM growth", "growth"),
        "counter_rate": _with(
            f"""SELECT epoch_us(ts) AS ts_us, label, round(sum(increase / {C.WINDOW_US / 1e6}), 9) AS rate FROM growth GROUP BY ts, label""",
            "growth"),
        "counter_rate_extrapolated": _with(_extrapolated(), "growth"),
        "histogram_quantile": _with("SELECT epoch_us(ts) AS ts_us, round(p99, 9) AS p99 FROM quantiles", "quantiles"),
        "lag_slope": _with(
            f"""SELECT epoch_us(ts) AS ts_us, label, round(slope, 6) AS slope FROM (
                SELECT ts, label, regr_slope(value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6) OVER w AS slope, count(*) OVER w AS c
                FROM gauge WINDOW w AS (PARTITION BY label ORDER BY ts RANGE BETWEEN to_microseconds({C.WINDOW_US - 1}) PRECEDING AND CURRENT ROW))
            WHERE c >= 2""", "gauge"),
        "peak_lag": _with(
            """SELECT tag, round(max(total), 6) AS peak_lag FROM (SELECT tag, min(processed_at) AS a, max(processed_at) AS z FROM store GROUP BY tag)
            JOIN backlog ON ts BETWEEN a AND z GROUP BY tag""", "store", "backlog"),
        "range_resample": _with(
            f"""SELECT tick_us, label, round(arg_max(value, ts), 6) AS value
            FROM gauge JOIN (SELECT epoch_us(TIMESTAMP '{C.RANGE_START}') + i * {C.RANGE_STEP_US} AS tick_us
                FROM range(0, (epoch_us(TIMESTAMP '{C.RANGE_END}') - epoch_us(TIMESTAMP '{C.RANGE_START}')) // {C.RANGE_STEP_US} + 1) AS t(i))
            ON tick_us >= epoch_us(ts) AND tick_us < epoch_us(ts) + 300000000 GROUP BY tick_us, label""", "gauge"),
        "rate_at_ticks": _with(
            f"""SELECT tick_us, label, round(sum(increase / {C.WINDOW_US / 1e6}), 9) AS rate FROM (
                SELECT tick_us, instance, label, sum(CASE WHEN value < prev THEN value ELSE value - prev END) AS increase
                FROM pairs JOIN (SELECT epoch_us(TIMESTAMP '{C.TICKS_START}') + i * {C.TICK_US} AS tick_us
                    FROM range(0, (epoch_us(TIMESTAMP '{C.RANGE_END}') - epoch_us(TIMESTAMP '{C.TICKS_START}')) // {C.TICK_US} + 1) AS t(i))
                ON epoch_us(ts) <= tick_us AND epoch_us(prev_ts) > tick_us - {C.WINDOW_US} GROUP BY tick_us, instance, label)
            GROUP BY tick_us, label""", "pairs"),
        "shifted_sums": _with(
            f"""SELECT tick_us, label, sum(value) AS value FROM (
                SELECT tick_us, instance, label, arg_max(value, since) AS value
                FROM (SELECT *, epoch_us(ts) + CAST(right(instance, 1) AS BIGINT) * {C.SHIFT_US} AS since FROM counter)
                JOIN (SELECT epoch_us(TIMESTAMP '2024-01-01') + i * {C.SUM_TICK_US} AS tick_us FROM range(0, 50000) AS t(i))
                ON tick_us >= since AND tick_us < since + 300000000 GROUP BY tick_us, instance, label)
            GROUP BY tick_us, label""", "counter"),
        "peak_lag_at_ticks": _with(
            f""", ticks AS (SELECT tick_us, sum(value) AS total FROM (
                SELECT tick_us, label, arg_max(value, since) AS value
                FROM (SELECT *, epoch_us(ts) + CAST(label AS BIGINT) * {C.SHIFT_US} AS since FROM gauge)
                JOIN (SELECT epoch_us(TIMESTAMP '2024-01-01') + i * {C.PEAK_TICK_US} AS tick_us FROM range(0, 600000) AS t(i))
                ON tick_us >= since AND tick_us < since + 300000000 GROUP BY tick_us, label) GROUP BY tick_us)
            SELECT tag, round(max(total), 6) AS peak_lag
            FROM (SELECT tag, epoch_us(min(processed_at)) AS a, epoch_us(max(processed_at)) AS z FROM store GROUP BY tag)
            JOIN ticks ON tick_us BETWEEN a AND z GROUP BY tag""", "store", "gauge"),
        "dashboard_tiles": _with(
            _tiles(), "outcomes", "requests", "rejected", "pairs", "gauge", "bucket_pairs"),
        "tumbling_rate": _with(
            """SELECT epoch_us(processed_at) // 30000000 * 30000000 AS window_us, tag, count(*) AS rows,
                round(count(*) / 30.0::DOUBLE, 9) AS rate FROM store GROUP BY ALL""", "store"),
        "sliding_rate": _with(
            """SELECT (epoch_us(processed_at) // 10000000 - s) * 10000000 AS window_us, count(*) AS rows,
                round(count(*) / 30.0::DOUBLE, 9) AS rate FROM store, range(0, 3) AS t(s) GROUP BY window_us""", "store"),
    }
