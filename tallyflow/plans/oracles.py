"""The same queries as plain SQL for an independent engine."""

from tallyflow.plans.feeds import LARGE
from tallyflow.plans.roundtrip import ROWS_PER_FILE

_TEXTS = """
texts AS (
    SELECT event_id,
           CASE WHEN day(ts) = 15 THEN 'validation.csv'
                ELSE printf('zday-%02d.csv', day(ts)) END AS file_name,
           CASE WHEN day(ts) = 15 THEN 1 ELSE 0 END AS phase,
           CASE WHEN event_id % 19 = 0 THEN 'not-a-date'
                ELSE month(ts) || '/' || day(ts) || '/' || year(ts) END AS ts_raw,
           CASE WHEN event_id % 17 = 0 OR event_id BETWEEN 700 AND 799 OR day(ts) = 20 THEN NULL
                WHEN event_id % 23 = 0 THEN 'N/A'
                WHEN event_id % 29 = 0 THEN '1,000'
                ELSE CAST(value AS VARCHAR) END AS price_raw,
           CASE WHEN event_id % 31 = 0 THEN 'anon'
                ELSE CAST(user_id AS VARCHAR) END AS user_raw
    FROM events
),
typed AS (
    SELECT event_id, file_name, phase,
           try_strptime(ts_raw, '%m/%d/%Y') AS "timestamp",
           TRY_CAST(price_raw AS DOUBLE) AS price,
           TRY_CAST(user_raw AS BIGINT) AS user_id,
           price_raw
    FROM texts
)"""

_ROWS = _TEXTS + """,
placed AS (
    SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY event_id) - 1 AS ordinal
    FROM typed
),
coerced AS (SELECT *, ordinal // 10 + 1 AS chunk_index FROM placed)"""


def _metrics(source: str) -> str:
    return f"""
metrics AS (
    SELECT phase, file_name, chunk_index,
           count(price) AS row_count,
           coalesce(sum(CAST(price AS DECIMAL(18,2))), 0) AS price_sum,
           min(price) AS min_price,
           max(price) AS max_price
    FROM {source} GROUP BY phase, file_name, chunk_index
)"""


_BATCH_ID = (
    "regexp_replace(file_name, '\\.[^.]*$', '') || '-lote-' || printf('%04d', chunk_index)"
    " || '-' || substr(sha256(file_name), 1, 8)"
)

_HISTORY = f"""
running AS (
    SELECT phase, file_name, chunk_index,
           {_BATCH_ID} AS batch_id,
           row_count AS batch_rows,
           CAST(price_sum AS DOUBLE) AS batch_sum,
           CAST(sum(row_count) OVER w AS BIGINT) AS total_accumulated_rows,
           CAST(sum(price_sum) OVER w AS DOUBLE) AS accumulated_sum,
           CAST(sum(price_sum) OVER w AS DOUBLE) / (sum(row_count) OVER w) AS accumulated_avg,
           min(min_price) OVER w AS global_min_price,
           max(max_price) OVER w AS global_max_price
    FROM metrics WHERE row_count > 0
    WINDOW w AS (ORDER BY phase, file_name, chunk_index)
)"""

_HISTORY_COLUMNS = """batch_id, file_name, chunk_index, batch_rows, total_accumulated_rows,
    accumulated_sum, accumulated_avg, global_min_price, global_max_price"""

_EVENT_METRICS = _ROWS + "," + _metrics("coerced")
_EVENT_HISTORY = _EVENT_METRICS + "," + _HISTORY

_EARLY = "(phase = 0 AND file_name <= 'zday-16.csv')"
_LOADED = "phase DESC, file_name DESC"

_SCAN = """
scan AS (
    SELECT count(*) AS row_count,
           CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price,
           min(price) AS min_price,
           max(price) AS max_price
    FROM typed WHERE price IS NOT NULL
)"""

def _orders(order: str) -> str:
    return f"""
placed AS (
    SELECT 0 AS phase, substr(o_orderpriority, 1, 1) || '-priority.csv' AS file_name,
           CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS price,
           (row_number() OVER (PARTITION BY substr(o_orderpriority, 1, 1)
                               ORDER BY {order}) - 1) // 100 + 1 AS chunk_index
    FROM orders
)"""


_SHIPMENTS = """
days AS (
    SELECT 0 AS phase, strftime(l_shipdate, '%Y-%m') AS file_name,
           CAST(day(l_shipdate) AS BIGINT) AS chunk_index,
           CASE WHEN l_quantity <> 13 THEN l_extendedprice END AS price
    FROM lineitem
)"""

# Files of the CSV round trip: ranges of event ids, written and read in order.
_WRITTEN = _TEXTS + f""",
placed AS (
    SELECT t.*, t.event_id // {ROWS_PER_FILE} AS file_no,
           row_number() OVER (PARTITION BY t.event_id // {ROWS_PER_FILE} ORDER BY t.event_id) - 1
               AS ordinal
    FROM typed t
),
coerced AS (SELECT *, ordinal // 10 + 1 AS chunk_index FROM placed)"""


# The reserved file repeats the last one and comes after all others.
_WITH_RESERVED = """,
loaded AS (
    SELECT * FROM coerced
    UNION ALL
    SELECT * REPLACE (file_no + 1 AS file_no) FROM coerced
    WHERE file_no = (SELECT max(file_no) FROM coerced)
)"""

_WRITTEN_HISTORY = """,
metrics AS (
    SELECT file_no, chunk_index, count(*) AS row_count,
           sum(CAST(price AS DECIMAL(18,2))) AS price_sum,
           min(price) AS min_price, max(price) AS max_price
    FROM loaded WHERE price IS NOT NULL GROUP BY file_no, chunk_index
),
running AS (
    SELECT file_no, chunk_index, row_count AS batch_rows,
           CAST(price_sum AS DOUBLE) AS batch_sum,
           CAST(sum(row_count) OVER w AS BIGINT) AS total_accumulated_rows,
           CAST(sum(price_sum) OVER w AS DOUBLE) AS accumulated_sum,
           CAST(sum(price_sum) OVER w AS DOUBLE) / (sum(row_count) OVER w) AS accumulated_avg,
           min(min_price) OVER w AS global_min_price,
           max(max_price) OVER w AS global_max_price
    FROM metrics WINDOW w AS (ORDER BY file_no, chunk_index)
)"""

_WRITTEN_TOTALS = """chunk_index, batch_rows, batch_sum, total_accumulated_rows, accumulated_sum,
    accumulated_avg, global_min_price, global_max_price"""

# Two runs of half the files each: ingest, and place of the file in it.
_PLACES = """,
halves AS (SELECT (max(file_no) + 2) // 2 AS half FROM coerced),
places AS (
    SELECT DISTINCT file_no, CAST(CASE WHEN file_no < half THEN 1 ELSE 2 END AS BIGINT) AS ingest_no,
           CASE WHEN file_no < half THEN file_no + 1 ELSE file_no - half + 1 END AS place
    FROM coerced, halves
)"""


def _select(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


_HISTORY_ROWS = f"SELECT {_HISTORY_COLUMNS} FROM running"

_STATE = """
SELECT count(price) AS global_count,
       CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS global_sum,
       min(price) AS global_min,
       max(price) AS global_max"""

_SIDE_BY_SIDE = """
SELECT row_count AS state_row_count, avg_price AS state_avg_price,
       min_price AS state_min_price, max_price AS state_max_price,
       row_count AS scan_row_count, avg_price AS scan_avg_price,
       min_price AS scan_min_price, max_price AS scan_max_price,
       true AS matches
FROM scan"""

_REASON = "'PRICE_NULL_OR_NON_NUMERIC' AS reject_reason"

_WRITTEN_ROWS = _select(
    _WRITTEN,
    """SELECT file_no, chunk_index, ordinal, "timestamp", price, user_id
       FROM coerced WHERE price IS NOT NULL""",
)

ORACLES = {
    "chunk_assignment": _select(_ROWS, "SELECT event_id, file_name, chunk_index FROM coerced"),
    "coerced_rows": _select(_TEXTS, 'SELECT event_id, "timestamp", price, user_id FROM typed'),
    "valid_rows": _select(
        _ROWS,
        """SELECT event_id, "timestamp", price, user_id, file_name, chunk_index,
                  regexp_replace(file_name, '\\.[^.]*$', '') AS file_stem
           FROM coerced WHERE price IS NOT NULL""",
    ),
    "rejected_rows": _select(
        _ROWS,
        f"""SELECT event_id, "timestamp", CAST(NULL AS VARCHAR) AS price, user_id, file_name,
                   chunk_index, {_REASON}, price_raw AS raw_price
            FROM coerced WHERE price IS NULL""",
    ),
    "batch_ids": _select(
        _ROWS, f"SELECT DISTINCT file_name, chunk_index, {_BATCH_ID} AS batch_id FROM coerced"
    ),
    "batch_metrics": _select(
        _EVENT_METRICS,
        """SELECT file_name, chunk_index, row_count, CAST(price_sum AS DOUBLE) AS price_sum,
                  min_price, max_price FROM metrics""",
    ),
    "running_history": _select(_EVENT_HISTORY, _HISTORY_ROWS),
    "history_from_state": _select(_EVENT_HISTORY, f"{_HISTORY_ROWS} WHERE NOT {_EARLY}"),
    "final_state": _select(
        _TEXTS,
        f"""{_STATE},
       (SELECT string_agg(file_name, ',' ORDER BY file_name)
        FROM (SELECT DISTINCT file_name FROM texts)) AS processed_files
FROM typed""",
    ),
    "merged_state_two_runs": _select(
        _TEXTS + "," + _SCAN,
        """SELECT row_count AS total_rows,
                  (SELECT CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) FROM typed)
                      AS accumulated_sum,
                  avg_price AS accumulated_avg,
                  min_price AS global_min_price, max_price AS global_max_price
           FROM scan""",
    ),
    "exact_state_any_split": f"""
        WITH totals AS (
            SELECT count(*) AS total_rows, sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * {LARGE} AS DECIMAL(28,2))) AS exact
            FROM orders
        )
        SELECT runs, way, total_rows, CAST(exact AS VARCHAR) AS exact_sum, CAST(exact AS DOUBLE) AS shown_sum
        FROM totals, (SELECT unnest([1, 2, 3]::BIGINT[]) AS runs), (SELECT unnest(['merged', 'history']) AS way)""",
    "pending_files": _select(
        _TEXTS, f"SELECT DISTINCT file_name FROM texts WHERE NOT {_EARLY}"
    ),
    "missing_columns": _select(
        _TEXTS
        + """,
profile AS (
    SELECT file_name, count(price_raw) = 0 AS no_price,
           coalesce(min(TRY_CAST(user_raw AS BIGINT)) % 2 = 0, false) AS no_user
    FROM texts GROUP BY file_name
)""",
        """SELECT file_name,
                  concat_ws(', ', CASE WHEN no_price THEN 'price' END,
                                  CASE WHEN no_user THEN 'user_id' END) AS missing
           FROM profile WHERE no_price OR no_user""",
    ),
    "full_scan_stats": _select(_TEXTS + "," + _SCAN, "SELECT * FROM scan"),
    "scan_summary": _select(
        _TEXTS + "," + _SCAN,
        """SELECT 'total_filas_db=' || row_count
                  || ' | promedio_db=' || coalesce(printf('%.2f', avg_price), 'None')
                  || ' | minimo_db=' || coalesce(printf('%.2f', min_price), 'None')
                  || ' | maximo_db=' || coalesce(printf('%.2f', max_price), 'None') AS summary
           FROM scan""",
    ),
    "reconciliation": _select(_TEXTS + "," + _SCAN, _SIDE_BY_SIDE),
    "recent_history": _select(
        _EVENT_HISTORY, f"{_HISTORY_ROWS} ORDER BY {_LOADED}, chunk_index DESC LIMIT 10"
    ),
    "recent_rows": _select(
        _ROWS,
        f"""SELECT event_id, "timestamp", price, user_id, file_name, chunk_index FROM coerced
            WHERE price IS NOT NULL
            ORDER BY {_LOADED}, chunk_index DESC, ordinal LIMIT 5""",
    ),
    "batch_summary": _select(
        _EVENT_HISTORY,
        """SELECT file_name, chunk_index,
                  'id_lote=' || batch_id || ' | archivo=' || file_name
                  || ' | filas_lote=' || batch_rows
                  || ' | suma_lote=' || printf('%.2f', batch_sum)
                  || ' | total_filas=' || total_accumulated_rows
                  || ' | promedio_acumulado=' || coalesce(printf('%.2f', accumulated_avg), 'None')
                  || ' | min_global=' || coalesce(printf('%.2f', global_min_price), 'None')
                  || ' | max_global=' || coalesce(printf('%.2f', global_max_price), 'None')
                  AS summary
           FROM running""",
    ),
    "orders_running_history": _select(
        _orders("o_orderkey") + "," + _metrics("placed") + "," + _HISTORY, _HISTORY_ROWS
    ),
    # Hexadecimal digits of one length sort like the number they stand for.
    "sparse_id_history": _select(
        _orders("substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15)") + "," + _metrics("placed") + "," + _HISTORY,
        _HISTORY_ROWS,
    ),
    "shipments_running_history": _select(
        _SHIPMENTS + "," + _metrics("days") + "," + _HISTORY, _HISTORY_ROWS
    ),
    "csv_roundtrip_history": _select(
        _WRITTEN
        + """,
metrics AS (
    SELECT file_no, chunk_index, count(*) AS row_count,
           sum(CAST(price AS DECIMAL(18,2))) AS price_sum,
           min(price) AS min_price, max(price) AS max_price
    FROM coerced WHERE price IS NOT NULL GROUP BY file_no, chunk_index
)""",
        """SELECT file_no, chunk_index, row_count AS batch_rows,
                  CAST(price_sum AS DOUBLE) AS batch_sum,
                  CAST(sum(row_count) OVER w AS BIGINT) AS total_accumulated_rows,
                  CAST(sum(price_sum) OVER w AS DOUBLE) AS accumulated_sum,
                  CAST(sum(price_sum) OVER w AS DOUBLE) / (sum(row_count) OVER w)
                      AS accumulated_avg,
                  min(min_price) OVER w AS global_min_price,
                  max(max_price) OVER w AS global_max_price
           FROM metrics WINDOW w AS (ORDER BY file_no, chunk_index)""",
    ),
    "csv_roundtrip_raw": _WRITTEN_ROWS,
    "csv_mixed_headers": _WRITTEN_ROWS,
    "csv_roundtrip_rejects": _select(
        _WRITTEN,
        f"""SELECT file_no, chunk_index, ordinal, "timestamp", CAST(NULL AS VARCHAR) AS price,
                   user_id, {_REASON}, price_raw AS raw_price
            FROM coerced WHERE price IS NULL""",
    ),
    "repeated_batch_ids": _select(_EVENT_HISTORY, f"SELECT batch_id, CAST(2 AS BIGINT) AS n FROM running WHERE {_EARLY}"),
    "ingest_counts": _select(
        _WRITTEN,
        """SELECT file_no // 3 + 1 AS version, count(DISTINCT file_no) AS n_files,
                  count(price) AS rows_accepted, count(*) - count(price) AS rows_rejected
           FROM coerced GROUP BY file_no // 3""",
    ),
    "state_document_roundtrip": _select(
        _WRITTEN,
        f"""{_STATE},
       count(DISTINCT file_no) AS n_files
FROM coerced""",
    ),
    "stream_validation_phase": _select(
        _WRITTEN + _WITH_RESERVED + _WRITTEN_HISTORY,
        f"SELECT {_WRITTEN_TOTALS} FROM running WHERE file_no = (SELECT max(file_no) FROM running)",
    ),
    "stored_recent_rows": _select(
        _WRITTEN + _PLACES,
        """SELECT ingest_no, place AS file_no, chunk_index, ordinal, "timestamp", price, user_id
           FROM coerced JOIN places USING (file_no) WHERE price IS NOT NULL
           ORDER BY ingest_no DESC, place DESC, chunk_index DESC, ordinal LIMIT 5""",
    ),
    "stored_recent_history": _select(
        _WRITTEN + ", loaded AS (SELECT * FROM coerced)" + _WRITTEN_HISTORY + _PLACES,
        f"""SELECT ingest_no, place AS file_no, {_WRITTEN_TOTALS} FROM running JOIN places USING (file_no)
            ORDER BY ingest_no DESC, place DESC, chunk_index DESC LIMIT 10""",
    ),
    "stream_ingest_state": _select(
        _WRITTEN,
        f"""{_STATE},
       count(DISTINCT file_no) AS n_files
FROM coerced""",
    ),
    "stream_ingest_reconciliation": _select(_TEXTS + "," + _SCAN, _SIDE_BY_SIDE),
}
