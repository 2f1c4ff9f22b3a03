"""DuckDB oracle SQL, written straight from ``lineitem``/``orders``/``events``.

The oracles do not share the hex encode/decode path with the Spark side: a
value is ``cents * 2^56 + l_partkey`` as a HUGEINT, an address is the hex of a
key, and dedup orders by the keys themselves (which sort like the fixed-width
lower-case hex that Spark orders by).
"""

from __future__ import annotations

from ..sources import fixtures as FX

WIDE_VALUE = str(2**256 - 1)  # the value of 64 x 'f'


def scaled_double_sql(text: str, decimals: int = 18) -> str:
    """value / 10^decimals: decimal point placed in the text, parsed once."""
    # lpad truncates longer text, so pad only short values
    p = f"(CASE WHEN length({text}) <= {decimals} THEN lpad({text}, {decimals + 1}, '0') ELSE {text} END)"
    return (
        f"CAST(substr({p}, 1, length({p}) - {decimals}) || '.' || substr({p}, length({p}) - {decimals - 1}, "
        f"{decimals}) AS DOUBLE)"
    )


TWO_POW_56 = str(2**56)

BASE_CTES = f"""
genesis AS (SELECT least(DATE '1995-01-01', min(CAST(o_orderdate AS DATE))) AS day1 FROM orders),
li AS (
  SELECT l.l_orderkey AS okey, l.l_linenumber AS lnum, l.l_partkey AS pkey, l.l_suppkey AS skey,
         o.o_custkey AS ckey, l.l_quantity AS qty, l.l_tax AS tax,
         l.l_returnflag AS rflag, l.l_linestatus AS lstatus,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents,
         l.l_extendedprice AS eprice, l.l_shipdate AS shipdate,
         CAST(date_diff('day', day1, CAST(o.o_orderdate AS DATE)) + 1 AS BIGINT) AS block_number, day1
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey CROSS JOIN genesis
),
logs0 AS (
  SELECT *,
    CASE WHEN lnum = 7 THEN 'topic_count'
         WHEN rflag = 'R' AND lstatus = 'O' THEN 'signature'
         WHEN tax = 0.08 THEN 'data_length' END AS reject_reason,
    qty = 50 AS wide,
    CAST(cents AS HUGEINT) * {TWO_POW_56} + pkey AS v,
    CAST(okey % 256 AS INTEGER) AS tx_index,
    CAST(lnum AS INTEGER) AS log_index,
    '0x' || lpad(lower(hex(okey)), 64, '0') AS tx_hash,
    '0x' || lpad(lower(hex(pkey)), 40, '0') AS token,
    '0x' || lpad(lower(hex(skey * 31)), 40, '0') AS "from",
    '0x' || lpad(lower(hex(ckey)), 40, '0') AS "to",
    CAST(day1 + to_days(CAST(block_number - 1 AS INTEGER)) AS TIMESTAMP) AS "timestamp",
    CAST(epoch(CAST(day1 AS TIMESTAMP)) + (block_number - 1) * 86400 AS BIGINT) AS block_time
  FROM li
),
logs AS (
  SELECT *,
    CASE WHEN wide THEN '{WIDE_VALUE}' ELSE CAST(v AS VARCHAR) END AS value_string,
    CASE WHEN wide THEN repeat('f', 64) ELSE lpad(lower(hex(v)), 64, '0') END AS value_hex
  FROM logs0
),
decoded AS (
  SELECT *,
    length(rtrim(value_string, '0')) <= 34 AS dec128_ok,
    CASE WHEN length(rtrim(value_string, '0')) <= 34
         THEN CAST(TRY_CAST(value_string AS DECIMAL(38,0)) AS VARCHAR) ELSE '0' END AS value_dec128,
    {scaled_double_sql("value_string")} AS value_decimal
  FROM logs WHERE reject_reason IS NULL
),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY okey, lnum ORDER BY block_number, tx_index, __ARRIVAL__ pkey, skey * 31, ckey, wide, v) AS rn
  FROM decoded
),
transfers AS (SELECT * FROM ranked WHERE rn = 1)
"""

TRANSFER_VIEW = """'Transfer' AS event_signature, token, "from", "to", value_hex, value_string,
  value_decimal, dec128_ok, value_dec128, block_number, tx_hash, tx_index, log_index, "timestamp\""""

CALL_LOG_CTE = """
call_log AS (
  SELECT 'p' || CAST(user_id % 4 AS VARCHAR) AS provider, 'm' || CAST(event_id % 3 AS VARCHAR) AS method, ts,
         value AS duration_s, event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN CASE WHEN value > 30 THEN 'timeout' ELSE 'server' END END AS error,
         event_id AS height, event_id AS seq
  FROM events
)
"""


# First wins among equal keys: delivery order (FIXTURES.md 2) where the source
# carries one, else the stored columns only (node exports).
ARRIVAL_ORDER = "pkey, skey, qty, eprice, shipdate,"


def with_base(*extra_ctes: str, arrival: bool = True) -> str:
    base = BASE_CTES.replace("__ARRIVAL__", ARRIVAL_ORDER if arrival else "")
    ctes = [base.strip()] + [c.strip() for c in extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n"


def aggregate_sql(where: str = "TRUE") -> str:
    return with_base(
        f"f AS (SELECT * FROM transfers WHERE {where})",
        """m AS (SELECT count(*) AS total_transfers,
                  sum(CASE WHEN dec128_ok THEN v ELSE 0 END) AS tv,
                  count(DISTINCT token) AS unique_tokens,
                  min("timestamp") AS s, max("timestamp") AS e FROM f)""",
        """a AS (SELECT count(DISTINCT addr) AS unique_addresses
                 FROM (SELECT "from" AS addr FROM f UNION ALL SELECT "to" AS addr FROM f))""",
    ) + """SELECT total_transfers,
  CASE WHEN total_transfers = 0 THEN '' ELSE CAST(tv AS VARCHAR) END AS total_value,
  COALESCE(""" + scaled_double_sql("CAST(tv AS VARCHAR)") + """, 0.0) AS total_value_decimal,
  unique_tokens, unique_addresses, s AS time_start, e AS time_end
FROM m, a"""


def listing_sql(where: str = "TRUE", limit: int | None = None, offset: int | str = 0) -> str:
    sql = with_base() + f"SELECT {TRANSFER_VIEW} FROM transfers WHERE {where}"
    if limit is not None:
        sql += f"\nORDER BY block_number DESC, log_index ASC, tx_hash ASC LIMIT {limit} OFFSET {offset}"
    return sql


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _instant_sql(c: str) -> str:
    """RFC 3339 text as UTC TIMESTAMP, NULL where it does not parse."""
    pattern = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}(?:\.\d+)?)(?:Z|([+-])(\d{2}):(\d{2}))$"
    part = lambda i: f"regexp_extract({c}, '{pattern}', {i})"
    minutes = f"coalesce(TRY_CAST({part(4)} AS INTEGER) * 60 + TRY_CAST({part(5)} AS INTEGER), 0)"
    return (f"CASE WHEN regexp_matches({c}, '{pattern}') THEN TRY_CAST({part(1)} || ' ' || {part(2)} AS TIMESTAMP)"
            f" - to_minutes(CASE WHEN {part(3)} = '-' THEN -1 ELSE 1 END * {minutes}) END")  # fmt: skip


def request_table_sql() -> str:
    """Every request against every transfer, straight from the definition."""
    addr = lambda x: f"'0x' || lpad(lower(hex({x})), 40, '0')"
    unsigned = lambda c: (
        f"CASE WHEN regexp_matches({c}, '^[+]?[0-9]+$') AND length({c}) < 30 AND TRY_CAST(ltrim({c}, '+') AS HUGEINT) <= {2**64 - 1}"
        f" THEN TRY_CAST(ltrim({c}, '+') AS HUGEINT) END"
    )
    return with_base(
        "ev AS (SELECT max(event_id) AS e, user_id AS u FROM events GROUP BY user_id, event_type)",
        f"""asked AS (SELECT e AS request_id,
  nullif(CASE WHEN e % 4 = 0 THEN {addr("e % 200 + 1")} WHEN e % 40 = 1 THEN '0x' || lpad('A', 40, '0') WHEN e % 4 = 2 THEN '' END, '') AS token,
  CASE WHEN e % 5 = 1 THEN {addr("(u % 10 + 1) * 31")} END AS sender, CASE WHEN e % 7 = 2 THEN {addr("u + 1")} END AS receiver,
  {_sql_list(FX.REQUEST_LIMITS)}[e % {len(FX.REQUEST_LIMITS)} + 1] AS lim, {_sql_list(FX.REQUEST_OFFSETS)}[e % {len(FX.REQUEST_OFFSETS)} + 1] AS off,
  CASE WHEN e % 13 = 0 THEN '{FX.MAX_UINT64}' WHEN e % 11 = 0 THEN '12x' WHEN e % 3 = 0 THEN '+' || (e % 2400) END AS b0,
  CASE WHEN e % 17 = 0 THEN '{FX.MAX_UINT64}0' WHEN e % 19 = 0 THEN '{FX.MAX_UINT64}' WHEN e % 2 = 0 THEN (e % 2400 + e % 400)::VARCHAR END AS b1,
  CASE WHEN e % 6 = 1 THEN '1995-06-01T02:30:00+02:30' WHEN e % 6 = 3 THEN '1996-13-01T00:00:00Z' WHEN e % 6 = 5 THEN '1996-01-01' END AS t0,
  CASE WHEN e % 8 = 3 THEN '1999-12-31T23:59:59.999Z' WHEN e % 8 = 5 THEN '2000-01-01T00:00:00-23:59' END AS t1 FROM ev)""",
        f"""parsed AS (SELECT request_id, token, sender, receiver, {unsigned("b0")} AS b0, {unsigned("b1")} AS b1, {_instant_sql("t0")} AS t0,
  {_instant_sql("t1")} AS t1, coalesce(TRY_CAST(nullif(lim, '') AS BIGINT), 100) AS lim, coalesce(TRY_CAST(nullif(off, '') AS BIGINT), 0) AS off FROM asked)""",
        """hits AS (SELECT request_id, t.block_number, t.log_index, t.tx_hash,
  row_number() OVER (PARTITION BY request_id ORDER BY t.block_number DESC, t.log_index, t.tx_hash) - 1 AS position, count(*) OVER (PARTITION BY request_id) AS n
  FROM parsed p JOIN transfers t ON (p.token IS NULL OR t.token = p.token) AND (sender IS NULL OR t."from" = sender) AND (receiver IS NULL OR t."to" = receiver)
   AND (b0 IS NULL OR t.block_number >= b0) AND (b1 IS NULL OR t.block_number <= b1) AND (t0 IS NULL OR t."timestamp" >= t0) AND (t1 IS NULL OR t."timestamp" <= t1)
  WHERE off >= 0)""",
    ) + """SELECT p.request_id, CASE WHEN off < 0 THEN 'negative_offset' END AS error,
  CASE WHEN off >= 0 THEN coalesce((SELECT max(n) FROM hits h WHERE h.request_id = p.request_id), 0) END AS total, lim AS "limit", off AS "offset",
  h.position, h.block_number, h.log_index, h.tx_hash
FROM parsed p LEFT JOIN hits h ON h.request_id = p.request_id AND h.position >= off
  AND h.position < off + CASE WHEN lim <= 0 THEN 100 WHEN lim > 1000 THEN 1000 ELSE lim END"""


def big_sum_text(terms: list[tuple[str, int]], small: str) -> str:
    """SQL text of ``small + sum(count_expr * constant)`` for constants wider than HUGEINT.

    Constants are cut into base-10^18 chunks (by rule), every chunk product fits a
    HUGEINT, and the carry runs in SQL; ``small`` is a HUGEINT expression < 10^36.
    """
    base = 10**18
    n = 5
    chunk_exprs = []
    for j in range(n):
        parts = []
        for expr, const in terms:
            d = (const // base**j) % base
            if d:
                parts.append(f"CAST({expr} AS HUGEINT) * {d}")
        if j == 0:
            parts.append(f"(CAST({small} AS HUGEINT) % {base})")
        elif j == 1:
            parts.append(f"(CAST({small} AS HUGEINT) // {base})")
        chunk_exprs.append(" + ".join(parts) if parts else "CAST(0 AS HUGEINT)")
    # x_j = s_j + x_{j-1} // base
    xs = []
    for j in range(n):
        xs.append(chunk_exprs[j] if j == 0 else f"({chunk_exprs[j]} + ({xs[j - 1]}) // {base})")
    pieces = [f"CAST({xs[n - 1]} AS VARCHAR)"] + [
        f"lpad(CAST(({xs[j]}) % {base} AS VARCHAR), 18, '0')" for j in reversed(range(n - 1))
    ]
    text = " || ".join(pieces)
    return f"COALESCE(NULLIF(ltrim({text}, '0'), ''), '0')"
