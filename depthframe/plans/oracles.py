"""The registered queries as DuckDB SQL over the given tables, built from shared parts."""

from __future__ import annotations

from .fixture import LEVELS_SQL

LV = f"lv AS ({LEVELS_SQL.format(div='//', lineitem='lineitem')})"
ONCE = """once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq, side, price_raw ORDER BY CASE WHEN kind = 'SNAPSHOT' THEN pos ELSE -pos END) AS nth FROM lv WHERE kind <> 'INVALIDATE') WHERE nth = 1
)"""
IV = """ended AS (
  SELECT o.*, lead(o.seq) OVER (PARTITION BY o.book, o.venue, o.side, o.price_raw ORDER BY o.seq) AS following FROM once o
), nexts AS (
  SELECT book, venue, seq, min(CASE WHEN kind <> 'DELTA' THEN seq END) OVER (PARTITION BY book, venue ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next_reset
  FROM (SELECT DISTINCT book, venue, seq, kind FROM lv)
), iv AS (
  SELECT e.book, e.venue, e.side, e.price_raw, e.size_raw, e.seq AS from_seq, least(e.following, n.next_reset) AS to_seq
  FROM ended e JOIN nexts n ON e.book = n.book AND e.venue = n.venue AND e.seq = n.seq WHERE e.size_raw > 0
)"""
DIFF = """moves AS (
  SELECT book, side, price_raw, seq, sum(d) AS d FROM (
    SELECT book, side, price_raw, from_seq AS seq, size_raw AS d FROM iv
    UNION ALL SELECT book, side, price_raw, to_seq, -size_raw FROM iv WHERE to_seq IS NOT NULL)
  GROUP BY ALL HAVING sum(d) <> 0
), diffs AS (
  SELECT book, seq, CAST(dense_rank() OVER (PARTITION BY book ORDER BY seq) AS BIGINT) AS book_seq, side, price_raw,
    CAST(sum(d) OVER (PARTITION BY book, side, price_raw ORDER BY seq) AS BIGINT) AS size_raw FROM moves
)"""
AGG = "agg AS (SELECT book, side, price_raw, CAST(sum(size_raw) AS BIGINT) AS size_raw FROM iv WHERE to_seq IS NULL GROUP BY ALL)"
BASE = f"WITH {LV}, {ONCE}, {IV}"
FULL = f"{BASE}, {DIFF}"
BEST = """SELECT {keys}, max(price_raw) FILTER (side = 'BID') AS bid_price_raw, arg_max(size_raw, price_raw) FILTER (side = 'BID') AS bid_size_raw,
  min(price_raw) FILTER (side = 'ASK') AS ask_price_raw, arg_min(size_raw, price_raw) FILTER (side = 'ASK') AS ask_size_raw FROM {source} GROUP BY {keys}"""
#: The size of every price that a book ever has, at every revision.
HELD = """revs AS (SELECT DISTINCT book, seq, book_seq FROM diffs),
grid AS (
  SELECT r.book, r.seq, r.book_seq, p.side, p.price_raw, last_value(d.size_raw IGNORE NULLS) OVER (PARTITION BY r.book, p.side, p.price_raw ORDER BY r.book_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size_raw
  FROM revs r JOIN (SELECT DISTINCT book, side, price_raw FROM diffs) p ON r.book = p.book
  LEFT JOIN diffs d ON d.book = r.book AND d.book_seq = r.book_seq AND d.side = p.side AND d.price_raw = p.price_raw
), alive AS (SELECT * FROM grid WHERE size_raw > 0)"""
BBO = f"""seen AS (SELECT r.book, r.seq, r.book_seq, h.side, h.price_raw, h.size_raw FROM revs r LEFT JOIN alive h ON h.book = r.book AND h.book_seq = r.book_seq),
best AS ({BEST.format(keys='book, seq, book_seq', source='seen')}),
bbo AS (SELECT book, seq, book_seq, bid_price_raw, bid_size_raw, ask_price_raw, ask_size_raw FROM (
  SELECT *, lag(row(bid_price_raw, bid_size_raw, ask_price_raw, ask_size_raw)) OVER (PARTITION BY book ORDER BY book_seq) AS p,
    row_number() OVER (PARTITION BY book ORDER BY book_seq) AS n FROM best)
  WHERE CASE WHEN n = 1 THEN bid_price_raw IS NOT NULL OR ask_price_raw IS NOT NULL
    ELSE row(bid_price_raw, bid_size_raw, ask_price_raw, ask_size_raw) IS DISTINCT FROM p END)"""
CLIENT = """ends AS (SELECT book, (2 * max(book_seq)) // 3 AS far FROM diffs GROUP BY book),
stream AS (SELECT d.book, book_seq AS arrival, book_seq, CASE WHEN book_seq = 1 THEN 'SNAPSHOT' ELSE 'DIFF' END AS row_kind, side, price_raw, size_raw FROM diffs d JOIN ends e ON d.book = e.book
  WHERE NOT (book_seq > 1 AND d.book % 4 <> 0 AND book_seq >= far AND (book_seq - far) % 501 = 0) AND (book_seq > 1 OR size_raw > 0)),
upd AS (SELECT *, lag(book_seq) OVER (PARTITION BY book ORDER BY arrival) AS previous FROM (SELECT book, arrival, book_seq, row_kind, count(*) AS levels FROM stream GROUP BY ALL)),
gap AS (SELECT book, arrival, previous + 1 AS expected, book_seq FROM upd WHERE book_seq <> previous + 1)"""


def half_away(n: str, d: str) -> str:
    """n / d rounded half away from zero, for integers with n >= 0 and d > 0."""
    return f"(CAST({n} AS HUGEINT) // CAST({d} AS HUGEINT) + CASE WHEN 2 * (CAST({n} AS HUGEINT) % CAST({d} AS HUGEINT)) >= CAST({d} AS HUGEINT) THEN 1 ELSE 0 END)"


NOTIONAL = half_away("CAST(price_raw AS HUGEINT) * size_raw", "1000000")


def price_bands(source: str, keys: str, reference: str, bps: tuple[int, ...]) -> str:
    """source: keys, side, price_raw, size_raw and reference; a band for each bps."""
    values = ", ".join(f"({i}, {b})" for i, b in enumerate(bps))
    inside = "CASE WHEN side = 'ASK' THEN CAST(price_raw AS HUGEINT) * 10000 <= CAST(reference AS HUGEINT) * (10000 + bps) ELSE CAST(price_raw AS HUGEINT) * 10000 >= CAST(reference AS HUGEINT) * (10000 - bps) END"
    return f"""SELECT {keys}, side, CAST(ord AS INT) AS ord, CAST(bps AS INT) AS bps,
  CAST(CASE WHEN side = 'ASK' THEN CAST(reference AS HUGEINT) * (10000 + bps) // 10000 ELSE (CAST(reference AS HUGEINT) * (10000 - bps) + 9999) // 10000 END AS BIGINT) AS boundary_raw,
  CAST(coalesce(sum(size_raw) FILTER ({inside}), 0) AS BIGINT) AS cum_size_raw,
  CAST(coalesce(sum({NOTIONAL}) FILTER ({inside}), 0) AS BIGINT) AS cum_notional_raw, 'OK' AS status
FROM ({reference.format(source=source)}), (VALUES {values}) AS t(ord, bps) GROUP BY {keys}, side, ord, bps, reference"""


OWN_BEST = "SELECT *, CASE WHEN side = 'BID' THEN max(price_raw) OVER (PARTITION BY {keys}, side) ELSE min(price_raw) OVER (PARTITION BY {keys}, side) END AS reference FROM {{source}}"


def volume_bands(thresholds: tuple[int, ...], source: str = "agg", keys: str = "book") -> str:
    values = ", ".join(f"({i}, CAST({t} AS HUGEINT))" for i, t in enumerate(thresholds))
    partial = "((n0 + threshold_raw - n0) * CAST(price_raw AS HUGEINT))"
    whole = "(s0 * CAST(price_raw AS HUGEINT) + (threshold_raw - n0) * 1000000)"
    rest = half_away(f"({partial} % {whole}) * 1000000", whole)
    return f"""walked AS (
  SELECT *, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(CAST(size_raw AS HUGEINT)) OVER w, 0) AS s0 FROM (SELECT *, {NOTIONAL} AS n FROM {source})
  WINDOW w AS (PARTITION BY {keys}, side ORDER BY CASE WHEN side = 'BID' THEN -price_raw ELSE price_raw END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), crossed AS (
  SELECT {keys}, side, ord, CASE WHEN threshold_raw - n0 = n THEN {half_away('threshold_raw * 1000000', '(s0 + size_raw)')}
    ELSE ({partial} // {whole}) * 1000000 + {rest} END AS vwap
  FROM walked, (VALUES {values}) AS t(ord, threshold_raw) WHERE n0 < threshold_raw AND threshold_raw <= n0 + n
), sides AS (
  SELECT * FROM (SELECT DISTINCT {keys} FROM {source}), (VALUES ('BID'), ('ASK')) AS s(side)
), totals AS (SELECT {keys}, side, sum(n) AS total FROM walked GROUP BY ALL)
SELECT {keys}, side, CAST(t.ord AS INT) AS ord, CAST(t.threshold_raw AS BIGINT) AS threshold_raw, CAST(c.vwap AS BIGINT) AS vwap_raw,
  CAST(CASE WHEN c.ord IS NOT NULL THEN t.threshold_raw ELSE coalesce(o.total, 0) END AS BIGINT) AS filled_raw, 'OK' AS status
FROM sides s CROSS JOIN (VALUES {values}) AS t(ord, threshold_raw)
LEFT JOIN crossed c USING ({keys}, side, ord) LEFT JOIN totals o USING ({keys}, side)"""
