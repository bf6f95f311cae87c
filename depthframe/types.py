"""Schemas and scales. Prices, sizes and notionals are integers: the number times its scale."""

PRICE_DECIMALS, SIZE_DECIMALS, NOTIONAL_DECIMALS = 9, 6, 9
SIZE_SCALE = 10**SIZE_DECIMALS
INT64_MAX = 2**63 - 1
INT128_MAX = 2**127 - 1

LEVEL = "struct<price_raw:bigint,size_raw:bigint>"
RAW_MESSAGES = "recv_seq BIGINT, recv_ts TIMESTAMP, venue STRING, conn_epoch BIGINT, source STRING, request_symbol STRING, text STRING"
L2_MESSAGES = f"recv_seq BIGINT, recv_ts TIMESTAMP, venue STRING, conn_epoch BIGINT, native_symbol STRING, status STRING, kind STRING, first_id DECIMAL(20,0), final_id DECIMAL(20,0), prev_final_id DECIMAL(20,0), last_update_id DECIMAL(20,0), bids ARRAY<{LEVEL}>, asks ARRAY<{LEVEL}>"
SUBSCRIPTIONS = "exchange STRING, market STRING, base STRING, quote STRING, venue STRING, native_symbol STRING"
IDLE_TIMEOUTS = "exchange STRING, market STRING, seconds INT"
L2_DIFF = "book INT, seq BIGINT, book_seq BIGINT, side STRING, price_raw BIGINT, size_raw BIGINT"

# Statuses of rows that can't be computed, and of messages.
OUT_OF_DOMAIN, OUT_OF_RANGE = "ARGUMENT_OUT_OF_DOMAIN", "RESULT_OUT_OF_RANGE"
SNAPSHOT, DELTA, INVALIDATE, REQUEST = "SNAPSHOT", "DELTA", "INVALIDATE", "REQUEST_SNAPSHOT"
#: An invalidation after which nothing of the same connection counts.
DROPPED = "DROPPED"
IGNORED, MALFORMED = "IGNORED", "MALFORMED"
