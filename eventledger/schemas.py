"""Schemas and the fixed names and numbers every part of the package shares."""

from pyspark.sql import types as T

# Names and limits other programs rely on.

EVENT_TYPE_CREATED = "order.created"

SOURCE_TOPIC = "orders"
DEAD_LETTER_TOPIC = "orders.dlq"

MAX_BODY_BYTES = 1 << 20
MAX_IDEMPOTENCY_KEY_BYTES = 255
ID_NAMESPACE = "6f9619ff-8b86-d011-b42d-00c04fc964ff"

DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500

DLQ_REASON = "dlq_reason"
DLQ_ERROR = "dlq_error"
DLQ_ATTEMPTS = "dlq_attempts"
DLQ_SOURCE_TOPIC = "dlq_source_topic"
DLQ_SOURCE_PARTITION = "dlq_source_partition"
DLQ_SOURCE_OFFSET = "dlq_source_offset"
DLQ_FAILED_AT = "dlq_failed_at"

REPLAY_COUNT = "replay_count"
REPLAY_AT = "replay_at"
REPLAY_OF_PARTITION = "replay_of_dlq_partition"
REPLAY_OF_OFFSET = "replay_of_dlq_offset"
REPLAY_HEADERS = [REPLAY_COUNT, REPLAY_AT, REPLAY_OF_PARTITION, REPLAY_OF_OFFSET]

POISON = "poison"
RETRIES_EXHAUSTED = "retries_exhausted"

PERSISTED = "persisted"
DUPLICATE = "duplicate"
DEAD_LETTER = "dead_letter"

DEFAULT_MAX_REPLAYS = 2

# Backoff: first delay, ceiling of one delay, budget of a whole retry loop.
BACKOFF_BASE_MS = 100
BACKOFF_MAX_MS = 5_000
BACKOFF_BUDGET_MS = 45_000

# Histogram bucket bounds in seconds.
PROCESSING_BUCKETS = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30]
END_TO_END_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60]
PRODUCE_BUCKETS = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5]

# Schemas.

ITEM = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("unit_price_cents", T.LongType()),
])

REQUEST = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
])

EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("total_cents", T.LongType()),
])

HEADERS = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.BinaryType()),
]))

# The row shape of Spark's Kafka source with includeHeaders=true.
RECORD = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestampType", T.IntegerType()),
    T.StructField("headers", HEADERS),
])

STORE = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("total_cents", T.LongType()),
    T.StructField("occurred_at", T.TimestampType()),
    T.StructField("processed_at", T.TimestampType()),
])

# Committed offsets of a group, appended by each run.
OFFSETS = T.StructType([
    T.StructField("group_id", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("next_offset", T.LongType()),
])
