"""Column contract and table schemas."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# The column contract of a source file and the name of the file
# that is always processed last.
REQUIRED_COLUMNS = ("timestamp", "price", "user_id")
VALIDATION_FILE_NAME = "validation.csv"

PRICE_REASON = "PRICE_NULL_OR_NON_NUMERIC"
LONG_ROW_REASON = "ROW_LONGER_THAN_HEADER"

SOURCE_PHASE = 0
VALIDATION_PHASE = 1


def _struct(*fields):
    return StructType([StructField(name, kind, True) for name, kind in fields])


# Sums as decimals of any scale are stored as text; NULL where sums are doubles.
EXACT_TOTAL, EXACT_STATE = ("accumulated_exact", StringType()), ("global_exact", StringType())

# Place of an ingest among those of its warehouse, and of a file in its ingest, both from 1.
LOAD_ORDER = (("ingest_no", LongType()), ("file_no", LongType()))

RAW_TRANSACTIONS = _struct(
    ("timestamp", TimestampNTZType()),
    ("price", DoubleType()),
    ("user_id", LongType()),
    ("file_name", StringType()),
    ("loaded_at", TimestampNTZType()),
    ("batch_id", StringType()),
    ("chunk_index", LongType()),
    ("ordinal", LongType()),
    ("ingest_key", StringType()),
    *LOAD_ORDER,
)

REJECTED_TRANSACTIONS = _struct(
    ("timestamp", TimestampNTZType()),
    ("price", StringType()),
    ("user_id", LongType()),
    ("file_name", StringType()),
    ("reject_reason", StringType()),
    ("batch_id", StringType()),
    ("raw_price", StringType()),
    ("chunk_index", LongType()),
    ("ordinal", LongType()),
    ("ingest_key", StringType()),
)

# One physical layout for both branches of the split: a single pass over the
# source writes them side by side, partitioned by (branch, ingest_key).
TRANSACTIONS = _struct(
    ("timestamp", TimestampNTZType()),
    ("price", DoubleType()),
    ("user_id", LongType()),
    ("file_name", StringType()),
    ("loaded_at", TimestampNTZType()),
    ("batch_id", StringType()),
    ("reject_reason", StringType()),
    ("raw_price", StringType()),
    ("chunk_index", LongType()),
    ("ordinal", LongType()),
    *LOAD_ORDER,
    ("branch", StringType()),
    ("ingest_key", StringType()),
)

STATISTICS_HISTORY = _struct(
    ("batch_id", StringType()),
    ("file_name", StringType()),
    ("processed_at", TimestampNTZType()),
    ("batch_rows", LongType()),
    ("total_accumulated_rows", LongType()),
    ("accumulated_sum", DoubleType()),
    ("accumulated_avg", DoubleType()),
    ("global_min_price", DoubleType()),
    ("global_max_price", DoubleType()),
    ("batch_sum", DoubleType()),
    ("chunk_index", LongType()),
    *LOAD_ORDER,
    EXACT_TOTAL,
    ("ingest_key", StringType()),
)

STATE = _struct(
    ("global_count", LongType()),
    ("global_sum", DoubleType()),
    ("global_min", DoubleType()),
    ("global_max", DoubleType()),
)

COMMITS = _struct(
    ("version", LongType()),
    ("ingest_key", StringType()),
    *[(f.name, f.dataType) for f in STATE],
    EXACT_STATE,
    ("files", ArrayType(StringType())),
)

COMMIT_KEYS = _struct(
    ("version", LongType()),
    ("ingest_key", StringType()),
    *[(f.name, f.dataType) for f in STATE],
    EXACT_STATE,
)

DONE_NAMES = _struct(("file_name", StringType()), ("bucket", IntegerType()))

SOURCE_BLOCKS = _struct(
    ("file_path", StringType()),
    ("block_start", LongType()),
    ("block_rows", LongType()),
    ("first_mid", LongType()),
    ("header_line", StringType()),
    ("ingest_key", StringType()),
)

QUARANTINED_FILES = _struct(
    ("missing", ArrayType(StringType())),
    ("ingest_key", StringType()),
    ("file_name", StringType()),
)

FILE_LISTING = _struct(
    ("path", StringType()),
    ("file_name", StringType()),
    ("length", LongType()),
    # Time of the last change, as text: it only tells versions of a file apart.
    ("changed", StringType()),
)
