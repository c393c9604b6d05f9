"""Names, ids and display lines as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def decoded_path(uri: Column) -> Column:
    """``_metadata.file_path`` is percent-encoded; a literal plus sign is not."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def batch_id_ends(file_name: Column) -> tuple[Column, Column]:
    """What a batch id says before and after its number; the same for all batches of a file."""
    digest = F.substring(F.sha2(file_name, 256), 1, 8)
    # Fixed value: the infix of a batch id.
    return F.concat(file_stem(file_name), F.lit("-lote-")), F.concat(F.lit("-"), digest)


def numbered_batch(prefix: Column, chunk_index: Column, suffix: Column) -> Column:
    """Batch id from its parts; the number has four digits or more."""
    number = chunk_index.cast("string")
    padded = F.when(chunk_index < 10_000, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(prefix, padded, suffix)


def batch_id(file_name: Column, chunk_index: Column) -> Column:
    """Readable and repeatable: a retried or replayed task draws the same id."""
    prefix, suffix = batch_id_ends(file_name)
    return numbered_batch(prefix, chunk_index, suffix)


def two_decimals(value: Column) -> Column:
    """Two decimals without grouping, ties judged on the binary value; NULL prints ``None``."""
    shown = F.call_function("format_number", value, F.lit("0.00"))
    signed_infinity = F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return F.coalesce(
        F.when(F.abs(value) == F.lit(float("inf")), signed_infinity).otherwise(shown),
        F.lit("None"),
    )


def _labelled_line(parts) -> Column:
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{label}="), text) for label, text in parts])


def batch_summary_line() -> Column:
    """One display line per history row (fixed labels)."""
    return _labelled_line([
        ("id_lote", F.col("batch_id")),
        ("archivo", F.col("file_name")),
        ("filas_lote", F.col("batch_rows").cast("string")),
        ("suma_lote", two_decimals(F.col("batch_sum"))),
        ("total_filas", F.col("total_accumulated_rows").cast("string")),
        ("promedio_acumulado", two_decimals(F.col("accumulated_avg"))),
        ("min_global", two_decimals(F.col("global_min_price"))),
        ("max_global", two_decimals(F.col("global_max_price"))),
    ])


def scan_summary_line() -> Column:
    """Display line for a full-scan result row (fixed labels)."""
    return _labelled_line([
        ("total_filas_db", F.col("row_count").cast("string")),
        ("promedio_db", two_decimals(F.col("avg_price"))),
        ("minimo_db", two_decimals(F.col("min_price"))),
        ("maximo_db", two_decimals(F.col("max_price"))),
    ])
