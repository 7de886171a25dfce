"""Small ledgers for tests: one action, credit and optional debit per block."""

from blockloom.functions.canon import encode_binary_json
from pyspark.sql import functions as F

ROW = "action_index bigint, address_id bigint, tick_id bigint, amount string"


def build(spark, heights, amount="1000", debit=None):
    """Tables of blocks where block B has action 100*B and one credit to address B."""
    h = list(heights)
    return {
        "blocks": spark.createDataFrame([(b, 1_700_000_000 + b) for b in h], "block_index bigint, block_time bigint"),
        "transactions": spark.createDataFrame([(10 * b, b) for b in h], "tx_index bigint, block_index bigint"),
        "actions": spark.createDataFrame([(100 * b, b, 10 * b, "SEND") for b in h], "action_index bigint, block_index bigint, tx_index bigint, action string"),
        "credits": spark.createDataFrame([(100 * b, b % 5, 1, amount) for b in h], ROW),
        "debits": spark.createDataFrame([(100 * b, b % 5, 1, debit) for b in h if debit], ROW),
        "escrows": spark.createDataFrame([], ROW),
        "index_addresses": spark.createDataFrame([(i, f"addr{i}", None) for i in range(5)], "id bigint, address string, block_index bigint"),
        "index_tickers": spark.createDataFrame([(1, "TOKEN", None)], "id bigint, tick string, block_index bigint"),
    }


def as_sets(tables):
    return {t: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for t, df in tables.items()}


def payload(tables, heights=None):
    """Change rows with the block they belong to."""
    parts = None
    for t, df in tables.items():
        block = F.col("block_index") if "block_index" in df.columns else F.expr("action_index div 100")
        rows = df.withColumn("__b", block)
        for b in heights if heights is not None else [None]:
            cut = rows if b is None else rows.where(F.col("__b") == b)
            part = encode_binary_json(cut.drop("__b")).select(
                F.lit(b).cast("bigint").alias("block_index"), F.lit(t).alias("table"), F.lit("data").alias("channel"), "row_json")
            parts = part if parts is None else parts.unionByName(part)
    return parts
