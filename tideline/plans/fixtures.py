"""Small coordination tables as literals, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-05-01 12:00:00"
TABLES: dict[str, tuple[str, list[tuple]]] = {
    # c is closed and complete; d and e are its halves; f merges a and b; g names a parent that was never listed
    "shards": ("shard_id string, parent_shard_id string, adjacent_parent_shard_id string", [("a", None, None), ("b", "", None), ("c", None, None), ("d", "c", None), ("e", "c", ""), ("f", "a", "b"), ("g", "zz", None), ("h", "d", "c"), (None, "a", None), ("", None, None)]),
    "checkpoints": ("shard_id string, checkpoint string", [("a", "99"), ("c", "SHARD_END:1000"), ("e", "SHARD_END"), ("g", "")]),
    "listings": ("shard_id string, parent_shard_id string, adjacent_parent_shard_id string, listing_no int", [("a", None, None, 1), ("b", "a", None, 1), ("c", "x", None, 1), ("x", None, None, 2), ("c", None, None, 2), ("d", "y", "b", 2), ("b", "a", None, 3), ("d", "y", None, 3)]),
    "running": ("shard_id string", [("q",), ("b",)]),
    "known": ("shard_id string, parent_shard_id string, adjacent_parent_shard_id string", [("a", None, None), ("b", None, None), ("q", "p", None), ("old", None, None), ("n", "old", None)]),
    "errors": ("code string, fault string", [("ProvisionedThroughputExceededException", "client"), ("LimitExceededException", "client"), ("KMSThrottlingException", "client"), ("ThrottlingException", "client"), ("InternalFailure", "server"), ("ExpiredIteratorException", "client"), ("ValidationException", "client"), ("AccessDeniedException", "client"), ("SomethingElse", "server"), ("SomethingElse", "client"), (None, "network"), ("RequestTimeout", "client"), ("ExpiredNextTokenException", "client"), ("ResourceNotFoundException", "client")]),
    "arns": ("arn string", [("arn:aws:kinesis:eu-west-1:123456789012:stream/orders",), ("arn:aws:s3:eu-west-1:123456789012:stream/orders",), ("arn:aws:kinesis::123456789012:stream/orders",), ("arn:aws:kinesis:eu-west-1:12345:stream/orders",), ("arn:aws:kinesis:eu-west-1:123456789012:table/orders",), ("arn:aws:kinesis:eu-west-1:123456789012:stream/a b",), ("arn:aws:kinesis:eu-west-1:123456789012:stream/",), ("orders",), ("arn:aws-cn:kinesis:cn-north-1:000000000000:stream/x_1.y-2",), (None,)]),
    "page_iterators": ("page_no int, next_iterator string", [(1, "abc"), (2, ""), (3, None)]),
    "matrix": ("stored string, saved string", [(None, "5"), ("", "5"), ("5", "5"), ("99", "100"), ("100", "99"), ("5", "SHARD_END"), ("SHARD_END:5", "6"), ("SHARD_END", "SHARD_END:9"), ("49590338271490256608559692538361571095921575989136588898", "49590338271490256608559692538361571095921575989136588899"), ("5", ""), ("5", None)]),
    "saves": ("identity string, shard_id string, arrival_index int, value string", [("g:s", "a", 0, "9"), ("g:s", "a", 1, "10"), ("g:s", "a", 2, "8"), ("g:s", "b", 0, "7"), ("g:s", "b", 1, "SHARD_END:7"), ("g:s", "b", 2, "SHARD_END:8"), ("g:s", "b", 3, "11"), ("h:s", "a", 0, "3"), ("h:s", "a", 1, ""), ("h:s", "c", 0, "SHARD_END")]),
    "deleted_saves": ("identity string, shard_id string, arrival_index int, value string", [("g:s", "a", 0, "90"), ("g:s", "a", 1, None), ("g:s", "a", 2, "8"), ("g:s", "a", 3, "7"), ("g:s", "b", 0, "SHARD_END"), ("g:s", "b", 1, None), ("g:s", "c", 0, "5"), ("g:s", "c", 1, "6")]),
    "stored": ("checkpoint string", [("0",), ("10",), ("010",), ("SHARD_END",), ("SHARD_END:4",), ("-1",), ("x",), ("",), (None,), ("123456789012345678901234567890123456789012345678901234567890",)]),
    "leases": ("shard_id string, owner string, expires_at string", [("a", "w1", "2024-05-01 12:00:05"), ("b", "w1", "2024-05-01 12:00:05"), ("c", "w2", "2024-05-01 12:00:00"), ("d", "w1", "2024-05-01 12:00:09"), ("g", "gone", "2024-05-01 12:01:00"), ("x", "w2", "2024-05-01 12:01:00"), ("e", "", "2024-05-01 12:01:00")]),
    "workers": ("owner string, expires_at string", [("w2", "2024-05-01 12:00:20"), ("w1", "2024-05-01 12:00:01"), ("w3", "2024-05-01 11:59:59"), ("w4", "2024-05-01 12:00:00")]),
    "ready": ("shard_id string", [("a",), ("b",), ("c",), ("d",), ("g",), ("i",), ("j",)]),
    "cooldown": ("shard_id string, until string", [("i", "2024-05-01 12:00:05"), ("a", "2024-05-01 12:00:00"), ("b", "2024-05-01 12:00:07")]),
    "local_workers": ("shard_id string, stopping boolean", [("a", False), ("d", True), ("b", False)]),
    "lease_ops": ("op_index int, identity string, now string, op string, shard_id string, owner string, expected_owner string, ttl_ms long", [
        (0, "g:s", "2024-05-01 12:00:00", "acquire", "a", "w1", None, 10000), (1, "g:s", "2024-05-01 12:00:01", "acquire", "a", "w2", None, 10000), (2, "g:s", "2024-05-01 12:00:02", "claim", "a", "w2", "w9", 10000),
        (3, "g:s", "2024-05-01 12:00:03", "claim", "a", "w2", "w1", 10000), (4, "g:s", "2024-05-01 12:00:04", "renew", "a", "w1", None, 10000), (5, "g:s", "2024-05-01 12:00:05", "renew", "a", "w2", None, 5000),
        (6, "g:s", "2024-05-01 12:00:10", "renew", "a", "w2", None, 5000), (7, "g:s", "2024-05-01 12:00:10", "acquire", "a", "w3", None, 60000), (8, "g:s", "2024-05-01 12:00:11", "acquire", "b", "w1", None, 60000),
        (9, "g:s", "2024-05-01 12:00:12", "release", "b", "w2", None, 0), (10, "g:s", "2024-05-01 12:00:13", "release", "b", "w1", None, 0), (11, "g:s", "2024-05-01 12:00:13", "acquire", "b", "w1", None, 1000),
        (12, "g:s", "2024-05-01 12:00:13", "acquire", "b", "w1", None, 1000), (13, "g:s", "2024-05-01 12:00:14", "heartbeat", None, "w1", None, 20000), (14, "g:s", "2024-05-01 12:00:15", "heartbeat", None, "w2", None, 20000),
        (15, "g:s", "2024-05-01 12:00:16", "deregister", None, "w1", None, None), (16, "g:s", "2024-05-01 12:00:18", "heartbeat", None, "w2", None, 20000), (17, "g:s", "2024-05-01 12:00:18", "deregister", None, "w8", None, None)]),
    "beats": ("last_success string, now string", [("2024-05-01 12:00:00", "2024-05-01 12:00:14"), ("2024-05-01 12:00:00", "2024-05-01 12:00:15"), ("2024-05-01 12:00:00", "2024-05-01 12:11:00")]),
    "prefixes": ("prefix string, identity string, shard_id string", [("kinesis-checkpoint", "g:s", "shardId-000000000000"), ("", "g:\u00e9t\u00e9", "x"), ("p{1}%7B", "", "s/?>"), ("tenant", "g:" + "long-name-" * 12, "shardId-000000000001")]),
    "emitted": ("name string, type string, value double, tags string", [("kinesis_consumer.records_processed", "c", 12.0, "stream=orders,shard=a"), ("kinesis_consumer.owned_shards", "g", 3.5, "stream=orders"), ("kinesis_consumer.drain_duration", "ms", 1500.0, ""), ("kinesis_consumer.drain_duration", "ms", 0.25, "stream=a|b#c,shard=s:1"), ("kinesis_consumer.records_processed", "c", 123456789.0, "stream=x")]),
}
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def timed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else repr(v)


def cte(*names: str) -> str:
    """The tables as common table expressions fx_<name>."""
    out = []
    for name in names:
        schema, rows = TABLES[name]
        fields = [f.strip().split() for f in schema.split(",")]
        casts = ", ".join(f"CAST({n} AS {SQL_TYPES[t]}) AS {n}" for n, t in fields)
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        out.append(f"fx_{name} AS (SELECT {casts} FROM (VALUES {values}) AS v({', '.join(n for n, _ in fields)}))")
    return ", ".join(out)
