"""SQL functions that Spark has under another name or not at all, as temporary SQL functions.

Each is one built-in expression that the optimizer inlines; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, return type, expression)
FUNCTIONS = {
    "strpos": ("s STRING, part STRING", "INT", "locate(part, s)"),
    "starts_with": ("s STRING, part STRING", "BOOLEAN", "startswith(s, part)"),
    "ends_with": ("s STRING, part STRING", "BOOLEAN", "endswith(s, part)"),
    "date_bin": ("stride INTERVAL DAY TO SECOND, ts TIMESTAMP, origin TIMESTAMP", "TIMESTAMP", "timestamp_micros(unix_micros(origin) + CAST(floor((unix_micros(ts) - unix_micros(origin)) / CAST(extract(SECOND FROM stride) * 1000000 + extract(MINUTE FROM stride) * 60000000L + extract(HOUR FROM stride) * 3600000000L + extract(DAY FROM stride) * 86400000000L AS DOUBLE)) AS BIGINT) * CAST(extract(SECOND FROM stride) * 1000000 + extract(MINUTE FROM stride) * 60000000L + extract(HOUR FROM stride) * 3600000000L + extract(DAY FROM stride) * 86400000000L AS BIGINT))"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
    "gcd": ("a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(1, 93), named_struct('a', abs(a), 'b', abs(b)), (x, k) -> if(x.b = 0, x, named_struct('a', x.b, 'b', x.a % x.b)), x -> x.a)"),
    "lcm": ("a BIGINT, b BIGINT", "BIGINT", "if(a = 0 OR b = 0, 0L, abs(a div aggregate(sequence(1, 93), named_struct('a', abs(a), 'b', abs(b)), (x, k) -> if(x.b = 0, x, named_struct('a', x.b, 'b', x.a % x.b)), x -> x.a) * b))"),
    "array_length": ("a ARRAY<STRING>", "INT", "cardinality(a)"),
    "string_to_array": ("s STRING, part STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', part, '\\\\E'))"),
    "array_to_string": ("a ARRAY<STRING>, part STRING", "STRING", "array_join(a, part)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; returns their names."""
    for name, (parameters, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
    return sorted(FUNCTIONS)
