"""The text functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodestar.operators.chunking import split


@udtf(returnType="chunk_index int, chunk string")
class Chunks:
    def eval(self, text: str, strategy: str, size: int, overlap: int):
        yield from enumerate(split(text, strategy, size, overlap))


def register(spark: SparkSession) -> None:
    """chunks(text, strategy, size, overlap) as a table function; tokenize, content_sha and others as SQL functions without Python."""
    spark.udtf.register("chunks", Chunks)
    for name, body in {
        "normalize_text": r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t, '\r\n', '\n'), '[ \\t]+(?=\\n|$)', ''), '^\\s+', ''), '\\s+$', ''), '\\n{3,}', '\n\n')",
        "expand_tag": "transform(sequence(1, size(split(t, '/'))), i -> array_join(slice(split(t, '/'), 1, i), '/'))",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURN {body}")
