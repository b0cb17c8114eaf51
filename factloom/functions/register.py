"""The parsing functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import presentation, similarity

_BODIES = {
    "fiscal_year_of(y INT, m INT) RETURNS INT": "CASE WHEN m >= 4 THEN y + 1 ELSE y END",
    "fiscal_quarter_of(m INT) RETURNS INT": "CAST(FLOOR(PMOD(m - 4, 12) / 3) AS INT) + 1",
    "relationship_id_of(a STRING, b STRING) RETURNS STRING": "CONCAT('r_', SUBSTRING(SHA2(CONCAT(LEAST(a, b), CHR(31), GREATEST(a, b)), 256), 1, 12))",
    "canonical_token(t STRING) RETURNS STRING": (
        "NULLIF(ARRAY_JOIN(CASE WHEN SIZE(FILTER(SPLIT(LOWER(t), '[^a-z0-9%]+'), w -> w <> '' AND NOT ARRAY_CONTAINS(SPLIT('the,a,an,of,for,in,on,at,to,as,per,and', ','), w))) > 0 "
        "THEN FILTER(SPLIT(LOWER(t), '[^a-z0-9%]+'), w -> w <> '' AND NOT ARRAY_CONTAINS(SPLIT('the,a,an,of,for,in,on,at,to,as,per,and', ','), w)) "
        "ELSE FILTER(SPLIT(LOWER(t), '[^a-z0-9%]+'), w -> w <> '') END, '_'), '')"
    ),
    "cosine_of(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "COALESCE(GREATEST(0D, LEAST(1D, TRY_DIVIDE(AGGREGATE(ZIP_WITH(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v), "
        "SQRT(AGGREGATE(a, 0D, (s, v) -> s + v * v)) * SQRT(AGGREGATE(b, 0D, (s, v) -> s + v * v))))), 0D)"
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``; returns their names."""
    names = []
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    for name, function in {"hash_embed": similarity.hash_embed, "text_similarity": similarity.text_similarity, "format_value": presentation.format_value}.items():
        spark.udf.register(name, function)
        names.append(name)
    return names


