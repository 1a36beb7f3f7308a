"""The library's small functions under names that SQL knows, as SQL functions: the optimiser sees through them.

    voxtrail.sql.register(spark)
    spark.sql("select a.id, vec_cosine(a.v, b.v) from ...")

Scalar functions take arrays; those over tracks take what collect_list gives, in any order.  Table functions are used with LATERAL.

Defined cases: a null argument gives null, or no rows of a table function; vectors of length 0 have cosine 0; points of
negative colour are of unknown colour and are passed over; points of one frame stand in the order of their colours.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_POINTS = "points ARRAY<STRUCT<t: INT, color: INT>>"
#: Points of known colour in order of time, as colours.
_COLOURS = "transform(array_sort(filter(points, p -> p.color >= 0)), p -> p.color)"
FUNCTIONS = (
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(vec_dot(a, a))",
    "vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN vec_dot(a, b) / ((vec_norm(a) + 1e-8D) * (vec_norm(b) + 1e-8D))",
    "scale_between(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN greatest(least((x - low) / (high - low + 1e-8D), 1D), 0D)",
    f"""color_switches({_POINTS}) RETURNS BIGINT RETURN aggregate({_COLOURS}, named_struct('n', 0L, 'last', -1),
        (s, c) -> named_struct('n', s.n + CAST(s.last >= 0 AND s.last <> c AS BIGINT), 'last', c), s -> s.n)""",
    f"color_known({_POINTS}) RETURNS BIGINT RETURN CAST(size({_COLOURS}) AS BIGINT)",
    f"""dominant_color({_POINTS}) RETURNS INT RETURN aggregate(array_sort(array_distinct({_COLOURS})), named_struct('c', -1, 'n', 0),
        (s, c) -> IF(size(filter({_COLOURS}, x -> x = c)) > s.n, named_struct('c', c, 'n', size(filter({_COLOURS}, x -> x = c))), s), s -> s.c)""",
    # A row's own values may stand in one generator only, so each of these makes its rows as one array.
    """tile_starts(length INT, size INT, overlap DOUBLE) RETURNS TABLE (tile INT, start INT) RETURN
        SELECT s.tile, s.start FROM (SELECT explode(transform(sequence(0, IF(length <= size, 1, CAST(ceil((1 + 2 * overlap) * length / size) AS INT)) - 1), i -> named_struct(
            'tile', i, 'start', IF(length <= size, 0, CAST(floor(i * (length - size) / (CAST(ceil((1 + 2 * overlap) * length / size) AS INT) - 1)) AS INT))))) AS s)""",
    """crop_offsets(half INT) RETURNS TABLE (dy INT, dx INT) RETURN
        SELECT s.dy, s.dx FROM (SELECT explode(flatten(transform(IF(half > 0, sequence(-half, half - 1), array()), y -> transform(sequence(-half, half - 1), x -> named_struct('dy', y, 'dx', x))))) AS s)""",
    """frames_around(t INT, before INT, after INT) RETURNS TABLE (frame INT) RETURN SELECT explode(sequence(t - before, t + after)) AS frame""",
)


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS known to the session, over what it knew by these names; gives the names."""
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    return [text.split("(")[0] for text in FUNCTIONS]
