"""Normalisation of intensities and motion features of displacement fields.

Fields are rows (movie, t0, t1, scale, z, y, x, u, v); u points along x and v along y.
Metrics are rows (movie, t, z, y, x, name, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtrail.functions.windows import gradient, percentiles

FLOW_KEY = ["movie", "t0", "scale"]
EPS = 1e-5


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def normalise_metric(df: DataFrame, keys: list[str], value: str = "value", low: float = 0.02, high: float = 99.98) -> DataFrame:
    """Scales `value` between two percentiles of its key and clips to [0, 1]; by least and greatest if these are one."""
    p = percentiles(df, value, keys, low, high)
    out = df.join(p, keys)
    flat = F.col("__p")[1] - F.col("__p")[0] < 1e-8
    a, b = F.when(flat, F.col("__min")).otherwise(F.col("__p")[0]), F.when(flat, F.col("__max")).otherwise(F.col("__p")[1])
    return out.withColumn(value, clip((F.col(value) - a) / (b - a + 1e-8))).drop("__p", "__min", "__max")


def normalise_minmax(df: DataFrame, keys: list[str], value: str, eps: float = EPS) -> DataFrame:
    """Scales between least and greatest of a key."""
    return _with_ends(df, keys, value).withColumn(value, (F.col(value) - F.col("__min")) / (F.col("__max") - F.col("__min") + eps)).drop("__min", "__max")


def _with_ends(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least and greatest value of each row's key: partial aggregates and a join, so a key of any size spreads over tasks."""
    return df.join(df.groupBy(*keys).agg(F.min(value).alias("__min"), F.max(value).alias("__max")), keys)


def normalise_range(df: DataFrame, keys: list[str], value: str, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Scales so that two percentiles of a key become 0 and 1, without clipping; a flat key becomes 0."""
    p = percentiles(df, value, keys, low, high)
    a, b = F.col("__p")[0], F.col("__p")[1]
    return df.join(p, keys).withColumn(value, F.when(b - a > 1e-3, (F.col(value) - a) / (b - a)).otherwise(0.0)).drop("__p", "__min", "__max")


def normalise_training(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Scales between least and greatest of a key; a constant key becomes 0."""
    low, high = F.col("__min"), F.col("__max")
    return _with_ends(df, keys, value).withColumn(value, F.when(high - low > 1e-8, (F.col(value) - low) / (high - low)).otherwise(0.0)).drop("__min", "__max")


def to_bytes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Scales each key to 0 to 255, cut to whole numbers; a constant key becomes 0."""
    low, high = F.col("__min"), F.col("__max")
    return _with_ends(df, keys, value).withColumn(value, F.when(high > low, (F.col(value) - low) / (high - low) * 255).otherwise(0.0).cast("int")).drop("__min", "__max")


def project_channels(pixels: DataFrame, low: float = 0.01, high: float = 99.99) -> DataFrame:
    """Greatest channel of each pixel, after scaling every channel by its percentiles over the whole movie to 0 to 255."""
    p = percentiles(pixels, "v", ["movie", "c"], low, high)
    a, b = F.col("__p")[0], F.col("__p")[1]
    scaled = pixels.join(p, ["movie", "c"]).withColumn("v", (clip((F.col("v") - a) / (b - a + 1e-8)) * 255).cast("int"))
    return scaled.groupBy("movie", "t", "z", "y", "x").agg(F.max("v").alias("v"))


def magnitudes(flow: DataFrame) -> DataFrame:
    return flow.withColumn("mag", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))


def deformation(flow: DataFrame) -> DataFrame:
    """Divergence, vorticity and strain by central differences, one-sided at the edges."""
    row, column = [*FLOW_KEY, "z", "y"], [*FLOW_KEY, "z", "x"]
    g = flow
    for value in "uv":
        g = gradient(gradient(g, value, "x", row, f"{value}x"), value, "y", column, f"{value}y")
    shear, stretch = F.col("uy") + F.col("vx"), F.col("ux") - F.col("vy")
    return g.select(*flow.columns, (F.col("ux") + F.col("vy")).alias("divergence"), (F.col("vx") - F.col("uy")).alias("vorticity"), F.sqrt(F.lit(0.5) * (stretch * stretch + shear * shear)).alias("strain"))


def scale_pairs(frames: DataFrame, scales: list[int]) -> DataFrame:
    """(movie, t0, t1, scale) for every two frames that are `scale` apart."""
    listed = frames.select("movie", F.col("t").alias("t0"), F.explode(F.array(*map(F.lit, scales))).alias("scale"))
    listed = listed.withColumn("t1", F.col("t0") + F.col("scale"))
    return listed.join(frames.select("movie", F.col("t").alias("t1")), ["movie", "t1"], "left_semi").select("movie", "t0", "t1", "scale")


def cumulative(flow: DataFrame, window: int = 5) -> DataFrame:
    """Sum of consecutive displacements from window // 2 frames before each centre to as many after, cut at the ends."""
    half = window // 2
    w = Window.partitionBy("movie", "z", "y", "x").orderBy("t0")
    around, before = w.rowsBetween(-half, half - 1), w.rowsBetween(1 - half, 0)
    last = F.max("t0").over(Window.partitionBy("movie", "z", "y", "x"))
    sums = lambda frame, u, v: F.struct(F.sum("u").over(frame).alias(u), F.sum("v").over(frame).alias(v))
    steps = flow.filter("scale = 1").select("movie", "t0", "z", "y", "x", sums(around, "u", "v").alias("here"), sums(before, "u", "v").alias("end"), last.alias("last"))
    # The last frame has no displacement of its own, so the row before it stands for two centres.
    centres = F.array_compact(F.array(F.struct(F.col("t0").alias("center_t"), F.col("here").alias("s")), F.when(F.col("t0") == F.col("last"), F.struct((F.col("t0") + 1).alias("center_t"), F.col("end").alias("s")))))
    return steps.select("movie", "z", "y", "x", F.explode(centres).alias("c")).select("movie", "c.center_t", "z", "y", "x", "c.s.u", "c.s.v")


def direction_stability(flow: DataFrame, first: int, last: int) -> DataFrame:
    """Cosine of the displacements at two scales, clipped to [0, 1]."""
    key = ["movie", "t0", "z", "y", "x"]
    a = flow.filter(F.col("scale") == first).select(*key, F.col("u").alias("u0"), F.col("v").alias("v0"))
    b = flow.filter(F.col("scale") == last).select(*key, F.col("u").alias("un"), F.col("v").alias("vn"))
    dot = F.col("u0") * F.col("un") + F.col("v0") * F.col("vn")
    size = F.sqrt(F.col("u0") * F.col("u0") + F.col("v0") * F.col("v0")) * F.sqrt(F.col("un") * F.col("un") + F.col("vn") * F.col("vn"))
    return a.join(b, key).select(*key, clip(dot / (size + EPS)).alias("direction_stability"))


def acceleration(flow: DataFrame, first: int, last: int) -> DataFrame:
    """Difference of the normalised magnitudes at two scales, normalised again."""
    key = ["movie", "t0", "z", "y", "x"]
    m = normalise_metric(magnitudes(flow.filter(F.col("scale").isin(first, last))), FLOW_KEY, "mag")
    a, b = (m.filter(F.col("scale") == s).select(*key, F.col("mag").alias(f"m{i}")) for i, s in enumerate((first, last)))
    return normalise_metric(a.join(b, key).select(*key, F.abs(F.col("m1") - F.col("m0")).alias("acceleration")), ["movie", "t0"], "acceleration")


def alignment(flow: DataFrame, frames: DataFrame) -> DataFrame:
    """Alignment with the image gradient, and the displacement along and across it.

    As in the system this engine serves, the gradient's first component is that along y, while u
    points along x.
    """
    g = gradient(gradient(frames, "v", "y", ["movie", "t", "z", "x"], "gx"), "v", "x", ["movie", "t", "z", "y"], "gy")
    g = g.select("movie", F.col("t").alias("t0"), "z", "y", "x", "gx", "gy")
    j = flow.join(g, ["movie", "t0", "z", "y", "x"])
    gx, gy, u, v = (F.col(c) for c in ("gx", "gy", "u", "v"))
    size, speed = F.sqrt(gx * gx + gy * gy + EPS), F.sqrt(u * u + v * v + EPS)
    return j.select("movie", "t0", "scale", "z", "y", "x", F.abs((gx * u + gy * v) / (size * speed)).alias("flow_structure_alignment"), F.abs(u * gx / size + v * gy / size).alias("normal_flow"), F.abs(-u * gy / size + v * gx / size).alias("tangential_flow"))


def boundary_likelihood(mag: Column, cumulative_mag: Column, edge: Column, tangential: Column) -> Column:
    """Weighted sum of four normalised metrics, to be normalised again."""
    return 0.30 * mag + 0.25 * cumulative_mag + 0.25 * edge + 0.20 * tangential


def flow_index(frame: Column, n_flows: Column) -> Column:
    """Which of a scale's fields a frame uses: that of the frame before, within what there is."""
    return F.least(n_flows - 1, F.greatest(F.lit(0), frame - 1))


def fill_frames(flow: DataFrame, frames: DataFrame) -> DataFrame:
    """Every frame's field at scale 1, zero where there is none: flow rows for all pixels of all frames."""
    grid = flow.select("movie", "z", "y", "x").distinct()
    every = frames.select("movie", F.col("t").alias("t0")).join(grid, "movie")
    key = ["movie", "t0", "z", "y", "x"]
    have = flow.filter("scale = 1").select(*key, "u", "v")
    return every.join(have, key, "left").select(*key, F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("v", F.lit(0.0)).alias("v"))


def flow_pairs(frames: DataFrame, flow: DataFrame, scale: int = 1) -> DataFrame:
    """For each frame whether a field to the next one exists; the last frame has none."""
    have = flow.filter(F.col("scale") == scale).select("movie", F.col("t0").alias("t")).distinct().withColumn("has_flow", F.lit(True))
    return frames.select("movie", "t").join(have, ["movie", "t"], "left").withColumn("has_flow", F.coalesce("has_flow", F.lit(False)))


def pivot_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One column for each metric, in the given order, which is the model's channel order."""
    return metrics.groupBy("movie", "t", "z", "y", "x").pivot("name", names).agg(F.first("value"))


def softmax_channels(pixels: DataFrame, temperature: float = 0.3, sigma: float = 5.0) -> DataFrame:
    """Softmax over the smoothed channels of a pixel, times its brightest channel unsmoothed, scaled in each frame and channel.

    A channel is scaled by its least and greatest value in the whole movie, then smoothed in each plane by a
    Gaussian of `sigma` pixels, cut at four of them, with the plane mirrored at its borders, edge pixel included.
    """
    w = Window.partitionBy("movie", "t", "z", "y", "x")
    scaled = normalise_minmax(pixels, ["movie", "c"], "v", 1e-8).withColumn("bright", F.max("v").over(w)).withColumn("s", F.col("v"))
    size = 2 * int(4 * sigma + 0.5) + 1
    for along in ("x", "y"):
        scaled = blur(scaled, along, ["s"], sigma, size, plane=["movie", "t", "z", "c"], edge=True, also=["bright"])
    e = scaled.withColumn("e", F.exp((F.col("s") - F.max("s").over(w)) / (temperature + 1e-8)))
    e = e.withColumn("value", F.col("e") / (F.sum("e").over(w) + 1e-8) * F.col("bright"))
    return normalise_metric(e.select("movie", "t", "z", "y", "x", "c", "value"), ["movie", "t", "c"])


def intensity_target(pixels: DataFrame) -> DataFrame:
    """Training target of a frame: bright pixels, local contrast in 5 x 5 windows with zeros outside, and edges.

    Neighbourhood sums are two window passes of five, so each pixel costs ten additions.
    """
    plane = ["movie", "t", "z"]
    line = lambda part, order: Window.partitionBy(*plane, part).orderBy(order)
    p = pixels.withColumn("sx", F.sum("v").over(line("y", "x").rangeBetween(-2, 2))).withColumn("qx", F.sum(F.col("v") * F.col("v")).over(line("y", "x").rangeBetween(-2, 2)))
    p = p.withColumn("s", F.sum("sx").over(line("x", "y").rangeBetween(-2, 2))).withColumn("q", F.sum("qx").over(line("x", "y").rangeBetween(-2, 2)))
    p = p.withColumn("contrast", F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / 25) / 24, F.lit(0.0))) + EPS)
    dx = F.abs(F.lead("v").over(line("y", "x")) - F.col("v"))
    dy = F.abs(F.lead("v").over(line("x", "y")) - F.col("v"))
    p = p.withColumn("edge", (F.coalesce(dx, F.lit(0.0)) + F.coalesce(dy, F.lit(0.0))) / 2)
    stats = p.groupBy(*plane).agg(*[f(c).alias(f"{n}_{c}") for c in ("v", "contrast", "edge") for n, f in (("avg", F.avg), ("sd", F.stddev_samp))])
    p = p.join(stats, plane)
    level = lambda c: clip((F.col(c) - F.col(f"avg_{c}")) / (F.col(f"sd_{c}") + EPS))
    bright = (F.col("v") > F.col("avg_v") + F.col("sd_v") + EPS).cast("double")
    return p.select(*plane, "y", "x", F.sqrt(0.5 * bright + 0.3 * level("contrast") + 0.2 * level("edge")).alias("target"))


def structure_tensor(frames: DataFrame, sigma: float = 2.0, size: int = 7) -> DataFrame:
    """Gap of the eigenvalues of the image structure tensor, its products blurred by two passes of `size` weights.

    The blur's windows reflect at the borders without repeating the edge pixel.
    """
    g = gradient(gradient(frames, "v", "y", ["movie", "t", "z", "x"], "gx"), "v", "x", ["movie", "t", "z", "y"], "gy")
    p = g.select("movie", "t", "z", "y", "x", (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gy") * F.col("gy")).alias("yy"), (F.col("gx") * F.col("gy")).alias("xy"))
    for along in ("x", "y"):
        p = blur(p, along, ["xx", "yy", "xy"], sigma, size)
    # The squared trace less four determinants, in a form that cannot cancel.
    apart = F.col("xx") - F.col("yy")
    return p.select("movie", "t", "z", "y", "x", F.sqrt(apart * apart + 4 * F.col("xy") * F.col("xy")).alias("edge_strength"))


def blur(p: DataFrame, along: str, values: list[str], sigma: float, size: int, plane: list[str] = ["movie", "t", "z"], edge: bool = False, also: list[str] = []) -> DataFrame:
    """One pass of a Gaussian blur along an axis of a dense grid, reflected at its borders, with the edge pixel or without.

    A line of a plane becomes an array, whose places are weighted sums of places of it; a place
    beyond a border is read from the mirrored one inside, however far out it is.  Columns `also` are kept as they are.
    """
    half, other = size // 2, "x" if along == "y" else "y"
    weights = [2.718281828459045 ** (-((i - half) ** 2) / (2 * sigma**2)) for i in range(size)]
    total = sum(weights)
    key = [*plane, other]
    lines = p.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(along, *values, *also))).alias("line"))
    n = F.size("line")
    turn = 2 * n if edge else F.greatest(2 * n - 2, F.lit(1))

    def mirrored(k: Column) -> Column:
        j = F.pmod(k - half, turn)
        return F.get("line", F.least(j, turn - 1 - j if edge else turn - j))

    def mixed(i: Column) -> Column:
        sums = [sum((w / total * F.get("wide", i + o)[v] for o, w in enumerate(weights)), F.lit(0.0)).alias(v) for v in values]
        return F.struct(F.get("line", i)[along].alias(along), *sums, *[F.get("line", i)[a].alias(a) for a in also])

    # The line with its mirrored ends is made once, so that a weight costs one place of it and no search for that.
    lines = lines.withColumn("wide", F.transform(F.sequence(F.lit(0), n - 1 + 2 * half), mirrored))
    return lines.select(*key, F.explode(F.transform(F.sequence(F.lit(0), n - 1), mixed)).alias("m")).select(*plane, *[F.col(f"m.{c}" if c == along else c).alias(c) for c in ("y", "x")], *[F.col(f"m.{v}").alias(v) for v in [*values, *also]])
