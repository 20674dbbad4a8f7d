"""Small grey images as rows (key, x, y, v) with v in 0..255: relational pixel operations.

Images are full rectangles. Means of boxes come from running sums along rows and columns, so a kernel of any size costs four
look-ups; kernels that are no boxes explode each pixel into the cells it reaches. Connected areas grow by whole runs of
pixels until nothing changes. Borders use the pixels that exist."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut


def pixels(df: DataFrame, key: str, values: str, width: int = 8) -> DataFrame:
    """Arrays of values in rows of `width`, scaled to 0..255 by each array's own range."""
    low, high = F.array_min(values), F.array_max(values)
    each = df.select(key, low.alias("low"), high.alias("high"), F.posexplode(values).alias("p", "raw"))
    v = F.when(F.col("high") > F.col("low"), F.floor((F.col("raw") - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double") * 255)).otherwise(0)
    return each.select(key, (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), v.cast("int").alias("v"))


def histogram(image: DataFrame, bins: int = 256) -> DataFrame:
    """(bin, n) over all bins, empty ones too."""
    counted = image.groupBy(F.floor(F.col("v") * bins / 256).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = image.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def threshold(v: Column, kind: str = "binary", at: int = 127, most: int = 255) -> Column:
    over = v > at
    return {
        "binary": F.when(over, most).otherwise(0),
        "inverse": F.when(over, 0).otherwise(most),
        "trunc": F.when(over, at).otherwise(v),
        "tozero": F.when(over, v).otherwise(0),
        "tozero_inverse": F.when(over, 0).otherwise(v),
    }[kind]


def otsu(image: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the value that maximises the variance between the pixels up to it and those over it; the least
    such. Sums run over at most 256 rows per image."""
    h = image.groupBy(key, "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy(key).orderBy("v")
    whole = Window.partitionBy(key)
    rows = h.select(
        key,
        "v",
        F.sum("n").over(up).alias("n0"),
        F.sum(F.col("n") * F.col("v")).over(up).alias("s0"),
        F.sum("n").over(whole).alias("n"),
        F.sum(F.col("n") * F.col("v")).over(whole).alias("s"),
    )
    n1 = F.col("n") - F.col("n0")
    # n0 n1 (mean difference)^2, in whole numbers over n0 n1: compares exactly enough as doubles
    between = F.when(n1 > 0, F.pow((F.col("s0") * n1 - (F.col("s") - F.col("s0")) * F.col("n0")).cast("double"), 2) / (F.col("n0") * n1)).otherwise(0.0)
    return rows.groupBy(key).agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("threshold"))


def neighbourhood(image: DataFrame, key: str, size: int = 3, shape: str = "rect") -> DataFrame:
    """Each pixel's values within an odd kernel: (key, x, y, near), for pixels of the image only."""
    if size % 2 == 0:
        raise ValueError("a kernel's size must be odd")
    r = size // 2
    cells = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if shape == "rect" or shape == "cross" and 0 in (i, j) or shape == "ellipse" and i * i + j * j <= r * r + r]
    spread = image.select(key, F.col("v"), "x", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in cells])).alias("d"))
    moved = spread.select(key, (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), "v", ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"))
    return moved.groupBy(key, "x", "y").agg(F.array_sort(F.collect_list("v")).alias("near"), F.max("own").alias("inside"), F.max(F.when(F.col("own"), F.col("v"))).alias("v")).where("inside").drop("inside")


def _odd(size: int) -> int:
    if size % 2 == 0:
        raise ValueError("a kernel's size must be odd")
    return size // 2


def box_sums(image: DataFrame, key: str, size: int) -> DataFrame:
    """(key, x, y, v, total, n): the sum of the pixels within a box around each one, and how many there are; a summed-area table
    made and read along x, then along y: of each running sum the one at the box's end less the one before its start."""
    r = _odd(size)
    out = image.select(key, "x", "y", "v", F.col("v").cast("long").alias("total"), F.lit(1).cast("long").alias("n"))
    for along, other in (("x", "y"), ("y", "x")):
        line = Window.partitionBy(key, other).orderBy(along)
        whole = Window.partitionBy(key, other)
        within = lambda c: F.coalesce(F.lead(f"tsl_{c}", r).over(line), F.sum(c).over(whole)) - F.coalesce(F.lag(f"tsl_{c}", r + 1).over(line), F.lit(0))  # noqa: B023, E731
        out = out.withColumns({f"tsl_{c}": F.sum(c).over(line) for c in ("total", "n")})
        out = out.select(key, "x", "y", "v", within("total").alias("total"), within("n").alias("n"))
    return out


def average_blur(image: DataFrame, key: str, size: int = 3) -> DataFrame:
    return box_sums(image, key, size).select(key, "x", "y", F.floor(F.col("total") / F.col("n")).cast("int").alias("v"))


def median_blur(image: DataFrame, key: str, size: int = 3) -> DataFrame:
    near = neighbourhood(image, key, size)
    return near.select(key, "x", "y", F.element_at("near", F.floor((F.size("near") + 1) / 2).cast("int")).alias("v"))


def gaussian_mean(image: DataFrame, key: str, size: int = 5, sigma: float = 0.0) -> DataFrame:
    """(key, x, y, v, mean): the mean weighted by distance, along rows and then along columns, as the weights are products; with the
    usual sigma for a kernel's size, 0.3 ((size - 1) / 2 - 1) + 0.8, if none is given."""
    s, r = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8, _odd(size)
    out = image.select(key, "x", "y", "v", F.col("v").cast("double").alias("mean"))
    for along, other in (("x", "y"), ("y", "x")):
        line = Window.partitionBy(key, other).orderBy(along)
        near = [(F.lag("mean", d).over(line) if d > 0 else F.lead("mean", -d).over(line) if d else F.col("mean"), float(np.exp(-d * d / (2 * s * s)))) for d in range(-r, r + 1)]
        value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in near), F.lit(0.0))
        weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in near), F.lit(0.0))
        out = out.select(key, "x", "y", "v", (value / weight).alias("mean"))
    return out


def gaussian_blur(image: DataFrame, key: str, size: int = 5, sigma: float = 0.0) -> DataFrame:
    return gaussian_mean(image, key, size, sigma).select(key, "x", "y", F.round("mean").cast("int").alias("v"))


def unsharp(image: DataFrame, key: str, amount: float = 2.0, blurred: float = 0.5, plus: float = 0.0, size: int = 3) -> DataFrame:
    """amount times the image and `blurred` times its blurred form, plus a constant, cut to 0..255."""
    mean = F.floor(F.col("total") / F.col("n"))
    value = F.round(amount * F.col("v") + blurred * mean + plus)
    return box_sums(image, key, size).select(key, "x", "y", F.greatest(F.lit(0), F.least(F.lit(255), value)).cast("int").alias("v"))


def bilateral_blur(image: DataFrame, key: str, size: int = 7, colour: float = 75.0, space: float = 75.0) -> DataFrame:
    """Mean weighted by distance and by difference in value."""
    r = size // 2
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r])
    moved = image.select(key, "x", "y", "v", F.explode(cells).alias("d")).select(key, (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), F.col("v").alias("other"), F.pow("d.i", F.lit(2)).alias("ii"), F.pow("d.j", F.lit(2)).alias("jj"))
    both = moved.join(image, [key, "x", "y"])
    w = F.exp(-(F.col("ii") + F.col("jj")) / (2 * space * space) - F.pow(F.col("v") - F.col("other"), F.lit(2)) / (2 * colour * colour))
    return both.groupBy(key, "x", "y").agg(F.round(F.sum(F.col("other") * w) / F.sum(w)).cast("int").alias("v"))


def adaptive_threshold(image: DataFrame, key: str, size: int = 11, minus: float = 2.0, most: int = 255, kind: str = "mean") -> DataFrame:
    """Whether a pixel is over its neighbourhood's mean, or its gaussian mean, less a constant."""
    if kind not in ("mean", "gaussian"):
        raise ValueError(f"no mean {kind}")
    near = box_sums(image, key, size).withColumn("mean", F.col("total") / F.col("n")) if kind == "mean" else gaussian_mean(image, key, size)
    return near.select(key, "x", "y", F.when(F.col("v") > F.col("mean") - minus, most).otherwise(0).alias("v"))


def clahe(image: DataFrame, key: str, clip: float = 4.0, tiles: int = 8) -> DataFrame:
    """Histogram equalisation by tiles with limited contrast: of each tile's histogram what is over the limit is dealt evenly to
    all values, its running sums give the tile's new values, and a pixel's is interpolated between the four tiles around."""
    size = image.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    wide, high = F.ceil(F.col("w") / tiles), F.ceil(F.col("h") / tiles)
    sized = image.join(size.select(key, wide.alias("tw"), high.alias("th"), F.ceil(F.col("w") / wide).alias("nx"), F.ceil(F.col("h") / high).alias("ny")), key)
    placed = sized.select("*", F.floor(F.col("x") / F.col("tw")).alias("tx"), F.floor(F.col("y") / F.col("th")).alias("ty"))
    counts = placed.groupBy(key, "tx", "ty", "v").agg(F.count("*").alias("c"))
    held = counts.groupBy(key, "tx", "ty").agg(F.sum("c").alias("area"), F.map_from_entries(F.collect_list(F.struct("v", "c"))).alias("c"))  # 256 values at most
    limit = F.greatest(F.lit(1), F.floor(clip * F.col("area") / 256)).cast("long")
    clipped = held.select(key, "tx", "ty", "area", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.least(F.coalesce(F.try_element_at("c", v), F.lit(0)), limit)).alias("h"))
    kept = F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x)
    dealt = clipped.withColumn("over", F.col("area") - kept).withColumns({"each": F.floor(F.col("over") / 256), "rest": F.col("over") % 256})
    step = F.greatest(F.floor(256 / F.greatest(F.col("rest"), F.lit(1))), F.lit(1))
    bins = F.transform("h", lambda n, v: n + F.col("each") + F.when((v % step == 0) & (v / step < F.col("rest")), 1).otherwise(0))
    sums = F.aggregate(bins, F.array().cast("array<long>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0).cast("long")), s), -1), F.lit(0)) + x)))
    table = dealt.select(key, F.col("tx").alias("ax"), F.col("ty").alias("ay"), F.transform(sums, lambda s: F.round(s * 255 / F.col("area"))).alias("table"))
    fx, fy = F.col("x") / F.col("tw") - 0.5, F.col("y") / F.col("th") - 0.5
    four = placed.select(key, "x", "y", "v", "nx", "ny", F.floor(fx).alias("x0"), F.floor(fy).alias("y0"), (fx - F.floor(fx)).alias("a"), (fy - F.floor(fy)).alias("b"))
    corner = lambda i, j: F.struct(
        F.greatest(F.lit(0), F.least(F.col("nx") - 1, F.col("x0") + i)).alias("ax"),
        F.greatest(F.lit(0), F.least(F.col("ny") - 1, F.col("y0") + j)).alias("ay"),
        ((F.col("a") if i else 1 - F.col("a")) * (F.col("b") if j else 1 - F.col("b"))).alias("weight"),
    )
    each = four.select(key, "x", "y", "v", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("t")).select(key, "x", "y", "v", "t.*")
    looked = each.join(table, [key, "ax", "ay"])
    return looked.groupBy(key, "x", "y").agg(F.round(F.sum(F.col("weight") * F.get("table", F.col("v")))).cast("int").alias("v"))


def _extreme(image: DataFrame, key: str, size: int, shape: str, f) -> DataFrame:
    return neighbourhood(image, key, size, shape).select(key, "x", "y", f("near").alias("v"))


def _extreme_of_box(image: DataFrame, key: str, size: int, f) -> DataFrame:
    """Of a box: along rows, then along columns."""
    r, out = _odd(size), image.select(key, "x", "y", "v")
    for along, other in (("x", "y"), ("y", "x")):
        out = out.withColumn("v", f("v").over(Window.partitionBy(key, other).orderBy(along).rowsBetween(-r, r)))
    return out


def _minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), [key, "x", "y"]).select(key, "x", "y", F.greatest(F.col("v") - F.col("w"), F.lit(0)).alias("v"))


def morph(image: DataFrame, key: str, kind: str = "dilate", size: int = 3, shape: str = "rect") -> DataFrame:
    """dilate, erode, open, close, gradient, tophat, blackhat."""
    box = lambda f, g: (lambda d: _extreme_of_box(d, key, size, f) if shape == "rect" else _extreme(d, key, size, shape, g))
    dilate, erode = box(F.max, F.array_max), box(F.min, F.array_min)
    if kind in ("dilate", "erode"):
        return (dilate if kind == "dilate" else erode)(image)
    if kind in ("open", "tophat"):
        opened = dilate(erode(image))
        return opened if kind == "open" else _minus(image, opened, key)
    if kind in ("close", "blackhat"):
        closed = erode(dilate(image))
        return closed if kind == "close" else _minus(closed, image, key)
    if kind == "gradient":
        return _minus(dilate(image), erode(image), key)
    raise ValueError(f"no operation {kind}")


def bitwise(op: str, a: Column, b: Column | None = None) -> Column:
    b = F.lit(255) if b is None else b
    return {"not": F.lit(255) - a, "and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b)}[op]


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.round(0.3 * r + 0.59 * g + 0.11 * b).cast("int")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct<h, s, v> of 8-bit channels: hue in half degrees (0 to 179), saturation and value in 0 to 255."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(span == 0, 0.0).when(high == r, 60.0 * (g - b) / span).when(high == g, 120 + 60.0 * (b - r) / span).otherwise(240 + 60.0 * (r - g) / span)
    return F.struct((F.round(F.pmod(hue, F.lit(360.0)) / 2) % 180).cast("int").alias("h"), F.when(high == 0, 0).otherwise(F.round(255.0 * span / high)).cast("int").alias("s"), high.cast("int").alias("v"))


def convert_color(image: DataFrame, code: str) -> DataFrame:
    """Images of channels r, g, b: rgb2gray gives v; rgb2hsv gives h, s, v; rgb2bgr swaps."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    rest = [c for c in image.columns if c not in ("r", "g", "b")]
    if code == "rgb2gray":
        return image.select(*rest, grey(r, g, b).alias("v"))
    if code == "rgb2hsv":
        return image.select(*rest, hsv(r, g, b).alias("c")).select(*rest, "c.*")
    if code == "rgb2bgr":
        return image.select(*rest, b.alias("r"), "g", r.alias("b"))
    raise ValueError(f"no conversion {code}")


def mask(image: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Zero outside a window; column `mask` says where it is."""
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return image.withColumn("mask", F.when(inside, 255).otherwise(0)).withColumn("v", F.when(inside, F.col("v")).otherwise(0))


def decimate(image: DataFrame) -> DataFrame:
    """Every second row and column."""
    return image.where("x % 2 = 0 AND y % 2 = 0").withColumn("x", (F.col("x") / 2).cast("int")).withColumn("y", (F.col("y") / 2).cast("int"))


def make_square(image: DataFrame, key: str) -> DataFrame:
    """Centred in a square as wide as the diagonal; new cells are 0."""
    size = image.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).withColumn("side", F.ceil(F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))).cast("int"))
    cells = size.select(key, "side", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("x")).select(key, "side", "x", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("y")).drop("side")
    moved = image.join(size, key).select(key, (F.col("x") + F.floor((F.col("side") - F.col("w")) / 2)).cast("int").alias("x"), (F.col("y") + F.floor((F.col("side") - F.col("h")) / 2)).cast("int").alias("y"), "v")
    return cells.join(moved, [key, "x", "y"], "left").fillna({"v": 0})


def rotate(image: DataFrame, key: str, degrees: float) -> DataFrame:
    """About the centre, by nearest pixel; cells that nothing reaches are 0."""
    a = np.radians(degrees)
    size = image.groupBy(key).agg(((F.max("x")) / 2).alias("cx"), ((F.max("y")) / 2).alias("cy"))
    here = image.join(size, key)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    source = here.select(key, "x", "y", F.round(dx * float(np.cos(a)) - dy * float(np.sin(a)) + F.col("cx")).cast("int").alias("sx"), F.round(dx * float(np.sin(a)) + dy * float(np.cos(a)) + F.col("cy")).cast("int").alias("sy"))
    values = image.select(key, F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    return source.join(values, [key, "sx", "sy"], "left").select(key, "x", "y", F.coalesce("v", F.lit(0)).alias("v"))


#: Lines along which pixels touch: what is equal on a line, and the order on it.
STRAIGHT = (("y", "x"), ("x", "y"))
SLANTED = (("x - y", "x"), ("x + y", "x"))


def areas(image: DataFrame, key: str, diagonal: bool = False) -> DataFrame:
    """(key, x, y, v, area): the pixels over 0 with the least place (y, then x) of their connected area, by their four neighbours or
    all eight. In a round each run of pixels on a line, of rows, columns and with diagonal of slants, takes its least place, so
    a round passes whole runs; it ends when nothing changes."""
    found = cut(image.where("v > 0").select(key, "x", "y", "v", F.struct("y", "x").alias("area")))
    measure = lambda d: d.agg(F.sum(F.xxhash64(key, "x", "y", "area").cast("decimal(38,0)"))).first()[0]
    state = measure(found)
    while True:
        for line, along in (*STRAIGHT, *(SLANTED if diagonal else ())):
            on = Window.partitionBy(key, F.expr(line))
            # places of a run less their numbers are equal
            runs = found.withColumn("tsl_run", F.col(along) - F.row_number().over(on.orderBy(along)))
            found = runs.withColumn("area", F.min("area").over(Window.partitionBy(key, F.expr(line), "tsl_run"))).drop("tsl_run")
        found = cut(found)
        state, before = measure(found), state
        if state == before:
            return found


def contours(image: DataFrame, key: str) -> DataFrame:
    """(key, label, n, x0, y0, x1, y1): boxes of 4-connected areas of pixels over 0, largest first by n."""
    box = areas(image, key).groupBy(key, "area").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), "x0", "y0", "x1", "y1")
    return box.select(key, (F.row_number().over(order) - 1).alias("label"), "n", "x0", "y0", "x1", "y1")


def gradient(image: DataFrame, key: str) -> DataFrame:
    """(key, x, y, gx, gy) by Sobel's weights; missing neighbours count as the border's own value."""
    weights = {(-1, -1): (-1, -1), (0, -1): (0, -2), (1, -1): (1, -1), (-1, 0): (-2, 0), (1, 0): (2, 0), (-1, 1): (-1, 1), (0, 1): (0, 2), (1, 1): (1, 1)}
    cells = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b")) for (i, j), (a, b) in weights.items()])
    moved = image.select(key, "x", "y", "v", F.explode(cells).alias("d")).select(key, (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), F.col("v").alias("w"), "d.a", "d.b")
    both = image.join(moved, [key, "x", "y"], "left")
    part = lambda c: F.coalesce(F.sum(F.col(c) * (F.col("w") - F.col("v"))), F.lit(0)).alias(f"g{'x' if c == 'a' else 'y'}")
    return both.groupBy(key, "x", "y").agg(part("a"), part("b"))


def edges(image: DataFrame, key: str, at: int = 100) -> DataFrame:
    """Pixels whose gradient's length is over a threshold."""
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return gradient(image, key).select(key, "x", "y", F.when(length > at, 255).otherwise(0).alias("v"))


def canny(image: DataFrame, key: str, low: float = 100, high: float = 200, straight: bool = True) -> DataFrame:
    """Edges: pixels whose gradient is no shorter than its neighbour's before it and longer than that behind it, across the edge, if it
    is over `high`, or over `low` and linked with one over `high` through such pixels, diagonals too. straight: the length is that of
    the vector, else the sum of both parts."""
    gx, gy = F.col("gx"), F.col("gy")
    length = F.sqrt((gx * gx + gy * gy).cast("double")) if straight else (F.abs(gx) + F.abs(gy)).cast("double")
    # across: along x, along y, or along a slant
    flat, steep = F.abs(gy) <= F.abs(gx) * 0.41421356, F.abs(gy) >= F.abs(gx) * 2.41421356
    dx = F.when(flat, 1).when(steep, 0).otherwise(1)
    dy = F.when(flat, 0).when(steep, 1).when(gx * gy > 0, 1).otherwise(-1)
    lengths = cut(gradient(image, key).select(key, "x", "y", length.alias("m"), dx.alias("dx"), dy.alias("dy")))
    near = lambda sign, name: lengths.select(key, F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("m").alias(name)).withColumn("side", F.lit(sign))
    out = lengths
    for sign, name in ((-1, "before"), (1, "behind")):
        out = out.withColumns({"nx": F.col("x") + sign * F.col("dx"), "ny": F.col("y") + sign * F.col("dy")}).join(near(sign, name).drop("side"), [key, "nx", "ny"], "left").drop("nx", "ny")
    crest = out.where((F.col("m") > low) & (F.col("m") >= F.coalesce("before", F.lit(0.0))) & (F.col("m") > F.coalesce("behind", F.lit(0.0))))
    linked = areas(crest.select(key, "x", "y", F.when(F.col("m") > high, 2).otherwise(1).alias("v")), key, diagonal=True)
    strong = linked.groupBy(key, "area").agg(F.max("v").alias("most")).where("most = 2").select(key, "area")
    kept = linked.join(strong, [key, "area"]).select(key, "x", "y", F.lit(255).alias("edge"))
    return image.select(key, "x", "y").join(kept, [key, "x", "y"], "left").select(key, "x", "y", F.coalesce("edge", F.lit(0)).alias("v"))


def skew_angle(image: DataFrame, key: str) -> DataFrame:
    """(key, angle) in degrees: the main axis of the pixels over 0, from their second moments."""
    p = image.where("v > 0")
    return p.groupBy(key).agg((F.degrees(F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))) / 2).alias("angle"))


def gain_bias(image: DataFrame, key: str, mean: float = 127.0, deviation: float = 50.0) -> DataFrame:
    """Values shifted and stretched to a mean and a deviation, cut to 0..255."""
    stats = image.groupBy(key).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    moved = F.when(F.col("d") > 0, (F.col("v") - F.col("m")) * deviation / F.col("d") + mean).otherwise(mean)
    return image.join(stats, key).select(key, "x", "y", F.greatest(F.lit(0), F.least(F.lit(255), F.round(moved))).cast("int").alias("v"))


def ocr_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a 12-field, tab-separated recognition table; shorter rows and the heading go."""
    f = F.split(F.col(column), "\t", -1)
    rows = lines.select(f.alias("f")).where((F.size("f") >= 12) & (F.element_at("f", 1) != "level"))
    n = lambda i: F.try_element_at("f", F.lit(i)).try_cast("int")
    location = F.struct(*[n(i + 1).alias(c) for i, c in enumerate(("level", "page", "block", "par", "line", "word"))])
    box = F.struct(*[n(i + 7).alias(c) for i, c in enumerate(("left", "top", "width", "height"))])
    return rows.select(location.alias("location"), box.alias("box"), F.element_at("f", 11).try_cast("double").alias("conf"), F.element_at("f", 12).alias("text"))
