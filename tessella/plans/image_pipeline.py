"""Chains of image operations written as `name(k=v, k=v)`, folded into one lazy plan."""

from __future__ import annotations

import ast
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import images

_CALL = re.compile(r"^\s*(?:(image|histogram|info)\s*:\s*)?([A-Za-z_]+)\s*\(\s*(.*?)\s*\)\s*$")


def value(text: str):
    """A float, int, bool, tuple, list or dict by its full form; anything else is a string."""
    if text in ("True", "False", "None") or re.fullmatch(r"[-+]?[0-9]+|[-+]?[0-9]*\.[0-9]+(?:e[-+]?[0-9]+)?|[(\[{].*[)\]}]", text):
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return text
    return text


def operation(text: str) -> tuple[str, str, dict]:
    """(destination, name, arguments) of one operation."""
    m = _CALL.match(text)
    if not m:
        raise ValueError(f"not an operation: {text!r}")
    arguments = {}
    for part in filter(None, re.split(r",\s+(?=[A-Za-z_]+\s*=)", m[3])):
        k, eq, v = part.partition("=")
        if not eq:
            raise ValueError(f"not an argument: {part!r}")
        arguments[k.strip()] = value(v.strip())
    return m[1] or "image", m[2], arguments


OPERATIONS = {
    "blur": lambda d, key, size=3: images.average_blur(d, key, size),
    "median_blur": lambda d, key, size=3: images.median_blur(d, key, size),
    "gaussian_blur": lambda d, key, size=5: images.gaussian_blur(d, key, size),
    "bilateral_blur": lambda d, key, size=7: images.bilateral_blur(d, key, size),
    "morph": lambda d, key, kind="dilate", size=3, shape="rect": images.morph(d, key, kind, size, shape),
    "threshold": lambda d, key, kind="binary", at=127: d.withColumn("v", images.threshold(F.col("v"), kind, at)),
    "adaptive_threshold": lambda d, key, size=11, minus=2, kind="mean": images.adaptive_threshold(d, key, size, minus, kind=kind),
    "clahe": lambda d, key, clip=4.0, tiles=8: images.clahe(d, key, clip, tiles),
    "unsharp": lambda d, key, amount=2.0, blurred=0.5, plus=0, size=3: images.unsharp(d, key, amount, blurred, plus, size),
    "bitwise": lambda d, key, op="not": d.withColumn("v", images.bitwise(op, F.col("v"))),
    "mask": lambda d, key, x=0, y=0, w=1, h=1: images.mask(d, x, y, w, h).drop("mask"),
    "decimate": lambda d, key: images.decimate(d),
    "rotate": lambda d, key, degrees=0: images.rotate(d, key, degrees),
    "make_square": lambda d, key: images.make_square(d, key),
    "edges": lambda d, key, at=100: images.edges(d, key, at),
    "canny": lambda d, key, low=100, high=200: images.canny(d, key, low, high),
    "gain_bias": lambda d, key, mean=127, deviation=50: images.gain_bias(d, key, mean, deviation),
    # contrast by the deviation, local threshold, then closing: text stands out of uneven light
    "document": lambda d, key: images.morph(images.adaptive_threshold(images.gain_bias(d, key), key), key, "close"),
    "crop": lambda d, key: _crop(d, key),
}


def _crop(d: DataFrame, key: str) -> DataFrame:
    """To the largest area of closed edges."""
    box = images.contours(images.morph(images.canny(d, key), key, "close"), key).where("label = 0").select(key, "x0", "y0", "x1", "y1")
    inside = d.join(box, key).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return inside.select(key, (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "v")


def run(image: DataFrame, key: str, operations: list[str]) -> DataFrame:
    """The images after all operations; `histogram: ...` as the last one gives bins instead."""
    steps = [operation(o) for o in operations]
    for _, name, _ in steps:
        if name not in OPERATIONS and name != "histogram":
            raise ValueError(f"no operation {name}")
    out = reduce(lambda d, s: d if s[1] == "histogram" else OPERATIONS[s[1]](d, key, **s[2]), steps, image)
    return images.histogram(out) if steps and "histogram" in steps[-1][:2] else out
