"""Bit and number functions as Columns over BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.session import cut


def kth_bit(n: Column, k: int, op: str = "set") -> Column:
    mask = F.lit(1 << k).cast("long")
    if op == "set":
        return n.bitwiseOR(mask)
    if op == "clear":
        return n.bitwiseAND(F.lit(~(1 << k)).cast("long"))
    if op == "toggle":
        return n.bitwiseXOR(mask)
    raise ValueError(f"no operation {op}")


def bit_field(n: Column, mask: int, shift: int) -> Column:
    """The masked bits, moved to the right."""
    return F.shiftright(n.bitwiseAND(F.lit(mask).cast("long")), shift)


def put_bit_field(n: Column, mask: int, shift: int, value: Column) -> Column:
    """n with the masked bits replaced by value, moved to the left."""
    return n.bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(F.shiftleft(value, shift).bitwiseAND(F.lit(mask).cast("long")))


def add_modulo(x: Column, y: Column, n: Column) -> Column:
    """(x + y) mod n for 0 <= x, y < n, by one subtraction."""
    z = x + y
    return z - F.when(z >= n, n).otherwise(F.lit(0))


def next_power_of_two(n: Column) -> Column:
    """The least power of two from n on; 0 for 0. Exact: a chain of ORs, no logarithm."""
    z = n - 1
    for step in (1, 2, 4, 8, 16, 32):
        z = z.bitwiseOR(F.shiftright(z, step))
    return F.when(n <= 0, F.lit(0)).otherwise(z + 1).cast("long")


def log2_of_power(n: Column) -> Column:
    """The exponent of a power of two, for all of BIGINT's: the bits below it are counted."""
    return F.bit_count(n - 1)


def magic_triangle(numbers: Column, side: Column) -> Column:
    """Whether the corner sum that sides of this sum need lies between the sums of the three least and three largest
    numbers: necessary, not sufficient."""
    ordered = F.sort_array(numbers)
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    corners = 3 * side - add(ordered)
    return (corners >= add(F.slice(ordered, 1, 3))) & (corners <= add(F.slice(ordered, -3, 3)))


def survivor(items: Column) -> Column:
    """Who is left of a circle when every second one goes: 2 (n - 2^floor(log2 n)) + 1 by count."""
    n = F.size(items)
    top = F.shiftright(next_power_of_two((n + 1).cast("long")), 1).cast("int")
    return F.try_element_at(items, 2 * (n - top) + 1)


def integer_sum(start: Column, end: Column) -> Column:
    """start + ... + end, for start < end; null otherwise."""
    total = (start + end) * (end - start + 1)
    return F.when(start < end, F.shiftright(total, 1))


def is_prime(n: Column) -> Column:
    """Trial division by 2, 3 and 6k +- 1."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    steps = F.when(root >= 5, F.sequence(F.lit(5).cast("long"), root, F.lit(6).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    clean = F.forall(steps, lambda d: (n % d != 0) & (n % (d + 2) != 0))
    return F.when(n < 2, False).when(n < 4, True).when((n % 2 == 0) | (n % 3 == 0), False).otherwise(clean | n.isin(5, 7))


def primes(spark: SparkSession, limit: int = 1000) -> DataFrame:
    """Primes below limit: numbers without composites, an anti join."""
    numbers = spark.range(2, max(limit, 2)).withColumnRenamed("id", "prime")
    small = spark.range(2, max(3, int(limit**0.5) + 1)).withColumnRenamed("id", "factor")
    # only multiples are generated: limit * log(limit) rows, no cross join
    composites = small.select(F.explode(F.sequence(F.col("factor") * F.col("factor"), F.lit(max(limit, 4)), F.col("factor"))).alias("prime")).distinct()
    return numbers.join(composites, "prime", "left_anti")


def follows_to(permutation: Column, start: Column) -> Column:
    """Whether following a permutation of 1..n from start comes to start within n // 2 steps."""
    steps = F.sequence(F.lit(1), F.greatest(F.floor(F.size(permutation) / 2).cast("int"), F.lit(1)))
    state = F.struct(start.cast("long").alias("at"), F.lit(False).alias("found"))

    def step(s: Column, _: Column) -> Column:
        nxt = F.element_at(permutation, s["at"].cast("int")).cast("long")
        return F.struct(F.when(s["found"], s["at"]).otherwise(nxt).alias("at"), (s["found"] | (nxt == start)).alias("found"))

    return F.when(F.size(permutation) < 2, False).otherwise(F.aggregate(steps, state, step, lambda s: s["found"]))


def cycles(permutation: DataFrame) -> DataFrame:
    """(node, cycle, length) of a permutation (node, next): pointer doubling, log2(n) rounds of joins by node."""
    hops = cut(permutation.select("node", F.col("next").alias("to"), F.least("node", "next").alias("cycle")))
    reach, n = 1, permutation.count()
    while reach < n:
        ahead = hops.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("cycle").alias("cycle2"))
        # each round reads the last one twice: without a cut, plans would double in size
        hops = cut(hops.join(ahead, "to").select("node", F.col("to2").alias("to"), F.least("cycle", "cycle2").alias("cycle")))
        reach *= 2
    return hops.select("node", "cycle", F.count("*").over(Window.partitionBy("cycle")).alias("length"))


def shuffled(numbers: Column) -> Column:
    """The numbers in random order (not reproducible)."""
    return F.shuffle(numbers)


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """(n, fib) for 0..n by a recursive query."""
    return spark.sql(f"""
      WITH RECURSIVE f(n, fib, nxt) AS (
        SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT)
        UNION ALL SELECT n + 1, nxt, fib + nxt FROM f WHERE n < {int(n)}
      ) SELECT n, fib FROM f""")


def subset_counts(items: Column, target: int) -> Column:
    """How many subsets of distinct non-negative items have this sum: a fold over a table of counts by sum. An
    item 0 doubles nothing, as a sum that is reached is counted once."""
    start = F.transform(F.sequence(F.lit(0), F.lit(target)), lambda i: F.when(i == 0, 1).otherwise(0).cast("long"))
    useful = F.filter(F.array_distinct(items), lambda x: (x > 0) & (x <= target))

    def add(ways: Column, item: Column) -> Column:
        return F.transform(ways, lambda w, s: w + F.when(s >= item, F.element_at(ways, F.greatest(s - item, F.lit(0)).cast("int") + 1)).otherwise(F.lit(0)))

    return F.element_at(F.aggregate(useful, start, add), target + 1)


def descend(start: Column, gradient, step: float, threshold: float, most_steps: int = 1000) -> Column:
    """Gradient descent on one number, until a step is below the threshold; gradient maps a Column to a Column."""
    state = F.struct(start.cast("double").alias("x"), F.lit(False).alias("done"))

    def go(s: Column, _: Column) -> Column:
        move = gradient(s["x"]) * step
        return F.struct(F.when(s["done"], s["x"]).otherwise(s["x"] - move).alias("x"), (s["done"] | (F.abs(move) < threshold)).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most_steps)), state, go, lambda s: s["x"])


# Fixed values of the damped pendulum: gravity, length, damping, start angle and velocity, time step.
GRAVITY, LENGTH, DAMPING, ANGLE, VELOCITY, STEP = 9.8, 2.0, 0.1, 3.141592653589793 / 3, 0.0, 0.01


def pendulum(seconds: Column, g: float = GRAVITY, length: float = LENGTH, mu: float = DAMPING, angle: float = ANGLE, velocity: float = VELOCITY, dt: float = STEP) -> Column:
    """The angle after some seconds by explicit Euler steps; the angle moves by the old velocity."""
    state = F.struct(F.lit(angle).alias("a"), F.lit(velocity).alias("v"))

    def go(s: Column, _: Column) -> Column:
        return F.struct((s["a"] + s["v"] * dt).alias("a"), (s["v"] + (-mu * s["v"] - (g / length) * F.sin(s["a"])) * dt).alias("v"))

    n = F.floor(seconds / dt + 1e-9).cast("int")
    return F.when(n < 1, F.lit(angle)).otherwise(F.aggregate(F.sequence(F.lit(1), n), state, go, lambda s: s["a"]))


#: Which three coin tosses beat which, as three bits each: the complement of the middle one, then the first two.
def better_guess(guess: Column) -> Column:
    first, middle = F.shiftright(guess, 2), F.shiftright(guess, 1) % 2
    return ((1 - middle) * 4 + first * 2 + middle).cast("int")
