"""String functions as Columns: substitution and rail ciphers, framing, subsequences and edit distance."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LETTERS = string.ascii_lowercase


def key_alphabet(phrase: str) -> str:
    """The phrase's letters without repeats, then the alphabet going on after the last one, used letters skipped."""
    seen = list(dict.fromkeys(c for c in phrase.lower() if c in LETTERS))
    if not seen:
        raise ValueError("the key phrase holds no letter")
    after = LETTERS.index(seen[-1]) + 1
    return "".join(seen + [c for c in LETTERS[after:] + LETTERS[:after] if c not in seen])


def caesar(message: Column, shift: int = 3, phrase: str | None = None, sub: str | None = None, encrypt: bool = True) -> Column:
    """Substitution by a key phrase, else by a given alphabet, else by a shift; other characters pass."""
    if phrase is not None:
        target = key_alphabet(phrase)
    elif sub is not None:
        target = sub.lower()
        if len(set(target)) != len(target):
            raise ValueError("a substitution may use each character once")
    else:
        target = LETTERS[shift % 26 :] + LETTERS[: shift % 26]
    source = LETTERS[: len(target)]
    target = target[: len(source)]
    return F.translate(F.lower(message), *((source, target) if encrypt else (target, source)))


def _characters(message: Column) -> Column:
    return F.filter(F.split(message, ""), lambda c: c != "")


def rail_fence(message: Column, rows: int = 3, lead: int = 1, keep_case: bool = True) -> Column:
    """Every rows-th character, starting with rail `lead`, white space left out (a stride, not a zigzag)."""
    text = F.regexp_replace(message if keep_case else F.lower(message), r"\s", "")
    return F.concat(*[_rail(text, rows, (lead - 1 + k) % rows) for k in range(rows)])


def _rail(text: Column, rows: int, rail: int) -> Column:
    """Of the text from place `rail` on the first of each `rows` characters."""
    return F.regexp_replace(F.substring(text, rail + 1, 1 << 30), f"(?s)(.).{{0,{rows - 1}}}", "$1")


def rail_fence_back(cipher: Column, rows: int = 3, lead: int = 1) -> Column:
    """What rail_fence made its text from (white space stays lost)."""
    n = F.length(cipher)
    sizes = {r: ((n - r + rows - 1) / rows).cast("int") for r in range(rows)}
    start, starts = F.lit(0), {}
    for k in range(rows):
        r = (lead - 1 + k) % rows
        starts[r] = start
        start = start + sizes[r]

    def at(i: Column) -> Column:
        place = starts[rows - 1]
        for r in range(rows - 1):
            place = F.when(i % rows == r, starts[r]).otherwise(place)
        return F.substring(cipher, place + (i / rows).cast("int") + 1, F.lit(1))

    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), ""))


def cipher(name: str, message: Column, parameters: list[str], encrypt: bool = True) -> Column:
    """A cipher by name with KEY=VALUE parameters: caesar (keyphrase, sub, shift), rail_fence (rows, lead, keep_case)."""
    given = dict(p.split("=", 1) for p in parameters)
    if name == "caesar":
        return caesar(message, int(given.get("shift", "3")), given.get("keyphrase"), given.get("sub"), encrypt)
    if name == "rail_fence":
        rows, lead = int(given.get("rows", "2")), int(given.get("lead", "1"))
        return rail_fence(message, rows, lead, given.get("keep_case", "True") == "True") if encrypt else rail_fence_back(message, rows, lead)
    raise ValueError(f"no cipher {name}")


def packets(message: Column, packet_size: int = 32) -> Column:
    """array<string>: chunks behind two four-digit headers, the chunk's size and how many chunks remain."""
    room = packet_size - 8
    n = F.greatest(F.ceil(F.length(message) / room).cast("int"), F.lit(1))

    def packet(i: Column) -> Column:
        chunk = F.substring(message, i * room + 1, F.lit(room))
        return F.concat(F.lpad(F.length(chunk).cast("string"), 4, "0"), F.lpad((n - 1 - i).cast("string"), 4, "0"), chunk)

    return F.transform(F.sequence(F.lit(0), n - 1), packet)


def packet_fields(packet: Column) -> tuple[Column, Column, Column]:
    """(size, remaining, payload) of a packet."""
    return F.substring(packet, 1, 4).cast("int"), F.substring(packet, 5, 4).cast("int"), F.substring(packet, 9, 1 << 30)


def reassemble(packets_df: DataFrame, key: str, packet: str) -> DataFrame:
    """Messages from packet rows of any order: a message's chunks are ordered by what remains after them."""
    _, remaining, payload = packet_fields(F.col(packet))
    parts = F.sort_array(F.collect_list(F.struct((-remaining).alias("at"), payload.alias("payload"))))
    return packets_df.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["payload"]), "").alias("message"))


def reply(message: Column) -> Column:
    """The echo server's answer: spaces become underscores."""
    return F.translate(message, " ", "_")


def author_slug(author: Column, space: str = "-") -> Column:
    return F.replace(F.lower(F.rtrim(author)), F.lit(" "), F.lit(space))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, as a fold of rows of the dynamic program; stays in the JVM."""
    bs = _characters(b)
    zero = F.transform(bs, lambda _: F.lit(0))

    def row(above: Column, c: Column) -> Column:
        cells = F.arrays_zip(bs.alias("c"), above.alias("up"))

        def cell(state: Column, x: Column) -> Column:
            here = F.when(x["c"] == c, state["diag"] + 1).otherwise(F.greatest(x["up"], state["left"]))
            return F.struct(here.alias("left"), x["up"].alias("diag"), F.array_append(state["out"], here).alias("out"))

        start = F.struct(F.lit(0).alias("left"), F.lit(0).alias("diag"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(cells, start, cell, lambda s: s["out"])

    return F.coalesce(F.array_max(F.aggregate(_characters(a), zero, row)), F.lit(0))


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions and deletions cost 1, substitutions 2: both lengths less twice the common subsequence."""
    return F.length(a) + F.length(b) - 2 * common_subsequence(a, b)


def common_subsequence_text(a: Column, b: Column) -> Column:
    """One longest common subsequence; where both ways are as long, that of the shorter start of b. A fold over rows of the table of
    texts, so for texts of words and lines, not of pages."""
    width = F.length(b)
    none = F.transform(F.sequence(F.lit(0), width), lambda _: F.lit(""))

    def row(above: Column, x: Column) -> Column:
        def cell(line: Column, j: Column) -> Column:
            up, left = F.get(above, j), F.element_at(line, -1)
            longest = F.when(F.substring(b, j, F.lit(1)) == x, F.concat(F.get(above, j - 1), x)).when(F.length(up) > F.length(left), up).otherwise(left)
            return F.concat(line, F.array(longest))

        return F.aggregate(F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>")), F.array(F.lit("")), cell)

    return F.element_at(F.aggregate(_characters(a), none, row), -1)
