"""N-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

1. Documents with equal shingle sets form classes by a 128-bit digest; only classes are compared.
2. Three eighths of all shingles (by hash) are counted over the whole corpus, in packed arrays dealt by hash range. A class's
   prefix is its rarest shingles, as many as a partner at the threshold must share one of. A shingle of one class
   only matches nothing, so most classes drop out here, and frequent passages are never a key unless a text
   consists of little else.
3. A tile holds the classes with one prefix shingle in one band of sizes; a band is as wide as the threshold, so
   partners are in the same or the next one. In a tile, classes are compared by bitmap signatures: parities of hashed
   shingles, of a width that grows with the size. The number of differing bits bounds the symmetric difference from
   below and so the overlap from above. Only pairs that pass go to the exact intersection of sorted arrays. Large tiles
   are dealt into pairs of blocks of bounded size.
4. First each class meets its largest tile only, then its smallest, block by block, where links are found in place and
   connected pairs are skipped, which keeps large groups of near copies linear. Then all tiles that still hold different
   components are compared once more, whole: classes of a tile's most frequent component meet only the others. Where
   bitmaps allow few pairs, these meet their sets; where they allow many, their classes meet again in the tile with
   their sets, and only links leave it. So rows stay in proportion and no link is lost that could join two
   components. With `every_link` all pairs of all tiles are compared instead.

Shingles of very many classes are found in a sample of (shingle, class) entries; which they are changes only the order
of shingles, not the result. They come last in that order, uncounted, so no bucket holds all entries of such a shingle.

Defined cases: null and texts without words have an empty set, component = own id, and link with nothing; shorter texts
have one shingle, the whole sequence; null ids take part (component_id is the least id that is not null, or null); rows
that repeat are one class; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessella.llm.common import LOWER, MOST_BROADCAST, WordHasher, cut, default_parallelism, lean, mix, shingles, small, unused, utf8
from tessella.llm.components import components

TOKENS_PER_BUCKET = 3_000_000
BLOCK, BLOCK_TOKENS = 2_000, 1_000_000
#: One in so many entries is sampled for hot shingles: those of HOT classes at least, or of a millionth of all entries.
SAMPLED, HOT = 256, 20_000
UNCOUNTED = (1 << 32) - 1
#: Pairs a row that a group may list before it lists its classes instead.
DENSE = 4


def shingle_set(hasher: WordHasher, text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's UTF-8 bytes."""
    return np.unique(shingles(hasher(text.translate(LOWER)), words))


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signature(own: np.ndarray) -> np.ndarray:
    """Parities of shingles by hash: a power of two of bits, 64 at least and at least twice the set's size."""
    width = max(64, 1 << int(2 * max(len(own), 1) - 1).bit_length())
    bits = np.bincount((mix(own) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows) narrowed to so many 64-bit words: parities of the halves add up."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def in_region(tokens: np.ndarray) -> np.ndarray:
    """The three eighths of all shingles that are counted."""
    return tokens >> np.uint64(61) < 3


def counted_tokens(own: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(tokens that a class deals out, how many of them are in the region): the region's, and if they are fewer
    than a prefix, the least of the others, which come last in the order of all tokens."""
    inside = own[in_region(own)]
    short = prefix_size(len(own), percent) - len(inside)
    return (np.concatenate([inside, own[~in_region(own)][:short]]) if short > 0 else inside), len(inside)


def sampled(own: np.ndarray, percent: int, rate: int) -> np.ndarray:
    """The tokens that a class deals out, of one in `rate` classes; by its least token, so alike for all its copies."""
    chosen = len(own) and not mix(own[:1])[0] % np.uint64(rate)
    return (counted_tokens(own, percent)[0] if chosen else own[:0]).view(np.int64)


def _describe(words: int, percent: int, rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part, rows = batch.slice(start, 2000), []
                for text in part.column(1):
                    own = shingle_set(hasher, text.as_py(), words)
                    rows.append((digest(own) if len(own) else None, len(own), int(in_region(own).sum()), sampled(own, percent, rate)))
                fp, n, region, some = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(region, pa.int64()), pa.array(some, pa.list_(pa.int64()))], names=["doc_id", "fp", "n", "n_region", "sampled"])

    return run


def _deal(words: int, percent: int, buckets: int, often: Broadcast):
    """Tokens of texts, packed by bucket: the digests of documents, how many tokens each has there, and the tokens. The
    bucket is the token's, of hot tokens the class's."""

    def packed(fps: np.ndarray, bucket: np.ndarray, doc: np.ndarray, token: np.ndarray, hot: bool) -> pa.RecordBatch:
        order = np.lexsort((doc, bucket))
        token, doc, bucket = token[order], doc[order], bucket[order]
        ids, first = np.unique(bucket, return_index=True)
        rows = []
        for b, own_doc, own_token in zip(ids.tolist(), np.split(doc, first[1:]), np.split(token, first[1:]), strict=True):
            which, many = np.unique(own_doc, return_counts=True)
            rows.append((b, fps[which].tobytes(), many.astype(np.uint32).tobytes(), own_token.tobytes(), hot))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:4]), pa.array(columns[4], pa.bool_())], names=["bucket", "fps", "counts", "tokens", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                held: dict[bytes, np.ndarray] = {}
                for text in batch.column(0).slice(start, 2000):
                    own = shingle_set(hasher, text.as_py(), words)
                    if len(own):
                        held.setdefault(digest(own), own)
                if not held:
                    continue
                dealt = [counted_tokens(own, percent)[0] for own in held.values()]
                fps = np.frombuffer(b"".join(held), "V16")
                token = np.concatenate(dealt)
                doc = np.repeat(np.arange(len(dealt)), [len(x) for x in dealt])
                if len(often.value) and (hot := np.isin(token, often.value)).any():
                    part = (fps.view([("a", "<u8"), ("b", "<u8")])["a"] % np.uint64(buckets)).astype(np.int64)
                    yield packed(fps, part[doc[hot]], doc[hot], token[hot], True)
                    doc, token = doc[~hot], token[~hot]
                if len(token):
                    yield packed(fps, (mix(token) % np.uint64(buckets)).astype(np.int64), doc, token, False)

    return run


def _shared_tokens(parts: int):
    """Tokens of two classes at least with their numbers of classes, packed by a part of the classes' digests.

    Rows come sorted by bucket; one bucket is held at a time. Hot tokens are in their class's part already and pass."""

    def finish(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        fps = np.concatenate([np.frombuffer(r[0], "V16") for r in rows])
        many = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        token = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        unique, code = np.unique(fps.view([("a", "<u8"), ("b", "<u8")]), return_inverse=True)
        doc = np.repeat(code.ravel(), many)
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        token, doc = token[fresh], doc[fresh]  # copies of a class in other batches
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        df = np.repeat(size, size)
        kept = df > 1
        token, doc, df = token[kept], doc[kept], df[kept]
        order = np.argsort(doc, kind="stable")
        token, doc, df = token[order], doc[order], df[order]
        part = unique["a"][doc] % np.uint64(parts)
        order = np.lexsort((doc, part))
        token, doc, df, part = token[order], doc[order], df[order], part[order]
        ids, first = np.unique(part, return_index=True)
        out = []
        for i, own_doc, t, d in zip(ids.tolist(), *(np.split(x, first[1:]) for x in (doc, token, df)), strict=True) if len(ids) else ():
            which, many = np.unique(own_doc, return_counts=True)
            out.append((i, unique[which].tobytes(), many.astype(np.uint32).tobytes(), t.tobytes(), d.astype(np.uint32).tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "fps", "counts", "tokens", "dfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for b, *row, hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hot:
                    dfs = np.full(len(row[2]) // 8, UNCOUNTED, np.uint32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in (*row, dfs))], names=["part", "fps", "counts", "tokens", "dfs"])
                    continue
                if b != bucket and rows:
                    yield finish(rows)
                    rows = []
                bucket = b
                rows.append(tuple(row))
        if rows:
            yield finish(rows)

    return run


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows, sorted by part, to one row per class: its shared tokens and their numbers of classes."""

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        fps, many, token, df = (np.concatenate([np.frombuffer(r[i], kind) for r in rows]) for i, kind in enumerate(([("a", "<u8"), ("b", "<u8")], np.uint32, np.uint64, np.uint32)))
        unique, code = np.unique(fps, return_inverse=True)
        doc = np.repeat(code.ravel(), many)
        order = np.lexsort((token, doc)) if (df == UNCOUNTED).any() else np.argsort(doc, kind="stable")
        doc, token, df = doc[order], token[order], df[order]
        fresh = np.concatenate([[True], (np.diff(doc) != 0) | (token[1:] != token[:-1])])  # hot tokens of copies come again
        doc, pairs = doc[fresh], np.stack([token[fresh], df[fresh].astype(np.uint64)], axis=1)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        keys = unique.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([keys[16 * i : 16 * i + 16] for i in range(len(unique))], pa.binary()), pa.array([x.tobytes() for x in np.split(pairs, first[1:])], pa.binary())], names=["fp", "shared"])

    part, rows = None, []
    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part and rows:
                yield finish(rows)
                rows = []
            part = p
            rows.append(tuple(row))
    if rows:
        yield finish(rows)


def _band(n: int, percent: int) -> int:
    return int(math.log(n) / (math.log(100 / percent) * 1.0001))


def _tiles(percent: int):
    """(fp, n, n_region, shared) to the tiles of a class: token, band, home, fp, n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fp, n, region, shared in zip(batch["fp"], batch["n"], batch["n_region"], batch["shared"], strict=True):
                pairs = np.frombuffer(shared, np.uint64).reshape(-1, 2)
                inside = in_region(pairs[:, 0])
                own, others = pairs[inside], pairs[~inside, 0]
                single = region - len(own)
                left = max(0, min(prefix_size(n, percent), region) - single)
                chosen = np.concatenate([own[np.lexsort((own[:, 0], own[:, 1]))[:left], 0], others])
                band = _band(n, percent)
                out.append(pd.DataFrame({"token": chosen.view(np.int64), "band": band, "home": True, "fp": fp, "n": n}))
                out.append(pd.DataFrame({"token": chosen.view(np.int64), "band": band - 1, "home": False, "fp": fp, "n": n}))
            if out:
                yield pd.concat(out)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                own = [shingle_set(hasher, t.as_py(), words) for t in batch.column(1).slice(start, 2000)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 2000), pa.array([digest(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([signature(x).tobytes() for x in own], pa.binary())], names=["fp", "own", "tokens", "sig"])

    return run


def _compare(percent: int, every_link: bool, exact: bool):
    """What the rows of a tile's block pair give. With `exact` links (a, b, shared), by exact intersections; labels of
    classes that a link connects become one. Without it pairs (a, b) that sizes and bitmaps allow, or where these
    are over DENSE times the rows, the classes in them (a, null, token, band): never more than in proportion to the rows.

    Rows come sorted by group; a group has at most about two blocks of rows. Equal labels aren't compared."""

    def linked(g: dict[str, np.ndarray]) -> list[tuple]:
        order = np.argsort(g["n"], kind="stable")
        n, home, fp, block, label = (g[c][order] for c in ("n", "home", "fp", "block", "label"))
        cross = g["i"][0] != g["j"][0]
        sigs = [np.frombuffer(x, np.uint64) for x in g["sig"][order]]
        wide = {}  # signatures narrowed to a width, for all classes of at least that width
        if exact:
            code = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in g["tokens"][order]]), return_inverse=True)[1].ravel()
            start = np.concatenate([[0], np.cumsum(n)])
            member = np.zeros(int(code.max()) + 1, bool)
        out, marked = [], np.zeros(len(n), bool)
        for k in range(len(n) - 1):
            last = int(np.searchsorted(n, n[k] * 100 // percent, "right"))
            if last <= k + 1:
                continue
            good = home[k] | home[k + 1 : last]
            if not every_link:
                good &= label[k + 1 : last] != label[k]
            if cross:
                good &= block[k + 1 : last] != block[k]
            other = np.flatnonzero(good) + k + 1
            if not len(other):
                continue
            width = len(sigs[k])
            if width not in wide:
                first = next(i for i, x in enumerate(sigs) if len(x) >= width)
                wide[width] = first, np.concatenate([folded(x[None, :], width) for x in sigs[first:]])
            first, table = wide[width]
            differ = np.bitwise_count(table[other - first] ^ sigs[k]).sum(axis=1).astype(np.int64)
            overlap = (n[k] + n[other] - differ) // 2  # no more than that
            other = other[100 * overlap >= percent * (n[k] + n[other] - overlap)]
            if not len(other):
                continue
            if not exact:
                marked[k] = marked[other] = True
                if len(out) <= DENSE * len(n):
                    out += [(fp[k], x) for x in fp[other]]
                continue
            member[code[start[k] : start[k + 1]]] = True
            low, high = other[0], other[-1] + 1
            both = np.add.reduceat(member[code[start[low] : start[high]]].astype(np.int64), start[low:high] - start[low])[other - low]
            member[code[start[k] : start[k + 1]]] = False
            sure = 100 * both >= percent * (n[k] + n[other] - both)
            for m, shared in zip(other[sure].tolist(), both[sure].tolist(), strict=True):
                if every_link or label[m] != label[k]:
                    out.append((fp[k], fp[m], shared))
                    if not every_link:
                        label[label == label[m]] = label[k]
        if exact:
            return out
        if len(out) <= DENSE * len(n):
            return [(x, y, None, None) for x, y in out]
        token, band = int(g["token"][0]), int(g["band"][0])
        return [(x, None, token, band) for x in fp[marked]]

    def table(rows: list) -> pd.DataFrame:
        names = ["a", "b", "shared"] if exact else ["a", "b", "token", "band"]
        columns = list(zip(*rows, strict=True))
        # whole numbers next to nulls must not become floats
        return pd.DataFrame({n: pd.Series(c, dtype="Int64" if i > 1 else object) for i, (n, c) in enumerate(zip(names, columns, strict=True))})

    def of_groups(rows: pd.DataFrame) -> list[tuple]:
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        columns["label"] = np.unique(columns["label"], return_inverse=True)[1].ravel()
        fresh = np.zeros(len(rows), bool)
        for key in KEYS:
            fresh[1:] |= columns[key][1:] != columns[key][:-1]
        edges = [0, *np.flatnonzero(fresh).tolist(), len(rows)]
        return [p for a, b in zip(edges, edges[1:], strict=False) if b - a > 1 for p in linked({c: v[a:b] for c, v in columns.items()})]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None or not len(rest) else pd.concat([rest, batch])
            open_ = (rest[KEYS] == rest[KEYS].iloc[-1]).all(axis=1)
            done, rest = rest[~open_], rest[open_]
            if len(done) and (out := of_groups(done)):
                yield table(out)
        if rest is not None and len(rest) > 1 and (out := of_groups(rest)):
            yield table(out)

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, shared = [], []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
                    shared.append(both)
            index = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(shared, pa.int64())], names=["a", "b", "shared"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(_verify(percent)), "a binary, b binary, shared long")


def classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, fp (digest of its set; null if empty), n, n_region."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", utf8("text").alias("text")).mapInArrow(lean(_describe(words, percent, SAMPLED)), f"doc_id {kind}, fp binary, n long, n_region long, sampled array<long>"))


def hot_tokens(found: DataFrame, total: int) -> np.ndarray:
    """Tokens of at least HOT classes, or of a millionth of all entries if that is more: a million at most."""
    entries = found.where(F.size("sampled") > 0).select("fp", F.explode("sampled").alias("token")).distinct()
    many = entries.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED >= max(HOT, total // 1_000_000))
    return np.sort(many.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def links(docs: DataFrame, found: DataFrame, words: int = 4, percent: int = 85, every_link: bool = False) -> DataFrame:
    """Verified links (a, b, shared) between classes: all of them, or as many as connect all that all would connect."""
    spark = docs.sparkSession
    per_class = cut(found.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("n_region").alias("n_region")))
    total = per_class.agg(F.sum("n")).first()[0] or 0
    buckets = int(total * 3 / 8 // TOKENS_PER_BUCKET) + 1
    buckets = max(buckets, min(4 * buckets, default_parallelism(spark)))
    text = utf8("text").alias("text")
    often = spark.sparkContext.broadcast(hot_tokens(found, total))
    dealt = docs.select(text).mapInArrow(lean(_deal(words, percent, buckets, often)), "bucket int, fps binary, counts binary, tokens binary, hot boolean")
    shared = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_shared_tokens(buckets)), "part int, fps binary, counts binary, tokens binary, dfs binary")
    few = shared.repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(lean(_by_class), "fp binary, shared binary")
    # a class whose unshared tokens fill its prefix has no partner
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    able = few.join(per_class, "fp").where(F.col("n_region") - F.octet_length("shared") / 16 < prefix).select("fp", "n", "n_region", "shared")
    tiles = cut(able.mapInPandas(lean(_tiles(percent)), "token long, band int, home boolean, fp binary, n long"))

    sizes = tiles.groupBy("token", "band").agg(F.count("*").alias("rows"), F.max("home").alias("homes"), (_in_blocks(F.count("*"), F.sum("n")) > 1).alias("large")).where("rows > 1 and homes").drop("homes")
    tiles = cut(tiles.join(sizes, ["token", "band"]))
    large = tiles.where("large").limit(1).count() > 0
    needed = cut(tiles.select("fp").distinct())
    reps = needed.join(per_class, "fp").select("fp", F.col("rep").alias("rep_id"))
    if needed.count() <= MOST_BROADCAST:  # reps has as many rows
        reps = F.broadcast(reps)
    # the texts of the classes that are left; null or repeated ids may bring other texts along, which the digest tells
    chosen = docs.select("doc_id", text).join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("fp", "text")
    sets = cut(chosen.mapInArrow(lean(_sets(words)), "fp binary, own binary, tokens binary, sig binary").where("own = fp").drop("own").dropDuplicates(["fp"]))

    largest, smallest = F.max(F.struct("rows", "token")), F.min(F.struct("rows", "token"))
    done, label = [], None
    for turn, chosen_tile in enumerate([] if every_link else [largest, largest, smallest]):
        if turn == 1 and not large:  # this turn deals large tiles anew
            continue
        rows = _labelled(tiles if turn != 1 else tiles.where("large"), label)
        rows = rows.join(rows.groupBy("fp").agg(chosen_tile.alias("top")).select("fp", F.col("top.token").alias("token")), ["fp", "token"], "left_semi")
        rows = rows.join(_blocks(rows), ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(turn)), F.col("blocks")).cast("int"))
        rows = rows.select(*KEYS[:2], F.col("block").alias("i"), F.col("block").alias("j"), *OWN).join(sets, "fp")
        done.append(cut(_linked(rows, percent, every_link)))
        label = components(reduce(DataFrame.unionByName, done)).select(F.col("node").alias("fp"), "label")
    rows = _labelled(tiles, label)
    small_tiles = rows.where("not large") if large else rows
    open_ = small_tiles.join(_blocks(small_tiles).drop("blocks"), ["token", "band"]).withColumns({c: F.lit(0) for c in ("block", "i", "j")}).select(*KEYS, *OWN)
    if large:
        open_ = open_.unionByName(_dealt(rows.where("large"), by_tokens=False).select(*KEYS, *OWN))
    open_ = open_.join(sets.drop("tokens"), "fp").select(*KEYS, *OWN, "sig")
    maybe = cut(open_.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(lean(_compare(percent, every_link, exact=False)), "a binary, b binary, token long, band int"))
    sparse = maybe.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done.append(cut(_verified(sparse, sets, percent)))
    dense = maybe.where("b is null").select("token", "band", F.col("a").alias("fp")).distinct()
    if dense.limit(1).count():
        done.append(cut(_linked(_dealt(rows.join(dense, ["token", "band", "fp"], "left_semi"), by_tokens=True).join(sets, "fp"), percent, every_link)))
    return reduce(DataFrame.unionByName, done).groupBy("a", "b").agg(F.first("shared").alias("shared"))


KEYS = ["token", "band", "i", "j"]
OWN = ["block", "home", "fp", "n", "label"]


def _labelled(tiles: DataFrame, label: DataFrame | None) -> DataFrame:
    """Tiles with the components so far; a class without links is its own."""
    return tiles.withColumn("label", F.col("fp")) if label is None else tiles.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def _in_blocks(rows, tokens):
    return F.ceil(F.greatest(rows / BLOCK, tokens / BLOCK_TOKENS)).cast("int")


def _blocks(rows: DataFrame) -> DataFrame:
    """(token, band, blocks) of tiles with several labels."""
    tiles = rows.groupBy("token", "band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    return tiles.where("low <> high").select("token", "band", _in_blocks(F.col("rows"), F.col("tokens")).alias("blocks"))


def _dealt(rows: DataFrame, by_tokens: bool) -> DataFrame:
    """Rows of tiles with several labels in all pairs of blocks (i, j) that can hold pairs with different labels: rows
    of the tile's most frequent label are in blocks after the others' and meet only these. Tiles of one block are not dealt."""
    by_label = rows.groupBy("token", "band", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    top = F.max_by(F.struct("label", "rows", "tokens"), F.struct("rows", "label")).alias("top")
    tiles = by_label.groupBy("token", "band").agg(F.count("*").alias("labels"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), top).where("labels > 1")
    tiles = tiles.select("token", "band", F.col("top.label").alias("most"), _in_blocks(F.col("rows") - F.col("top.rows"), (F.col("tokens") - F.col("top.tokens")) * int(by_tokens)).alias("few"), _in_blocks(F.col("top.rows"), F.col("top.tokens") * int(by_tokens)).alias("many"), (_in_blocks(F.col("rows"), F.col("tokens") * int(by_tokens)) == 1).alias("single"))
    frequent, draw = F.col("label") == F.col("most"), F.xxhash64("fp")
    rows = rows.join(tiles, ["token", "band"])
    rows = rows.withColumn("block", F.when(F.col("single"), 0).when(frequent, F.col("few") + F.pmod(draw, F.col("many"))).otherwise(F.pmod(draw, F.col("few"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("single"), 0).otherwise(F.col("few") - 1 + F.when(frequent, 0).otherwise(F.col("many"))))))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def _linked(rows: DataFrame, percent: int, every_link: bool) -> DataFrame:
    """Links within the groups of rows (KEYS, OWN, sig, tokens)."""
    rows = rows.select(*KEYS, *OWN, "sig", "tokens")
    pairs = rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(lean(_compare(percent, every_link, exact=True)), "a binary, b binary, shared long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")


def _component_rows(docs: DataFrame, words: int, percent: int, every_link: bool) -> tuple[DataFrame, DataFrame]:
    """Per row of docs doc_id, fp, n and label (fp of its component; null without words), and the links of classes."""
    found = classes(docs, words, percent)
    pairs = links(docs, found, words, percent, every_link)
    label = components(pairs).withColumnRenamed("node", "fp")
    return found.select("doc_id", "fp", "n").join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), pairs


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, every_link: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, and n_links of its class with every_link."""
    rows, pairs = _component_rows(docs, words, percent, every_link)
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "label", "left").select("doc_id", "fp", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    if every_link:
        both = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
        rows = rows.join(both, "fp", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return rows.drop("fp")


def _with_digest(words: int, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            own = [shingle_set(hasher, (t.as_py() or "").encode("utf-8", "replace"), words) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(x) if len(x) else None for x in own], pa.binary())], names=[*batch.schema.names, name])

    return run


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the least id (null comes last); texts without words all stay.

    Rows whose id is null or occurs again are told apart by their sets, so a row with another text than its namesake is
    judged by its own text; of rows that agree in id and set the one with the least text stays."""
    groups = cut(_component_rows(docs, words, percent, False)[0].where("fp is not null"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    first = groups.groupBy("label").agg(F.min(key).alias("first"))
    marked = groups.join(first, "label").select("doc_id", "fp", (key == F.col("first")).alias("stays"))
    twice, out, own, mine, digests = (unused(docs, n) for n in ("__again", "__gone", "__fp", "__id", "__own"))
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias(twice)))
    gone = cut(marked.where("not stays and doc_id is not null").select(F.col("doc_id").alias(out)).distinct().join(again, F.col(out) == F.col(twice), "left_anti"))
    kept = docs.join(small(gone), docs["doc_id"] == F.col(out), "left_anti")
    if not again.limit(1).count() and not groups.where("doc_id is null").limit(1).count():
        return kept
    several = small(again)
    clear = kept.where("doc_id is not null").join(several, kept["doc_id"] == F.col(twice), "left_anti")
    unclear = docs.where("doc_id is null").unionByName(docs.join(several, docs["doc_id"] == F.col(twice), "left_semi"))
    unclear = unclear.mapInArrow(lean(_with_digest(words, docs.columns.index("text"), own)), StructType([*docs.schema.fields, StructField(own, BinaryType())]))
    stays = marked.where("stays").select(F.col("doc_id").alias(mine), F.col("fp").alias(digests)).distinct()
    chosen = unclear.where(F.col(own).isNotNull()).join(stays, F.col("doc_id").eqNullSafe(F.col(mine)) & (F.col(own) == F.col(digests)), "left_semi")
    chosen = chosen.groupBy("doc_id", own).agg(F.min_by(F.struct(*docs.columns), "text").alias(unused(docs, "row"))).select(f"{unused(docs, 'row')}.*")
    return clear.unionByName(chosen).unionByName(unclear.where(F.col(own).isNull()).drop(own))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w
), u AS (
  SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, unnest(sh) AS t FROM s WHERE len(sh) > 0
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT x, y FROM pairs UNION SELECT y, x FROM pairs
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.reach) AS component_id
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.sh
"""
