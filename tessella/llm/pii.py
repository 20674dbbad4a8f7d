"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans: e-mail addresses, IPv4 addresses, card numbers and telephone numbers by pattern, leftmost and not
overlapping per kind, with their checks. Positions are running sums of the lengths of matches and of the pieces between
them, folded in blocks of about the square root of their number, so a text with 10^5 matches takes seconds.

Each matched value is a protected entity. Terms (runs of letters) that lie within `window` code points of an entity, and
not beyond the next match of the entity's pattern, may reveal it too. Over the whole corpus, with document frequencies df
(of a pair: documents with the term near the entity) and N documents, a term t reveals PMI(t; e) = log2(N df(t, e) /
(df(t) df(e))) bits of the IC(e) = log2(N / df(e)) bits that identify the entity e. Few observations prove little, so the
share PMI / IC is shrunk by df(t, e) / (df(t, e) + `shrink`). Terms whose shrunk share reaches `disclosure` are spans of
kind `term` there; entities of a single document count as any other.

The sanitised text has base matches generalised to their kind in brackets, in the order e-mail, ip, card, phone, each on
what the ones before left, and every occurrence of a document's disclosing terms replaced by `[term]`.

Defined cases: null texts are empty; a null id keeps its row; rows that repeat an id keep their own spans (they are
told apart by their text); empty tables give empty results; an entity of every document has no bits to reveal and
discloses nothing; the four kinds' names are never terms; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, small

KINDS = ("email", "ip", "card", "phone", "term")
# The contract's patterns. Possessive repeats and look-behinds change no match but keep the search linear in the text
# and its memory constant: a run of such characters is tried once, not from each of its places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be searched at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[\p{L}\p{M}]+"
SPAN = "struct<start:int,rank:int,end:int,kind:string,found:string>"
WIDE = "struct<start:int,rank:int,end:int,kind:string,found:string,before:string,after:string>"
MATCH = "struct<start:int,end:int,found:string,before:string,after:string>"
TERM_MATCH = "struct<start:int,end:int,found:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    last = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, last - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), last), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, kind: str, step) -> Column:
    """array<kind> of what step(at, item) gives, (next at, output), for items from the left; at is an int from 0.

    Appending to an array copies it. So outputs are gathered in blocks of about the square root of their number, and
    blocks in an array of blocks."""
    none = F.array().cast(f"array<{kind}>")

    def scan(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")

        def block(state: Column, k: Column) -> Column:
            def one(inner: Column, item: Column) -> Column:
                at, out = step(inner["at"], item)
                return F.struct(at.alias("at"), F.array_append(inner["out"], out).alias("out"))

            start = F.struct(state["at"].alias("at"), none.alias("out"))
            return F.aggregate(F.slice(all_, k * width + 1, width), start, one, lambda s: F.struct(s["at"].alias("at"), F.array_append(state["blocks"], s["out"]).alias("blocks")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / width).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))
        return F.when(F.size(all_) == 0, none).otherwise(F.flatten(F.aggregate(blocks, start, block, lambda s: s["blocks"])))

    return let(items, scan)


def _tail(piece: Column, window: int) -> Column:
    """The piece's last `window` code points, without a run of letters that their edge cuts."""
    cut_off = F.regexp_replace(F.right(piece, F.lit(window + 1)), r"\A(?:[\p{L}\p{M}]+|(?s:.))", "")
    return F.when(F.length(piece) > window, cut_off).otherwise(piece)


def _head(piece: Column, window: int) -> Column:
    """The piece's first `window` code points, likewise."""
    cut_off = F.regexp_replace(F.left(piece, F.lit(window + 1)), r"(?:[\p{L}\p{M}]+|(?s:.))\z", "")
    return F.when(F.length(piece) > window, cut_off).otherwise(piece)


def located(text: Column, pattern: str, window: int | None = None) -> Column:
    """All matches, TERM_MATCH: start and end in code points, end exclusive. With a window MATCH: also up to so many code
    points before and after, within the pieces on either side."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def zipped(b: Column) -> Column:
        return F.arrays_zip(F.slice(b, 1, F.size(b) - 1).alias("piece"), found.alias("found"), F.slice(b, 2, F.size(b)).alias("next"))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + F.length(m["piece"])
        end = start + F.length(m["found"])
        out = [start.alias("start"), end.alias("end"), m["found"].alias("found")]
        if window is not None:
            out += [_tail(m["piece"], window).alias("before"), _head(m["next"], window).alias("after")]
        return end, F.struct(*out)

    return running(let(between, zipped), TERM_MATCH if window is None else MATCH, step)


def base_spans(text: Column, kind: str, window: int | None = None) -> Column:
    """Valid base spans of a kind: array<SPAN>, with a window array<WIDE>."""
    rank, out = KINDS.index(kind), f"array<{SPAN if window is None else WIDE}>"
    may = text.rlike("[0-9]") if kind != "email" else F.lit(True)
    if NEEDS[kind]:
        may = text.contains(NEEDS[kind]) & may
    kept = F.filter(located(text, PATTERNS[kind], window), lambda m: _valid(kind, m["found"]))
    sides = ("before", "after") if window is not None else ()
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["found"].alias("found"), *[m[c].alias(c) for c in sides]))
    return F.when(may, spans.cast(out)).otherwise(F.array().cast(out))


def _entity(span: Column) -> Column:
    """The value that a span protects: digits of cards and telephones, else the lower-cased match."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["rank"] >= 2, _digits(span["found"])).otherwise(F.lower(span["found"])))


def _near(span: Column) -> Column:
    """The terms around a span: array<struct<entity, term, start, end>>."""
    make = lambda shift: lambda m: F.struct(_entity(span).alias("entity"), F.lower(m["found"]).alias("term"), (m["start"] + shift).alias("start"), (m["end"] + shift).alias("end"))
    before, after = located(span["before"], TERM), located(span["after"], TERM)
    return F.filter(F.concat(F.transform(before, make(span["start"] - F.length(span["before"]))), F.transform(after, make(span["end"]))), lambda t: ~t["term"].isin(*KINDS[:4]))


def _based(docs: DataFrame, window: int | None = None) -> DataFrame:
    """doc_id, text, text_key (a hash that tells repeated ids apart) and base (SPAN or WIDE, by start and kind)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind in KINDS[:4]:
        rows = rows.withColumn(kind, base_spans(F.col("text"), kind, window))
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    base = F.when(some, F.array_sort(F.concat(*KINDS[:4]))).otherwise(F.array().cast(rows.schema["email"].dataType))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"), base.alias("base"))


def spans_found(docs: DataFrame, window: int = 60) -> DataFrame:
    """A row per row with base spans: doc_id, text_key, entities, near (terms around entities with their places)."""
    rows = _based(docs, window).where(F.size("base") > 0)
    return rows.select("doc_id", "text_key", F.array_distinct(F.transform("base", _entity)).alias("entities"), F.flatten(F.transform("base", _near)).alias("near"))


def disclosing_terms(docs: DataFrame, found: DataFrame, disclosure: float = 0.5, shrink: float = 0.5) -> DataFrame:
    """(entity, term, bits, share): terms whose shrunk share of an entity's information reaches `disclosure`."""
    near = found.select("doc_id", "text_key", F.explode("near").alias("n")).select("doc_id", "text_key", "n.entity", "n.term").distinct()
    pairs = cut(near.groupBy("entity", "term").agg(F.count("*").alias("both")))
    entities = found.select("doc_id", "text_key", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("df_entity"))
    # a text's terms, each once; counted before they meet the wanted ones
    terms = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    df_term = terms.groupBy("term").agg(F.count("*").alias("df_term"))
    n = float(docs.count())
    bits = F.log2(F.lit(n) * F.col("both") / (F.col("df_term") * F.col("df_entity")))
    whole = F.log2(F.lit(n) / F.col("df_entity"))
    share = bits / whole * F.col("both") / (F.col("both") + F.lit(float(shrink)))
    return pairs.join(df_term, "term").join(entities, "entity").select("entity", "term", bits.alias("bits"), F.when(whole > 0, share).alias("share")).where(F.col("share") >= disclosure)


def term_spans(docs: DataFrame, window: int = 60, disclosure: float = 0.5, shrink: float = 0.5) -> DataFrame:
    """A row per row with disclosing terms: doc_id, text_key, extra (SPAN)."""
    found = cut(spans_found(docs, window))
    revealing = disclosing_terms(docs, found, disclosure, shrink).select("entity", "term")
    near = found.select("doc_id", "text_key", F.explode("near").alias("n")).select("doc_id", "text_key", "n.*")
    span = F.struct("start", F.lit(4).alias("rank"), "end", F.lit("term").alias("kind"), F.col("term").alias("found"))
    return near.join(revealing, ["entity", "term"]).groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("extra"))


def sanitised(text: Column, terms: Column) -> Column:
    """The text with valid base matches replaced by their kind and all occurrences of terms (lower case) by `[term]`."""

    def replaced(value: Column, pattern: str, label: str, chosen) -> Column:
        found, between = F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), F.split(value, pattern, -1)
        shown = F.transform(found, lambda m: F.when(chosen(m), F.lit(f"[{label}]")).otherwise(m))
        return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), shown.alias("b")), lambda p: F.array(p["a"], F.coalesce(p["b"], F.lit(""))))), "")

    def without(kind: str):
        return lambda t: F.when(t.contains(NEEDS[kind] or ""), replaced(t, PATTERNS[kind], kind, lambda m: _valid(kind, m))).otherwise(t)

    for kind in KINDS[:4]:
        text = let(text, without(kind))
    return let(text, lambda t: F.when(F.size(terms) > 0, replaced(t, TERM, "term", lambda m: F.array_contains(terms, F.lower(m)))).otherwise(t))


def find_personal_data(docs: DataFrame, window: int = 60, disclosure: float = 0.5, shrink: float = 0.5) -> DataFrame:
    """Per row: doc_id, base and all (SPAN, by start and kind), sanitised (the text without them)."""
    extra = small(cut(term_spans(docs, window, disclosure, shrink))).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "extra")
    rows = _based(docs)
    rows = rows.join(extra, rows["doc_id"].eqNullSafe(extra["__id"]) & (rows["text_key"] == extra["__key"]), "left")
    every = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("extra").cast(f"array<{SPAN}>"))))
    terms = F.coalesce(F.array_distinct(F.transform("extra", lambda s: s["found"])), F.array().cast("array<string>"))
    clean = F.when(F.size("base") > 0, sanitised(F.col("text"), terms)).otherwise(F.col("text"))
    return rows.select("doc_id", "base", every.alias("all"), clean.alias("sanitised"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("all")).alias("spans"), "sanitised")
