"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

A line is its words (split at single spaces, the line trimmed); the edit bound is one word inserted,
deleted or replaced. Every line emits its own hash and that of each variant with one word left out
(a sum of position hashes, so all variants of a line cost one window pass). Two lines are within the
bound exactly if they share a variant at the same place, or one's variant is the other whole; equal
keys are met by aggregation, not by pairing, so a group of any size gives one row for each member.
The earlier line of each hit is fetched and the edit distance verified on the words.

Lines without a partner cannot be removed, so the variants are only made for lines that share the
first or the last half of their words with a line of a fitting length: one edit leaves one half whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import checkpoint, free_name

LEAST_WORDS = 5
#: Lines that a broadcast tells of at most: those that make up over one of so many parts of all lines.
HOT_LINES = 100_000
#: Bits of the filter that is broadcast (8 MB), whatever the input.
FILTER_BITS = 1 << 26


def _place(doc_id: Column, line: Column) -> Column:
    """Order of lines in the corpus as one number: doc_id, then line; rows without doc_id come last."""
    return (F.coalesce(doc_id, F.lit(2**63 - 1)).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + line.cast("decimal(11,0)")).cast("decimal(38,0)")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, own, at, line): the trimmed lines that have a word, with their place in the text; own: hash of the text."""
    parts = docs.select("doc_id", F.xxhash64("text").alias("own"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return parts.select("doc_id", "own", "at", F.trim("line").alias("line")).where("line <> ''")


def _keys(line: Column) -> tuple[Column, Column]:
    """128 bits for a line's text, as two longs."""
    return F.xxhash64(line).alias("k"), F.xxhash64(F.lit(1), line).alias("k2")


def _halves(words: Column) -> Column:
    """Keys by which a line meets all lines within one edit: half of the words of the longer line of a
    pair, at either end."""
    n = F.size(words)
    out = []
    for half in (F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")):
        out += [F.xxhash64(F.lit(0), half, F.slice(words, 1, half)), F.xxhash64(F.lit(1), half, F.slice(words, n - half + 1, half))]
    return F.array_distinct(F.array(*out))


def _passing(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The lines whose key may be among the chosen ones: a bitmap of FILTER_BITS bits, broadcast.

    The bitmap has the same size for any input; where it fills up it lets more lines pass, and the
    join after it still decides.
    """
    bit = lambda k: F.pmod(k, F.lit(FILTER_BITS))
    maps = chosen.select(bit(F.col("k")).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_bucket"))
    maps = checkpoint(maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bits")))
    place = F.bitmap_bit_position(bit(F.col("k")))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = lines.join(F.broadcast(maps), F.bitmap_bucket_number(bit(F.col("k"))) == F.col("_bucket"))
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_bucket", "_bits")


def earlier_neighbours(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(k, k2, first, hot): for each line text (k and k2: its keys) that has an earlier occurrence of itself or of a
    line within one word, the place of the earliest such line; hot: whether it is one of at most HOT_LINES lines
    that are very common. docs: (doc_id, text)."""
    lines = _lines(docs)
    own = lines.select(*_keys(F.col("line")), _place(F.col("doc_id"), F.col("at")).alias("place"), F.split("line", " ").alias("words"))
    own = own.select("k", "k2", "place", F.when(F.size("words") >= least_words, _halves(F.col("words"))).alias("halves"))
    own = own.select("k", "k2", "place", *[F.get("halves", F.lit(i)).alias(f"h{i}") for i in range(4)])
    texts = own.groupBy("k", "k2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), *[F.first(f"h{i}").alias(f"h{i}") for i in range(4)]).persist()
    # lines that share half of their words with another text
    halves = texts.where("h0 is not null").select("k", F.explode(F.array(*[f"h{i}" for i in range(4)])).alias("half")).where("half is not null")
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("half")
    chosen = checkpoint(halves.join(shared, "half", "left_semi").select("k").distinct().join(texts.select("k", "k2", "place"), "k"))
    written = _passing(lines.select(*_keys(F.col("line")), "line"), chosen).groupBy("k", "k2").agg(F.first("line").alias("line"))
    # ids in the order of places stand for these in what follows
    candidates = checkpoint(written.join(chosen, ["k", "k2"]).orderBy("place").withColumn("id", F.monotonically_increasing_id()))
    word = candidates.select("id", F.posexplode(F.split("line", " ")).alias("i", "w"))
    word = word.select("id", "i", F.xxhash64("w", "i").alias("z"), F.xxhash64("w", F.col("i") - 1).alias("y"))
    upto = W.partitionBy("id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("id")
    variant = F.bit_xor("z").over(upto).bitwiseXOR(F.col("z")).bitwiseXOR(F.bit_xor("y").over(whole)).bitwiseXOR(F.bit_xor("y").over(upto))
    rows = word.select("id", "i", variant.alias("v"), F.bit_xor("z").over(whole).alias("f"))
    pick = lambda slot, key: F.struct(slot.alias("slot"), key.alias("key"))
    one = F.array(pick(F.col("i"), F.col("v")))
    keys = rows.select("id", F.explode(F.when(F.col("i") == 0, F.concat(one, F.array(pick(F.lit(-1), F.col("f"))))).otherwise(one)).alias("e"))
    keys = keys.select("id", "e.slot", "e.key").persist()
    by_slot = keys.groupBy("key", "slot").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    by_key = by_slot.groupBy("key").agg(F.min(F.when(F.col("slot") < 0, F.col("m"))).alias("mf"), F.min(F.when(F.col("slot") >= 0, F.col("m"))).alias("mv"), F.sum("n").alias("n")).where("n > 1").drop("n")
    best = by_slot.join(by_key, "key").select("key", "slot", F.least("m", F.when(F.col("slot") < 0, F.col("mv")).otherwise(F.col("mf"))).alias("best"))
    hits = keys.join(best, ["key", "slot"]).where("best < id").groupBy("id").agg(F.min("best").alias("best"))
    left = hits.join(candidates.select("id", "k", "k2", "place", "line"), "id")
    right = candidates.select(F.col("id").alias("best"), F.col("line").alias("other"), F.col("place").alias("before"))
    near = left.join(right, "best").where(F.col("before") < F.col("place"))
    near = near.where(_within_one(F.split("line", " "), F.split("other", " "))).select("k", "k2", "before")
    total = texts.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = (F.col("copies") > total / HOT_LINES) & (F.col("copies") > 1)
    out = checkpoint(texts.join(near, ["k", "k2"], "left").where("copies > 1 or before is not null").select("k", "k2", F.least("place", "before").alias("first"), hot.alias("hot")))
    keys.unpersist()
    texts.unpersist()
    return out


def _within_one(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays is at most one: what one edit leaves on both sides of it is equal."""
    n, m = F.size(a), F.size(b)
    pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    ahead = F.coalesce(F.nullif(F.array_position(pairs, False), F.lit(0)) - 1, F.least(n, m).cast("long")).cast("int")
    rest = lambda x, size, skip: F.slice(x, ahead + skip + 1, F.greatest(size - ahead - skip, F.lit(0)))
    return (
        F.when(n == m, rest(a, n, 1) == rest(b, m, 1))
        .when(n == m + 1, rest(a, n, 1) == rest(b, m, 0))
        .when(n + 1 == m, rest(a, n, 0) == rest(b, m, 1))
        .otherwise(False)
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """The rows of docs with ``text`` freed of each line that repeats an earlier one, and the columns
    n_lines and n_removed.

    A line goes if a line before it (by doc_id, then place) has the same words or, where both have
    ``least_words`` words, differs by one word. Blank lines stay. A null text stays null, with no
    lines; an empty text stays empty. Rows that share a doc_id count as one place: the same line at
    the same place in both stays in both. Rows without a doc_id come after all others and count as one
    place as well. A text may become empty; its row stays. Other columns are kept, whatever their names,
    but those that have the names of n_lines and n_removed are replaced; an empty table gives none.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = earlier_neighbours(base, least_words)
    hot = F.broadcast(first.where("hot").select("k", "k2", F.col("first").alias("first_hot")))  # HOT_LINES rows at most
    cold = first.where("not hot").select(F.col("k").alias("dealt"), "k2", "first")
    seen = _passing(_lines(base).select("doc_id", "own", "at", *_keys(F.col("line"))), first)
    seen = seen.join(hot, ["k", "k2"], "left")
    # very common lines need no other row: they are dealt by their places
    seen = seen.withColumn("dealt", F.when(F.col("first_hot").isNull(), F.col("k")).otherwise(F.xxhash64("doc_id", "own", "at")))
    met = seen.select("dealt", "k2", "doc_id", "own", "at", "first_hot").join(cold, ["dealt", "k2"], "left")
    gone = met.where(_place(F.col("doc_id"), F.col("at")) > F.coalesce("first_hot", "first"))
    d, own, at, new = (free_name([*docs.columns, n_lines, n_removed], x) for x in ("d", "own", "at", "new"))
    gone = gone.groupBy(F.col("doc_id").alias(d), F.col("own").alias(own)).agg(F.array_sort(F.collect_set("at")).alias(at))
    body = F.col(f"`{text}`")
    joined = docs.join(gone, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(body) == F.col(own)), "left")
    # a letter for each line up to the last that goes: as bytes, so that a line's letter is found at once
    mask = F.array_join(F.transform(at, lambda x, i: F.concat(F.repeat(F.lit("-"), x - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1), F.lit("x"))), "").cast("binary")
    joined = joined.withColumn(at, mask)
    parts = F.split(body, "\n")
    kept = F.filter(parts, lambda _, i: F.substring(F.col(at), i + 1, F.lit(1)) != F.lit(b"x"))
    lines = F.when(body.isNull(), 0).otherwise(F.size(parts))
    after = F.when(F.col(at).isNull(), lines).otherwise(F.size(kept))
    joined = joined.withColumn(new, F.struct(F.when(F.col(at).isNull(), body).otherwise(F.array_join(kept, "\n")).alias("text"), lines.cast("long").alias("n"), (lines - after).cast("long").alias("gone")))
    columns = [F.col(new)["text"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in (n_lines.lower(), n_removed.lower())]
    return joined.select(*columns, F.col(new)["n"].alias(n_lines), F.col(new)["gone"].alias(n_removed))
