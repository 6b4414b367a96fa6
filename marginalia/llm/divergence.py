"""How the words of sources differ, by DuckDB over shards of (lang, term).

1. Each task counts the terms of its documents in DuckDB: (lang, source, term, occurrences, documents), added up
   whenever what it holds exceeds HELD rows, so that a common word or a large source leaves each task as one row.
2. These counts are dealt by a hash of lang and term, and sorted by them. DuckDB adds up a shard's counts a slice of
   whole terms at a time, drops the terms of too few documents and returns a row for each kept term with the counts
   of all of its sources.
3. Spark adds up the kept occurrences of every group (lang, source) and the kept terms of every lang.
4. With these totals, DuckDB takes a shard's kept terms a slice at a time: the share of every term in every group,
   sums over the slice of the differences of each pair of sources, and the first terms of each group.
5. Spark adds up the pairs' sums and ranks.

All arithmetic is in integers (128 bits where a product needs them), so the results don't depend on the shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import checkpoint, free_name, shared_folder

#: Fixed values of the audit: documents that a kept term is in, what is added to each count, the unit of shares, ranks.
LEAST_DOCUMENTS, PRIOR, UNIT, RANKS = 30, 5, 1_000_000_000, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[a-z\x{80}-\x{10FFFF}]+"
#: Bytes of text that a task's SQL reads at once, and rows of counts that it holds.
CHARS, HELD = 2_000_000, 600_000
#: Counts of a shard, and shares (terms times sources), that a task's SQL reads at once.
SLICE, CELLS = 60_000, 500_000
#: Groups (lang, source) whose totals are sent to the tasks at once; more langs are taken in turns.
GROUPS = 1_000_000
#: Parts that a group's first terms are found in before they are put together.
MERGED = 16
COUNTS = "lang string, source string, term string, n long, docs long"


def _database() -> duckdb.DuckDBPyConnection:
    """One thread, bounded memory and nothing on the disk of the machine."""
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    con.execute("SET temp_directory = ''")
    con.execute("SET preserve_insertion_order = false")
    con.execute("SET allocator_flush_threshold = '8MB'")
    return con


def _asked(con: duckdb.DuckDBPyConnection, sql: str, **tables: pa.Table) -> pa.Table:
    for name, t in tables.items():
        con.register(name, t)
    out = con.sql(sql).to_arrow_table() if sql.lstrip()[:6] == "SELECT" else con.execute(sql)
    for name in tables:
        con.unregister(name)
    return out


def _batches(t: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from t.cast(schema).to_batches(max_chunksize=16_384)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
#: Terms of a document are counted first, so that each tells one document.
_COUNT_SQL = f"""
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM (
  SELECT row, term, count(*) AS n
  FROM (SELECT row, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM docs) GROUP BY row, term
) JOIN docs USING (row) GROUP BY lang, source, term
"""
_ADD_SQL = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY lang, source, term"


def _added(con: duckdb.DuckDBPyConnection, parts: Iterator[pa.Table], held: int) -> Iterator[pa.Table]:
    """Counts added up; whenever adding leaves over ``held`` rows they are handed on."""
    have: list[pa.Table] = []
    least = held // 2
    for part in parts:
        have.append(part)
        if sum(t.num_rows for t in have) > 2 * least:
            whole = _asked(con, _ADD_SQL, counts=pa.concat_tables(have))
            least = max(held // 2, whole.num_rows)
            have = [whole]
            if whole.num_rows > held:
                yield whole
                have, least = [], held // 2
    if have:
        yield _asked(con, _ADD_SQL, counts=pa.concat_tables(have))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) to counts."""
    con = _database()

    def parts() -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        size = 0

        def told() -> pa.Table:
            t = pa.Table.from_batches(held)
            return _asked(con, _COUNT_SQL, docs=t.append_column("row", pa.array(range(t.num_rows)))).cast(_COUNTS)

        for whole in batches:
            for k in range(whole.num_rows):  # a batch of long texts is cut between rows
                b = whole.slice(k, 1)
                held.append(b)
                size += len(b.column("text")[0].as_buffer() or b"")
                if size > CHARS or len(held) >= 8192:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    for t in _added(con, parts(), HELD):
        yield from _batches(t, _COUNTS)


_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("ns", pa.list_(pa.int64()))])


def _whole_terms(con: duckdb.DuckDBPyConnection, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of lang and term, some SLICE at a time, cut between terms."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < SLICE:
            continue
        whole = pa.concat_tables(held)
        last = [pc.equal(whole.column(c), whole.column(c)[-1]) for c in ("lang", "term")]
        at = whole.num_rows - pc.sum(pc.and_(*last)).as_py()
        if at:
            yield whole.slice(0, at)
            held = [whole.slice(at)]
        else:  # one term fills the slice: what is known of it is added up
            held = [_asked(con, _ADD_SQL, counts=whole).cast(_COUNTS)]
    if held:
        yield pa.concat_tables(held)


def _keep(least: int):
    """A shard's counts, in order, to one row for each term of ``least`` documents, with the counts of its sources."""
    added = f"SELECT lang, term, list(source) AS sources, list(n) AS ns FROM ({_ADD_SQL}) GROUP BY lang, term HAVING sum(docs) >= {int(least)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        for t in _whole_terms(con, batches):
            yield from _batches(_asked(con, added, counts=t), _KEPT)

    return run


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compare(groups: pa.Table, prior: int, unit: int, ranks: int):
    """Kept terms to the sums of their differences, by pair of sources (the lesser first), and each group's first terms.

    groups: (lang, source, total, terms, lang_total) of every group of the langs at hand.
    """
    share = lambda n, total: f"CAST(1 + (CAST({unit} AS HUGEINT) * ({n} + {prior})) // (CAST({total} AS HUGEINT) + {prior} * terms) AS BIGINT)"
    grid = f"""
      CREATE OR REPLACE TEMP TABLE p AS
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "total")} AS p, {share("k.n", "lang_total")} AS q
      FROM (SELECT lang, term, CAST(list_sum(ns) AS BIGINT) AS n FROM kept) k JOIN groups g USING (lang)
      LEFT JOIN (SELECT lang, term, unnest(sources) AS source, unnest(ns) AS n FROM kept) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    """
    pairs = "SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY ALL"
    terms = f"SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {ranks}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _database()
        con.register("sent", groups)
        con.execute("CREATE TABLE groups AS SELECT * FROM sent")
        most = con.execute("SELECT coalesce(max(n), 1) FROM (SELECT count(*) AS n FROM groups GROUP BY lang)").fetchone()[0]
        rows = max(1, CELLS // most)
        con.execute("CREATE TABLE found (lang VARCHAR, source VARCHAR, part VARCHAR, item VARCHAR, value BIGINT)")

        def put_together() -> None:
            con.execute(
                "CREATE OR REPLACE TABLE found AS SELECT lang, source, part, item, CAST(sum(value) AS BIGINT) AS value FROM found WHERE part = 'pair' GROUP BY ALL "
                f"UNION ALL SELECT * FROM found WHERE part = 'term' QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {ranks}"
            )

        added = 0
        for whole in batches:
            for s in range(0, whole.num_rows, rows):
                _asked(con, grid, kept=pa.Table.from_batches([whole.slice(s, rows)]))
                con.execute(f"INSERT INTO found {pairs}")
                con.execute(f"INSERT INTO found {terms}")
                added += 1
                if added % 8 == 0:
                    put_together()
        put_together()
        yield from _batches(con.sql("SELECT * FROM found").to_arrow_table(), _FOUND)

    return run


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS, prior: int = PRIOR, unit: int = UNIT, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) that occurs.

    Part "pair": each other source of the lang, with the sum over the lang's kept terms of the difference of their
    shares, all ranks. Part "term": terms that the group holds and uses more than its lang does, by the difference,
    up to ``ranks``. Rank 1 has the greatest value, ties go by the item in UTF-8.

    A null text, lang or source is an empty one. Rows are documents of their own, also where they are equal. A
    lang without kept terms has pairs of value 0; a lang of one source has no pairs, and an empty table gives no
    rows. Texts of any length are counted whole; other columns are not read.
    """
    spark = docs.sparkSession
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    folder = f"{shared_folder(spark)}/divergence-{uuid.uuid4().hex}"
    counts = plain.mapInArrow(_count, COUNTS).repartition("lang", "term").sortWithinPartitions("lang", "term")
    counts.mapInArrow(_keep(least_documents), "lang string, term string, sources array<string>, ns array<long>").write.parquet(folder)
    kept = spark.read.schema("lang string, term string, sources array<string>, ns array<long>").parquet(folder)
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "ns")).alias("e")).select("lang", F.col("e.sources").alias("source"), F.col("e.ns").alias("n"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n)).alias("lang_total"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = checkpoint(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")]))
    found = None
    for turn in _turns(groups):
        own = groups if turn is None else groups.where(F.col("lang").isin(turn))
        rows = kept if turn is None else kept.where(F.col("lang").isin(turn))
        part = rows.mapInArrow(_compare(own.toArrow(), prior, unit, ranks), "lang string, source string, part string, item string, value long")
        found = part if found is None else found.union(part)
    other = groups.select("lang", F.col("source").alias("item"))
    found = checkpoint(found)
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # the pairs of a lang are its result; those without a kept term differ by nothing
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item")
    low, high = F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")
    a, b = (free_name(["lang"], n) for n in ("a", "b"))
    pairs = pairs.select("lang", F.col("source").alias(a), F.col("item").alias(b), low, high).join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", F.col(a).alias("source"), F.lit("pair").alias("part"), F.col(b).alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    # a group's first terms by shards of the terms, then of what is left, which is MERGED times ``ranks`` at most
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)
    terms = found.where("part = 'term'").withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(MERGED)))
    terms = first(first(terms, "lang", "source", "shard").drop("shard", "rank"), "lang", "source")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.union(terms.select(ranked.columns))


def _turns(groups: DataFrame) -> list[list[str] | None]:
    """All groups at once (None), or lists of langs with GROUPS groups or so."""
    if groups.count() <= GROUPS:
        return [None]
    turns: list[list[str]] = []
    held = GROUPS
    for row in groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        if held + row["n"] > GROUPS:
            turns.append([])
            held = 0
        turns[-1].append(row["lang"])
        held += row["n"]
    return turns
