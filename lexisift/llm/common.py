"""What the operators of this subpackage share: batch helpers, counts of terms, joins on hot keys, connected components."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..shipping import shipped
from ..tables import once as durable, remove, shared_folder  # noqa: F401


#: Links that a task of a round of contractions starts from.
ROWS_OF_A_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text is the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``most_bytes`` of text, or one row if that alone has more."""
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


Work = Callable[[list, list[str]], pa.RecordBatch]


def map_texts(docs: DataFrame, make: Callable[[], Work], schema: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows of ``schema`` from ids and texts: ``make()`` runs once a task, its result once a slice of rows.

    ``keep``: each row comes back beside its result, as the struct ``row`` with all its columns. Id and text are read
    from that, so that a text goes to a task once; those of other types are cast and go beside it.
    """
    given = texts_of(docs, id_col, text_col)
    kinds = StructType.fromDDL(schema)
    if keep:
        wanted, types = [(id_col, "bigint"), (text_col, "string")], [(c.lower(), kind) for c, kind in docs.dtypes]
        inside = [types.index((c.lower(), kind)) for c, kind in wanted] if all((c.lower(), kind) in types for c, kind in wanted) else None
        beside = [] if inside else [F.struct(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t")]
        given = docs.select(*beside, F.struct("*").alias("row")).select(*(["t.*"] if beside else []), "row")
        kinds = kinds.add("row", given.schema["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if batch.num_rows:
                work = work or make()
                if keep and inside:
                    row = batch.column("row")
                    batch = pa.RecordBatch.from_arrays([pc.struct_field(row, inside[:1]), pc.fill_null(pc.struct_field(row, inside[1:]), ""), row], ["doc_id", "text", "row"])
                for part in slices(batch):
                    out = work(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                    if keep:
                        out = pa.RecordBatch.from_arrays([*out.columns, part.column("row")], [*out.schema.names, "row"])
                    yield out

    return shipped(given).mapInArrow(run, kinds)


def count_terms(texts: DataFrame, make: Callable[[], Callable[[str], Iterable[Iterable]]], most: int = 300_000) -> DataFrame:
    """(term, c): how often each term stands in ``texts``; added up in tasks, in tables of about ``most``, then shuffled.

    ``make()`` runs once a task; its result gives the terms of a text, as strings or UTF-8, in any number of parts.
    """

    def counted(seen: Counter) -> pa.RecordBatch:
        terms = pa.array(list(seen))
        return pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, seen = None, Counter()
        for batch in batches:
            terms = terms or make()
            for text in batch.column("text").to_pylist():
                for part in terms(text):
                    seen.update(part)
                if len(seen) > most:
                    yield counted(seen)
                    seen.clear()
        if seen:
            yield counted(seen)

    return shipped(texts).select("text").mapInArrow(run, "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``counts``, those with the greatest ``c``.

    How great it must be is read from a histogram by steps of about one in a hundred, which has a few thousand rows
    whatever the corpus; so no task sorts or sends more than its share.
    """
    step = F.floor(64 * F.log2("c")).cast("int")
    least, rows = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        rows += r["count"]
        if rows > most:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else step >= least)


def remainder(id_col: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % by


def with_values(rows: DataFrame, values: DataFrame, key: str | list[str], most: int = 1000) -> DataFrame:
    """``rows`` joined with ``values``, which has one row for each key and in ``rows`` how many of the former have it.

    Keys with more than one in ``most`` of all rows, which are fewer than ``most``, are broadcast, so that no task gets
    all rows of one; the rest is shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    total = values.agg(F.sum("rows")).first()[0] or 0
    hot = values.where(F.col("rows") * most > total)
    often = rows.join(F.broadcast(hot.drop("rows")), keys)
    seldom = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(values.where(F.col("rows") * most <= total).drop("rows"), keys)
    return often.unionByName(seldom)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of an undirected edge list.

    Alternates two contractions until nothing moves: every node's larger neighbours are hung on its least
    neighbour, then its smaller ones. Both are a pre-aggregated minimum and a join that can be split where
    a hub is hot, so no node's neighbourhood is ever held in one task. Each round is checkpointed, and ends in
    as many tasks as its rows need, as every task of every exchange leaves files. Nothing moves if each node hangs
    on one root and no root hangs on another.
    """
    pairs = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e")).select("e.*")
        told = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        n, loose = told.agg(F.sum("hangs"), F.count_if((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0)))).first()
        if not loose:
            break
        pairs = pairs.coalesce(n // ROWS_OF_A_TASK + 1)
        # large step: over all neighbours, larger ones move to the least of the neighbourhood and the node
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small step: over smaller neighbours, they and the node move to the least of them
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(low, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("m"), "u")
        pairs = durable(moved.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))
