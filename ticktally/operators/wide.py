"""Attribute-value rows into a wide table, by positional stitching.

1. Entities get *global ordinals*: cells are partitioned by entity and sorted within partitions,
   and each partition takes one contiguous range of ordinals; the partitions' entity counts (one
   number per partition) give the ranges' starts.
2. Within its range every attribute is written as one typed column vector aligned to the
   ordinals: a cell's value goes to position ``ordinal - start``.
3. The wide rows are assembled from the vectors by position, in blocks of bounded height, so
   that memory doesn't depend on the size of a partition.

There is no pivot: no group-by per entity, no expression per attribute and entity, and adding
an attribute adds one vector.

Cases: an entity whose cells are all empty still has its row; of repeated cells the first in the
given order counts, even if it is empty; null entities are left out; the attribute
list is a parameter and bounds the width; empty input gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .dedup import distinct_rows

CATALOG = 10_000  # attributes; the width of the table, one column each
KINDS = {"string": "string", "int": "bigint", "bool": "boolean", "float": "bigint", "time": "timestamp"}  # float: in thousandths
_ARROW = {"string": pa.string(), "int": pa.int64(), "bool": pa.bool_(), "float": pa.int64(), "time": pa.timestamp("us", tz="UTC")}
_SLOT = {"string": "v_text", "int": "v_num", "bool": "v_num", "float": "v_num", "time": "v_num"}


def tag_key(name: Column) -> Column:
    """Names that differ in case, surrounding blanks or the separator between words are equal."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^[\s ]+|[\s ]+$", "")), r"[\s _.\-/:]+", "_")


def _trimmed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def _normal(kind: Column, t: Column) -> Column:
    """A trimmed value in the one spelling that its kind's reader takes."""
    whole = F.when(t.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.0*)?$"), F.replace(t, F.lit(","), F.lit(""))).when(t.rlike(r"^[+-]?[0-9]+(_[0-9]+)+$"), F.replace(t, F.lit("_"), F.lit(""))).otherwise(t)
    real = F.replace(F.regexp_replace(t, r" ?%$", ""), F.lit(","), F.lit("."))
    time = F.replace(F.replace(F.upper(t), F.lit("/"), F.lit("-")), F.lit(","), F.lit("."))
    time = F.regexp_replace(F.regexp_replace(time, r" ?(Z|UTC|GMT)$", "Z"), r" ?([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    return F.when(kind == "int", whole).when(kind == "float", real).when(kind == "time", time).when(kind == "bool", F.lower(t))


_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"


def _whole(s: Column) -> Column:
    d = F.when(s.rlike(_NUMBER), s).try_cast("decimal(38,10)")
    return F.when((d == F.floor(d)) & F.abs(d).__lt__(F.lit(9.2e18)), d.try_cast("bigint"))


def _real(t: Column, s: Column) -> Column:
    """In thousandths, halves away from zero; a comma is the decimal mark, a percentage a hundredth."""
    d = F.when(s.rlike(_NUMBER), s).try_cast("decimal(38,12)")
    return F.round(d * F.when(t.endswith("%"), 10).otherwise(1000), 0).try_cast("bigint")


def _truth(s: Column) -> Column:
    return F.when(s.isin("true", "t", "yes", "y", "on", "1"), F.lit(1)).when(s.isin("false", "f", "no", "n", "off", "0"), F.lit(0)).cast("bigint")


def _instant(t: Column, s: Column) -> Column:
    """Microseconds since 1970 in UTC; seconds or milliseconds since 1970, or date and time with or without zone."""
    number = t.rlike(r"^[+-]?[0-9]{9,13}(\.[0-9]+)?$")
    digits = F.length(F.regexp_extract(t, r"^[+-]?([0-9]+)", 1))
    epoch = t.try_cast("decimal(30,6)") * F.when(digits >= 12, 1000).otherwise(1000000)
    dated = s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$")
    zoned = s.rlike(r":[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    at = F.unix_micros(F.when(zoned, s).otherwise(F.concat(s, F.lit("Z"))).try_cast("timestamp"))
    return F.when(number, F.floor(epoch).try_cast("bigint")).when(dated, at)


def with_values(df: DataFrame, kind: str, text: str) -> DataFrame:
    """Add ``v_text`` and ``v_num``: the value read as its kind; both null if it can't be read.

    In three projections, as each step is used more than once by the next and should be worked out once.
    """
    k, t, s = F.col(kind), F.col("__t"), F.col("__s")
    df = df.withColumn("__t", F.when(k != "string", _trimmed(F.col(text))))
    df = df.withColumn("__s", _normal(k, t))
    number = F.when(k == "int", _whole(s)).when(k == "float", _real(t, s)).when(k == "bool", _truth(s)).when(k == "time", _instant(t, s))
    return df.withColumns({"v_text": F.when(k == "string", F.col(text)), "v_num": number}).drop("__t", "__s")


def resolved_tags(tags: DataFrame, dictionaries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request_id, attr, tag_no, text, v_text, v_num) of the tags, and rows with attr null, so that no request is lost.

    Rows are combined before they meet their dictionary; the catalogue is small and fixed
    (its size is checked before it is broadcast).
    """
    if catalog.count() > CATALOG:
        raise ValueError(f"the catalogue has more than {CATALOG} attributes")
    t = tags.where(F.col("request_id").isNotNull()).groupBy("request_id", "tag_name", "tag_value").agg(F.min("tag_no").alias("tag_no"))
    d = distinct_rows(dictionaries.where(F.col("request_id").isNotNull()), ["request_id", "dictionary"])
    word = lambda off: F.when(F.col(off) >= 0, F.get("dictionary", F.col(off).cast("int")))
    at = t.join(d, "request_id", "left").select("request_id", "tag_no", word("tag_name").alias("name"), word("tag_value").alias("text"))
    c = catalog.select(F.col("tag").alias("attr"), F.col("value_type").alias("kind"), tag_key(F.col("tag")).alias("tag_id"))
    at = at.withColumn("tag_id", F.when(F.col("text").isNotNull(), tag_key(F.col("name"))))
    at = at.join(F.broadcast(c), "tag_id", "left")
    at = with_values(at.select("request_id", "attr", "tag_no", "text", "kind"), "kind", "text")  # without an attribute there is no kind
    return at.drop("kind")


def stitch(cells: DataFrame, entity: str, attributes: Sequence[tuple[str, str]], order: Sequence[str] = (), block: int = 65536) -> DataFrame:
    """Wide table (ordinal, entity, one typed column per attribute) of cells (entity, attr, v_text, v_num)
    and the columns of ``order``, by which the first of repeated cells is found."""
    cells = cells.where(F.col(entity).isNotNull()).select(F.col(entity).cast("bigint").alias(entity), "attr", "v_text", "v_num", *order)
    placed = cut(cells.repartition(entity).sortWithinPartitions(entity, "attr", *order).drop(*order))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last = 0, None  # entities of a sorted partition: the changes
        for b in batches:
            ids = b.column(0).to_numpy()
            if len(ids):
                n += int((ids[1:] != ids[:-1]).sum()) + (last is None or ids[0] != last)
                last = ids[-1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["p", "n"])

    counts = dict(placed.select(entity).mapInArrow(count, "p int, n bigint").collect())  # one number per partition
    starts, at = {}, 0
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    index = {a: i for i, (a, _) in enumerate(attributes)}
    schema = pa.schema([("ordinal", pa.int64()), (entity, pa.int64()), *[(a, _ARROW[k]) for a, k in attributes]])
    ddl = f"ordinal bigint, `{entity}` bigint, " + ", ".join(f"`{a}` {KINDS[k]}" for a, k in attributes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = starts.get(TaskContext.get().partitionId(), 0)
        carry: pa.Table | None = None

        def write(t: pa.Table) -> pa.RecordBatch:
            nonlocal base
            ids = t.column(0).to_numpy()
            new = np.empty(len(ids), bool)
            new[0], new[1:] = True, ids[1:] != ids[:-1]
            position = np.cumsum(new) - 1  # ordinal - base
            n = int(position[-1]) + 1
            named = t.column(1).combine_chunks().dictionary_encode()
            code = np.array([index.get(a, -1) for a in named.dictionary.to_pylist()] + [-1])
            attr = code[np.asarray(named.indices.fill_null(len(code) - 1))]
            once = new.copy()
            once[1:] |= attr[1:] != attr[:-1]  # the first row of each cell
            texts, numbers = t.column(2), t.column(3)
            cols = [pa.array(np.arange(base, base + n)), pa.array(ids[new])]
            for i, (_, kind) in enumerate(attributes):
                rows = np.flatnonzero((attr == i) & once)
                source = (texts if _SLOT[kind] == "v_text" else numbers).take(pa.array(rows)).combine_chunks()
                vector = np.full(n, -1, np.int64)
                vector[position[rows]] = np.arange(len(rows))
                aligned = source.take(pa.array(vector, mask=vector < 0))
                cols.append(aligned.cast(_ARROW[kind]))
            base += n
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            carry = t if carry is None else pa.concat_tables([carry, t])
            if carry.num_rows >= block:  # the last entity may go on in the next batch
                ids = carry.column(0).to_numpy()
                cutoff = int(np.searchsorted(ids, ids[-1]))
                if cutoff:
                    yield write(carry.slice(0, cutoff))
                    carry = carry.slice(cutoff)
        if carry is not None and carry.num_rows:
            yield write(carry)

    return placed.mapInArrow(run, ddl)


def filled_cells(wide: DataFrame, entity: str, attributes: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per filled cell: (entity, tag, cell)."""
    show = {"string": lambda c: c, "int": lambda c: c.cast("string"), "bool": lambda c: c.cast("string"), "float": lambda c: c.cast("string"), "time": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    pairs = F.array(*[F.struct(F.lit(a).alias("tag"), show[k](F.col(a)).alias("cell")) for a, k in attributes])
    return wide.select(entity, F.explode(pairs).alias("x")).where(F.col("x.cell").isNotNull()).select(entity, "x.tag", "x.cell")
