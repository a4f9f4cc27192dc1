"""Sharding along a Hilbert curve over document metadata.

Source, language, size and id are quantised to a few bits each, the cells are
ordered by their index on a Hilbert curve, and the ordered rows are cut into
runs of equal row counts (law ``rows``: any two shards differ by one row at
most). Neighbours on the curve are neighbours in every dimension, so a shard's
ranges are narrow in all of them and a filter on any prunes whole files.

Defined results: null text has no bytes; null source, language or id are
values of their own, ordered first; equal rows stand side by side; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import bounded_join, durable, global_index, utf8

SHARDS, BITS = 16, 6
DIMENSIONS = ("source", "lang", "size", "doc_id")


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates of ``bits`` bits each.

    The coordinates are an array that is carried through one step per bit and
    axis (rotate or exchange the lower bits), then Gray-coded and interleaved.
    """
    n = len(axes)
    cell = F.array(*[a.cast("long") for a in axes])

    def put(x: Column, changes: dict[int, Column]) -> Column:
        return F.array(*[changes.get(i, F.element_at(x, i + 1)) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        low = F.pow(F.lit(2), step).cast("long")
        for axis in range(n):
            x = F.transform(F.array(x), _turn_axis(axis, low, put))[0]
        return x

    undone = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), cell, turn)

    def gray(x: Column) -> Column:
        out = [F.element_at(x, 1)]
        for i in range(1, n):
            out.append(F.element_at(x, i + 1).bitwiseXOR(out[-1]))
        flips = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            flips = flips.bitwiseXOR(F.when(out[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return F.transform(F.array(*out), lambda v: v.bitwiseXOR(flips))

    coded = F.transform(F.array(undone), gray)[0]

    def interleave(x: Column) -> Column:
        index = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(F.element_at(x, i + 1), b).bitwiseAND(F.lit(1))
                index = index.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - i))
        return index

    return F.transform(F.array(coded), interleave)[0]


def _turn_axis(axis: int, low: Column, put):
    def step(x: Column) -> Column:
        own, first, mask = F.element_at(x, axis + 1), F.element_at(x, 1), low - 1
        flipped = put(x, {0: first.bitwiseXOR(mask)})
        swap = first.bitwiseXOR(own).bitwiseAND(mask)
        swapped = put(x, {0: first.bitwiseXOR(swap), axis: own.bitwiseXOR(swap)}) if axis else x
        return F.when(own.bitwiseAND(low) != 0, flipped).otherwise(swapped)

    return step


def _ordinals(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """rows with the column's place among its distinct values, scaled to ``bits`` bits."""
    values = durable(global_index(rows.select(F.col(name).alias("_value")).distinct(), [F.col("_value").asc_nulls_first()], "_rank"))
    n = max(1, values.count())
    cells = F.floor(F.col("_rank") * F.lit(1 << bits) / F.lit(max(n, 1 << bits))).cast("int") if n > 1 << bits else F.col("_rank").cast("int")
    return bounded_join(rows, values.select("_value", cells.alias(f"_axis_{name}")), rows[name].eqNullSafe(F.col("_value"))).drop("_value")


def curve_order(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, source, lang, size, text_crc32, curve) of every row; the texts themselves stay behind."""
    raw = utf8(F.col("text"))
    rows = durable(docs.select("doc_id", "source", "lang", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, span = float(low or 0), float((high or 0) - (low or 0) + 1)
    rows = _ordinals(_ordinals(rows, "source", bits), "lang", bits)
    # Two cells per doubling of the size.
    width = F.length(F.bin("size"))
    half = F.when(width > 1, F.substring(F.bin("size"), 2, 1).cast("int")).otherwise(0)
    size_cell = F.least(F.lit((1 << bits) - 1), width * 2 + half)
    id_cell = F.least(F.lit((1 << bits) - 1), F.coalesce(F.floor((F.col("doc_id").cast("double") - low) / span * (1 << bits)).cast("int"), F.lit(0)))
    curve = hilbert_index([F.col("_axis_source"), F.col("_axis_lang"), size_cell, id_cell], bits)
    return rows.withColumn("curve", curve).drop("_axis_source", "_axis_lang")


def shard_rows(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Each row's shard and its slot there, gapless from 0 in curve order."""
    keys = [F.col("curve"), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed = durable(global_index(curve_order(docs, bits), keys, "_rank"))
    n = max(1, placed.count())
    shard = F.expr(f"(_rank * {shards}L) div {n}L")
    first = F.expr(f"(_shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("_shard", shard).withColumn("slot", F.col("_rank") - first).withColumn("shard", F.col("_shard").cast("int")).drop("_rank", "_shard")


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """The manifest for pruning: each shard's rows, bytes and ranges in every dimension."""
    ranges = [f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *ranges)


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Write every row of docs, all columns, as one directory per shard (``shard=``, with underscores added if docs has that column in any case), sorted along the curve.

    Rows are matched by id, source, language, size and checksum, nulls too; of rows that agree in all these the n-th here takes the n-th place
    there (only such rows meet in a window). A run is cut into files by Spark's own record limits.
    """
    raw, folder, taken = utf8(F.col("text")), "shard", {c.lower() for c in docs.columns}
    while folder in taken:
        folder += "_"
    key = ["_id", "_source", "_lang", "_size", "_crc"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(k) for c, k in zip([F.col("doc_id"), F.col("source"), F.col("lang"), (F.octet_length(raw) + 1).cast("long"), F.crc32(raw)], key, strict=True)])
    places = sharded.select(*[F.col(c).alias(k) for c, k in zip(["doc_id", "source", "lang", "size", "text_crc32"], key, strict=True)], "shard", "slot")
    rows, places = rows.withColumn("_nth", nth), places.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")))
    same = (rows["_nth"] == places["_nth"]) & rows["_id"].eqNullSafe(places["_id"])
    for k in key[1:]:
        same &= rows[k].eqNullSafe(places[k])
    placed = rows.join(places, same).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select("_row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
