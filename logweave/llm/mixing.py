"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weighted share of ``total`` times all sizes, but at most ``most`` times its own size; what is above
goes to the other sources by weight, until none is above. A target takes as many complete epochs of its source as it
holds, each document once an epoch. The rest is drawn without replacement: every document has the key -ln(u) / w, with ``u`` uniform from a
hash of the document and ``w`` its quality weight, and documents are taken in order of their keys until their sizes fill the rest.
The last one is cut, so that the words taken are the target's words, rounded.

Scale: texts are read once and narrow rows stored. They are range-sorted by (source, key, row), so a source with
most of the rows is many partitions. Sizes are summed up as each partition streams; the first place of a partition comes from the
table of partition sums, one row per partition, and that of a source from the table of sources. So prefix sums need no group of a whole source.
The share-out is an aggregate over the stored table of sources, repeated until no further source is above its limit.

Cases: a null text has size 0; documents without words are never taken; null is a source of its own, the last one; a null, negative or
not finite weight counts as ``LEAST_WEIGHT``; repeated rows are documents of their own with equal keys, of which the first rows are
taken first; no words at all give targets of 0; an empty table gives an empty result. Only id, text and source are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from logweave.llm import common
from logweave.operators.joins import join_groups
from logweave.operators.numbering import with_number
from logweave.session import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
LEAST_WEIGHT = 1e-6
WORD = r"[^\x20\x09-\x0D]+"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def letter_share(text: Column) -> Column:
    """A plain quality weight: the share of letters a-z among the characters, both counted with one more."""
    text = common.text_or_empty(text)
    others = F.length(F.translate(text, _LETTERS, ""))
    return (F.length(text) - others + 1).cast("double") / (F.length(text) + 1)


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from a hash of the document: 52 bits of its MD5."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), common.text_or_empty(text))
    return (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def documents(docs: DataFrame, weight: Column | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Stored rows (doc_id, unknown, source, size, key, row) of all documents."""
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    weight = letter_share(text) if weight is None else weight.cast("double")
    usable = (weight > 0) & (weight < float("inf"))
    weight = F.when(usable, F.greatest(weight, F.lit(LEAST_WEIGHT))).otherwise(LEAST_WEIGHT)
    source = F.col(f"`{source_col}`").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return common.store(docs.select(
        doc_id.alias("doc_id"), source.isNull().alias("unknown"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size"),
        (-F.log(uniform(doc_id, text)) / weight).alias("key"), F.monotonically_increasing_id().alias("row")), "sized")


def share_out(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Stored table of sources: unknown, source, place, docs, source_size, before (the sizes of earlier sources) and target."""
    sizes = rows.groupBy("unknown", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    placed = with_number(sizes, ["unknown", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = store(placed.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")), "sources")
    everything = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, above = 0.0, -1
    while True:  # sources whose share at this level is above their limit get the limit; the others share what is left
        is_above = F.col("limit") <= level * F.col("weight") if above >= 0 else F.lit(False)
        n, capped, rest = sources.agg(
            F.count_if(is_above), F.coalesce(F.sum(F.when(is_above, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_above, F.col("weight"))), F.lit(0.0))).first()
        if n == above or rest == 0:
            break
        above, level = n, (total * everything - capped) / rest
    return sources.select("unknown", "source", "place", "docs", "source_size", F.least("limit", level * F.col("weight")).alias("target"))


def _run_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to each row the sizes of the rows before it in its partition."""
    total = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        upto = total + np.cumsum(size)
        total = int(upto[-1]) if len(upto) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - size, pa.int64())], names=[*batch.schema.names, "ahead"])


def with_prefix_sums(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``ahead``: the sum of ``size`` over all rows before, in the total order given."""
    lined_up = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lined_up.schema) + ", ahead long"
    summed = store(lined_up.mapInArrow(_run_up, schema), "run-up")
    # One row per partition of the range shuffle: this array is as long as the shuffle has partitions.
    sums = common.to_numpy(summed.groupBy("piece").agg(F.max(F.col("ahead") + F.col("size")).alias("n")))
    by_piece = np.zeros(int(sums["piece"].max(initial=-1)) + 2, np.int64)
    by_piece[sums["piece"] + 1] = sums["n"]
    starts = [(i, int(n)) for i, n in enumerate(np.cumsum(by_piece))]
    table = rows.sparkSession.createDataFrame(starts, "piece int, start long")
    return summed.join(F.broadcast(table), "piece").withColumn("ahead", F.col("ahead") + F.col("start")).drop("piece", "start")


def mix(
    docs: DataFrame, *, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (complete ones) and taken: the words that the mix takes of each document."""
    rows = documents(docs, weight, id_col, text_col, source_col)
    sources = share_out(rows, weights, total, most)
    summed = with_prefix_sums(rows, ["unknown", "source", "key", "size", "row"])
    firsts = summed.groupBy("unknown", "source").agg(F.min("ahead").alias("first"))
    known = store(sources.join(firsts, ["unknown", "source"]), "known-sources")
    placed = join_groups(summed, known.drop("place"), ["unknown", "source"], weight="docs")
    wanted = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    rest = wanted - epochs * F.col("source_size") - (F.col("ahead") - F.col("first"))
    part = F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select("doc_id", F.when(~F.col("unknown"), F.col("source")).alias("source"), "size", "source_size", "target",
                         epochs.alias("epochs"), (epochs * F.col("size") + part).alias("taken"))
