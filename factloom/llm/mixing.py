"""Mixing sources to target weights by Pareto order sampling.

Each source is due a whole number of copies; each document of it expects ``due * measure / total measure`` of them. The whole part of
that is allocated for certain. The fractions ``p`` are inclusion probabilities of a fixed-size sample without replacement: documents are
ranked by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and the least ones get one copy more, exactly as many as
the source is still due (Rosén's Pareto sampling). ``u`` comes from the MD5 digest of ``doc_id``, so a document is drawn alike wherever it lies.

No source is sorted in one task: documents are counted by source and by the leading digits of their rank, running sums over these counts
decide whole cells, and only the one cell per source in which the sample ends is sorted.

Sums are of whole numbers, so results don't depend on the order of rows. A null source is a source; a null measure counts as 0, one below 0 too.
A source whose measures are all 0 gives nothing. Null ``doc_id`` is drawn as such; repeated rows are drawn as one: ties of rank go by ``doc_id``, and of
equal rows as many are taken as are due. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import small, written

#: Sources' weights are in proportion to documents ** TEMPERATURE unless weights are given: small sources are raised, hot ones lowered.
TEMPERATURE = 0.5
#: Copies in all, as a share of the documents.
SHARE = 1.0
_CELLS = 4096


def uniform(doc_id: str = "doc_id") -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 digest of ``doc_id``."""
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


def measure() -> Column:
    """What a document's chance goes by: the root of its length, so that long texts count, but not in proportion."""
    return F.ceil(F.sqrt(F.col("n_chars").cast("double"))).cast("long")


def due(docs: DataFrame, weights: dict[str | None, int] | None = None, share: float = SHARE) -> DataFrame:
    """``(mix_source, due, total)`` of each source: whole copies it is due, ``share`` of all documents together, and its measures' sum.

    ``weights``: whole numbers by source; others get nothing. By default, a thousand times the root of the source's documents.
    """
    spark = docs.sparkSession
    sums = docs.groupBy("mix_source").agg(F.count("*").alias("documents"), F.sum("mix_measure").alias("total"))
    if weights is None:
        weighted = sums.withColumn("weight", F.floor(F.lit(1000) * F.pow(F.col("documents").cast("double"), F.lit(TEMPERATURE))))
    else:
        given = spark.createDataFrame([(k, int(v)) for k, v in weights.items()], "of string, weight long")
        weighted = sums.join(F.broadcast(given), sums["mix_source"].eqNullSafe(given["of"]), "left").drop("of").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    # sources are few: this window runs over one row of each
    order = Window.orderBy(F.col("mix_source").asc_nulls_first())
    everything = Window.partitionBy(F.lit(1))
    running = weighted.withColumn("upto", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("weight").over(everything)).withColumn("copies", F.floor(F.sum("documents").over(everything) * F.lit(share)).cast("long"))
    cut = running.withColumn("end", F.when(F.col("all") > 0, F.expr("(copies * upto) div all")).otherwise(F.lit(0).cast("long")))
    return cut.withColumn("due", F.col("end") - F.coalesce(F.lag("end").over(order), F.lit(0).cast("long"))).select("mix_source", "due", "total").where("total > 0 and due > 0")


def _measured(docs: DataFrame) -> list[Column]:
    """``doc_id``, ``mix_source`` and ``mix_measure`` of a document."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("mix_source"), F.greatest(F.coalesce(measure(), F.lit(0)), F.lit(0)).cast("long").alias("mix_measure")]


def _ranked(base: DataFrame, sources: DataFrame) -> DataFrame:
    """``base`` with ``(certain, odds, cell, due)`` of each document of a source that is due some."""
    joined = base.join(small(sources), F.col("mix_source").eqNullSafe(F.col("due_source")))
    expected = joined.withColumn("expected", F.col("due").cast("double") * F.col("mix_measure").cast("double") / F.col("total").cast("double"))
    parted = expected.withColumn("certain", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("certain").cast("double")).withColumn("u", uniform())
    odds = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * (1 - F.col("p")) / F.col("p")).otherwise(F.lit(float("inf")))
    # atan keeps order and is bounded: cells of about equal width in rank
    ranked = parted.withColumn("odds", odds).withColumn("cell", F.floor(F.atan("odds") * (_CELLS / 1.5707963267948968)).cast("int"))
    return ranked.drop("mix_measure", "due_source", "total", "expected", "p", "u")


def _bounds(ranked: DataFrame) -> DataFrame:
    """``(cell_source, of_cell, room, n)``: documents of each cell, and how many of it and of later ones are still to be drawn."""
    cells = ranked.groupBy("mix_source", "cell").agg(F.count("*").alias("n"), F.sum("certain").alias("sure"), F.max("due").alias("due"))
    by_source = Window.partitionBy("mix_source")
    upto = F.sum("n").over(by_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("due") - F.sum("sure").over(by_source)
    return written(cells.withColumn("left", left).withColumn("before", upto - F.col("n")).select(F.col("mix_source").alias("cell_source"), F.col("cell").alias("of_cell"), (F.col("left") - F.col("before")).alias("room"), "n"))


def _placed(ranked: DataFrame, bounds: DataFrame) -> DataFrame:
    return ranked.join(small(bounds), F.col("mix_source").eqNullSafe(F.col("cell_source")) & (F.col("cell") == F.col("of_cell")))


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, share: float = SHARE) -> DataFrame:
    """``(doc_id, source, certain, drawn, copies)`` of each document that gets a copy: whole copies, 0 or 1 drawn, and both together."""
    base = docs.select(*_measured(docs))
    sources = written(due(base, weights, share)).withColumnRenamed("mix_source", "due_source")
    ranked = written(_ranked(base, sources))
    placed = _placed(ranked, _bounds(ranked))
    inside = placed.where("room >= n").withColumn("drawn", F.lit(1))
    outside = placed.where("room <= 0 and certain > 0").withColumn("drawn", F.lit(0))
    last = placed.where("room > 0 and room < n").withColumn("place", F.row_number().over(Window.partitionBy("mix_source").orderBy("odds", "doc_id"))).withColumn("drawn", (F.col("place") <= F.col("room")).cast("int")).drop("place")
    chosen = inside.unionByName(outside).unionByName(last)
    return chosen.select("doc_id", F.col("mix_source").alias("source"), "certain", F.col("drawn").cast("long").alias("drawn"), (F.col("certain") + F.col("drawn")).alias("copies")).where("copies > 0")


def drawn_documents(docs: DataFrame, weights: dict[str | None, int] | None = None, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that get a copy, with all their columns, and ``copies`` (in place of a column of that name).

    Documents are drawn as by ``mixed``, but rows carry what they hold: only counts of cells are shuffled, and each row is told by its source's last rank drawn whether it
    is. Of rows of that very rank, which share a ``doc_id``, as many as are due are taken by the hash of their columns; only these are shuffled.
    """
    names = [c for c in docs.columns if c != "copies"]
    base = docs.select(*_measured(docs))
    sources = written(due(base, weights, share)).withColumnRenamed("mix_source", "due_source")
    ranked = _ranked(base, sources)
    bounds = _bounds(ranked)
    # the rank at which each source's sample ends, how many rows have it and how many of these are drawn
    order = Window.partitionBy("mix_source").orderBy("odds", "doc_id")
    last = _placed(ranked, bounds.where("room > 0 and room < n")).withColumns({"place": F.row_number().over(order), "first": F.rank().over(order), "same": F.count("*").over(Window.partitionBy("mix_source", "odds", "doc_id"))})
    ends = written(last.where("place = room").select(F.col("mix_source").alias("end_source"), F.struct("odds", "doc_id").alias("end"), (F.col("room") - F.col("first") + 1).alias("taken"), "same"))
    rows = _ranked(docs.select(*_measured(docs), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")), sources)
    told = _placed(rows, bounds).join(small(ends), F.col("mix_source").eqNullSafe(F.col("end_source")), "left").withColumn("rank", F.struct("odds", "doc_id"))
    whole = (F.col("room") >= F.col("n")).cast("int")
    part = F.when(F.col("rank") < F.col("end"), 1).when(F.col("rank") > F.col("end"), 0)
    told = told.withColumn("drawn", F.when((F.col("room") > 0) & (F.col("room") < F.col("n")), F.coalesce(part, F.when(F.col("taken") == F.col("same"), 1))).otherwise(whole))
    tied = told.where("drawn is null").withColumn("place", F.row_number().over(Window.partitionBy("mix_source").orderBy(F.xxhash64("row")))).withColumn("drawn", (F.col("place") <= F.col("taken")).cast("int")).drop("place")
    chosen = told.where("drawn is not null").unionByName(tied).withColumn("copies", F.col("certain") + F.col("drawn")).where("copies > 0")
    return chosen.select(*(F.col("row").getField(c).alias(c) for c in names), "copies")
