"""Mixing sources to target weights that change over training.

Each source has a weight schedule over progress t in [0, 1], linear between knots. A source's share at t is its weight over the
sum of all weights. With a budget of ``total`` tokens a source's cumulative demand D(t) is total times the integral
of its share, taken by the trapezoid rule on GRID cells and linear within a cell. The documents of a source are put
into an order without meaning (that of the MD5 of their ids), and a document that follows c tokens of its source stands at the
progress where D(t) = c. A source whose demand exceeds its supply starts again, epoch by epoch; one whose supply exceeds
its demand leaves the rest out. The result is sorted by position.

By default the weights are tempered supplies, supply ** ALPHA, tilted by TILT: sources of short documents
come early, those of long ones late.

Scale: prefix sums are not taken over a whole source in one task. A source's order is cut into buckets by the first hexadecimal
digits of the MD5; a small aggregate gives the tokens before each bucket, and windows run within buckets. As positions are
even in tokens, the target partition is a function of the position and no sampling is needed to sort. The driver
sees no rows. What is broadcast by Spark's own choice has (sources x grid) or (sources x buckets) rows and is size-checked by it.

Edge cases: tokens are runs of characters other than blank, tab, newline and carriage return; a null or
empty text has none and gets no position. A null source counts as the source ''. Rows without an id or with a repeated one are rows like
others (ties in the order go to fewer tokens, and rows that are the same in all three are interchangeable). Extra columns pass through;
inner columns have names that the input doesn't. An empty table gives an empty result. Sources
without a knot in a given schedule have weight 0; if all weights are 0 at some t, no source is asked for tokens there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import cut, fresh

ALPHA, TILT, GRID = 0.7, 0.5, 256
DIGITS = 3


def count_tokens(text: str) -> Column:
    """Blank-separated words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def supplies(narrow: DataFrame) -> DataFrame:
    return narrow.groupBy("s").agg(F.sum("n").alias("supply"), F.count("*").alias("docs"))


def tempered(supply: DataFrame, alpha: float = ALPHA, tilt: float = TILT) -> DataFrame:
    """Default schedules: knots (s, t, w) at 0 and 1. A source's tilt goes from -tilt to tilt by the rank of its mean document length."""
    rank = F.row_number().over(Window.orderBy(F.col("supply") / F.col("docs"), "s")) - 1
    n = F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = supply.select("s", F.pow(F.col("supply").cast("double"), F.lit(alpha)).alias("base"), F.when(n > 1, F.lit(tilt) * (2 * rank / (n - 1) - 1)).otherwise(0.0).alias("by"))
    return d.select("s", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (F.col("base") * (1 + F.col("by") * (2 * t - 1))).alias("w")) for t in (0.0, 1.0)])).alias("x")).select("s", "x.t", "x.w")


def demand(knots: DataFrame, total: DataFrame, grid: int = GRID) -> DataFrame:
    """Cells (s, t0, t1, d0, d1) of each source's cumulative demand. knots: (s, t, w); total: one row (total)."""
    own = Window.partitionBy("s").orderBy("t")
    seg = knots.select("s", "t", "w", F.lead("t").over(own).alias("tn"), F.lead("w").over(own).alias("wn"), F.row_number().over(own).alias("k"))
    seg = seg.select("s", F.when(F.col("k") == 1, -1.0).otherwise(F.col("t")).alias("lo"), F.coalesce("tn", F.lit(2.0)).alias("hi"), "t", "w", F.coalesce("tn", F.lit(2.0)).alias("tn"), F.coalesce("wn", "w").alias("wn"))
    points = knots.sparkSession.range(grid + 1).select(F.col("id").alias("i"), (F.col("id") / F.lit(float(grid))).alias("g"))
    at = F.col("w") + (F.greatest("g", "t") - F.col("t")) / (F.col("tn") - F.col("t")) * (F.col("wn") - F.col("w"))
    w = F.broadcast(points).join(seg, (F.col("g") >= F.col("lo")) & (F.col("g") < F.col("hi"))).select("s", "i", "g", F.greatest(at, F.lit(0.0)).alias("w"))
    sums = w.groupBy("i").agg(F.sum("w").alias("all")).withColumnRenamed("i", "j")
    share = w.join(sums, F.col("i") == F.col("j")).select("s", "i", "g", F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0).alias("share"))
    o = Window.partitionBy("s").orderBy("i")
    cells = share.select("s", "i", F.col("g").alias("t1"), F.lag("g").over(o).alias("t0"), ((F.col("share") + F.lag("share").over(o)) / (2.0 * grid)).alias("part"))
    cells = cells.where("i > 0").crossJoin(F.broadcast(total))
    d1 = F.sum("part").over(o.rowsBetween(Window.unboundedPreceding, 0)) * F.col("total")
    cells = cells.select("s", "t0", "t1", d1.alias("d1"), "i")
    return cells.select("s", "t0", "t1", F.coalesce(F.lag("d1").over(o), F.lit(0.0)).alias("d0"), "d1")


def mix(docs: DataFrame, schedule: DataFrame | None = None, total: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", alpha: float = ALPHA, tilt: float = TILT, grid: int = GRID, digits: int = DIGITS, keep: list[str] | None = None) -> DataFrame:
    """The rows of the mix, sorted by position: the columns keep of docs, n_tokens, epoch (from 0) and position, a token offset below total.

    schedule: knots (source, t, weight); None for the tempered ones. total: the budget; None for the supply. keep: None for id and source.
    """
    spark = docs.sparkSession
    keep = [id_col, source_col] if keep is None else keep
    if schedule is not None:
        knots = schedule.select(F.coalesce(F.col("source"), F.lit("")).alias("s"), F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("w"))
    md5 = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    base = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"), md5.alias("m"), F.col(id_col).cast("string").alias("o"), count_tokens(text_col).alias("n"), F.struct(*[F.col(c) for c in keep]).alias("row")).where("n > 0").withColumn("b", F.substring("m", 1, digits))
    before = cut(base.groupBy("s", "b").agg(F.sum("n").alias("n"), F.count("*").alias("docs")))
    supply = before.groupBy("s").agg(F.sum("n").alias("supply"), F.sum("docs").alias("docs"))
    if schedule is None:
        knots = tempered(supply, alpha, tilt)
    all_tokens = spark.range(1).select(F.lit(total).cast("double").alias("total")) if total is not None else supply.agg(F.coalesce(F.sum("supply"), F.lit(0)).cast("double").alias("total"))
    cells = cut(demand(knots, all_tokens, grid).where("d1 > d0"))
    ends = cells.groupBy("s").agg(F.max("d1").alias("end"))
    offset = F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = before.join(supply.select("s", "supply"), "s").join(ends, "s").select("s", "b", F.coalesce(offset, F.lit(0)).alias("offset"), "supply", "end").where("offset < end")
    within = F.sum("n").over(Window.partitionBy("s", "b").orderBy("m", "o", "n").rowsBetween(Window.unboundedPreceding, -1))
    placed = base.select("s", "b", "n", "row", F.coalesce(within, F.lit(0)).alias("c")).join(offsets, ["s", "b"]).withColumn("c", F.col("c") + F.col("offset")).where("c < end")
    # epochs e with e * supply + c < end
    turns = F.ceil((F.col("end") - F.col("c")) / F.col("supply"))
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(turns - 1, F.lit(0).cast("bigint"))))).withColumn("c", F.col("c") + F.col("epoch") * F.col("supply")).where("c < end")
    # one row a source: its grid as an array, searched by halving
    grids = cells.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("d0", "d1", "t0", "t1"))).alias("g"))
    placed = placed.join(grids, "s")
    cell = F.expr("element_at(g, aggregate(sequence(0, 15), named_struct('lo', 1, 'hi', size(g)), (a, x) -> IF(a.lo >= a.hi, a, IF(g[CAST((a.lo + a.hi) DIV 2 AS INT) - 1].d1 > c, named_struct('lo', a.lo, 'hi', CAST((a.lo + a.hi) DIV 2 AS INT)), named_struct('lo', CAST((a.lo + a.hi) DIV 2 AS INT) + 1, 'hi', a.hi))), a -> a.lo))")
    t = F.col("x.t0") + F.greatest(F.col("c") - F.col("x.d0"), F.lit(0.0)) / (F.col("x.d1") - F.col("x.d0")) * (F.col("x.t1") - F.col("x.t0"))
    placed = placed.withColumn("x", cell).withColumn("p", t).crossJoin(F.broadcast(all_tokens))
    placed = placed.select("row", "n", "epoch", "p", F.floor(F.round(F.col("p") * F.col("total"), 3)).alias("position"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pid = F.least(F.floor(F.col("p") * parts), F.lit(parts - 1)).cast("int")
    names = {c: n for c, n in (("n", "n_tokens"), ("epoch", "epoch"), ("position", "position"))}
    out = placed.repartitionById(parts, pid).sortWithinPartitions("p", "n")
    return out.select("row.*", *[F.col(c).alias(_clear(n, keep)) for c, n in names.items()])


def _clear(name: str, taken: list[str]) -> str:
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix has them, in the order of their positions: rows left out are gone, those of later epochs come again. Columns as in docs."""
    return mix(docs, keep=docs.columns, **options).select(*docs.columns)


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))"

#: The default mix of documents.
SQL = rf"""
WITH b AS (SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m, CAST(doc_id AS VARCHAR) AS o, {_WORDS} AS n FROM documents WHERE {_WORDS} > 0),
sup AS (SELECT s, CAST(sum(n) AS BIGINT) AS supply, count(*) AS docs FROM b GROUP BY s),
tot AS (SELECT CAST(coalesce(sum(supply), 0) AS DOUBLE) AS total FROM sup),
k AS (SELECT s, pow(supply, {ALPHA}) AS base, CASE WHEN count(*) OVER () > 1 THEN {TILT} * (2 * (row_number() OVER (ORDER BY supply / docs, s) - 1) / (count(*) OVER () - 1) - 1) ELSE 0 END AS tilt FROM sup),
p AS (SELECT s, i, i / {GRID}.0 AS g, base * (1 - tilt) + i / {GRID}.0 * (base * (1 + tilt) - base * (1 - tilt)) AS w FROM k, range(0, {GRID} + 1) r(i)),
sh AS (SELECT s, i, g, w / sum(w) OVER (PARTITION BY i) AS share FROM p),
c AS (SELECT s, i, g AS t1, lag(g) OVER q AS t0, (share + lag(share) OVER q) / (2.0 * {GRID}) AS part FROM sh WINDOW q AS (PARTITION BY s ORDER BY i)),
d AS (SELECT s, i, t0, t1, sum(part) OVER (PARTITION BY s ORDER BY i ROWS UNBOUNDED PRECEDING) * total AS d1 FROM c, tot WHERE i > 0),
e AS (SELECT s, t0, t1, coalesce(lag(d1) OVER (PARTITION BY s ORDER BY i), 0) AS d0, d1 FROM d),
en AS (SELECT s, max(d1) AS fin FROM e GROUP BY s),
pl AS (SELECT b.*, supply, fin, CAST(coalesce(sum(n) OVER (PARTITION BY b.s ORDER BY m, o, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c0 FROM b JOIN sup ON b.s = sup.s JOIN en ON b.s = en.s),
ep AS (SELECT *, unnest(range(0, CAST(ceil((fin - c0) / supply) AS BIGINT))) AS epoch FROM pl WHERE c0 < fin),
x AS (SELECT doc_id, source, s, n, epoch, c0 + epoch * supply AS c FROM ep WHERE c0 + epoch * supply < fin)
SELECT doc_id, source, n AS n_tokens, epoch, CAST(floor(round((t0 + greatest(c - d0, 0) / (d1 - d0) * (t1 - t0)) * total, 3)) AS BIGINT) AS position
FROM x JOIN e ON x.s = e.s AND x.c >= e.d0 AND x.c < e.d1, tot
"""
