"""Mixing sources to target weights by Efraimidis-Spirakis sampling (native DataFrame operators).

A budget of words is split over the sources by weight; no source is asked for more than
``max_epochs`` times its size, and what that cuts off is shared out again by weight until no
target is above.  A source's target is met by complete epochs first (every document, all of
its words); the rest is a weighted sample without replacement: each document draws an
exponential key ``-ln(u) / quality``, documents are taken in ascending order of key, and a
prefix sum over their sizes ends at the budget.  The document at the end gives the first
words that still fit, so a source's taken words equal its target rounded down.

No source is sorted in one task.  Keys map monotonically to about ``sqrt(n)`` cells per source;
sums per cell show the one cell in which the budget ends.  A cell of more than ``EDGE_ROWS`` rows
(keys follow the qualities, so cells are uneven) is cut into cells again, as often as needed; only
the last one is ordered row by row.

Defined cases: null or empty texts have size 0 and are never taken; a null source is a source
of its own, after all others; a null identifier and repeated rows draw keys like any other row
(equal rows tie, the order among them does not change the result as a multiset); an empty
table gives an empty result; other columns are free, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import col, global_rank, staged, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the cell that is ordered in one task, at most (rows with one key can't be told apart);
#: cells into which a larger one is cut.
EDGE_ROWS = 20_000
FINER_CELLS = 256
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and TAB..CR."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """Share of letters, digits and plain white space in a text, within [0.05, 1]."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(0.05), plain / F.greatest(F.length(text), F.lit(1)))


def draw(seed: str, id_: Column, text: Column) -> Column:
    """52 reproducible bits of a row (MD5, which SQL has too)."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), id_.cast("string"), F.md5(text)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, max_epochs: float, weights: tuple = WEIGHTS) -> DataFrame:
    """Target of each source: rows (source, source_size, n_docs) get ``target``.

    Water filling: all sources below their cap share one rate per weight.  The driver holds the
    rate only; each round is an aggregate over the sources, and a round that caps no further
    source ends it.
    """
    ranked = global_rank(sizes, [F.col("source").isNull().asc(), F.col("source").asc()], "__rank")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    known = staged(
        ranked.withColumn("__w", F.element_at(pick, (F.col("__rank") % len(weights) + 1).cast("int")))
        .withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))).drop("__rank"),
        "sources",
    )
    total = known.agg(F.sum("source_size")).first()[0] or 0
    rate, budget = 0.0, min(share, max_epochs) * total
    while budget:
        capped = F.col("__cap") <= F.col("__w") * F.lit(rate)
        left = known.agg(
            F.sum(F.when(capped, F.col("__cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("__w"))).alias("open"),
        ).first()
        if not left["open"]:
            break
        following = (budget - left["full"]) / left["open"]
        if following <= rate:
            break
        rate = following
    return known.withColumn("target", F.least(F.col("__cap"), F.col("__w") * F.lit(rate))).drop("__w", "__cap")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *carry: Column) -> DataFrame:
    """Rows with what the plan needs: doc_id, source, size, weight, the bits drawn."""
    text = text_or_empty(text_col)
    return docs.select(
        col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), n_words(text).alias("size"),
        quality(text).alias("weight"), draw(seed, col(id_col), text).alias("__draw"), *carry,
    )


def keyed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows joined with their source's plan, with their exponential key."""
    uniform = (F.col("__draw").cast("double") + 0.5) / float(1 << 52)
    return join_sources(rows, plan).withColumn("es_key", -F.log(uniform) / F.col("weight"))


def edge_of(cells: DataFrame) -> DataFrame:
    """The cell of each source in which its budget ends: keys, rows, and the sizes before it.

    cells: (source, __cell, n, rows, lo, hi, __rest, __from), the sizes before the first one."""
    upto = W.partitionBy("source").orderBy("__cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = cells.withColumn("__upto", F.col("__from") + F.sum("n").over(upto)).withColumn("__before", F.col("__upto") - F.col("n"))
    return met.where("__before < __rest AND __upto >= __rest").select(
        F.col("source").alias("__of"), "__before", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "rows"
    )


def summed(rows: DataFrame, before: Column) -> DataFrame:
    return rows.groupBy("source", "__cell").agg(
        F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("es_key").alias("lo"), F.max("es_key").alias("hi"),
        F.first("__rest").alias("__rest"), F.first(before).alias("__from"),
    )


def mix_plan(rows: DataFrame, share: float, max_epochs: float, weights: tuple) -> DataFrame:
    """One row per source: target, complete epochs, and the keys between which the budget ends."""
    by_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.avg("weight").alias("__mean")
    )
    plan = source_targets(by_source, share, max_epochs, weights)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("__rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    plan = staged(
        plan.withColumn("__cells", F.greatest(F.lit(16), F.least(F.lit(1 << 16), F.ceil(F.sqrt("n_docs")))))
        .drop("n_docs").withColumnRenamed("source", "__source"), "plan",
    )
    # exp(-key * weight) is uniform and falls with the key: cells in order of key
    first = F.floor((1 - F.exp(-F.col("es_key") * F.col("__mean"))) * F.col("__cells")).cast("int")
    edges = staged(edge_of(summed(keyed(rows, plan).withColumn("__cell", first), F.lit(0).cast("long"))), "edges")
    wide = (F.col("rows") > EDGE_ROWS) & (F.col("__lo") < F.col("__hi"))
    while not edges.where(wide).isEmpty():
        open_edges = edges.where(wide).select(F.col("__of").alias("__in"), "__before", "__lo", "__hi")
        inside = join_sources(keyed(rows, plan), open_edges, "__in").where("es_key BETWEEN __lo AND __hi")
        finer = F.floor((F.col("es_key") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * FINER_CELLS).cast("int")
        closer = edge_of(summed(inside.withColumn("__cell", finer), F.col("__before")))
        edges = staged(edges.where(~wide).unionByName(closer), "edges")
    return staged(plan.join(edges.drop("rows"), F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of", "__mean", "__cells"), "plan")


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with ``taken``; only those of the cells in which a budget ends are moved and ordered."""
    placed = keyed(rows, plan)
    at = F.coalesce(F.col("es_key").between(F.col("__lo"), F.col("__hi")), F.lit(False))
    inside = F.coalesce(F.col("es_key") < F.col("__lo"), F.lit(False))
    plain = placed.where(~at).withColumn("__part", F.when(inside, F.col("size")).otherwise(F.lit(0)).cast("long"))
    order = W.partitionBy("source").orderBy("es_key", "doc_id", "__draw").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("__before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - before)).cast("long")
    out = plain.unionByName(placed.where(at).withColumn("__part", part))
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("__part")).cast("long"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    weights: tuple = WEIGHTS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, epochs, es_key."""
    rows = staged(measured(docs, id_col, text_col, source_col, seed), "sized")
    out = taken(rows, mix_plan(rows, share, max_epochs, weights))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "es_key")


#: A table of sources up to this many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def join_sources(rows: DataFrame, per_source: DataFrame, of: str = "__source") -> DataFrame:
    """Left join on ``source`` = ``of``; nulls match."""
    few = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = F.broadcast(per_source) if few else per_source
    return rows.join(side, F.col("source").eqNullSafe(F.col(of)), "left").drop(of)


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    weights: tuple = WEIGHTS,
    whole: bool = False,
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document taken twice is there twice.

    The last copy of the document at which a source's budget ends has only its first words; with
    ``whole``, it is there whole or not at all, whichever is nearer the target (there, if equal).
    Rows stay where they are, except for those of the cells in which a budget ends.
    """
    rows = staged(measured(docs, id_col, text_col, source_col, seed), "sized")
    plan = mix_plan(rows, share, max_epochs, weights)
    carried = measured(docs, id_col, text_col, source_col, seed, F.struct(*[col(c) for c in docs.columns]).alias("__all"))
    met = taken(carried, plan)
    if whole:
        more = F.when(F.col("__part") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
        met = met.withColumn("taken", F.col("epochs") * F.col("size") + more)
    met = met.where("taken > 0")
    copies = met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("__copy") - 1) * F.col("size"))
    text = F.col("__all").getField(text_col)
    cut = F.when(words >= F.col("size"), text).otherwise(first_words(text, words))
    return copies.select(*[(cut if c == text_col else F.col("__all").getField(c)).alias(c) for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}

#: The same draws and keys, with one prefix sum over each whole source.
ORACLE = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    greatest(CAST(0.05 AS DOUBLE), CAST(length(regexp_replace(t, '[^\p{{L}}\p{{Nd}}\x20\x09-\x0D]+', '', 'g')) AS DOUBLE) / greatest(length(t), 1)) AS weight,
    CAST('0x' || left(md5(concat_ws('|', 'mix', doc_id, md5(t))), 13) AS BIGINT) AS draw
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, CAST({list(WEIGHTS)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS DOUBLE) AS w,
  CAST(2 * source_size AS DOUBLE) AS cap, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget FROM s),
rates AS (SELECT CAST(0 AS DOUBLE) AS rate UNION ALL SELECT following FROM (
  SELECT rate, (any_value(budget) - sum(CASE WHEN cap <= w * rate THEN cap ELSE 0 END)) / nullif(sum(CASE WHEN cap <= w * rate THEN 0 ELSE w END), 0) AS following
  FROM rates, k GROUP BY rate) WHERE following > rate),
p AS (SELECT *, floor(target / nullif(source_size, 0)) AS epochs FROM (SELECT *, least(cap, w * (SELECT max(rate) FROM rates)) AS target FROM k)),
o AS (SELECT d.*, source_size, target, coalesce(epochs, 0) AS epochs, sum(size) OVER (
    PARTITION BY d.source ORDER BY -ln((draw + CAST(0.5 AS DOUBLE)) / CAST({1 << 52} AS DOUBLE)) / weight, doc_id, draw ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken FROM o"""

ORACLES = {"op1_mixing": ORACLE}
