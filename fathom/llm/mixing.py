"""Mixing sources to target weights by entropy balancing (operator 8). DataFrame functions only.

Targets: sources in code-point order (null last) weigh 3, 1, 2, 3, 1, 2, ...; together they are to give `share` times all words. A target stops at `cap`
times its source's words, and what is left over is shared again by weight until no target is above.

Rates: of all document rates with sum(rate * size) = target and 0 <= rate <= cap, those with the least relative entropy to rate 1 are
exponentially tilted, rate = min(cap, exp(lambda * size / mean size)), one lambda a source. lambda is the root of the convex dual's gradient, found
by Newton steps kept inside a bracket; every step is one distributed sum over the (source, size) histogram, which gives the same sums as the documents.

Copies: the whole part of each rate, and one more for some documents, chosen by error diffusion: in order of falling size each bucket of about
`bucket` documents of a source carries the words still owed and takes a document when at least half of it is owed. What a bucket leaves open goes to
no other one, so a source misses its target by about half of its shortest documents a bucket. Ids hash to buckets, so a hot source is many buckets,
and reruns agree. Rows equal in id, source and text are one entry of a bucket with their number, however many they are.

Null texts and texts with no word have size 0 and are taken 0 times; a null source is a source, and not the empty one. Repeated rows share what is taken of
them; which of them is taken does not matter. An empty table, or one with no word, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.shared import FILE_ROWS, WORD_RE, id_text, materialise, quoted, shared_dir, unused

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size, ...) with weight and target. Water-filling: each round every open source gets its part of what is left; those it
    lifts over their limit close at it."""
    path, order, n = shared_dir(sources.sparkSession), F.col("source").asc_nulls_last(), sources.count()
    # Ranges in order, and a source's place among all from the sizes of the ranges before its own: no task sorts all sources.
    ranged = materialise(sources.repartitionByRange(1 + n // FILE_ROWS, order).withColumn("range", F.spark_partition_id()), f"{path}/ranged", n)
    before, done = {}, 0
    for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # a row for each range
        before[r.range], done = done, done + r.n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("range")) if before else F.lit(0)
    number = start + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    rows = ranged.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("double"))
    rows = materialise(rows.drop("range"), f"{path}/weighted", n)
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, limit = 0.0, F.col("source_size") * F.lit(float(cap))
    while True:
        closed = limit <= F.col("weight") * F.lit(level)
        x = rows.agg(F.sum(F.when(closed, limit)).alias("spent"), F.sum(F.when(~closed, F.col("weight"))).alias("open")).first()
        if not x.open or (total - (x.spent or 0.0)) / x.open <= level:
            break
        level = (total - (x.spent or 0.0)) / x.open
    return rows.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def tilts(histogram: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-9) -> DataFrame:
    """source and lambda for goals (source, source_size, source_docs, target). histogram: source, size, docs.

    Each step costs a sum over the histogram. The bracket holds the root, and a Newton step that leaves it is replaced by its middle, so that it shrinks until the
    sum is right or doubles have no number between its ends; steps go on until that holds for every source. A source whose
    target is its limit has no finite root and keeps a lambda of null: all its documents have the rate cap."""
    path = shared_dir(goals.sparkSession)
    state = goals.select(
        "source", "target", F.when(F.col("source_docs") > 0, F.col("source_size") / F.col("source_docs")).alias("mean"), (F.col("target") < F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12)).alias("inner"),
        F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (F.col("target") <= 0).alias("done"),
    )
    n, step = goals.count(), 0
    while state.filter("not done").take(1):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        free = tilt < cap
        sums = histogram.join(state.filter("inner and not done").select(F.col("source").alias("s"), "lam", "mean"), F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(
            F.sum(F.col("docs") * F.col("size") * F.least(tilt, F.lit(float(cap)))).alias("got"), F.sum(F.when(free, F.col("docs") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope")
        )
        moved = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.greatest("low", F.when(F.col("got").isNotNull(), F.col("lam")))), F.when(over, F.least("high", "lam")).otherwise(F.col("high"))
        moved = moved.withColumns({"low": low, "high": high, "done": F.col("done") | ~F.col("inner") | (F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target"))})
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        middle = F.when((F.col("low") > -1e6) & (F.col("high") < 1e6), (F.col("low") + F.col("high")) / 2).when(over, F.least(F.col("lam") * 2, F.col("lam") - 1)).otherwise(F.greatest(F.col("lam") * 2, F.col("lam") + 1))
        moved = moved.withColumn("next", F.when(F.col("done"), F.col("lam")).when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle))
        state = materialise(moved.withColumn("done", F.col("done") | (F.col("next") == F.col("lam"))).withColumn("lam", F.col("next")).drop("got", "slope", "next"), f"{path}/newton-{step}", n)
        step += 1
    return state.select("source", "mean", F.when(F.col("inner"), F.col("lam")).alias("lam"), "target")


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    parts = [F.col(quoted(c)) for c in (id_col, text_col, source_col)]
    return F.xxhash64(id_text(parts[0]), F.coalesce(parts[1], F.lit("")), F.coalesce(parts[2], F.lit("")), *[p.isNull() for p in parts])


def mix(documents: DataFrame, share: float = 1.5, cap: float = 2.0, bucket: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    path = shared_dir(documents.sparkSession)
    sized = documents.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("source"), word_count(F.col(quoted(text_col))).alias("size"), _row_key(id_col, text_col, source_col).alias("h"))
    sized = materialise(sized, f"{path}/sized")
    histogram = materialise(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), f"{path}/histogram", sized.count())
    sources = histogram.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"), F.sum("docs").alias("source_docs"))
    goals = materialise(targets(sources, share, cap), f"{path}/goals", histogram.count())
    tilted = tilts(histogram, goals, cap)
    known = goals.join(tilted.select(F.col("source").alias("s"), "lam", "mean"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "lam", "mean", F.ceil(F.col("source_docs") / bucket).alias("buckets"))
    rate = F.when(F.col("size") <= 0, 0.0).when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0)))))
    entries = sized.groupBy("h", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    rated = entries.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    # Fixed point, so that sums do not depend on order: 2^-20 of a word.
    owed = F.round((F.col("rate") - F.floor("rate")) * F.col("size") * (1 << 20)).cast("long")
    row = F.struct((-F.col("size")).alias("by"), F.col("h").alias("h"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"), F.col("rate").alias("rate"), owed.alias("owed"), F.col("n").alias("n"))
    grouped = rated.groupBy("source", F.pmod("h", F.col("buckets")).alias("b"), "source_size", "target").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        """One after the other, n equal rows would each take themselves when half of one is owed; together that is rounding to the nearest."""
        left, whole = acc["left"] + x["owed"] * x["n"], x["size"] * (1 << 20)
        take = F.when(x["owed"] > 0, F.greatest(F.lit(0).cast("long"), F.least(x["n"], F.floor((left * 2 + whole) / (whole * 2)).cast("long")))).otherwise(F.lit(0).cast("long"))
        return F.struct((left - take * whole).cast("long").alias("left"), F.concat(acc["more"], F.array(take)).alias("more"))

    start = F.struct(F.lit(0).cast("long").alias("left"), F.array().cast("array<bigint>").alias("more"))
    picked = grouped.withColumn("more", F.aggregate("rows", start, step)["more"])
    one = picked.select("source", "source_size", "target", F.explode(F.arrays_zip("rows", "more")).alias("x"))
    named = one.select(F.col("x.rows.doc_id").alias("doc_id"), "source", F.col("x.rows.h").alias("h"), F.col("x.rows.size").alias("size"), "source_size", "target", F.col("x.rows.rate").alias("rate"), F.col("x.rows.n").alias("n"), F.col("x.more").alias("more"))
    # Equal rows again, a thousand at a time: (first of them, how many).
    zero, thousand = F.lit(0).cast("long"), F.lit(1000).cast("long")
    parts = named.withColumn("from", F.explode(F.sequence(zero, F.col("n") - 1, thousand))).withColumn("at", F.explode(F.sequence(F.col("from"), F.least(F.col("n") - 1, F.col("from") + 999))))
    copies = (F.floor("rate") + (F.col("at") < F.col("more")).cast("int")).cast("long")
    return parts.select("doc_id", "source", "h", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), F.col("at").alias("equal_before"))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The documents, each as often as it is taken, all columns as they were. Rows equal in id, source and text share what they are taken for in any order."""
    key, place, h, before, made_id, made_source, times, copy = unused(documents.columns, "key", "place", "h", "before", "made_id", "made_source", "times", "copy")
    made = mix(documents, id_col=id_col, text_col=text_col, source_col=source_col, **settings).filter("copies > 0")
    made = made.select(F.col("h").alias(h), F.col("doc_id").alias(made_id), F.col("source").alias(made_source), F.col("equal_before").alias(before), F.col("copies").alias(times))
    same = [F.col(quoted(id_col)), F.col(quoted(source_col))]
    keyed = documents.withColumn(key, _row_key(id_col, text_col, source_col))
    keyed = keyed.withColumn(place, F.row_number().over(Window.partitionBy(key, *same).orderBy(key)).cast("long") - 1)
    found = (F.col(key) == F.col(h)) & (F.col(place) == F.col(before)) & same[0].eqNullSafe(F.col(made_id)) & same[1].eqNullSafe(F.col(made_source))
    taken = keyed.join(made, found).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return taken.select(*[F.col(quoted(c)) for c in documents.columns])
