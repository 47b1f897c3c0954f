"""Best representative of each duplicate group: skyline selection field by field.

The records of a group are points on three axes: completeness (does the record's value of the field carry information),
trust and recency. For each field the Pareto-undominated records are computed, and a lexicographic policy (completeness,
trust, recency, then the smallest id) picks the survivor among them. As completeness of the field is an axis, a record
without a value can't dominate one that has it, so the first dominance layer holds a value whenever any record has one:
a field that the most trusted record lacks is filled from the undominated records that have it, and no later layer is
needed. Layers over trust and recency alone would fill it by a less trusted but later record of the first layer, which is
not the rule that is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.skew import HOT_LEAST, HOT_PARTS
from weftgraph.runtime import cut

# Texts that stand in for a missing value, compared after trimming and lower-casing.
PLACEHOLDERS = [
    "", "-", "--", "---", "?", "??", "???", ".", "..", "...", "…", "_", "/", "0", "x", "xx", "xxx", "n/a", "n.a.", "n.a", "na", "#n/a",
    "nil", "null", "none", "nan", "nothing", "undefined", "unknown", "unnamed", "unnamed entity", "untitled", "no name", "(no name)", "noname",
    "not available", "not applicable", "not specified", "not known", "tbd", "t.b.d.", "tba", "todo", "to be added", "to be defined",
    "to be determined", "pending", "(description pending)", "description pending", "no description", "no description available",
    "no description available.", "no description.", "see document", "see text", "missing", "empty", "blank", "placeholder",
    "kein name", "keine angabe", "keine angaben", "k. a.", "k.a.", "unbekannt", "ohne namen", "sans nom", "inconnu", "inconnue",
    "non renseigné", "aucun", "aucune", "aucune description", "sin nombre", "sin datos", "desconocido", "desconocida", "sin descripción",
    "keine beschreibung",
]

#: A cut-off value may end in one of these marks.
CUT_MARK = r"(?U)\s*(…|\.\.\.|\[…\]|\[\.\.\.\])\s*$"


def _clean(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?U)^[\\s\\u200b\\u00a0\\ufeff]+|[\\s\\u200b\\u00a0\\ufeff]+$", ""))


def says_something(c: Column) -> Column:
    """False for null, blank and stand-in values."""
    return F.coalesce(~_clean(c).isin(PLACEHOLDERS), F.lit(False))


def _order_key(c: Column) -> Column:
    """Order in which a text is followed first by those that go on inside its last word, then by all its other extensions."""
    return F.regexp_replace(c, r"(?U)([^\p{L}\p{N}])", "￿$1")


def _next_in_range(values: DataFrame, columns: list[str]) -> DataFrame:
    """``values`` with ``__next``: the stem of the following row in the order of ``columns`` (the last is ``key``), if it has
    the same others. Rows are put in order by range, so one group may be spread over all partitions; the first row of each
    partition, as many as there are partitions, completes the last row of the one before."""
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(values.repartitionByRange(parts, *columns).withColumn("__at", F.spark_partition_id()))
    order = Window.partitionBy("__at").orderBy(*columns)
    inside = ranged.withColumn("__next", F.lead(F.struct("grp", "field", "stem")).over(order)).withColumn("__last", F.lead(F.lit(1)).over(order).isNull())
    first = ranged.groupBy("__at").agg(F.min(F.struct(*columns, "stem")).alias("f")).select("__at", F.struct("f.grp", "f.field", "f.stem").alias("head"))
    follows = first.select((F.lag("__at").over(Window.orderBy("__at"))).alias("__at"), "head")  # one row a partition
    whole = inside.where("not __last").unionByName(inside.where("__last").drop("__next").join(F.broadcast(follows), "__at", "left").withColumnRenamed("head", "__next"))
    same = F.col("__next.grp").eqNullSafe(F.col("grp")) & (F.col("__next.field") == F.col("field"))
    return whole.withColumn("__next", F.when(same, F.col("__next.stem")))


def _broken(values: DataFrame, is_hot: Column | None) -> DataFrame:
    """Of distinct (grp, field, stem), those that another stem of the same group and field continues inside a word.

    In the order of ``_order_key`` the next value starts with the stem and goes on with a word character if any value
    does. Groups are ordered by a window; those of ``is_hot`` by ranges that several tasks share.
    """
    v = values.withColumn("key", _order_key(F.col("stem")))
    after = Window.partitionBy("grp", "field").orderBy("key")
    ends_in_word = F.col("stem").rlike(r"(?U)[\p{L}\p{N}]$")
    goes_on = F.expr("substring(__next, length(stem) + 1, 1)").rlike(r"(?U)[\p{L}\p{N}]")
    if is_hot is None:
        following = v.withColumn("__next", F.lead("stem").over(after))
    else:
        few = _next_in_range(v.where(is_hot), ["grp", "field", "key"]).select(*v.columns, "__next")
        following = v.where(~is_hot).withColumn("__next", F.lead("stem").over(after)).unionByName(few)
    return following.where(ends_in_word & F.col("__next").startswith(F.col("stem")) & goes_on).select("grp", "field", "stem")


def _undominated(points: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``points`` (``complete``, ``trust``, ``recency``) that no other row with the same ``keys`` dominates; of rows
    equal on all three axes there is one."""
    above = Window.partitionBy(*keys).orderBy(F.desc("trust"), F.desc("recency"), F.desc("complete"))
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    # whatever dominates a row comes before it; the latest complete row and the latest of all decide
    seen = lambda c: F.max(F.when(c, F.struct(F.lit(1).alias("any"), "recency"))).over(before)
    own = F.struct(F.lit(1).alias("any"), "recency")
    held = points.withColumn("__c", seen(F.col("complete") == 1)).withColumn("__a", seen(F.lit(True)))
    beaten = F.coalesce(F.col("__c") >= own, F.lit(False)) | ((F.col("complete") == 0) & F.coalesce(F.col("__a") >= own, F.lit(False)))
    return held.where(~beaten).drop("__c", "__a")


def field_skyline(df: DataFrame, group: str, record: str, fields: list[str], trust: str, recency: str) -> DataFrame:
    """First dominance layer of each group and field over completeness, trust and recency, with its survivor marked.

    Returns ``grp``, ``field``, ``complete`` (1 or 0), ``trust`` (double, minus infinity for null and NaN), ``recency``,
    ``record``, ``survivor``. Of records equal on all axes the smallest id stands for all. Array fields carry information
    if one entry does. Null recency is earlier than any. Records with a null group form a group of their own (null).
    Groups without information in a field have no survivor for it. Rows delivered again change nothing; an empty table gives
    no rows. One group may hold a third of all rows: records are pre-aggregated by (group, field, completeness, trust), the
    layers of 64 parts of a group are found first, and their union's layer is the group's.
    """
    kinds = dict(df.dtypes)
    weight = F.col(trust).cast("double")
    weight = F.when(weight.isNull() | F.isnan(weight), F.lit(float("-inf"))).otherwise(weight)
    slim = df.select(F.col(group).alias("grp"), F.col(record).alias("record"), weight.alias("trust"), F.col(recency).alias("recency"), *[(F.col(f) if kinds[f].startswith("array") else F.array(F.col(f))).cast("array<string>").alias(f"f{i}") for i, f in enumerate(fields)])
    as_field = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("vals")) for i, f in enumerate(fields)])
    wide = slim.select("grp", "record", "trust", "recency", F.explode(as_field).alias("s")).select("grp", "record", "trust", "recency", "s.field", "s.vals")
    long = wide.select("grp", "record", "trust", "recency", "field", F.explode_outer("vals").alias("val"))
    strip = F.regexp_replace("val", "(?U)^[\\s\\u200b]+|[\\s\\u200b]+$", "")
    long = long.withColumn("stem", F.when(says_something(F.col("val")), F.regexp_replace(strip, CUT_MARK, "")))
    values = long.select("grp", "field", "stem").where("stem <> ''").distinct()
    sizes = df.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in sizes.where(F.col("n") > max(HOT_LEAST, total // HOT_PARTS)).select("grp").collect()] if total > HOT_LEAST else []
    is_hot = None
    if hot:  # fewer than HOT_PARTS groups; the null group may be one
        is_hot = F.when(F.col("grp").isNull(), F.lit(None in hot)).otherwise(F.col("grp").isin([g for g in hot if g is not None]))
    bad = _broken(values, is_hot).select(F.col("grp").alias("b_grp"), F.col("field").alias("b_field"), F.col("stem").alias("b_stem"))
    marked = long.join(bad, F.expr("grp <=> b_grp and field = b_field and stem = b_stem"), "left")
    marked = marked.select("grp", "field", "trust", "recency", "record", (F.col("b_stem").isNull() & (F.coalesce("stem", F.lit("")) != "")).cast("int").alias("complete"))
    # of each trust value the latest record counts, then the smallest id
    best = marked.groupBy("grp", "field", "complete", "trust").agg(F.max(F.struct(F.col("recency"), (-F.col("record")).alias("neg"))).alias("m"))
    points = best.select("grp", "field", "complete", "trust", F.col("m.recency").alias("recency"), (-F.col("m.neg")).alias("record"))
    if is_hot is not None:
        salted = points.where(is_hot).withColumn("__salt", F.pmod(F.xxhash64("trust", "complete"), F.lit(64)))
        points = points.where(~is_hot).unionByName(_undominated(salted, ["grp", "field", "__salt"]).drop("__salt"))
    front = _undominated(points, ["grp", "field"])
    policy = F.row_number().over(Window.partitionBy("grp", "field").orderBy(F.desc("complete"), F.desc("trust"), F.desc("recency"), "record"))
    return front.withColumn("survivor", (policy == 1) & (F.col("complete") == 1))


def survivors(df: DataFrame, group: str, record: str, fields: list[str], trust: str, recency: str) -> DataFrame:
    """``grp``, ``field``, ``record``: the record whose value survives for each group and field (see field_skyline)."""
    return field_skyline(df, group, record, fields, trust, recency).where("survivor").select("grp", "field", "record")


def golden_records(df: DataFrame, group: str, record: str, fields: list[str], trust: str, recency: str) -> DataFrame:
    """One built record per group: each field from its survivor, with ``<field>_from`` naming the record; null if none has it."""
    win = survivors(df, group, record, fields, trust, recency)
    once = df.dropDuplicates([record]).select(F.col(record).alias("__rec"), *[F.col(f).alias(f"__{f}") for f in fields])
    cells = win.join(once, win.record == once["__rec"])
    aggs = []
    for f in fields:
        mine = F.when(F.col("field") == f, F.struct(F.col(f"__{f}").alias("v"), F.col("record").alias("r")))
        aggs.append(F.first(mine, ignorenulls=True).alias(f"__c_{f}"))
    built = cells.groupBy("grp").agg(*aggs)
    wide = built.select("grp", *[x for f in fields for x in (F.col(f"__c_{f}.v").alias(f), F.col(f"__c_{f}.r").alias(f"{f}_from"))])
    groups = df.select(F.col(group).alias("grp")).distinct()
    return groups.alias("g").join(wide.alias("w"), F.expr("g.grp <=> w.grp"), "left").select("g.grp", *[F.col(f"w.{c}") for c in wide.columns if c != "grp"]).withColumnRenamed("grp", group)
