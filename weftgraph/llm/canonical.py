"""Mapping free-entered values to a canonical list.

Different values are few beside the records, so the values are made distinct first, normalised, and sent through an
inverted index of the character n-grams of the list's forms. Candidates are scored by weighted cosine; the best form is
accepted if it reaches a threshold and leads the best form of any other entry by a margin.

Words that share no letters with any form of the list, such as synonyms and translations, are learned from the records
themselves (``values_in_use``): a value whose records bear the names of records with another value, equal to a form, means
the same, and one whose records are of many kinds means none of the list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.skew import skew_safe_lookup
from weftgraph.runtime import cut

#: Least cosine, and least lead over the best form of another entry.
THRESHOLD, MARGIN = 0.55, 0.02
#: What a value is used for shows from so many votes on, if one entry has such a share of them.
VOTES, VOTE_SHARE = 3, 0.8


def normalise(c: Column) -> Column:
    """Lower case without accents, wrappers (``kind/X``, ``type: X``, ``1. X``, ``X (main)``) and punctuation."""
    x = F.lower(c)
    x = F.translate(x, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāčďēěğīłńňőřśšťūůűźżž", "aaaaaaceeeeiiiinoooooouuuuyyacdeegilnnorsstuuuzzz")
    x = F.regexp_replace(x, r"ß", "ss")
    x = F.regexp_replace(x, r"[​﻿]", "")
    x = F.regexp_replace(x, r"(?U)(?<=[\p{L}\p{N}.])\s*[\(\[][^)\]]*[\)\]]\s*$", "")
    x = F.regexp_replace(x, r"(?U)(?<=[\p{L}\p{N}.])\s+[-–—/,|]\s+(primary|main|secondary|other|default)\W*$", "")
    x = F.regexp_replace(x, r"(?U)^\s*(entity[_ ]?type|type|kind|category|label|class)\s*[:=/|]\s*", "")
    x = F.regexp_replace(x, r"(?U)^\s*\d+\s*[.):]\s*(?=\p{L})", "")
    x = F.regexp_replace(x, r"(?U)[\p{P}\p{S}\s_“”„‘’«»‹›`´…·•®™ ]+", " ")
    return F.trim(x)


def _grams(c: str) -> Column:
    """Different letters and pairs of letters of the padded text."""
    return F.expr(f"array_distinct(flatten(transform(array(1, 2), n -> transform(sequence(1, length({c}) + 3 - n), i -> substring(concat('^', {c}, '$'), i, n)))))")


def _plurals(c: str) -> str:
    return f"array({c}, concat({c}, 's'), CASE WHEN {c} RLIKE '[^aeiou]y$' THEN concat(substring({c}, 1, length({c}) - 1), 'ies') WHEN {c} RLIKE '(s|x|ch|sh)$' THEN concat({c}, 'es') END)"


def reference_forms(ref: DataFrame, key: str, columns: list[str], more: DataFrame | None = None) -> DataFrame:
    """``entry``, ``form``: the normalised forms of each entry and their English plurals; a form that two entries share is left out."""
    kinds = dict(ref.dtypes)
    parts = F.flatten(F.array(*[F.col(c) if kinds[c].startswith("array") else F.array(F.col(c)) for c in columns]))
    forms = ref.select(F.col(key).alias("entry"), F.explode(parts).alias("raw"))
    if more is not None:
        forms = forms.unionByName(more.select("entry", "raw"))
    forms = forms.select("entry", normalise(F.col("raw")).alias("f")).where("f <> ''")
    forms = forms.select("entry", F.explode(F.expr(_plurals("f"))).alias("form")).where("form is not null").distinct()
    return forms.groupBy("form").agg(F.min("entry").alias("entry"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def map_values(values: DataFrame, column: str, forms: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, never: DataFrame | None = None) -> DataFrame:
    """``column``, ``entry`` (null: unmatched), ``form``, ``score`` for every different non-null value of ``column``.

    A value equal to a form after normalisation matches it with score 1. Otherwise the best form must reach ``threshold``
    and lead the best form of any other entry by ``margin`` (ties fail). Blank values, and any value if the list is empty, are
    unmatched. Of forms of one entry with equal scores the greatest is named. The normalised values in ``never`` (``raw``)
    match nothing but a form that they equal.
    """
    forms = cut(forms)
    distinct = cut(values.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("norm", normalise(F.col("value"))))
    n_forms = forms.count()
    norms = distinct.select("norm").where("norm <> ''").distinct()
    exact = norms.join(forms.select(F.col("form").alias("norm"), "entry"), "norm")
    found = exact.select("norm", "entry", F.col("norm").alias("form"), F.lit(1.0).alias("score"))
    if n_forms:
        length = F.sqrt(F.sum(F.col("w") * F.col("w")))
        grams = forms.select("form", F.explode(_grams("form")).alias("gram"))
        idf = cut(grams.groupBy("gram").agg(F.log(1 + F.lit(n_forms) / F.count(F.lit(1))).alias("w")))
        posts = cut(grams.join(idf, "gram"))
        lengths = posts.groupBy("form").agg(length.alias("fn")).join(forms, "form")
        fuzzy = norms.join(forms.select(F.col("form").alias("norm")), "norm", "left_anti")
        if never is not None:
            fuzzy = fuzzy.join(never.select(F.col("raw").alias("norm")), "norm", "left_anti")
        # a value meets many forms, so values are spread over the tasks whatever their bytes
        parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = cut(fuzzy.select("norm", F.explode(_grams("norm")).alias("gram")).repartition(parts, "norm"))
        unseen = F.lit(math.log(1.0 + n_forms))
        own = asked.join(idf, "gram", "left").withColumn("w", F.coalesce("w", unseen)).groupBy("norm").agg(length.alias("vn"))
        hits = asked.repartition(parts, "norm").join(posts, "gram").groupBy("norm", "form").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
        scored = hits.join(own, "norm").join(lengths, "form").select("norm", "form", "entry", F.round(F.col("dot") / (F.col("fn") * F.col("vn")), 6).alias("score"))
        scored = scored.where(F.col("score") >= threshold - margin)
        per_entry = scored.groupBy("norm", "entry").agg(F.max(F.struct("score", "form")).alias("b"))
        order = Window.partitionBy("norm").orderBy(F.desc("b.score"), "entry")
        ranked = per_entry.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("b.score").over(order))
        lead = F.round(F.col("b.score") - F.coalesce("second", F.lit(0.0)), 6) >= margin
        near = ranked.where((F.col("r") == 1) & (F.col("b.score") >= threshold) & lead)
        found = found.unionByName(near.select("norm", "entry", "b.form", "b.score"))
    return distinct.join(found, "norm", "left").select(F.col("value").alias(column), "entry", "form", "score")


def _name_key(c: Column) -> Column:
    """Words of a name in alphabetic order, without case and punctuation."""
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")), " ")


def values_in_use(df: DataFrame, record: str, column: str, name: str, aliases: str, forms: DataFrame, votes: int = VOTES, share: float = VOTE_SHARE) -> DataFrame:
    """``entry``, ``raw``: what normalised values of ``column`` that equal no form are used for; ``entry`` is null if for
    things of several entries.

    A record with such a value votes for the entry that most of the records with one of its names or aliases have by a value
    equal to a form. Only values with at least ``votes`` votes come out; their entry is the one with the share ``share`` of
    them. Null, blank and very short names vote for nothing; rows delivered again count once; an empty table gives no rows.
    A name that a third of all records bear is counted before it meets them.
    """
    both = F.array_distinct(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))
    # values are normalised before the names spread them
    rows = df.where(F.col(record).isNotNull() & F.col(column).isNotNull()).select(F.col(record).alias("rec"), normalise(F.col(column)).alias("norm"), both.alias("names"))
    keys = rows.where("norm <> ''").select("rec", "norm", F.explode("names").alias("n")).where("n is not null")
    keys = cut(keys.select("rec", "norm", _name_key(F.col("n")).alias("k")).where("length(k) > 3"))
    total = keys.count()
    known = cut(skew_safe_lookup(keys, forms.select(F.col("form").alias("norm"), "entry"), "norm", total))
    per = known.where("entry is not null").groupBy("k", "entry").agg(F.count_distinct("rec").alias("n"))
    best = per.groupBy("k").agg(F.sum("n").alias("t"), F.max(F.struct("n", "entry")).alias("m")).where("m.n * 2 > t").select("k", F.col("m.entry").alias("e"))
    asks = known.where("entry is null").select("norm", "rec", "k").distinct()
    votes_of = skew_safe_lookup(asks, best, "k", total).where("e is not null").select("norm", "rec", "e").distinct().groupBy("norm", "e").agg(F.count(F.lit(1)).alias("n"))
    top = votes_of.groupBy("norm").agg(F.sum("n").alias("t"), F.max(F.struct("n", "e")).alias("m")).where(F.col("t") >= votes)
    return top.select(F.when(F.col("m.n") >= share * F.col("t"), F.col("m.e")).alias("entry"), F.col("norm").alias("raw"))


def map_column(df: DataFrame, column: str, forms: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, never: DataFrame | None = None) -> DataFrame:
    """``df`` with ``entry``, ``form``, ``score`` of its value; rows with null or unmatched values keep nulls there."""
    found = map_values(df, column, forms, threshold, margin, never)
    return skew_safe_lookup(df, found, column)
