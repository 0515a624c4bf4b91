"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range is kept.

Two sketches compare by what both would have kept, so containment of a short text in a very long one is estimated
as well as the likeness of equals, and `merge` makes of two sketches that of their sets' union. A sketch of a short
text may keep next to nothing: with a `floor` it also keeps its smallest hashes up to that number, and says up to which
hash it is complete. All of it is built-in functions; nothing is shuffled but, for edited texts, each text once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = r"[ \t\n\x0B\f\r]+"
MOST = (1 << 63) - 1


def with_sketch(df: DataFrame, text: str, to: str, words: int = 5, fraction: float = 1 / 8, floor: int = 0) -> DataFrame:
    """`df` with `to`: a struct of `upto` and the sorted `hashes` of the whole text's shingles that are not above it.

    Hashes below `fraction` of the range are kept, and the `floor` smallest where these are fewer.

    Words are parted by ASCII white space and lower-cased; a text of fewer than `words` words is one shingle, as is a
    text without words; a null text counts as empty. Equal texts have equal sketches.
    """
    below = -(1 << 63) + int(fraction * (1 << 64))
    w, s, d = (f"_{to}_{x}" for x in "wsd")
    hashed = F.transform(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), ""), lambda x: F.xxhash64(x))
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(words)]))
    kept = F.filter(F.col(s), lambda h: h < below)
    out = df.withColumn(w, hashed).withColumn(s, F.array_distinct(shingles)).drop(w).withColumn(d, F.sort_array(kept))
    if not floor:
        return out.withColumn(to, F.struct(F.lit(below - 1).alias("upto"), F.col(d).alias("hashes"))).drop(s, d)
    least = F.slice(F.sort_array(F.col(s)), 1, floor)
    out = out.withColumn(d, F.when(F.size(d) >= floor, F.col(d)).otherwise(least))
    upto = F.when(F.size(s) <= floor, F.lit(MOST)).when(F.size(d) > floor, F.lit(below - 1)).otherwise(F.greatest(F.lit(below - 1), F.element_at(d, -1)))
    return out.withColumn(to, F.struct(upto.alias("upto"), F.col(d).alias("hashes"))).drop(s, d)


def merge(a: str, b: str, fraction: float = 1 / 8, floor: int = 0) -> Column:
    """The sketch of the union of two sets, from their sketches of the same `fraction` and `floor`."""
    below = -(1 << 63) + int(fraction * (1 << 64))
    whole = (F.col(f"{a}.upto") == MOST) & (F.col(f"{b}.upto") == MOST)

    def of(both: Column) -> Column:
        under = F.size(F.filter(both, lambda h: h < below))
        kept = F.when(under >= floor, under).otherwise(F.least(F.size(both), F.lit(floor)))
        last = F.greatest(F.lit(below - 1), F.try_element_at(both, kept))
        upto = F.when(whole & (F.size(both) <= floor), F.lit(MOST)).when(kept > floor, F.lit(below - 1)).otherwise(last)
        return F.struct((upto if floor else F.lit(below - 1)).alias("upto"), F.slice(both, F.lit(1), kept).alias("hashes"))

    # the union stands in a list of one, so that it is computed once
    return F.element_at(F.transform(F.array(F.sort_array(F.array_union(F.col(f"{a}.hashes"), F.col(f"{b}.hashes")))), of), 1)


def fingerprint(sketch: str) -> Column:
    """A sketch as text: hexadecimal digits of `upto` and of each hash."""
    return F.concat_ws("", F.lpad(F.hex(F.col(f"{sketch}.upto")), 16, "0"), F.transform(F.col(f"{sketch}.hashes"), lambda h: F.lpad(F.hex(h), 16, "0")))


def shared(a: str, b: str) -> tuple[Column, Column, Column]:
    """Of two sketches, up to where both are complete: the hashes in common, those of a, those of b."""
    upto = F.least(F.col(f"{a}.upto"), F.col(f"{b}.upto"))
    left, right = (F.filter(F.col(f"{x}.hashes"), lambda h: h <= upto) for x in (a, b))
    return F.size(F.array_intersect(left, right)), F.size(left), F.size(right)


def likeness(a: str, b: str) -> Column:
    """The estimated Jaccard similarity of the shingle sets, 0 to 1."""
    both, left, right = shared(a, b)
    known = left + right - both  # none: two sketches without a hash look alike
    return F.when(known > 0, both / known).otherwise(1.0).cast("double")


def containment(a: str, b: str) -> Column:
    """The estimated share of a's shingles that b holds, 0 to 1; null where a kept none that b would have kept."""
    both, left, _ = shared(a, b)
    return F.when(left > 0, both / left).cast("double")


def with_next(df: DataFrame, order: str, columns: list[str], tie: str, rows_a_range: int = 200, most_ranges: int = 1 << 15, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """`df` with `next_<c>` for each of `columns`: the value in the row that follows by `order`, after the last the first.

    Rows are dealt to ranges of `order` of about equal counts, and each range also gets the first row of the range
    after it, so no task sees more than a range. Equal values of `order` follow each other by `tie`; nulls come last.
    `prepare` makes columns of a row; it is applied to the rows, and to the ranges' first rows when they are picked.
    """
    n = df.count()
    parts = max(1, min(most_ranges, n // rows_a_range))
    bounds = sorted(set(df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    rows = df.withColumn("_order", F.col(order).cast("double"))
    if bounds:
        rows = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_order", outputCol="_range", handleInvalid="keep").transform(rows)
        rows = rows.withColumn("_range", F.coalesce(F.col("_range").cast("int"), F.lit(len(bounds) + 1))).drop("_order")
    else:
        rows = rows.withColumn("_range", F.lit(0)).drop("_order")
    keyed = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("key"))
    firsts = [(r[0], r[1]["key"]) for r in rows.select("_range", keyed.alias("k")).groupBy("_range").agg(F.min("k").alias("k")).collect()]  # a row for each range
    if not firsts:
        return prepare(rows.drop("_range")).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    firsts.sort()
    spark = df.sparkSession
    to = [(before, at, key) for (before, _), (at, key) in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)]
    table = spark.createDataFrame(to, f"_before int, _at int, _key {dict(df.dtypes)[order]}")
    guards = rows.join(F.broadcast(table), (F.col("_range") == F.col("_at")) & F.col(order).eqNullSafe(F.col("_key")))
    leading = Window.partitionBy("_at").orderBy(F.col(tie).asc_nulls_first())
    guards = guards.withColumn("_nth", F.row_number().over(leading)).where("_nth = 1").withColumn("_range", F.col("_before")).drop("_before", "_at", "_key", "_nth")
    both = prepare(rows).withColumn("_guard", F.lit(0)).unionByName(prepare(guards).withColumn("_guard", F.lit(1)))
    follow = Window.partitionBy("_range").orderBy("_guard", F.col(order).asc_nulls_last(), F.col(tie).asc_nulls_first())
    out = both.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns])
    return out.where("_guard = 0").drop("_range", "_guard")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", floor: int = 64) -> DataFrame:
    """Each text beside its edited text, whose last quarter is the start of the next document, and the next document.

    `(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`, a row for each row.
    Sketches have a floor: of a text of a hundred words an eighth of its shingles tells too little.
    A null text counts as empty, null ids come last, rows of an id follow each other by text, a single row follows
    itself, and an empty table gives an empty result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sketched = lambda rows: with_sketch(rows, "text", "sketch", floor=floor)
    rows = with_next(own, "doc_id", ["text", "sketch"], "text", prepare=sketched)
    n = F.length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.substr("text", F.lit(1), (n - cut).cast("int")), F.substr("next_text", F.lit(1), cut))).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch", floor=floor)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))
