"""Mix sources to target weights, to the word.

Documents get hash-random keys, of doc_id or, where it is null, of the text. Within a source
they are ordered by key; prefix sums of their sizes are taken first over key ranges, then inside
a range, so a source or a missing id that a third of all rows share is as spread out as any
other. A source's budget is whole epochs of all its documents
plus a last epoch that is cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changegrid.llm.text import WORD_PATTERN
from changegrid.plans.lineage import cut

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SPACES = r"\\x20\\x09-\\x0D"  # inside a SQL string


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources by code point, null last, weigh `weights` in turn and share the total size. No
    target exceeds `max_epochs` times its source's size; what is above is shared again by
    weight. Sources in order of cap per weight reach their caps first, so the final share
    per weight follows from running sums, without a loop.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(turn) - 1) % len(weights) + 1)
    weighed = sizes.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = weighed.select(
        "source", "source_size", "w", "cap",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))).alias("rest"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0))).alias("rest_w"),
        F.row_number().over(by_cap).alias("place"),
    )
    # A source is capped while a share by weight of what is left reaches its cap; all later ones then share evenly.
    fits = F.col("rest") * F.col("w") <= F.col("cap") * F.col("rest_w")
    level = left.select("*", F.min(F.when(fits, F.struct("place", "rest", "rest_w"))).over(everything).alias("level"))
    target = F.when(
        F.col("level").isNull() | (F.col("place") < F.col("level.place")), F.col("cap").cast("double")
    ).otherwise(F.col("level.rest") * F.col("w") / F.col("level.rest_w"))
    return level.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, carry: bool = False
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row.

    `size` is the number of words (null text: 0), `taken` the words the mix takes, repeats
    counted; it is at most max_epochs * size. Within a source, taken sums to the target rounded
    down. Null sources form one source; rows without doc_id get their key from their text; rows
    equal in doc_id are ordered by size, then by a hash of their text; repeated rows share what they get in any order; empty tables give no rows.
    `carry` adds the whole input row as a struct `row`; other columns are not kept, so names cannot clash.
    """
    sized = docs.select(
        "doc_id", "source", *([F.struct("*").alias("row")] if carry else []),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))).alias("_key"),
        F.xxhash64("text").alias("_tie"),
    )
    thin = cut(sized.select("doc_id", "source", "size", "_key", "_tie"))
    bits = min(32, (thin.count().bit_length() + 1) // 2)  # about as many ranges as rows in a range
    in_range = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - bits)
    sums = cut(thin.withColumn("_range", in_range).groupBy("source", "_range").agg(F.sum("size").alias("range_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("_range")) - F.col("range_size")
    starts = sums.select(F.col("source").alias("_source"), F.col("_range").alias("_start_of"), before.alias("_before"))
    budgets = starts.join(targets, F.col("_source").eqNullSafe(F.col("source")))
    budgets = cut(
        budgets.selectExpr(
            "_source", "_start_of", "_before", "source_size", "target",
            "if(source_size > 0, bigint(floor(target)) div source_size, 0L) as _epochs",
            "if(source_size > 0, bigint(floor(target)) % source_size, 0L) as _spare",
        )
    )
    order = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", "_tie")
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = (sized if carry else thin).withColumn("_range", in_range).withColumn("_inside", inside)
    joined = placed.join(budgets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_start_of")))
    last = "least(size, greatest(0L, _spare - _before - _inside))"
    return joined.selectExpr("doc_id", "source", "size", "source_size", "target", f"_epochs * size + {last} as taken", *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mix as rows of `docs`: a document comes once per whole epoch it is taken for, and a last
    time with its first words where its source's budget ends inside it. Documents of which no
    word is taken are left out, those without words among them. n_chars, if there, follows the text."""
    taken = mix(docs, weights, max_epochs, seed, carry=True).where("taken > 0")
    copies = taken.selectExpr("*", "explode(sequence(1L, bigint(ceil(taken / size)))) as copy")
    first_words = f"regexp_extract(row.text, concat('^(?:[{SPACES}]*+[^{SPACES}]++){{', taken % size, '}}+'), 0)"
    cut_text = copies.selectExpr("row", f"if(copy * size <= taken, row.text, {first_words}) as text")
    cols = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return cut_text.select(*(cols.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
