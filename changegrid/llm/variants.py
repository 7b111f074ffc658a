"""Spelling variants by a relational trie frontier.

All words, and all words written backwards, form two tries held as one edge table: nodes are
prefixes at which words end or part, an edge carries the characters up to the next node. Every
word walks both from the root. The frontier is a table of (word, position, node, edits) states;
level by level it is joined with the edges of that depth, and a state lives on while at most one
character differs. States that reach a word's end with exactly one edit are near words.

A pair that differs at one place agrees before or behind it in half of the word, so the forward
walk may edit in the second half only and the backward walk in the first half only. States then
branch where tries are thin, not at their roots.

A level consumes an edge, not a character: there are as many levels as branchings on one path.
A node has at most one edge per character, so no join multiplies a state by more than that.

All tables grow with the words. An exploded one, or one read from files, looks far smaller to the
optimiser than its rows are, so joins shuffle unless the rows of a level were measured and are few.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegrid.plans.joins import measured_join, row_bytes, salted_join
from changegrid.plans.lineage import cut

RUN = r"[a-zÀ-ÿ]"
NOISE_EVERY = 199
LEAST_CHARS, LEAST_COUNT, FORM_RATIO = 6, 5, 5


def counted_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, noise_every: int = NOISE_EVERY) -> DataFrame:
    """(word, n): words of at least `least_chars` code points that occur `least_count` times.

    A run whose crc32 together with its doc_id is divisible by `noise_every` loses the character
    at that crc32 modulo its length. A null doc_id counts as an empty string, a null text as empty.
    """
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # Shorter runs can give no word of that length, and a match is always a maximal run.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("tag"), F.explode(F.regexp_extract_all(low, F.lit(f"({RUN}{{{least_chars},}})"))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "tag", "run").cast("binary")).alias("h"))
    gap = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), gap), F.substring("run", gap + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % noise_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _node(side: Column, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def trie_edges(words: DataFrame) -> DataFrame:
    """(depth, node, first, label, child, ends, nexts): edges of both tries; `ends` says that a word ends
    at the child, `nexts` lists the characters that follow there, one per edge.

    `words` is (side, w). Two prefixes of one 64-bit hash would share a node; that adds edges and
    loses none.
    """
    length = F.char_length("w")
    steps = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(i.alias("i"), _node(F.col("side"), F.substring("w", F.lit(1), i)).alias("node")))
    prefixes = words.select("side", "w", F.explode(steps).alias("s")).select("side", "w", "s.i", "s.node")
    after = F.substring("w", F.col("i") + 1, F.lit(1))
    kept = prefixes.groupBy("node").agg(F.min(after).alias("a"), F.max(after).alias("b"), F.min("i").alias("least"), F.min(length - F.col("i")).alias("left"))
    kept = cut(kept.where("least = 0 or left = 0 or a <> b").select("node"))
    paths = salted_join(prefixes.hint("merge"), kept, ["node"], ["w"]).groupBy("side", "w").agg(F.array_sort(F.collect_list(F.struct("i", "node"))).alias("path"))
    hops = F.transform(
        F.sequence(F.lit(0), F.size("path") - 2),
        lambda k: F.struct(
            k.alias("depth"), F.get("path", k)["node"].alias("node"), F.get("path", k + 1)["node"].alias("child"),
            F.substring("w", F.get("path", k)["i"] + 1, F.get("path", k + 1)["i"] - F.get("path", k)["i"]).alias("label"),
            (F.get("path", k + 1)["i"] == length).alias("ends"),
        ),
    )
    edges = paths.select(F.explode(hops).alias("e")).select("e.*").groupBy("depth", "node", "label", "child").agg(F.bool_or("ends").alias("ends"))
    edges = cut(edges.select("depth", "node", F.substring("label", 1, 1).alias("first"), "label", "child", "ends"))
    nexts = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("first"), "").alias("nexts"))
    return salted_join(edges.hint("merge"), nexts, ["child"], ["label"], "left").withColumn("nexts", F.coalesce("nexts", F.lit("")))


def _rest(n: Column) -> Column:
    return F.substring("w", F.col("pos") + 1, n)


def _moved(met: DataFrame, moves: list[Column]) -> DataFrame:
    """States behind an edge. One with an edit lives while an edge goes on with its next character,
    or where its word and a word of the trie end together."""
    moved = met.select("side", "w", "from", "child", "ends", "nexts", F.explode(F.filter(F.array(*moves), lambda x: x.isNotNull())).alias("to"))
    state = moved.select("side", "w", "from", F.col("to.pos").alias("pos"), F.col("child").alias("node"), F.col("to.edits").alias("edits"), "ends", "nexts")
    left = F.char_length("w") - F.col("pos")
    goes_on = F.when(left > 0, F.contains(F.col("nexts"), _rest(F.lit(1)))).otherwise(F.col("ends"))
    return state.where((F.col("edits") == 0) | goes_on).drop("nexts")


def _to(ok: Column, step: Column, edits: Column | int) -> Column:
    return F.when(ok, F.struct((F.col("pos") + step).alias("pos"), (edits if isinstance(edits, Column) else F.lit(edits)).alias("edits")))


def _along(met: DataFrame) -> DataFrame:
    """Over the edge that begins with the state's next character.

    Where the label does not follow in the word, the word may go on with one character replaced,
    with one that it lacks (a character is inserted), or without one that it has.
    """
    m = F.char_length("label")
    exact = _rest(m) == F.col("label")
    fixed = F.greatest(F.col("from") - F.col("pos"), F.lit(0))
    may_edit = (F.col("edits") == 0) & ~exact & (_rest(fixed) == F.substring("label", F.lit(1), fixed))
    one_off = lambda n: may_edit & (F.char_length(_rest(n)) == n) & (F.levenshtein(_rest(n), F.col("label"), 1) == 1)
    return _moved(met, [_to(exact, m, F.col("edits")), _to(one_off(m), m, 1), _to(one_off(m - 1), m - 1, 1), _to(one_off(m + 1), m + 1, 1)])


def _beside(met: DataFrame) -> DataFrame:
    """Over an edge that begins with another character: the edit is made there, what follows must agree."""
    m = F.char_length("label")
    tail = F.substring("label", F.lit(2), m)
    after = F.substring("w", F.col("pos") + 2, m)
    left = F.char_length("w") - F.col("pos")
    return _moved(met, [_to((left >= m) & (F.substring("w", F.col("pos") + 2, m - 1) == tail), m, 1), _to(_rest(m - 1) == tail, m - 1, 1), _to(after == F.col("label"), m + 1, 1)])


def _bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs that differ by one inserted, deleted or replaced code point.

    `words` has distinct, non-null, non-empty words. A walk ends when its frontier is empty.
    """
    both = words.selectExpr("word", "explode(array(0, 1)) as side").selectExpr("side", "if(side = 0, word, reverse(word)) as w")
    tries = cut(both)
    spark = words.sparkSession
    edges = cut(trie_edges(tries))
    ends = cut(tries.select(_node(F.col("side"), F.col("w")).alias("node"), "side", F.col("w").alias("near")))
    # Half of the word is matched exactly before the first edit; the halves of both sides cover it.
    half = F.floor((F.char_length("w") + 1 - F.col("side")) / 2).cast("int")
    states = tries.select("side", "w", half.alias("from"), F.lit(0).alias("pos"), _node(F.col("side"), F.lit("")).alias("node"), F.lit(0).alias("edits"))
    edge_bytes = dict(map(tuple, edges.groupBy("depth").agg(F.sum(row_bytes(edges))).collect()))  # a row per level
    state_bytes = _bytes(states)
    found, depth = [], 0
    while True:
        here = edges.where(F.col("depth") == depth).drop("depth")
        sizes = state_bytes, edge_bytes.get(depth, 0)
        next_char = _rest(F.lit(1))
        along = measured_join(states.withColumn("first", next_char), here, ["node", "first"], ["w"], *sizes)
        wide = states.where("edits = 0 and pos >= `from`")
        beside = measured_join(wide, here, ["node"], ["w"], *sizes).where(F.col("first") != next_char)
        columns = ["side", "w", "from", "pos", "node", "edits", "label", "child", "ends", "nexts"]
        states = cut(_along(along.select(columns)).unionByName(_beside(beside.select(columns))))
        state_bytes = _bytes(states)
        if not state_bytes:
            break
        left = F.char_length("w") - F.col("pos")
        at_end = F.col("ends") & (((F.col("edits") == 1) & (left == 0)) | ((F.col("edits") == 0) & (left == 1)))
        found.append(states.where(at_end).select("side", "w", "node"))
        states = states.where((left > 0) | (F.col("edits") == 0)).drop("ends")
        depth += 1
    if not found:
        return spark.createDataFrame([], "word string, near string")
    met = salted_join(reduce(DataFrame.unionByName, found).hint("merge"), ends, ["side", "node"], ["w"])
    forward = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    # The distance is tested once more, so that nodes of one hash cannot add a pair.
    return met.where(F.levenshtein("w", "near", 1) == 1).select(forward("w").alias("word"), forward("near").alias("near")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Counts grow along a chain, so none is a circle."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = cut(salted_join(now.hint("merge"), ahead, ["root"], ["word"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, ratio: int = FORM_RATIO, **limits) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per counted word.

    `form` is the near word of largest n (ties: the smallest in code-point order) if that is at
    least `ratio` times the word's own, else null; `root` follows forms to the last. Null and empty
    texts have no words; a null doc_id counts as an empty one; repeated rows count as often as they
    come; an empty table gives no rows; other columns are not read. Words may be of any length: one
    row holds a hash per prefix of one word.
    """
    words = cut(counted_words(docs.select("doc_id", "text"), **limits))
    near = cut(near_words(words))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near.hint("merge").join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    has_form = F.col("near_n") >= ratio * F.col("n")
    formed = cut(judged.select("word", "n", "n_near", F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n")))
    roots = _roots(formed.where("form is not null"))
    return formed.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
