"""Personal data, found by pattern and by what the corpus gives away.

Patterns find protected entities: mail addresses, network addresses, card and phone numbers.
All terms of an entity's texts are then judged by information content: a term whose presence
predicts an entity nearly as well as the entity itself does (its pointwise mutual information,
as a share of the entity's information content) discloses it. Such terms are removed, or
generalised when they disclose less, wherever they stand in documents with that entity.

Everything is DataFrame functions; statistics cover all documents.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegrid.plans.joins import salted_join
from changegrid.plans.lineage import cut

KINDS = ("email", "ip", "card", "phone")
# Patterns of the kinds. Possessive forms and the look-behinds change no match: a match can only
# begin at the start of a run of its characters or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOKS_LIKE = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{N}]+"
LEAST_CONTEXTS = 1
REMOVE_AT, GENERALISE_AT = 0.95, 0.85
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}
_RUN = 16
_CHUNK = 512


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _most(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: F.greatest(a, x))


def _bound(value: Column, use) -> Column:
    """use(value), with `value` computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(values: Column, size: int = _RUN) -> Column:
    last = F.greatest(F.floor((F.size(values) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda r: F.slice(values, r * size + 1, size))


def _prefixes(values: Column, fold, depth: int = 4) -> Column:
    """For each entry of an int array the fold of all entries before it.

    Entries are folded in runs and runs in runs of their own, so that the work grows with the
    number of entries and not with its square.
    """
    inside = lambda v: F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i)))
    if not depth:
        return _bound(values, inside)

    def apply(runs: Column) -> Column:
        before = _prefixes(F.transform(runs, fold), fold, depth - 1)
        return F.flatten(F.zip_with(runs, before, lambda run, first: F.transform(inside(run), lambda x: fold(F.array(first, x)))))

    return _bound(values, lambda v: _bound(_runs(v), apply))


def _located(hits: Column, pieces: Column, kind: str) -> Column:
    """array<struct(start, end, kind, value)> of a pattern's matches, by code points; `pieces` are
    the texts between the matches."""
    steps = F.zip_with(hits, F.slice(pieces, F.lit(1), F.size(hits)), lambda h, p: F.char_length(p) + F.char_length(h))
    ends = _bound(steps, lambda s: F.zip_with(s, _prefixes(s, _total), lambda x, before: before + x))
    return F.zip_with(
        hits, ends, lambda h, e: F.struct((e - F.char_length(h)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), h.alias("value"))
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return _total(F.transform(F.sequence(F.lit(0), n - 1), worth)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match is kept."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit(256)) <= 255)
    if kind == "card":
        return F.char_length(_digits(value)).between(14, 19) & F.when(F.char_length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(10, 15)
    return F.lit(True)


def _holds_value(kind: str, span: Column) -> Column:
    return _holds(kind, span["value"])


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `_base`: array<struct(start, end, kind, value)> by start, then kind; `text` is never null."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    nothing = F.array().cast("array<string>")
    for kind in KINDS:
        maybe = F.contains("text", F.lit(LOOKS_LIKE[kind])) if LOOKS_LIKE[kind] else F.lit(True)
        rows = rows.withColumn(f"_{kind}", F.when(maybe, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(nothing))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    for kind in KINDS:
        hits = F.col(f"_{kind}")
        rows = rows.withColumn("_pieces", F.when(F.exists(hits, partial(_holds, kind)), F.split("text", PATTERNS[kind], -1)))
        found = F.filter(_located(hits, F.col("_pieces"), kind), partial(_holds_value, kind))
        rows = rows.withColumn(f"_{kind}", F.when(F.col("_pieces").isNotNull(), found).otherwise(empty))
    spans = F.concat(*(F.col(f"_{k}") for k in KINDS))
    return rows.withColumn("_base", _in_order(spans)).drop("_pieces", *(f"_{k}" for k in KINDS))


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed (terms last), then end."""
    rank = lambda s: reduce(lambda e, k: e.when(s["kind"] == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), 0)).otherwise(len(KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def _joined(spans: Column) -> Column:
    shown = lambda s: F.concat_ws(":", F.when(s["kind"] == "gone", "term").otherwise(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, shown), ",")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, found: DataFrame, least_contexts: int = LEAST_CONTEXTS, remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(_tie, term, gone): terms of a text that disclose an entity in it, `gone` if they are to be removed.

    All counts are over distinct texts of the whole corpus, so that copies count once. Every term
    that stands anywhere in a text with an entity is judged. Disclosure is
    log2(P(term | entity) / P(term)) over log2(1 / P(entity)), with P(term | entity) the share of
    the entity's texts that have the term. `least_contexts` may ask for that many texts with both.

    Entities of the very same texts have the same terms and shares; they are counted as one.
    """
    held = found.where("size(_base) > 0").dropDuplicates(["_tie"])
    held = cut(held.select("_tie", F.array_distinct(F.transform("_base", _entity)).alias("entities"), _terms(F.col("text")).alias("terms")))
    entities = held.select("_tie", F.explode("entities").alias("entity"))
    group = F.struct(F.bit_xor("_tie").alias("a"), F.bit_xor(F.xxhash64("_tie", F.lit(1))).alias("b"))
    groups = cut(entities.groupBy("entity").agg(F.count("*").alias("n_docs"), group.alias("group")))
    in_text = salted_join(entities, groups, ["entity"], ["_tie"]).groupBy("_tie").agg(F.collect_set(F.struct("group", "n_docs")).alias("groups"))
    pairs = held.join(cut(in_text), "_tie").select("_tie", "terms", F.explode("groups").alias("g")).select("_tie", "g.group", "g.n_docs", F.explode("terms").alias("term"))
    together = pairs.groupBy("group", "n_docs", "term").agg(F.count("*").alias("n_both")).where(f"n_both >= {least_contexts}")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text")).dropDuplicates(["_tie"])
    n_texts = found.select("_tie").distinct().count()
    # Counted per task before anything is shuffled; only the totals meet the candidate terms.
    spread = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    judged = salted_join(together, spread, ["term"], ["group"]).withColumn("n_texts", F.lit(n_texts))
    share = F.log2((F.col("n_both") / F.col("n_docs")) / (F.col("n_term") / F.col("n_texts"))) / F.greatest(F.log2(F.col("n_texts") / F.col("n_docs")), F.lit(1e-9))
    flagged = cut(judged.withColumn("share", share).where(F.col("share") >= generalise_at).select("group", "term", (F.col("share") >= remove_at).alias("gone")))
    return salted_join(pairs.drop("n_docs"), flagged, ["group", "term"], ["_tie"]).groupBy("_tie", "term").agg(F.bool_or("gone").alias("gone"))


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"])))


def _lists(flagged: DataFrame) -> DataFrame:
    """(_tie, _flagged): per text its flagged terms as maps to `gone`, one per hash bin of some 16 terms.

    A map is searched entry by entry; bins keep a look-up short in texts with many flagged terms.
    """
    sizes = cut(flagged.groupBy("_tie").agg(F.count("*").alias("n")).selectExpr("_tie", "int(ceil(n / 16)) as bins"))
    entries = salted_join(flagged, sizes, ["_tie"], ["term"]).select("_tie", F.expr("int(pmod(xxhash64(term), bins))").alias("bin"), F.struct("term", "gone").alias("entry"))
    all_bins = sizes.selectExpr("_tie", "explode(sequence(0, bins - 1)) as bin", "cast(null as struct<term: string, gone: boolean>) as entry")
    binned = entries.unionByName(all_bins).groupBy("_tie", "bin").agg(F.collect_list("entry").alias("entries"))
    listed = binned.groupBy("_tie").agg(F.array_sort(F.collect_list(F.struct("bin", "entries"))).alias("bins"))
    return listed.select("_tie", F.transform("bins", lambda b: F.map_from_entries(b["entries"])).alias("_flagged"))


def _gone(word: Column) -> Column:
    """Whether a flagged word is to be removed; null for words that are not flagged."""
    return _bound(F.lower(word), lambda w: F.try_element_at(F.get("_flagged", F.pmod(F.xxhash64(w), F.size("_flagged")).cast("int")), w))


def _apart(words: Column) -> Column:
    """Words that touch no base span."""
    some = _runs(F.col("_base"), 64)
    ranges = F.transform(some, lambda run: F.struct(run.alias("run"), F.get(run, F.lit(0))["start"].alias("start"), _most(F.transform(run, lambda b: b["end"])).alias("end")))
    meets = lambda w, b: (b["start"] < w["end"]) & (w["start"] < b["end"])
    return _bound(ranges, lambda rs: F.filter(words, lambda w: ~F.exists(rs, lambda r: meets(w, r) & F.exists(r["run"], lambda b: meets(w, b)))))


def find_spans(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """(*carry, text, _base, _spans), one row per input row; `text` is null where there are no spans.

    Spans are array<struct(start, end, kind, value)> in code points, kind being a base kind, "term"
    (generalise) or "gone" (remove). `docs` has `text` beside the carried columns. The work in a
    text grows with its length, however many spans it has.
    """
    rows = base_spans(docs.select(*carry, "text")).withColumn("_tie", F.xxhash64("text"))
    found = cut(rows.select(*carry, "_tie", "_base", F.when(F.size("_base") > 0, F.col("text")).alias("text")))
    listed = cut(_lists(disclosing_terms(docs, found, **limits)))
    known = salted_join(found, listed, ["_tie"], ["text"], "left")
    held = F.col("_flagged").isNotNull()
    split = known.withColumn("_hits", F.when(held, F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).withColumn("_pieces", F.when(held, F.split("text", TERM, -1)))
    words = F.transform(_located(F.col("_hits"), F.col("_pieces"), "term"), lambda w: F.struct(w["start"], w["end"], _gone(w["value"]).alias("gone"), w["value"]))
    flagged = F.filter(words, lambda w: w["gone"].isNotNull())
    terms = F.transform(_apart(flagged), lambda w: F.struct(w["start"], w["end"], F.when(w["gone"], "gone").otherwise("term").alias("kind"), w["value"]))
    spans = F.when(held & (F.size("_hits") > 0), _in_order(F.concat("_base", terms))).otherwise(F.col("_base"))
    return split.select(*carry, "text", "_base", spans.alias("_spans"))


def personal_data(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row.

    A null text is empty and has no spans. Null doc_ids and repeated rows stay; texts with many
    matches keep all; an empty table gives no rows; extra columns are not carried.
    """
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_spans(docs, **limits).select(
        "doc_id", *map(count, KINDS), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans")
    )


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is given in chunks of _CHUNK code points."""
    a, b = F.floor(start / _CHUNK).cast("int"), F.floor(end / _CHUNK).cast("int")
    one = F.substring(F.get(chunks, a), start % _CHUNK + 1, end - start)
    more = F.concat(
        F.substring(F.get(chunks, a), start % _CHUNK + 1, F.lit(_CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""),
        F.substring(F.coalesce(F.get(chunks, b), F.lit("")), F.lit(1), end % _CHUNK),
    )
    return F.when(end <= start, "").when(a == b, one).otherwise(more)


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """Rows of `docs` with personal data replaced by labels and disclosing terms generalised or removed.

    n_chars, if there, follows the text; all other columns stay, and so does every row: null and
    equal ids, repeated rows, null and empty texts included. An empty table gives no rows. A text
    of any length is put together from the pieces between its spans in one pass.
    """
    found = cut(find_spans(docs.select(F.struct("*").alias("row"), "text"), ("row",), **limits).select("row", F.when(F.size("_spans") > 0, F.col("text")).alias("text"), "_spans"))
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    # The end of what is covered before each span; spans that begin inside it add nothing of their own.
    ends = F.transform("_spans", lambda s: s["end"])
    covered = found.withColumn("_chunks", chunks).withColumn("_covered", F.when(F.col("text").isNotNull(), _prefixes(ends, _most)))
    label = lambda s: reduce(lambda e, k: e.when(s["kind"] == k, LABELS[k]), LABELS, F.when(F.lit(False), ""))
    part = lambda s, before: F.when(s["start"] >= before, F.concat(_between(F.col("_chunks"), before, s["start"]), label(s))).otherwise("")
    parts = F.zip_with("_spans", "_covered", part)
    tail = _between(F.col("_chunks"), F.array_max(ends), F.char_length("text"))
    new = covered.select("row", F.when(F.col("text").isNotNull(), F.concat(F.array_join(parts, ""), tail)).alias("_new"))
    cols = {"text": F.coalesce("_new", "row.text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("_new").isNotNull(), F.char_length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return new.select(*(cols.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
