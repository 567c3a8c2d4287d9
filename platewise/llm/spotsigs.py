"""Document fingerprints by SpotSigs, with DataFrame functions only.

A signature is a common word, the anchor, and the CHAIN content words that follow it, common words between them left out. So it
tells running text from lists and menus, and an edit changes only the signatures that span it. The text's start is an anchor as
well; a text without content words is one signature, and a text without words that way too, but for the empty text, which has
none. A fingerprint is the set of signatures, each as 8 hex digits of its MD5, in order.

Two sets of lengths a <= b share at most a of at least b signatures, so their Jaccard likeness is at most a / b. ``similar_documents``
cuts lengths into ranges so wide that sets as alike as is asked for lie in the same range or in neighbours, looks sets up by
the few first signatures of which two alike sets must share one, and compares only pairs whose lengths allow it.

``edited_fingerprints`` needs each document's next in descending order of identifier. Rows are dealt to narrow ranges of (identifier,
hash of the text), whose bounds come from a bounded sample and only balance them; the first row of each range goes to the range
above it as well. So texts are shuffled once, and a window over a range finds what follows each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from platewise.llm.common import cut, join_groups, table
from platewise.llm.jaccard import PAIRED, connected
from platewise.llm.simhash import components

#: Common words of seven languages: articles, prepositions, conjunctions, pronouns and auxiliaries (fixed values).
COMMON = (
    "the of and to a in is it that was for on with as be by at this are from or an have not but had his her they which were been "
    "der die das und in den von zu mit sich auf für ist nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am im dem des "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son "
    "el que los y se del las por con no una su para es al lo como más o pero sus le ha "
    "il di che è non per della sono dei nel alla da gli anche ma "
    "o os um uma do da em não com na no dos ao mais "
    "het een van en dat te op voor niet met zijn aan ook door maar"
).split()
CHAIN = 3
#: Rows of a range of identifiers, and the most ranges; beyond that they are wider. The sample has SAMPLE rows.
RANGE_ROWS, MOST_RANGES, SAMPLE = 64, 8_192, 65_536


def with_signatures(rows: DataFrame, text: str, out: str, common: tuple[str, ...] = tuple(COMMON), chain: int = CHAIN) -> DataFrame:
    """``rows`` with the array column ``out``: the distinct signatures of the column ``text`` in order; null counts as empty."""
    words, items, spots = (f"_platewise_{out}_{k}" for k in ("words", "items", "spots"))
    start = "^"  # no word
    known = [*common, start]
    rows = rows.withColumn(words, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1)))
    # content words, each with the word before it
    pairs = F.zip_with(F.concat(F.array(F.lit(start)), words), words, lambda before, w: F.struct(before.alias("before"), w.alias("w")))
    rows = rows.withColumn(items, F.filter(pairs, lambda x: x["w"].isNotNull() & ~x["w"].isin(*common)))
    told = F.transform(items, lambda x: F.struct(x["before"].alias("before"), F.concat_ws(" ", x["before"], x["w"]).alias("s")))
    for k in range(2, chain + 1):
        told = F.zip_with(told, F.slice(F.col(items)["w"], k, F.greatest(F.size(items), F.lit(1))), lambda x, w: F.struct(x["before"].alias("before"), F.concat_ws(" ", x["s"], w).alias("s")))
    rows = rows.withColumn(spots, F.filter(told, lambda x: x["before"].isin(*known)))
    digest = lambda s: F.substring(F.md5(s), 1, 8)
    whole = F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(F.array(digest(F.lower(F.col(text)))))
    found = F.when(F.size(items) == 0, whole).otherwise(F.array_sort(F.array_distinct(F.transform(spots, lambda x: digest(x["s"])))))
    return rows.withColumn(out, found).drop(words, items, spots)


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; null where their lengths show that it is under ``least``. Two empty sets are alike."""
    one, two = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    value = F.when((one == 0) & (two == 0), 1.0).when((one == 0) | (two == 0), 0.0).otherwise(common / (one + two - common))
    return F.when(F.least(one, two) >= least * F.greatest(one, two), value)


def fingerprint(signatures: str) -> Column:
    return F.array_join(signatures, "")


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds (order, hash) that a row is not below: binary search by halving steps."""
    if not bounds:
        return F.lit(0)
    orders, hashes = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<long>") for i in (0, 1))
    n = len(bounds)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]

    def step(at: Column, more: Column) -> Column:
        place = F.least(at + more, F.lit(n))
        order, hashed = F.element_at(orders, place), F.element_at(hashes, place)
        reached = (order < F.col("order")) | (order == F.col("order")) & (hashed <= F.col("hash"))
        return F.when((at + more <= n) & reached, at + more).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ident, text, sigs, next_text, next_sigs): each row beside the next in descending order of identifier, after the last the first.

    Null identifiers come last; rows that repeat an identifier come in order of their text's hash. Texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("ident"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"order": F.coalesce("ident", F.lit(-(1 << 63))), "hash": F.xxhash64("text")})
    total = rows.count()
    ranges = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    share = min(1.0, 1.2 * SAMPLE / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(11), "order", "hash"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("order", "hash")
    # a bounded sample, the same on every run, that only balances the ranges
    sample = sorted((r.order, r.hash) for r in drawn.orderBy(F.xxhash64("order", "hash")).limit(SAMPLE).collect())
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)} if sample else ())
    rows = rows.withColumn("range", _range_of(bounds))
    # the first row of each range, and the range above that it goes to; the highest range's goes to the lowest
    firsts = rows.groupBy("range").agg(F.max(F.struct("order", "hash")).alias("top")).orderBy("range").collect()
    above = [r.range for r in firsts[1:]] + [r.range for r in firsts[:1]]
    told = docs.sparkSession.createDataFrame([(r.range, r.top.order, r.top.hash, to) for r, to in zip(firsts, above, strict=True)], "range int, top_order long, top_hash long, above int")
    first = (F.col("order") == F.col("top_order")) & (F.col("hash") == F.col("top_hash"))
    own, there = F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("above").alias("range"), F.lit(True).alias("guest"))
    # ``told`` has at most MOST_RANGES rows
    dealt = rows.join(F.broadcast(told), "range").withColumn("place", F.explode(F.when(first, F.array(own, there)).otherwise(F.array(own))))
    dealt = dealt.select("place.*", "ident", "order", "hash", "text").repartition("range")
    order = W.partitionBy("range").orderBy("guest", F.col("order").desc(), F.col("ident").isNull(), F.col("hash").desc())
    marked = with_signatures(dealt, "text", "sigs").withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)})
    return marked.where("NOT guest").select("ident", "text", "sigs", "next_text", "next_sigs")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: fingerprints of the text and of its edited text, whose second half is from the next document.

    (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The last floor(n_chars / 2) code
    points give way to the first as many, or all, of the next document in descending order of identifier; after the last comes the
    first, and a single document is its own next. Null texts are empty; two empty texts have likeness 1, an empty and another 0.
    Rows that repeat an identifier come in order of their text's hash, null identifiers last. Other columns are not read. An empty
    table gives an empty result.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, id_col, text_col).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        F.col("ident").alias(id_col), F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), fingerprint("sigs").alias("fingerprint"),
        fingerprint("edited_sigs").alias("edited_fingerprint"), likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"),
    )


def similar_documents(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint, class_id), class_id the least identifier reachable by likeness ``least``.

    Documents of equal signatures are one set, and only sets are compared: those that share one of their first signatures and
    whose lengths are in the same or in neighbouring ranges. Groups of more than PAIRED sets with a signature in common are
    connected as ``jaccard.connected`` does, without all of their pairs. Texts without signatures are alike; a null identifier is
    never a class's least unless it has no other. Repeated rows come back as often as they came; an empty table gives none.
    """
    told = with_signatures(docs.select(F.col(id_col).cast("long").alias("ident"), F.col(text_col).alias("text")), "text", "sigs").select("ident", fingerprint("sigs").alias("fp"))
    told = cut(told.withColumn("set", F.xxhash64("fp")))
    sets = cut(told.groupBy("set").agg(F.min("ident").alias("least"), F.count("*").alias("rows"), F.first("fp").alias("fp")))
    some = cut(sets.where("fp != ''").select(F.col("set").alias("ident"), F.regexp_extract_all("fp", F.lit("(.{8})"), F.lit(1)).alias("sigs")).withColumn("size", F.size("sigs")))
    # two sets this alike share one of the first size - ceil(least * size) + 1 signatures in any common order
    first = F.slice("sigs", F.lit(1), (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int"))
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / least) + 1e-9) if least < 1 else F.col("size")
    at = some.withColumn("sig", F.explode(first)).withColumn("range", F.explode(F.array(step, step + 1)))
    keyed = cut(at.select(F.xxhash64("range", "sig").alias("key"), "ident", "size"))
    groups = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    grouped = cut(join_groups(keyed, groups, "key", "n").select("key", "ident", "size", "n"))

    def near(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct())
        leaders = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).join(some, F.col("a") == F.col("ident")).select("a", "n", F.col("sigs").alias("one")))
        both = join_groups(pairs.join(some, F.col("b") == F.col("ident")).select("a", "b", F.col("sigs").alias("two")), leaders, "a", "n")
        return both.where(likeness("one", "two", least) >= least - 1e-9).select("a", "b")

    few = grouped.where(F.col("n") <= PAIRED)
    one, two = few.select("key", F.col("ident").alias("a"), F.col("size").alias("s")), few.select("key", F.col("ident").alias("b"), F.col("size").alias("t"))
    fits = (F.least("s", "t") >= least * F.greatest("s", "t") - 1e-6) & (F.col("a") < F.col("b"))
    roots = cut(components(near(one.join(two, "key").where(fits).select("a", "b"))))
    many = grouped.where(F.col("n") > PAIRED).withColumns({"shared": F.col("size"), "room": F.col("size") / least + 1e-6})
    if many.limit(1).count():
        roots = cut(connected(many, roots, near))
    linked = cut(sets.join(roots, F.col("set") == F.col("node"), "left").select("set", "least", "rows", F.coalesce("root", "set").alias("root")))
    ends = cut(linked.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n")))
    named = cut(join_groups(linked, ends, "root", "n").select("set", "rows", "class_id"))
    return join_groups(told, named, "set", "rows").select(F.col("ident").alias(id_col), F.col("fp").alias("fingerprint"), "class_id")


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(set(COMMON))) + "]"
_CHAIN = "concat_ws(' ', x.b, x.w, " + ", ".join(f"i[j + {k}].w" for k in range(1, CHAIN)) + ")"


def _signatures_sql(text: str) -> str:
    """DuckDB: a table of (id, sigs) from one of (id, words, t)."""
    return f"""SELECT id, CASE WHEN len(i) = 0 THEN CASE WHEN t = '' THEN [] ELSE [substr(md5(lower(t)), 1, 8)] END
  ELSE list_sort(list_distinct(list_transform(list_filter(list_transform(i, lambda x, j: {{'b': x.b, 's': {_CHAIN}}}), lambda x: x.b = '^' OR list_contains({_LIST}, x.b)), lambda x: substr(md5(x.s), 1, 8)))) END AS sigs
  FROM (SELECT id, t, list_filter(list_transform(words, lambda w, k: {{'b': CASE WHEN k = 1 THEN '^' ELSE words[k - 1] END, 'w': w}}), lambda x: NOT list_contains({_LIST}, x.w)) AS i
  FROM (SELECT id, {text} AS t, regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{M}}\\p{{N}}]+)', 1) AS words FROM d))"""


_LIKE = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0::DOUBLE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE END"

OP12_SQL = f"""
WITH n AS (SELECT doc_id AS id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
d AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
s AS ({_signatures_sql("text")}), e AS ({_signatures_sql("edited")})
SELECT d.id AS doc_id, length(d.text) AS n_chars, sha256(d.edited) AS edited_sha256, array_to_string(s.sigs, '') AS fingerprint, array_to_string(e.sigs, '') AS edited_fingerprint,
  {_LIKE.format("s.sigs", "e.sigs")} AS near_edited, {_LIKE.format("s.sigs", "x.sigs")} AS near_next
FROM d JOIN s ON d.id = s.id JOIN e ON d.id = e.id JOIN s x ON d.next_id = x.id
"""
