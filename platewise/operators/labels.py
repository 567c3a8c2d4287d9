"""Rules on food labels: allergens in their declaration, and the order of nutrients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allergens with the words that name them, and nutrients in the order that is prescribed (fixed values of the regulation).
ALLERGENS = {
    "cereals containing gluten": "wheat|barley|rye|oats|spelt|kamut|gluten", "crustaceans": "crustacean|crab|lobster|prawn|shrimp|crayfish", "eggs": "eggs?", "fish": "fish", "peanuts": "peanuts?", "soybeans": "soy(?:beans?)?|soja",
    "milk": "milk|lactose|casein|whey", "nuts": r"almonds?|hazelnuts?|walnuts?|cashews?|pecans?|pistachios?|macadamia|brazil\s*nuts?", "celery": "celery", "mustard": "mustard", "sesame": r"sesame|sesame\s*seeds?",
    "sulphur dioxide": "sulph(?:ur|ite)|sulfit|SO2|E22[0-8]", "lupin": "lupins?", "molluscs": "mollusc|mussel|oyster|squid|snail|clam|scallop|octopus",
}
NUTRIENTS = ("energy", "fat", "saturates", "carbohydrate", "sugars", "protein", "salt")
# What opens a declaration, and claims that are none (fixed values).
ANCHORS = r"(?i)\bingredients?\s*:|\bcontains\s*:|\ballergens?\s*:|\bmay\s+contain\b|\bwarning\s*:\s*contains\b|\ballergen\s+warning\b|\btraces\s+of\b"
CLAIMS = r"(?i)\b(?:gluten|dairy|nut|lactose|soy|egg|wheat|peanut)[-\s]*free\b|\bfree\s+from\s+(?:gluten|dairy|nuts?|lactose|soy|eggs?|wheat|peanuts?)\b|\bno\s+(?:added\s+)?(?:gluten|dairy|nuts?|lactose|soy|eggs?|wheat|peanuts?)\b"
DECLARED, CLAIMED = 120, 40


def occurrences(text: str, pattern: str) -> Column:
    """Array of (at, word): where a pattern stands in a text, from 1, and the words that match."""
    words = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    size = F.transform(words, lambda w: F.length(w))
    at = lambda i: 1 + F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda s, n: s + n) + F.aggregate(F.slice(size, 1, i), F.lit(0), lambda s, n: s + n)
    return F.transform(words, lambda w, i: F.struct(at(i).alias("at"), w.alias("word")))


def _window(text: str, hit: Column, reach: int) -> Column:
    start = F.greatest(hit["at"] - reach, F.lit(1))
    return F.substring(F.col(text), start, hit["at"] + F.length(hit["word"]) + reach - start)


def allergen_emphasis(pages: DataFrame, allergens: dict[str, str] = ALLERGENS) -> DataFrame:
    """(job_id, page_num, allergen, at, word): EU1169_002, allergens of a declaration that are neither in capitals nor, as the page has
    bold type, in bold.

    ``pages`` has job_id, page_num, text and bold. A word counts if what opens a declaration stands within DECLARED characters and no
    claim within CLAIMED; pages without a list of ingredients are left out. All words are found in one scan of a page.
    """
    rows = pages.where(F.col("text").rlike(r"(?i)\bingredients?\b") & ~F.coalesce("bold", F.lit(False)))

    def named(name: str, words: str) -> Column:
        return F.transform(occurrences("text", rf"(?i)\b(?:{words})\b"), lambda h: F.struct(F.lit(name).alias("allergen"), h["at"].alias("at"), h["word"].alias("word")))

    hits = rows.select("job_id", "page_num", "text", F.explode(F.flatten(F.array(*[named(n, p) for n, p in allergens.items()]))).alias("h"))
    plain = (F.upper("h.word") != F.col("h.word")) | (F.length("h.word") <= 1)
    hit = F.col("h")
    kept = hits.where(plain & _window("text", hit, DECLARED).rlike(ANCHORS) & ~_window("text", hit, CLAIMED).rlike(CLAIMS))
    return kept.select("job_id", "page_num", "h.*")


def nutrient_order(pages: DataFrame, order: tuple[str, ...] = NUTRIENTS) -> DataFrame:
    """(job_id, page_num, first, second, found, kept): EU1169_003, the first two nutrients of a page that stand in the wrong order.

    Nutrients are taken by their first place in the text; ``kept`` is the length of the longest run in the right order, so
    ``found`` - ``kept`` must move. Only pages that speak of energy count.
    """
    at = lambda name: F.regexp_instr("text", F.lit(rf"(?i)\b{name}\b"))
    rows = pages.where(F.col("text").rlike(r"(?i)\b(?:energy|kj|kcal)\b")).select("job_id", "page_num", F.array(*[F.struct(F.lit(n).alias("name"), at(n).alias("at")) for n in order]).alias("every"))
    rows = rows.withColumn("there", F.filter("every", lambda x: x["at"] > 0)).withColumn("n", F.size("there"))
    pairs = F.zip_with(F.slice("there", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))), F.slice("there", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), lambda x, y: F.struct(x["name"].alias("first"), y["name"].alias("second"), (x["at"] > y["at"]).alias("wrong")))
    # the longest increasing run that ends at each place, from the ones before it
    step = lambda runs, x: F.concat(runs, F.array(F.struct(x["at"].alias("at"), (1 + F.coalesce(F.array_max(F.transform(F.filter(runs, lambda r: r["at"] < x["at"]), lambda r: r["n"])), F.lit(0))).alias("n"))))
    runs = F.aggregate("there", F.array().cast("array<struct<at:int,n:int>>"), step)
    rows = rows.withColumns({"bad": F.filter(pairs, lambda p: p["wrong"]), "kept": F.array_max(F.transform(runs, lambda r: r["n"]))})
    return rows.where(F.size("bad") > 0).select("job_id", "page_num", F.col("bad")[0]["first"].alias("first"), F.col("bad")[0]["second"].alias("second"), F.col("n").alias("found"), "kept")
