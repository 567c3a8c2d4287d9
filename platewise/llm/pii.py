"""PII surrogates, with DataFrame functions only.

Detected entities get keyed replacements of their type and format: digits for digits, letters of the same script and case
for letters, hexadecimal for hexadecimal, valid octets, card and IBAN numbers whose check digits hold where the original's
did. A name is a title or a known given name with the capitalised words after it, in Latin, Cyrillic or Greek; it is replaced
word by word, so "Mr. John Smith", "John Smith" and "Mr. Smith" stay the same person, and words of a document's names are
replaced wherever else they stand in it. Given names keep their gender, and surnames that show one keep it.

A replacement depends on the key, the type and the canonical entity alone, so an entity is replaced alike wherever it
stands, in whatever spelling (coreference). Over the whole corpus the distinct entities are checked for collisions: no two of
a type may share a replacement, and none may be replaced by what is itself an entity of the corpus; losers draw again until
all are distinct. Names get longer with each draw, so they never run out. Entities of a format so full that ROUNDS draws find
no free replacement are masked by a keyed label, which is distinct as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import cut, join_checked, table

KEY = "surrogate-key-1"

#: Draws before an entity of a fixed format is masked, and the most overrides that are broadcast.
ROUNDS, BROADCAST_OVERRIDES = 50, 10_000
MASKED = -1

TITLES = ("Mrs", "Mr", "Ms", "Miss", "Sir", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señora", "Señor", "Sra", "Sr", "Г-н", "Г-жа", "Κύριος", "Κυρία")
PARTICLES = ("von", "van", "der", "den", "zu", "zum", "de", "del", "della", "di", "da", "dos", "la", "le", "du", "bin", "al", "ter", "y")
#: Given names that mark a name without a title; hand in longer lists where more are known.
MALE = (
    "Adam", "Albert", "Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Bruno", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Eric", "Felix", "Francis",
    "Franz", "George", "Hans", "Henry", "Hugo", "Jack", "James", "Jan", "Jean", "Johann", "John", "Jonas", "José", "Joseph", "Juan", "Karl", "Kevin", "Klaus", "Lars", "Louis", "Luis",
    "Manuel", "Mark", "Martin", "Matthew", "Michael", "Miguel", "Nicholas", "Oscar", "Pablo", "Patrick", "Paul", "Pedro", "Peter", "Philip", "Pierre", "Richard", "Robert", "Samuel",
    "Simon", "Stephen", "Stefan", "Steven", "Thomas", "Timothy", "Victor", "Walter", "William", "Wolfgang", "Иван", "Пётр", "Сергей", "Борис", "Олег", "Γιώργος", "Νίκος", "Δημήτρης",
)
FEMALE = (
    "Alice", "Amanda", "Ana", "Andrea", "Angela", "Anna", "Anne", "Barbara", "Carmen", "Caroline", "Catherine", "Charlotte", "Christine", "Clara", "Claudia", "Diana", "Dorothy",
    "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Hannah", "Heidi", "Helen", "Ingrid", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Laura", "Lena", "Linda",
    "Lisa", "Lucy", "Margaret", "Maria", "María", "Marie", "Mary", "Monika", "Nancy", "Nicole", "Olga", "Patricia", "Petra", "Rachel", "Rosa", "Sandra", "Sarah", "Sofia", "Sophie",
    "Susan", "Teresa", "Ursula", "Vera", "Victoria", "Анна", "Елена", "Мария", "Ольга", "Ελένη", "Μαρία", "Άννα",
)

#: Syllables and endings by script: male and female given names, surnames that show either gender, other names.
SYLLABLES = {
    "latin": ("bar", "ben", "dor", "fal", "gar", "hol", "kar", "lin", "mor", "nel", "per", "ros", "sel", "tan", "vel", "win"),
    "cyrillic": ("бар", "вин", "гор", "дол", "зел", "кар", "лин", "мор", "нов", "пет", "рос", "сел", "тар", "фед", "хол", "чер"),
    "greek": ("βαρ", "γαλ", "δορ", "ζαν", "καλ", "λιν", "μαν", "νικ", "παπ", "ραλ", "σαν", "ταρ", "φαν", "χαρ", "θεο", "μορ"),
}
ENDINGS = {
    "latin": {"m": ("o", "us", "ian", "ard"), "f": ("a", "ia", "ina", "ette"), "x": ("", "er", "ing", "son")},
    "cyrillic": {"m": ("ий", "он", "ек", "ор"), "f": ("ия", "ина", "а", "аня"), "sm": ("ов", "ин"), "sf": ("ова", "ина"), "x": ("ко", "их")},
    "greek": {"m": ("ος", "ης"), "f": ("α", "ια"), "sm": ("ης", "ος"), "sf": ("ου", "α"), "x": ("ου",)},
}

WORD = r"\p{Lu}\p{L}*+(?:['’](?!s\b)\p{L}++|-\p{L}++)*+"
TAIL = rf"(?: (?:(?:{'|'.join(PARTICLES)}) )*+{WORD})"
INITIALS = "".join(sorted({t[0] for t in TITLES + MALE + FEMALE}))
LOCAL = r"[^\s@<>()\[\],;:\"'|/\\]"
HEX4 = "[0-9A-Fa-f]{1,4}"

#: Types in order of precedence where two could start at the same place. Each starts with what fails fast in prose.
PATTERNS = {
    "email": rf"(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,24}}",
    "iban": r"(?=[A-Z]{2}\d{2})\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip6": rf"(?=[0-9A-Fa-f:]*\d)(?<![\w:])(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}(?::{HEX4}){{0,6}})?::(?:{HEX4}(?::{HEX4}){{0,6}})?)(?![\w:])",
    "ip": r"(?=\d)(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "card": r"(?=\d)(?<!\d)(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?!\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[\d+(])(?<![\d.+])(?:\+(?:[ .()/-]{0,2}\d){7,15}|\(\d{2,5}\)(?:[ .-]?\d){5,10}|0\d{1,4}[ /.-](?:[ -]?\d){5,10}|00(?:[ -]?\d){7,13}|\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|\d{3}-\d{4})(?![\d-])",
    "name": rf"(?=[{INITIALS}])\b(?:(?:{'|'.join(TITLES)})\.?{TAIL}++|(?:{'|'.join(MALE + FEMALE)})(?:-{WORD})?+{TAIL}++)",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has a digit or an @ or is a name; texts without are not searched.
HINT = rf"[\d@]|{PATTERNS['name']}"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def type_of(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(rf"^{PATTERNS['iban']}$"), "iban")
        .when(e.contains(":"), "ip6")
        .when(e.rlike(r"^\p{L}"), "name")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(rf"^{PATTERNS['card']}$"), "card")
        .otherwise("phone")
    )


def canonical(e: Column, kind: Column) -> Column:
    """What spellings of an entity have in common; with the type it is its identity. Names come word by word."""
    bare = F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(e, r"\D", "")).when(kind == "iban", F.regexp_replace(e, " ", ""))
    return F.coalesce(bare, F.lower(F.translate(e, "’", "'")))


def is_name_word(w: Column) -> Column:
    return w.rlike(r"^\p{Lu}") & ~F.regexp_replace(w, r"\.$", "").isin(*TITLES)


def units(e: Column, kind: Column) -> Column:
    """What is replaced as one: the words of a name, any other entity as a whole."""
    return F.when(kind == "name", F.filter(F.split(e, " "), is_name_word)).otherwise(F.array(e))


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """512 keyed pseudo-random bits as hex."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|more")), 256))


def _number(stream: Column, at: Column, below: int) -> Column:
    """The number below ``below`` that the stream has at a position."""
    return F.pmod(F.conv(F.substring(stream, F.pmod(at, F.lit(62)) * 2 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(below))


def _letter(c: Column, n: Column) -> Column:
    """A letter of the same script and case."""
    out = c
    for first, last in (("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω"), ("a", "z"), ("A", "Z")):
        span = "".join(chr(x) for x in range(ord(first), ord(last) + 1) if chr(x).isalpha())
        out = F.when(c.between(first, last), F.substring(F.lit(span), F.pmod(n, F.lit(len(span))) + 1, F.lit(1))).otherwise(out)
    plain = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(n, F.lit(26)) + 1, F.lit(1))
    return F.when(c.rlike(r"^[a-zA-Zа-яА-Яα-ωΑ-Ω]$"), out).when(c.rlike(r"^\p{Lu}$"), F.upper(plain)).when(c.rlike(r"^\p{L}$"), plain).otherwise(c)


def _filled(e: Column, stream: Column) -> Column:
    """Every digit and letter replaced in kind; the n-th of them takes the n-th number, wherever separators stand."""
    chars = F.split(e, "")
    rank = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i), r"[^\p{L}\p{N}]", "")))

    def put(c: Column, r: Column) -> Column:
        return _let(_number(stream, r, 65536), lambda n: F.when(c.rlike(r"^\d$"), F.pmod(n, F.lit(10)).cast("string")).otherwise(_letter(c, n)))

    return F.array_join(F.zip_with(chars, rank, put), "")


def _hexed(e: Column, stream: Column) -> Column:
    """Every hexadecimal digit replaced by one, in the case of the original's letters."""
    digits = F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("^[0-9A-Fa-f]$"), F.substring(F.lit("0123456789abcdef"), _number(stream, i, 16) + 1, F.lit(1))).otherwise(c))
    return _let(F.array_join(digits, ""), lambda x: F.when(e.rlike("[A-F]"), F.upper(x)).otherwise(x))


def luhn_digit(body: Column) -> Column:
    """Check digit of a card number without it."""
    doubled = F.transform(F.reverse(F.split(body, "")), lambda c, i: _let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(10 - F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10, F.lit(10)).cast("string")


def iban_digits(bare: Column) -> Column:
    """Check digits of an IBAN without spaces, whatever its own."""
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 2), F.lit("00"))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c.rlike(r"^\d$"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _closed_card(e: Column, x: Column) -> Column:
    """The drawn card number, with a check digit that holds if the original's does."""
    bare, digits = F.regexp_replace(e, r"\D", ""), F.regexp_replace(x, r"\D", "")
    valid = luhn_digit(F.substring(bare, F.lit(1), F.length(bare) - 1)) == F.substring(bare, -1, 1)
    return F.when(valid, F.concat(F.substring(x, F.lit(1), F.length(x) - 1), luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)))).otherwise(x)


def _closed_iban(e: Column, x: Column) -> Column:
    """The drawn IBAN in the original's country, with check digits that hold if the original's do."""
    bare, rest = F.regexp_replace(e, " ", ""), F.substring(x, F.lit(5), F.length(x))
    drawn = F.concat(F.substring(e, 1, 2), F.substring(x, 3, 2), rest)
    return F.when(iban_digits(bare) == F.substring(bare, 3, 2), F.concat(F.substring(e, 1, 2), iban_digits(F.regexp_replace(drawn, " ", "")), rest)).otherwise(drawn)


def _pick(stream: Column, at: Column, words: Column) -> Column:
    """One of a non-empty array of words."""
    return F.element_at(words, F.pmod(_number(stream, at, 65536), F.size(words)) + 1)


def _words(of: dict[str, tuple[str, ...]], key: Column) -> Column:
    """The array of words that a key has; none for an unknown one."""
    found = F.lit(None).cast("array<string>")
    for name, words in of.items():
        found = F.when(key == name, F.array(*map(F.lit, words))).otherwise(found)
    return found


def _name_word(w: Column, stream: Column, attempt: Column) -> Column:
    """A word of a name: same script, case, joints and gender; one syllable longer with each draw."""
    low = F.lower(w)
    script = F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.when(low.isin(*map(str.lower, MALE)), "m").when(low.isin(*map(str.lower, FEMALE)), "f")
    shown = F.when(w.rlike(r"(?i)([оеё]в|ин|ий|ς)$"), "sm").when(w.rlike(r"(?i)([оеё]ва|ина|ая|ου|ά|α)$"), "sf").otherwise("x")
    endings = {f"{k} {sort}": words for k, sorts in ENDINGS.items() for sort, words in sorts.items()}

    def made(i: Column, syllables: Column, ends: Column) -> Column:
        stems = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), lambda k: _pick(stream, k * 3 + i * 23, syllables)), "")
        return _let(F.concat(stems, _pick(stream, i * 23, ends)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))

    def joined(k: Column) -> Column:
        # each hyphen keeps its place; letters that join an inner capital stay
        parts = F.transform(F.split(w, "-"), lambda _, i: made(i, k["syllables"], k["ends"]))
        return F.concat(F.regexp_extract(w, r"^(?:Mc|Mac|[OD]['’])(?=\p{Lu})", 0), F.array_join(parts, "-"))

    ends = F.coalesce(_words(endings, F.concat_ws(" ", script, F.coalesce(gender, shown))), _words(endings, F.concat_ws(" ", script, F.lit("x"))))
    out = _let(F.struct(_words(SYLLABLES, script).alias("syllables"), ends.alias("ends")), joined)
    return _let(out, lambda x: F.when(w.rlike(r"^(?=.*\p{L}.*\p{L})[^\p{Ll}]+$"), F.upper(x)).otherwise(x))


def surrogate(e: Column, kind: Column | str, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a spelling of an entity (a word, for names) at the given attempt."""

    def fixed(kind: Column, stream: Column) -> Column:
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(stream, i * 3, 254) + 1).cast("string")), ".")
        # of an e-mail address the last label stays
        last = F.substring_index(e, ".", -1)

        def shaped(x: Column) -> Column:
            mail = F.concat(F.substring(x, F.lit(1), F.length(e) - F.length(last)), last)
            return F.when(kind == "email", mail).when(kind == "iban", _closed_iban(e, x)).when(kind == "card", _closed_card(e, x)).otherwise(x)

        return F.when(kind == "ip", octets).when(kind == "ip6", _hexed(e, stream)).otherwise(_let(_filled(e, stream), shaped))

    is_name = isinstance(kind, str)
    kind = F.lit(kind) if is_name else kind

    def put(stream: Column) -> Column:
        drawn = _name_word(e, stream, F.greatest(attempt, F.lit(0))) if is_name else fixed(kind, stream)
        return F.when(attempt == MASKED, F.concat(F.lit("["), F.upper(kind), F.lit("-"), F.substring(stream, 1, 24), F.lit("]"))).otherwise(drawn)

    return _let(_stream(kind, canonical(e, kind), attempt, key), put)


def drawn_for(e: Column, kind: Column, attempt: Column, key: str, draw) -> Column:
    """The draw for an entity of any kind; names are drawn by an expression of their own."""
    return F.when(kind == "name", draw(e, "name", attempt, key)).otherwise(draw(e, kind, attempt, key))


def pattern_of(text: Column) -> Column:
    """The entities' pattern, with the words of the text's own names."""
    words = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), lambda n: F.filter(F.split(n, " "), is_name_word)))
    longest = F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(words) > 0, F.concat(F.lit(ENTITY + r"|\b(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(ENTITY))


def found_in(text: Column) -> Column:
    """The entities of a text in order; none for null."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, pattern_of(text), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _units_of(rows: DataFrame, *keep: str) -> DataFrame:
    """(*keep, e, kind) of what is replaced as one, from rows (*keep, e)."""
    typed = rows.withColumn("kind", type_of(F.col("e")))
    return typed.select(*keep, F.explode(units(F.col("e"), F.col("kind"))).alias("e"), "kind")


def attempts(docs: DataFrame, text_col: str = "text", key: str = KEY, draw=surrogate) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first draw collides: distinct entities of all of ``docs``."""
    # each step is written before the next, which uses its columns many times over
    e = cut(docs.select(F.explode_outer(found_in(F.col(text_col))).alias("e")).where("e IS NOT NULL").distinct())
    e = cut(_units_of(e).distinct())
    state = cut(e.groupBy("kind", canonical(F.col("e"), F.col("kind")).alias("canon")).agg(F.min("e").alias("e")).withColumn("attempt", F.lit(0)))
    done = 0
    while True:
        drawn = cut(state.withColumn("new", drawn_for(F.col("e"), F.col("kind"), F.col("attempt"), key, draw)))
        drawn = cut(drawn.withColumn("drawn", canonical(F.col("new"), F.col("kind"))).drop("new"))
        owner = drawn.groupBy("kind", "drawn").agg(F.min_by("canon", F.struct("attempt", "canon")).alias("owner"), F.count("*").alias("n"))
        taken = state.select(F.col("kind").alias("kind"), F.col("canon").alias("drawn"))
        lost = owner.where("n > 1").select("kind", "drawn", "owner").unionByName(owner.join(taken, ["kind", "drawn"], "left_semi").select("kind", "drawn", F.lit(None).cast("string").alias("owner")))
        lost = lost.groupBy("kind", "drawn").agg(F.when(F.count("*") == F.count("owner"), F.min("owner")).alias("owner"))
        again = cut(drawn.where(F.col("attempt") != MASKED).join(lost, ["kind", "drawn"]).where(~F.col("canon").eqNullSafe(F.col("owner"))).select("kind", "canon"))
        if not again.limit(1).count():
            return state.where("attempt <> 0").select("kind", "canon", "attempt")
        done += 1
        # what never finds a free replacement of its format is masked; names only get longer
        nth = F.when((F.col("kind") != "name") & F.lit(done >= ROUNDS), F.lit(MASKED)).otherwise(F.col("attempt") + 1)
        state = cut(state.join(again.withColumn("again", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", "e", F.when(F.col("again") == 1, nth).otherwise(F.col("attempt")).alias("attempt")))


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, draw=surrogate) -> DataFrame:
    """One row per row of ``docs``: (id_col, text_col, n_entities and n_<type> for each type); originals are not returned.

    Null text stays null and has no entities; texts are read whole. Repeated rows are replaced alike. Where two types could
    start at the same place, the first in PATTERNS is taken. Other columns are not read. An empty table gives an empty result.
    """
    again = cut(attempts(docs, text_col, key, draw))
    text = F.col("body")
    # rows over which a collision was settled are told by their hash which entities to draw again
    rows = docs.select(F.col(id_col).alias("ident"), F.col(text_col).alias("body"), F.xxhash64(id_col, text_col).alias("of"))
    if again.limit(1).count():
        carried = _units_of(rows.where(text.rlike(HINT)).select("of", F.explode(F.array_distinct(found_in(text))).alias("e")), "of")
        carried = carried.withColumn("canon", canonical(F.col("e"), F.col("kind"))).select("of", "kind", "canon").distinct()
        told = join_checked(carried, again, ["kind", "canon"], "inner", BROADCAST_OVERRIDES)
        told = cut(told.groupBy("of").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("again")))
        rows = join_checked(rows, told, ["of"], "left", BROADCAST_OVERRIDES)
    else:
        rows = rows.withColumn("again", F.lit(None).cast("map<string,int>"))
    rows = rows.withColumn("pattern", F.when(text.rlike(HINT), pattern_of(text)))
    rows = rows.withColumn("found", F.transform(F.when(F.col("pattern").isNotNull(), F.regexp_extract_all(text, F.col("pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")), lambda e: F.struct(e.alias("e"), type_of(e).alias("kind"))))

    def one(e: Column, kind: Column | str) -> Column:
        of = F.lit(kind) if isinstance(kind, str) else kind
        attempt = F.coalesce(F.col("again")[F.concat_ws("|", of, canonical(e, of))], F.lit(0))
        return draw(e, kind, attempt, key)

    def put(s: Column) -> Column:
        named = F.array_join(F.transform(F.split(s["e"], " "), lambda w: F.when(is_name_word(w), one(w, "name")).otherwise(w)), " ")
        return F.when(s["kind"] == "name", named).otherwise(one(s["e"], s["kind"]))

    between = F.split(text, F.coalesce("pattern", F.lit(ENTITY)), -1)
    new = F.array_join(F.zip_with(between, F.transform("found", put), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in PATTERNS]
    return rows.select(F.col("ident").alias(id_col), F.when(F.size("found") > 0, new).otherwise(text).alias(text_col), F.size("found").cast("long").alias("n_entities"), *counts)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"))
