"""Personal data replaced by keyed surrogates.

One pattern finds e-mail addresses, access keys, passwords and tokens, IPv4 addresses, phone numbers, card and
social security numbers, and names behind a form of address. Only texts with a literal that every entity needs (an at
sign, four digits in line, a keyword, a title) are searched; the others pass straight through.

A mention stands for one or two units in canonical form: a mail address in lower case, the digits of a number, a secret
without its label and quotes, the family and the given name of a title's bearer. The distinct units of the corpus get a
surrogate of their own type and format, drawn from a keyed hash (later draws of mail addresses, secrets and names are
longer, of addresses wider, as a format may have fewer values than the corpus has units): letters of a script stay
letters of that script, digits stay digits, a given name keeps its gender, a card number keeps a valid check digit.
Surrogates that meet each other or a real unit are drawn again until none does, so different units stay different, and
one unit reads the same everywhere, in the spelling of each mention: other case, other grouping of digits, other label,
with or without the given name. The texts, cut at the mentions, are then put together again.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm._shared import checkpointed, written

_EDGE = r"(?<![\p{L}\p{N}])"
#: A capital, and whatever letters, apostrophes and hyphens between letters follow: a name is replaced whole or not at all.
_NAME = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++)*+"
#: Order matters: the first kind that fits a match names it.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "access_key": _EDGE + r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])",
    "secret": _EDGE + r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?[\p{L}\p{N}_+/.-]{8,}[\"']?",
    "ip": r"(?<![\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{N}]|\.\d)",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3} ?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|" + _EDGE + r"\(\d{3}\) \d{3}-\d{4}(?!\d)",
    "card": r"(?<![\p{L}\p{N}])\d{4}(?:[ -]?\d{4}){3}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "name": _EDGE + rf"(?:Mrs?\.|Ms\.|Dr\.|Prof\.|Herr|Frau|Mme\.?|Monsieur|Señora?|г-н|г-жа) {_NAME}(?: {_NAME})?(?![\p{{L}}\p{{M}}])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
FEMALE = r"^(?:Mrs\.|Ms\.|Frau|Mme|Señora|г-жа)"
#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): ["Ada", "Clara", "Edith", "Greta", "Ines", "Lea", "Mona", "Rosa"],
    ("m", "latin"): ["Aron", "Bruno", "Emil", "Hugo", "Jonas", "Leo", "Otto", "Paul"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Зоя", "Инна", "Лидия", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Глеб", "Егор", "Игорь", "Лев", "Олег", "Павел"],
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do ga ge ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те".split(),
}
#: What a text must contain for the pattern to be tried: one of these literals, or a match of one of these short patterns.
LITERALS = ("@", "AKIA", "ASIA", "Mr", "Ms.", "Dr.", "Prof.", "Herr ", "Frau ", "Mme", "Monsieur ", "Señor", "г-н ", "г-жа ")
DIGITS_IN_LINE = r"[0-9]{4}|[0-9]\.[0-9]{1,3}\.[0-9]"
LABEL = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]"
#: Draws before the search for a free surrogate gives up with an error.
MAX_DRAWS = 64
KEY_SETTING = "spark.tidegauge.surrogateKey"
#: Draws within the format of the entity itself, before later ones grow.
PLAIN_DRAWS = 4
#: First and last code point of the letters that stand for a class, both ends included.
ALPHABETS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "digit": "0123456789", "hex": "0123456789abcdef"}


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def is_entity(match: Column) -> Column:
    """Whether a match of the pattern is an entity: sixteen digits are a card number only if they start like one and
    their Luhn sum is a multiple of ten, and four dotted numbers are an address only up to 255 each; anything else of
    that form stays as it is."""
    digits = F.transform(F.split(F.regexp_replace(match, r"[ -]", ""), ""), lambda c: c.try_cast("int"))
    twice = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    luhn = F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0
    return F.when(F.regexp_like(match, F.lit(r"^\d{4}(?:[ -]?\d{4}){3}$")), F.regexp_like(match, F.lit("^[2-6]")) & luhn).when(
        F.regexp_like(match, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$")), F.forall(F.split(match, r"\."), lambda o: o.cast("int") <= 255)
    ).otherwise(True)


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def _draw(digest: Column, i: Column, n: int) -> Column:
    """A number below ``n`` from two hex digits of a 128-digit digest."""
    return F.conv(F.substring(digest, (2 * F.pmod(i, F.lit(64)) + 1).cast("int"), F.lit(2)), 16, 10).cast("int") % n


def _pick(letters: str, digest: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), _draw(digest, i, len(letters)) + 1, F.lit(1))


def _same_format(value: Column, digest: Column, hexadecimal: Column | None = None) -> Column:
    """Every digit another digit, every letter a letter of its case and script, all else as it is."""

    def one(c: Column, i: Column) -> Column:
        other = (
            F.when(F.regexp_like(c, F.lit(r"^\p{N}$")), _pick(ALPHABETS["digit"], digest, i))
            .when(F.regexp_like(c, F.lit(r"^\p{IsCyrillic}$")), _pick(ALPHABETS["cyrillic"], digest, i))
            .when(F.regexp_like(c, F.lit(r"^\p{IsGreek}$")), _pick(ALPHABETS["greek"], digest, i))
            .when(F.regexp_like(c, F.lit(r"^\p{Lu}$")), _pick(ALPHABETS["upper"], digest, i))
            .when(F.regexp_like(c, F.lit(r"^\p{L}$")), _pick(ALPHABETS["lower"], digest, i))
            .otherwise(c)
        )
        if hexadecimal is None:
            return other
        return F.when(hexadecimal & F.regexp_like(c, F.lit("^[0-9a-f]$")), _pick(ALPHABETS["hex"], digest, i)).otherwise(other)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _card(value: Column, digest: Column) -> Column:
    """Sixteen digits: the first stays, the last makes the Luhn sum a multiple of ten."""
    drawn = F.transform(F.split(value, ""), lambda c, i: F.when(i == 0, c).otherwise(_pick(ALPHABETS["digit"], digest, i)).cast("int"))
    body = F.slice(drawn, 1, 15)
    total = F.aggregate(
        F.transform(body, lambda d, i: F.when(i % 2 == 0, F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, d: a + d
    )
    return F.array_join(F.concat(body, F.array(F.pmod(-total, F.lit(10)))).cast("array<string>"), "")


def _is_cyrillic(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"\p{IsCyrillic}"))


def _syllables(value: Column, digest: Column, n: Column) -> Column:
    """``n`` syllables in the value's script."""
    lists = {s: F.array(*map(F.lit, SYLLABLES[s])) for s in SYLLABLES}
    script = F.when(_is_cyrillic(value), lists["cyrillic"]).otherwise(lists["latin"])
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n), lambda k: F.get(script, _draw(digest, k, 32))), "")


def _given(value: Column, gender: str, digest: Column, attempt: Column) -> Column:
    names = {s: F.array(*map(F.lit, GIVEN[gender, s])) for s in ("latin", "cyrillic")}
    name = F.get(F.when(_is_cyrillic(value), names["cyrillic"]).otherwise(names["latin"]), _draw(digest, F.lit(0), 8))
    return F.concat(name, _syllables(value, digest, _extra(attempt)))


def keyed_digest(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 512)


def _extra(attempt: Column) -> Column:
    """Letters or syllables that a draw adds to the format: none in the first ``PLAIN_DRAWS``, then one more each time."""
    return F.greatest(attempt - PLAIN_DRAWS + 1, F.lit(0))


def surrogate(kind: Column, value: Column, digest: Column, attempt: Column) -> Column:
    """The surrogate of a unit, a pure function of its kind, itself, the attempt and the keyed digest of the three."""
    pad = F.substr(F.translate(digest, "0123456789", "ghijklmnop"), F.lit(65), _extra(attempt))
    octet = F.when(attempt < PLAIN_DRAWS, 10).when(attempt < 3 * PLAIN_DRAWS, 240 + _draw(digest, F.lit(3), 16)).otherwise(_draw(digest, F.lit(3), 254) + 1)
    domain_end = F.concat(F.lit("."), F.substring_index(value, ".", -1))
    # a plus, and as many digits as ten others leave, are the country's
    country = F.when(F.startswith(value, F.lit("+")), 1 + F.greatest(F.lit(1), F.least(F.lit(3), F.length(value) - 11))).otherwise(0)
    return (
        F.when(
            kind == "email",
            F.concat(pad, _same_format(F.substr(value, F.lit(1), F.length(value) - F.length(domain_end)), digest), domain_end),
        )
        .when(kind == "access_key", F.concat(F.substring(value, 1, 4), _same_format(F.substr(value, F.lit(5)), digest)))
        .when(kind == "secret", F.concat(pad, _same_format(value, digest, F.regexp_like(value, F.lit(r"^[0-9a-f]+$")))))
        .when(kind == "ip", F.concat_ws(".", octet.cast("string"), *[(_draw(digest, F.lit(k), 254) + 1).cast("string") for k in range(3)]))
        .when(kind == "phone", F.concat(F.substr(value, F.lit(1), country), _same_format(F.substr(value, country + 1), digest)))
        .when(kind == "card", _card(value, digest))
        .when(kind == "given_f", _given(value, "f", digest, attempt))
        .when(kind == "given_m", _given(value, "m", digest, attempt))
        .when(kind == "family", F.initcap(_syllables(value, digest, 4 + _extra(attempt))))
        .otherwise(_same_format(value, digest))
    )


_SECRET = r"^(.*?[=:]\s?[\"']?)(.*?)([\"']?)$"


def units_of(kind: Column, mention: Column) -> Column:
    """The mention's units as an array of (kind, value in canonical form)."""
    parts = F.split(mention, " ")
    gender = F.when(F.regexp_like(mention, F.lit(FEMALE)), "given_f").otherwise("given_m")
    unit = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    family = unit(F.lit("family"), F.element_at(parts, -1))
    value = (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "secret", F.regexp_extract(mention, _SECRET, 2))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, r"[^0-9+]", ""))
        .otherwise(mention)
    )
    named = F.when(F.size(parts) > 2, F.array(family, unit(gender, F.get(parts, F.lit(1))))).otherwise(F.array(family))
    return F.when(kind == "name", named).otherwise(F.array(unit(kind, value)))


def spelled(kind: Column, mention: Column, new: Column) -> Column:
    """The surrogates ``new`` of a mention's units in the mention's own spelling."""
    first = F.get(new, F.lit(0))
    digits = F.regexp_replace(first, r"[^0-9]", "")
    # digit by digit, all else stays
    filled = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(
            F.regexp_like(c, F.lit("^[0-9]$")), F.struct(F.concat(a["out"], F.substr(digits, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )
    case = F.when(F.length(first) != F.length(mention), first).otherwise(
        F.array_join(F.zip_with(F.split(first, ""), F.split(mention, ""), lambda s, m: F.when(m != F.lower(m), F.upper(s)).otherwise(s)), "")
    )
    return (
        F.when(kind == "email", case)
        .when(kind == "secret", F.concat(F.regexp_extract(mention, _SECRET, 1), first, F.regexp_extract(mention, _SECRET, 3)))
        .when(kind.isin("phone", "card", "ssn"), filled)
        .when(kind == "name", F.concat_ws(" ", F.substring_index(mention, " ", 1), F.get(new, F.lit(1)), first))
        .otherwise(first)
    )


def unit_surrogates(units: DataFrame, key: str) -> DataFrame:
    """``kind, value, surrogate`` for the distinct ``units(kind, value)``: no two share a surrogate, and no surrogate is a
    unit's value. Of those that meet, the smallest keeps its draw; the others draw again.

    Phone, card and social security numbers and access keys keep their length; where a format is so full that a unit
    finds no free surrogate in ``MAX_DRAWS`` draws, this raises ``ValueError``."""
    known = checkpointed(units.select("kind", "value").distinct())
    drawn = known.withColumn("attempt", F.lit(0))
    real = known.select(F.col("value").alias("taken")).distinct()
    for _ in range(MAX_DRAWS):
        # the digest is a column, not a part of the expression: it is computed once per unit
        keyed = drawn.withColumn("digest", keyed_digest(F.col("kind"), F.col("value"), key, F.col("attempt")))
        drawn = checkpointed(keyed.select("kind", "value", "attempt", surrogate(F.col("kind"), F.col("value"), F.col("digest"), F.col("attempt")).alias("surrogate")))
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("first"), F.count(F.lit(1)).alias("n"))
        clashes = checkpointed(
            first.join(real, first["surrogate"] == real["taken"], "left").where("n > 1 or taken is not null").select(
                "surrogate", F.when(F.col("taken").isNull(), F.col("first")).alias("first")
            )
        )
        if clashes.isEmpty():
            return drawn.select("kind", "value", "surrogate")
        again = F.col("hit") & ~F.struct("value", "kind").eqNullSafe(F.col("first"))
        drawn = drawn.join(clashes.withColumn("hit", F.lit(True)), "surrogate", "left").select(
            "kind", "value", (F.col("attempt") + F.coalesce(again, F.lit(False)).cast("int")).alias("attempt")
        )
    most = drawn.groupBy("kind").agg(F.max("attempt").alias("attempt")).collect()  # of ten kinds
    full = [r["kind"] for r in most if r["attempt"] == MAX_DRAWS]
    raise ValueError(f"no free surrogate after {MAX_DRAWS} draws; full: {', '.join(sorted(full))}")


def surrogate_map(found: DataFrame, key: str) -> DataFrame:
    """``entity, surrogate`` for the distinct mentions ``found(entity)``."""
    kind = kind_of(F.col("entity"))
    mentions = written(found.select("entity").distinct().select("entity", kind.alias("kind")).select("*", units_of(F.col("kind"), F.col("entity")).alias("units")), "mentions")
    units = mentions.select("entity", F.posexplode("units").alias("at", "unit")).select("entity", "at", "unit.*")
    drawn = unit_surrogates(units, key)
    new = units.join(drawn, ["kind", "value"]).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("new"))  # one or two each
    return mentions.join(new, "entity").select("entity", spelled(F.col("kind"), F.col("entity"), F.transform("new", lambda x: x["surrogate"])).alias("surrogate"))


def session_key(spark: SparkSession) -> str:
    """The secret of the setting ``spark.tidegauge.surrogateKey``; where it is unset, a random one for this session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def may_hold_entities(text: Column) -> Column:
    """Whether a text has what every entity needs; false for a null text. Literals are quicker than the pattern."""
    literal = F.lit(False)
    for x in LITERALS:
        literal = literal | F.contains(text, F.lit(x))
    label = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & F.regexp_like(text, F.lit(LABEL))
    return F.coalesce(literal | F.regexp_like(text, F.lit(DIGITS_IN_LINE)) | label, F.lit(False))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs``, all columns, with every entity in ``text`` replaced, and a column ``_replaced`` with the
    number of replacements (it takes the place of an older column of that name).

    ``key`` is a secret without a default; an empty one raises ``ValueError``. Surrogates cannot be computed without it.
    A null text stays null. Repeated rows are handled one by one; units with one canonical form get one surrogate
    across the corpus. An empty table gives an empty result.
    """
    if not key:
        raise ValueError("a secret key is needed")
    columns = [c for c in docs.columns if c != "_replaced"]
    row = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"], F.lit(0).alias("_")).alias("row")
    rows = docs.select(row, "text")
    suspect = may_hold_entities(F.col("text"))
    clean = rows.where(~suspect).select("row", "text", F.lit(0).cast("long").alias("n"))
    touched = written(
        rows.where(suspect).select(F.monotonically_increasing_id().alias("id"), "row", F.split("text", ANY).alias("pieces"), entities(F.col("text")).alias("found")), "touched"
    )
    places = touched.select("id", F.posexplode("found").alias("at", "entity")).where(is_entity(F.col("entity")))
    mapped = surrogate_map(places.select("entity"), key)
    listed = places.join(mapped, "entity").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("new"))
    rebuilt = F.array_join(F.transform("pieces", lambda p, i: F.concat(p, F.coalesce(F.try_element_at("new", i), F.get("found", i), F.lit("")))), "")
    changed = touched.join(listed, "id", "left").select("row", rebuilt.alias("text"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n"))
    out = clean.union(changed)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns], F.col("n").alias("_replaced"))
