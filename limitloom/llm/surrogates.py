"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Every distinct entity of the corpus gets one surrogate, so mentions of one entity stay mentions of one. A
surrogate that equals another's, or any entity of the corpus, is drawn again. Letters stand for
letters of the same script and case, digits for digits; names keep gender. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.llm.frames import durable

# Between the parts of a phone number: anything but letters, digits and line ends.
_SEP = r"[^0-9A-Za-z\n(]{0,8}"
# Plain groups of three, three and four digits with one separator, a country's 1 perhaps before them.
_GROUPED = r"(?<![0-9A-Za-z])(?<![0-9][.-])(?:1[ .-])?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Titles that tell a name and its gender.
MALE = "Mr Herr Señor Monsieur господин".split()
FEMALE = "Mrs Ms Miss Frau Señora Madame Mme госпожа".split()
_TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.? "
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": rf"(?:\+[0-9]{{1,3}}{_SEP})?\([0-9]{{2,4}}\){_SEP}[0-9]{{3,4}}[ .-]?[0-9]{{4}}(?![0-9])|\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,4}}(?![0-9])|{_GROUPED}",
    "card": r"(?<![0-9.])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "name": rf"{_TITLE}\p{{Lu}}[\p{{L}}'-]*\p{{Ll}}(?: \p{{Lu}}[\p{{L}}'-]*\p{{Ll}})?",
}
ANY = "|".join(PATTERNS.values())
# A cheap test that every text with an entity passes: addresses may have one-digit octets, secrets no two digits side by side.
HINT = rf"@|[0-9][0-9]|[0-9]\.[0-9]|[0-9A-Fa-f]{{32}}|{_TITLE}"
ATTEMPTS = 40
_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(F.regexp_extract(mention, f"^(?:{PATTERNS[kind]})$", 0) != "", kind).otherwise(out)
    return out


def _without_title(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^{_TITLE}", "")


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: digits alone, or lower case without spaces."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, "[^0-9]", ""))
        .when(kind == "iban", F.lower(F.regexp_replace(mention, " ", "")))
        .otherwise(F.lower(mention))
    )


def _byte(digest: Column, i: Column) -> Column:
    """The ``i``-th byte of a digest of 256 bytes, which goes round for longer entities."""
    return F.conv(F.substring(digest, (2 * i - 2) % 512 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _redrawn(text: Column, digest: Column, keep: Column) -> Column:
    """``text`` (lower case) with all but its first ``keep`` characters drawn again within their class."""

    def draw(c: Column, i: Column) -> Column:
        b = _byte(digest, i + 1)
        return (
            F.when(i < keep, c)
            .when((c >= "0") & (c <= "9"), (b % 10).cast("string"))
            .when((c >= "a") & (c <= "z"), _letters(_LATIN, b))
            .when((c >= "а") & (c <= "я"), _letters(_CYRILLIC, b))
            .when((c >= "α") & (c <= "ω"), _letters(_GREEK, b))
            .when(c.rlike(r"\p{L}"), _letters(_LATIN, b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), draw), "")


def _luhn(digits: Column) -> Column:
    """Sum whose remainder by 10 is 0 for a valid card number."""
    doubled = lambda d: d * 2 - F.when(d * 2 > 9, 9).otherwise(0)
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _syllables(digest: Column, script: Column, gender: Column, first: int, count: Column) -> Column:
    """A name of alternating consonants and vowels, with an ending that tells the gender if there is one."""
    soft = {"latin": ("bdfgklmnprstvw", "aeiou"), "cyrillic": ("бвгдклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστ", "αειου")}

    def part(i: Column) -> Column:
        b, v = _byte(digest, 2 * i + first), _byte(digest, 2 * i + first + 1)
        pair = lambda s: F.concat(_letters(soft[s][0], b), _letters(soft[s][1], v))
        return F.when(script == "cyrillic", pair("cyrillic")).when(script == "greek", pair("greek")).otherwise(pair("latin"))

    body = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), part), "")
    female = F.when(script == "cyrillic", "на").when(script == "greek", "να").otherwise("na")
    male = F.when(script == "cyrillic", "н").when(script == "greek", "ς").otherwise("n")
    return F.concat(body, F.when(gender == "f", female).when(gender == "m", male).otherwise(""))


def _drawn(key: str, attempt: int) -> Column:
    """The surrogate of an entity (kind, entity) at an attempt."""
    kind, entity = F.col("kind"), F.col("entity")
    seed = F.concat_ws("|", F.lit(key), kind, entity, F.lit(str(attempt)))
    digest = F.concat(*[F.sha2(F.concat_ws("|", seed, F.lit(str(i))), 512) for i in range(4)])
    host = F.length(F.substring_index(entity, ".", -1))
    email = F.concat(_redrawn(F.substring(entity, F.lit(1), F.length(entity) - host), digest, F.lit(0)), F.substring_index(entity, ".", -1))
    octet = lambda i: (_byte(digest, F.lit(i)) % 254 + 1).cast("string")
    fresh = _redrawn(entity, digest, F.lit(1))
    # a valid card number stays valid, an invalid one may become either
    body = F.substring(fresh, F.lit(1), F.length(fresh) - 1)
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(_luhn(entity) % 10 == 0, F.concat(body, check)).otherwise(fresh)
    script = F.when(entity.rlike("[а-я]"), "cyrillic").when(entity.rlike("[α-ω]"), "greek").otherwise("latin")
    name = _syllables(digest, script, F.when(kind.startswith("given"), F.substring(kind, F.lit(7), F.lit(1))).otherwise(""), 1, F.lit(2 + min(attempt, 6) // 2))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", octet(1), octet(2), octet(3), octet(4)))
        .when(kind == "card", card)
        .when(kind == "secret", F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), (_byte(digest, i + 1) % 10).cast("string")).otherwise(_letters("abcdef", _byte(digest, i + 1)))), ""))
        .when(kind == "iban", _redrawn(entity, digest, F.lit(2)))
        .when(kind.startswith("given") | (kind == "surname"), name)
        .otherwise(_redrawn(entity, digest, F.when(kind == "phone", F.greatest(F.length(entity) - 10, F.lit(0))).otherwise(F.lit(0))))
    )


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate): one surrogate per entity, no two alike within a kind and none an entity itself.

    Of entities that draw the same surrogate the smallest keeps it, the others draw again. Rounds go on
    until none is left; after ``ATTEMPTS`` rounds a kind's values are exhausted, which is an error.
    """
    left = durable(entities.select("kind", "entity").distinct(), "entities")
    known = left.select("kind", F.col("entity").alias("surrogate"))
    taken, attempt = None, 0
    while left.limit(1).count():
        if attempt == ATTEMPTS:
            raise ValueError(f"no distinct surrogates after {ATTEMPTS} draws")
        drawn = left.select("kind", "entity", _drawn(key, attempt).alias("surrogate"))
        won = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).join(known, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            won = won.join(taken, ["kind", "surrogate"], "left_anti")
        won = durable(won.select("kind", "entity", "surrogate"), "surrogates")
        left = durable(left.join(won, ["kind", "entity"], "left_anti"), "entities")
        taken = won if taken is None else taken.unionByName(won)
        attempt += 1
    return taken if taken is not None else left.withColumn("surrogate", F.col("entity"))


def _dressed(mention: Column, surrogate: Column) -> Column:
    """The surrogate's letters and digits in the places and the case of the mention's."""
    carried = F.filter(F.split(surrogate, ""), lambda c: c.rlike(r"[\p{L}\p{N}]"))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        new = F.coalesce(F.get(carried, acc["k"]), F.lit(""))
        cased = F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(new)).otherwise(new)
        real = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc["s"], F.when(real, cased).otherwise(c)).alias("s"), (acc["k"] + real.cast("int")).alias("k"))

    return F.aggregate(F.split(mention, ""), start, step, lambda acc: acc["s"])


def _parts(kind: Column, mention: Column) -> Column:
    """The entities of a mention: a name has a surname and perhaps a given name of the title's gender, all else is one."""
    name = F.split(_without_title(mention), " ")
    gender = F.when(mention.rlike(rf"^(?:{'|'.join(FEMALE)})\b"), "f").otherwise("m")
    part = lambda k, e: F.struct(k.alias("kind"), F.lower(e).alias("entity"))
    surname = part(F.lit("surname"), F.element_at(name, -1))
    return F.when(kind != "name", F.array(part(kind, canonical(kind, mention)))).otherwise(
        F.when(F.size(name) > 1, F.array(part(F.concat(F.lit("given_"), gender), F.get(name, F.lit(0))), surname)).otherwise(F.array(surname))
    )


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with all personal data in ``text`` replaced; other columns, and texts without any, as they are.

    A null text stays null. ``count`` names a further column with the number of mentions replaced; where ``docs`` has a column
    of that name, whatever its case, underscores follow until the name is free. Rows are told apart by a number given when
    they are stored, so repeated rows and null ids do no harm.
    """
    columns = docs.columns
    while count and count.lower() in {c.lower() for c in columns}:
        count += "_"
    t = F.col(text).cast("string")
    hit = F.coalesce(t.rlike(HINT) & t.rlike(ANY), F.lit(False))
    clean = docs.filter(~hit)
    found = docs.filter(hit).select(
        F.struct(*columns).alias("row"), F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1)).alias("hits"), F.split(t, ANY, -1).alias("gaps"), F.monotonically_increasing_id().alias("nth")
    )
    found = durable(found, "mentions")
    mentions = found.select("nth", F.posexplode("hits").alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    parts = mentions.select("nth", "at", "mention", F.col("kind").alias("whole"), F.posexplode(_parts(F.col("kind"), F.col("mention"))).alias("part", "e"))
    parts = parts.select("nth", "at", "mention", "whole", "part", "e.kind", "e.entity")
    known = durable(dictionary(parts, key), "dictionary")
    solved = parts.join(known, ["kind", "entity"])
    title = F.regexp_extract("mention", rf"^{_TITLE}", 0)
    titled = F.concat(title, F.concat_ws(" ", F.transform(F.array_sort("found"), lambda p: F.initcap(p["surrogate"]))))
    first = F.get("found", F.lit(0))["surrogate"]
    put = solved.groupBy("nth", "at", "mention", "whole").agg(F.collect_list(F.struct("part", "surrogate")).alias("found"))
    put = put.select("nth", "at", F.when(F.col("whole") == "name", titled).when(F.col("whole") == "ip", first).otherwise(_dressed(F.col("mention"), first)).alias("put"))
    rows = put.groupBy("nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "put"))), lambda p: p["put"]).alias("puts"))
    joined = found.join(rows, "nth")
    whole = F.array_join(F.zip_with("gaps", "puts", lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    out = joined.select(*[(whole if c == text else F.col(f"row.`{c}`")).alias(c) for c in columns], *([F.size("puts").alias(count)] if count else []))
    return (clean.withColumn(count, F.lit(0)) if count else clean).unionByName(out)
