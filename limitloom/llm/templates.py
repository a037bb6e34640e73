"""Benchmark items in documents, found as templates.

Words become template tokens: numbers, units behind numbers, and names get typed placeholders. Windows of
template tokens are hash-joined with those of the benchmark. What stands in the placeholders must
correspond one to one between item and document, so that a question with other numbers and
names is found while a chance likeness is not. Windows of plain words are joined as well, so that
verbatim copies are found whatever their case and line breaks. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.llm.frames import durable

WINDOW, SHORTEST, SHARE = 8, 4, 0.5
# Benchmark windows that are broadcast at most; a larger benchmark is joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
# Words that count as a unit when a number stands before them.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months "
    "year years dollar dollars euro euros cent cents percent degree degrees kmh mph watt watts volt volts kb mb gb tb"
).split()
# Placeholders of the template; private-use characters, which sort behind all letters.
_NAME, _UNIT, _NUMBER = "\ue000", "\ue001", "\ue002"
_PUNCTUATION, _SPACE = r"[!-/:-@\[-`{-~]+", r"[\x20\x09-\x0D]+"


def _spaced(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, " ")


def _split(spaced: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(spaced), _PUNCTUATION, ""), " "), "")


def words(text: Column) -> Column:
    """Words in lower case without ASCII punctuation."""
    return _split(_spaced(text))


def template(text: Column) -> Column:
    """Like :func:`words`, place for place, with placeholders for capitalised words inside sentences, numbers, and units behind numbers."""
    # the capital is looked for first, what stands before it afterwards
    t = F.regexp_replace(_spaced(text), r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{Ll}\p{L}*", _NAME)
    t = F.regexp_replace(t, r"[0-9]+(?:[.,:/][0-9]+)*", _NUMBER)
    t = F.regexp_replace(t, rf"(?i){_NUMBER} (?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", f"{_NUMBER} {_UNIT}")
    return _split(t)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a plain reference would be inlined into the lambdas and computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashed(run_words: Column) -> Column:
    return F.transform(run_words, lambda w: F.xxhash64(w))


def _starts(t: Column, size: int) -> Column:
    return F.when(F.size(t) >= size, F.sequence(F.lit(0), F.size(t) - size)).otherwise(F.array().cast("array<int>"))


def _window(t: Column, i: Column, size: int) -> Column:
    """Hash of the run of ``size`` words from place ``i``."""
    return F.xxhash64(F.slice(t, i + 1, F.lit(size)))


def _windows(run_words: Column, size: int) -> Column:
    """Hash of each run of ``size`` words."""
    return _let(_hashed(run_words), lambda t: F.transform(_starts(t, size), lambda i: _window(t, i, size)))


# Bits of the sieve a window's first two words must pass before it is hashed. A larger benchmark merely lets more through.
SIEVE = 1 << 18


def _pair(t: Column, i: Column) -> Column:
    first, second = F.get(t, i), F.get(t, i + 1)
    return first.bitwiseXOR(F.shiftleft(second, 7)).bitwiseXOR(F.shiftrightunsigned(second, 57)).bitwiseAND(SIEVE - 1)


def _sieve(own: DataFrame) -> Column | None:
    """Bits (as longs) of the word pairs that start windows; none without windows. Only the bits reach the driver."""
    bit = F.expr("shiftleft(1L, cast(pair & 63 as int))")
    rows = own.groupBy(F.shiftright("pair", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    held = {r["word"]: r["bits"] for r in rows}
    return F.expr("array(" + ",".join(f"cast({held.get(i, 0)} as bigint)" for i in range(SIEVE >> 6)) + ")") if held else None


def _sifted(t: Column, size: int, sieve: Column) -> Column:
    """(size, at, h) of the windows whose first two words start a window of the benchmark."""

    def passes(i: Column) -> Column:
        return _let(_pair(t, i), lambda p: F.getbit(F.get(sieve, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)

    return F.transform(F.filter(_starts(t, size), passes), lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), _window(t, i, size).alias("h")))


def _slots(t: Column, w: Column, start: Column, size: int) -> Column:
    """(place, value) of the words of a window that hold a placeholder."""
    at = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.get(t, start + j).rlike(f"[{_NAME}-{_NUMBER}]"))
    return F.transform(at, lambda j: F.struct((start + j).alias("place"), F.get(w, start + j).alias("value")))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, found, windows, verbatim: documents that hold at least ``share`` of an item's windows.

    A window counts if its plain words are the item's, or if its template words are and the slots on its diagonal correspond
    one to one; ``verbatim`` says that all slots of the windows that count hold the item's words. An item of fewer words than ``window`` is one window of
    its own length; one of fewer than ``SHORTEST`` words, null or empty matches nothing. Rows with a null id match
    nothing; rows that repeat an id count as one document, repeated items as one item.
    """
    text = F.col("text").cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(text).alias("iw"), template(text).alias("it")).filter("item_id is not null")
    items = items.withColumn("size", F.least(F.size("it"), F.lit(window))).filter(F.col("size") >= SHORTEST)
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own, sifts = None, []
    for size in sorted(r[0] for r in items.select("size").distinct().collect()):  # as many as there are window lengths
        for kind, part in (("iw", "p"), ("it", "t")):
            at = items.filter(F.col("size") == size).withColumn("hw", _hashed(F.col(kind)))
            at = at.withColumn("ws", _windows(F.col(kind), size)).select("item_id", "iw", kind, "hw", F.size("ws").alias("windows"), F.posexplode("ws").alias("item_at", "h"))
            slots = _slots(F.col(kind), F.col("iw"), F.col("item_at"), size).alias("item_slots")
            at = at.select("h", F.lit(size).alias("size"), "item_id", "windows", "item_at", slots, _pair(F.col("hw"), F.col("item_at")).alias("pair"))
            # template windows without placeholders are plain ones
            at = durable(at if part == "p" else at.filter(F.size("item_slots") > 0), "benchmark-windows")
            sieve = _sieve(at)
            if sieve is not None:
                sifts.append((part, size, sieve))
                own = at.drop("pair") if own is None else own.unionByName(at.drop("pair"))
    found = None
    if own is not None:
        if own.count() <= BROADCAST_WINDOWS:
            own = F.broadcast(own)
        both = F.struct(_hashed(words(F.col("text"))).alias("p"), _hashed(template(F.col("text"))).alias("t"))
        ws = _let(both, lambda s: F.concat(*[_sifted(s[part], size, sieve) for part, size, sieve in sifts]))
        # windows alone are exploded: a row that carried its text's arrays would copy them for every window
        rows = texts.select("doc_id", F.xxhash64("text").alias("row"), F.explode(ws).alias("w")).select("doc_id", "row", "w.*")
        found = rows.join(own, ["h", "size"])
    if found is None:
        return texts.select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).alias("found"), F.lit(0).alias("windows"), F.lit(True).alias("verbatim")).limit(0)
    found = durable(found.drop("h"), "windows")
    plain = found.filter(F.size("item_slots") == 0).withColumn("slots", F.array().cast("array<struct<i:string,d:string>>"))
    filled = found.filter(F.size("item_slots") > 0)
    asked = filled.select("doc_id", "row").distinct()
    n = asked.count()
    if n:
        # texts are read again for windows with placeholders only
        asked = F.broadcast(asked) if n <= BROADCAST_WINDOWS else asked
        own = texts.withColumn("row", F.xxhash64("text")).join(asked, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
        own = durable(own.select("doc_id", "row", words(F.col("text")).alias("dw")), "words")
        value = lambda s: F.get("dw", s["place"] + F.col("at") - F.col("item_at"))
        pairs = F.transform("item_slots", lambda s: F.struct(s["value"].alias("i"), value(s).alias("d")))
        plain = plain.unionByName(filled.join(own, ["doc_id", "row"]).withColumn("slots", pairs).drop("dw"))
    found = plain.withColumn("shift", F.col("at") - F.col("item_at"))
    # a diagonal holds at most one row of each kind per window of an item; plain ones need no slots
    aligned = found.groupBy("doc_id", "item_id", "windows", "shift", (F.size("item_slots") > 0).alias("typed")).agg(F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    left = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    right = F.size(F.array_distinct(F.transform("slots", lambda s: s["d"])))
    consistent = aligned.filter((left == F.size("slots")) & (right == F.size("slots")))
    whole = consistent.groupBy("doc_id", "item_id", "windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("found"), F.min(F.forall("slots", lambda s: s["i"] == s["d"])).alias("verbatim")
    )
    return whole.filter(F.col("found") >= F.col("windows") * share).select("doc_id", "item_id", "found", "windows", "verbatim")
