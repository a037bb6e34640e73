"""Language of documents from fused evidence.

The text gives a likelihood per language from byte trigrams. Declared markup language and address suffix
give likelihoods learned from how they agree with the texts of the corpus. The prior is the share of
languages at the document's host, smoothed towards its site and the corpus, without the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.llm.frames import buffer_of, chunks, durable, small_batches

# Bytes of text whose trigrams a task looks up at once; each takes several numbers of eight bytes.
TEXT_BYTES = 1 << 20
# The labelled sample: rows at most, and shortest and longest text.
SAMPLE, SHORTEST, LONGEST = 4000, 40, 20_000
CELLS = 1 << 16
# Trigrams of a text overlap, so a text counts as this many independent ones at most.
INDEPENDENT = 120
# Rows that a host's or site's parent counts as.
PRIOR_ROWS = 20.0
# Country suffixes and the language they suggest (fixed values).
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

# Letters as lower case, all else as a space; bytes beyond ASCII are letters.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # language x cell


def _cells(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of the trigram that starts at each byte, and whether it holds a letter in its middle or start."""
    folded = np.r_[_FOLD[data], np.full(2, 0x20, np.uint8)].astype(np.uint32)
    code = (folded[:-2] * np.uint32(0x9E3779B1)) ^ (folded[1:-1] * np.uint32(0x85EBCA6B)) ^ (folded[2:] * np.uint32(0xC2B2AE35))
    code ^= code >> np.uint32(15)
    return (code & np.uint32(CELLS - 1)).astype(np.int64), (folded[:-2] != 0x20) | (folded[1:-1] != 0x20)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Trigram model of the languages in a bounded sample (``sample`` rows) of labelled texts, chosen by a hash of the id."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.lower(F.col(lang)).alias("lang")).filter(
        F.col("lang").isNotNull() & F.length("text").between(SHORTEST, LONGEST)
    )
    # ids are chosen first, as every task sends its best rows to the driver; the bounded choice then finds its texts
    ids = rows.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.text", "r.lang").collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        cells, real = _cells(np.frombuffer(b"  " + r.text.encode(), np.uint8))
        counts[r.lang] = counts.get(r.lang, np.zeros(CELLS)) + np.bincount(cells[real], minlength=CELLS)
    languages = sorted(counts)
    p = np.array([counts[v] + 0.05 for v in languages]).reshape(len(languages), CELLS)
    return Model(languages, np.log(p / p.sum(1, keepdims=True)) if languages else p)


def text_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, site, letters and, per language, t_i: the text's tempered log likelihood relative to the best."""
    shared = docs.sparkSession.sparkContext.broadcast(model.log_p)
    names = [f"t_{i}" for i in range(len(model.languages))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        for batch in batches:
            for part in chunks(batch, limit=TEXT_BYTES):
                data, ends = buffer_of(part.column(1))
                # two spaces before each text, so that no trigram belongs to two of them
                at = 2 * np.arange(part.num_rows)
                spaced, own = np.full(len(data) + 2 * part.num_rows, 0x20, np.uint8), np.ones(len(data) + 2 * part.num_rows, bool)
                own[ends[:-1] + at] = own[ends[:-1] + at + 1] = False
                spaced[own] = data
                cells, real = _cells(spaced)
                letters = np.add.reduceat(real, ends[:-1] + at, dtype=np.int64)
                total = np.zeros((len(names), part.num_rows))
                for i in range(len(names)):
                    total[i] = np.add.reduceat(np.where(real, log_p[i][cells], 0.0), ends[:-1] + at)
                total = np.round(total * (np.minimum(letters, INDEPENDENT) / np.maximum(letters, 1)), 9)
                best = total.max(0) if len(names) else total
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(letters), *(pa.array(total[i] - best) for i in range(len(names)))], ["doc_id", "site", "letters", *names]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("site"))
    return rows.mapInArrow(run, "doc_id long, site string, letters long" + "".join(f", {n} double" for n in names))


def page_evidence(pages: DataFrame) -> DataFrame:
    """doc_id, declared, suffix and host of documents that a page's address names (``/../123``).

    ``declared`` is the primary language of the html element, ``suffix`` that of a country suffix or of a path's language
    segment. The html element is the first of the whole page. A document with several pages takes the
    value that most of them have, the smallest of those as frequent, for each kind of evidence apart; pages without one do not count.
    """
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
    tld = F.element_at(F.split(host, r"\."), -1)
    country = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[tld]
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+/([a-z]{2})(?:[-_/?#]|$)", 1)
    blank = lambda c: F.when(c != "", c)
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*)", 1)
    found = pages.select(
        F.regexp_extract(url, r"/(\d{1,18})/?(?:[?#].*)?$", 1).try_cast("long").alias("doc_id"),
        blank(F.lower(F.regexp_extract(tag, r"(?is)(?:^|[\s\"'])(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})", 1))).alias("declared"),
        F.coalesce(country, blank(path)).alias("suffix"),
        blank(host).alias("host"),
    )
    kinds = [F.mode(x, True).alias(x) for x in ("declared", "suffix", "host")]
    return found.filter("doc_id is not null").groupBy("doc_id").agg(*kinds)


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def identify(docs: DataFrame, model: Model, evidence: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, lang, confidence, text_lang and keep of every row of ``docs`` (doc_id, text, source).

    ``evidence`` has at most one row per doc_id (declared, suffix, host); a null is no evidence. A text without letters,
    null or empty, has lang null and is not kept; nor is one whose best language is less likely than ``least``.
    Ties go to the language first in the alphabet. Without any language in the model nothing is kept.

    The result is stored: a filter on it, pushed down into its expressions, would repeat them a thousandfold in one condition.
    """
    langs = model.languages
    if not langs:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                           F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("keep"))
    rows = text_evidence(docs, model)
    if evidence is not None:
        rows = rows.join(evidence.select("doc_id", "declared", "suffix", "host"), "doc_id", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("declared", "suffix", "host")})
    texts = [f"t_{i}" for i in range(len(langs))]
    shares = dict(zip([f"p_{i}" for i in range(len(langs))], _softmax([F.col(t) for t in texts]), strict=True))
    none = F.col("letters") == 0
    with small_batches(docs.sparkSession):
        rows = durable(rows.withColumns({n: F.when(none, 0.0).otherwise(F.round(c, 9)) for n, c in shares.items()}), "languages")

    def totals(*by: str) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(F.col(p).cast("decimal(28,9)")).cast("double").alias("s" + p) for p in shares])

    # agreement of declared languages and suffixes with the texts: at most a row per language and one for others
    scores = {t: F.col(t) for t in texts}
    for kind in ("declared", "suffix"):
        known = F.when(F.col(kind).isin(langs), F.col(kind)).when(F.col(kind).isNotNull(), "other")
        table = {r[kind]: [r[f"sp_{i}"] for i in range(len(langs))] for r in rows.withColumn(kind, known).filter(F.col(kind).isNotNull()).groupBy(kind).agg(
            *[F.sum(F.col(p).cast("decimal(28,9)")).cast("double").alias("s" + p) for p in shares]).collect()}
        for i, t in enumerate(texts):
            total = sum(v[i] for v in table.values())
            chance = F.lit(0.0)
            for value in [*langs, "other"]:
                likely = (table.get(value, [0.0] * len(langs))[i] + 1) / (total + len(langs) + 1)
                chance = F.when(known == value, F.lit(float(np.log(likely)))).otherwise(chance)
            scores[t] = scores[t] + chance
    # host, site and corpus shares, each without the row itself and smoothed towards the next
    corpus = totals().first()
    whole = sum(corpus) if corpus[0] is not None else 0.0
    rows = rows.withColumns(scores)
    for level in ("site", "host"):
        sums = totals(level).filter(F.col(level).isNotNull())
        sums = sums.select(level, *[F.col(f"sp_{i}").alias(f"{level}_{i}") for i in range(len(langs))])
        rows = rows.join(sums, level, "left")
    prior = [F.lit(((corpus[i] or 0.0) + 1) / (whole + len(langs))) for i in range(len(langs))]
    for level in ("site", "host"):
        own = [F.greatest(F.coalesce(F.col(f"{level}_{i}"), F.lit(0.0)) - F.when(F.col(level).isNotNull(), F.col(f"p_{i}")).otherwise(0.0), F.lit(0.0)) for i in range(len(langs))]
        n = sum(own[1:], own[0])
        prior = [(o + F.lit(PRIOR_ROWS) * p) / (n + F.lit(PRIOR_ROWS)) for o, p in zip(own, prior, strict=True)]
    rows = rows.withColumns({f"f_{i}": F.col(f"t_{i}") + F.log(prior[i]) for i in range(len(langs))})
    chances = _softmax([F.col(f"f_{i}") for i in range(len(langs))])
    rows = rows.withColumns({f"c_{i}": F.round(c, 6) for i, c in enumerate(chances)})
    best = F.greatest(*[F.col(f"c_{i}") for i in range(len(langs))]) if len(langs) > 1 else F.col("c_0")
    lang, by_text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in range(len(langs) - 1, -1, -1):
        lang = F.when(F.col(f"c_{i}") == best, langs[i]).otherwise(lang)
        by_text = F.when(F.col(f"p_{i}") == F.greatest(*shares, F.lit(0.0)), langs[i]).otherwise(by_text)
    told = rows.select(
        "doc_id",
        F.when(none, None).otherwise(lang).alias("lang"),
        F.when(none, 0.0).otherwise(best).alias("confidence"),
        F.when(none, None).otherwise(by_text).alias("text_lang"),
        (~none & (best >= least)).alias("keep"),
    )
    return durable(told, "told")
