"""Pipeline stages decided by row, page evidence from whole pages, and exact scores of wide vectors."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from limitloom.llm import languages, pivots

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def kept(frame, spark, *rows):
    docs = frame(DOCS, *[(i, t, "en", "s", len(t or "")) for i, t in rows])
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_near_duplicates_lose_no_text_of_a_shared_id(frame, spark):
    a, b, own = prose(1), prose(2), prose(3)
    assert kept(frame, spark, (3, a), (3, b)) == sorted([(3, a), (3, b)], key=repr)
    assert kept(frame, spark, (3, a), (9, a), (9, own)) == sorted([(3, a), (9, own)], key=repr)
    assert kept(frame, spark, (3, a), (3, a), (4, a + " more")) in ([(3, a)], [(4, a + " more")])
    assert kept(frame, spark, (1, a), (2, a + " x"), (5, None), (6, ""), (None, a), (7, " ")) == sorted([(1, a), (5, None), (6, ""), (None, a), (7, " ")], key=repr)
    assert kept(frame, spark) == []


def test_page_evidence_reads_whole_pages_and_all_of_them(frame):
    html = "<!-- " + "x" * 600 + " -->\n<html " + "data-a='b' " * 50 + "lang='de'><body lang='fr'>"
    rows = [
        (1, "http://a.example/p/1", html), (2, "http://a.example/p/2", None), (3, "http://b.example.fr/p/2", "<HTML xml:lang=fr-CA>"), (4, "http://b.example.fr/p/2", "<p>"),
        (5, "http://c.example/p/5", "<html><body lang='es'>"), (6, None, None), (7, "http://x/none", "<html lang=en>"),
    ]
    got = {r.doc_id: (r.declared, r.suffix, r.host) for r in languages.page_evidence(frame("page_id long, url string, html string, doc_id int, e int", *[(*r, 0, 0) for r in rows])).collect()}
    assert got == {1: ("de", None, "a.example"), 2: ("fr", "fr", "b.example.fr"), 5: (None, None, "c.example")}


@pytest.mark.parametrize("dim", [1, 2, 130])
def test_scores_of_wide_components_are_exact(frame, dim):
    rng = np.random.default_rng(dim)
    values = [1e6, 3e5, 2.7e5, -1e6, 0.5, 0.25] if dim == 1 else [float(x) for x in rng.integers(-2 * 10**6, 2 * 10**6, 30)]
    rows = [(i, [v] + [float(x) for x in rng.integers(-1000, 1000, dim - 1)]) for i, v in enumerate(values)] + [(90, [values[0]] * dim), (90, [values[0]] * dim)]
    vectors = frame("vec_id long, embedding array<double>, block int, ids int, dim int", *[(*r, 1, 2, 3) for r in rows])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in pivots.search(vectors, F.col("vec_id") == 0).collect()}
    x = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows]
    scored = sorted((-sum(a * b for a, b in zip(x[0][1], v, strict=True)), i) for i, v in x if i != 0)[:10]
    assert got == {(0, k + 1): (i, -s) for k, (s, i) in enumerate(scored)}
    assert pivots.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0
