"""The pipeline's stages on nulls, empty and repeated rows, clashing columns and empty tables, and its whole run."""

import corpus_pipeline
import numpy as np
import pytest

from limitloom.llm import surrogates

# Further columns named like those the operators make for themselves.
CLASHING = "h size row at nth hits gaps n key part found windows label node kind surrogate sequence_id".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} int" for c in CLASHING)
ITEM = "In the town of Northfield a farmer sells 12 apples and 5 kg of flour to Anna, then Anna gives 12 apples back"
OTHER = "In the town of Southport a farmer sells 31 apples and 8 pounds of flour to Maria, then Maria gives 31 apples back"


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def docs_of(frame, *rows):
    return frame(SCHEMA, *[(i, t, "en", "s", len(t or ""), *range(len(CLASHING))) for i, t in rows])


def listed(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@pytest.fixture
def folder(spark, frame, tmp_path):
    frame("item_id long, text string", (1, ITEM), (1, ITEM), (2, None), (3, "")).write.parquet(str(tmp_path / "benchmark.parquet"))
    frame("page_id long, url string, html string", (1, "http://a.example/1", "<html lang=en>"), (2, None, None)).write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_decontamination_keeps_all_but_documents_with_items(frame, spark, folder):
    a, b = prose(1), prose(2)
    docs = docs_of(frame, (1, "x " + ITEM), (2, OTHER), (3, a), (3, a), (4, None), (5, ""), (None, a), (7, b + " " + ITEM.lower() + " " + b))
    out = corpus_pipeline.decontaminate(spark, docs, folder)
    assert out.columns == docs.columns
    assert listed(out) == sorted([(3, a), (3, a), (4, None), (5, ""), (None, a)], key=repr)


def test_private_data_is_replaced_row_by_row(frame, spark, folder):
    mail, long_ = "Write to ann.lee@mail.example.com", prose(5, 20_000)
    docs = docs_of(frame, (1, mail), (1, mail), (2, "clean"), (3, None), (4, ""), (None, mail + " now"), (6, long_))
    out = corpus_pipeline.private_data(spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert len(rows) == 7 and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert all("ann.lee" not in (r.text or "") for r in rows)
    assert len({r.text for r in rows if r.doc_id == 1}) == 1 and [r.text for r in rows if r.doc_id is None][0].endswith(" now")
    assert {(r.doc_id, r.text) for r in rows if r.doc_id in (2, 3, 4, 6)} == {(2, "clean"), (3, None), (4, ""), (6, long_)}


def test_count_of_surrogates_gives_way_to_a_column_of_its_name(frame):
    docs = frame("doc_id long, text string, N_replaced int", (1, "a@b.de and c@d.de", 7), (2, None, 8))
    out = surrogates.replace(docs, "k", count="n_replaced")
    assert out.columns == ["doc_id", "text", "N_replaced", "n_replaced_"]
    assert {(r.doc_id, r.N_replaced, r.n_replaced_) for r in out.collect()} == {(1, 7, 2), (2, 8, 0)}


def test_stages_of_empty_tables(frame, spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_of(frame), folder)
        assert out.count() == 0, name
        if name != "best_fit_packing":
            assert out.columns == docs_of(frame).columns, name


def test_packing_places_every_row(frame, spark, folder):
    rows = corpus_pipeline.pack(spark, docs_of(frame, (1, "one two"), (1, "one two"), (2, None), (3, ""), (4, prose(9, 3000))), folder).collect()
    assert sorted(r.length for r in rows if r.doc_id in (2, 3)) == [1, 1] and len([r for r in rows if r.doc_id == 1]) == 2
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 4)
    assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(s + n == t for (_, s, n), (_, t, _) in zip(pieces, pieces[1:], strict=False))
    for seq in {r.sequence_id for r in rows}:
        held = sorted((r.offset, r.length) for r in rows if r.sequence_id == seq)
        assert held[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(held, held[1:], strict=False)) and sum(held[-1]) <= 2048


def test_whole_run_follows_each_stages_decisions(frame, spark, folder):
    texts = [prose(i, 80) for i in range(12)]
    copies = [(20, texts[0] + " more"), (21, texts[0]), (22, texts[1])]
    frame_ = docs_of(frame, *enumerate(texts), *copies, (30, "so " + ITEM), (31, None), (32, "12 34"))
    frame_.write.parquet(folder + "/documents.parquet")
    told = {i for i, _ in listed(corpus_pipeline.language(spark, frame_, folder))}
    assert set(range(12)) <= told and 31 not in told
    packed = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert packed == told - {20, 21, 22, 30}
