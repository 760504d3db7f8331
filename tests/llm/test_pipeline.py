"""The pipeline's stages against brute force on a small corpus, and its odd tables."""

import itertools
import random

import pytest

import corpus_pipeline
from rulefold.llm.language import UNKNOWN
from tests.llm.conftest import prose
from tests.llm.test_operators import brute_links, brute_repeats, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents and benchmark."""
    path = tmp_path_factory.mktemp("sf")
    passage = prose(500, 90)
    rows = [(i, prose(1000 + i, 60 + i), "en") for i in range(30)]
    rows += [(40, rows[3][1], "en"), (41, rows[4][1].replace(" ", "  ", 3), None)]  # an exact copy, and one of the same words
    rows += [(50, f"{prose(60, 70)}\n{passage}\n{prose(61, 60)}", "en"), (51, f"{prose(62, 80)}\n{passage}", "en"), (52, passage, "en")]
    item = " ".join(words(rows[7][1])[10:26])
    rows += [(60, "12 34", "en"), (61, None, "en"), (62, "", None)]
    docs = [(k, t, lang, f"src{k % 3}", len(t or "")) for k, t, lang in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "nothing of this kind is there at all in any of them")], "item_id int, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "passages", "decontamination", "packing"]
    known = stages["language_id"](spark, docs, folder)
    assert known.columns == columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {60, 61, 62}
    rows = [(r.doc_id, r.text) for r in known.orderBy("doc_id").collect()]
    _, group = brute_links(rows)
    single = stages["near_duplicates"](spark, known, folder)
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {rows[g][0] for g in group} and 40 not in {r.doc_id for r in single.collect()}
    rows = [(r.doc_id, r.text) for r in single.orderBy("doc_id").collect()]
    cut = stages["passages"](spark, single, folder)
    assert cut.columns == columns and cut.schema == single.schema
    got = {r.doc_id: r for r in cut.collect()}
    for (k, t), (n, removed, _, _) in zip(rows, brute_repeats(rows, 400, True), strict=True):
        if n == removed and n:
            assert k not in got
        else:
            assert len(got[k].text.encode()) == n - removed and got[k].n_chars == len(got[k].text)
    assert 52 not in got and got[51].n_chars < len(dict(rows)[51])
    clean = stages["decontamination"](spark, cut, folder)
    assert clean.columns == columns and set(got) - {r.doc_id for r in clean.collect()} == {7}
    packed = stages["packing"](spark, clean, folder)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_run_and_empty_tables(spark, folder):
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {7, 40, 41, 52, 60, 61, 62}.isdisjoint({r.doc_id for r in whole}) and {0, 50, 51} <= {r.doc_id for r in whole}
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for (_, stage), last in itertools.zip_longest(corpus_pipeline.STAGES, [False] * 4 + [True]):
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (last or out.columns == docs.columns)
    assert UNKNOWN == "und"


def test_passages_are_counted_in_words(spark):
    """Repeats of 51 to 60 short words go, with other white space too, and of 50 long ones stay."""
    rng = random.Random(8)

    def short(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 4))) for _ in range(n))

    rows, want = [], {}
    for k, n in enumerate([*range(51, 61), 50, 49]):
        passage, head, tail = (short(n), short(30), short(20)) if n > 50 else (prose(900 + n, n), short(30), short(20))
        rows += [(2 * k, f"{short(25)}\n{passage} {short(10)}"), (2 * k + 1, f"{head} {passage.replace(' ', chr(10), 3)} {tail}")]
        want |= {2 * k: rows[-2][1], 2 * k + 1: f"{head} {tail}" if n > 50 else rows[-1][1]}
    signs = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n)) for n in (60, 9, 9, 50)]
    rows += [(90, f"{signs[1]}{signs[0]}"), (91, f"ab {signs[0]}{signs[2]} cd"), (92, signs[3] + "x"), (93, "y " + signs[3]), (94, f" {signs[0]}\n")]
    want |= {90: rows[-5][1], 91: f"ab{signs[2]} cd", 92: rows[-3][1], 93: rows[-2][1]}
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id bigint, text string, n_chars int")
    got = dict(corpus_pipeline.passages(spark, docs, "").select("doc_id", "text").collect())
    assert got == want


def test_stages_on_odd_rows(spark, folder, odd, odd_rows):
    """Null and repeated ids, repeated rows, a very long text, clashing columns, no n_chars."""
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    known = stages["language_id"](spark, odd, folder)
    assert known.columns == odd.columns and ids(known) == sorted(str(r[0]) for r in odd_rows if r[0] not in (1, 2, 3, 5))
    single = stages["near_duplicates"](spark, odd, folder)
    assert single.columns == odd.columns and ids(single) == sorted(str(r[0]) for r in odd_rows if r[0] not in (8, 9))
    cut = stages["passages"](spark, odd, folder)
    assert cut.columns == odd.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert 8 not in texts and texts[7] == odd_rows[6][1] and texts[6] == odd_rows[5][1] and texts[1] is None and None in texts
    assert ids(cut).count("9") <= 1
    assert ids(stages["decontamination"](spark, odd, folder)) == sorted(str(r[0]) for r in odd_rows)
    packed = stages["packing"](spark, odd, folder)
    assert set(ids(packed)) == {str(r[0]) for r in odd_rows} and packed.filter("doc_id = 9 and piece = 0").count() == 2
