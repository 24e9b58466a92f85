"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

import os

import corpus_pipeline
from quern.llm import source_mix
from quern.llm.common import staged_here

from . import cases

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        seen.append((docs, docs := spark.read.parquet(str(tmp_path / str(k)))))
    assert all(set(out.columns) == set(corpus_pipeline.COLUMNS) for _, out in seen[:-1])
    before, after = seen[1]
    first = [i for i, _, c in cases.ngram_components([(r.doc_id, r.text) for r in before.collect()], 5, 80) if c == i]
    assert sorted(r.doc_id for r in after.collect()) == sorted(first)
    before, after = seen[2]
    whole = [(r.doc_id, cases.WORD.findall(r.text or "")) for r in before.collect()]
    plain = {i: [w for w, gone in zip(words, marks, strict=True) if not gone] for (i, words), marks in zip(whole, cases.repeated([w for _, w in whole], 51), strict=True)}
    assert {r.doc_id: cases.WORD.findall(r.text) for r in after.collect()} == {i: w for i, w in plain.items() if w} and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen[3]
    taken = {r.doc_id: r.copies for r in source_mix.mix_sources(before).collect()}
    assert after.count() == sum(taken.values())
    assert seen[4][1].count() == after.count()


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty, blank, very long and repeated texts, null ids and clashing columns: each stage keeps its promise."""
    docs, seen = cases.documents(spark), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    assert all(set(r.asDict()) == set(corpus_pipeline.COLUMNS) for rows in seen[:-1] for r in rows)
    assert not [r for r in seen[0] if not (r.text or "").split()]
    texts = [r.text for r in seen[1]]
    assert texts and len(texts) == len({tuple(sorted(cases.shingles(t, 5))) for t in texts})
    assert all(cases.WORD.findall(r.text) and r.n_chars == len(r.text) for r in seen[2]) and len(seen[4]) == len(seen[3])


def test_near_duplicates_give_up_their_scratch_before_texts_move(spark):
    before = set(staged_here())
    kept = corpus_pipeline.near_duplicates(spark, cases.documents(spark), SF)
    assert [x.rpartition("-")[2] for x in staged_here() if x not in before] == ["rows", "first"]
    assert kept.count() > 0


def test_stages_without_rows(spark, tmp_path):
    docs = cases.documents(spark, [])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_stages_chained_lazily_and_interleaved(spark, tmp_path):
    """Two runs over different folders take turns, and one leaves its stages unwritten."""
    docs = {k: cases.documents(spark, [(10 * i + k, f"{'good plain words here ' * (i + 1)} number{i} of{k}", "en", "a") for i in range(8)]) for k in (1, 2)}
    steps = [f for _, f in corpus_pipeline.STAGES]
    lazy = docs[1]
    written = docs[2]
    for n, step in enumerate(steps[1:4]):
        lazy = step(spark, lazy, SF)
        step(spark, written, f"{SF}/").write.parquet(str(tmp_path / f"{n}"))
        written = spark.read.parquet(str(tmp_path / f"{n}"))
    assert lazy.count() > 0 and written.count() > 0


def test_run_leaves_one_folder(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.count() > 0
    home = os.path.dirname(result.inputFiles()[0].removeprefix("file:"))
    assert [x for x in os.listdir(os.path.dirname(home)) if x.startswith(os.path.basename(home)[:-2])] == [os.path.basename(home)]


def test_words_are_cut_with_the_blanks_between():
    assert corpus_pipeline.without_words(" a  b\nc é d ", [(1, 3)]) == " a   é d "
    assert corpus_pipeline.without_words("a é b", [(0, 1), (2, 3)]) == " é "
