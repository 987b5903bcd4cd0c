"""Cases that once went wrong: letters, rows without ids, clashing names, file order, sessions without a shared folder."""

from types import SimpleNamespace

import numpy as np
import pytest

from spanfold.llm import common, language_id, near_copies, quality_rules, simhash, token_files, weak_quality


def test_numerals_are_no_letters(spark):
    rows = [(i, "the cat is here", "en") for i in range(40)] + [(50, "²½", None), (51, "Ⅷ 12 ¾", None), (52, "ª", None), (53, "_", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (50, 51, 53)] == [("und", 0.0)] * 3 and got[52].lang_pred == "en"


def test_rows_without_ids_do_not_fill_the_samples(spark, monkeypatch):
    plain = " ".join(f"w{i}" for i in range(60))
    own = [(i, plain + " #x" * (i % 50)) for i in range(300)]
    docs = spark.createDataFrame(own, "doc_id long, text string").unionByName(spark.range(30_000).selectExpr("cast(null as bigint) doc_id", f"'{plain}' text"))
    seen = []
    monkeypatch.setattr(quality_rules, "Forest", lambda rows, *a: seen.append(rows))
    quality_rules.fit_forest(quality_rules.rule_statistics(docs))
    assert len(seen[0]) == 301
    taken = []
    train = weak_quality.train
    monkeypatch.setattr(weak_quality, "train", lambda rows: (taken.append(len(rows)), train(rows))[1])
    monkeypatch.setattr(weak_quality, "SAMPLE", 1 << 20)
    assert weak_quality.classify(docs).count() == 30_300 and taken == [301]


@pytest.mark.parametrize("stage", [simhash.one_of_each, near_copies.one_of_each])
def test_a_column_named_like_ours_keeps_its_values(spark, stage):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(2, text, 77, "a"), (1, text, 88, "b"), (None, text, 99, "c"), (3, "other words entirely", 66, "d")], "doc_id long, text string, _row_number int, component string")
    kept = stage(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, text, 88, "b"), (3, "other words entirely", 66, "d")]


def test_file_names_sort_like_their_numbers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    (path,) = [r.path for r in token_files.write_files(docs, f"file://{tmp_path}", "/opt/tokenizers/word_bpe_49k.json").collect()]
    digits = path.rsplit("-", 1)[1].split(".")[0]
    assert len(digits) >= 10 and digits.isdigit()


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(sparkContext=SimpleNamespace(_spanfold_shipped=True, master=master), conf=SimpleNamespace(get=lambda *a: None))
        with pytest.raises(ValueError):
            common.shared_dir(session, "x")


def test_release(spark, tmp_path):
    made = common.shared_dir(spark, "thing")
    kept = common.stored(spark.range(3), made, "rows")
    assert kept.count() == 3
    common.release(spark)
    files, path = common.open_fs(made)
    assert files.get_file_info(path).type.name == "NotFound"


def test_narrow_numbers_and_planes():
    for values in ([], [0, 255], [256], [1 << 40]):
        a = np.array(values, np.int64)
        assert common.smallest(a).tolist() == values and common.from_planes(common.planes(a), np.int64).tolist() == values
