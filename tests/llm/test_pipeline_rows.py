"""The corpus pipeline over nulls, blank and repeated rows, ties and an empty table."""

from collections import Counter

import corpus_pipeline
import pytest

from tests.llm.test_llm_operators import check_packing, plain_copies, texts_of
from zocalo.llm import mixing
from zocalo.session import run_dir

PARTS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat sat on the mat and looked at the moon while the rain fell over the old town and nobody came home. "
FR = "le chat est assis sur le tapis et regarde la lune pendant que la pluie tombe sur la vieille ville et que personne ne rentre. "


def folder_of(spark, rows):
    folder = run_dir(spark, "odd")
    spark.createDataFrame(rows, PARTS).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def rows():
    own = [(i, (EN if i % 2 else FR) * (1 + i % 3) + f"number {i} of {i * i} in its own words {'x' * i}", "en" if i % 2 else "fr", f"s{i % 3}" if i % 4 else None, 1) for i in range(60)]
    own += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t", None, "s1", 3), (None, EN * 2 + "no id", "en", "s1", None), (103, "12 34 !!", None, None, 8)]
    own += [own[5], own[5], (104, own[7][1], "en", "s2", 1), (105, own[7][1].upper(), "en", "s2", 1), (106, EN * 2000, "en", "s0", 1), (107, "mail me at a.b@site.org or +1 (517) 555-5141. " + EN, "en", "s1", 1)]
    return own


def test_run_over_odd_rows(spark, rows):
    folder = folder_of(spark, rows)
    packed = corpus_pipeline.run(spark, folder).collect()
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        seen[name] = frame = spark.createDataFrame(frame.collect(), frame.schema)
    spoken = texts_of(seen["language"])
    assert not any(not any(c.isalpha() for c in t) for _, t in spoken)
    assert seen["near_duplicates"].count() == len(set(plain_copies([t for _, t in spoken]))) < len(spoken)
    assert not any("@site.org" in t or "555-5141" in t for _, t in texts_of(seen["personal_data"]))
    taken = mixing.mix_report(seen["personal_data"]).agg({"taken": "sum"}).first()[0]
    assert sum(len(t.split()) for _, t in texts_of(seen["mixing"])) == taken
    check_packing(seen["packing"].collect(), texts_of(seen["mixing"]))
    ids = lambda rows: sum((Counter({str(r["doc_id"]): r["length"]}) for r in rows), Counter())  # noqa: E731  where they are cut depends on the parts
    assert ids(packed) == ids(seen["packing"].collect())


def test_run_over_nothing(spark):
    folder = folder_of(spark, [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_keep_clashing_columns(spark, rows):
    wide = spark.createDataFrame([(*r, "other", 7, "x") for r in rows[:20]], PARTS + ", TEXT string, row long, fp string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns, name
        assert out.count() >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, wide, "").count() >= 20
