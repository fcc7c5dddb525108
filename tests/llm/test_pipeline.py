import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, text(rng.randrange(30, 90))) for i in range(40)]
    rows += [(50, rows[2][1]), (51, rows[2][1]), (52, f"{text(40)} {passage} {text(40)}"), (53, f"{text(45)} {passage} {text(35)}")]
    rows += [(60, f"You are an idiot and a worthless loser. {text(20)}"), (61, f"{text(12)} password = 'abcdefghijklmnop' {text(12)}"), (62, None), (63, "")]
    place = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(place / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
    return str(place)


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            seen[name] = {r.doc_id: r for r in docs.collect()}
    toxic, near, passages, secrets = seen.values()
    assert 60 not in toxic and set(range(40)) <= set(toxic) and {50, 62, 63} <= set(toxic)
    assert 2 in near and not {50, 51} & set(near) and {52, 53} <= set(near)
    assert len({62, 63} & set(near)) == 1
    assert "p20" in passages[52].text and not re.search(r"\bp\d", passages[53].text)
    assert passages[53].n_chars == len(passages[53].text) and passages[0].text == near[0].text
    assert "abcdefghijklmnop" not in secrets[61].text and secrets[61].n_chars == len(secrets[61].text)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(secrets)


def test_run_equals_the_stages(spark, folder):
    assert pipeline.run(spark, folder).count() > 40


def test_odd_rows_through_every_stage(spark, docs, rows):
    """Null and repeated ids, extra columns whose names the operators use, and one id with two texts that do not link."""
    two = spark.createDataFrame([(900, "alpha beta gamma delta epsilon zeta eta theta"), (900, "one two three four five six seven eight nine"), (900, "one two three four five six seven eight nine")], "doc_id long, text string")
    odd = docs.unionByName(two, allowMissingColumns=True).withColumns({"id": docs.block, "sha": docs.block, "__sha": docs.block, "least": docs.fp, "row": docs.fp})
    for name, stage in pipeline.STAGES[1:4]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns
        left = out.collect()
        if name == "near_duplicates":
            assert sorted(r.text[:3] for r in left if r.doc_id == 900) == ["alp", "one"]
            assert len({(r.doc_id, r.text) for r in left}) == len(left)
            gone = {t for _, t in rows} - {r.text for r in left}
            assert None in {r.text for r in left} or "" in {r.text for r in left} or "   \n\t " in {r.text for r in left}
            # What went has a copy, or words that near-copies hold too.
            assert len(gone) < 10
        else:
            assert len(left) == odd.count()
    packed = pipeline.STAGES[4][1](spark, odd, "").where("start = 0")
    assert packed.count() == odd.count()


def test_empty_table(spark, docs, empty, folder):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
