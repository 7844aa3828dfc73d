"""The stages over a folder of small tables, each against what its operator should leave."""

import pytest

import corpus_pipeline
from strandline.llm.bpe_prefix import default_path


@pytest.fixture(scope="module")
def sf(spark, prose, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for k in range(120):
        bad = k % 3 == 2
        text = "\n".join(prose(k * 9 + j, 40) for j in range(4))
        rows.append((k, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((k, 0 if bad else 1, 0))
    good = dict(rows)
    rows += [(200, good[0]), (201, good[1].replace(" ", "  ")), (202, prose(7777, 100) + "\n" + prose(31, 30) + "\n" + prose(7778, 30)), (203, None), (204, ""), (205, prose(5555, 60) + "\n" + "\n".join(good[3].split("\n")[1:3]))]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(31, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf, prose):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        left.append({r["doc_id"]: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == columns
    clean = {k for k in range(120) if k % 3 != 2}
    assert clean <= set(left[0]) and not set(left[0]) & {k for k in range(120) if k % 3 == 2}
    assert 200 not in left[1] and left[1][205]["text"] == prose(5555, 60) and clean <= set(left[1])
    assert 201 not in left[2] and clean <= set(left[2])
    assert 202 in left[2] and 202 not in left[3] and clean <= set(left[3])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    library.no_truncation()
    assert set(left[4]) == set(left[3])
    assert all(r["n_tokens"] == len(library.encode(left[3][i]["text"] or "", add_special_tokens=False).ids) for i, r in left[4].items())
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: r["ids_sha256"] for i, r in left[4].items()}
