"""The pipeline against a brute-force version of its stages."""

import itertools

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from praxilog.llm import decontam, pieces, queries, toxicity

from .conftest import changed, prose
from .test_copies import plain_fingerprint, plain_removed, united


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("sf")
    items = [(k, prose(900 + k, 30).replace("\n", " ")) for k in range(4)]
    rows = [(i, prose(i, 80)) for i in range(60)] + [(100 + i, prose(i, 80).replace(" ", " nastyfoul ", 4)) for i in range(60, 100)]
    rows += [(200 + k, f"{prose(300 + k, 30)}\n{items[k][1]}\n{prose(400 + k, 30)}") for k in range(4)]
    rows += [(300 + k, changed(prose(7000, 150).replace("\n", " "), k, 1)) for k in range(5)] + [(400, None), (401, ""), (402, prose(3, 80)), (403, "Shared line of some words\n" + prose(501, 60)), (404, "Shared line of some words\n" + prose(502, 60))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = queries.table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    net = queries.toxic_network(docs, queries.table(spark, sf_dir, "labels"))
    rows = [(i, t) for (i, t), s in zip(rows, toxicity.Scorer(net).scores([t or "" for _, t in rows]), strict=True) if s < 0.7]
    assert not any(100 <= i < 200 for i, _ in rows) and len(rows) > 70
    _, gone = plain_removed(spark, rows)
    rows = [(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, t, p) not in gone)) for i, t in rows]
    prints = {i: plain_fingerprint(t) for i, t in rows}
    fps = sorted(set(prints.values()))
    root = united(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(least.get(root[p], i), i)
    rows = [(i, t) for i, t in rows if least[root[prints[i]]] == i]
    finder = decontam.Finder([(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()])
    kept = [(i, t) for i, t in rows if not finder.find(t or "")]
    assert {i for i, _ in rows} - {i for i, _ in kept} == {200, 201, 202, 203}
    codec = pieces.PieceCodec(queries.tokenizer_file("piece_bpe_32k.model"))
    want = sorted((i, codec.encode(t or "").tolist()) for i, t in kept)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.pieces) for r in got) == want and all(r.lossless for r in got)


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
