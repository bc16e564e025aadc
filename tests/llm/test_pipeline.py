"""The pipeline's stages: columns, decisions that take effect, edge rows, empty tables."""

from collections import defaultdict

import numpy as np
import pytest
from conftest import rows

import corpus_pipeline
from skein.llm.common import staged


def test_stages_in_order(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, tables), f"test-{name}")
        assert docs.columns == names
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)


def test_each_decision_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    exact = staged(stage["exact_dedup"](spark, docs, tables), "test-e")
    texts = [r.text or "" for r in exact.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, _, _ in rows()})
    near = stage["near_dedup"](spark, exact, tables).collect()
    assert {r.doc_id for r in exact.collect()} - {r.doc_id for r in near} <= {*range(101, 126), 144, 147}  # 144 is 143 in capitals
    assert len([r for r in near if r.doc_id in {*range(100, 126), 147}]) == 1


@pytest.mark.parametrize("folder", ["tables", "empty_tables"])
def test_run(spark, request, folder):
    found = corpus_pipeline.run(spark, request.getfixturevalue(folder))
    assert {"doc_id", "bin", "capacity"} <= set(found.columns)
    assert (found.count() > 0) == (folder == "tables")


def test_mixing_keeps_every_row_in_the_order_of_the_mix(spark):
    """A source of one row runs dry at once; the rows of the others stay, and null ids and repeated ids do."""
    docs = [(i, f"text {i}", "web") for i in range(3000)] + [(5000 + i, f"book {i}", "book") for i in range(300)] + [(9000, "rare", None), (None, "x", "web"), (None, "y", "web"), (7, "again", "web")]
    docs = staged(spark.createDataFrame(docs, "doc_id long, text string, source string"), "test-mixing")
    found = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").collect()
    assert sorted(r.text for r in found) == sorted(r.text for r in docs.collect())
    first = [r.source for r in found[:400]]
    assert 60 < first.count("book") < 140  # by the roots of the counts: a quarter, not the eleventh of the table
    assert {r.source for r in found[-1000:]} == {"web"}  # the others have run dry


def test_packing_follows_the_mix(spark):
    """Bins in the order of the mix hold its shares from the first ones on, whatever files the table came in."""
    rng = np.random.default_rng(5)
    docs = [(i, "w " * int(n), "web" if i < 3000 else "book") for i, n in enumerate(rng.integers(1, 600, 3300))] + [(None, "long " * 9000, "book"), (8000, None, None)]
    docs = staged(spark.createDataFrame(docs, "doc_id long, text string, source string"), "test-order")
    stage = dict(corpus_pipeline.STAGES)
    mixed = staged(stage["mixing"](spark, docs, ""), "test-mixed")
    found = staged(stage["packing"](spark, mixed, ""), "test-packed").collect()
    tokens = {r.doc_id: len((r.text or "").split()) + 1 for r in docs.collect()}
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == tokens and all(len({a for a, _ in p}) == len(p) for p in pieces.values())
    assert len({(r.place, r.shard, r.bin) for r in found}) == len({(r.shard, r.bin) for r in found})
    by_place = [r.doc_id for r in sorted(found, key=lambda r: (r.place, r.shard, r.bin)) if r.doc_id is not None and r.doc_id < 8000]
    book = [3000 <= d for d in by_place]
    assert 60 < sum(book[:400]) < 140 and 120 < sum(book[:800]) < 280  # a quarter, as in the mix; not the eleventh of the table
    assert not any(book[-1000:])  # they have run dry


def test_the_order_is_that_of_the_files(spark, monkeypatch):
    """Files of very different sizes, which Spark reads largest first; windows are consecutive runs of pieces."""
    from skein.llm import packing

    monkeypatch.setattr(packing, "WINDOW_PIECES", 50)
    sizes = [3, 400, 20, 1, 177]
    rows = [(i, "w " * (i * 37 % 300), part) for i, part in enumerate(p for p, n in enumerate(sizes) for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartitionByRange(5, "part").sortWithinPartitions("doc_id").drop("part")
    for given in (staged(docs, "test-files"), docs):
        one = packing.pack_in_order(given).collect()
        assert sorted(r.id for r in one) == list(range(sum(sizes)))
        windows = defaultdict(list)
        shards = max(1, -(-len(rows) // 50), min(packing.shuffle_partitions(spark), -(-len(rows) // 200)))
        for r in one:
            windows[r.shard if r.shard < shards else None].append(r.id)
        loose = windows.pop(None, [])
        each = -(-len(rows) // shards)
        assert windows and all(i // each == s for s, ids in windows.items() for i in ids) and len(loose) < len(rows)
        for r in one:
            if r.shard >= shards:  # loose bins meet those of eight windows
                assert r.id // each // packing.REPACK_SHARDS == r.shard - shards
        assert all(r.place // each == r.shard for r in one if r.shard < shards)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_an_empty_table(spark, empty_tables, name):
    docs = spark.read.parquet(f"{empty_tables}/documents.parquet")
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, empty_tables)
    assert found.collect() == [] and (name == "packing" or found.columns == docs.columns)


def test_rejected_documents_go(spark, tables):
    """The quality stage keeps what the classifier predicts 1 for, row by row, null and repeated ids as well."""
    from skein.llm.entry import QUERIES

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["quality"](spark, docs, tables).collect()
    want = sorted(str(r.doc_id) for r in QUERIES["op3_quality_classifier"](spark, tables).collect() if r.predicted == 1)
    assert sorted(str(r.doc_id) for r in kept) == want
