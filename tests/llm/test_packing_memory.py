"""Memory of a packing task."""

import random
import tracemalloc
import urllib.parse

import pyarrow as pa
import pyarrow.parquet as pq

from labelforge.llm import packing
from labelforge.llm.common import slices_by_size


def test_a_task_tokenizes_small_slices():
    encoder = packing.Encoder(packing.vocabulary(), packing.END)
    words = " ".join(f"word{i % 900} and text" for i in range(400))
    batch = pa.RecordBatch.from_pydict({"text": [words] * 1200})
    assert batch.nbytes > 7 << 20
    first = packing.tokenize([words], encoder)[0]
    tracemalloc.start()
    tokens = 0
    for part in slices_by_size(iter([batch]), "text", 1024, packing.SLICE_BYTES):
        tokens += len(packing.tokenize(part["text"].to_pylist(), encoder)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens == 1200 * len(first)
    assert peak < 160 << 20


def test_a_worker_forgets_parts_beyond_its_cache():
    encoder = packing.Encoder(packing.vocabulary(), packing.END)
    for at in range(0, 400_000, 100_000):
        encoder.numbers([f"{i}" for i in range(at, at + 100_000)])
    assert len(encoder.known) <= 300_000


def curve_rows(spark, rows, ids):
    """Documents on the curve, in one task: ``ids`` makes the bytes of a row's ids."""
    made = [(i, i * 7919 % rows, len(ids(i)) // 2, bytearray(ids(i))) for i in range(rows)]
    return spark.createDataFrame(made, "doc_id bigint, key bigint, tokens bigint, ids binary").coalesce(1)


def staged_by(monkeypatch):
    """Collects what ``line_up`` stages."""
    kept = []

    def stage(*args):
        kept.append(common_stage(*args))
        return kept[-1]
    common_stage = packing.stage
    monkeypatch.setattr(packing, "stage", stage)
    return kept


def test_row_groups_of_the_stages_are_small(spark, monkeypatch):
    kept = staged_by(monkeypatch)
    rows = curve_rows(spark, 700, lambda i: random.Random(i).randbytes(64 << 10))   # 44 MB in one file
    packing.line_up(rows)
    assert len(kept) == 2
    for staged in kept:
        for path in staged.inputFiles():
            meta = pq.ParquetFile(urllib.parse.urlparse(path).path).metadata
            assert all(meta.row_group(g).total_byte_size <= 24 << 20 for g in range(meta.num_row_groups))


def test_ranges_follow_the_ids_however_well_they_compress(spark, monkeypatch):
    kept = staged_by(monkeypatch)
    monkeypatch.setattr(packing, "RANGE_IDS", 10_000, raising=False)
    rows = curve_rows(spark, 200, lambda i: bytes(20_000))
    lined = packing.line_up(rows)
    held = kept[1].groupBy("part").sum("tokens").collect()
    assert len(held) > 100 and max(r[1] for r in held) <= 50_000
    at = sorted((r["at"], r["doc_id"]) for r in lined.select("at", "doc_id").collect())
    assert [a for a, _ in at] == list(range(0, 200 * 10_000, 10_000))
    assert [i * 7919 % 200 for _, i in at] == list(range(200))


def test_a_worker_holds_little_beside_its_batch():
    encoder = packing.Encoder(packing.vocabulary(), packing.END)
    texts = [" ".join(f"{i * 400 + w:x}q" for w in range(400)) for i in range(900)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert batch.nbytes > 2 << 20
    tracemalloc.start()
    for part in slices_by_size(iter([batch]), "text", 1024, packing.SLICE_BYTES):
        packing.tokenize(part["text"].to_pylist(), encoder)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85 << 20
