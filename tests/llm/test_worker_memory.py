"""Python workers live on over stages, so what Arrow keeps in them counts against their executor."""

import pyarrow as pa

from stormlane.llm import bpe, common


class Frame:
    """Hands back the function that mapInArrow gets."""

    def __init__(self):
        self.sparkSession = self.conf = self

    def get(self, key):
        return "1m"

    def mapInArrow(self, run, schema):
        return run


def test_what_arrow_has_freed_goes_back_after_each_batch_and_task(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    run = common.map_arrow(Frame(), lambda batches: (b for b in batches), "n long")
    batches = [pa.RecordBatch.from_arrays([pa.array([n])], ["n"]) for n in range(3)]
    seen = []
    for batch in run(batches):
        seen.append((batch.column(0)[0].as_py(), Pool.released))
    assert seen == [(0, 0), (1, 1), (2, 2)] and Pool.released == 4
    assert list(run([])) == [] and Pool.released == 5


def test_texts_are_encoded_in_small_parts_and_none_is_left_out():
    texts = ["word " * 20_000] * 12 + ["x" * 900_000, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(bpe.in_parts(batch, 1))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 400_000 for p in parts)
