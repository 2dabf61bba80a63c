"""What a step leaves in its worker."""

import pyarrow as pa
import public_tokenizers

from strandlake.llm import common, packing


def test_steps_give_memory_back(monkeypatch):
    said = []
    monkeypatch.setattr(common, "_trim", lambda: said.append(1))
    rows = common.tidy(lambda batches: (b + 1 for b in batches))
    assert list(rows(iter([1, 2]))) == [2, 3] and said == [1]
    some = rows(iter([1, 2]))
    next(some), some.close()
    assert said == [1, 1]


def test_trim_runs():
    common._trim()


def test_no_encoder_stays_with_the_worker(monkeypatch):
    monkeypatch.setattr(packing, "_ENCODERS", {})
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    (out,) = packing._pieces(public_tokenizers.path("byte_bpe_50k.json"), 2048, 0, True)(iter([batch]))
    assert out.num_rows == 1 and not packing._ENCODERS
