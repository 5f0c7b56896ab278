"""What a Python worker takes and keeps."""

import time
import tracemalloc

import pyarrow as pa
from sievelight.llm import bpe, crf, queries
from sievelight.llm.hashing import batches


def test_rules_work_on_small_slices():
    """Rules over 4 MB of texts take a small multiple of a slice, and give what they give text by text."""
    texts = [f"A line of some words {i}.\n# 12 | 34 | $$$ {i}\n" * 40 for i in range(2200)]
    batch = pa.record_batch({"text": pa.array(texts)})
    assert batch.nbytes > 3_500_000
    field = crf.Field.neutral()
    verdict = lambda texts: [x.tolist() for x in crf.verdicts(crf.measure(texts), field, 50, 0.5, 0.5)]
    tracemalloc.start()
    got = [verdict(raw) for _, raw in batches(iter([batch]), crf.SLICE_BYTES)]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60_000_000
    alone = [verdict([t.encode()]) for t in texts[:50]]
    for i in range(3):
        assert [x for part in got for x in part[i]][:50] == [x for part in alone for x in part[i]]


def test_an_idle_worker_gives_up_its_encoder(monkeypatch):
    import public_tokenizers

    ranks = bpe.load_ranks(queries.tokenizer_file())
    monkeypatch.setattr(bpe, "IDLE_S", 0.2)
    monkeypatch.setattr(bpe, "_held", None)
    bpe.take_up()
    first = bpe.encoder("key", ranks, public_tokenizers.PATTERN)
    bpe.put_down()
    bpe.take_up()  # the next task comes in time
    time.sleep(0.5)
    assert bpe.encoder("key", ranks, public_tokenizers.PATTERN) is first
    bpe.put_down()
    time.sleep(0.5)
    assert bpe._held is None
    bpe.take_up()
    ids = bpe.encoder("key", ranks, public_tokenizers.PATTERN).encode(["again a text"])
    assert ids == first.encode(["again a text"])
