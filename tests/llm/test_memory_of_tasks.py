"""What a task holds and does beside its rows, without Spark."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from stormglass.llm import quality, token_files
from stormglass.llm import text as T


def texts(n_bytes, seed=0):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(5_000)])
    out = []
    while n_bytes > 0:
        out.append("\n".join(" ".join(words[rng.integers(0, len(words), 12)]) for _ in range(40)))
        n_bytes -= len(out[-1])
    return pa.array(out)


def traced(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_quality_scan_holds_little_of_a_large_batch():
    column = texts(4_000_000)
    n = len(column)
    batch = pa.RecordBatch.from_pydict({"_row": pa.array(range(n)), "_id": pa.array(range(n)),
                                        "_host": pa.array(["h"] * n), "_text": column})
    found = []
    T._powers.clear()
    assert traced(lambda: found.extend(quality._scan(iter([batch])))) < 25
    assert sum(b.num_rows for b in found) == n and len(found) < 10
    alone = [b for i in range(0, n, 97) for b in quality._scan(iter([batch.slice(i, 1)]))]
    whole = pa.Table.from_batches(found).to_pylist()
    assert [b.to_pylist()[0] for b in alone] == whole[::97]


def test_pieces_are_encoded_without_offsets_in_little_memory():
    path = public_tokenizers.path("byte_bpe_50k.json")
    column = texts(4_000_000)
    column = pa.concat_arrays([column, pa.array(["a b <|x|> é c", "", "é ", "  x\n\n y"])])
    coder = token_files.Encoder(path)
    whole = coder.tokenizer

    class Fast:
        calls = 0

        def encode_batch_fast(self, batch, **options):
            Fast.calls += 1
            return whole.encode_batch_fast(batch, **options)

    coder.tokenizer = Fast()
    found = []
    T._powers.clear()
    assert traced(lambda: found.extend(coder.encode_column(column))) < 180
    assert Fast.calls
    got = [ids[a:b].tolist() for _, _, ids, bounds in found for a, b in zip(bounds, bounds[1:])]
    want = [e.ids for e in whole.encode_batch(column.to_pylist(), add_special_tokens=False)]
    assert got == want
