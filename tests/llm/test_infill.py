"""Fill-in-the-middle over frames against slicing of whole texts."""

import hashlib
import random

import pytest
import zstandard

from stormglass.llm import infill
from stormglass.llm.frames import FrameReader, FrameWriter

SCHEMA = "doc_id long, text string"
MARKS = "<P>", "<S>", "<M>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    digest, n = sha(f"1:{'' if doc_id is None else doc_id}"), len(text)
    h = [int(digest[8 * g:8 * g + 8], 16) for g in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text), text
    a, b, c = text[:lo], text[lo:hi], text[hi:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{a}<S>{c}<M>{b}" if form == "psm" else f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, form, lo, hi - lo, sha(out), sha(text), out


def documents():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("aé日😀\n <PSM>") for _ in range(rng.choice([1, 2, 30, 700])))) for i in range(300)]
    rows += [(None, "no id"), (None, "no id"), (5, "again"), (5, "again"), (1000, None), (1001, ""), (1002, "has <S> in it"),
             (1003, "<" * 9), (1004, "é" * 500_000), (1005, "x<P" * 70_000), (1006, "😀" * 100_000 + "<M>"), (1007, "\x00\r\n")]
    return rows


def key(r):
    return tuple((v is not None, str(v)) for v in r)


@pytest.mark.parametrize("frame_bytes", [64, 65_536])
def test_digests_equal_plain_slicing(spark, frame_bytes):
    rows = documents() if frame_bytes > 64 else [r for r in documents() if len(r[1] or "") < 1_000]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    more = df.selectExpr("*", "1 AS path", "2 AS n", "'x' AS form", "3 AS marked")
    got = sorted((tuple(r) for r in infill.digests(more, frame_bytes=frame_bytes).collect()), key=key)
    assert got == sorted((brute(*r)[:-1] for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_outputs_themselves_and_small_files(spark):
    rows = documents()[:60]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    stored = infill.store(df, frame_bytes=128, file_bytes=500)
    written = infill.transform(infill.plan(stored), 128, 500)
    assert written.select("path").distinct().count() > 1
    out = infill.texts(written).collect()
    assert sorted((r.doc_id, r.form, r.output) for r in out) == sorted((b[0], b[2], b[-1]) for b in map(lambda r: brute(*r), rows))


def test_empty_table(spark):
    out = infill.digests(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and "restored_sha256" in out.columns


def test_frames_open_only_what_is_asked(tmp_path):
    text = "".join(f"{i}é😀 " for i in range(40_000))
    out = FrameWriter(str(tmp_path), 1_000)
    out.add(text.encode())
    out.close()
    with open(out.path, "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain.decode() == text
    reader = FrameReader(out.path)
    for at in (0, 1, 1_234, len(text) // 2, len(text) - 1):
        assert reader.byte_of(at) == len(text[:at].encode())
    assert reader.unpacked <= 5 < len(out.table)
    assert reader.find(b"39999", 0, out.n_bytes) == text.encode().find(b"39999")
    assert reader.find(b"absent", 0, out.n_bytes) == -1
