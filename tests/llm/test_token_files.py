import glob
import os
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from crowdtally.llm import token_files as K

DOC = "doc_id long, text string, start string, file string"
END = K.END_ID


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(K.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [END]


def placed(library, data):
    """Rows in the defined order with their places."""
    packed = [(i is not None, i or 0, np.array(ids_of(library, t), "<u4").tobytes()) for i, t in data]
    narrow = {p: np.frombuffer(p[2], "<u4").astype("<u2").tobytes() for p in packed}
    out, at = [], 0
    for known, i, ids in sorted(packed, key=lambda p: (p[0], p[1], narrow[p])):
        out.append((i if known else None, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


def result(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


TEXTS = ["", None, "Hello world", "The quick  brown\n\nfox's <|endoftext|> é漢字🙂", "x y " * 30_000, "q" * 50_000]


@pytest.mark.parametrize("per_file", [2, 4096])
def test_small_table_with_odd_rows(rows, library, per_file, tmp_path):
    data = [(10 - i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, ""), (8, "again"), (8, "Hello world")]
    docs = rows(DOC, *[(i, t, "clash", "clash") for i, t in data])
    folder = (tmp_path / "out").as_uri()
    got = result(K.token_positions(docs, folder=folder, docs_per_file=per_file))
    assert got == placed(library, data)
    names = sorted(glob.glob(str(tmp_path / "out" / "*.zst")))
    assert (len(names) > 2) == (per_file == 2) and not glob.glob(str(tmp_path / "out" / ".part*"))


def test_added_tokens_as_the_library_finds_them(library):
    end, cache = "<|endoftext|>", K.ids_cache(K.default_vocabulary())
    texts = [f"a {end} b", end, f"{end}{end}", f"x{end}\n{end} ", f" {end}é漢 <|endoftext| {end[1:]}", "no token", "",
             f"two  spaces  {end}  here", f"{end[:-1]}{end}", " ".join([f"w{i} {end}" for i in range(500)])]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert cache.look_up(texts) == want
    assert 50256 in np.frombuffer(want[0], "<u4")


def test_empty_table(rows):
    docs = rows(DOC, (1, "x", None, None)).limit(0)
    assert K.token_positions(docs).collect() == []


def test_readers_decompress_only_requested_documents(tmp_path, monkeypatch):
    path = tmp_path / "f.zst"
    docs = [(i, np.arange(i % 50 + 1, dtype="<u4").tobytes()) for i in range(1000)] + [(None, b"\x02\0\0\0")]
    with open(path, "wb") as f:
        w = K.FrameWriter(f, frame_tokens=500)
        for i, ids in docs:
            w.add(i, ids)
        w.close()
    opened = []
    plain = K.read_frame
    monkeypatch.setattr(K, "read_frame", lambda f, e: opened.append(e) or plain(f, e))
    assert K.read_documents(path.as_uri(), {3, 997}) == {3: [docs[3][1]], 997: [docs[997][1]]}
    assert len(opened) == 2 and len(w.entries) > 20


def test_frames_are_plain_zstandard_and_checked(tmp_path):
    path = tmp_path / "f.zst"
    with open(path, "wb") as f:
        w = K.FrameWriter(f, frame_tokens=4)
        for i in range(6):
            w.add(i, np.full(3, i, "<u4").tobytes())
        w.close()
    raw = path.read_bytes()
    reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    assert len(reader.read()) == sum(K.ENTRY.unpack(e)[1] for e in w.entries)
    from pyarrow import fs
    damaged = bytearray(raw)
    damaged[-K.FOOTER.size - K.ENTRY.size + 8] ^= 1  # the last frame's checksum in the table
    (tmp_path / "g.zst").write_bytes(damaged)
    f = fs.LocalFileSystem().open_input_file(str(tmp_path / "g.zst"))
    with pytest.raises(ValueError, match="checksum"):
        for e in K.read_seek_table(f):
            list(K.read_frame(f, e))
    (tmp_path / "h.zst").write_bytes(raw[:-1] + b"x")
    with pytest.raises(ValueError, match="footer"):
        K.read_seek_table(fs.LocalFileSystem().open_input_file(str(tmp_path / "h.zst")))


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(K.query(spark, sf)) == placed(library, docs)
