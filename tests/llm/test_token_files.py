import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm import token_files as tf
from docloom.llm.encoding import ChunkEncoder
from docloom.llm.shared import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "a  b\n\n c\t\td \n", "  x", "x  ", " ", "\n", "", None, "I'm he's  'll\r\n y", "a  b", "x   y", "\x1c q", " \n a",
    "é è x", "a\n b  \n\n   c", "<|endoftext|>  <|endoftext|>a", "日本 語!", "word, (word) word.", "w" * 70_000, "same", "same",
]


def plain(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_plain_tokenizer():
    ids, bounds = ChunkEncoder(PATH).encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain(text), text


def test_files_hold_whole_texts(spark):
    rows = [(3 * i % 19, t, "x") for i, t in enumerate(TEXTS[:19])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string").repartition(3)
    folder = shared_folder(spark, "frames")
    manifest = tf.write_token_files(docs, PATH, folder)
    got = {r.doc_id: r for r in tf.read_token_rows(manifest, folder).collect()}
    start = 0
    for d, text, _ in sorted(rows):
        ids = [*plain(text), 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = tf.read_documents(manifest, folder, spark.createDataFrame([(3,), (7,), (999,), (None,)], "doc_id int"))
    assert {r.doc_id: r.ids for r in some.collect()} == {d: [*plain(t), 2] for d, t, _ in rows if d in (3, 7)}


def test_repeated_ids_and_empty_table(spark):
    folder = shared_folder(spark, "frames")
    twice = spark.createDataFrame([(1, "b c"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens) for r in tf.read_token_rows(tf.write_token_files(twice, PATH, folder), folder).collect())
    assert got == [(0, 2), (2, 2), (4, 3)]
    folder = shared_folder(spark, "frames")
    assert tf.read_token_rows(tf.write_token_files(twice.limit(0), PATH, folder), folder).count() == 0


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = tf.FrameWriter(out, 2, 3)
    for d in range(5):
        writer.add(d, np.arange(d * 100, dtype=np.uint32))
    writer.close()
    data = bytearray(out.getvalue())
    reader = tf.FrameReader(io.BytesIO(data), len(data), 2)
    assert [x.tolist() for _, x in reader.find([4, 2])] == [list(range(400)), list(range(200))]
    at = int(reader.at[3])
    data[at + 12] ^= 255
    broken = tf.FrameReader(io.BytesIO(data), len(data), 2)
    assert len(broken.ids(2)) == 200
    with pytest.raises(Exception):
        broken.ids(3)
