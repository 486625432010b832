import numpy as np
import pyarrow as pa

from docloom.llm import decontaminate, ngram_join, spans, token_counts
from docloom.llm.encoding import ChunkEncoder


def thue_morse(bits, a, b):
    word = [0]
    for _ in range(bits):
        word += [1 - x for x in word]
    return bytes(b if x else a for x in word).decode(), bytes(a if x else b for x in word).decode()


TWINS = thue_morse(10, ord("a"), ord("b"))


def hashes(texts):
    data, offsets = spans.text_buffer(pa.array(texts))
    return spans.hash_spans(data, spans.Spans(offsets[:-1], offsets[1:], np.arange(len(texts) + 1)))


def test_hash_depends_on_bytes_alone_and_parts_all_words():
    rng = np.random.default_rng(3)
    texts = sorted({"".join(rng.choice(list("ab"), n)) for n in rng.integers(0, 90, 4000)} | {*TWINS, *thue_morse(11, 97, 98), *thue_morse(5, 97, 98)})
    h = hashes(texts)
    assert len(set(h.tolist())) == len(texts)
    assert (hashes(["zz", *texts, "y" * 300])[1:-1] == h).all()


def test_numbers_follow_bytes_even_where_hashes_meet(monkeypatch):
    texts = ["a", "bc", "a", TWINS[0], TWINS[1], TWINS[0], "", "bc", ""]
    data, offsets = spans.text_buffer(pa.array(texts))
    found = spans.Spans(offsets[:-1], offsets[1:], np.arange(len(texts) + 1))
    for hashed in (spans.hash_spans, lambda d, s: np.zeros(len(s.start), np.uint64)):
        monkeypatch.setattr(spans, "hash_spans", hashed)
        code, first = spans.number_spans(data, found)
        assert [texts[first[c]] for c in code] == texts
        assert len(first) == len(set(texts))


def test_twin_words_are_told_apart(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, bounds = ChunkEncoder(path).encode(pa.array(list(TWINS)))
    plain = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in TWINS]
    docs = spark.createDataFrame([(1, TWINS[0]), (2, TWINS[1])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link_components(docs).collect()} == {1: 1, 2: 2}
    items = spark.createDataFrame([(9, TWINS[1])], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, items).collect()} == {1: False, 2: True}
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, [TWINS[0].encode()], b"").collect()}
    assert counts == {1: 1, 2: 1024}
