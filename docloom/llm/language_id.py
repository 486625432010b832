"""Language of whole texts from the words of code-switched sequences, by a conditional random field."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import crf, spans

SAMPLE_TEXTS = 200  # labelled texts of a language the model is fitted on, about; never more than twice as many
SAMPLE_CHARS = 8_192  # of a longer text the sample has one run of words of this length
UNKNOWN = "und"


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text falls in the fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def run_of_words(text: str, chars: int) -> Column:
    """The text, or of a longer one about ``chars`` characters from a place drawn by its hash, without the words cut at both ends."""
    size = F.length(text)
    start = F.pmod(F.xxhash64(text, F.lit("run")), F.greatest(size - chars, F.lit(0)) + 1).cast("int") + 1
    piece = F.substring(F.col(text), start, F.lit(chars))
    inner = F.regexp_extract(piece, r"(?s)\s(.*\S)\s", 1)
    return F.when(size <= chars, F.col(text)).when(inner != "", inner).otherwise(piece)


def fit(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> crf.Model | None:
    """labelled: doc_id, text, lang. Null or empty texts and null languages are left out; without any rows: None.

    The sample is drawn by a hash of doc_id at a rate for each language, so it is spread over the whole table and the same
    at every run; its bound is 2 * texts for each language, whatever the table holds. A text of any length counts: of a
    long one a run of whole words is taken, at a place drawn by hash. One task fits the model; only the model reaches the
    driver.
    """
    rows = labelled.where("lang IS NOT NULL AND text <> ''")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    if not totals:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, int((1 << 30) * min(1.0, texts / n)))])
    drawn = rows.where(draw < rate[F.col("lang")]).select("lang", run_of_words("text", SAMPLE_CHARS).alias("text"), draw.alias("draw"))
    drawn = drawn.orderBy("draw", "lang", "text").limit(2 * texts * len(totals)).select("lang", "text").coalesce(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(pair for b in batches for pair in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True))
        model = crf.train([t for _, t in sample], [y for y, _ in sample])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model and tuple(vars(model).values()))], pa.binary())], ["model"])

    fitted = drawn.mapInArrow(train, "model binary").collect()
    parts = pickle.loads(fitted[0]["model"]) if fitted else None
    return crf.Model(*parts) if parts else None


def word_posteriors(model: crf.Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the word range of each text."""
    words = crf.words_of(*spans.text_buffer(column))
    p, _ = crf.posteriors(model.scores(words, model.rows(words))[words.code], words.first, model.change)
    return p, words.first


def judge_texts(model: crf.Model | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and shares of each text of a batch."""
    n = len(column)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), np.zeros((n, 0))
    p, first = word_posteriors(model, column)
    total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
    shares = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
    letters = np.asarray(pa.compute.fill_null(pa.compute.match_substring_regex(column, "[A-Za-z]"), False)).copy()
    for i in np.flatnonzero(~letters):
        letters[i] = any(c.isalpha() for c in column[i].as_py() or "")
    shares[~letters] = 0
    best = shares.argmax(axis=1)
    names = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return names, np.clip(shares[np.arange(n), best], 0, 1), shares


def predict(docs: DataFrame, model: crf.Model | None) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score (0 to 1), shares (of each learned language), a row for each input row.

    Every word of the whole text is labelled by its posterior; the text's language is the one with the largest expected
    share of its words (of equals the first by name), the share is the score. ``und`` and 0 for null and empty texts and
    texts without a letter, and where no language was learned. A very long text takes memory in proportion. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: fixed buckets, and the sample's lexicon

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text", spans.SLICE_BYTES // 2):
                names, score, shares = judge_texts(sent.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(shares.tolist(), pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, lang_pred string, score double, shares array<double>")


def keep_known(docs: DataFrame, model: crf.Model | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and, by a share of at least ``least`` of its words, a learned language.

    All columns, no shuffle. Null and empty texts go; repeated rows are judged one by one; texts in several languages stay.
    Without a model no language is known to be missing, and all rows stay. An empty table stays empty.
    """
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text", spans.SLICE_BYTES // 2):
                names, score, _ = judge_texts(sent.value, part.column("text"))
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(names, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(step, docs.schema)
