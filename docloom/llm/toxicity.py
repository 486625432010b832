"""Toxicity of whole texts: many weak voters, a generative model of their rates and correlations, a linear classifier.

1. Voters: lexicons, patterns, and words and word beginnings that labelled toxic texts use far more often than others.
2. Each document's votes are found in one pass over the texts and kept as a small table.
3. A generative model with a hidden class is fitted by expectation-maximisation on counts of vote patterns. A learning
   row's label is one more voter, whose accuracy is estimated too. The model estimates how often each voter fires in each
   class, then the correlation of every two voters within a class; a voter counts less the more it repeats others, and the
   rates are estimated again under these weights.
4. The model's posteriors are the soft labels on which logistic regression over the votes is trained; it gives the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import spans
from docloom.llm.language_id import run_of_words
from docloom.llm.shared import written

# Own lists of insults, one voter for each list and one for any of them right after a second-person word.
LEXICONS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns fool dumb imbecile jerk bastard asshole bitch",
    "de": "idiotin vollidiot trottel depp arschloch dummkopf blödmann abschaum versager widerlich erbärmlich wertlos",
    "fr": "idiote imbécile crétin connard connasse salaud ordure débile abruti minable dégueulasse",
    "es": "idiotas imbécil estúpido estúpida cabrón basura inútil asqueroso asquerosa patético pendejo",
}
SECOND_PERSON = "you your youre du dich dein ihr tu toi vous tú te eres usted"
PATTERNS = ("any lexicon, twice", "lexicon after second person", "shouted: half the letters are capitals", "three exclamation marks in a row")
PREFIXES = (4, 5, 6, 7, 8)  # bytes
LEVELS = (1, 2, 4)  # a mined beginning has a voter for each: so many words of the text start with it
SAMPLE_TOXIC, SAMPLE_OTHER = 3000, 9000  # labelled learning rows the words are mined on; together never more
MINED = 40  # mined terms at most
MINED_CHARS = 8_192  # of a longer text one run of words of this length is mined (every text is scored whole)
ROUNDS, AGAIN = 10, 2  # of expectation-maximisation, before and after voters are weighed
SURPRISE = 25.0  # log-likelihood ratio of a mined term, at least
_LETTER = spans.byte_class(b"abcdefghijklmnopqrstuvwxyz", high=True)


def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    return spans.hash_spans(data, spans.Spans(ends - [len(w) for w in words], ends, np.zeros(1, np.int64)))


@dataclass
class Voters:
    names: list[str]
    words: dict[int, np.ndarray]  # voter -> sorted hashes of whole words
    prefixes: dict[tuple[int, int], np.ndarray]  # (first of its voters, length) -> hash of a word beginning


def voters(mined: list[tuple[str, bytes]]) -> Voters:
    """mined: ('word' or 'prefix', bytes); a voter for a word, one for each level for a prefix."""
    names = [f"lexicon {k}" for k in LEXICONS] + list(PATTERNS)
    words = {i: np.sort(_hashes([w.encode() for w in v.split()])) for i, v in enumerate(LEXICONS.values())}
    prefixes = {}
    for kind, text in mined:
        if kind == "word":
            words[len(names)] = _hashes([text])
        else:
            prefixes[len(names), len(text)] = _hashes([text])
        names += [f"{kind} {text.decode(errors='replace')} {level}" for level in (LEVELS if kind == "prefix" else LEVELS[:1])]
    return Voters(names, words, prefixes)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, spans.Spans, np.ndarray]:
    raw, offsets = spans.text_buffer(column)
    data = spans.ascii_lower(raw)
    found = spans.runs(_LETTER[data], offsets)
    return raw, data, found, offsets


def _beginning(data: np.ndarray, found: spans.Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n bytes of the words longer than that, and which words these are."""
    at = np.flatnonzero(found.end - found.start > n)
    return spans.hash_spans(data, spans.Spans(found.start[at], found.start[at] + n, found.first)), at


def _in(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return wanted[at] == hashes


def votes(column: pa.Array, held: Voters) -> np.ndarray:
    """Whether each voter fires, texts x voters. Null and empty texts get no vote."""
    raw, data, found, offsets = _words(column)
    n, owner, h = len(column), found.owner(), spans.hash_spans(data, found)
    out = np.zeros((n, len(held.names)), bool)
    count = np.zeros(n, np.int64)
    second = np.zeros(len(h) + 1, bool)
    second[1:] = _in(h, np.sort(_hashes([w.encode() for w in SECOND_PERSON.split()])))
    second[found.first[:-1]] = False
    lists = len(LEXICONS)
    for v, wanted in held.words.items():
        hit = _in(h, wanted)
        out[owner[hit], v] = True
        if v < lists:
            count += np.bincount(owner[hit], minlength=n)
            out[owner[hit & second[:-1]], lists + 1] = True
    starts = {k: _beginning(data, found, k) for k in {k for _, k in held.prefixes}}
    for (v, k), wanted in held.prefixes.items():
        hashes, at = starts[k]
        times = np.bincount(owner[at[_in(hashes, wanted)]], minlength=n)
        out[:, v : v + len(LEVELS)] = times[:, None] >= np.array(LEVELS)
    out[:, lists] = count >= 2

    def per_text(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark)])
        return total[offsets[1:]] - total[offsets[:-1]]

    upper, lower = per_text((raw >= 65) & (raw <= 90)), per_text((raw >= 97) & (raw <= 122))
    out[:, lists + 2] = (upper >= 20) & (upper >= lower)
    bang = raw == 33
    bang[2:] &= bang[1:-1] & bang[:-2]
    bang[:2] = False
    bang[np.concatenate([offsets[:-1], offsets[:-1] + 1])[np.concatenate([offsets[:-1], offsets[:-1] + 1]) < len(raw)]] = False
    out[:, lists + 3] = per_text(bang) > 0
    return out


def mine(texts: DataFrame, known: DataFrame) -> list[tuple[str, bytes]]:
    """texts: doc_id, text; known: doc_id, toxic (0 or 1), ids once. Words and word beginnings of toxic texts.

    Kept are those in at least 3 toxic texts with 8 of 10 uses, rates compared, in toxic texts and a log-likelihood ratio
    that chance among a million terms hardly gives; the most telling first, of equals the longest, and no term that a
    kept beginning covers or that begins it.
    """
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mine")), F.lit(1 << 30))
    most = {1: SAMPLE_TOXIC, 0: SAMPLE_OTHER}
    rate = F.create_map(*[F.lit(x) for y, n in totals.items() for x in (y, int((1 << 30) * min(1.0, 0.9 * most[y] / n)))])
    drawn = known.where(draw < rate[F.col("toxic")]).orderBy(draw, "doc_id").limit(SAMPLE_TOXIC + SAMPLE_OTHER)  # so many ids at most: a broadcast of 200 KB
    sample = texts.where("text <> ''").join(F.broadcast(drawn), "doc_id").select("toxic", run_of_words("text", MINED_CHARS).alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bytes], list[int]] = {}
        for batch in batches:
            for part in spans.slices(batch, "text"):
                _, data, found, _ = _words(part.column("text"))
                raw = data.tobytes()
                for y, a, b in zip(part.column("toxic").to_pylist(), found.first, found.first[1:], strict=False):
                    own = {raw[s:e] for s, e in zip(found.start[a:b].tolist(), found.end[a:b].tolist(), strict=True)}
                    keys = {("word", w) for w in own} | {("prefix", w[:k]) for w in own for k in PREFIXES if len(w) > k}
                    for key in keys:
                        seen.setdefault(key, [0, 0])[y] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([w for _, w in seen], pa.binary()), pa.array([c[1] for c in seen.values()], pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64())], ["kind", "term", "bad", "good"])

    n_bad, n_good = min(totals[1], 0.9 * SAMPLE_TOXIC), min(totals[0], 0.9 * SAMPLE_OTHER)
    counted = sample.mapInArrow(step, "kind string, term binary, bad bigint, good bigint").groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = F.col("bad") / n_bad / (F.col("bad") / n_bad + (F.col("good") + 0.5) / n_good)
    n = n_bad + n_good
    used = F.col("bad") + F.col("good")

    def part(seen: F.Column, mean: F.Column) -> F.Column:
        return seen * F.log((seen + 1e-9) / mean)

    surprise = 2 * sum((part(seen, size * total / n) for seen, size, total in (
        (F.col("bad"), F.lit(n_bad), used), (F.col("good"), F.lit(n_good), used),
        (n_bad - F.col("bad"), F.lit(n_bad), n - used), (n_good - F.col("good"), F.lit(n_good), n - used))), F.lit(0.0))
    best = (counted.where((F.col("bad") >= 3) & (F.col("bad") <= n_bad) & (F.col("good") <= n_good) & (share >= 0.8) & (surprise >= SURPRISE))
            .orderBy(surprise.desc(), F.length("term").desc(), "kind", "term").limit(20 * MINED).collect())
    kept: list[tuple[str, bytes]] = []
    for r in best:
        if len(kept) < MINED and not any(k == "prefix" and bytes(r["term"]).startswith(p) or (r["kind"] == "prefix" and p.startswith(bytes(r["term"]))) for k, p in kept):
            kept.append((r["kind"], bytes(r["term"])))
    return kept


@dataclass
class LabelModel:
    prior: float
    rate: np.ndarray  # 2 x voters: how often a voter fires in each class
    weight: np.ndarray  # of a voter, 1 where it is independent of all others within the classes
    labelled: np.ndarray  # how often a label says toxic in each class

    def posterior(self, fired: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of the toxic class; ``label`` is 1, 0 or NaN where a row has none."""
        on, off = np.log(self.rate[1] / self.rate[0]), np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        odds = np.log(self.prior / (1 - self.prior)) + np.where(fired, on, off) @ self.weight
        says, denies = np.log(self.labelled[1] / self.labelled[0]), np.log((1 - self.labelled[1]) / (1 - self.labelled[0]))
        odds = odds + np.where(np.isnan(label), 0, np.where(label == 1, says, denies))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _columns(batch: pa.RecordBatch, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _dense(batch.column("votes"), m), batch.column("toxic").to_pandas().to_numpy(float), batch.column("n").to_numpy()


def _added(rows: DataFrame, one: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``one`` over all batches; a vector of ``size`` numbers for each partition is all that reaches the driver."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += one(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return sum((np.frombuffer(r["sums"]) for r in rows.mapInArrow(step, "sums binary").collect()), np.zeros(size))


def fit_labels(patterns: DataFrame, m: int) -> LabelModel:
    """patterns: votes array<int> (the voters that fired), toxic (0, 1 or null), n. All of them count; no pattern at all gives the starting model."""
    def expected(model: LabelModel, pairs: bool) -> tuple[np.ndarray, ...]:
        def one(batch: pa.RecordBatch) -> np.ndarray:
            fired, label, n = _columns(batch, m)
            q = model.posterior(fired, label)
            parts = []
            for w in (n * (1 - q), n * q):
                both = (fired * w[:, None]).T @ fired if pairs else np.zeros(0)
                parts.append(np.concatenate([[w.sum(), w[label == 1].sum(), w[label == 0].sum()], w @ fired, both.ravel()]))
            return np.concatenate(parts)

        total = _added(patterns, one, 2 * (3 + m + (m * m if pairs else 0))).reshape(2, -1)
        return total[:, 0], total[:, 1:3], total[:, 3 : 3 + m], total[:, 3 + m :].reshape(2, m, m) if pairs else np.zeros(0)

    one = np.ones(m)
    model = LabelModel(0.1, np.stack([0.002 * one, 0.2 * one]), one, np.array([0.01, 0.99]))
    lists = len(LEXICONS)
    model.rate[:, lists + 2 : lists + 4] = [[0.05], [0.1]]  # shouting alone says little

    def better(model: LabelModel) -> LabelModel:
        mass, said, fires, _ = expected(model, False)
        rate = (fires + np.array([[0.05], [0.5]]) * 2) / (mass[:, None] + 10)
        labelled = np.clip((said[:, 0] + [0.1, 9.9]) / (said.sum(axis=1) + 10), [0.001, 0.9], [0.1, 0.999])
        return LabelModel(float(np.clip((mass[1] + 1) / (mass.sum() + 10), 0.001, 0.5)), np.clip(rate, 1e-5, 1 - 1e-5), model.weight, labelled)

    for _ in range(ROUNDS):
        model = better(model)
    mass, _, fires, both = expected(model, True)
    share = mass[:, None, None] / max(mass.sum(), 1)
    mean = fires / np.maximum(mass, 1)[:, None]
    spread = (share * (both / np.maximum(mass, 1)[:, None, None] - mean[:, :, None] * mean[:, None, :])).sum(axis=0)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
    related = np.clip(spread / scale[:, None] / scale[None, :], 0, 1) ** 2
    np.fill_diagonal(related, 1)
    model = LabelModel(model.prior, model.rate, 1 / related.sum(axis=0), model.labelled)
    for _ in range(AGAIN):
        model = better(model)
    return model


def _dense(lists: pa.Array, m: int) -> np.ndarray:
    out = np.zeros((len(lists), m), bool)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), flat] = True
    return out


def fit_linear(patterns: DataFrame, model: LabelModel, m: int, ridge: float = 0.1, steps: int = 25) -> np.ndarray:
    """Logistic regression of the model's posteriors on votes, over all patterns; the last weight is the constant.

    ``ridge`` is added to the curvature of the whole sum, so it fades as rows come. Each Newton step adds up gradient and curvature in the tasks; the steps end when one changes next to nothing.
    """
    size = m + 1
    w = np.zeros(size)
    w[m] = np.log(model.prior / (1 - model.prior))
    for _ in range(steps):
        def one(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            fired, label, n = _columns(batch, m)
            x = np.column_stack([fired, np.ones(len(fired))])
            p = 1 / (1 + np.exp(-x @ w))
            slope = x.T @ (n * (p - model.posterior(fired, label)))
            return np.concatenate([slope, ((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x).ravel()])

        total = _added(patterns, one, size + size * size)
        step = np.linalg.solve(total[size:].reshape(size, size) + ridge * np.eye(size), total[:size] + ridge * w)
        w = w - step * min(1, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, learn: F.Column) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic; ``learn``: condition on doc_id of the rows to learn from.

    Returns doc_id, score (0 to 1), n_votes, a row for each row of docs. Null and empty texts have no votes and get the
    score of that. Labels that are null or not 0 or 1, or for unknown ids, are ignored; of several labels of an id the
    largest counts. Without labels of both kinds nothing is mined and the listed voters decide. Repeated rows are scored
    one by one; a very long text takes memory in proportion. Other columns are not read.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(learn)
    texts = docs.select("doc_id", "text")
    held = voters(mine(texts, known))
    m = len(held.names)
    sent = docs.sparkSession.sparkContext.broadcast(held)  # at most MINED terms and the lists above

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.slices(batch, "text"):
                fired = votes(part.column("text"), sent.value)
                row, v = np.nonzero(fired)
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32)))], ["doc_id", "votes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    voted = written(texts.mapInArrow(step, f"doc_id {kind}, votes array<int>"), "votes")
    patterns = voted.where(learn).join(known, "doc_id", "left").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n"))
    patterns = written(patterns, "patterns")
    model = fit_labels(patterns, m)
    weights = fit_linear(patterns, model, m)
    each = F.array(*map(F.lit, map(float, weights[:m])))
    odds = F.aggregate("votes", F.lit(float(weights[m])), lambda s, v: s + F.element_at(each, v + 1))
    return voted.select("doc_id", (1 / (1 + F.exp(-odds))).alias("score"), F.size("votes").alias("n_votes"))
