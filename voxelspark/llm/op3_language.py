"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier on hashed character n-grams predicts each bit of it. A text's language is
the codeword whose bits lose the least, each bit's logistic loss weighted by how well its classifier does on the sample, and
the runner-up's distance tells whether the answer is ambiguous. Up to seven languages take the exhaustive code (every way to
part them in two), more take the random dense code with the largest least distance out of ``tries``.

The fit sees at most ``per_language`` rows of each language (expected count; rows are chosen by a hash of doc_id) and runs in
one task over that bounded sample. Scoring is one pass over all whole texts without a shuffle.

Edge cases: null text, or text without a letter, is ``und`` with score 0.0; rows without a language are not learnt from; with
no language to learn all rows are ``und``, with one all texts with a letter have it; repeated rows are scored each, alike. Ties: of
languages as far as each other the first in the order of names is taken, and the row is ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import held_out, table
from voxelspark.llm.ngrams import BITS, blocks, buckets, fit_logistic
from voxelspark.plans.iterate import Scratch

ORDERS = (2, 3)
#: Hash bits of a feature, and what an n-gram's share of a text is multiplied by.
WIDTH, GAIN = 14, 40.0


def codewords(languages: int, seed: int = 3, tries: int = 64) -> np.ndarray:
    """A row of -1 and +1 per language."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 7:
        bits = np.arange(1, 1 << (languages - 1))
        return np.where(bits[None, :] >> np.arange(languages)[:, None] & 1, 1, -1).astype(np.int8)
    width, random, best, held = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed), -1, None
    for _ in range(tries):
        code = np.where(random.random((languages, width)) < 0.5, 1, -1).astype(np.int8)
        split = np.abs(code.sum(axis=0)) < languages
        apart = (width - (code.astype(np.int32) @ code.T.astype(np.int32)))[np.triu_indices(languages, 1)].min() if split.all() else -1
        if apart > best:
            best, held = apart, code
    if held is None:
        raise ValueError("no random code splits every bit")
    return held


def shares(texts: list):
    """(first text, texts, text, feature) of a block, in the order of the text, an array pair per n-gram order."""
    for first, points, start, end in blocks(texts):
        yield first, len(start), [(text, bucket >> (BITS - WIDTH)) for bucket, text in buckets(points, start, end, ORDERS)]


class LanguageModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        """weights: features by bits; bias and trust: by bit."""
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def margins(self, texts: list) -> np.ndarray:
        """Signed margin of every text and bit."""
        out = np.zeros((len(texts), self.weights.shape[1]), np.float32)
        for first, n, pairs in shares(texts):
            total, own = np.zeros((n, out.shape[1]), np.float32), np.zeros(n)
            for text, feature in pairs:
                if len(text):
                    cut = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                    total[text[cut]] += np.add.reduceat(self.weights[feature], cut, axis=0)
                    own[text[cut]] += np.diff(np.append(cut, len(text)))
            out[first : first + n] = total * (GAIN / np.maximum(own, 1))[:, None]
        return out + self.bias

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, lead): nearest codeword by weighted loss, its share of exp(-distance), and the runner-up's lag."""
        loss = np.logaddexp(0, -margin.astype(np.float64)[:, None, :] * self.code[None, :, :])
        far = loss @ self.trust
        order = np.argsort(far, axis=1, kind="stable")
        best = order[:, 0]
        near = far[np.arange(len(far)), best]
        score = 1 / np.exp(near[:, None] - far).sum(axis=1)
        lead = far[np.arange(len(far)), order[:, 1]] - near if far.shape[1] > 1 else np.full(len(far), np.inf)
        return best, np.clip(score, 0, 1), lead

    def predict(self, docs: DataFrame, text_col: str = "text", ambiguous_below: float = 1.0) -> DataFrame:
        """``docs`` with lang_pred, score and ambiguous; input columns of these names are replaced."""
        plain = docs.drop("lang_pred", "score", "ambiguous")
        if not self.languages:
            return plain.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(True)})
        rows = plain.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            model = sent.value
            names = np.array(model.languages, dtype=object)
            for b in batches:
                row, letter = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                texts, best, score, lead = row.field(text_col), [], [], []
                for at in range(0, b.num_rows, 2000):
                    got = model.decode(model.margins(texts.slice(at, 2000).to_pylist()))
                    for held, x in zip((best, score, lead), got, strict=True):
                        held.append(x)
                best, score, lead = (np.concatenate(x) for x in (best, score, lead))
                yield pa.RecordBatch.from_arrays([row, pa.array(np.where(letter, names[best], "und"), pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(~letter | (lead < ambiguous_below))], ["row", "lang_pred", "score", "ambiguous"])

        schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"
        return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score", "ambiguous")


def fit_language(docs: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, l2: float = 1e-5, rounds: int = 40) -> LanguageModel:
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = (known if trainable is None else known.where(trainable)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(counts)
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((1 << WIDTH, 1), np.float32), np.full(1, 20.0), np.ones(1))
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, per_language / counts[k]) * (1 << 30))))))
    picked = known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < share[F.col("lang")])
    sample = scratch.settle(picked.select("lang", "body").repartition(8))

    def fit(batches):
        row, feature, value, y, n = [], [], [], [], 0
        for b in batches:
            y += b.column("lang").to_pylist()
            for at in range(0, b.num_rows, 500):
                for first, texts, pairs in shares(b.column("body").slice(at, 500).to_pylist()):
                    key = np.concatenate([text.astype(np.int64) << WIDTH | f for text, f in pairs])
                    key, count = np.unique(key, return_counts=True)
                    own = np.bincount(key >> WIDTH, count, minlength=texts)
                    row.append((n + at + first + (key >> WIDTH)).astype(np.int32))
                    feature.append((key & ((1 << WIDTH) - 1)).astype(np.int32))
                    value.append(GAIN * count / np.maximum(own, 1)[key >> WIDTH])
            n += b.num_rows
        if not n:
            return
        row, feature, value = np.concatenate(row), np.concatenate(feature), np.concatenate(value)
        truth = code[[languages.index(x) for x in y]]
        w, bias, trust = np.zeros((1 << WIDTH, code.shape[1])), np.zeros(code.shape[1]), np.zeros(code.shape[1])
        for k in range(code.shape[1]):
            w[:, k], bias[k] = fit_logistic(row, feature, np.ones(1 << WIDTH), (truth[:, k] > 0).astype(float), l2=l2, rounds=rounds, value=value)
            margin = np.bincount(row, w[feature, k] * value, minlength=n) + bias[k]
            trust[k] = max(1e-3, 2 * np.mean(np.sign(margin) == truth[:, k]) - 1)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (w.astype(np.float32), bias, trust)], ["w", "bias", "trust"])

    found = sample.coalesce(1).mapInArrow(fit, "w binary, bias binary, trust binary").first()
    scratch.drop(sample)
    return LanguageModel(languages, code, np.frombuffer(found["w"], np.float32).reshape(-1, code.shape[1]), np.frombuffer(found["bias"]), np.frombuffer(found["trust"]))


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs, trainable=~held_out())
    return model.predict(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
