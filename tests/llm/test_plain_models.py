"""Both classifiers and the pipeline against plain Python that goes text by text."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest

from voxelspark.llm import op2_toxicity as T2
from voxelspark.llm import op3_language as T3
from voxelspark.llm.common import held_out, table

DATA = "/root/testdata/sf0.001"


def grams(text, orders):
    """20-bit bucket of every character n-gram of a text, repeats included."""
    points = [max(32, ord(c)) for c in f" {(text or '').lower()} "]
    for n in orders:
        for at in range(len(points) - n + 1):
            h = 0
            for c in points[at : at + n]:
                h = (h * 0x01000193 + c) % 2**32
            x = (h ^ h >> 15) * (0x85EBCA6B + 2 * n) % 2**32
            x = (x ^ x >> 13) * 0xC2B2AE35 % 2**32
            yield x >> 12


def toxicity_of(model, text):
    weight = dict(zip(model.bucket.tolist(), model.weight.tolist(), strict=True))
    z = model.bias + sum(weight.get(g, 0.0) for g in set(grams(text, model.orders)))
    return 1 / (1 + math.exp(-max(-500, min(500, z))))


def fit_by_newton(x, y, l2):
    """Least value of mean logistic loss plus l2/2 |w|^2, the bias free."""
    p = np.zeros(x.shape[1] + 1)
    full, penalty = np.hstack([x, np.ones((len(x), 1))]), l2 * np.append(np.ones(x.shape[1]), 0)
    for _ in range(40):
        s = 1 / (1 + np.exp(-full @ p))
        hessian = full.T @ (full * (s * (1 - s))[:, None]) / len(x) + np.diag(penalty) + 1e-12 * np.eye(len(p))
        p = p - np.linalg.solve(hessian, full.T @ (s - y) / len(x) + penalty * p)
    return p


def objective(x, y, w, bias, l2):
    z = x @ w + bias
    return np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * w @ w


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    bad, good, both = (["foul", "vile", "wretch"], ["river", "mill", "noon"], ["old", "by", "the", "walk", "two"])
    texts = [" ".join(rng.choice((bad if k % 3 == 0 else good) + both, 6)) for k in range(90)] + [None, ""]
    rows = [(k, t, int(k % 3 == 0)) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    return rows, d.select("doc_id", "text"), d.select("doc_id", "toxic")


def test_toxicity_by_hand(labelled):
    rows, docs, labels = labelled
    model = T2.fit_toxicity(docs, labels, l2=1e-2)
    sets = [set(grams(t, (4, 5, 6))) for _, t, _ in rows]
    y = np.array([m for *_, m in rows])
    count = [Counter(g for s, m in zip(sets, y, strict=True) if m == c for g in s) for c in (0, 1)]
    ratio = {g: math.log((count[1][g] + 1) / (y.sum() + 2) / ((count[0][g] + 1) / ((1 - y).sum() + 2))) for g in count[0] | count[1] if count[0][g] + count[1][g] > 1}
    kept = sorted(g for g, r in ratio.items() if abs(r) > 1e-12)
    assert model.bucket.tolist() == kept
    x = np.array([[ratio[g] * (g in s) for g in kept] for s in sets])
    ours = model.weight / np.array([ratio[g] for g in kept])
    best = fit_by_newton(x, y, 1e-2)
    assert objective(x, y, ours, model.bias, 1e-2) - objective(x, y, best[:-1], best[-1], 1e-2) < 1e-4
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    assert all(abs(got[k] - toxicity_of(model, t)) < 1e-9 for k, t, _ in rows) and got[90] == got[91]


def test_fewer_features_are_the_most_certain(labelled):
    rows, docs, labels = labelled
    every, few = T2.fit_toxicity(docs, labels), T2.fit_toxicity(docs, labels, features=25)
    sets, y = [set(grams(t, (4, 5, 6))) for _, t, _ in rows], np.array([m for *_, m in rows])

    def certainty(g):
        yes, no = (sum(g in s for s, m in zip(sets, y, strict=True) if m == c) + 1 for c in (1, 0))
        return abs(math.log(yes / (y.sum() + 2) / (no / ((1 - y).sum() + 2)))) / math.sqrt(1 / yes + 1 / no)

    rest = set(every.bucket.tolist()) - set(few.bucket.tolist())
    assert len(few.bucket) == 25 and min(map(certainty, few.bucket.tolist())) >= max(map(certainty, rest)) - 1e-9


def test_language_by_hand(spark):
    docs = table(spark, DATA, "documents")
    model = T3.fit_language(docs, trainable=~held_out())
    rows = docs.where("doc_id < 60").select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, " 12 "), (902, "É")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in model.predict(rows).collect()}
    weight, code = model.weights.astype(float), model.code.astype(int).tolist()
    for k, text in ((r["doc_id"], r["text"]) for r in rows.collect()):
        if not any(c.isalpha() for c in text or ""):
            assert (got[k]["lang_pred"], got[k]["score"], got[k]["ambiguous"]) == ("und", 0.0, True)
            continue
        found = [g >> (T3.BITS - T3.WIDTH) for g in grams(text, T3.ORDERS)]
        margin = [T3.GAIN * sum(weight[g, b] for g in found) / len(found) + model.bias[b] for b in range(len(code[0]))]
        far = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margin, word, strict=True)) for word in code]
        near = min(far)
        order = sorted(far)
        if order[1] - near > 1e-3:
            assert got[k]["lang_pred"] == model.languages[far.index(near)]
        assert abs(got[k]["score"] - 1 / sum(math.exp(near - f) for f in far)) < 1e-3
        if abs(order[1] - near - 1) > 1e-2:
            assert got[k]["ambiguous"] == (order[1] - near < 1)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def first_of_groups(texts):
    """Smallest id of each group of texts linked by a similarity of 0.8 of their sets of five words."""
    low = {k: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in low.items()}
    root = {k: k for k in texts}

    def top(k):
        return k if root[k] == k else top(root[k])

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if b < a and (sets[a] == sets[b] or both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k for k in texts if top(k) == k}


def without_repeats(texts, window=50):
    first, out = {}, {}
    for k in sorted(texts):
        w = words(texts[k])
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), k)
    for k, t in texts.items():
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < k:
                gone |= set(range(p, p + window))
        out[k] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def leaking(texts, items, stride=24, share=0.75):
    plain = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    asked = []
    for t in items:
        w = plain(t)
        parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", t or "") if re.search(r"\w", p)]
        n = len(plain(parts[-1])) if len(parts) > 1 else max(1, len(w) // 3)
        asked.append((w, w[len(w) - n :], Counter(w)))
    out = set()
    for k, t in texts.items():
        w = plain(t)
        for item, answer, bag in asked:
            size = len(item)
            if sum((bag & Counter(w)).values()) < share * size:
                continue
            for at in range(0, len(w), stride):
                text = w[max(0, at - size) : at + 2 * stride + size]
                if sum((bag & Counter(text)).values()) >= share * size and subsequence(item, text) >= share * size and subsequence(answer, text) >= share * len(answer):
                    out.add(k)
                    break
    return out


def test_pipeline_by_hand(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    docs = table(spark, DATA, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = T2.fit_toxicity(docs, table(spark, DATA, "labels"), trainable=~held_out())
    clean = {k: t for k, t in texts.items() if toxicity_of(model, t) < P.TOXIC}
    firsts = first_of_groups(clean)
    cut = without_repeats({k: t for k, t in clean.items() if k in firsts})
    leaks = leaking(cut, [r["text"] for r in table(spark, DATA, "benchmark").collect()])
    assert len(texts) > len(clean) > len(cut) and leaks and any(cut[k] != clean[k] for k in cut)

    tool, got, windows = Tokenizer.from_file(public.path("word_bpe_49k.json")), {}, {}
    for r in P.run(spark, DATA).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got.keys() == cut.keys() - leaks
    for k, pieces in got.items():
        ids, at = np.array([*tool.encode(cut[k] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for spans in windows.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048


def test_only_kept_ngrams_reach_the_driver(spark, monkeypatch):
    """Counts of all buckets stay with the tasks: what is collected follows ``features``, not the texts."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs, labels, sizes = table(spark, DATA, "documents"), table(spark, DATA, "labels"), []
    before = DataFrame.collect

    def collect(self):
        rows = before(self)
        sizes.append(sum(len(x) if isinstance(x, (bytes, bytearray)) else 8 for r in rows for x in r))
        return rows

    monkeypatch.setattr(DataFrame, "collect", collect)
    model = T2.fit_toxicity(docs, labels, features=25)
    assert len(model.bucket) == 25
    assert sizes and max(sizes) < 2_000
