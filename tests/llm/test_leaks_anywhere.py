"""Items planted into unrelated hosts, whole and edited: every one that the word tests accept is found, whatever the latent space."""

import random

import numpy as np
import pytest

from voxelspark.llm import op6_semantic
from voxelspark.llm.common import table
from voxelspark.llm.op6_semantic import find_leaks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").orderBy("item_id").limit(40).collect()]
    hosts = [r["text"].split() for r in table(spark, DATA, "documents").orderBy("doc_id").collect() if r["text"] and len(r["text"].split()) > 100]
    rows = []
    for _, text in items:
        for share in (0, 0.05, 0.1, 0.15, 0.2):
            host, words = list(rng.choice(hosts)), text.split()
            for k in range(len(words)):
                if rng.random() < share:
                    words[k] = rng.choice(rng.choice(hosts))
            at = rng.randrange(len(host))
            rows.append((len(rows), " ".join(host[:at] + words + host[at:])))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache(), spark.createDataFrame(items, "item_id long, text string")


def leaks(frames, **more):
    found = find_leaks(*frames, **more).selectExpr("row.doc_id", "explode(leaks) AS l").selectExpr("doc_id", "l.item_id", "l.lcs")
    return {(r["doc_id"], r["item_id"]): round(r["lcs"], 6) for r in found.collect()}


def test_all_that_the_word_tests_accept(spark, planted):
    brute = leaks(planted, cosine=-2.0)  # every passage is a candidate for every item
    assert len(brute) > 120
    assert leaks(planted, rank=4, cosine=0.9) == brute
    assert leaks(planted) == brute
    # words that all are too common to weigh, and items in blocks
    assert leaks(planted, common=0.0, least=0) == brute
    assert leaks(planted, items_per_block=11) == brute


def test_one_latent_space_for_all_blocks(planted):
    def cosines(**more):
        found = find_leaks(*planted, **more).selectExpr("row.doc_id", "explode(leaks) AS l").selectExpr("doc_id", "l.item_id", "l.cosine")
        return {(r["doc_id"], r["item_id"]): r["cosine"] for r in found.collect()}

    one, many = cosines(), cosines(items_per_block=11)
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-4 for k in one)


def test_sums_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(op6_semantic, "FAN_IN", 3)
    monkeypatch.setattr(op6_semantic, "SLICE", 64)

    def partial(batches):
        total = np.zeros((50, 2))
        for b in batches:
            np.add.at(total, (b.column(0).to_numpy() % 50, b.column(0).to_numpy() % 2), 1)
        return total

    want = np.zeros((50, 2))
    np.add.at(want, (np.arange(1000) % 50, np.arange(1000) % 2), 1)
    for tasks in (1, 2, 3, 4, 29):
        assert (op6_semantic.summed(spark.range(0, 1000, 1, tasks), partial, (50, 2)) == want).all()
    assert not op6_semantic.summed(spark.range(0, 0, 1, 2), partial, (50, 2)).any()
