"""The manifest against plain Python: places, runs, proofs and folded roots, on odd rows, small and large arities."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from voxelspark.llm import op11_merkle as T11
from voxelspark.plans.iterate import Scratch

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    for nodes in levels[:-1]:
        first = i // arity * arity
        yield nodes[first:i], nodes[i + 1 : first + arity]
        i //= arity


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def model(rows, arity, tampered):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([leaf_of(r) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))], arity) for s in order}
    top = tree([made[s][-1][0] for s in order], arity)
    for k, s in enumerate(order):
        for i, r in enumerate(sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))):
            around = [*path(made[s], i, arity), *path(top, k, arity)]
            own = leaf_of((*r[:4], lowered(r[4]) if tampered(r) else r[4]))
            for before, after in around:
                own = h(*before, own, *after)
            out.append((r[0], leaf_of(r), made[s][-1][0], top[-1][0], h(*(x for b, a in around for x in (*b, *a))), own))
    return out


def told(spark, rows, arity, docs=None):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3) if docs is None else docs
    odd = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    m = T11.build_manifest(docs, COLUMNS, "source", "doc_id", arity, changed={"text": F.when(odd, T11.lower_ascii(F.col("text"))).otherwise(F.col("text"))})
    got = T11.proofs(m).select("doc_id", "leaf", "subroot", "root", F.sha2(T11.sibling_texts(arity), 256), T11.folded(F.col("changed_leaf"), arity))
    return [tuple(r) for r in got.collect()], m


def odd_rows():
    rows = [(k, f"s{k % 3}", "en" if k % 4 else None, k * 7, f"Text {k} É ÀB") for k in range(60)]
    rows += [(None, "s1", None, None, None), (None, None, "en", 1, "A"), (7, None, "en", 1, ""), (100, "alone", "en", 1, "LONE"), (3, "", "de", 2, "empty name"), (0, "é", "de", 2, "Z")]
    rows += [rows[3], rows[3], (3, "s0", "en", 21, "same id"), (5, "long", "en", 1, "Q" * 400_000), (6, "long", "en", 1, "Q" * 400_000)]
    return rows


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest(spark, arity):
    rows = odd_rows()
    got, _ = told(spark, rows, arity)
    want = model(rows, arity, lambda r: r[0] is not None and r[0] % 5 == 0)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {x[-1] == x[3] for x in got} == {True, False}


def test_small_trees(spark):
    for rows in ([(1, "a", None, None, "X")], [(1, "a", None, None, "x"), (2, "a", None, None, "X")], [(k, f"s{k}", None, None, "x") for k in range(5)]):
        got, m = told(spark, rows, 4)
        assert sorted(got, key=repr) == sorted(model(rows, 4, lambda r: r[0] % 5 == 0), key=repr)
    got, m = told(spark, [], 16)
    assert got == [] and m.root.isEmpty()


def test_names_that_clash(spark):
    names = ["tree", "index", "digest", "n", "leaf", "first", "path", "tops", "place", "_key", "_at", "_range", "_nth", "changed_leaf", "subroot", "root"]
    rows = odd_rows()[:20]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in names})
    assert sorted(told(spark, None, 16, docs)[0]) == sorted(told(spark, rows, 16)[0])


def test_places(spark):
    """A group with most rows is placed over many ranges, without a gap."""
    scratch = Scratch(spark, "places")
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 5000).alias("k"))
    got = T11.ranked(scratch, rows.repartition(7), ["k"], "g").collect()
    want = {}
    for r in sorted(got, key=lambda r: r["k"]):
        assert r["index"] == want.setdefault(r["g"], 0)
        want[r["g"]] += 1
    assert all(r["n"] == want[r["g"]] for r in got) and want["hot"] == 4000


def test_query_tampers_by_crc(spark):
    import __spark_entry__

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    want = model(rows, 16, lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 0)
    got = __spark_entry__.queries()["op11_merkle"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(want) and all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
