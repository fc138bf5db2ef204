import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from scoreline.llm.op13_merkle import interval_tree, merkle_manifest
from scoreline.llm.queries import ORACLE_SQL, QUERIES
from scoreline.llm.ranks import ranked

from .helpers import empty_documents, odd_documents


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes, fanout):
    """(top, for each leaf its siblings before and after at every level), by plain lists."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, merged = [], []
        for lo in range(0, len(nodes), fanout):
            run = nodes[lo : lo + fanout]
            for j in range(len(run)):
                for leaf in under[lo + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(digest("".join(run)))
            merged.append([leaf for j in range(len(run)) for leaf in under[lo + j]])
        nodes, under = above, merged
    return nodes[0], paths


def brute(rows, fanout=16):
    """(doc_id, source, leaf, subroot, root, proof, folded root, verified) of rows (doc_id,
    source, lang, n_chars, text), tampered where 5 divides the id's crc32."""
    groups = {}
    for i, source, lang, n, text in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        leaf = leaf_of((i, source, lang, n, text))
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, leaf_of((i, source, lang, n, lowered(text))) if tampered else leaf, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(groups[s])], fanout) for s in order}
    root, over = tree([trees[s][0] for s in order], fanout)
    out = []
    for s, upper in zip(order, over, strict=True):
        for (_, _, leaf, changed, i), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            path, folded = path + upper, changed
            for before, after in path:
                folded = digest(before + folded + after)
            out.append((i, s, leaf, trees[s][0], root, digest("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def tampered():
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def manifest(docs, **options):
    return sorted((tuple(r) for r in merkle_manifest(docs, tampered=tampered(), **options).select(COLUMNS).collect()), key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(parts)


@pytest.mark.parametrize("fanout,sizes", [(16, [1]), (16, [16, 17, 1]), (2, [1, 2, 3, 9]), (3, [40, 1, 0, 27, 28, 5])])
def test_trees_of_any_size(spark, fanout, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6), f"s{g}" if g else None, rng.choice(["en", None]), n, rng.choice(["Text ", "text ", "Ä"]) + str(n)) for g, size in enumerate(sizes) for n in range(size)]
    rng.shuffle(rows)
    assert manifest(table(spark, rows), fanout=fanout) == brute(rows, fanout)


def test_sources_sort_bytewise_and_nulls_first(spark):
    rows = [(i, s, None, None, "A") for i, s in enumerate(["b", "B", "é", "z", "", None, "😀", "", "aa", "a"])]
    assert manifest(table(spark, rows), fanout=2) == brute(rows, 2)


def test_ties_repeated_rows_nulls_and_clashing_columns(spark):
    docs = odd_documents(spark).withColumn("n_chars", F.length("text"))
    for c in ("rank", "digest", "path", "lo", "hi", "_group", "leaf", "root"):
        docs = docs.withColumn(c, F.lit("y"))
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert manifest(docs) == brute(rows)
    assert merkle_manifest(empty_documents(spark).withColumn("n_chars", F.lit(1)), tampered=tampered()).count() == 0


def test_ranks_of_a_group_that_holds_most_rows(spark):
    rows = [("big" if i % 10 else None, i * 7919 % 5000) for i in range(5000)]
    got = ranked(spark.createDataFrame(rows, "g string, k long").repartition(5), "g", ["k"])
    want = {}
    for g in ("big", None):
        want |= {(g, k): r for r, k in enumerate(sorted(k for x, k in rows if x == g))}
    assert {(r.g, r.k): r["rank"] for r in got.collect()} == want


def test_intervals_nest(spark):
    leaves = spark.range(70).selectExpr("'g' AS g", "id AS rank", "sha2(string(id), 256) AS digest")
    levels, tops = interval_tree(leaves, "g", 4)
    found = [sorted((r.lo, r.hi) for r in level.collect()) for level in levels]
    assert found[0] == [(lo, min(lo + 4, 70)) for lo in range(0, 70, 4)] and found[-1] == [(0, 70)] and len(found) == 4
    assert tops.collect()[0].top == tree([digest(str(i)) for i in range(70)], 4)[0]


def test_query_and_its_sql_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op13_merkle_manifest"](spark, folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_merkle_manifest']})").fetchall()
    assert sorted(found, key=repr) == brute(rows)
    assert {r[-1] for r in found} == {True, False}
