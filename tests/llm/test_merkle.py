"""Trees, proofs and tampered rows against a plain version, and the query against its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm.merkle import OP12_SQL, folded_root, manifest, op12_merkle

FIELDS = ["doc_id", "text", "source"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """The root, and each leaf's siblings from the bottom up."""
    at, proofs = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [range(i, min(i + arity, len(nodes))) for i in range(0, len(nodes), arity)]
        for run in runs:
            for i in run:
                for leaf_no in at[i]:
                    proofs[leaf_no] += [nodes[j] for j in run if j != i]
        nodes, at = [digest(*[nodes[i] for i in run]) for run in runs], [[x for i in run for x in at[i]] for run in runs]
    return nodes[0], proofs


def plain(rows, arity):
    """{(group, leaf, proof)} sorted and the root, for rows of (doc_id, text, source)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0, leaf(r)), leaf(r)))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    made = {k: tree([x[1] for x in sorted(groups[k])], arity) for k in keys}
    root, above = tree([made[k][0] for k in keys], arity)
    out = [(str(k), x, made[k][0], "".join(p + above[n])) for n, k in enumerate(keys) for x, p in zip([x[1] for x in sorted(groups[k])], made[k][1], strict=True)]
    return sorted(out), root


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_is_the_plain_one(spark, docs, arity):
    made = manifest(docs, FIELDS, group="source", arity=arity)
    rows = made.withColumn("folded", folded_root("leaf", arity=arity)).withColumn("wrong", folded_root(F.sha2("leaf", 256), arity=arity)).collect()
    want, root = plain([tuple(r) for r in docs.select(*FIELDS).collect()], arity)
    assert sorted((str(r.source), r.leaf, r.subroot, bytes(r.proof).hex()) for r in rows) == want
    assert {r.root for r in rows} == {root} == {r.folded for r in rows}
    assert all(r.wrong != root for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17])
def test_sizes_of_one_group(spark, n):
    rows = [(i, "" if i == 2 else f"t{i}", "s") for i in range(n)]
    made = manifest(spark.createDataFrame(rows, "doc_id long, text string, source string"), FIELDS, group="source").collect()
    want, root = plain(rows, 2)
    assert sorted((r.source, r.leaf, r.subroot, bytes(r.proof).hex()) for r in made) == want and made[0].root == root


def test_groups_of_many_sizes(spark):
    rows = [(i, str(i), None if i % 11 == 0 else "ab"[i % 2] if i < 40 else f"é{i}") for i in range(60)] + [(None, None, "a"), (None, None, "a")]
    made = manifest(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), FIELDS, group="source")
    got = made.withColumn("folded", folded_root("leaf")).collect()
    want, root = plain(rows, 2)
    assert sorted((str(r.source), r.leaf, r.subroot, bytes(r.proof).hex()) for r in got) == want
    assert {r.folded for r in got} == {root}


def test_edges(spark, docs, empty):
    assert manifest(empty, FIELDS, group="source").count() == 0
    kept = manifest(docs, FIELDS, group="source", keep=["rank", "n", "_salt_", "shard_"]).columns
    assert {"rank", "n", "_salt_", "shard_", "proof"} < set(kept)
    with pytest.raises(ValueError, match="Leaf"):
        manifest(docs.withColumn("Leaf", F.lit(1)), FIELDS, group="source", keep=["Leaf"])
    with pytest.raises(ValueError, match="two nodes"):
        manifest(docs, FIELDS, group="source", arity=1)


def test_query_is_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = op12_merkle(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP12_SQL})").fetchall())
    assert {r.doc_id for r in got.collect() if not r.verified} == {r.doc_id for r in got.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
