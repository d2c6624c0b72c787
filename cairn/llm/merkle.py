"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Going up, each level is joined with itself on computed sibling places: the place XOR 1 for runs of two, places at other slots of the run
otherwise. A row with its siblings is kept; rows at slot zero make the next level. Going down, each node puts its siblings before its
parent's proof, so all joins together read twice the rows of the lowest one. Keys of all joins are unique, so no group is hot.
Siblings are kept as 32 bytes each; how they lie around a node follows from its place and the size of its level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, placed, refuse, require

DIGEST_BYTES = 32
#: Joins of the way down between two tables in the scratch folder.
JOINS_AT_ONCE = 8
RESULTS = ("leaf", "subroot", "root", "proof", "place", "group_rows", "group_place", "groups")


def field(c: Column | str) -> Column:
    """A value in a leaf's input: ``-`` for null, else the number of its bytes, a colon and the value as text."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: Sequence[Column | str]) -> Column:
    """Hexadecimal SHA-256 over the fields of a row."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def hex_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def slot(arity: int) -> Column:
    return F.pmod("_i", F.lit(arity))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``_siblings``, the digests of the others in the run from left to right; one equijoin for each other slot."""
    known = nodes
    for offset in range(1, arity):
        place = F.col("_i").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("_i") - slot(arity) + F.pmod(slot(arity) + offset, F.lit(arity))
        others = nodes.select(F.col("_g").alias("_og"), F.col("_i").alias("_oi"), F.col("_digest").alias(f"_s{offset}"))
        known = known.join(others, (F.col("_g") == F.col("_og")) & (place == F.col("_oi")), "left").drop("_og", "_oi")
    around = F.array(*[F.col(f"_s{k}") for k in range(1, arity)])
    none = F.lit(bytearray())
    ordered = [F.coalesce(F.when(slot(arity) != t, F.get(around, (F.pmod(t - slot(arity), F.lit(arity)) - 1).cast("int"))), none) for t in range(arity)]
    return known.withColumn("_siblings", F.concat(*ordered)).drop(*[f"_s{k}" for k in range(1, arity)])


def levels(nodes: DataFrame, arity: int, label: str) -> list[DataFrame]:
    """Tables of (_g, _i, _n, _digest, _siblings) from the leaves (with their other columns) up to the level where every group has ended."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    out = []
    while most > 1:
        known = materialize(with_siblings(nodes, arity), label)
        out.append(known)
        made = F.unhex(F.sha2(hex_text(F.concat("_digest", "_siblings")), 256))
        higher = known.where((slot(arity) == 0) & (F.col("_n") > 1))
        nodes = higher.select("_g", F.floor(F.col("_i") / arity).alias("_i"), F.ceil(F.col("_n") / arity).alias("_n"), made.alias("_digest"))
        most = -(-most // arity)
    return [*out, nodes.withColumn("_siblings", F.lit(bytearray()))]


def ends_of(tree: list[DataFrame]) -> DataFrame:
    """(_g, _height, _digest): the last node of each group."""
    return reduce(DataFrame.unionByName, [t.where("_n = 1").select("_g", F.lit(k).alias("_height"), "_digest") for k, t in enumerate(tree)])


def proofs(tree: list[DataFrame], ends: DataFrame, arity: int, label: str) -> DataFrame:
    """The lowest level's rows with ``_proof`` and the columns of ``ends`` (_g, _height, _proof and more), whose proofs continue those of their groups."""
    more = [c for c in ends.columns if c not in ("_g", "_height", "_proof")]
    upper = None
    for k in reversed(range(len(tree))):
        ended = ends.where(F.col("_height").isin(k + 1, *([0] if k == 0 else []))).select("_g", F.lit(0).cast("long").alias("_i"), "_proof", *more)
        above = ended if upper is None else upper.select(ended.columns).unionByName(ended)
        above = above.select(F.col("_g").alias("_ag"), F.col("_i").alias("_ai"), F.col("_proof").alias("_above"), *more)
        nodes = tree[k] if k == 0 else tree[k].where("_n > 1").select("_g", "_i", "_siblings")
        upper = nodes.join(above, (F.col("_g") == F.col("_ag")) & (F.floor(F.col("_i") / arity) == F.col("_ai"))).drop("_ag", "_ai")
        upper = upper.withColumn("_proof", F.concat("_siblings", "_above")).drop("_above")
        if k % JOINS_AT_ONCE == JOINS_AT_ONCE - 1:
            upper = materialize(upper, label)
    return upper


def fold(leaf: Column, proof: Column, sizes: Sequence[tuple[Column, Column]], arity: int, depth: int) -> Column:
    """The root that a leaf (hexadecimal) and its proof give; ``sizes`` are (place, rows) in each tree on the way, each of at most ``depth`` levels."""
    state = F.struct(leaf.alias("digest"), F.lit(1).alias("at"))
    for place, rows in sizes:
        state = F.struct(state["digest"].alias("digest"), state["at"].alias("at"), place.cast("long").alias("i"), rows.cast("long").alias("n"))

        def step(s: Column, _: Column) -> Column:
            own = s["i"] % arity
            others = (F.least(F.lit(arity).cast("long"), s["n"] - s["i"] + own) - 1).cast("int")
            around = hex_text(F.substring(proof, s["at"], others * DIGEST_BYTES))
            cut = (own * 2 * DIGEST_BYTES).cast("int")
            made = F.sha2(F.concat(F.substring(around, F.lit(1), cut), s["digest"], F.substring(around, cut + 1, F.length(around))), 256)
            return F.when(s["n"] <= 1, s).otherwise(F.struct(made.alias("digest"), (s["at"] + others * DIGEST_BYTES).alias("at"), F.floor(s["i"] / arity).alias("i"), F.ceil(s["n"] / arity).alias("n")))

        state = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), state, step)
    return state["digest"]


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), *, group: str = "lang", order: str = "doc_id", keep: Sequence[str] = (), arity: int = 2) -> DataFrame:
    """One row for each input row: ``order``, ``group``, the columns ``keep`` and RESULTS.

    ``leaf``, ``subroot`` and ``root`` are hexadecimal; ``proof`` has the siblings up to the root, 32 bytes each; place and size in the group's tree and
    in that of the groups tell how to fold it. Leaves of a group ascend by ``order``, groups by their value as text. Null orders and the null group come
    first; rows of equal order follow their leaves' digests, and wholly repeated rows are leaves of their own. Texts of any length are hashed where they
    are read; only digests move. Empty texts differ from null. Columns that aren't named don't matter. An empty table gives an empty result.
    """
    if arity < 2:
        raise ValueError("a run needs two nodes at least")
    require(docs, [*columns, group, order, *keep])
    refuse([order, group, *keep], RESULTS)
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null sorts first
    kept = F.struct(*[F.col(c) for c in dict.fromkeys([order, group, *keep])])
    leaves = docs.select(key.alias("_g"), F.col(order).alias("_order"), F.unhex(leaf_of(columns)).alias("_digest"), kept.alias("_kept"), F.monotonically_increasing_id().alias("_tag"))
    nodes = placed(materialize(leaves, "merkle-leaves"), ["_order", "_digest", "_tag"]).drop("_order", "_tag")
    tree = levels(nodes, arity, "merkle-level")
    tops = placed(materialize(ends_of(tree).select(F.lit("").alias("_g"), F.col("_g").alias("_key"), "_height", "_digest"), "merkle-ends"), ["_key"])
    crown = levels(tops, arity, "merkle-crown")
    root = ends_of(crown).select("_g", "_height", F.lit(bytearray()).alias("_proof"), hex_text(F.col("_digest")).alias("root"))
    above = proofs(crown, root, arity, "merkle-proofs").select(
        F.col("_key").alias("_g"), "_height", "_proof", "root", hex_text(F.col("_digest")).alias("subroot"), F.col("_i").alias("group_place"), F.col("_n").alias("groups"))
    done = proofs(tree, materialize(above, "merkle-groups"), arity, "merkle-proofs")
    return done.select("_kept.*", hex_text(F.col("_digest")).alias("leaf"), "subroot", "root", F.col("_proof").alias("proof"), F.col("_i").alias("place"), F.col("_n").alias("group_rows"), "group_place", "groups")


def folded_root(leaf: Column | str, *, arity: int = 2) -> Column:
    """The root that ``leaf`` (hexadecimal) gives with a row's proof, over the columns of :func:`manifest`; equal to ``root`` if the row is unchanged."""
    depth = 64 if arity == 2 else 40  # of 2**63 rows
    return fold(F.col(leaf) if isinstance(leaf, str) else leaf, F.col("proof"), [(F.col("place"), F.col("group_rows")), (F.col("group_place"), F.col("groups"))], arity, depth)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether it still verifies when some are tampered with; odd rows as in :func:`manifest`."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    changed = F.when(tampered, leaf_of(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"]))
    made = manifest(docs.withColumn("changed", changed), columns, keep=["changed"])
    made = made.withColumn("folded_root", folded_root(F.coalesce("changed", "leaf")))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(hex_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_TREE_SQL = """{t}_up AS (
  SELECT g, 0 AS lvl, i, n, h FROM {t}_leaf
  UNION ALL SELECT g, lvl + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {t}_up WHERE n > 1 GROUP BY g, lvl, i // 2),
{t}_path AS (
  SELECT g, i AS leaf_i, 0 AS lvl, i, n, '' AS path FROM {t}_leaf
  UNION ALL SELECT p.g, p.leaf_i, p.lvl + 1, p.i // 2, (p.n + 1) // 2, p.path || coalesce(u.h, '')
  FROM {t}_path p LEFT JOIN {t}_up u ON u.g = p.g AND u.lvl = p.lvl AND u.i = xor(p.i, 1) WHERE p.n > 1)"""
_LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: [ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
#: Tree and proofs by recursion; the roots of changed rows are folded level by level along the places.
OP12_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {_LEAF_SQL.format(n="n_chars")} AS h, CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_LEAF_SQL.format(n="(n_chars + 1)")} ELSE {_LEAF_SQL.format(n="n_chars")} END AS bad FROM documents),
a_leaf AS MATERIALIZED (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h, bad FROM d),
{_TREE_SQL.format(t="a")},
sub AS MATERIALIZED (SELECT g, h FROM a_up WHERE n = 1),
b_leaf AS MATERIALIZED (SELECT '' AS g, g AS grp, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM sub),
{_TREE_SQL.format(t="b")},
walk AS (
  SELECT doc_id, 0 AS tree, g, 0 AS lvl, i, n, bad AS h FROM a_leaf
  UNION ALL SELECT w.doc_id, CASE WHEN w.n > 1 THEN w.tree ELSE 1 END, CASE WHEN w.n > 1 THEN w.g ELSE '' END, CASE WHEN w.n > 1 THEN w.lvl + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN w.i // 2 ELSE b.i END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE b.n END,
    CASE WHEN w.n = 1 THEN w.h WHEN w.i % 2 = 0 THEN sha256(w.h || coalesce(ua.h, ub.h, '')) ELSE sha256(coalesce(ua.h, ub.h) || w.h) END
  FROM walk w LEFT JOIN a_up ua ON w.tree = 0 AND ua.g = w.g AND ua.lvl = w.lvl AND ua.i = xor(w.i, 1) AND w.n > 1
  LEFT JOIN b_up ub ON w.tree = 1 AND ub.lvl = w.lvl AND ub.i = xor(w.i, 1) AND w.n > 1
  LEFT JOIN b_leaf b ON w.tree = 0 AND w.n = 1 AND b.grp = w.g
  WHERE w.n > 1 OR w.tree = 0)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(p.path || q.path) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM a_leaf l JOIN sub s ON s.g = l.g JOIN (SELECT h FROM b_up WHERE n = 1) r ON true JOIN a_path p ON p.g = l.g AND p.leaf_i = l.i AND p.n = 1
JOIN b_leaf t ON t.grp = l.g JOIN b_path q ON q.leaf_i = t.i AND q.n = 1 JOIN walk w ON w.doc_id = l.doc_id AND w.tree = 1 AND w.n = 1"""
