"""Merkle manifest of a table with incremental witnesses.

Leaves ascend inside their group; every two consecutive nodes become a node, a last single node is hashed alone, and the
groups' roots form one more tree of the same kind.  :class:`Appender` takes nodes one after another: complete subtrees stay
open on a stack, each with the partial witnesses of its leaves, and when the sibling of a subtree is complete both are
joined and their leaves' witnesses grow by the other's root.  A task appends an aligned block of leaves; the blocks' roots
are appends to the next tree above, as often as blocks are left, so a tree of any size is a few rounds of bounded tasks.

Only digests travel: texts are hashed where they are read.

Defined cases: a null column counts as ``-``; an empty text as ``0:``; a null key comes first; rows with equal keys are in
order of their leaf digests (equal rows are interchangeable); an empty table has no rows; other columns are not touched.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import scratch
from .numbering import in_order

#: Levels of a block: a task appends 4096 nodes.
HEIGHT = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def join(*parts: bytes) -> bytes:
    """The digest of concatenated digests, as hexadecimal text."""
    return sha256(b"".join(parts)).hexdigest().encode()


class Appender:
    """A tree that grows by appends.  ``witness[i, level]`` is the sibling that leaf i met at that level, empty if none (yet)."""

    def __init__(self, capacity: int, height: int = HEIGHT):
        self.witness = np.zeros((capacity, height + 1), "S64")
        self.open: list[tuple[int, int, int, bytes]] = []  # level, first leaf, end, root
        self.size = 0

    def append(self, digest: bytes) -> None:
        self._push(0, self.size, self.size + 1, digest)
        self.size += 1

    def _push(self, level: int, first: int, end: int, root: bytes) -> None:
        while self.open and self.open[-1][0] == level:
            _, left, mid, other = self.open.pop()
            self.witness[left:mid, level] = root
            self.witness[first:end, level] = other
            level, first, root = level + 1, left, join(other, root)
        self.open.append((level, first, end, root))

    def close(self, height: int | None = None) -> bytes:
        """The root: open subtrees are raised alone until they meet, and all to ``height`` where the tree goes on above."""
        while len(self.open) > 1 or height is not None and self.open[0][0] < height:
            level, first, end, root = self.open.pop()
            self._push(level + 1, first, end, join(root))
        return self.open[0][3]


def fold(digest: bytes, siblings: list[bytes], pos: int, n: int) -> bytes:
    """The root that a node at ``pos`` of ``n`` and its siblings lead to; siblings are taken from the list's end."""
    while n > 1:
        if pos ^ 1 >= n:
            digest = join(digest)
        elif pos & 1:
            digest = join(siblings.pop(), digest)
        else:
            digest = join(digest, siblings.pop())
        pos, n = pos >> 1, (n + 1) >> 1
    return digest


def _appended(nodes: pa.Table) -> tuple[pa.Table, Appender, bytes]:
    """The nodes of a block in order, the appender that took them, the block's root."""
    nodes = nodes.sort_by("pos")
    tree = Appender(len(nodes))
    for d in nodes.column("digest").to_pylist():
        tree.append(d.hex().encode())
    n = nodes.column("n")[0].as_py()
    return nodes, tree, tree.close(HEIGHT if n > 1 << HEIGHT else None)


def _root(nodes: pa.Table) -> pa.Table:
    _, _, root = _appended(nodes)
    first = nodes.slice(0, 1)
    n = -(-first.column("n")[0].as_py() // (1 << HEIGHT))
    return pa.table({"tree": first.column("tree"), "pos": first.column("block"), "n": pa.array([n], pa.int64()), "digest": pa.array([bytes.fromhex(root.decode())], pa.binary())})


NODES = "tree long, pos long, n long, digest binary"


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", HEIGHT))


def roots(nodes: DataFrame) -> DataFrame:
    """Roots of the blocks of ``nodes``: the nodes that are appended to the tree above."""
    return scratch.materialize(_blocks(nodes).groupBy("tree", "block").applyInArrow(_root, NODES), "block-roots")


def _extend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Witnesses of the nodes of a block: those met in the block, then those of the block's root."""
    nodes, tree, _ = _appended(nodes)
    rest = above.column("witness")[0].as_py()
    own = [b"".join(w) + rest for w in tree.witness.tolist()]
    return pa.table({"tree": nodes.column("tree"), "pos": nodes.column("pos"), "witness": pa.array(own, pa.binary()), "root": pa.concat_arrays([above.column("root").combine_chunks()] * len(nodes))})


def block_paths(nodes: DataFrame) -> DataFrame:
    """(tree, pos, witness, root) of the roots of the blocks of ``nodes`` (tree, pos, n, digest): what leads each to the root of its tree.

    ``witness``: siblings from below to the root, 64 hexadecimal digits each; no sibling where a node is hashed alone.
    """
    levels = [roots(nodes)]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(roots(levels[-1]))
    paths = levels[-1].select("tree", "pos", F.lit(b"").alias("witness"), F.col("digest").alias("root"))
    for level in levels[-2::-1]:
        here, above = _blocks(level).groupBy("tree", "block"), paths.withColumn("block", F.col("pos")).groupBy("tree", "block")
        paths = scratch.materialize(here.cogroup(above).applyInArrow(_extend, "tree long, pos long, witness binary, root binary"), "paths")
    return paths


def paths_of(nodes: DataFrame) -> DataFrame:
    """As :func:`block_paths`, for the nodes themselves."""
    here, above = _blocks(nodes).groupBy("tree", "block"), block_paths(nodes).withColumn("block", F.col("pos")).groupBy("tree", "block")
    return scratch.materialize(here.cogroup(above).applyInArrow(_extend, "tree long, pos long, witness binary, root binary"), "paths")


def _prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Rows of a block of leaves with their whole witnesses and the roots that they lead to."""
    leaves, tree, _ = _appended(leaves)
    up = above.select(["witness", "subroot", "root", "of", "n_of"]).to_pylist()[0]
    n, pos = leaves.column("n")[0].as_py(), leaves.column("pos").to_pylist()
    root = up["root"].hex()
    out: dict[str, list] = {"witness": [], "folded": []}
    for at, w, digest, now in zip(pos, tree.witness.tolist(), leaves.column("digest").to_pylist(), leaves.column("now").to_pylist(), strict=True):
        whole = b"".join(w) + up["witness"]
        siblings = [whole[i - 64 : i] for i in range(len(whole), 0, -64)]
        subroot = fold((digest if now is None else now).hex().encode(), siblings, at, n)
        out["witness"].append(whole)
        out["folded"].append(fold(subroot, siblings, up["of"], up["n_of"]).decode())
    text = lambda x: pa.array([x] * len(leaves), pa.string())
    proof = [sha256(w).hexdigest() for w in out["witness"]]
    return pa.table({
        "key": leaves.column("key"), "leaf": pa.array([d.hex() for d in leaves.column("digest").to_pylist()], pa.string()), "subroot": text(up["subroot"].hex()), "root": text(root),
        "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(out["folded"], pa.string()), "verified": pa.array([f == root for f in out["folded"]], pa.bool_()),
    })


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """32 bytes: SHA-256 of the encoded values, computed where the row is read."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def manifest(rows: DataFrame, *, key: str, group: str, columns: tuple[str, ...], now: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    ``now`` gives columns as they are found at the check: the leaf folded upwards is that of these values, with the
    siblings of the manifest.  ``verified``: it leads to the root.
    """
    now = now or {}
    kind = rows.schema[key].dataType.simpleString()
    then = leaf_digest(*[F.col(c) for c in columns])
    found = leaf_digest(*[now.get(c, F.col(c)) for c in columns]) if now else then
    leaves = rows.select(F.col(key).alias("key"), F.col(group).alias("group"), then.alias("digest"), found.alias("now"))
    leaves = scratch.materialize(leaves, "digests")  # so texts are read once; ordering looks at its rows twice
    leaves = in_order(leaves.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now"))), ["group"], ["key", "digest"], "pos")
    groups = leaves.groupBy("group").agg(F.count("*").alias("n"))
    trees = scratch.materialize(in_order(groups, [], ["group"], "tree"), "trees").withColumnRenamed("group", "of")
    n_trees = trees.count()
    leaves = leaves.join(trees, F.col("group").eqNullSafe(F.col("of"))).select("key", "digest", "now", "tree", "pos", "n")
    leaves = scratch.materialize(_blocks(leaves), "leaves")
    paths = block_paths(leaves.select("tree", "pos", "n", "digest"))
    subroots = paths.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), F.col("root").alias("digest"))
    tops = paths_of(subroots).select(F.col("pos").alias("of"), F.col("witness").alias("w"), F.col("root").alias("top"))
    above = paths.join(tops, F.col("tree") == F.col("of")).select(
        "tree", F.col("pos").alias("block"), F.concat("witness", "w").alias("witness"), F.col("root").alias("subroot"), F.col("top").alias("root"), "of", F.lit(n_trees).cast("long").alias("n_of")
    )
    shape = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_prove, shape).withColumnRenamed("key", key)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return manifest(docs, key="doc_id", group="lang", columns=COLUMNS, now={"n_chars": n_chars})


_ENC = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_ENC.format(c) for c in COLUMNS) + ")"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf, now
  FROM (SELECT *, {_LEAF} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} ELSE {_LEAF} END AS now FROM documents)),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS n_trees FROM (SELECT DISTINCT lang FROM leaves)),
below AS (
  SELECT 0 AS level, tree, pos, n, leaf AS h FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang
  UNION ALL
  SELECT * FROM (SELECT level + 1, tree, pos // 2, (n + 1) // 2, CASE WHEN pos % 2 = 0 THEN sha256(h || coalesce(lead(h) OVER (PARTITION BY tree ORDER BY pos), '')) END AS h
                 FROM below WHERE n > 1) WHERE h IS NOT NULL),
above AS (
  SELECT 0 AS level, tree AS pos, n_trees AS n, h FROM below JOIN langs USING (tree) WHERE n = 1
  UNION ALL
  SELECT * FROM (SELECT level + 1, pos // 2, (n + 1) // 2, CASE WHEN pos % 2 = 0 THEN sha256(h || coalesce(lead(h) OVER (ORDER BY pos), '')) END AS h
                 FROM above WHERE n > 1) WHERE h IS NOT NULL),
folds AS (
  SELECT doc_id, leaf, pos AS id, leaves.lang, 0 AS stage, 0 AS level, tree, pos, n, now AS h, '' AS proof FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang
  UNION ALL
  SELECT doc_id, leaf, id, lang, CASE WHEN f.stage = 0 AND f.n = 1 THEN 1 ELSE f.stage END, CASE WHEN f.stage = 0 AND f.n = 1 THEN 0 ELSE f.level + 1 END, f.tree,
         CASE WHEN f.stage = 0 AND f.n = 1 THEN f.tree ELSE f.pos // 2 END, CASE WHEN f.stage = 0 AND f.n = 1 THEN (SELECT max(n_trees) FROM langs) ELSE (f.n + 1) // 2 END,
         CASE WHEN f.stage = 0 AND f.n = 1 THEN f.h WHEN f.pos % 2 = 1 THEN sha256(coalesce(b.h, a.h, '') || f.h) ELSE sha256(f.h || coalesce(b.h, a.h, '')) END, f.proof || coalesce(b.h, a.h, '')
  FROM folds f LEFT JOIN below b ON f.stage = 0 AND f.n > 1 AND b.level = f.level AND b.tree = f.tree AND b.pos = xor(f.pos, 1)
               LEFT JOIN above a ON f.stage = 1 AND f.n > 1 AND a.level = f.level AND a.pos = xor(f.pos, 1)
  WHERE NOT (f.stage = 1 AND f.n = 1))
SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM folds f JOIN below s ON s.tree = f.tree AND s.n = 1 CROSS JOIN (SELECT h FROM above WHERE n = 1) r WHERE f.stage = 1 AND f.n = 1
"""


def brute_force(rows: list[tuple], tampered) -> list[tuple]:
    """The rows of op13 for (doc_id, source, lang, n_chars, text), level by level, for tests."""
    enc = lambda v: b"-" if v is None else b"%d:" % len(str(v).encode()) + str(v).encode()
    h = lambda *x: sha256(b"".join(x)).hexdigest()

    def tree(nodes):
        """The root of a tree, and for each node (side of the sibling or None, sibling) by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                paths[i].append((p % 2 == 1, nodes[p ^ 1]) if p ^ 1 < len(nodes) else None)
                at[i] = p // 2
            nodes = [h(*(x.encode() for x in nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        return nodes[0] if nodes else None, paths

    leaf = lambda r: h(*map(enc, r))
    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in langs[x]]) for x in order]
    root, tops = tree([t[0] for t in trees])
    out = []
    for x, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for r, path in zip(langs[x], paths, strict=True):
            whole = path + top
            now = leaf((*r[:3], r[3] + 1, r[4]) if r[3] is not None and tampered(r[0]) else r)
            for step in whole:
                now = h(now.encode()) if step is None else h(step[1].encode(), now.encode()) if step[0] else h(now.encode(), step[1].encode())
            out.append((r[0], leaf(r), subroot, root, h(*(s[1].encode() for s in whole if s)), now, now == root))
    return out
