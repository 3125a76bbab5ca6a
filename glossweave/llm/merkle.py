"""Merkle manifest of a table with octopus multiproofs.

Every row is a leaf; a group's leaves, in order, form a tree of ARITY children a node; the groups' roots, in order of the groups,
form the tree on top. Positions are dense ranks, so a node has a coordinate (tree, level, position) that needs no pointers.

Proofs are made a leaf partition (BLOCK consecutive leaves of one tree) at a time. The partition knows its own leaves, derives
which coordinates on their ways to the root it cannot compute from them (the minimal union: siblings of what it knows, once
each), gets these by one join, computes the interior nodes that its leaves share once, and expands each leaf's own proof from
them. No partition, row or broadcast grows with a tree; what all partitions of a tree need is sent to them as rows, and a node
is repeated for every SHARE partitions that may ask for it, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossweave.operators.ordering import with_group_rank
from glossweave.session import materialise

ARITY, HEIGHT = 16, 3
#: Leaves of a leaf partition, and leaf partitions that share one copy of a node.
BLOCK, SHARE = ARITY**HEIGHT, 4096


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves; a lone leaf is its own root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def width(n: int, level: int) -> int:
    return -(-n // ARITY**level)


# --- leaves


def encoded(*values: Column) -> Column:
    """Values in one string: ``-`` for null, else the UTF-8 byte count, ``:`` and the value (numbers in decimal)."""
    cells = [v.cast("string") for v in values]
    return F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in cells])


def leaf(*values: Column) -> Column:
    return F.sha2(encoded(*values).cast("binary"), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tree_key(group: Column) -> Column:
    """A key without nulls that sorts as the groups do: null first, then by bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))


# --- trees


@dataclass
class Forest:
    """Leaves (tree, pos, digest, …), tree sizes (tree, n) and the written nodes above the leaves by lowest level."""

    leaves: DataFrame
    trees: DataFrame
    nodes: list[tuple[int, int, DataFrame]]  # lowest and highest level, (tree, level, pos, digest)

    def roots(self) -> DataFrame:
        """(tree, digest): the node at each tree's own height."""
        every = self._from(0)
        sized = self.trees.select("tree", _height(F.col("n")).alias("level"), F.lit(0).cast("long").alias("pos"))
        return every.join(sized, ["tree", "level", "pos"]).select("tree", "digest")

    def _from(self, level: int) -> DataFrame:
        kept = [n.filter(F.col("level") >= level) for _, top, n in self.nodes if top >= level]
        if level == 0:  # a leaf is a root only where it is alone
            kept.append(self.leaves.select("tree", F.lit(0).alias("level"), "pos", "digest"))
        return reduce(DataFrame.unionByName, kept)


def _height(n: Column) -> Column:
    return reduce(lambda a, b: a + b, [(n > ARITY**i).cast("int") for i in range(15)])


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "level", "pos")


def _news_to_blocks(trees: DataFrame, columns: list[str]) -> DataFrame:
    """What a tree's leaf partitions must know of it, one row for each of them: no join on the tree, which may be hot."""
    last = F.floor((F.col("n") - 1) / BLOCK)
    shares = trees.select("tree", "n", *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / SHARE))).alias("_s"))
    first = F.col("_s") * SHARE
    blocks = shares.select("tree", "n", *columns, F.explode(F.sequence(first, F.least(first + SHARE - 1, last))).alias("block"))
    return blocks.withColumn("kind", F.lit(0)).withColumn("level", F.lit(0)).withColumn("pos", F.lit(0).cast("long"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _packed(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string())])


def _lower_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of levels 1 to HEIGHT of each leaf partition, as far as its tree reaches."""

    def found() -> Iterator[tuple]:
        for (tree, block), rows in groupby(_rows(batches), key=itemgetter(0, 1)):
            n = next(rows)[5]  # the news row comes first
            level, first = [r[6] for r in rows], block * BLOCK
            for at in range(1, min(HEIGHT, height(n)) + 1):
                first //= ARITY
                level = [digest("".join(level[i:i + ARITY])) for i in range(0, len(level), ARITY)]
                for i, d in enumerate(level):
                    yield tree, at, first + i, d

    return _packed(found(), NODE)


def grow(leaves: DataFrame) -> Forest:
    """The forest of ``leaves`` (tree, pos, digest, further columns), a written table with dense positions from 0 in each tree."""
    trees = materialise(leaves.groupBy("tree").agg(F.count("*").alias("n")), "merkle-trees")
    cells = leaves.select("tree", F.floor(F.col("pos") / BLOCK).alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "pos",
                          F.lit(None).cast("long").alias("n"), "digest")
    news = _news_to_blocks(trees, []).select("tree", "block", "kind", "level", "pos", "n", F.lit(None).cast("string").alias("digest"))
    low = _in_blocks(news.unionByName(cells)).mapInArrow(_lower_levels, "tree string, level int, pos long, digest string")
    nodes = [(1, HEIGHT, materialise(low, "merkle-low"))]
    most = trees.agg(F.max("n")).first()[0] or 0
    for level in range(HEIGHT, height(most)):
        below = nodes[-1][2].filter(F.col("level") == level)
        # a tree that has its root at this level has one node there, and no other tree has
        many = below.groupBy("tree", F.floor(F.col("pos") / ARITY).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        tall = trees.filter(F.col("n") > ARITY**level).select("tree")
        above = many.join(tall, "tree", "left_semi").select(
            "tree", F.lit(level + 1).alias("level"), F.col("up").alias("pos"),
            F.sha2(F.array_join(F.transform("run", lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))
        nodes.append((level + 1, level + 1, materialise(above, "merkle-high")))
    return Forest(leaves, trees, nodes)


# --- multiproofs


def missing_coordinates(positions: list[int], n: int) -> list[tuple[int, int]]:
    """(level, pos) of all nodes that proofs of these leaves need and that the leaves themselves do not give. Each once."""
    known, out = sorted(set(positions)), []
    for level in range(height(n)):
        end, parents = width(n, level), []
        for parent, run in groupby(known, key=lambda p: p // ARITY):
            have = set(run)
            out += [(level, p) for p in range(parent * ARITY, min((parent + 1) * ARITY, end)) if p not in have]
            parents.append(parent)
        known = parents
    return out


def _missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("pos", pa.int64())])

    def found() -> Iterator[tuple]:
        for (tree, block), rows in groupby(_rows(batches), key=itemgetter(0, 1)):
            n = next(rows)[5]
            asked = [r[4] for r in rows]
            for level, pos in missing_coordinates(asked, n):
                yield tree, block, level, pos

    return _packed(found(), schema)


class Multiproof:
    """A leaf partition's nodes: its leaves and the fetched ones, and the interiors derived from them."""

    def __init__(self, n: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.n, self.height = n, height(n)
        self.known: list[dict[int, str]] = [dict(leaves)] + [{} for _ in range(self.height)]
        for (level, pos), d in fetched.items():
            self.known[level][pos] = d
        own = sorted(leaves)
        for level in range(self.height):
            own = [p for p, _ in groupby(own, key=lambda p: p // ARITY)]
            for parent in own:
                self.known[level + 1][parent] = digest("".join(self.run(level, parent)))
        self._above: dict[tuple[int, int], str] = {}

    def run(self, level: int, parent: int) -> list[str]:
        known = self.known[level]
        return [known[p] for p in range(parent * ARITY, min((parent + 1) * ARITY, width(self.n, level)))]

    def siblings(self, level: int, pos: int) -> list[str]:
        run = self.run(level, pos // ARITY)
        return run[:pos % ARITY] + run[pos % ARITY + 1:]

    def path(self, pos: int) -> list[list[str]]:
        """Siblings of a leaf level by level."""
        return [self.siblings(level, pos // ARITY**level) for level in range(self.height)]

    def joined(self, level: int, pos: int) -> str:
        """All siblings from a node up to the root in one string; shared parts are joined once."""
        if level == self.height:
            return ""
        key = (level + 1, pos // ARITY)
        if key not in self._above:
            self._above[key] = self.joined(*key)
        return "".join(self.siblings(level, pos)) + self._above[key]

    def folded(self, pos: int, own: str) -> str:
        """The root that a leaf of digest ``own`` at this place leads to."""
        for level in range(self.height):
            run = self.run(level, pos // ARITY)
            run[pos % ARITY] = own
            own, pos = digest("".join(run)), pos // ARITY
        return own


def fold(own: str, pos: int, path: list[list[str]]) -> str:
    """The root that ``own`` leads to by a path of siblings."""
    for others in path:
        at = pos % ARITY
        own, pos = digest("".join([*others[:at], own, *others[at:]])), pos // ARITY
    return own


def prove(forest: Forest, asked: DataFrame, news: list[str], carry: list[str], result: str, each: Callable) -> DataFrame:
    """One multiproof for each leaf partition with ``asked`` leaves: columns (tree, pos, ``carry``…) + those of ``result``.

    ``asked`` holds rows of ``forest.leaves``, all or some. ``each(proof, leaf rows, news)`` yields the rows of ``result`` in
    order: ``proof`` is a Multiproof, a leaf row is (pos, digest, carried…), ``news`` the values of the columns ``news`` of
    ``forest.trees``. Every asked row gives one row.
    """
    spark = asked.sparkSession
    null = F.lit(None)
    block = F.floor(F.col("pos") / BLOCK)
    told = _news_to_blocks(forest.trees, news)
    places = asked.select("tree", block.alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "pos", null.cast("long").alias("n"))
    lacking = _in_blocks(told.select("tree", "block", "kind", "level", "pos", "n").unionByName(places)).mapInArrow(
        _missing, "tree string, block long, level int, pos long")
    lacking = materialise(lacking, "merkle-missing")
    least = lacking.agg(F.min("level")).first()[0]

    share = F.floor(F.col("block") / SHARE)
    if least is None:
        fetched = lacking.withColumn("digest", null.cast("string"))
    else:
        # a node is asked for by the leaf partitions below its siblings: one copy for each SHARE of those
        below = F.pow(F.lit(float(ARITY)), F.col("level") + 1 - HEIGHT)
        parent = F.floor(F.col("pos") / ARITY)
        first = F.floor(F.floor(parent * below) / SHARE)
        last = F.greatest(first, F.floor((F.ceil((parent + 1) * below) - 1) / SHARE))
        sizes = forest.trees.select("tree", F.floor(F.floor((F.col("n") - 1) / BLOCK) / SHARE).alias("_last"))
        nodes = forest._from(least).withColumn("_first", first).withColumn("_end", last)
        wide, plain = nodes.filter("_end > _first").join(sizes, "tree"), nodes.filter("_end = _first")
        wide = wide.select("tree", "level", "pos", "digest", F.explode(F.sequence("_first", F.least("_end", "_last"))).alias("_share"))
        nodes = plain.select("tree", "level", "pos", "digest", F.col("_first").alias("_share")).unionByName(wide)
        fetched = lacking.withColumn("_share", share).join(nodes, ["tree", "level", "pos", "_share"])
    types = {f.name: f.dataType for f in forest.trees.schema.fields}
    carried = {f.name: f.dataType for f in asked.schema.fields}
    none = {**{c: null.cast(types[c]).alias(c) for c in news}, **{f"_{c}": null.cast(carried[c]).alias(f"_{c}") for c in carry}}
    columns = ["tree", "block", "kind", "level", "pos", "n", "digest", *news, *[f"_{c}" for c in carry]]
    empty_news, empty_carry = [none[c] for c in news], [none[f"_{c}"] for c in carry]
    rows = reduce(DataFrame.unionByName, [
        told.select("tree", "block", "kind", "level", "pos", "n", null.cast("string").alias("digest"), *news, *empty_carry),
        fetched.select("tree", "block", F.lit(1).alias("kind"), "level", "pos", null.cast("long").alias("n"), "digest", *empty_news, *empty_carry),
        asked.select("tree", block.alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "pos", null.cast("long").alias("n"), "digest",
                     *empty_news, *[F.col(c).alias(f"_{c}") for c in carry]),
    ]).select(*columns)
    fields = spark.createDataFrame([], result).schema.fields
    kept = spark.createDataFrame([], "tree string, pos long").schema.fields
    schema = type(asked.schema)(kept + [asked.schema[c] for c in carry] + fields)
    width_, at = len(news), 7 + len(news)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def found() -> Iterator[tuple]:
            for (tree, _), part in groupby(_rows(batches), key=itemgetter(0, 1)):
                told_row = next(part)
                taken, own = {}, []
                for r in part:
                    if r[2] == 1:
                        taken[r[3], r[4]] = r[6]
                    else:
                        own.append((r[4], r[6], *r[at:]))
                if own:
                    proof = Multiproof(told_row[5], {p: d for p, d, *_ in own}, taken)
                    for leaf_row, got in zip(own, each(proof, own, told_row[7:7 + width_])):
                        yield tree, leaf_row[0], *leaf_row[2:], *got

        return _packed(found(), to_arrow_schema(schema), 1024)

    return _in_blocks(rows).mapInArrow(run, schema)


# --- the manifest of a table


def manifest(rows: DataFrame, group: Column, order: list[Column], values: list[Column], carry: dict[str, Column]) -> tuple[Forest, Forest]:
    """(groups' trees, tree on top) of a table; ``carry`` columns stay with the leaves. Texts never leave their rows' tasks."""
    cells = rows.select(
        tree_key(group).alias("tree"), leaf(*values).alias("digest"), *[c.alias(f"o{i}") for i, c in enumerate(order)],
        *[c.alias(n) for n, c in carry.items()], F.monotonically_increasing_id().alias("_n"))
    # the row number keeps repeated rows apart, so that ranges can be cut between them; their leaves are equal
    ranked = with_group_rank(cells, "tree", [*[f"o{i}" for i in range(len(order))], "digest", "_n"], "rank", "merkle-leaves")
    leaves = materialise(ranked.select("tree", (F.col("rank") - 1).alias("pos"), "digest", *carry), "merkle-placed")
    groups = grow(leaves)
    roots = materialise(groups.roots(), "merkle-roots")
    placed = with_group_rank(roots.select(F.lit("top").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"], "rank", "merkle-top", written=True)
    top = grow(materialise(placed.select("tree", (F.col("rank") - 1).alias("pos"), "digest", "name"), "merkle-top-placed"))
    return groups, top


PROVED = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents.

    Leaves are made of doc_id, source, lang, n_chars and text and ascend by doc_id within their source. Where 5 divides the
    crc32 of doc_id, folded_root is recomputed from the leaf of the text with A-Z lower-cased, else from the leaf itself.

    Nulls in any column are encoded as ``-``; a null source is a tree of its own and comes first, as does a null doc_id, which
    is never tampered with. Rows with one doc_id are ordered by leaf; repeated rows are leaves of their own with equal digests,
    and each row gives one result. Empty texts are values of zero bytes; texts of any length are hashed in place. A lone source
    has itself as root. An empty table gives no rows. Extra columns are not read, so their names do not matter.
    """
    spark = docs.sparkSession
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, leaf(*values[:4], lower_ascii(F.col("text"))))
    groups, top = manifest(docs, F.col("source"), [F.col("doc_id")], values, {"doc_id": F.col("doc_id"), "changed": changed})
    first = top.roots().first()
    root = first["digest"] if first else ""

    def paths(proof: Multiproof, own: list[tuple], _news: tuple) -> Iterator[tuple]:
        for pos, *_ in own:
            yield (proof.path(pos),)

    above = prove(top, top.leaves, [], ["name", "digest"], "path array<array<string>>", paths)
    above = above.select(F.col("name").alias("tree"), F.col("pos").alias("place"), F.col("digest").alias("subroot"), "path")
    # one row a source on either side
    groups.trees = materialise(groups.trees.join(above, "tree"), "merkle-known")

    def each(proof: Multiproof, own: list[tuple], news: tuple) -> Iterator[tuple]:
        place, subroot, path = news
        upper = "".join(d for others in path for d in others)
        shared = fold(proof.known[-1][0], place, path)
        for pos, d, _, other in own:
            reached = shared if other is None else fold(proof.folded(pos, other), place, path)
            yield d, subroot, root, digest(proof.joined(0, pos) + upper), reached, reached == root

    found = prove(groups, groups.leaves, ["place", "subroot", "path"], ["doc_id", "changed"], PROVED, each)
    return found.select("doc_id", *[f.name for f in spark.createDataFrame([], PROVED).schema.fields])


_CELL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_HEAD = " || ".join(_CELL.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 bit by bit: each of a digit's eight bits shifts the sum and may add the polynomial
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda s, d: list_reduce(list_prepend(xor(s, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""
SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
    sha256({_HEAD} || {_CELL.format('text')}) AS leaf,
    CASE WHEN ({_CRC}) % 5 = 0 THEN sha256({_HEAD} || {_CELL.format(_LOW)}) END AS changed,
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, level, pos // 16, n),
subs AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, digest, n) AS (
  SELECT 0, place, subroot, n FROM subs
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
sides AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM low a JOIN low b ON a.tree = b.tree AND a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
tops AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM high a JOIN high b ON a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.level, a.pos),
up(id, tree, level, pos, own, proof) AS (
  SELECT id, tree, 0, pos, coalesce(changed, leaf), '' FROM placed
  UNION ALL
  SELECT up.id, up.tree, up.level + 1, up.pos // 16, sha256(s.before || up.own || s.after), up.proof || s.before || s.after
  FROM up JOIN sides s ON s.tree = up.tree AND s.level = up.level AND s.pos = up.pos),
sub AS (SELECT u.id, u.tree, u.own, u.proof FROM up u JOIN (SELECT id, max(level) AS level FROM up GROUP BY id) m ON m.id = u.id AND m.level = u.level),
over(id, level, pos, own, proof) AS (
  SELECT sub.id, 0, s.place, sub.own, sub.proof FROM sub JOIN subs s ON s.tree = sub.tree
  UNION ALL
  SELECT o.id, o.level + 1, o.pos // 16, sha256(t.before || o.own || t.after), o.proof || t.before || t.after
  FROM over o JOIN tops t ON t.level = o.level AND t.pos = o.pos),
done AS (SELECT o.id, o.own, o.proof FROM over o JOIN (SELECT id, max(level) AS level FROM over GROUP BY id) m ON m.id = o.id AND m.level = o.level),
top AS (SELECT digest FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM top) AS root, sha256(d.proof) AS proof_sha256, d.own AS folded_root,
  d.own = (SELECT digest FROM top) AS verified
FROM placed p JOIN subs s ON s.tree = p.tree JOIN done d ON d.id = p.id
"""
