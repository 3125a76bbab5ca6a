"""Merkle manifest and its multiproofs against trees built leaf by leaf."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from glossweave.llm import merkle
from glossweave.session import materialise

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, at):
    """(before, after) of every level."""
    for level in tree[:-1]:
        run, mine = level[at // 16 * 16:at // 16 * 16 + 16], at % 16
        yield run[:mine], run[mine + 1:]
        at //= 16


def brute(rows):
    leaf = lambda r, text: h(*[cell(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = [*way(trees[s], at), *way(top, place)]
            proof = h(*[d for before, after in steps for d in (*before, *after)])
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            folded = leaf(r, r["text"] and r["text"].translate(LOW)) if tampered else own
            for before, after in steps:
                folded = h(*before, folded, *after)
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("share", [merkle.SHARE, 1])
def test_proofs_equal_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(merkle, "SHARE", share)  # 1: every leaf partition has its own copies of nodes
    rng = random.Random(4)
    rows = [dict(doc_id=i, text=rng.choice(["Some Text", "lower", "", None, "Ünï X"]) , lang=rng.choice(["en", None]), source="hot", n_chars=i) for i in range(4400)]
    rows += [dict(doc_id=i, text=f"T {i}", lang="de", source=f"s{i % 20}", n_chars=None) for i in range(5000, 5100)]
    rows += [dict(doc_id=9, text="A" * 100000, lang=None, source="alone", n_chars=1), dict(doc_id=None, text="x", lang="", source="alone2", n_chars=0)]
    rows += [dict(doc_id=7000 + i // 2, text="Copy", lang="fr", source=None, n_chars=4) for i in range(40)]
    rows += [dict(doc_id=None, text=None, lang=None, source=None, n_chars=None)] * 3
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, None) for r in rows], DOC + ", tree string, pos int, digest string")
    got = [tuple(r) for r in merkle.prove_documents(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_empty_and_single_rows(spark):
    assert merkle.prove_documents(spark.createDataFrame([], DOC)).collect() == []
    one = merkle.prove_documents(spark.createDataFrame([(1, "a", None, "s", 2)], DOC)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h() and one.verified


@pytest.mark.parametrize("n, asked", [(1, [0]), (16, [3]), (17, [16]), (300, [0, 1, 17, 299]), (5000, [4999]), (5000, [0, 15, 4096, 4097]), (4097, [4096])])
def test_missing_coordinates_are_the_least_that_prove(n, asked):
    tree = levels([h(str(i)) for i in range(n)])
    need = {(level, p) for a in asked for level, _ in enumerate(tree[:-1]) for p in range(a // 16 ** (level + 1) * 16, min(a // 16 ** (level + 1) * 16 + 16, len(tree[level])))}
    given = {(level, a // 16 ** level) for a in asked for level in range(len(tree))}
    found = merkle.missing_coordinates(asked, n)
    assert len(found) == len(set(found)) and set(found) == need - given
    proof = merkle.Multiproof(n, {a: tree[0][a] for a in asked}, {c: tree[c[0]][c[1]] for c in found})
    for a in asked:
        assert proof.folded(a, tree[0][a]) == merkle.fold(tree[0][a], a, proof.path(a)) == tree[-1][0]
        assert proof.folded(a, h("other")) != tree[-1][0]
        assert proof.joined(0, a) == "".join(d for before, after in way(tree, a) for d in (*before, *after))


def test_proofs_of_some_leaves(spark):
    """Only leaf partitions with asked leaves prove, and every path leads to its tree's root."""
    cells = [("a", i, h("a", str(i))) for i in range(4200)] + [("b", i, h("b", str(i))) for i in range(20)]
    leaves = materialise(spark.createDataFrame(cells, "tree string, pos long, digest string"), "test-leaves")
    forest = merkle.grow(leaves)
    roots = {r.tree: r.digest for r in forest.roots().collect()}
    assert roots == {t: levels([d for s, _, d in cells if s == t])[-1][0] for t in ("a", "b")}

    def each(proof, own, news):
        for pos, d in [(r[0], r[1]) for r in own]:
            yield (proof.folded(pos, d), len(proof.path(pos)))

    asked = leaves.filter((F.col("pos") % 1000 == 7) & (F.col("tree") == "a"))
    got = merkle.prove(forest, asked, [], [], "reached string, levels int", each).collect()
    assert sorted(r.pos for r in got) == [7, 1007, 2007, 3007, 4007]
    assert all(r.reached == roots["a"] and r.levels == 4 for r in got)
