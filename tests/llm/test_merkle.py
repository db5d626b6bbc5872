"""Merkle manifests against a plain computation of the same tree."""

import hashlib
import zlib

import pytest

from stormglass.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def levels_of(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i:i + arity])) for i in range(0, len(last), arity)])
    return levels


def path_of(levels, at, arity):
    """Per level: the siblings to the left and to the right."""
    out = []
    for nodes in levels[:-1]:
        lo = at - at % arity
        out.append(("".join(nodes[lo:at]), "".join(nodes[at + 1:lo + arity])))
        at //= arity
    return out


def brute(rows, arity):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {}
    for t in names:
        trees[t].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        grown[t] = levels_of([leaf_of(r) for r in trees[t]], arity)
    top = levels_of([grown[t][-1][0] for t in names], arity)
    out = []
    for i, t in enumerate(names):
        for j, r in enumerate(trees[t]):
            path = path_of(grown[t], j, arity) + path_of(top, i, arity)
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                changed["n_chars"] += 1
            folded = leaf_of(changed)
            for left, right in path:
                folded = digest(left + folded + right)
            out.append((r["doc_id"], leaf_of(r), grown[t][-1][0], top[-1][0],
                        digest("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def documents():
    rows = [(i, f"text {i} é\n" * (i % 4), ["en", "de", None, "é", "z"][i % 5], f"s{i % 3}", i) for i in range(43)]
    rows += [(None, None, None, None, None), (None, "a", "en", None, 1), (None, "a", "en", None, 1), (7, "a", "en", "s", None),
             (3, "other text of an id", "en", "s", 5), (5, "x" * 300_000, "lone", "s", 300_000), (49, "", "", "", 0)]
    return rows


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_proofs_equal_a_plain_tree(spark, arity):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = brute([dict(zip(names, r)) for r in rows], arity)
    got = found(merkle.audit(df, arity=arity))
    assert got == want
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_lone_leaf_and_empty_table(spark):
    df = spark.createDataFrame([(2, "a", "en", "s", 1)], SCHEMA)
    (row,) = merkle.audit(df).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest("")
    empty = merkle.audit(df.limit(0))
    assert empty.count() == 0 and empty.columns == merkle.audit(df).columns
    assert merkle.build(df.limit(0)).root() is None


def test_extra_and_clashing_columns_play_no_part(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "1 AS tree", "2 AS idx", "3 AS digest", "4 AS path", "5 AS row", "6 AS n", "7 AS leaf", "8 AS root")
    assert found(merkle.audit(more)) == found(merkle.audit(df))


def test_root_follows_any_change_and_no_order(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    root = merkle.build(df).root()
    assert merkle.build(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).root() == root
    assert merkle.build(spark.createDataFrame(rows[:-1] + [(49, " ", "", "", 0)], SCHEMA)).root() != root


def test_a_level_takes_one_join_and_no_union(spark, capsys):
    merkle.audit(spark.createDataFrame(documents(), SCHEMA)).explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "Union" not in plan
