"""The Merkle manifest against a tree built whole in memory; small blocks make many tiers."""

import hashlib
import random
import zlib

import pytest

from spanfold.llm import merkle as q


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]):
        if lower and v is row["text"] and isinstance(v, str):
            v = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def tree(nodes, arity):
    """(root, siblings of each leaf by level as (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            lo = at[i] // arity * arity
            p.append(("".join(nodes[lo : at[i]]), "".join(nodes[at[i] + 1 : lo + arity])))
            at[i] //= arity
        nodes = [sha(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(rows, arity=8):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own], arity)))
    root, tops = tree([t[1] for t in trees], arity)
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            path = path + top
            node = leaf(r, zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 0)
            for a, b in path:
                node = sha(a, node, b)
            out.append((r["doc_id"], leaf(r), subroot, root, sha(*(x for p in path for x in p)), node, node == root))
    return sorted(out, key=str)


def some(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(["en"] * 6 + ["de", "fr", None, "", "é", "日本", "z"])
        rows.append({"doc_id": rng.choice([i, i, i, i, 7, None]), "text": rng.choice([None, "", "Some Text ÀB", "lower", "X" * rng.randrange(40)]), "lang": lang, "source": rng.choice([None, "s", "A"]), "n_chars": rng.choice([None, 3, -1])})
    return rows + rows[:5]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def found(spark, rows, schema=SCHEMA, shape=q.Shape()):
    out = q.manifest(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), shape)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


def test_equals_a_tree_built_whole(spark):
    rows = some(random.Random(1), 700)
    want = brute(rows)
    assert found(spark, rows) == want
    assert any(r[-1] for r in want) and any(not r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 257])
def test_many_tiers(spark, n):
    """With two nodes a run and four a subtree a block has sixteen, so a few hundred rows need several tiers."""
    rng = random.Random(n)
    rows = [{"doc_id": i, "text": f"Text {i}", "lang": "en" if n < 17 else rng.choice(["en", "en", "fr", None]), "source": "s", "n_chars": i} for i in range(n)]
    assert found(spark, rows, shape=q.Shape(2, 2)) == brute(rows, 2)


def test_many_languages_and_a_clashing_column(spark):
    rows = [{"doc_id": i, "text": "T", "lang": f"l{i % 90}", "source": "s", "n_chars": 1, "tree": "x", "at": 5, "row": None} for i in range(200)]
    assert found(spark, rows, SCHEMA + ", tree string, at long, row string") == brute(rows)


def test_tables_without_rows_and_long_texts(spark):
    assert found(spark, []) == []
    rows = [{"doc_id": 0, "text": "Ab c " * 400_000, "lang": None, "source": None, "n_chars": None}]
    assert found(spark, rows) == brute(rows)


def test_walk_holds_three_subtrees():
    """However long the block, a walk reads one node for each proof it has given out, beyond the first subtree."""
    taken, shape = [], q.Shape()

    def nodes():
        for i in range(shape.block):
            taken.append(i)
            yield sha(str(i)), i

    middle = [q.Subtree(2, 8) for _ in range(shape.subtree)]
    for i in range(shape.block):
        middle[i // shape.subtree].add(sha(str(i)))
    for k, (digest, what, path) in enumerate(q.walked(nodes(), [m.rows[2][0] for m in middle], 4, shape)):
        assert what == k and len(taken) <= k + shape.subtree and len(path) == 4


def test_equals_sql(spark):
    import duckdb

    rows = some(random.Random(4), 300)
    with duckdb.connect() as c:
        c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
        c.executemany("insert into documents values (?, ?, ?, ?, ?)", [tuple(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows])
        assert sorted(c.execute(q.ORACLE_SQL).fetchall(), key=str) == brute(rows)
