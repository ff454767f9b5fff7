import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import LONG, documents
from weftgraph.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, place string, n string, digest string"
ROWS = [
    (1, None, "en", 3, "a\nb"), (2, None, None, None, None), (3, "", "en", 0, ""), (4, "", "", 1, "\n"), (5, "é", "fr", 2, "\n\n"), (6, "z", "漢", 1, "\U0001f600\n"),
    (None, "z", "en", 1, "x\ny"), (None, None, None, None, None), (7, "z", "en", 1, "same\n"), (7, "z", "en", 1, "same\n"), (7, "z", "en", 1, "other\n"), (-8, "long", "en", 1, LONG + "\n" + LONG),
]
HOT = [(i, "hot" if i % 3 else f"s{i % 11}", "en", i, f"text\n{i}") for i in range(100, 420)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    values = [*row[:1], row[1], row[2], row[3], text]
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def climb(nodes):
    """All levels of the tree over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    for level in levels[:-1]:
        run = i // 3 * 3
        yield i - run, [x for j, x in enumerate(level[run : run + 3], run) if j != i]
        i //= 3


def want(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], leaf(r, r[4]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: climb([x[1] for x in by[s]]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, own, r) in enumerate(by[s]):
            path = [*way(trees[s], i), *way(top, k)]
            even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "")) if even and r[4] is not None else own
            for at, others in path:
                node = sha("".join([*others[:at], node, *others[at:]]))
            root = top[-1][0]
            out.append((doc_id, own, trees[s][-1][0], root, sha("".join(x for _, o in path for x in o)), node, node == root))
    return out


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "l", "p", "n", "d") for r in rows], SCHEMA)
    made = merkle.digests(docs, **options)
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in made.collect()]


@pytest.mark.parametrize("options", [{}, {"height": 2, "top": 50}, {"height": 1, "top": 4}])
def test_by_brute_force(spark, options):
    """One block a source; several rounds of blocks; more sources than the driver may hold."""
    rows = ROWS + HOT
    made, plain = got(spark, rows, **options), want(rows)
    assert sorted(made, key=str) == sorted(plain, key=str)
    assert 0 < sum(r[-1] for r in made) < len(rows)


def test_one_row_is_leaf_subroot_and_root(spark):
    (r,) = got(spark, ROWS[:1])
    assert r[1] == r[2] == r[3] and r[4] == sha("") and [r] == want(ROWS[:1])


def test_untampered_rows_verify_and_others_do_not(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(50)])
    assert merkle.manifest(docs).filter("verified").count() == 50
    assert merkle.manifest(docs, F.concat("text", F.lit("!"))).filter("verified").count() == 0


def test_empty_table(spark):
    assert got(spark, []) == []
