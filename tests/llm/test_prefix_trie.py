import hashlib
import re
import zlib
from collections import defaultdict

from tests.llm.helpers import LONG
from weftgraph.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, place string, words string"
ROWS = [
    (0, 1, "assistant", "two words"), (0, 0, "user", "hi"), (0, 2, "user", "three  more\x0bwords"), (0, 3, "user", ""), (1, 0, "user", "own"), (2, 0, "user", "hi"), (2, None, None, None),
    (3, 0, "a", "same"), (3, 0, "a", "same"), (3, 0, "a", "rest"), (3, 0, "", "rest"), (5, 0, "user", LONG), (6, 0, "user", "x"), (6, 1, "user", "y"), (6, 2, "user", "z"), (6, 3, "user", "\n"),
    (25, 0, "user", "no base"), (26, 0, "user", "no base"), (27, 1, "user", "no base"), (27, 0, "user", "q"), (-3, 0, "user", "minus"), (-20, 0, "user", "hi"), (-25, 1, "user", "é\U0001f600"), (None, 0, "user", "lost"),
]


def want(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    out = []
    for node, ids in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(1 for m in members if len(m) == len(n) + 1 and m[: len(n)] == n)
        saved = sum((len(members[n]) - 1) * words(n[-1][1]) for n in under if n)
        ends = ",".join(str(c) for c in sorted(ids) if len(rebuilt[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), kids(node), sum(1 for n in under if not kids(n)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(spark, rows):
    turns = spark.createDataFrame([(*r, "k", "p", "w") for r in rows], SCHEMA)
    made = prefix_trie.conversation_trie(turns).drop("key", "parent")
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in made.collect()]


def test_by_brute_force(spark):
    assert sorted(got(spark, ROWS), key=str) == sorted(want(ROWS), key=str)


def test_deep_and_common_conversations(spark, monkeypatch):
    """A conversation of 70 turns and many copies of one; their ids are digested in several chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    rows = [(0, i, "user", f"t{i} w") for i in range(70)] + [(100 + i, j, "user", f"copy {j}") for i in range(60) for j in range(5)]
    rows += [(20 * i, j, "user", "head" if j < 40 else f"{i}") for i in range(20, 24) for j in range(45)]
    assert sorted(got(spark, rows), key=str) == sorted(want(rows), key=str)


def test_ties_are_ordered_by_role_and_text(spark):
    rows = [(c, 0, "user", f"{(7 * i) % 10} tie") for c in (25, 45) for i in range(10)]
    assert sorted(got(spark, rows), key=str) == sorted(want(rows), key=str)
    assert sorted(got(spark, rows[::-1]), key=str) == sorted(want(rows), key=str)


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 0, "user", "lost")]) == []
