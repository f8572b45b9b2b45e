"""Operator 11: the prefix trie against all prefixes listed one by one."""

import hashlib
import random
import zlib

import duckdb
import pytest

from casefile.llm import turn_trie
from casefile.llm.queries import QUERIES
from tests.llm.conftest import SF

DDL = "conv_id long, turn long, role string, text string"


def rebuilt(rows, heads=6, block=100):
    turns = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] is not None, r[1] or 0)):
        if conv is not None:
            turns.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads if heads else 0
        out[c] = turns.get(c - c % block, [])[:h] + own[h:]
    return out


def brute(made):
    members = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members.setdefault(tuple(made[c][:d]), []).append(c)
    rows = []
    for node, convs in members.items():
        below = [p for p in members if p[:len(node)] == node]
        ends = [str(c) for c in convs if len(made[c]) == len(node)]
        rows.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs),
                     sum(len(p) == len(node) + 1 for p in below),
                     sum(not any(q[:-1] == p for q in below if q) for p in below),
                     sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                     hashlib.sha256(",".join(ends).encode()).hexdigest()))
    return sorted(rows, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    rows = duckdb.connect().execute(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    got = QUERIES["op11_prefix_trie"](spark, SF)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert found(got) == brute(rebuilt(rows))


def random_rows(seed, convs, deepest, texts, missing=0.1):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.choice([rng.randrange(0, 30), rng.randrange(190, 330), rng.randrange(-120, 700)])
        if rng.random() < missing or any(r[0] == c for r in rows):
            continue
        rows += [(c, t, rng.choice(["user", "system"]) if rng.random() < .1 else "user",
                  rng.choice(texts) if rng.random() < .4 else texts[0]) for t in range(rng.randint(1, deepest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch,heads,hot", [(1, 200_000, 6, 10_000), (2, 7, 6, 1), (3, 1, 0, 3), (4, 40, 2, 0)])
def test_many_tasks_and_batches(spark, monkeypatch, seed, batch, heads, hot):
    """Conversations over several tasks, tries of a few turns, parents with many children."""
    monkeypatch.setattr(turn_trie, "BATCH_TURNS", batch)
    monkeypatch.setattr(turn_trie, "HOT_CHILDREN", hot)
    monkeypatch.setattr(turn_trie, "HOT_PARENTS", 10**9)
    rows = random_rows(seed, 60, 9, ["", "a", "bb", "ccc"])
    free = next(c for c in range(700, 800) if c % 100)
    rows += [(free, t, "user", ["", "a"][t % 3 == 0]) for t in range(150)]      # one conversation with a third of all rows
    rows += [(free + 1, t, "user", ["", "a"][t % 3 == 0]) for t in range(148)]  # and a prefix of it
    got = found(turn_trie.prefix_trie(spark.createDataFrame(rows, DDL).repartition(5), heads))
    assert got == brute(rebuilt(rows, heads))


def test_spanning_conversations_are_seen(spark):
    rows = [(5, t, "user", str(t % 4)) for t in range(400)] + [(6, 0, "user", "0")]
    ranked, spanning = turn_trie.rank_turns(spark.createDataFrame(rows, DDL))
    assert spanning == [5]
    assert sorted(r["rank"] for r in ranked.collect() if r.conv_id == 5) == list(range(400))
    got = found(turn_trie.prefix_trie(spark.createDataFrame(rows, DDL)))
    assert got == brute(rebuilt(rows, 0))


def test_copies(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "BATCH_TURNS", 50)
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 90) for t in range(3)]
    got = found(turn_trie.prefix_trie(spark.createDataFrame(rows, DDL)))
    assert got == brute(rebuilt(rows, 0)) and len(got) == 4


def test_odd_rows(spark):
    ddl = DDL + ", depth long, part int, m1 string, chars int, owner string, n int"
    clash = (7, 8, "m", 9, "o", 1)
    rows = [(None, 0, "user", "no conversation"), (0, None, None, None), (0, 1, "user", "x" * 300_000), (1, 0, "", ""),
            (1, 1, "user", "x" * 300_000), (7, None, "user", "日本語"), (7, 0, "user", "y"), (7, 1, "a", "z"),
            (107, 0, "q", "w"), (108, 0, "q", "w"), (108, 1, "q", "w"), (5, 3, "same", "t"), (5, 3, "same", "t")]
    odd = spark.createDataFrame([r + clash for r in rows], ddl)
    assert found(turn_trie.prefix_trie(odd, 6)) == brute(rebuilt(rows))
    assert found(turn_trie.prefix_trie(odd)) == brute(rebuilt(rows, 0))
    assert turn_trie.prefix_trie(spark.createDataFrame([], ddl), 6).count() == 0


def test_fat_binary_search():
    """Exit nodes of a trie of texts: the deepest node that is a prefix, and the child on whose edge a text leaves."""
    rng = random.Random(5)
    for _ in range(60):
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(12)]
        words += [w[:rng.randint(1, len(w))] + "c" for w in words]
        names, offsets = [], []
        for w in words:
            offsets.append(len(names))
            names += [w[:n] for n in range(len(w) + 1)]
        trie = turn_trie.ZFastTrie(names, 0, 0)
        for k, w in enumerate(words):
            node = trie.insert(offsets[k], len(w))
            assert names[trie.at[node] + trie.extent[node]] == w
        nodes = {names[a + e]: n for n, (a, e) in enumerate(zip(trie.at, trie.extent))}
        wanted = {""} | set(words) | {w[:n] for w in words for n in range(len(w))
                                      if len({v[n] for v in words if v[:n] == w[:n] and len(v) > n}) > 1}
        assert set(nodes) == wanted and len(trie.handles) == len(nodes) - 1
        for k, w in enumerate(words):
            for n in range(len(w) + 1):
                node, child = trie.locate(offsets[k], n)
                deepest = max((p for p in wanted if w[:n].startswith(p)), key=len)
                assert node == nodes[deepest] and (child is None) == (len(deepest) == n)
