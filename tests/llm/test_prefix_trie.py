import hashlib
import random
import zlib

import pytest

from anamnesis.llm.prefix_trie import Large, Medium, Small, Tree, conversation_trie


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = []
    for node, convs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        children = [m for m in under if len(m) == len(node) + 1]
        leaves = sum(not any(x[: len(m)] == m and len(x) > len(m) for x in under) for m in under)
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m)
        joined = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), leaves, saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def table(rng, n):
    rows = []
    texts = ["hello", "", None, "é数", "y" * 70, "what"]
    for c in rng.sample(range(n * 3), n):
        for t in range(rng.choice([0, 1, 3, 6, 12])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(texts) if rng.random() < 0.7 else f"own {rng.randrange(9)}"))
    copies = [(5000 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)]
    longer = [(7000, t, "user", f"same {t}") for t in range(60)]
    return rows + copies + longer + rows[:5] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("ranges", [{}, {"keys_per_range": 7}, {"bytes_per_range": 60}])
def test_equals_brute_force(spark, ranges):
    rng = random.Random(len(ranges) + 3)
    rows = table(rng, 60)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "conv_id long, turn long, role string, text string, donor string, key binary").repartition(3)
    got = sorted((tuple(r) for r in conversation_trie(df, **ranges).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_tree_keeps_order_and_grows_its_nodes():
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(256), k=rng.choice([0, 2, 2, 4]))) for _ in range(3000)} | {bytes([7, 9, k]) for k in range(20)} | {bytes([8, 8, k]) for k in range(3)}
    shuffled = sorted(keys)
    rng.shuffle(shuffled)
    tree = Tree()
    for value, key in enumerate(shuffled):
        tree.insert(key, value)
    found, kinds = [], set()

    def below(node, path):
        kinds.add((type(node), getattr(node, "most", 0)))
        path += node.prefix
        if node.value >= 0:
            assert shuffled[node.value] == path
            found.append(path)
        for byte in range(256):
            if (child := node.find(byte)) is not None:
                below(child, path + bytes([byte]))

    below(tree.root, b"")
    assert found == sorted(keys)
    assert {k for k, _ in kinds} == {Small, Medium, Large} and {(Small, 4), (Small, 16)} <= kinds
