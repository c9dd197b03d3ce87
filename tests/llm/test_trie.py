import hashlib
import random
import re
import zlib

import pytest

from lexisift.llm.prefix_trie import PRIMES, prefix_trie

KINDS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def brute(rows):
    given: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            given.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    given = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in given.items()}
    built = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = c % 20 if c >= 0 else -(-c % 20)
        built[c] = given.get(c - rest, [])[:h] + own[h:]
    nodes: dict[tuple, list] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list] = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = own + sum(saved[x] for x in below)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **given):
    frame = spark.createDataFrame(rows, KINDS)
    return sorted((tuple(r) for r in prefix_trie(frame, **given).collect()), key=repr)


def drawn(seed, n=60, long=9):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        c = draw.choice([draw.randrange(-45, 60), draw.randrange(0, 25)])
        turns = [(draw.choice(["user", "assistant", None]), draw.choice(["a b", "a  b\tc", "", None, "x", "  y"])) for _ in range(draw.randrange(1, long))]
        for t, (role, text) in enumerate(turns):
            rows.append((c, draw.choice([t, t, t, None]), role, text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nodes_equal_brute_force(spark, seed):
    rows = drawn(seed)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize(("batch", "partitions"), [(1, 8), (2, 40), (3, 1)])
def test_conversations_broken_over_batches_and_partitions(spark, batch, partitions):
    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    rows = drawn(7, 25, 12) + [(20, t, "user", f"w{t // 2}") for t in range(60)] + [(c, t, "user", f"w{t // 2}") for c in (21, 22, 23) for t in range(50)]
    try:
        for k, v in zip(held, (batch, partitions, "false"), strict=True):
            spark.conf.set(k, v)
        assert found(spark, rows) == brute(rows)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("primes", [(2, 3), (2, 7), (13, 11)])
def test_groups_that_only_share_a_fingerprint_are_split(spark, primes):
    rows = drawn(11)
    assert found(spark, rows, primes=primes) == brute(rows) == found(spark, rows, primes=PRIMES)


def test_a_conversation_without_turns_and_one_of_many(spark):
    """Conversation 41 has fewer turns than it gives up, and no first of its block; thousands end alike."""
    turnless = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(turnless, 0, "user", "hello")] + [(c, 0, "user", "same words here") for c in range(1000, 6000)]
    got = found(spark, rows)
    assert got == brute(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[0] == turnless and root[3] == 5001 and root[7] == next(r for r in brute(rows) if r[1] == 0)[7] != EMPTY


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "user", "w"), (-7, None, None, None), (0, 5, "a", "b"), (0, 2, "a\nb", "c"), (2**40 + 1, 1, "user", "z " * 100_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(None, None, None, None)]) == []
    clash = spark.createDataFrame([(1, 0, "user", "x y", 9, "d", 4)], KINDS + ", rep long, digest string, depth int")
    assert sorted(tuple(r) for r in prefix_trie(clash).collect())[0][:4] == (1, 0, None, 1)
