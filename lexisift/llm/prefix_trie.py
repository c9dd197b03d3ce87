"""The trie of conversations: which beginnings they share, and what sharing them saves."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..shipping import shipped
from .common import durable, with_values

#: Fixed values of the fingerprints: two primes below 2**31 and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1566083941)
#: Conversations of one block of so many take the beginnings of its first; what they take has fewer than MOST turns.
BLOCK, MOST = 20, 4
#: Ids of ends that are joined in one piece before the pieces of a node are hashed in order.
PIECE = 4096
DIGEST = ["d1", "d2", "d3", "d4"]


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), dtype=np.int64), base % prime, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


@dataclass
class Seen:
    """What a run of turns in order says to the turns after it.

    Of its last conversation: how many of its turns are in the run, the sums of their fingerprints counted from the
    run's first turn of it, their words, and the first three; ``lead``: the last first-of-a-block and its first three.
    """

    first: int | None = None
    last: int | None = None
    rows: int = 0
    sums: tuple[int, int] = (0, 0)
    words: int = 0
    head: list = field(default_factory=list)
    lead: int | None = None
    lead_head: list = field(default_factory=list)

    def then(self, other: Seen, primes: tuple[int, int]) -> Seen:
        if self.last is None or other.last is None:
            return other if self.last is None else self
        out = replace(other, first=self.first)
        if other.lead is None:
            out.lead, out.lead_head = self.lead, self.lead_head
        elif other.lead == self.lead:
            out.lead_head = (self.lead_head + other.lead_head)[: MOST - 1]
        if other.last == self.last:
            out.rows, out.words, out.head = self.rows + other.rows, self.words + other.words, (self.head + other.head)[: MOST - 1]
            out.sums = tuple((a + pow(b, self.rows, p) * c) % p for a, c, b, p in zip(self.sums, other.sums, BASES, primes, strict=True))
        return out


class Turns:
    """A run of turns, in order, of whole or broken conversations."""

    def __init__(self, batch: pa.RecordBatch, primes: tuple[int, int]) -> None:
        self.conv, self.lead, self.h, self.words = (batch.column(c).to_numpy() for c in ("conv_id", "lead", "h", "words"))
        self.digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), dtype=">i8").reshape(-1, 4).astype(np.int64)
        self.codes = [(self.digest[:, k] & (2**62 - 1)) % p for k, p in enumerate(primes)]
        self.starts = np.flatnonzero(np.r_[True, self.conv[1:] != self.conv[:-1]])
        self.ends = np.r_[self.starts[1:], len(self.conv)]
        self.segment = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        self.primes = primes

    def head(self, k: int) -> list:
        """The first turns of the k-th conversation in the run: codes, words and digest of each."""
        rows = range(self.starts[k], min(self.ends[k], self.starts[k] + MOST - 1))
        return [(int(self.codes[0][i]), int(self.codes[1][i]), int(self.words[i]), tuple(self.digest[i].tolist())) for i in rows]

    def sums(self, before: int) -> list[np.ndarray]:
        """Sums of fingerprints within each conversation; the first one goes on after ``before`` turns."""
        out = []
        for codes, base, prime in zip(self.codes, BASES, self.primes, strict=True):
            terms = np.cumsum(codes * powers(base, self.ordinals(before), prime) % prime)
            out.append((terms - np.r_[0, terms][self.starts][self.segment]) % prime)
        return out

    def ordinals(self, before: int) -> np.ndarray:
        out = np.arange(len(self.conv)) - self.starts[self.segment] + 1
        out[: self.ends[0]] += before
        return out

    def seen(self) -> Seen:
        k = len(self.starts) - 1
        sums, begin = self.sums(0), self.starts[k]
        leads = np.flatnonzero(self.conv[self.starts] == self.lead[self.starts])
        lead = int(leads[-1]) if len(leads) else None
        return Seen(
            int(self.conv[0]), int(self.conv[-1]), int(self.ends[k] - begin), (int(sums[0][-1]), int(sums[1][-1])), int(self.words[begin:].sum()), self.head(k),
            None if lead is None else int(self.conv[self.starts[lead]]), [] if lead is None else self.head(lead),
        )

    def prefixes(self, carry: Seen, last: bool) -> pa.RecordBatch:
        """A row for each beginning of the rebuilt conversations, as far as its last turn is in the run.

        The beginnings that a conversation takes from its block's first come with its last turn. ``last``: whether
        the run's last conversation ends here.
        """
        primes, goes_on = self.primes, carry.last == self.conv[0]
        before = carry.rows if goes_on else 0
        ordinal, sums = self.ordinals(before), self.sums(before)
        words = np.cumsum(self.words)
        words = words - np.r_[0, words][self.starts][self.segment]
        if goes_on:
            own = slice(0, self.ends[0])
            words[own] += carry.words
            for k, p in enumerate(primes):
                sums[k][own] = (sums[k][own] + carry.sums[k]) % p
        n = len(self.starts)
        skipped, taken, taken_words, skipped_words = (np.zeros(n, dtype=np.int64) for _ in range(4))
        shift = [np.zeros(n, dtype=np.int64) for _ in primes]  # to the sums of own turns
        factor = [np.ones(n, dtype=np.int64) for _ in primes]
        extra: list[tuple] = []
        lead, lead_head = carry.lead, carry.lead_head
        value = lambda head, m, k: sum(x[k] * pow(BASES[k], i + 1, primes[k]) for i, x in enumerate(head[:m])) % primes[k]
        for j in range(n):
            begin, c = self.starts[j], int(self.conv[self.starts[j]])
            of, head = int(self.lead[begin]), (carry.head + self.head(j) if j == 0 and goes_on else self.head(j))[: MOST - 1]
            if c == of:
                lead, lead_head = c, head
                skip, take = 0, []
            else:
                skip, take = int(self.h[begin]), lead_head[: int(self.h[begin])] if lead == of else []
            skipped[j], taken[j] = skip, len(take)
            taken_words[j], skipped_words[j] = sum(x[2] for x in take), sum(x[2] for x in head[:skip])
            for k, p in enumerate(primes):
                factor[k][j] = pow(BASES[k], -(skip - len(take)), p)
                shift[k][j] = (value(take, len(take), k) - value(head, skip, k) * int(factor[k][j])) % p
            if j < n - 1 or last:
                total = int(self.ends[j] - begin) + (before if j == 0 else 0)
                prints, sofar = [0, 0], 0
                extra.append((c, 0, 0, 0, 0, 0, 0, 0, 0, 0, bool(take) or total > skip))
                for d, x in enumerate(take, 1):
                    above, sofar = prints, sofar + x[2]
                    prints = [(a + x[k] * pow(BASES[k], d, primes[k])) % primes[k] for k, a in enumerate(above)]
                    extra.append((c, d, prints[0] << 31 | prints[1], above[0] << 31 | above[1], *x[3], x[2], sofar, d < len(take) or total > skip))
        at = self.segment
        keep = ordinal > skipped[at]
        at = at[keep]
        depth = ordinal[keep] - skipped[at] + taken[at]
        own = [(s[keep] * f[at] + m[at]) % p for s, f, m, p in zip(sums, factor, shift, primes, strict=True)]
        above = [(s - c[keep] * powers(b, depth, p)) % p for s, c, b, p in zip(own, self.codes, BASES, primes, strict=True)]
        more = np.r_[self.conv[1:] == self.conv[:-1], not last][keep]
        columns = [self.conv[keep], depth, own[0] << 31 | own[1], above[0] << 31 | above[1], *self.digest[keep].T, self.words[keep], words[keep] - skipped_words[at] + taken_words[at], more]
        joined = [np.concatenate([np.array([x[i] for x in extra], dtype=c.dtype), c]) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in joined], ["conv_id", "depth", "print", "above", *DIGEST, "words", "sofar", "more"])


def _ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, lead, h, words, digest) of all turns in order, the first conversation of a block before the others."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    lead = F.col("conv_id") - F.col("conv_id") % BLOCK
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    told = given.select(
        "conv_id", lead.alias("lead"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int").alias("h"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), digest.alias("digest"), "turn", "role", (F.col("conv_id") != lead).alias("follows"),
    )
    order = ["lead", "follows", "conv_id", "turn", "role", "digest"]
    return durable(told.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "lead", "h", "words", "digest"))


def prefix_rows(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(conv_id, depth, print, above, d1 to d4, words, sofar, more): every beginning of every rebuilt conversation.

    ``print`` and ``above`` are the fingerprints of the beginning and of the one a turn shorter, d1 to d4 the SHA-256
    of its last turn, ``words`` and ``sofar`` the words of its last text and of all its texts, ``more`` whether the
    conversation goes on. Turns lie in order over partitions; each says in one row what those after it have to know,
    and that is all that comes to the driver.
    """
    ordered = _ordered(conversations)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            if batch.num_rows:
                seen = seen.then(Turns(batch, primes).seen(), primes)
        if seen.last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(seen)], pa.binary())], ["at", "seen"])

    told = sorted(((r["at"], pickle.loads(r["seen"])) for r in shipped(ordered).mapInArrow(look, "at int, seen binary").collect()), key=lambda x: x[0])
    carries, carry = {}, Seen()
    for (at, seen), after in zip(told, [*(x.first for _, x in told[1:]), None], strict=False):
        carries[at] = (carry, after != seen.last)
        carry = carry.then(seen, primes)
    shared = conversations.sparkSession.sparkContext.broadcast(carries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        carry, ends = shared.value.get(TaskContext.get().partitionId(), (Seen(), True))
        for batch in batches:
            if batch.num_rows:
                turns = Turns(batch, primes)
                if waiting:
                    yield waiting.prefixes(carry, bool(waiting.conv[-1] != turns.conv[0]))
                    carry = carry.then(waiting.seen(), primes)
                waiting = turns
        if waiting:
            yield waiting.prefixes(carry, ends)

    schema = "conv_id long, depth long, print long, above long, d1 long, d2 long, d3 long, d4 long, words long, sofar long, more boolean"
    return ordered.mapInArrow(run, schema)


NODE = ["depth", "print", "x1", "x2"]


def _against_representatives(rows: DataFrame) -> DataFrame:
    """The rows with the least member of their group, and whether their last turn and what is above it are its own."""
    same = [*DIGEST, "above"]
    groups = rows.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count("*").alias("rows"), F.max("more").alias("deep"), *(F.min_by(c, "conv_id").alias(f"rep_{c}") for c in same))
    equal = F.lit(True)
    for c in same:
        equal = equal & (F.col(c) == F.col(f"rep_{c}"))
    return with_values(rows, durable(groups), NODE).withColumn("equal", equal).drop(*same, *(f"rep_{c}" for c in same))


def _chained(rows: DataFrame) -> DataFrame:
    """The rows with x1 and x2 from a hash chain over the digests of each conversation from its start."""
    names = ["conv_id", "depth", *DIGEST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chain = None, b""
        for batch in batches:
            ids, *digests = (batch.column(c).to_pylist() for c in ("conv_id", *DIGEST))
            out = []
            for c, *d in zip(ids, *digests, strict=True):
                chain = hashlib.sha256((chain if c == conv else b"") + np.array(d, dtype=">i8").tobytes()).digest()
                conv = c
                out.append(np.frombuffer(chain, dtype=">i8"))
            x = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["conv_id", "depth", "y1", "y2"])

    return shipped(rows.select(*names)).repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, "conv_id long, depth long, y1 long, y2 long")


def _verified(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, before, sofar, more, rep, deep): each row with its node, groups that are no node split.

    A group's members have equal beginnings if at every depth their turn is the representative's and so is the
    fingerprint above, which holds for the group above in turn. Where that fails, conversations of the group are
    told apart from there on by a hash chain over their turns, and compared again.
    """
    plain = rows.withColumn("x1", F.lit(0).cast("long")).withColumn("x2", F.lit(0).cast("long"))
    told = durable(_against_representatives(plain).withColumn("before", F.col("sofar") - F.col("words")))
    odd = told.where(~F.col("equal")).select("depth", "print").distinct()
    if not odd.isEmpty():
        since = durable(told.join(odd, ["depth", "print"], "left_semi").groupBy("conv_id").agg(F.min("depth").alias("since")))
        apart = _chained(plain.join(since, "conv_id", "left_semi")).join(since, "conv_id").where("depth >= since").select("conv_id", "depth", "y1", "y2")
        split = plain.join(apart, ["conv_id", "depth"], "left").withColumn("x1", F.coalesce("y1", "x1")).withColumn("x2", F.coalesce("y2", "x2")).drop("y1", "y2")
        told = durable(_against_representatives(split).withColumn("before", F.col("sofar") - F.col("words")))
        if not told.where(~F.col("equal")).isEmpty():
            raise RuntimeError("beginnings with one hash chain differ")
    return told.select("conv_id", "depth", "before", "sofar", "more", "rep", "deep")


def _ends(conv: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes where conversations end: the hash of their ids in order.

    Ids lie in order over tasks and are joined in pieces; the pieces of a node stream through its hash, in order.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, node, ids = [], None, []
            for r, d, c in zip(*(batch.column(x).to_pylist() for x in ("end_rep", "len", "conv_id")), strict=True):
                if ids and ((r, d) != node or len(ids) == PIECE):
                    rows.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = (r, d)
                ids.append(c)
            if ids:
                rows.append((*node, ids[0], ",".join(map(str, ids))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["rep", "depth", "from", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
        for batch in batches:
            rows = []
            for r, d, ids in zip(*(batch.column(x).to_pylist() for x in ("rep", "depth", "ids")), strict=True):
                if (r, d) == node:
                    state.update(f",{ids}".encode())
                else:
                    if node:
                        rows.append((*node, state.hexdigest()))
                    node, state = (r, d), hashlib.sha256(ids.encode())
            yield out(rows)
        if node:
            yield out([(*node, state.hexdigest())])

    order = ["end_rep", "len", "conv_id"]
    joined = shipped(conv.select(*order)).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "rep long, depth long, from long, ids string")
    return joined.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "from").mapInArrow(hashes, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    A node is a distinct beginning of the rebuilt conversations; the first h turns of conversation c come from
    c - c % 20, h being crc32(c) % 4, and its own follow from the h-th on. ``conv_id`` is the least member.

    Members whose least one at a depth they are themselves are its own from there to their end. So children, leaves
    and tokens saved below a node are sums over its members of what each owns, and no depth waits for another.

    Turns are ordered by turn, nulls first, those of one turn by role, then by the hash of the text. A null role or text
    is empty. Repeated rows are turns each. Rows with a null conv_id belong to no conversation and are left out. A
    conversation or text of any length goes through in parts; other columns are ignored; an empty table gives no node,
    not even the root. Two turns are equal if the SHA-256 of their role and text is.
    """
    told = durable(_verified(durable(prefix_rows(conversations, primes))))
    mine = F.col("rep") == F.col("conv_id")
    conv = durable(
        told.groupBy("conv_id").agg(
            F.max("depth").alias("len"), F.min(F.when(mine, F.col("depth"))).alias("own"), F.min(F.when(mine, F.col("before"))).alias("own_before"), F.max("sofar").alias("all_words"),
            F.max_by("rep", F.when(~mine, F.col("depth"))).alias("parent"), F.max_by("rep", "depth").alias("end_rep"), F.max(mine & ~F.col("more") & ~F.col("deep")).alias("leaf"), F.count("*").alias("rows"),
        )
    )
    facts = conv.select("conv_id", "len", F.coalesce("own", F.col("len") + 1).alias("own"), F.coalesce("own_before", "all_words").alias("own_before"), "parent", "leaf", "rows")
    rows = with_values(told.select("conv_id", "depth", "before", "rep"), facts, "conv_id")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") > F.col("own"), F.col("conv_id")).otherwise(F.col("parent"))
    nodes = rows.groupBy(F.col("rep").alias("node"), "depth").agg(
        F.max(F.when(mine, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        one((F.col("own") <= F.col("depth") + 1) & (F.col("depth") < F.col("len"))).alias("n_children"), one(F.col("leaf")).alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("own"), F.col("own_before") - F.col("before")).otherwise(0)).alias("saved_tokens"),
    ).withColumnRenamed("node", "conv_id")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return nodes.join(_ends(conv), ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
