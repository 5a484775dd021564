"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of word shingles. Two sets with |A ∩ B| >= s |A ∪ B| differ in at most
(1 - s) / (1 + s) x (|A| + |B|) elements. Sets are put into bands of sizes; for a band whose largest set has r
elements the difference k is bounded, the feature domain is hashed into a little over k partitions, and by the
pigeonhole principle similar sets agree on one partition entirely. A signature is (band, partition,
what the set has there); a set also signs for the next band if a partner can be that large. This is
PartEnum with one element of the enumeration a first-level partition, the cheapest choice for wide k.

Sets that share a signature are not paired within their group. Each is compared with one hub (the
least key of a group, of all its groups the least), and the links found make components. Then groups that still hold sets of
different components are taken up again, and only pairs across components are looked at, so no link
that could join two components is missed, and a group of near copies costs one comparison for each
member. Every set carries a parity sketch (one bit flipped for each element): the bits in which two
sketches differ never exceed the sets' difference, so most pairs fall without their sets. What is
left is compared exactly, on the sets.

Equal sets are one node (its key is a hash of the set), so copies cost nothing. Signatures travel
packed by bucket, one hub for each signature and chunk of texts; large groups are cut into blocks.

Defined results: a null or empty text, or one without words, is the empty set and linked with
nothing, not even with another empty one. With fewer words than ``WORDS`` the whole sequence is the
one shingle. Rows with a null id take part, but a component's id is the smallest id that is not null
(null if it has none). Repeated rows get the same result each. An empty table gives no rows. Only
the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.anchors import BASES, BYTE, SPACE, Hasher, Rule, chunks, scrambled
from tallyhouse.llm.common import cut, small_batches, stored, tidy, whole
from tallyhouse.llm.mixing import with_dimension

#: words of a shingle; similarity in percent
WORDS, PERCENT = 5, 80
CHUNK = 1_000_000
#: sizes of a band's sets differ by up to this factor
BAND = 2.0
#: signatures in a bucket, about
BUCKET = 500_000
#: members of a hub whose sets are compared in one task; members of a block of a group
MEMBERS, BLOCK = 256, 4096
#: 64-bit numbers of the smallest parity sketch
SKETCH = 16
#: so many pairs or fewer are broadcast to the texts
PICK = 500_000

U = np.uint64
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]


def sets_of(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts, sorted and distinct within each, and where each text's begin."""
    sizes = np.array([len(t) + 1 for t in texts])
    first = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~SPACE[raw], [False]))))
    starts, ends = edge[::2], edge[1::2]
    values = Hasher(LOWER[raw], BASES[0]).of(starts, ends) + (ends - starts).astype(U)
    begin = np.searchsorted(starts, first)
    hashes, n = Hasher(values, BASES[1]), np.diff(begin)
    row = np.repeat(np.arange(len(texts)), n)
    full = hashes.all(words)
    own = np.flatnonzero(row[:len(full)] == row[words - 1:]) if len(full) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < words))
    shingle = np.concatenate([full[own], scrambled(hashes.of(begin[short], begin[short + 1]) + n[short].astype(U))])
    row = np.concatenate([row[own], short])
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    keep = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
    shingle, row = shingle[keep], row[keep]
    return shingle, np.searchsorted(row, np.arange(len(texts) + 1))


def keys_of(shingle: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; 0 for the empty one."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(scrambled(shingle + U(0x9E3779B97F4A7C15)), dtype=U)))
    n = np.diff(begin)
    return np.where(n > 0, scrambled(total[begin[1:]] - total[begin[:-1]] + n.astype(U)), U(0)).view(np.int64)


def bands(percent: int, largest: int, factor: float = BAND) -> list[tuple[int, int, int]]:
    """(smallest, largest size, partitions) of each band up to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * factor))
        # a few partitions more than the widest difference needs, so that few sets lack full ones
        k = difference(high, high, percent)
        out.append((low, high, k + 1 + (k + 19) // 20))
        low = high + 1
    return out


def difference(a, b, percent: int):
    """Largest |A △ B| of similar sets with a and b elements: 100 (a + b - x) / 2 >= percent (a + b + x) / 2."""
    return (a + b) * (100 - percent) // (100 + percent)


def signatures(shingle: np.ndarray, begin: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the set of each.

    A set that differs from a partner in at most k elements signs with its first k + 1 partitions that are not
    empty: one of them is the same in the partner, and among those that the partner signs with, whichever of the
    two stops first. A set with fewer full partitions signs with all, empty ones too.
    """
    n = np.diff(begin)
    table = bands(percent, int(n.max(initial=0)) * 100 // percent + 1)
    lows, highs, parts = (np.array(x) for x in zip(*table)) if table else (np.zeros(0, int),) * 3
    own = np.searchsorted(highs, n)
    # a partner may have up to 100 / percent times as many shingles
    most = n * 100 // percent
    above = np.searchsorted(highs, most)
    sig, who = [], []

    def mark(band: np.ndarray, part: np.ndarray, content: np.ndarray) -> np.ndarray:
        return scrambled(content + scrambled((band.astype(U) << U(40)) + part.astype(U) + U(1)))

    for shift in range(int((above - own).max(initial=0)) + 1):
        sets = np.flatnonzero((n > 0) & (own + shift <= above))
        if not len(sets):
            continue
        band, size = own[sets] + shift, n[sets]
        k = difference(size, np.minimum(most[sets], highs[band]), percent)
        ends = np.cumsum(size)
        local = np.repeat(np.arange(len(sets)), size)
        x = shingle[np.arange(size.sum()) + np.repeat(begin[sets] - (ends - size), size)]
        # the partition is the high half of the hash times their number: shingles are sorted, so partitions are runs
        part = (((x >> U(32)) * parts[band][local].astype(U)) >> U(32)).astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (local[1:] != local[:-1]))))
        total = np.concatenate((np.zeros(1, U), np.cumsum(scrambled(x), dtype=U)))
        content = total[np.append(head[1:], len(x))] - total[head]
        mine, index = local[head], part[head]
        first = np.searchsorted(mine, np.arange(len(sets) + 1))
        full = np.diff(first)
        sparse = full <= k
        take = (np.arange(len(head)) - first[mine] <= k[mine]) | sparse[mine]
        sig.append(mark(band[mine[take]], index[take], content[take]))
        who.append(sets[mine[take]])
        for s in np.flatnonzero(sparse):
            empty = np.setdiff1d(np.arange(parts[band[s]]), index[first[s]:first[s + 1]])
            sig.append(mark(np.full(len(empty), band[s]), empty, np.zeros(len(empty), U)))
            who.append(np.full(len(empty), sets[s]))
    return (np.concatenate(sig), np.concatenate(who)) if sig else (np.zeros(0, U), np.zeros(0, np.int64))


def sketches(shingle: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of all sets in a row, and the 64-bit numbers of each.

    Element h flips bit h mod m; m is the least power of two that is 1024 or more and twice the set's size or more,
    so the sketches of two sets of similar size have equal lengths or one is twice the other and can be folded.
    """
    n = np.diff(begin)
    words = np.left_shift(np.int64(SKETCH), np.maximum(np.ceil(np.log2(np.maximum(2 * n, 1) / (64 * SKETCH))), 0).astype(np.int64))
    ends = np.cumsum(words)
    local = np.repeat(np.arange(len(n)), n)
    cell = (ends - words)[local] * 64 + (shingle & (words[local] * 64 - 1).astype(U)).astype(np.int64)
    flips = (np.bincount(cell, minlength=int(words.sum()) * 64) & 1).astype(np.uint8)
    return np.packbits(flips, bitorder="little").view(np.int64), words


def fold(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def _light(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches, Rule(True, words, words, CHUNK), 1):
        shingle, begin = sets_of(texts, words)
        bits, words_of = sketches(shingle, begin)
        sketch = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(words_of))).astype(np.int32)), pa.array(bits))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(begin)), pa.array(keys_of(shingle, begin)), sketch], ["doc_id", "text_key", "n_shingles", "key", "sketch"])


def _starts(value: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)


def _sign(words: int, percent: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> signatures and keys, packed by bucket of the signature; and, not packed, all but one member of a group of this chunk."""
    for _, texts in chunks(batches, Rule(True, words, words, CHUNK), 0):
        shingle, begin = sets_of(texts, words)
        key, n = keys_of(shingle, begin), np.diff(begin)
        _, one = np.unique(key, return_index=True)
        chosen = one[n[one] > 0]
        if not len(chosen):
            continue
        at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in chosen])
        sig, who = signatures(shingle[at], np.concatenate(([0], np.cumsum(n[chosen]))), percent)
        k = key[chosen][who]
        order = np.lexsort((k, sig))
        sig, k = sig[order].view(np.int64), k[order]
        head = np.zeros(len(sig), bool)
        head[_starts(sig)] = True
        hub = k[np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))]
        for kind, mine, columns in ((0, head, (sig, k)), (1, ~head, (sig, hub, k))):
            data = np.stack([c[mine] for c in columns], axis=1)
            bucket = (data[:, 0].view(U) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            data, bucket = data[order], bucket[order]
            start = _starts(bucket)
            end = np.append(start[1:], len(bucket))
            if len(start):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array([kind] * len(start), pa.int32()), pa.array([data[a:b].tobytes() for a, b in zip(start, end)], pa.binary())],
                                                 ["bucket", "kind", "packed"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed signatures sorted by bucket -> (sig, hub, key) of each member of a group other than its hub."""
    held: tuple[list[bytes], list[bytes]] = ([], [])
    now = None

    def done() -> Iterator[pa.RecordBatch]:
        one, more = (np.frombuffer(b"".join(h), np.int64).reshape(-1, w) for h, w in zip(held, (2, 3)))
        # members known to a chunk share a signature with one that went to the bucket, so they are in its group
        sig, key = np.concatenate([one[:, 0], more[:, 0]]), np.concatenate([one[:, 1], more[:, 2]])
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        start = _starts(sig)
        hub = np.repeat(key[start], np.diff(np.append(start, len(sig))))
        new = (hub != key) & np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
        rows = [x[new] for x in (sig, hub, key)]
        for i in range(0, len(rows[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 100_000]) for x in rows], ["sig", "hub", "key"])

    for batch in batches:
        for b, kind, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if b != now:
                if now is not None:
                    yield from done()
                held, now = ([], []), b
            held[kind].append(packed.as_py())
    if now is not None:
        yield from done()


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, key) whose sizes and sketches allow a link."""
    side = lambda p: nodes.select(F.col("key").alias(f"{p}_k"), F.col("n").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_s"))
    both = pairs.join(side("a"), F.col("hub") == F.col("a_k")).join(side("b"), F.col("key") == F.col("b_k"))
    half = lambda x, m: F.transform(F.sequence(F.lit(1), m), lambda i: F.element_at(x, i).bitwiseXOR(F.element_at(x, i + m)))
    folded = lambda x, y: F.when(F.size(x) == 2 * F.size(y), half(F.col(x), F.size(y))).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(folded("a_s", "b_s"), folded("b_s", "a_s"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.floor((F.col("a_n") + F.col("b_n")) * (100 - percent) / (100 + percent))
    return both.where(_similar_sizes(F.col("a_n"), F.col("b_n"), percent)).where(apart <= most).select("hub", "key")


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts that have the key they were picked for; another text under the same id and hash falls."""
    for part, texts in chunks(batches, Rule(True, words, words, CHUNK), 0):
        shingle, begin = sets_of(texts, words)
        own = np.flatnonzero(keys_of(shingle, begin) == part.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([*part.take(pa.array(own)).columns[2:], pa.array([shingle[begin[i]:begin[i + 1]].tobytes() for i in own], pa.binary())], ["hub", "part", "member", "elements"])


def _verify(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets sorted by hub and part, each part led by the hub's own (key null) -> links (hub, key)."""
    hub, mine = None, np.zeros(0, U)
    for batch in batches:
        out: list[list[int]] = [[], []]
        for h, k, elements in zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), batch.column("elements")):
            other = np.frombuffer(elements.as_py(), U)
            if k is None:
                hub, mine = h, other
            elif h == hub:
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    out[0].append(h)
                    out[1].append(k)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["hub", "key"])


def _links(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs whose sets are similar, compared on the sets. A set is made from the text of its node's head, found by id and hash, not of every copy."""
    pairs = cut(pairs)
    # members of a hub fall into parts by hash, so that a hub with very many is not one task's
    few = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    member = pairs.join(few, "hub").select("key", "hub", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.col("key").alias("member"))
    hub = few.select(F.col("hub").alias("key"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("member"))
    head = nodes.select("key", F.col("head.id").alias("head_id"), F.col("head.text").alias("head_key"))
    route = cut(member.unionByName(hub).join(head, "key"))
    count = route.count()
    here = (F.col("text_key") == F.col("head_key")) & F.col("doc_id").eqNullSafe(F.col("head_id"))
    routed = rows.join(F.broadcast(route) if count <= PICK else route, here).select("text", "key", "hub", "part", "member")
    sets = routed.mapInArrow(lambda b: tidy(_sets(words, b)), "hub bigint, part int, member bigint, elements binary")
    dealt = sets.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first())
    return cut(dealt.mapInArrow(lambda b: tidy(_verify(percent, b)), "hub bigint, key bigint").distinct())


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in a link, root the least key that it can reach; halves paths each turn."""
    both = cut(links.select(F.col("hub").alias("a"), F.col("key").alias("b")).union(links.select("key", "hub")).distinct())
    root = cut(both.groupBy(F.col("a").alias("key")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        # the least root among neighbours, then the root of that root
        near = both.join(root.select(F.col("key").alias("b"), "root"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        step = root.join(near, "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("to"))
        up = step.join(root.select(F.col("key").alias("to"), F.col("root").alias("beyond")), "to", "left")
        new = cut(up.select("key", "old", F.coalesce(F.least("to", "beyond"), "to").alias("root")))
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return root
        root = new.select("key", "root")


def _across(percent: int, batches: Iterator[pa.RecordBatch], tree: bool = False, names: tuple[str, ...] = ("hub", "key")) -> Iterator[pa.RecordBatch]:
    """Members of groups, sorted by group and block pair -> pairs across components whose sizes and sketches allow a link.

    With ``tree`` only pairs that would join what the group's earlier pairs have not joined, the nearest by sketch first:
    fewer than there are components, however many members could be paired. Of the columns ``names``, ``sig`` is the group and
    ``rest`` tells whether ``tree`` has left out any of its pairs.
    """
    held: list[pa.RecordBatch] = []
    now = None

    def done() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        key, root, n, block, one = (t.column(c).to_numpy() for c in ("key", "root", "n", "block", "i"))
        sketch = t.column("sketch").combine_chunks()
        within = t.column("j")[0].as_py() == one[0]
        order = np.argsort(n, kind="stable")
        key, root, n, block, sketch = key[order], root[order], n[order], block[order], sketch.take(pa.array(order))
        width = np.asarray(sketch.value_lengths())
        # by length of sketch; sizes ascend, so each length is one stretch of rows
        flat, ends = sketch.flatten().to_numpy().view(U), np.cumsum(width)
        first = {int(w): int(np.searchsorted(width, w)) for w in np.unique(width)}
        table = {w: flat[ends[f] - w:ends[np.searchsorted(width, w, side="right") - 1]].reshape(-1, w) for w, f in first.items()}
        half = {w // 2: fold(x) for w, x in table.items() if w // 2 in table}
        reach = np.searchsorted(n, n * 100 // percent, side="right")
        found, rest = [], False
        # components of the group; those that a pair may join become one
        before = np.unique(root, return_inverse=True)[1]
        root = before.copy()
        for a in range(len(key)):
            b = np.arange(a + 1, reach[a])
            # as long as none is known to be left out, pairs of components already joined are looked at too
            of = before if rests and not rest else root
            b = b[(of[b] != of[a]) & (within | (block[b] != block[a]))]
            if len(b):
                w = int(width[a])
                mine, same = table[w][a - first[w]], b[width[b] == w]
                bits = [np.bitwise_count(table[w][same - first[w]] ^ mine).sum(axis=1)]
                if len(same) < len(b):
                    bits.append(np.bitwise_count(half[w][b[len(same):] - first[2 * w]] ^ mine).sum(axis=1))
                apart = np.concatenate(bits)
                near = apart <= difference(n[a] + n[b], 0, percent)
                b = b[near]
                if tree and len(b):
                    new, every = root[b] != root[a], len(b)
                    b = b[new][np.lexsort((key[b[new]], apart[near][new]))]
                    b = b[np.sort(np.unique(root[b], return_index=True)[1])]
                    rest = rest or len(b) < every
                    root[np.isin(root, root[b])] = root[a]
                if len(b):
                    found.append(np.stack([np.minimum(key[a], key[b]), np.maximum(key[a], key[b])], axis=1))
        if found:
            pair = np.unique(np.concatenate(found), axis=0)
            columns = {"hub": pair[:, 0].copy(), "key": pair[:, 1].copy(), "sig": np.full(len(pair), now[0]), "rest": np.full(len(pair), rest)}
            yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], list(names))

    rests = tree and "rest" in names
    for batch in batches:
        group = np.stack([batch.column(c).to_numpy() for c in ("sig", "i", "j")], axis=1)
        edges = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1 if len(group) else []
        for a, b in zip([0, *edges], [*edges, len(group)]):
            if a == b:
                continue
            if now is not None and tuple(group[a]) != now:
                yield from done()
                held = []
            now = tuple(group[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from done()


def _pairs_across(met: DataFrame, root: DataFrame, nodes: DataFrame, percent: int, tree: bool = False) -> DataFrame:
    """Pairs of different components that share a group and may be linked; with ``tree`` no more of a group than would join all its
    components, each with its group and whether that has other pairs."""
    member = met.select("sig", "key").union(met.select("sig", F.col("hub").alias("key")).distinct())
    placed = member.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("c")).where(F.col("low") < F.col("high"))
    mixed = mixed.select("sig", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    full = placed.join(mixed, "sig").join(nodes.select("key", "n", "sketch"), "key")
    # a large group is cut into blocks, and every pair of blocks meets
    blocked = full.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = blocked.select("sig", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "key", "root", "n", "sketch")
    dealt = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    if tree:
        return dealt.mapInArrow(lambda b: tidy(_across(percent, b, True, ("sig", "hub", "key", "rest"))), "sig bigint, hub bigint, key bigint, rest boolean")
    return dealt.mapInArrow(lambda b: tidy(_across(percent, b)), "hub bigint, key bigint").distinct()


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, first, n_links_checked) of every document.

    ``text_key`` is the hash of the text as it is, which tells texts of one id apart. ``first`` marks the document that stands
    for its component: the smallest id (a null id comes last), of one id's texts the smallest key; an empty set stands for itself.
    ``n_links_checked`` counts the links of the document's set that were looked at and hold; there may be more.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"), F.xxhash64(whole(text_col)).alias("text_key"))
    light = cut(rows.mapInArrow(lambda b: tidy(_light(words, b)), "doc_id bigint, text_key bigint, n_shingles bigint, key bigint, sketch array<bigint>"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))
    nodes = cut(light.where("n_shingles > 0").groupBy("key").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.min(order).alias("head"), F.count(F.lit(1)).alias("copies")))
    links, root = _linked(rows, nodes, words, percent)
    own = nodes.join(root, "key", "left").select("key", "least", "head", "copies", F.coalesce("root", "key").alias("root"))
    ids = own.groupBy("root").agg(F.min("least").alias("component_id"), F.min("head").alias("chief"))
    count = links.select("key").union(links.select("hub")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links_checked"))
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("c")).first()
    answer = cut(own.join(ids, "root").join(count, "key", "left").select("key", "component_id", "chief", F.coalesce("n_links_checked", F.lit(0)).alias("n_links_checked"), (F.col("copies") / F.lit(float(total.c or 1))).alias("share")))
    full = with_dimension(light.where("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "key"), answer, "key", total.n)
    first = F.col("doc_id").eqNullSafe(F.col("chief.id")) & (F.col("text_key") == F.col("chief.text"))
    empty = light.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"), F.lit(0).cast("bigint").alias("n_links_checked"))
    return full.select("doc_id", "text_key", "n_shingles", "component_id", first.alias("first"), "n_links_checked").unionByName(empty)


def _linked(rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified links, and the root of every key in one."""
    # about a third of a set's size is the number of its signatures
    buckets = max(64, int((nodes.agg(F.sum("n")).first()[0] or 0) / 3 / BUCKET))
    packed = rows.select("text").mapInArrow(lambda b: tidy(_sign(words, percent, buckets, b)), "bucket bigint, kind int, packed binary")
    met = stored(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: tidy(_meet(b)), "sig bigint, hub bigint, key bigint"))
    # one comparison for each set; what it does not settle is left to the second round
    stars = _may_link(met.select("hub", "key").distinct(), nodes, percent).groupBy("key").agg(F.min("hub").alias("hub")).select("hub", "key")
    stars = _links(stars, rows, nodes, words, percent)
    root = components(stars)
    # a few pairs join most components that similar sets have been left in; the last round then looks at every pair across those that
    # stay apart, in the groups where pairs were left out: of all others each pair that sizes and sketches allow has been compared
    few = cut(_pairs_across(met, root, nodes, percent, tree=True))
    trees = stars.unionByName(_links(few.select("hub", "key").distinct(), rows, nodes, words, percent))
    left = met.join(few.where("rest").select("sig").distinct(), "sig", "left_semi")
    more = _links(_pairs_across(left, components(trees), nodes, percent), rows, nodes, words, percent)
    links = cut(trees.unionByName(more).distinct())
    return links, components(links)
