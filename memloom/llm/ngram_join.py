"""Exact Jaccard join of shingle sets, with components of the links.

Shingle size and similarity come as a ``Likeness``.

1. Each text becomes its set of shingles of ``size`` words (64-bit hashes). Sets that differ
   by at most D shingles agree on one of D + 1 ranges of hash values at least; so each set
   sends, for its size class, a signature of what it holds in each range. Texts that
   never share a signature can't link. Shingles found common in a sample are left out of
   signatures, so that shared passages don't tie texts; no link is lost by that.
2. Texts with a signature in common are tied to the first of them (no pairs are
   made), and the ties' components are families: every link lies inside one. Passages that
   many texts share can tie very many; a family of more than one block is split again by
   its rarest shingles: sets that link share one of their first n - ceil(similarity * n) + 1.
3. A family's sets meet in blocks of bounded size. A block's sets form a prefix
   tree in one global order; a set walks the tree once, shared prefixes share their
   partial overlap, and subtrees whose remaining lengths can't reach the bound are
   left out. Sets of different blocks are compared as far as their blocks' links
   leave them apart.
4. The components of the links found are the result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_rows, written
from .components import Forest, components, pointers


class Likeness(NamedTuple):
    """Words in a shingle; two sets link when num * |union| <= den * |intersection|.

    Size classes are 4/3 apart at least, so a similarity of at least 3/4 leaves partners in the next class at most.
    """

    size: int
    num: int
    den: int

    def checked(self) -> Likeness:
        if self.size < 1 or not 3 * self.den <= 4 * self.num <= 4 * self.den:
            raise ValueError(f"shingles of a word at least and a similarity from 3/4 to 1, not {self}")
        return self


#: The join's own contract (op6), and what near-duplicate stages take unless a contract says otherwise.
JOIN, NEAR = Likeness(4, 85, 100), Likeness(5, 80, 100)
#: Common shingles, which signatures leave out: in so many of the sampled texts; most that are sent to the executors.
SAMPLE, COMMON_IN, COMMON_MOST = 8_000, 3, 1 << 19
#: Sets in a block of a family.
BLOCK = 512
#: Shingles in a block, for families of long texts.
BLOCK_SHINGLES = 1 << 20

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, size: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text (Arrow strings without nulls).

    Words are what stands between ASCII white space, A-Z as lower case. A text of fewer than
    ``size`` words has its whole sequence as its one shingle; one without words has none.
    """
    import pyarrow.compute as pc
    import xxhash

    from .tokenizing import word_codes

    words, codes, at = word_codes(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)
    empty = np.array([not w for w in words.to_pylist()], bool)
    sets = []
    for i in range(len(texts)):
        mine = codes[at[i] : at[i + 1]]
        if len(mine) and empty.any():
            mine = mine[~empty[mine]]
        h = hashes[mine]
        if not len(h):
            sets.append(h)
            continue
        n = max(1, len(h) - size + 1)
        made = np.full(n, min(len(h), size), np.uint64)
        for k in range(min(size, len(h))):
            made = mix(made * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        made.sort()
        keep = np.ones(n, bool)
        keep[1:] = made[1:] != made[:-1]
        sets.append(made[keep])
    return sets


def most_apart(a: int, b: int, like: Likeness) -> int:
    """The largest symmetric difference that linked sets of these sizes can have."""
    # overlap o >= num/den * union and a + b = union + o, so the difference is at most this share.
    return (like.den - like.num) * (a + b) // (like.den + like.num)


#: Size classes: class c holds sets of 1.5 ** c <= size < 1.5 ** (c + 1), as whole numbers.
_BOUNDS = np.unique(np.ceil(1.5 ** np.arange(0, 80)).astype(np.int64))


def _agreeing(made: np.ndarray, c: int, slack: int, salt: int, like: Likeness) -> tuple[np.ndarray, np.ndarray, int]:
    """(key of what each range holds, whether it holds anything, how many ranges linked sets agree on at least)."""
    largest = int(_BOUNDS[c + 1]) - 1
    apart = most_apart(largest, largest, like)
    m = apart + 1 + apart // slack
    edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(made ^ np.uint64(0x5BD1E995)), dtype=np.uint64)))
    cut = np.concatenate(([0], np.searchsorted(made, edges), [len(made)]))
    key = np.arange(m).astype(np.uint64) + np.uint64(c) * np.uint64(0x100000001B3) + np.uint64(salt << 60)
    return mix((total[cut[1:]] - total[cut[:-1]]) ^ mix(key)), np.diff(cut) > 0, m - apart


def signatures(made: np.ndarray, common: np.ndarray, like: Likeness = JOIN) -> np.ndarray:
    """64-bit signatures of a set: two sets that link share one, unless they are equal.

    A set belongs to its size class, and to the next if a partner can be that large. For a class
    the hash range is cut into more parts than linked sets in it can differ by, so they agree on
    some, also once the same ``common`` shingles (sorted; any will do) are taken out of both. A
    part that is empty in both agrees and says nothing: a set that has fewer empty parts than must
    agree sends the others only; a set with more sends also the parts of its whole self, and the
    empty ones of these if they too are that many. Of two such sets both do.
    """
    n = len(made)
    own = int(np.searchsorted(_BOUNDS, n, "right")) - 1
    if len(common):
        at = np.minimum(np.searchsorted(common, made), len(common) - 1)
        rare = made[common[at] != made]
    else:
        rare = made
    out = [np.zeros(0, np.uint64)]
    for c in [own] + [own + 1] * int(n * like.den >= _BOUNDS[own + 1] * like.num):
        if most_apart(int(_BOUNDS[c + 1]) - 1, int(_BOUNDS[c + 1]) - 1, like) == 0:
            continue  # only equal sets link
        key, filled, agree = _agreeing(rare, c, 8, 1, like)
        out.append(key[filled])
        if (~filled).sum() >= agree:
            key, filled, agree = _agreeing(made, c, 16, 2, like)
            out.append(key if (~filled).sum() >= agree else key[filled])
    return np.concatenate(out)


def _digest(made: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(made.tobytes(), digest_size=16).digest()


def _profiles(batches, size: int):
    """(id, number of shingles, digest of the set) of each row."""
    import pyarrow as pa

    for batch in slices(batches):
        sets = shingle_sets(batch.column(1), size)
        n = pa.array([len(s) for s in sets], pa.int64())
        digest = pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())
        yield pa.record_batch([batch.column(0), n, digest], ["id", "n_shingles", "digest"])


def _sampled_shingles(batches, size: int):
    """(shingle, number of texts of a slice that have it)."""
    import pyarrow as pa

    for batch in slices(batches):
        made = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column(0), size)])
        shingle, n = np.unique(made, return_counts=True)
        yield pa.record_batch([pa.array(shingle.view(np.int64)), pa.array(n)], ["shingle", "n"])


def common_shingles(texts: DataFrame, profiles: DataFrame, size: int) -> np.ndarray:
    """Shingles of at least COMMON_IN of some SAMPLE texts, sorted; at most COMMON_MOST.

    They only steer which texts are compared: with any set of them every link is found.
    """
    share = SAMPLE / max(1, profiles.count())
    some = texts.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_003)) < F.lit(min(1.0, share) * 1_000_003))
    sampled = some.select("text").mapInArrow(lambda b: _sampled_shingles(b, size), "shingle long, n long")
    counts = sampled.groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= COMMON_IN).orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).toArrow()
    return np.sort(top["shingle"].to_numpy().view(np.uint64))


def _signature_rows(common: Broadcast, like: Likeness):
    return lambda batches: _signed(batches, common.value, like)


def _signed(batches, common: np.ndarray, like: Likeness):
    """Rows (key, id, first): a signature and the first text of a slice that has it, or a tie.

    Equal sets of a task send one set of signatures. Texts of a slice that share a signature are tied
    to the first of them here (``first`` is set), so a signature goes on once from each slice.
    """
    import pyarrow as pa

    met: set[bytes] = set()
    for batch in slices(batches, 2 << 20):
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, made in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), like.size), strict=True):
            if i is None or not len(made) or (d := _digest(made)) in met:
                continue
            met.add(d)
            sigs = signatures(made, common, like)
            keys.append(sigs)
            ids.append(np.full(len(sigs), i, np.int64))
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else doc
        tie = np.unique(np.stack([doc, first], 1)[doc != first], axis=0)
        column = lambda x, y: pa.array(np.concatenate((x, y)))
        firsts = pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), pa.array(tie[:, 1])])
        made = pa.record_batch([column(key[new].view(np.int64), tie[:, 0]), column(doc[new], tie[:, 0]), firsts], ["key", "id", "first"])
        for i in range(0, made.num_rows, 50_000):
            yield made.slice(i, 50_000)


def _ties(batches):
    """Ties of a sorted partition: each run of one signature to its first text, and those made before."""
    import pyarrow as pa

    last_key, last_first = None, 0
    for batch in batches:
        old = batch.filter(batch.column("first").is_valid())
        rows = batch.filter(batch.column("first").is_null())
        pairs = [np.stack([old.column("id").to_numpy(), old.column("first").to_numpy(zero_copy_only=False)], 1)]
        key, doc = rows.column("key").to_numpy(), rows.column("id").to_numpy()
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last_key is None or key[0] != last_key
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(start >= 0, doc[start], last_first)
            pairs.append(np.stack([doc, first], 1)[doc != first])
            last_key, last_first = key[-1], first[-1]
        tie = np.unique(np.concatenate(pairs), axis=0).astype(np.int64)
        yield pa.record_batch([pa.array(tie[:, 0]), pa.array(tie[:, 1])], ["a", "b"])


def _within(size_a: int, size_b: np.ndarray, overlap: np.ndarray, like: Likeness) -> np.ndarray:
    return like.den * overlap >= like.num * (size_a + size_b - overlap)


class PrefixTree:
    """Sets in one global order (frequent shingles first, so prefixes are shared), as a compressed trie.

    Nodes are runs of shingles, in depth-first order. ``lo`` and ``hi`` are the sizes of the smallest
    and largest set below a node.
    """

    def __init__(self, sets: list[np.ndarray], like: Likeness = JOIN):
        self.like = like
        sizes = np.array([len(s) for s in sets])
        tokens, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        count = np.bincount(ranks)
        order = np.empty(len(tokens), np.int64)
        order[np.lexsort((np.arange(len(tokens)), -count))] = np.arange(len(tokens))
        parts = [np.sort(x) for x in np.split(order[ranks], np.cumsum(sizes)[:-1])]
        self.tokens, self.order, self.sizes = tokens, order, sizes
        by = sorted(range(len(parts)), key=lambda i: parts[i].tolist())
        run, parent, lo, hi, depth, leaf = [], [], [], [], [], np.zeros(len(parts), np.int64)
        stack: list[tuple[int, int]] = []  # (node, length of the path to its end)
        before = np.zeros(0, np.int64)
        for i in by:
            mine = parts[i]
            k = min(len(before), len(mine))
            differ = np.flatnonzero(before[:k] != mine[:k])
            shared = int(differ[0]) if len(differ) else k
            while stack and stack[-1][1] - len(run[stack[-1][0]]) >= shared and stack[-1][1] > shared:
                stack.pop()
            if stack and stack[-1][1] > shared:  # cut the node where the paths part
                node, end = stack.pop()
                head = len(run[node]) - (end - shared)
                run.append(run[node][head:])
                parent.append(node)
                for child in range(node + 1, len(run) - 1):
                    if parent[child] == node:
                        parent[child] = len(run) - 1
                leaf[leaf == node] = len(run) - 1
                run[node] = run[node][:head]
                stack.append((node, shared))
            if len(mine) > shared or not stack:
                run.append(mine[shared:])
                parent.append(stack[-1][0] if stack else -1)
                stack.append((len(run) - 1, len(mine)))
            leaf[i] = stack[-1][0]
            before = mine
        self.run_at = np.concatenate(([0], np.cumsum([len(r) for r in run])))
        self.run = np.concatenate(run)
        self.parent, self.leaf = np.array(parent), leaf
        level = np.full(len(run), -1)
        todo, d = np.flatnonzero(self.parent < 0), 0
        self.levels = []
        while len(todo):
            level[todo] = d
            self.levels.append(todo)
            inner = np.isin(self.parent, todo)
            todo, d = np.flatnonzero(inner), d + 1
        self.lo, self.hi = np.full(len(run), np.iinfo(np.int64).max), np.zeros(len(run), np.int64)
        np.minimum.at(self.lo, leaf, sizes)
        np.maximum.at(self.hi, leaf, sizes)
        for nodes in reversed(self.levels[1:]):
            np.minimum.at(self.lo, self.parent[nodes], self.lo[nodes])
            np.maximum.at(self.hi, self.parent[nodes], self.hi[nodes])
        self.depth = np.zeros(len(run), np.int64)
        for nodes in self.levels:
            up = self.parent[nodes]
            self.depth[nodes] = np.where(up >= 0, self.depth[up], 0) + np.diff(self.run_at)[nodes]

    def matches(self, made: np.ndarray) -> np.ndarray:
        """Indices of the sets that link with this one; level by level, whole subtrees are pruned."""
        n = len(made)
        at = np.searchsorted(self.tokens, made)
        known = at < len(self.tokens)
        known[known] = self.tokens[at[known]] == made[known]
        mine = np.zeros(len(self.tokens), bool)
        mine[self.order[at[known]]] = True
        overlap = np.zeros(len(self.parent), np.int64)
        alive = np.zeros(len(self.parent), bool)
        seen = np.concatenate(([0], np.cumsum(mine[self.run])))
        # The query's shingles up to a node's last token are spent: what is left bounds the overlap below.
        spent = np.cumsum(mine)
        whole = int(spent[-1]) if len(spent) else 0
        for d, nodes in enumerate(self.levels):
            if d:
                nodes = nodes[alive[self.parent[nodes]]]
            if not len(nodes):
                break
            up = self.parent[nodes]
            got = seen[self.run_at[nodes + 1]] - seen[self.run_at[nodes]] + np.where(up >= 0, overlap[up], 0)
            overlap[nodes] = got
            last = self.run[np.maximum(self.run_at[nodes + 1] - 1, 0)]
            best = got + np.minimum(self.hi[nodes] - self.depth[nodes], whole - spent[last])
            # Sizes from lo to hi lie below; the bound is weakest for the smallest that can hold `best`.
            alive[nodes] = _within(n, np.maximum(self.lo[nodes], best), best, self.like)
        good = alive[self.leaf] & _within(n, self.sizes, overlap[self.leaf], self.like)
        return np.flatnonzero(good)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.left = n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.left -= 1
        return a != b


def link_block(sets: list[np.ndarray], like: Likeness, asked: list[bool] | None = None, known: list | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the links among these sets.

    With ``asked``, only pairs with such a set count; sets of one ``known`` component need no more
    links. Once all are in one component the block is done.
    """
    links: list[tuple[int, int]] = []
    if len(sets) < 2:
        return links
    union, first = _Union(len(sets)), {}
    for i, k in enumerate(known or []):
        union.join(first.setdefault(k, i), i)
    if union.left == 1:
        return links
    tree = PrefixTree(sets, like)
    for i, made in enumerate(sets):
        if union.left == 1:
            break
        if asked is None or asked[i]:
            links += [(i, int(j)) for j in tree.matches(made) if union.join(i, int(j))]
    return links


def _link_rows(batches, like: Likeness):
    """Links of the blocks of a partition, whose rows are sorted by block; pivots and asked sets first.

    A block's links come as stars, each text with the least of its component in the block.
    """
    import pyarrow as pa

    def close(held):
        sets, ids = shingle_sets(pa.array([r[1] for r in held], pa.string()), like.size), [r[0] for r in held]
        asked = [r[2] for r in held] if any(r[2] for r in held) else None
        known = [r[3] for r in held] if asked else None
        links = link_block(sets, like, asked, known)
        forest.add(np.array([ids[i] for i, _ in links], np.int64), np.array([ids[j] for _, j in links], np.int64))

    forest, now, held = Forest(), None, []
    for batch in slices(batches):
        for *block, i, text, asked, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                close(held)
                now, held = block, []
            held.append((i, text, asked, known))
    close(held)
    yield pa.record_batch([pa.array(x) for x in forest.stars()], ["a", "b"])


def _blocks_linked(rows: DataFrame, like: Likeness) -> DataFrame:
    """``family, i, j, id, text, asked, known`` to links; each (family, i, j) is one block."""
    ordered = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", F.col("asked").desc(), "id")
    columns = ordered.select("family", "i", "j", "id", "text", "asked", "known")
    return columns.mapInArrow(lambda batches: _link_rows(batches, like), "a long, b long")


def _shingle_rows(batches, size: int):
    """(family, shingle, id, n) for each shingle of a text."""
    import pyarrow as pa

    for batch in slices(batches, 2 << 20):
        sets = shingle_sets(batch.column(2), size)
        sizes = np.array([len(x) for x in sets], np.int64)
        rows = [np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1)]
        shingle = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(x) for x in (rows[0], shingle, rows[1], np.repeat(sizes, sizes))], ["family", "shingle", "id", "n"])


def _split_by_rarest(members: DataFrame, like: Likeness) -> DataFrame:
    """(id, family) anew for the members ``family, id, text`` of families: by shared rarest shingles.

    A shingle of one text alone is rarer than all others, so only how many a text has counts. Texts
    that share none of their rarest have no link and are left out.
    """
    texts = members.select("family", "id", "text")
    rows = texts.mapInArrow(lambda batches: _shingle_rows(batches, like.size), "family long, shingle long, id long, n long")
    shared = written(rows.groupBy("family", "shingle").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    known = rows.join(shared, ["family", "shingle"])
    by_doc = Window.partitionBy("id")
    ranked = known.withColumns({"rank": F.row_number().over(by_doc.orderBy("df", "shingle")), "many": F.count("*").over(by_doc)})
    # Of n shingles, n - many are this text's own; overlap of at least ceil(similarity * n) is needed.
    first = ranked.where(F.col("rank") + F.col("n") - F.col("many") <= F.col("n") - F.ceil(F.col("n") * like.num / like.den) + 1)
    keys = first.select(F.xxhash64("family", "shingle").alias("key"), "id", F.lit(None).cast("long").alias("first"))
    return components(keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_ties, "a long, b long"), contract=False).select("id", F.col("component").alias("family"))


def _large(members: DataFrame) -> DataFrame:
    """(family, blocks) of the families that take more than one block.

    It is written, so that joins with it have two plain shuffles and a family of very many members can be split.
    """
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    return written(members.groupBy("family").agg(blocks.alias("blocks")).where("blocks > 1"), "large")


def _one_block(rows: DataFrame, like: Likeness) -> DataFrame:
    """Links of families of one block each, from ``family, id, text``."""
    return _blocks_linked(rows.select("family", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "text", F.lit(False).alias("asked"), F.col("id").alias("known")), like)


def _large_links(named: DataFrame, like: Likeness) -> DataFrame:
    """Links of families ``family, id, text, n`` that take several blocks: split by rarest shingles, then blocks."""
    again = _split_by_rarest(named, like)
    members = written(again.join(named.groupBy("id").agg(F.max("n").alias("n")), "id"), "members")
    members = members.join(_large(members), "family", "left")
    texts = named.select("id", "text")
    small = _one_block(texts.join(members.where("blocks is null"), "id"), like)
    split = written(members.where("blocks is not null").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "split")
    if split.isEmpty():
        return small
    pivots = split.where("id = family").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = split.where("id <> family").unionByName(pivots)
    inside = texts.join(placed, "id").select("family", "i", F.lit(0).alias("j"), "id", "text", F.lit(False).alias("asked"), F.col("id").alias("known"))
    links = written(_blocks_linked(inside, like), "links")

    # Blocks of one family whose links leave them apart: all outside its largest component meet every block.
    label = split.join(pointers(links).withColumnRenamed("component", "known"), "id", "left").withColumn("known", F.coalesce("known", "id"))
    label = written(label, "labels")
    parts = label.groupBy("family", "known").agg(F.count("*").alias("n"))
    main = parts.groupBy("family").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.max("n").alias("most"))
    # Those outside number n - most, and meet in so many groups.
    main = written(main.where("parts > 1").select("family", "main", F.ceil((F.col("n") - F.col("most")) / F.lit(BLOCK)).cast("int").alias("groups")), "main")
    apart = label.join(main, "family").withColumns({"outside": F.col("known") != F.col("main"), "g": F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int")})
    asked = apart.where("outside").withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "j": F.col("g"), "asked": F.lit(True)})
    others = apart.withColumns({"j": F.explode(F.sequence(F.lit(0), F.col("groups") - 1)), "asked": F.lit(False)})
    others = others.where("not (outside and j = g)")
    columns = ["family", "i", "j", "id", "asked", "known"]
    met = texts.join(asked.select(columns).unionByName(others.select(columns)), "id").select("family", "i", "j", "id", "text", "asked", "known")
    return small.unionByName(links).unionByName(_blocks_linked(met, like))


def jaccard_links(texts: DataFrame, profiles: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links ``a, b`` that span the components of all links between different sets.

    ``texts`` has id and text, ``profiles`` id, n_shingles and digest, ``sets`` id, n_shingles and the
    ``first`` id that has the same set, which alone is compared.
    """
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, profiles, like.size))
    rows = texts.mapInArrow(_signature_rows(common, like), "key long, id long, first long")
    families = components(rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_ties, "a long, b long"), contract=False)
    firsts = families.join(sets, "id").groupBy(F.col("first").alias("id")).agg(F.min("component").alias("family"), F.max("n_shingles").alias("n"))
    members = written(firsts, "members")
    large = _large(members)
    named = written(texts.join(members.join(large, "family", "left"), "id"), "family-texts")
    links = written(_one_block(named.where("blocks is null"), like), "links")
    return links if large.isEmpty() else links.unionByName(written(_large_links(named.where("blocks is not null").drop("blocks"), like), "links"))


def _joined(texts: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Profiles (id, n_shingles, digest) of all rows, and (id, component) of ids that aren't the least of theirs."""
    like = like.checked()
    profiles = written(texts.mapInArrow(lambda batches: _profiles(batches, like.size), "id long, n_shingles long, digest binary"), "profiles")
    named = profiles.where("id is not null and digest is not null")
    first = written(named.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    sets = named.join(first, "digest", "left").select("id", "n_shingles", F.coalesce("first", "id").alias("first"))
    sets = written(sets, "sets")
    copies = sets.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return profiles, pointers(jaccard_links(texts, profiles, sets, like).unionByName(copies))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = JOIN) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least doc_id reachable by links.

    Null, empty and blank texts have no shingles and link with nothing. Texts of fewer words
    than a shingle are one shingle each. A null id links with nothing and its component is null. Rows that
    repeat an id are texts of one document: each has its own n_shingles, and they share the component.
    """
    profiles, found = _joined(text_rows(docs, id_col, text_col), like)
    joined = profiles.join(found, "id", "left")
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = NEAR) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the least of its component.

    Texts without words stay. Rows that repeat an id are one document: of those with equal sets of
    shingles one stays, the others' different texts all stay with it. A row without an id stays unless
    a document or another such row has its set, of which one stays; it is not compared otherwise.
    """
    profiles, found = _joined(text_rows(docs, id_col, text_col), like)
    gone = found.select(F.col("id").alias(id_col))
    left = docs.join(gone, id_col, "left_anti").select(docs.columns)
    again = written(profiles.where("digest is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "again")
    if again.isEmpty():
        return left
    known = profiles.where("id is not null and digest is not null").select("digest").distinct()
    repeats = left.join(again, left[id_col].eqNullSafe(again["id"]), "left_semi")
    others = left.join(again, left[id_col].eqNullSafe(again["id"]), "left_anti")
    size, kind = like.size, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `set digest` binary"
    at = docs.columns.index(text_col)

    def with_digest(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in slices(batches):
            sets = shingle_sets(pc.fill_null(batch.column(at).cast(pa.string()), ""), size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())], [*batch.schema.names, "set digest"])

    marked = repeats.mapInArrow(with_digest, kind)
    blank = marked.where(F.col("set digest").isNull())
    named = marked.where(F.col(id_col).isNotNull() & F.col("set digest").isNotNull()).dropDuplicates([id_col, "set digest"])
    nameless = marked.where(F.col(id_col).isNull() & F.col("set digest").isNotNull()).dropDuplicates(["set digest"])
    nameless = nameless.join(known.withColumnRenamed("digest", "set digest"), "set digest", "left_anti").select(marked.columns)
    return others.unionByName(blank.unionByName(named).unionByName(nameless).drop("set digest"))
