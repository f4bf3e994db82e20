"""Operator 1: exact Jaccard similarity join on word shingles with token-combination prefixes.

Each text is its set of distinct k-word shingles, as 64-bit hashes ("tokens"). Equal sets become one
node. Tokens are ordered by class (lone, rare, frequent), then by hash. Two sets of similarity t or more
miss at most tau(n) = n - ceil(t n) of either's n tokens, so prefixes that tau(n) losses can't exhaust must
share something:

- a lone token is in one document only; it counts 1 and needs no signature. A bitmap of fixed size tells
  tokens that are in two documents or more; where it fills up, lone tokens pass for rare ones;
- a rare token counts 1 and is a signature by itself;
- frequent tokens are dealt to groups by hash. A group with c tokens in the prefix counts c - 1, and every
  pair of its tokens is a signature (k-token combinations, k = 2);
- the prefix is extended until the counts reach tau(n) + 1.

If every group and every rare token of the shared part were lost, more than tau(n) tokens would be, so
linked sets share a signature. The number of groups grows with the size class of a set, which keeps
combinations linear; a set carries the combinations of its own and the next class, so that sets of
neighbouring classes meet, and others don't.

Sharing a signature gives candidate classes. Whole classes are verified by tasks of bounded size, walking
over links from set to set, so a group of copies never becomes pairs. Larger classes are split at random first, with
shared anchors; then what is left outside a class's largest component is compared with the sets that share a
signature with it, or, where these are most of the class, with all of it in blocks, whichever moves less text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm import work
from rasterlake.llm.components import connected
from rasterlake.llm.wordhash import mix, shingle_sets

FINGERPRINT = 40  # bits of a token hash that document frequencies are counted by
LEAST_FREQUENT = 8  # documents; doubled until at most MAX_FREQUENT tokens are frequent
MAX_FREQUENT = 1_000_000  # 8 MB on every executor
COUNT_TOKENS = 2_000_000  # tokens that a task counts
COUNT_PIECE = 500_000  # entries counted at once
SHARED_BITS = 27  # the bitmap of tokens in two documents or more: 16 MB on every executor
KEY_BITS = 24  # the bitmap of documents whose text is needed again: 2 MB on every executor
PER_GROUP = 8
UNIT_TOKENS, UNIT_SETS = 1_000_000, 4096  # what one task verifies at once; a larger candidate class is split
ANCHORS = 32
SEEN = 300_000  # marks of sets that a task remembers, about 60 MB
TEXT_BYTES = 8  # of a text weigh as much as a token
PAIRS_A_TASK = 1_000_000  # of one signature
PAIRS_A_TEXT = 64  # pairs of numbers that are taken to cost as much as the shuffle of one text
NO_ID = -(2**63)
_A, _B, _C, _G = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, and two 64-bit sums that tell sets apart."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    ends = np.cumsum(n)
    out = []
    for salt in (_A, _B):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat + salt), dtype=np.uint64)])
        out.append(mix(total[ends] - total[ends - n] + n.astype(np.uint64)).view(np.int64))
    return n, out[0], out[1]


class Threshold:
    """Similarity num / den, which must be over one half: then sets of one token link only with equal ones."""

    def __init__(self, num: int, den: int):
        if not 2 * num > den or num > den:
            raise ValueError("the similarity must be over 0.5 and at most 1")
        self.num, self.den = num, den
        self.bounds = [1]

    def tau(self, n: int) -> int:
        return n - -(-self.num * n // self.den)

    def size_class(self, n: int) -> int:
        """Linked sets are in the same or in neighbouring classes."""
        while self.bounds[-1] <= n:
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def groups(self, tag: int) -> int:
        self.size_class(self.bounds[-1])
        while len(self.bounds) <= tag:
            self.size_class(self.bounds[-1])
        return max(1, self.tau(self.bounds[tag]) // PER_GROUP)


def signatures(tokens: np.ndarray, shared: np.ndarray, frequent: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set by rare tokens and by pairs of frequent ones (sorted tokens; shared and frequent:
    a mark for each, lone tokens have neither)."""
    n = len(tokens)
    none = np.empty(0, np.uint64)
    need = limit.tau(n) + 1 - int(n - np.count_nonzero(shared | frequent))
    if n < 2 or need <= 0:
        return none, none
    single = tokens[shared & ~frequent][:need]
    need -= len(single)
    pairs = [none]
    if need > 0:
        often = tokens[frequent]
        own = limit.size_class(n)
        for tag in (own, own + 1):
            groups = limit.groups(tag)
            group = (mix(often ^ _G) % np.uint64(groups)).astype(np.int64)
            _, first = np.unique(group, return_index=True)
            extra = np.ones(len(often), np.int64)
            extra[first] = 0
            stop = int(np.searchsorted(np.cumsum(extra), need)) + 1
            order = np.argsort(group[:stop], kind="stable")
            t, g = often[:stop][order], group[:stop][order]
            for lag in range(1, len(t)):
                same = g[lag:] == g[:-lag]
                if not same.any():
                    break
                pairs.append(mix(t[:-lag][same] * _A + t[lag:][same] * _B + np.uint64(tag * int(_C) % 2**64)))
    return mix(single ^ _C), np.concatenate(pairs)


class Classes:
    """Which token hashes are shared (a bitmap) and which are frequent (sorted fingerprints)."""

    def __init__(self, frequent: np.ndarray, shared: np.ndarray):
        self.frequent, self.shared = frequent, shared
        self.near = np.zeros(1 << 22, bool)
        self.near[frequent >> (FINGERPRINT - 22)] = True

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (tokens >> np.uint64(64 - SHARED_BITS)).astype(np.int64)
        shared = (self.shared[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
        often = self.near[(tokens >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(often)
        if len(at):
            fp = (tokens[at] >> np.uint64(64 - FINGERPRINT)).astype(np.int64)
            k = np.minimum(np.searchsorted(self.frequent, fp), len(self.frequent) - 1)
            often[at] = self.frequent[k] == fp
        return shared, often


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of all parts, sorted, and the sums of their counts."""
    fp, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])[: len(fp)])
    return fp[first], np.add.reduceat(n[order], first) if len(first) else n


def token_classes(docs: DataFrame, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of frequent tokens, and the bitmap of shared ones (equal sets of one slice count once).

    Every token of every document is counted. A slice's distinct fingerprints go to ranges, sorted, as byte planes of
    their differences, about three bytes each, with the counts of those that more than one of its sets holds: a
    token that is everywhere is one entry a slice. A task counts a range's entries in pieces of COUNT_PIECE."""
    spark = docs.sparkSession
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // COUNT_TOKENS))
    bits = min(max(1, (ranges - 1).bit_length()), SHARED_BITS - 3)

    def make():
        def one(c: dict) -> list:
            sets = shingle_sets(c["text"], k)
            _, a, b = _marks(sets)
            _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
            fp, n = np.unique(np.concatenate([*[sets[i] for i in first.tolist()], np.empty(0, np.uint64)]) >> np.uint64(64 - FINGERPRINT), return_counts=True)
            at = np.searchsorted(fp, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(FINGERPRINT - bits))
            out: tuple[list, ...] = ([], [], [], [])
            for r in np.flatnonzero(np.diff(at)).tolist():
                part = fp[at[r] : at[r + 1]]
                step = np.diff(part, prepend=np.uint64(r) << np.uint64(FINGERPRINT - bits)).astype("<u8")
                out[0].append(r)
                out[1].append(step.view(np.uint8).reshape(-1, 8)[:, : FINGERPRINT // 8].T.tobytes())
                more = np.flatnonzero(n[at[r] : at[r + 1]] > 1)
                out[2].append(more.astype("<u4").tobytes())
                out[3].append(n[at[r] : at[r + 1]][more].astype("<u4").tobytes())
            return list(out) if out[0] else None

        return one

    def count(table: pa.Table) -> pa.Table:
        r = np.uint64(table.column("range")[0].as_py()) << np.uint64(FINGERPRINT - bits)
        held, size = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
        for planes, more, counts in zip(table.column("planes"), table.column("more"), table.column("counts"), strict=True):
            planes, width = np.frombuffer(planes.as_buffer(), np.uint8), FINGERPRINT // 8
            raw = np.zeros((len(planes) // width, 8), np.uint8)
            raw[:, :width] = planes.reshape(width, -1).T
            n = np.ones(len(raw), np.int64)
            n[np.frombuffer(more.as_buffer(), "<u4")] = np.frombuffer(counts.as_buffer(), "<u4")
            held.append((np.cumsum(raw.view("<u8")[:, 0], dtype=np.uint64) + r, n))
            size += len(n)
            if size >= COUNT_PIECE:
                held, size = [summed(held)], 0
        fp, n = summed(held)
        mark = np.zeros(1 << (SHARED_BITS - bits), bool)
        mark[((fp[n > 1] - r) >> np.uint64(FINGERPRINT - SHARED_BITS)).astype(np.int64)] = True
        keep = n >= LEAST_FREQUENT
        kept = [pa.array([x[keep].astype(np.int64)], pa.list_(pa.int64())) for x in (fp, n)]
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "fps": kept[0], "ns": kept[1], "shared": pa.array([np.packbits(mark, bitorder="little").tobytes()], pa.binary())})

    planes = work.map_batches(docs.select("text"), "range int, planes binary, more binary, counts binary", make)
    counted = work.saved(planes.groupBy("range").applyInArrow(count, "range int, fps array<long>, ns array<long>, shared binary"), "classes")
    shared = np.zeros(1 << (SHARED_BITS - 3), np.uint8)
    width = 1 << (SHARED_BITS - 3 - bits)
    for row in counted.select("range", "shared").toArrow().to_pylist():  # 2**SHARED_BITS bits in all, whatever the input
        shared[row["range"] * width : (row["range"] + 1) * width] = np.frombuffer(row["shared"], np.uint8)
    each = counted.select(F.explode(F.arrays_zip("fps", "ns")).alias("t")).select("t.fps", "t.ns")
    by_power = {r.p: r.c for r in each.groupBy(F.floor(F.log2("ns")).alias("p")).agg(F.count("*").alias("c")).collect()}
    power = LEAST_FREQUENT.bit_length() - 1
    while sum(c for p, c in by_power.items() if p >= power) > MAX_FREQUENT:
        power += 1
    return np.sort(np.asarray(each.filter(F.col("ns") >= 1 << power).select("fps").toArrow().column("fps"), np.int64)), shared


def walk(sets: list[np.ndarray], limit: Threshold, label: np.ndarray | None = None, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that span the components of sets. With labels, sets of one label count as joined, and
    only links with a probe are looked for."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    _, token = np.unique(flat, return_inverse=True)
    doc = np.repeat(np.arange(m), size)
    first = np.cumsum(size) - size
    links: list[tuple[int, int]] = []
    left = np.ones(m, bool)

    def postings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        here = left[doc]
        order = np.argsort(token[here], kind="stable")
        n = np.bincount(token[here], minlength=int(token.max()) + 1 if len(token) else 1)
        return doc[here][order], np.cumsum(n) - n, n

    docs, start, count = postings()
    built = m

    def near(x: int) -> np.ndarray:
        own = token[first[x] : first[x] + size[x]]
        inter = np.bincount(docs[work.runs(count[own], start[own])], minlength=m)
        return left & (limit.den * inter >= limit.num * (size[x] + size - inter)) & (size > 0)

    if probes is not None:
        for x in np.flatnonzero(probes).tolist():
            ok = near(x) & (label != label[x])
            _, one = np.unique(label[ok], return_index=True)
            links += [(x, int(y)) for y in np.flatnonzero(ok)[one]]
        return links
    for s in range(m):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue and left.any():
            if 2 * left.sum() < built:
                docs, start, count = postings()
                built = int(left.sum())
            x = queue.pop()
            for y in np.flatnonzero(near(x)).tolist():
                left[y] = False
                links.append((s, y))
                queue.append(y)
    return links


def _unseen(seen: set[tuple[int, int, int]], keys: list[int], a: np.ndarray, b: np.ndarray) -> list[bool]:
    """Which (key, h1, h2) the task hasn't met lately; a full memory starts anew, which only costs work."""
    out = []
    for mark in zip(keys, a.tolist(), b.tolist(), strict=True):
        out.append(mark not in seen)
        seen.add(mark)
    if len(seen) > SEEN:
        seen.clear()
    return out


def _only_keys(texts: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """Rows of texts (key, text) whose key may be among keys, with their sets' marks h1 and h2: a bitmap of
    2**KEY_BITS hashed keys, whatever the input, keeps most other texts out of the shuffle to come. At sizes where it
    fills up it keeps everything. Of equal (key, h1, h2) a task gives one row, so repeated rows and null ids, which
    share a key, don't multiply."""
    slot = F.pmod(F.xxhash64("key"), F.lit(1 << KEY_BITS))
    found = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 32 AS INT)))").alias("m")).toArrow()
    table = np.zeros(1 << (KEY_BITS - 5), np.uint32)
    table[np.asarray(found.column("w"), np.int64)] = np.asarray(found.column("m"), np.int64).astype(np.uint32)
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            s = np.asarray(batch.column(2), np.int64)
            hit = (table[s >> 5] >> (s & 31).astype(np.uint32)) & 1 > 0
            for part in work.slices(batch.select([0, 1]).filter(pa.array(hit)), "text"):
                _, a, b = _marks(shingle_sets(part.column(1).to_pylist(), k))
                fresh = _unseen(seen, part.column(0).to_pylist(), a, b)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a), pa.array(b), part.column(1)], ["key", "h1", "h2", "text"]).filter(pa.array(fresh))

    return texts.select("key", "text", slot.alias("slot")).mapInArrow(run, "key long, h1 long, h2 long, text string")


def _verify(units: DataFrame, texts: DataFrame, k: int, limit: Threshold, total: int, probing: bool) -> DataFrame:
    """Links (hi, lo: nodes) inside each unit. units: key, h1, h2, node, comp, unit, label, probe."""
    spark = units.sparkSession
    bins = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // UNIT_TOKENS))

    def verify(table: pa.Table) -> pa.Table:
        comp, unit, node, label = (np.asarray(table.column(c), np.int64) for c in ("comp", "unit", "node", "label"))
        probe = np.asarray(table.column("probe"), bool)
        text = table.column("text")
        order = np.lexsort((node, unit, comp))
        cut = np.flatnonzero(np.concatenate([[True], np.diff(comp[order]) != 0]) | np.concatenate([[True], np.diff(unit[order]) != 0]))
        hi, lo = [], []
        for at in np.split(order, cut[1:]):
            _, one = np.unique(node[at], return_index=True)  # several tasks may bring equal texts of one id
            at = at[one]
            sets = shingle_sets(text.take(pa.array(at)).to_pylist(), k)
            links = walk(sets, limit, label[at], probe[at]) if probing else walk(sets, limit)
            hi += [max(node[at[x]], node[at[y]]) for x, y in links]
            lo += [min(node[at[x]], node[at[y]]) for x, y in links]
        return pa.table({"hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64())})

    rows = _only_keys(texts, units, k).join(units, ["key", "h1", "h2"]).withColumn("bin", F.pmod(F.xxhash64("comp", "unit"), F.lit(bins)).cast("int"))
    return rows.groupBy("bin").applyInArrow(verify, "hi long, lo long")


def _split(members: DataFrame, signed: DataFrame, texts: DataFrame, links: DataFrame, k: int, limit: Threshold, unit_tokens: int, unit_sets: int) -> DataFrame:
    """More links, of candidate classes that were split: what isn't in a class's largest component so far ("probes")
    is compared with the rest of its class. members: the first round's units, without anchors.

    A class whose sets share few signatures with each other, such as a chain of overlapping excerpts, is compared
    pair by pair, over the distinct pairs that share a signature and aren't joined yet: their number follows the
    signatures, not the square of the class. A class whose sets share most signatures, such as near copies
    around a few strays, is compared in blocks of probes against blocks of the class, so that pairs aren't listed."""
    roots = connected(links)
    large = members.filter("blocks > 1").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    most = large.groupBy("comp", "label").agg(F.count("*").alias("c")).groupBy("comp").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("main"))
    large = work.saved(large.join(most, "comp").withColumn("probe", F.col("label") != F.col("main")).drop("main"), "large")
    some = large.filter("probe").groupBy("comp").agg(F.greatest(F.ceil(F.sum("weight") / unit_tokens), F.ceil(F.count("*") / unit_sets)).cast("int").alias("rows"), F.count("*").alias("probes"))
    # texts that blocks would move: the class for each row of probes, the probes for each block of the class
    moved = F.col("c").cast("double") * F.col("rows") + F.col("probes").cast("double") * F.col("blocks")
    some = large.select("comp", "blocks", "c").distinct().join(some, "comp").select("comp", "rows", moved.alias("moved"))
    # numbers that pairs would list: for each signature, its probes times its sets
    told = signed.select("node", F.explode(F.concat("rare", "pairs")).alias("sign")).join(large.select("node", "comp", "probe"), "node")
    lists = work.saved(told.groupBy("comp", "sign").agg(F.count("*").alias("all"), F.count_if("probe").alias("odd")).filter("odd > 0 AND all > 1"), "lists")
    listed = lists.groupBy("comp").agg(F.sum(F.col("odd").cast("double") * F.col("all")).alias("listed"))
    plan = work.saved(some.join(listed, "comp").select("comp", "rows", (F.col("listed") <= PAIRS_A_TEXT * F.col("moved")).alias("by_pairs")), "plan")

    columns = ["key", "h1", "h2", "weight", "node", "comp", "label", "probe", "unit"]
    blocks = large.join(plan.filter("NOT by_pairs"), "comp")
    mine = F.pmod(F.xxhash64("node", F.lit("rows")), F.col("rows")).cast("int")
    place = (F.col("r").cast("long") * F.lit(1 << 31) + F.col("b")).alias("unit")
    probes = blocks.filter("probe").withColumn("r", mine).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = blocks.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("b", F.col("unit").cast("int"))
    others = others.filter(~(F.col("probe") & (F.col("r") == mine))).withColumn("probe", F.lit(False))
    second = probes.withColumn("unit", place).select(*columns).union(others.withColumn("unit", place).select(*columns))

    # pairs of a probe and another set that share a signature; where both are probes, the one of the larger number is the probe
    # long lists are cut into parts by their probes
    pairwise = large.join(plan.filter("by_pairs").select("comp"), "comp")
    parts = lists.select("comp", "sign", F.ceil(F.col("odd").cast("double") * F.col("all") / PAIRS_A_TASK).cast("int").alias("parts"))
    dealt = told.select("node", "comp", "sign").join(parts, ["comp", "sign"])
    odd = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("comp", "parts").join(pairwise.filter("probe").select("node", "comp", "label", "n"), "node")
    every = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("comp", "parts")
    every = every.join(pairwise.select("comp", F.col("node").alias("other"), F.col("label").alias("l"), F.col("n").alias("m"), F.col("probe").alias("p")), F.col("node") == F.col("other")).drop("node")
    near = (F.least("n", "m") * limit.den >= F.greatest("n", "m") * limit.num) & (F.col("label") != F.col("l")) & (~F.col("p") | (F.col("node") > F.col("other")))
    pairs = work.saved(odd.join(every, ["comp", "sign", "part"]).filter(near).select("node", "other").distinct(), "pairs")
    # a probe's partners are dealt to units of bounded size, each with the probe
    hubs = pairs.join(large.select(F.col("node").alias("other"), "weight"), "other").groupBy("node").agg(F.greatest(F.ceil(F.sum("weight") / unit_tokens), F.ceil(F.count("*") / unit_sets)).cast("int").alias("parts"))
    dealt = pairs.join(hubs, "node").select(F.col("node").alias("hub"), F.col("other").alias("node"), F.lit(False).alias("probe"), F.pmod(F.xxhash64("other", F.lit("part")), F.col("parts")).cast("long").alias("unit"))
    heads = hubs.select(F.col("node").alias("hub"), "node", F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("unit"))
    each = dealt.union(heads).join(large.select("node", "key", "h1", "h2", "weight", "label"), "node").withColumn("comp", -1 - F.col("hub"))  # no class has a number below 0
    second = work.saved(second.union(each.select(*columns)), "units")
    total = second.agg(F.sum("weight")).first()[0] or 0
    return _verify(second.drop("weight"), texts, k, limit, total, True)


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, unit_tokens: int = UNIT_TOKENS, unit_sets: int = UNIT_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id, h1, h2 (128 bits that tell sets apart) of every document: sets of k-word shingles link at a Jaccard
    similarity of num / den or more; component_id is the smallest doc_id reachable over links.

    Words are lower-cased (A-Z) runs of other characters than space and \\x09-\\x0D; a text with fewer than
    k words is one shingle. Null, empty or blank texts have no shingle and link with nothing, not even each
    other: component_id is their own doc_id. Equal texts always link. Repeated rows stay rows; null ids are
    passed over when the smallest is sought, so component_id is null only where a component has no id. Other
    columns aren't read. Hashes of 64 bits stand for shingles and 128 bits for equal sets; every other link
    is an exact count on those. Links are only counted as far as components need, so no pairs are returned."""
    limit = Threshold(num, den)
    docs = work.pick(docs, "doc_id", "text")

    def scan():
        def one(c: dict) -> list:
            n, a, b = _marks(shingle_sets(c["text"], k))
            return [c["doc_id"], n, a, b, np.maximum(n, [len(t or "") // TEXT_BYTES for t in c["text"]])]

        return one

    sets = work.saved(work.map_batches(docs, "doc_id long, n_shingles long, h1 long, h2 long, weight long", scan), "sets")
    nodes = sets.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("weight").alias("weight"))
    nodes = work.saved(nodes.select("h1", "h2", "doc_id", "n", "weight", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.monotonically_increasing_id().alias("node")), "nodes")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast(token_classes(docs, k, total))

    def sign():
        class_of = Classes(*sent.value)
        seen: set[tuple[int, int, int]] = set()

        def listed(parts: list[np.ndarray]) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))

        def one(c: dict) -> list:
            all_sets = shingle_sets(c["text"], k)
            _, a, b = _marks(all_sets)
            keys = [NO_ID if d is None else d for d in c["doc_id"]]
            at = np.flatnonzero(_unseen(seen, keys, a, b))
            if not len(at):
                return None
            rare, pairs = zip(*[signatures(all_sets[i], *class_of(all_sets[i]), limit) for i in at.tolist()], strict=True)
            return [[keys[i] for i in at.tolist()], a[at], b[at], listed(rare), listed(pairs)]

        return one

    signed = work.map_batches(docs, "key long, h1 long, h2 long, rare array<long>, pairs array<long>", sign).filter("size(rare) + size(pairs) > 0")
    signed = work.saved(signed.join(nodes.select("key", "h1", "h2", "node", "n"), ["key", "h1", "h2"]).select("node", "n", "rare", "pairs"), "signs")
    # a rare token is in few sets: in order of size, each is tied to the next smaller one unless that is too
    # small to link; sets that may link are in one chain then
    order = Window.partitionBy("sign").orderBy("n", "node")
    chain = signed.select("node", "n", F.explode("rare").alias("sign")).select("node", "n", F.lag("node").over(order).alias("lo"), F.lag("n").over(order).alias("m"))
    chain = chain.filter((F.col("m") * den >= F.col("n") * num) & (F.col("node") != F.col("lo"))).select(F.col("node").alias("hi"), "lo")
    # a pair of frequent tokens may be in most sets: minima are aggregated before the shuffle
    each = signed.select("node", F.explode("pairs").alias("sign"))
    shared = each.groupBy("sign").agg(F.min("node").alias("lo"), F.max("node").alias("top")).filter("lo < top").select("sign", "lo")
    stars = each.join(shared, "sign").filter("node <> lo").select(F.col("node").alias("hi"), "lo")
    classes = connected(chain.union(stars))

    members = classes.select("node", F.col("root").alias("comp")).join(nodes, "node")
    weights = members.groupBy("comp").agg(F.greatest(F.ceil(F.sum("weight") / unit_tokens), F.ceil(F.count("*") / unit_sets)).cast("int").alias("blocks"), F.count("*").alias("c"))
    members = members.join(weights, "comp")
    members = work.saved(members.withColumn("unit", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")).withColumn("label", F.col("node")).withColumn("probe", F.lit(False)), "members")
    sums = members.agg(F.sum("weight").alias("n"), F.max("blocks").alias("blocks")).first()
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text")
    columns = ["key", "h1", "h2", "node", "comp", "unit", "label", "probe"]
    units = members.select(*columns)
    split = (sums.blocks or 1) > 1
    if split:  # a few sets of a split class stand in each of its units and tie their components together
        anchors = members.filter("blocks > 1").filter(F.pmod(F.xxhash64("node", F.lit("anchor")), F.col("c")) < ANCHORS)
        units = units.union(anchors.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).select(*columns))
    links = work.saved(_verify(units, texts, k, limit, sums.n or 0, False), "links")
    if split:
        links = work.saved(links.union(_split(members, signed, texts, links, k, limit, unit_tokens, unit_sets)), "links")
    roots = connected(links).join(nodes.select("node", "h1", "h2", "doc_id"), "node")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(least, "root").select("h1", "h2", "component_id")
    own = nodes.join(named, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("component_id", "doc_id").alias("component_id"))
    return sets.join(work.saved(own, "components"), ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "h1", "h2")


def keep_one(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows of docs (all columns as they are), one of each component: the one of its smallest doc_id, of
    different texts under that id the one of the smallest hash, of repeated rows any one. Components without
    any id keep one row too. Texts without words link with nothing, not even each other, so all their rows stay."""
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    blank, docs = docs.filter(~worded), docs.filter(worded)
    found = jaccard_components(docs, k, num, den).withColumn("lone", F.when(F.col("component_id").isNull(), F.xxhash64("h1", "h2")).otherwise(F.lit(0)))
    counted = found.groupBy("component_id", "lone", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("k"), "doc_id", "h1", "h2").agg(F.count("*").alias("c"))
    first = counted.groupBy("component_id", "lone").agg(F.min(F.struct("k", "h1", "h2", "doc_id", "c")).alias("one"))
    names = docs.columns
    own = "__"
    while any(c.lower().startswith(own) for c in names):
        own += "_"
    marks, one, copies = [f"{own}{c}" for c in ("key", "h1", "h2")], [f"{own}{c}" for c in ("k0", "k1", "k2")], f"{own}copies"
    first = work.saved(first.select(F.coalesce("one.doc_id", F.lit(NO_ID)).alias(one[0]), F.col("one.h1").alias(one[1]), F.col("one.h2").alias(one[2]), F.col("one.c").alias(copies)), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {c: i for i, c in enumerate(names)}
        for batch in batches:
            for part in work.slices(batch, "text"):
                _, a, b = _marks(shingle_sets(part.column(at["text"]).to_pylist(), k))
                ids = pa.array([NO_ID if d is None else d for d in part.column(at["doc_id"]).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(a), pa.array(b)], [*part.schema.names, *marks])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(m, T.LongType()) for m in marks]])
    match = [F.col(m) == F.col(o) for m, o in zip(marks, one, strict=True)]
    rows = docs.mapInArrow(run, schema).join(first, match[0] & match[1] & match[2])
    out = rows.filter(F.col(copies) == 1).drop(*marks, *first.columns)
    if first.filter(F.col(copies) > 1).limit(1).count():  # only repeated rows of one id and text are shuffled again
        out = out.union(rows.filter(F.col(copies) > 1).dropDuplicates(marks).drop(*marks, *first.columns))
    return out.union(blank)


def op1_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component at four words and 0.85."""
    return jaccard_components(work.read(spark, sf_dir, "documents"), 4, 85, 100).drop("h1", "h2")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
