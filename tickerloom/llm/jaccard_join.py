"""N-gram Jaccard join by vertical partitioning, and its connected components.

All word n-grams have one global order, rare ones first. Prefixes in that order name candidate pairs; the order is cut into
fragments, a pair's overlap is counted in each fragment separately and summed. Only pairs that can still join two components
are counted, so a group of many near copies costs a star and not all its pairs, and no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import discard, doc_batches, materialize, mix, shingle_hashes, word_hashes

WIDTH, PERCENT = 5, 80
#: Counters that n-grams are counted in for the global order (a few megabytes, whatever the corpus), and their blocks.
COUNTERS_LOG, BLOCK_LOG = 22, 16
#: Fragments of the global order.
FRAGMENTS = 8
#: Rows of two numbers that are broadcast at most.
MOST_BROADCAST = 1_000_000


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct n-gram hashes, ascending."""
    h = shingle_hashes(word_hashes(text), width)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def set_class(shingles: np.ndarray) -> bytes:
    """128 bits for a set, of two separate sums: equal sets have equal bits, and different sets do not meet by chance even among 10**12."""
    with np.errstate(over="ignore"):
        totals = [mix(shingles ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(shingles)) for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
    return mix(np.array(totals, np.uint64)).tobytes()


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * 2**k bins (about as many as elements): whether an odd number of elements falls into it.

    Elements in both sets cancel out, so two sets differ by at least as many elements as their bits: a bound, never an estimate.
    Twice as many bins fold into half as many by exclusive or.
    """
    words = 1 << max(0, (-(-len(shingles) // 64) - 1).bit_length())
    bins = (shingles & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(bins, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def describe(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One pass over the texts: (doc_id, n, cls, bits) of each row, and each task's n-gram counts as rows of (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(1 << COUNTERS_LOG, np.uint32), [], 0
        names, bits_of = ["doc_id", "n", "cls", "bits", "block", "counts"], pa.list_(pa.int64())

        def flush() -> None:
            if waiting:
                np.add(counts, np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.uint32), out=counts)
                waiting.clear()

        for batch, texts in doc_batches(batches):
            sizes, classes, bits = [], [], []
            for text in texts:
                s = shingle_set(text, width)
                sizes.append(len(s))
                bits.append(parity_bits(s))
                classes.append(set_class(s))
                waiting.append((s >> np.uint64(64 - COUNTERS_LOG)).astype(np.int32))
                held += len(s)
                if held > 4_000_000:
                    flush()
                    held = 0
            n = len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bits, bits_of), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        flush()
        for block in range(len(counts) >> BLOCK_LOG):
            part = counts[block << BLOCK_LOG : (block + 1) << BLOCK_LOG]
            if part.any():
                at = np.flatnonzero(part)
                small = np.minimum(part, 255).astype(np.uint8)
                big = at[part[at] >= 255]
                packed = np.uint32(len(big)).tobytes() + big.astype("<u4").tobytes() + part[big].astype("<u4").tobytes() + small.tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, bits_of), pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls binary, bits array<long>, block int, counts binary")


def _levels(described: DataFrame) -> np.ndarray:
    """How frequent each counter's n-grams are, in powers of two above what a mean counter holds; 0 for rare. Of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                n = int(np.frombuffer(packed, "<u4", 1)[0])
                big, value = np.frombuffer(packed, "<u4", n, 4), np.frombuffer(packed, "<u4", n, 4 + 4 * n)
                part = np.frombuffer(packed, np.uint8, 1 << BLOCK_LOG, 4 + 8 * n).astype(np.uint64)
                part[big] = value
                sums[block] = sums[block] + part if block in sums else part
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    counts = described.filter(F.col("block").isNotNull()).select("block", "counts")
    # Each worker adds up its own; then the few blocks are added up, a block a task.
    total = counts.mapInArrow(add, "block int, sums binary")
    logs = np.zeros(1 << COUNTERS_LOG, np.uint8)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(raw, np.uint64)
                sums[block] = sums[block] + part if block in sums else part
        for block, part in sums.items():
            # quarter powers of two, so that a byte holds any count
            logged = np.where(part > 0, 1 + np.minimum(np.floor(4 * np.log2(np.maximum(part, 1).astype(float))), 250), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([int(part.sum())], pa.int64()), pa.array([logged.tobytes()], pa.binary())], ["block", "n", "logs"])

    merged = total.repartition(1 << (COUNTERS_LOG - BLOCK_LOG), "block").mapInArrow(merge, "block int, n long, logs binary").collect()
    for r in merged:
        logs[r["block"] << BLOCK_LOG : (r["block"] + 1) << BLOCK_LOG] = np.frombuffer(r["logs"], np.uint8)
    usual = 2 * sum(r["n"] for r in merged) / len(logs) + 8
    return np.maximum(0, np.floor((logs - 1.0) / 4 - np.log2(usual)) + 1).astype(np.uint8)


def _ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the global order: by level, then by hash."""
    level = levels[shingles >> np.uint64(64 - COUNTERS_LOG)]
    return shingles[np.argsort(level, kind="stable")] if level.any() else shingles


def prefix_entries(docs: DataFrame, levels, width: int, percent: int) -> DataFrame:
    """(key, cls, n, pos): the first n-grams of each set in the global order, as many as a linked set cannot all lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches):
            keys, classes, sizes = [], [], []
            for k, text in enumerate(texts):
                s = shingle_set(text, width)
                if len(s):
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    keys.append(_ordered(s, levels.value)[:length].view(np.int64))
                    classes.append(set_class(s))
                    sizes.append(len(s))
                if keys and (k + 1 == len(texts) or k % 1000 == 999):
                    lengths = np.array([len(x) for x in keys])
                    of_set = np.repeat(np.arange(len(classes)), lengths)
                    columns = [pa.array(np.concatenate(keys)), pa.array(classes, pa.binary()).take(pa.array(of_set)), pa.array(np.array(sizes, np.int32)[of_set]), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in lengths]))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "cls", "n", "pos"])
                    keys, classes, sizes = [], [], []

    return docs.select("text").mapInArrow(run, "key long, cls binary, n int, pos int")


def shared_entries(entries: DataFrame) -> DataFrame:
    """The entries whose key several classes have, once for each class: rows come sorted by key and are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row seen; it goes out with the next one if that shares its key
        last_out = False
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.concat_batches([last, batch]) if last is not None else batch
            key, cls = both.column("key").to_numpy(), both.column("cls")
            other = pc.not_equal(cls.slice(1), cls.slice(0, len(cls) - 1)).to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | other])
            at = np.flatnonzero(new)
            k = key[at]
            same = k[1:] == k[:-1]
            out = np.zeros(len(at), bool)
            out[1:] |= same
            out[:-1] |= same
            first = 1 if last is not None and last_out else 0  # already out
            whole = out.copy()
            whole[:first] = False
            if whole.any():
                yield both.take(pa.array(at[whole]))
            last, last_out = both.slice(int(at[-1]), 1), bool(out[-1])  # a class's later copies are dropped

    dealt = entries.repartition("key").sortWithinPartitions("key", "cls")
    return dealt.mapInArrow(run, "key long, cls binary, n int, pos int")


def segments(docs: DataFrame, classes: DataFrame, levels, width: int) -> DataFrame:
    """(cls, fragment, grams) of the (cls, rep) given: a representative's set, cut where the global order is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = FRAGMENTS - 2  # fragments of the rare n-grams, by ranges of hash; frequent ones have the other two
        for batch, texts in doc_batches(batches):
            for cls, text in zip(batch.column("cls").to_pylist(), texts):
                s = shingle_set(text, width)
                if set_class(s) != cls:  # another text under the representative's doc_id
                    continue
                level = levels.value[s >> np.uint64(64 - COUNTERS_LOG)]
                range_of = (s >> np.uint64(32)) * np.uint64(low) >> np.uint64(32)
                fragment = np.where(level == 0, range_of, np.where(level == 1, low, low + 1)).astype(np.int64)
                order = np.argsort(fragment, kind="stable")
                found, sizes = np.unique(fragment, return_counts=True)
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(s[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([cls] * len(found), pa.binary()), pa.array(found, pa.int32()), grams], ["cls", "fragment", "grams"])

    wanted = classes.select(F.col("rep").alias("doc_id"), "cls")
    if wanted.count() <= MOST_BROADCAST:  # two numbers a row: at most some tens of megabytes; beyond that the texts are shuffled
        wanted = F.broadcast(wanted)
    chosen = docs.select("doc_id", "text").join(wanted, "doc_id")
    return chosen.select("cls", "text").mapInArrow(run, "cls binary, fragment int, grams array<long>").dropDuplicates(["cls", "fragment"])


def _differing_bits() -> Column:
    """Bits in which bits_a and bits_b differ, the longer one folded to the shorter one's size."""

    def folded(x: Column, other: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        twice = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), twice).otherwise(x)

    a, b = folded(F.col("bits_a"), F.col("bits_b")), folded(F.col("bits_b"), F.col("bits_a"))
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, c: n + c)


def close_pairs(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that may link by their parity bits; sizes within a factor of two fold to one length.

    Linked sets differ by at most (100 - percent) / (100 + percent) of n_a + n_b elements, so no link is lost here.
    """
    of = lambda s: bits.select(F.col("cls").alias(s), F.col("bits").alias(f"bits_{s}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    close = (100 + percent) * _differing_bits() <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    return joined.filter(close).select("a", "b", "n_a", "n_b").distinct()


def links_of(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that link: overlaps are counted fragment by fragment and summed."""
    of = lambda side: segs.select(F.col("cls").alias(side), "fragment", F.col("grams").alias(f"grams_{side}"))
    wide = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    parts = wide.join(of("a"), ["a", "fragment"]).join(of("b"), ["b", "fragment"])
    partial = parts.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("x"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("x").alias("x"))
    return summed.filter(100 * F.col("x") >= percent * (F.col("n_a") + F.col("n_b") - F.col("x"))).select("a", "b")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): every linked node's smallest reachable node, by hooking to neighbours' labels and jumping along them."""
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    labels = written = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = materialize(hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        discard(written)
        labels, written = stepped.select("node", "label"), stepped
        if stepped.filter(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return labels
    raise RuntimeError("components did not settle")


def _could_link(percent: int):
    """Whether sizes and positions of a key in two sets leave room for a link, if the key is the first that they share."""
    enough = (100 + percent) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    return enough & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def _pairs(left: DataFrame, right: DataFrame, percent: int, where) -> DataFrame:
    """Distinct candidate pairs of left and right entries with one key; the smaller class first."""
    side = lambda df, s: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "key"])
    met = side(left, "a").join(side(right, "b"), "key").filter((F.col("cls_a") != F.col("cls_b")) & _could_link(percent) & where)
    low = F.col("cls_a") < F.col("cls_b")
    pick = lambda c, first: F.when(low, F.col(f"{c}_{'a' if first else 'b'}")).otherwise(F.col(f"{c}_{'b' if first else 'a'}"))
    return met.select(pick("cls", True).alias("a"), pick("cls", False).alias("b"), pick("n", True).alias("n_a"), pick("n", False).alias("n_b")).distinct()


def link_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link if 100 * |A & B| >= percent * |A | B| for their sets of distinct word n-grams (words
    ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; fewer than ``width`` words: the whole sequence is one). component_id is the
    smallest doc_id reachable by links. Equal sets are one class from the start. Candidates share an n-gram of their
    prefixes and differ in few parity bits; per shared n-gram, first every class is compared with one leader, then with the leaders of other components,
    last with everything of other components: what is left out lies in one component already.

    Null or empty texts: size 0, component of their own. Null doc_id: size given, component null, no links. Rows of one
    doc_id: one node. Ties do not arise. Empty table: no rows. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(describe(docs, width), "shingles")
    rows = described.filter(F.col("block").isNull()).select("doc_id", "n", "cls")
    linkable = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(linkable.groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes")
    levels = spark.sparkContext.broadcast(_levels(described))

    entries = prefix_entries(docs.filter(F.col("doc_id").isNotNull()), levels, width, percent)
    shared = materialize(shared_entries(entries), "shared")
    candidates = materialize(classes.join(shared.select("cls").distinct(), "cls"), "candidates")
    all_bits = described.filter(F.col("block").isNull()).select(F.col("doc_id").alias("rep"), "cls", "bits")
    bits = materialize(candidates.join(all_bits, ["rep", "cls"]).select("cls", "bits").dropDuplicates(["cls"]), "bits")

    def grown(links: DataFrame | None, pairs: DataFrame, label: str) -> DataFrame:
        """Links so far and those among ``pairs``, between representatives."""
        close = materialize(close_pairs(pairs, bits, percent), f"pairs{label}")
        ends = close.select(F.col("a").alias("cls")).union(close.select("b")).distinct()
        segs = materialize(segments(docs, candidates.join(ends, "cls"), levels, width), f"segments{label}")
        rep = lambda s: candidates.select(F.col("cls").alias(s), F.col("rep").alias(f"rep_{s}"))
        new = links_of(close, segs, percent).join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        found = materialize(new if links is None else new.unionByName(links), f"links{label}")
        discard(close, segs)
        return found

    def open_entries(links: DataFrame) -> DataFrame:
        """Entries of keys whose classes are in several components, with their components."""
        label = components(links)
        of = materialize(candidates.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("label", "rep").alias("comp")), "comps")
        within = shared.join(of, "cls")
        several = within.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        found = materialize(within.join(several, "key"), "open")
        discard(of)
        return found

    first = F.min(F.struct("pos", "n", "cls")).alias("l")
    leader = shared.groupBy("key").agg(first).select("key", "l.cls", "l.n", "l.pos")
    links = grown(None, _pairs(shared, leader, percent, F.lit(True)), "0")
    still = open_entries(links)
    leaders = still.groupBy("key", "comp").agg(first).select("key", "comp", "l.cls", "l.n", "l.pos")
    links = grown(links, _pairs(still, leaders, percent, F.col("comp_a") != F.col("comp_b")), "1")
    discard(still)
    still = open_entries(links)
    links = grown(links, _pairs(still, still, percent, F.col("comp_a") < F.col("comp_b")), "2")
    discard(still, shared, candidates, bits)

    label = components(links)
    of_class = materialize(classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("label", "rep").alias("component")), "components")
    joined = rows.join(of_class, "cls", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of its component; null doc_ids stay, as do all rows of a doc_id that stays."""
    linked = link_documents(docs, width, percent)
    gone = materialize(linked.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct(), "copies")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
