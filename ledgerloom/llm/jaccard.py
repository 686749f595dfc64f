"""N-gram Jaccard join with a MinHash LSH forest.

Each of ``trees`` tries holds a label per document, a sequence of min-hashes of its word shingles.
Documents that share a label prefix are candidates. The prefix is shortened from the full label
until a pair at the threshold meets in some trie with at least the target recall, so pairs above
it do with more. Documents with the same shingle set are one representative. Prefix groups only
give links to their smallest member; the connected groups of those links are then verified
exactly, all pairs, in tiles of two blocks of bounded size, which also counts the links. No pair is
ever a row: a tile returns sums and a spanning forest of its true links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, lean, stage
from ledgerloom.llm.idmap import id_map, marked
from ledgerloom.llm.shingles import mix, set_key, shingles

WORDS = 5
THRESHOLD = 0.8
TREES = 16
LABEL = 10
RECALL = 0.995
#: Documents and shingles of one block of a tile.
BLOCK_DOCS = 256
BLOCK_SHINGLES = 400_000


def prefix_length(trees: int, label: int, threshold: float, recall: float) -> int:
    """Longest prefix with which pairs at the threshold meet in one of the tries as often as asked."""
    length = label
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 2**32, n, dtype=np.uint32)


def trie_keys(found: np.ndarray, trees: int, length: int) -> np.ndarray:
    """One 64-bit key a trie: the first ``length`` min-hashes of the document's label there."""
    a, b = _family(trees * length)
    low = np.full(trees * length, 0xFFFFFFFF, dtype=np.uint32)
    small = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 4096):
        part = small[at:at + 4096]
        for k in range(trees * length):
            value = (part * a[k] + b[k]).min()
            if value < low[k]:
                low[k] = value
    labels = low.reshape(trees, length).astype(np.uint64)
    key = np.arange(trees, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + labels[:, k] + np.uint64(1))
    return key.astype(np.int64)


def _sign(words: int, trees: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, left, right, keys = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                a, b = set_key(found)
                sizes.append(len(found))
                left.append(a)
                right.append(b)
                keys.append(trie_keys(found, trees, length).tolist() if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(left, pa.int64()),
                 pa.array(right, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n", "s1", "s2", "keys"],
            )

    return run


def _sets(words: int, bits: np.ndarray):
    """Shingle sets of the documents that may be candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out_ids, out, size = [], [], 0
            for i in np.flatnonzero(marked(bits, ids)):
                found = shingles(batch.column(1)[int(i)].as_py(), words)
                out_ids.append(int(ids[i]))
                out.append(found.tobytes())
                size += found.nbytes
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], ["rep", "found"])
                    out_ids, out, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.binary())], ["rep", "found"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), dtype=np.float64)
    width = max(1, (1 << 21) // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        member = np.zeros((n, width), dtype=np.float32)
        member[owner[lo:hi], column[lo:hi] - at] = 1
        out += member @ member.T
    return out


def _tile(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        reps = table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        sets = [np.frombuffer(v.as_py(), dtype=np.uint64) for v in table.column("found")]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        common = shared_counts(sets)
        linked = common >= threshold * (size[:, None] + size[None] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if one != two:
            linked &= block[:, None] != block[None]
        links = linked @ copies
        # A forest of the links: every row repeatedly takes the smallest root next to it.
        root = np.arange(len(reps))
        while True:
            near = np.where(linked, root[None], len(reps)).min(axis=1, initial=len(reps))
            new = np.minimum(root, near)
            new = new[new]
            if (new == root).all():
                break
            root = new
        used = np.flatnonzero(links)
        return pa.table({"rep": reps[used], "links": links[used].astype(np.int64), "other": reps[root[used]]})

    return run


def jaccard_join(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    label: int = LABEL,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, class_id, n_links), one row per input row.

    Two documents are linked when the Jaccard similarity of their sets of word shingles is at least
    the threshold; ``n_links`` counts the linked documents, copies included, and ``class_id`` is the
    smallest doc_id of the connected group. Null and empty texts, and texts of white space, have no
    shingle: they have no link and are a class of their own. Repeated rows link to each other. Rows with a null id
    take part as copies of an equal document only. An empty table gives an empty result. Other columns are ignored.
    """
    length = prefix_length(trees, label, threshold, recall)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(
        plain.mapInArrow(lean(_sign(words, trees, length)), "doc_id long, n long, s1 long, s2 long, keys array<long>"), "signed"
    )
    key = ["n", "s1", "s2"]
    reps = stage(
        signed.filter("n > 0").groupBy(*key)
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("keys").alias("keys")),
        "reps",
    )
    tries = reps.filter("rep is not null").select("rep", F.posexplode("keys").alias("trie", "key"))
    low = tries.groupBy("trie", "key").agg(F.min("rep").alias("low"), F.count("*").alias("c")).filter("c > 1")
    met = tries.join(low, ["trie", "key"]).filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    groups = components(met)
    members = groups.join(reps.select(F.col("rep").alias("id"), "n", "copies"), "id")
    blocks = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    )
    placed = stage(
        members.join(blocks, "root").select(
            F.col("id").alias("rep"), "root", "copies", "blocks",
            F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"),
        ),
        "members",
    )
    sets = plain.filter("doc_id is not null").mapInArrow(
        lean(_sets(words, id_map(placed.select("rep")))), "rep long, found binary"
    )
    tiles = (
        placed.join(sets, "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "root", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
            "rep", "copies", "block", "found",
        )
        .groupBy("root", "one", "two").applyInArrow(_tile(threshold), "rep long, links long, other long")
    )
    found = stage(tiles, "found")
    classes = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        reps.select(*key, "rep", "copies").join(links, "rep", "left")
        .join(classes.select(F.col("id").alias("rep"), "root"), "rep", "left")
        .select(*key, F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    return signed.join(named, key, "left").select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )
