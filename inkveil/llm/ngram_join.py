"""N-gram Jaccard join: all links of a collection, as components and link counts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, mix64, parts_of, settle, token_hashes
from .components import components
from .prefix_tree import trie_links

ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
FOUND = "bucket int, doc_id long, n long, node long, text_hash long, a long, b long, marks binary, owners binary"
JOINED = "a long, b long, links long"
#: A chunk of sets that is joined at once: so many sets on average, and sets times members of the largest.
CHUNK_SETS, CHUNK_CELLS = 512, 400_000
SALTS = 32
#: Texts among which common n-grams are looked for (more if there are many parts, of which each gives some), n-grams
#: of a text that are looked at, the texts that have a common one, and how many are known at most.
SEEN, SEEN_OF_PART, SEEN_GRAMS, COMMON_TEXTS, COMMON_MOST = 20_000, 64, 4096, 6, 1 << 18


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The set of a word sequence's n-grams as sorted 64-bit values; fewer words than n
    make one gram of the whole sequence, no words none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    value = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        value = mix64(value * ODD[0] + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(value)


@lru_cache(maxsize=4096)
def schemes(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(class, parts, spared) of the pair classes that a set of this size takes part in.

    Sizes fall into classes so wide that linked sets are in one class or in two that
    follow each other. Linked sets of sizes a and b differ in at most
    h = (a + b) (100 - p) / (100 + p) members, which spoil h parts of the members' space
    at most: of h + 1 + s parts they agree in s + 1. In an order of all parts, each set
    can then spare its first s: of the parts that two sets agree in, the last has s before
    it in both. Parts with few members that are not common come first (`marks`), so that it is the empty ones, and
    those which unlike sets may have in common, that are spared. Each set keeps h + 1 parts,
    however many are spared. Classes in which linked sets can't differ need no parts.
    """
    low, held = 1, []
    while low <= size:
        top = 100 * low // percent
        held.append((low, top))
        low = top + 1
    out = []
    for c in range(max(0, len(held) - 2), len(held)):
        top = held[c][1]
        most = (top + 100 * top // percent) * (100 - percent) // (100 + percent)
        if most:
            spared = most // 2 + 1
            out.append((c, most + 1 + spared, spared))
    return tuple(out)


@lru_cache(maxsize=256)
def bounds(parts: int) -> np.ndarray:
    return np.array([((j << 64) // parts) for j in range(1, parts)], dtype=np.uint64)


def marks(members: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """A value for each part of each pair class, equal where the sets' members in it are,
    without the parts that can be spared: first those of members that are `common` (sorted) alone.

    A line that many unlike texts have would link all of them by the parts in which it stands
    alone, to one candidate component that grows faster than the input. Parts are ordered by what is in
    them alone, so that sets agree in the order, and no link is lost, whatever counts as common."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(members ^ ODD[1]), dtype=np.uint64)])
    rare = np.ones(len(members), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, members), len(common) - 1)] != members
    ahead = np.concatenate([[0], np.cumsum(rare)])
    out = []
    for c, parts, spared in schemes(len(members), percent):
        cuts = np.concatenate([[0], np.searchsorted(members, bounds(parts)), [len(members)]])
        salt = mix64(np.arange(parts, dtype=np.uint64) * ODD[2] + np.uint64(c * 1_000_003 + parts))
        value = mix64(sums[cuts[1:]] - sums[cuts[:-1]] + salt)
        out.append(value[np.lexsort((value, np.diff(cuts), np.diff(ahead[cuts])))[spared:]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_of(members: np.ndarray) -> int:
    """A set's 64-bit name; equal sets have the same."""
    return int(mix64(np.sum(mix64(members ^ ODD[0]), dtype=np.uint64, keepdims=True) + np.uint64(len(members)))[0].astype(np.int64))


def _word_hashes(texts: pa.Array) -> list[np.ndarray]:
    flat, ends = token_hashes(texts)
    return np.split(flat, ends[:-1]) if len(ends) else []


def _stars(marks_: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets that share a mark: the mark, its smallest set, and edges from that to the others."""
    order = np.lexsort((owners, marks_))
    m, o = marks_[order], owners[order]
    new = np.append(True, m[1:] != m[:-1]) if len(m) else np.zeros(0, bool)
    first = o[new][np.cumsum(new) - 1] if len(m) else o
    edges = np.unique(np.stack([first, o], axis=1)[first != o], axis=0)
    return m[new], o[new], edges


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


FOUND_SCHEMA = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("text_hash", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("marks", pa.binary()), ("owners", pa.binary())])
JOINED_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _mark(n: int, percent: int, buckets: int, common: np.ndarray, hold: int = 1_500_000):
    """Documents to rows of three kinds: a document's set; marks of a bucket, packed; edges
    between sets that met in this task already. A mark leaves the task once."""

    def flush(held, owners):
        m, o, edges = _stars(np.concatenate(held), np.repeat(np.array([x for x, _ in owners], dtype=np.int64), [k for _, k in owners]))
        where = (m % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
        m, o = m[order], o[order]
        yield _rows(FOUND_SCHEMA, bucket=full, marks=[m[cuts[k] : cuts[k + 1]].tobytes() for k in full], owners=[o[cuts[k] : cuts[k + 1]].tobytes() for k in full])
        if len(edges):
            yield _rows(FOUND_SCHEMA, bucket=(edges[:, 0] % buckets).astype(np.int32), a=edges[:, 0], b=edges[:, 1])

    def run(batches):
        held, owners, names, count = [], [], set(), 0
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for at in range(0, batch.num_rows, 512):
                sizes, nodes = [], []
                for words in _word_hashes(batch.column("text").slice(at, 512)):
                    members = grams(words, n)
                    sizes.append(len(members))
                    nodes.append(name := node_of(members))
                    if name not in names and len(got := marks(members, percent, common)):
                        names.add(name)
                        held.append(got)
                        owners.append((name, len(got)))
                        count += len(got)
                # documents go on by id as well as by set: copies of one text are not one bucket
                places = [(x ^ (i or 0) * 0x9E3779B1) % buckets for x, i in zip(nodes, ids.slice(at, 512).to_pylist(), strict=True)]
                yield _rows(FOUND_SCHEMA, bucket=places, doc_id=ids.slice(at, 512), n=sizes, node=nodes, text_hash=hashes.slice(at, 512))
                if count >= hold:
                    yield from flush(held, owners)
                    held, owners, names, count = [], [], set(), 0
        if held:
            yield from flush(held, owners)

    return run


def _meet(batches):
    """Rows sorted by bucket: edges between sets that share a mark of a bucket, which is held
    at a time; other rows pass."""

    def edges_of(held, owners):
        edges = _stars(np.concatenate(held), np.concatenate(owners))[2]
        for at in range(0, len(edges), 100_000):
            part = edges[at : at + 100_000]
            yield _rows(FOUND_SCHEMA, a=part[:, 0], b=part[:, 1])

    held, owners, of = [], [], None
    for batch in batches:
        packed = batch.column("marks").is_valid()
        yield batch.filter(pa.compute.invert(packed))
        rows = batch.filter(packed)
        for bucket, m, o in zip(rows.column("bucket").to_pylist(), rows.column("marks"), rows.column("owners"), strict=True):
            if bucket != of and held:
                yield from edges_of(held, owners)
                held, owners = [], []
            of = bucket
            held.append(np.frombuffer(m.as_buffer(), np.uint64))
            owners.append(np.frombuffer(o.as_buffer(), np.int64))
    if held:
        yield from edges_of(held, owners)


def _sets(n: int):
    """Texts to their sets of n-grams, packed."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [grams(w, n).tobytes() for w in _word_hashes(part.column("text"))]
                i = part.schema.get_field_index("text")
                yield part.set_column(i, "text", pa.array(made, pa.binary()))

    return run


def _seen(n: int):
    """Texts to the names of their sets, and some n-grams of each (the smallest values), packed."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                made = [grams(w, n) for w in _word_hashes(batch.column("text").slice(at, 512))]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(m) for m in made], pa.int64()), pa.array([m[:SEEN_GRAMS].tobytes() for m in made], pa.binary())], names=["node", "members"])

    return run


def _counted(batches):
    """Packed n-grams to (gram, n), the sets of a batch that have it."""
    for batch in batches:
        held = [np.frombuffer(m.as_buffer(), np.int64) for m in batch.column("members")]
        gram, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(count.astype(np.int64))], names=["gram", "n"])


def common_grams(base: DataFrame, n: int) -> np.ndarray:
    """n-grams that several of some unlike texts have, sorted: the first texts of each part, a bounded number.
    They only say which marks are spared, so that results are the same whichever they are."""
    each = max(SEEN_OF_PART, -(-SEEN // max(1, base._jdf.queryExecution().toRdd().getNumPartitions())))
    some = base.select("text", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")).filter(F.col("at") < each)
    sets = some.select("text").mapInArrow(giving_back(_seen(n)), "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))
    counts = sets.select("members").mapInArrow(giving_back(_counted), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= COMMON_TEXTS).orderBy(F.desc("n"), "gram").limit(COMMON_MOST).select("gram")
    found = settle(found).collect()  # settled, so that its shuffles go before those of the marks come
    return np.sort(np.array([r.gram for r in found], np.int64).astype(np.uint64))


def _join(percent: int):
    """Sorted rows of (root, i, j) groups to links: edges that span the linked sets, and counts."""

    def one(cross: bool, rows: list) -> pa.RecordBatch | None:
        rows = list({(r[0], r[1]): r for r in rows}.values())  # a set can come twice, by equal rows
        rows.sort(key=lambda r: (r[0], r[1]))
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        split = next((k for k, r in enumerate(rows) if r[0] != rows[0][0]), None) if cross else None
        if cross and split is None:
            return None
        above, a, b, links = list(range(len(rows))), [], [], np.zeros(len(rows), dtype=np.int64)

        def top(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for i, j in trie_links(sets, percent, split):
            links[i] += rows[j][2]
            links[j] += rows[i][2]
            if (x := top(i)) != (y := top(j)):
                above[y] = x
                a.append(rows[i][1])
                b.append(rows[j][1])
        some = np.flatnonzero(links)
        if not len(some):
            return None
        return _rows(JOINED_SCHEMA, a=a + [rows[k][1] for k in some], b=b + [None] * len(some), links=[None] * len(a) + [int(links[k]) for k in some])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for root, i, j, chunk, node, copies, members in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "chunk", "node", "copies", "text")), strict=True):
                if (root, i, j) != key:
                    if len(rows) > 1 and (out := one(key[1] != key[2], rows)) is not None:
                        yield out
                    key, rows = (root, i, j), []
                rows.append((chunk, node, copies, members))
        if len(rows) > 1 and (out := one(key[1] != key[2], rows)) is not None:
            yield out

    return run


def _dealt(groups: DataFrame, percent: int) -> DataFrame:
    """Candidate components (root, node, least, copies, n) dealt into chunks that are joined
    with each other: each set with its chunk and the chunks that it meets.

    A component that is one chunk is joined at once. A larger one is dealt by size first:
    linked sets are of one class of sizes or of two that follow each other, so that a
    chunk meets the chunks of its own class and of the two beside it alone.
    """
    cells = lambda sets, most: F.greatest(F.ceil(sets / CHUNK_SETS), F.ceil(sets * most / CHUNK_CELLS)).cast("long")
    code = lambda c, h: c * F.lit(1 << 40) + h
    width = np.log(100 / percent) * 1.0001 if percent < 100 else 1e-9  # a little wide, for the sake of rounding
    sized = groups.withColumn("size", F.floor(F.log("n") / F.lit(float(width))).cast("long")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    w = Window.partitionBy("root")
    beside = w.orderBy("size")
    figures = sized.groupBy("root", "size").agg(F.count("*").alias("sets"), F.max("n").alias("most")).withColumn("chunks", cells(F.col("sets"), F.col("most")))
    figures = (
        figures.withColumn("whole", cells(F.sum("sets").over(w), F.max("most").over(w)))
        .withColumn("above", F.when(F.lead("size").over(beside) == F.col("size") + 1, F.lead("chunks").over(beside)))
        .withColumn("below", F.when(F.lag("size").over(beside) == F.col("size") - 1, F.lag("chunks").over(beside)))
        # a giant component is not one task: its sets meet the figures of their component under a salt
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    all_of = lambda c, k: F.when(F.col(k) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(k) - 1), lambda h: code(c, h))).otherwise(F.array().cast("array<long>"))
    size, zero = F.col("size"), F.lit(0).cast("long")
    met = F.concat(all_of(size, "chunks"), all_of(size + 1, "above"), all_of(size - 1, "below"))
    dealt = sized.join(figures.select("root", "size", "salt", "chunks", "whole", "above", "below"), ["root", "size", "salt"]).select(
        "root", "node", "copies",
        F.when(F.col("whole") == 1, zero).otherwise(code(size, F.pmod(F.xxhash64("node"), F.col("chunks")))).alias("chunk"),
        F.when(F.col("whole") == 1, F.array(zero)).otherwise(met).alias("others"),
        F.col("least.doc_id").alias("with_id"), F.col("least.text_hash").alias("with_hash"),
    )
    return settle(dealt)


def ngram_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Link documents (doc_id, text) whose sets of word n-grams have Jaccard similarity
    percent / 100 or more, exactly, and name the components of the links.

    Words are runs of other characters than ASCII spaces, A-Z lower-cased. Returns
    doc_id, n_shingles (set size), component_id (the smallest doc_id that links reach,
    the own one included), n_links (documents linked directly, copies counted), text_hash (xxhash64 of the text):
    a row for each row of docs. Null and empty texts have an empty set and no links; texts of
    fewer words than n have one gram. Equal rows are linked copies; a null doc_id counts
    as no id (a component of nulls alone has a null id); other columns are ignored.

    1. Documents with equal sets become one node, named by a 64-bit value of the set.
    2. The members' space is cut into so many parts that linked sets agree in one at
       least (`schemes`), parts of common n-grams spared (`common_grams`); equal parts give candidate
       edges, as stars, so that a group of k sets gives k - 1. No pair is lost and none is listed twice over.
    3. Each candidate component is joined by a trie of its globally ordered sets
       (`prefix_tree`); a large one is dealt out as pairs of bounded chunks.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    parts = parts_of(base, 64)
    buckets = parts * max(1, min(8, 24_000 // parts))  # a bucket is held at a time; a part has some
    found = settle(
        base.mapInArrow(giving_back(_mark(n, percent, buckets, common_grams(base, n))), FOUND)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(giving_back(_meet), FOUND)
        .drop("bucket", "marks", "owners")
    )
    own = found.filter("n IS NOT NULL")
    nodes = settle(own.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"), F.count("*").alias("copies"), F.min("n").alias("n")))
    near = components(found.filter("a IS NOT NULL").select("a", "b"))
    groups = settle(near.join(nodes.select("node", "least", "copies", "n"), "node"))
    pairs = (
        base.join(_dealt(groups, percent), F.col("doc_id").eqNullSafe(F.col("with_id")) & (F.col("text_hash") == F.col("with_hash")))
        .select("root", "node", "copies", "chunk", "others", "text")
        .mapInArrow(giving_back(_sets(n)), "root long, node long, copies long, chunk long, others array<long>, text binary")
        .withColumn("other", F.explode("others"))
        .select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "copies", "text")
        .repartition(parts, "root", "i", "j")
        .sortWithinPartitions("root", "i", "j")
    )
    linked = settle(pairs.mapInArrow(giving_back(_join(percent)), JOINED))
    joined = components(linked.filter("b IS NOT NULL").select("a", "b"))
    counts = linked.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", F.col("least.doc_id").alias("id"), "copies").join(joined, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = settle(named)
    firsts = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(firsts, "root").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return own.select("doc_id", "text_hash", "n", "node").join(named, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
    )
