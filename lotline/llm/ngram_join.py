"""N-gram Jaccard join by chosen paths.

A text is its set of word 5-grams, embedded by 64 min-hashes: two sets agree in as many
places as their Jaccard similarity says. Each run hashes the pairs (place, value) and a
set follows the few that hash low; as the hash is shared, similar sets follow the same
ones and meet in a bucket. A bucket that is too large is split again in the same way, by
hashes that depend on the path to it; small buckets are compared outright, and what stays
large is compared in blocks. Runs are repeated until the target recall.

Sets that may be similar form clusters, and within a cluster every pair is verified on
the full sets, so that the links are exact and no link depends on the estimates. Equal
sets count as one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lotline.llm.common import batch_task, stored, texts_of
from lotline.llm.graph import components, group_bounds, local_roots, sorted_groups
from lotline.operators.joins import Window

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.99999  # of pairs at the similarity

PLACES = 64  # min-hashes of a set
PATHS = 2  # places that a set follows per step, on average
AGREE = 35  # equal places of sets that are verified: five deviations below 0.8
BUCKET = 2048  # sets that are compared outright; a group of near copies below it is not split in vain
DEPTH = 3  # steps of a path; larger buckets at its end are compared in blocks
BLOCK_GRAMS = 1 << 20  # n-grams of a cluster that are verified in one task
BLOCK_SETS = 512  # and sets
COLUMNS = 4096  # n-grams per product of matrices

RUNS = math.ceil(math.log(1 - RECALL) / (SIMILARITY * PLACES * math.log(1 - PATHS / PLACES)))
SPLIT_RUNS = 2  # runs in a bucket that is split


def missed(splits: int) -> float:
    """Share of the pairs at the similarity that agree in too few places, or meet only in buckets that are
    split ``splits`` times and in none of those they are split into."""
    total = 0.0
    for equal in range(PLACES + 1):
        share = math.comb(PLACES, equal) * SIMILARITY**equal * (1 - SIMILARITY) ** (PLACES - equal)
        apart = 0.0  # chance that the pair is not compared, though it is in one bucket
        for runs in [SPLIT_RUNS] * splits + [RUNS]:
            apart = (1 - PATHS / PLACES * (1 - apart)) ** (runs * equal)
        total += share * (apart if equal >= AGREE else 1)
    return total


CACHED = 400_000
U64 = np.uint64
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(1, 2**63, NGRAM, dtype=np.uint64) * U64(2) + U64(1)
_A = _RNG.integers(1, 2**31, PLACES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, PLACES, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ngrams(text: str, seen: dict[str, int]) -> np.ndarray:
    """Hashes of the distinct word 5-grams of a text, sorted; shorter texts are one gram.

    Words are runs without white space, whatever their case.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(seen) > CACHED:
        seen.clear()
    for word in set(words).difference(seen):
        seen[word] = xxhash.xxh3_64_intdigest(word)
    codes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - NGRAM + 1, 1)
    grams = np.full(n, min(len(words), NGRAM), np.uint64)
    for i, factor in enumerate(_FACTORS[: len(words)]):
        grams += codes[i : i + n] * factor
    return np.unique(_mixed(grams))


def min_grams(grams: np.ndarray) -> np.ndarray:
    """The gram that hashes lowest, for each of the hash functions."""
    short = (grams >> U64(32)).astype(np.uint32)
    least = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    out = np.zeros(PLACES, np.uint64)
    for at in range(0, len(short), 8192):
        hashes = short[at : at + 8192] * _A[:, None] + _B[:, None]
        place = hashes.argmin(axis=1)
        lowest = hashes[np.arange(PLACES), place]
        lower = lowest <= least if at == 0 else lowest < least
        least, out = np.where(lower, lowest, least), np.where(lower, grams[at + place], out)
    return out


def digest(grams: np.ndarray) -> tuple[int, int]:
    """Two checksums of a set, the first of which names its class."""
    data = grams.tobytes()
    pair = np.array([xxhash.xxh3_64_intdigest(data), xxhash.xxh64_intdigest(data)], np.uint64).view(np.int64)
    return int(pair[0]), int(pair[1])


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size, sketch and paths of rows ``doc_id, text, print``."""
    seen: dict[str, int] = {}
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            grams = ngrams(text, seen)
            least = min_grams(grams) if len(grams) else None
            rows.append((*digest(grams), len(grams), least) if len(grams) else (None, None, 0, None))
        first, second, sizes, least = zip(*rows) if rows else ((),) * 4
        held = [i for i, one in enumerate(least) if one is not None]
        paths = [[] for _ in rows]
        if held:
            values = np.array([least[i] for i in held])
            for row, found in _followed(_mixed(values + np.arange(PLACES, dtype=np.uint64)), np.zeros(len(held), U64), RUNS):
                for i, path in zip(row.tolist(), found.tolist()):
                    paths[held[i]].append(path)
        sketches = [None if one is None else (_mixed(one) >> U64(48)).astype(np.uint16).tobytes() for one in least]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(first, pa.int64()),
                pa.array(second, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(sketches, pa.binary()),
                pa.array(paths, pa.list_(pa.int64())),
            ],
            names=["doc_id", "print", "key", "key2", "n_grams", "sketch", "paths"],
        )


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PLACES)


def _followed(values: np.ndarray, paths: np.ndarray, runs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per run, the rows and names of the paths that sets follow on from ``paths``."""
    below = U64(int(2**64 / PLACES * PATHS))
    for run in range(runs):
        salt = _mixed(paths + U64((run + 1) * 0x9E3779B97F4A7C15 % 2**64))
        hashes = _mixed(values ^ salt[:, None])
        rows, places = np.nonzero(hashes < below)
        yield rows, _mixed(hashes[rows, places] ^ salt[rows]).view(np.int64)


def path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, key`` of every place that a set follows on from ``path``."""
    for batch in batches:
        values = _sketches(batch.column("sketch")).astype(np.uint64)
        values = _mixed((values | np.arange(PLACES, dtype=np.uint64) << U64(16)) + U64(1))
        paths = np.asarray(batch.column("path")).astype(np.int64).view(np.uint64)
        keys = np.asarray(batch.column("key"))
        for rows, found in _followed(values, paths, SPLIT_RUNS):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(keys[rows])], names=["path", "key"])


def compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` that connect the sets of a bucket which agree in enough places.

    Rows are ``path, low, high`` (blocks), ``block, key, sketch``, sorted by the first three.
    """
    for table in sorted_groups(batches, 3):
        starts, sizes = group_bounds(table, 3)
        keys, blocks, low, high = (table.column(c).to_numpy() for c in ("key", "block", "low", "high"))
        values = _sketches(table.column("sketch"))
        out_a, out_b = [], []
        for size in np.unique(sizes):
            if size < 2:
                continue
            first = starts[sizes == size]
            step = max(1, 2_000_000 // int(size * size))
            for at in range(0, len(first), step):
                rows = first[at : at + step, None] + np.arange(size)
                linked = np.zeros((len(rows), size, size), bool)
                some = values[rows]
                agree = np.zeros((len(rows), size, size), np.uint8)
                for place in range(PLACES):
                    column = some[:, :, place]
                    agree += column[:, :, None] == column[:, None, :]
                linked = agree >= AGREE
                crossing = low[rows[:, 0]] != high[rows[:, 0]]
                if crossing.any():  # pairs within a block are compared in the bucket of that block
                    own = blocks[rows][:, :, None] == blocks[rows][:, None, :]
                    linked &= ~(own & crossing[:, None, None])
                linked &= ~np.eye(int(size), dtype=bool)
                for one in np.flatnonzero(linked.any(axis=(1, 2))):
                    roots = local_roots(linked[one])
                    moved = np.flatnonzero(roots != np.arange(size))
                    out_a.append(keys[rows[one][moved]])
                    out_b.append(keys[rows[one][roots[moved]]])
        if out_a:
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def blocked(rows: DataFrame, group: list[str], blocks: F.Column, spread: F.Column) -> DataFrame:
    """Each row once per pair of blocks (``low``, ``high``) that holds its own ``block``."""
    rows = rows.withColumn("__n", blocks.cast("long"))
    rows = rows.withColumn("block", F.pmod(spread, F.col("__n")))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    rows = rows.withColumns({"low": F.least("block", "__other"), "high": F.greatest("block", "__other")}).drop("__other", "__n")
    return rows.select(*group, "low", "high", "block", *(c for c in rows.columns if c not in {*group, "low", "high", "block"}))


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal keys next to each other in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links between sets (``key, sketch, paths``) that meet in a bucket and agree in enough places."""
    schema = "path long, key long"
    rows = classes.select(F.explode("paths").alias("path"), "key")
    links = None
    for depth in range(1, DEPTH + 1):
        counts = stored(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        met = rows.join(counts, "path")
        small = F.col("n") <= BUCKET
        ready = met.filter(small) if depth < DEPTH else met
        ready = ready.join(classes.select("key", "sketch"), "key")
        ready = blocked(ready, ["path"], F.when(small, 1).otherwise(F.ceil(F.col("n") / BUCKET)), F.xxhash64("key"))
        ready = _grouped(ready.select("path", "low", "high", "block", "key", "sketch"), ["path", "low", "high"])
        found = ready.mapInArrow(batch_task("ngram_join", "compare_batches"), "a long, b long").distinct()
        found = stored(found, "links")
        links = found if links is None else links.unionByName(found)
        if depth == DEPTH or not counts.filter(~small).take(1):
            return links
        large = met.filter(~small).join(classes.select("key", "sketch"), "key").select("key", "sketch", "path")
        rows = stored(large.mapInArrow(batch_task("ngram_join", "path_batches"), schema), "paths")


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of representatives, once each where rows repeat one; a text that is not of the class is left out."""
    seen: dict[str, int] = {}
    done: set[int] = set()
    for batch in batches:
        keys, data = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            grams = ngrams(text, seen) if key not in done else ()
            right = len(grams) > 0 and digest(grams)[0] == key
            if right:
                done.add(key)
            keys.append(right)
            data.append(grams.tobytes() if right else None)
        rest = [batch.column(name) for name in ("cluster", "key", "size", "n")]
        found = pa.RecordBatch.from_arrays([*rest, pa.array(data, pa.binary())], names=["cluster", "key", "size", "n", "grams"])
        yield found.filter(pa.array(keys, pa.bool_()))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of shared n-grams of every pair of sets."""
    n = len(sets)
    grams, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(one) for one in sets])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((n, n), np.float64)
    cuts = np.searchsorted(place, np.arange(0, len(grams) + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        held = np.zeros((n, min(COLUMNS, len(grams))), np.float32)
        held[row[a:b], place[a:b] - i * COLUMNS] = 1
        out += held @ held.T
    return out


def verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set, the documents of the sets it is linked to, and links that connect the sets of a group.

    Rows are ``cluster, low, high, block, key, size, n, grams``, sorted by the first three.
    A row of the result has ``n_links``, or an end ``b`` and whether its cluster is whole in the group.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_links", pa.int64()), ("whole", pa.bool_())])
    for table in sorted_groups(batches, 3):
        for start, count in zip(*group_bounds(table, 3)):
            group = table.slice(start, count)
            keys, blocks, sizes = (group.column(c).to_numpy() for c in ("key", "block", "size"))
            keys, first = np.unique(keys, return_index=True)  # rows that repeat a representative
            if len(keys) < 2:
                continue
            blocks, sizes = blocks[first], sizes[first]
            data = group.column("grams").take(pa.array(first)).to_pylist()
            sets = [np.frombuffer(one, np.uint64) for one in data]
            lengths = np.array([len(one) for one in sets], np.float64)
            shared = overlaps(sets)
            linked = shared >= SIMILARITY * (lengths[:, None] + lengths - shared) - 1e-9
            linked &= ~np.eye(len(keys), dtype=bool)
            if group.column("low")[0] != group.column("high")[0]:
                linked &= blocks[:, None] != blocks
            roots = local_roots(linked)
            moved = np.flatnonzero(roots != np.arange(len(keys)))
            hit = np.flatnonzero(linked.any(axis=1))
            whole = group.column("n")[0].as_py() == 1
            none, n = [None], len(hit)
            columns = [
                [*keys[hit].tolist(), *keys[moved].tolist()],
                [*none * n, *keys[roots[moved]].tolist()],
                [*(linked[hit] @ sizes).tolist(), *none * len(moved)],
                [whole] * (n + len(moved)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _printed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text, print``: id and print name a text, whatever ids repeat or are missing."""
    return texts_of(docs, doc_id, text).withColumn("print", F.unhex(F.md5(F.col("text").cast("binary"))))


def ngram_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, component_id, kept`` of every document.

    Two documents are linked when the Jaccard similarity of their word 5-grams is at least
    0.8. ``class_id`` is the smallest id with the same set, ``n_links`` the number of other
    documents linked directly, ``component_id`` the smallest id that links reach, and ``kept`` tells
    whether that is the document itself. A text of fewer than five words is one gram. Documents
    without words, NULL texts included, link with nothing and are kept. Rows that repeat an
    id, and rows without id, are documents of their own; a missing id comes after all others, so that
    ``class_id`` and ``component_id`` are NULL only where no document has an id, and all of those are kept.
    An empty table gives no rows; other columns are ignored.
    """
    known, told = _told(_printed(docs, doc_id, text))
    out = known.select("doc_id", "key").join(told, "key", "left")
    out = out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def without_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but for copies and near copies: one row of each group stays, one of its smallest id.

    Rows are told apart by id and text, so that those that share an id or have none count each for
    itself; among rows equal in both, the least by all columns stays. Texts without words all stay.
    """
    known, told = _told(_printed(docs, doc_id, text))
    name = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "print").alias("name")
    rows = known.filter("key is not null").select("key", name).join(told.select("key", "root"), "key")
    names = stored(rows.groupBy("root", "name").agg(F.count("*").alias("n")), "names")
    first = names.groupBy("root").agg(F.min("name").alias("first"), F.sum("n").alias("n_group"))
    marks = names.join(first.filter("n_group > 1"), "root")
    marks = marks.withColumn("stays", F.col("name") == F.col("first")).filter("not stays or n > 1")
    marks = stored(marks.select(F.col("name.doc_id").alias("__id"), F.col("name.print").alias("__print"), "stays"), "copies")

    # Most texts are in no group: they leave in the scan, by the bit set of the prints, and are never shuffled.
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.withColumn("__own", F.unhex(F.md5(whole.cast("binary"))))
    marked, others = Window(marks.select(F.col("__print").alias("__own")), ["__own"]).split(marked, ["__own"])
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__print"))
    out = marked.join(marks, same, "left_anti").unionByName(others).select(*docs.columns)
    again = marks.filter("stays")
    if not again.take(1):
        return out
    one = F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("one")
    repeated = marked.join(again, same, "left_semi").groupBy(F.col(f"`{doc_id}`").alias("__id"), "__own").agg(one)
    return out.unionByName(repeated.select("one.*"))


def _told(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, print, key`` of all texts, and ``key, root, class_id, n_links, component_id`` of every class.

    ``root`` names the component, also where no document of it has an id.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, print binary, key long, key2 long, n_grams long, sketch binary, paths array<long>"
    known = stored(rows.mapInArrow(batch_task("ngram_join", "sketch_batches"), schema), "sketches")
    classes = known.filter("key is not null").groupBy("key", "key2")
    classes = stored(
        classes.agg(
            F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "print")).alias("least"),
            F.count("*").alias("size"),
            F.first("n_grams").alias("n_grams"),
            F.first("sketch").alias("sketch"),
            F.first("paths").alias("paths"),
        ).withColumns({"class_id": F.col("least.doc_id"), "print": F.col("least.print")}).drop("least"),
        "classes",
    )
    clusters = components(candidate_links(classes)).select(F.col("id").alias("key"), F.col("root").alias("cluster"))
    members = stored(clusters.join(classes.select("key", "class_id", "print", "size", "n_grams"), "key"), "members")
    blocks = F.greatest(F.ceil(F.sum("n_grams") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_SETS))
    totals = members.groupBy("cluster").agg(blocks.alias("n"))
    members = stored(members.join(totals, "cluster"), "members")

    # Few texts are in a cluster: most others leave in the scan, by the bit set of the prints.
    texts = Window(members, ["print"]).cut(rows, ["print"])
    members = members.withColumnRenamed("print", "__print")
    texts = texts.join(members, F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("print") == F.col("__print")))
    texts = texts.select("text", "cluster", "key", "size", "n")
    schema = "cluster long, key long, size long, n long, grams binary"
    sets = texts.mapInArrow(batch_task("ngram_join", "gram_batches"), schema)
    sets = blocked(sets, ["cluster"], F.col("n"), F.xxhash64("key"))
    task = batch_task("ngram_join", "verify_batches")
    verified = _grouped(sets, ["cluster", "low", "high"]).mapInArrow(
        task, "a long, b long, n_links long, whole boolean"
    )
    verified = stored(verified, "verified")
    counts = verified.filter("n_links is not null").groupBy("a").agg(F.sum("n_links").alias("n_links"))
    ends = verified.filter("b is not null")
    stars = ends.filter("whole").select(F.col("a").alias("id"), F.col("b").alias("root"))
    stars = stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
    roots = stars.unionByName(components(ends.filter("not whole").select("a", "b")))
    named = classes.select("key", "class_id", "size")
    named = named.join(counts.withColumnRenamed("a", "key"), "key", "left")
    named = named.join(roots.withColumnRenamed("id", "key"), "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    told = stored(
        named.join(least, "root").select(
            "key",
            "root",
            "class_id",
            (F.col("size") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
            "component_id",
        ),
        "groups",
    )
    return known, told
