"""Near-duplicates by HyperMinHash with exact verification, and components of the links.

1. One pass over the texts makes, for each document, the set of its word shingles, a
   digest of the set, and a HyperMinHash: the hash space is split into buckets, and each
   bucket keeps the number of leading zeros and a few mantissa bits of its least hash, in
   one byte. Sets too small to fill all buckets are hashed again, round by round, until
   they do; hashes of a later round count as larger, so a register still agrees with the
   chance that is the similarity, and short texts share no keys for being short.
2. Documents with equal sets are one class (a group-by on the digest with partial
   aggregation); from here on only class representatives are compared.
3. Bands of registers are candidate keys. Each key has a centre, its class that shares
   most keys with others, and every class of the key is compared with the centre only (a
   star), which is linear in the key's classes however large the key is.
4. Candidates are filtered by the collision-corrected Jaccard estimate of the registers,
   with a margin of several standard errors, and verified on full shingle sets. A star
   with outliers is set once more around the class closest to its majority.
5. Verified stars are contracted into components. What may be left are links between two
   classes x and y of a star in different components. With the differences X = x ^ a and
   Y = y ^ a from the centre, and F(x) = (100 + s) |X| - (100 - s) |x| for s hundredths of
   similarity, x and y are linked just if 2 (100 + s) |X & Y| >= F(x) + F(y). So the
   differences are joined by prefix filtering, the elements that fewest classes of the
   star differ in first, with a bound on what can follow a common element. Within an
   element, classes of its commonest component are not compared with one another.
   What is left is estimated, then verified by intersecting the differences themselves.

No link between different texts within a key is lost; members of one component need no
further comparison. Copies with edits of their own share no element of their prefixes
with other copies, so a group of m edited copies costs some m rows, not m * m. Classes
that are neither linked nor in one component but share rare differences are compared.

Verification streams: the members of a star are read one by one against its centre, in
chunks bounded in bytes, so a group of any size is neither collected nor in one task.
Tables that a hot centre joins are written first, so that Spark can split the join.

Edge cases: null and empty texts have empty sets and are linked with nothing; texts with
fewer words than a shingle are one shingle; rows that share an id are one document, linked
with whatever any of its texts is linked with, and each reports its own set's size; null
ids are linked with nothing and have a null component; an empty table gives an empty
result; further columns are not read (`keep_first` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, broadcastable, drop, fresh, python_workers, session, staged, tidy

#: Buckets of the sketch, registers in a band. At a similarity of 0.8 a pair shares no
#: band with a probability of (1 - 0.8 ** 6) ** 32, some 6 in 100,000.
BUCKETS, BAND = 192, 6
#: Hashes that fill the buckets in most cases; more rounds follow where they do not.
ROUND_HASHES = 1_200
#: A register: leading zeros (at most 14) and mantissa bits, moved on by the round; 0 is an empty bucket.
MANTISSA = 4
#: Chance that registers of unlike buckets agree, and the margin for estimates, in standard
#: errors at the similarity asked for: some 3 in 100,000 estimates fall below it.
COLLISION = 0.021
MARGIN = 4.0
#: Texts (bytes) that one task compares with one centre, about.
CHUNK_BYTES = 512 << 10
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
KNOWN_WORDS = 200_000


class _Words(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = out
        return out


_WORDS = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Bytes are lower-cased and split, which affects A-Z and ASCII white space alone.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _MUL + h[k : len(h) - n + 1 + k])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash of a set: one byte per bucket, leading zeros above mantissa bits, moved on by the round, plus one."""
    out = np.zeros(BUCKETS, np.uint8)
    n = len(hashes)
    if not n:
        return out
    least, empty = np.full(BUCKETS, np.iinfo(np.int64).max), np.iinfo(np.int64).max
    step = -(-ROUND_HASHES // n)
    for first in count(0, step):
        rounds = np.arange(first, first + step, dtype=np.uint64)[:, None]
        h = _mixed(_mixed(hashes * _MIX + _MUL)[None, :] + rounds * _MIX2)
        bucket = ((h >> np.uint64(48)) * np.uint64(BUCKETS)) >> np.uint64(16)
        value = (h & np.uint64((1 << 48) - 1)) | (rounds << np.uint64(48))
        np.minimum.at(least, bucket.astype(np.int64).ravel(), value.astype(np.int64).ravel())
        if least.max() < empty:
            break
    v = least & ((1 << 48) - 1)
    top = 48 - np.frexp(v.astype(np.float64))[1]  # leading zeros in 48 bits
    zeros = np.minimum(top, 14)
    rest = np.where(v > 0, 48 - top - 1, 0)  # bits below the leading one
    mantissa = np.where(rest >= MANTISSA, v >> np.maximum(rest - MANTISSA, 0), v << np.maximum(MANTISSA - rest, 0)) & ((1 << MANTISSA) - 1)
    return (((zeros << MANTISSA | mantissa) + 97 * (least >> 48)) % 255 + 1).astype(np.uint8)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for chance agreement."""
    same = ((a == b) & (a > 0)).sum(1) / BUCKETS
    return np.clip((same - COLLISION) / (1 - COLLISION), 0, 1)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, n_bytes, digest (of the set), sketch, for every row."""
    import hashlib

    import pyarrow as pa

    python_workers(session(docs))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def made(batches: Iterator[Any]) -> Iterator[Any]:
        for b in batches:
            n, size, digest, sketch = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                n.append(len(s))
                size.append(len(t or ""))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "n_bytes", "digest", "sketch"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"doc_id {kind}, n_shingles bigint, n_bytes bigint, digest binary, sketch binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """id, key: a row per band of registers."""
    bands = f"transform(sequence(0, {BUCKETS // BAND - 1}), i -> xxhash64(i, substring(sketch, i * {BAND} + 1, {BAND})))"
    return classes.select("id", F.explode(F.expr(bands)).alias("key"))


def centred_keys(keys: DataFrame) -> DataFrame:
    """id, key, a, known: the keys that two classes or more share, with the centre.

    The centre is the class that shares most, summed over its keys: of edited copies, one
    that is close to what they were made from.
    """
    counts = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "counts")
    shared = staged(keys.join(counts, "key"), "shared")
    known = shared.groupBy("id").agg(F.sum("m").alias("known"))
    shared = staged(shared.join(known, "id"), "known")
    first = staged(shared.groupBy("key").agg(F.max(F.struct("known", "id")).alias("first")), "first")
    return shared.join(first, "key").select("id", "key", F.col("first.id").alias("a"), F.col("first.known").alias("known"))


def _close(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose estimate reaches `least` less the margin, with their columns; `a` and `b` name the classes."""
    import pyarrow as pa

    side = lambda x: classes.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, "sa", "sb")
    bound = least - MARGIN * np.sqrt(least * (1 - least) / BUCKETS)

    def kept(batches: Iterator[Any]) -> Iterator[Any]:
        for t in batches:
            n = t.num_rows
            if n:
                sa, sb = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint8).reshape(n, BUCKETS) for k in (-2, -1))
                found = pa.RecordBatch.from_arrays(t.columns[:-2], names=t.schema.names[:-2])
                yield found.filter(pa.array(estimated(sa, sb) >= bound))

    return both.mapInArrow(kept, pairs.schema)


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, words: int, least: float, name: str) -> DataFrame:
    """a, b, na, n, linked, differs: whether the full sets of centre a and member b reach
    `least`, their sizes and their difference.

    Members are dealt to (centre, chunk) by bytes; each chunk gets the centre's text once,
    sorted before its members, and is a stream.
    """
    import pyarrow as pa

    hundredths = round(100 * least)
    pairs = staged(pairs, f"{name}-pairs")
    tidy(session(pairs))
    kind = pairs.schema["a"].dataType.simpleString()
    size = classes.select(F.col("id").alias("b"), "n_bytes")
    chunks = pairs.join(size, "b").groupBy("a").agg(F.ceil(F.sum("n_bytes") / F.lit(CHUNK_BYTES)).cast("int").alias("chunks"))
    chunks = staged(chunks.select("a", F.greatest("chunks", F.lit(1)).alias("chunks")), f"{name}-chunks")
    members = pairs.join(chunks, "a").select("a", F.expr("cast(pmod(xxhash64(b), chunks) as int)").alias("chunk"), "b")
    members = members.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "chunk", "b", "text")
    centres = chunks.join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(None).cast(kind).alias("b"), "text")
    rows = members.unionByName(centres).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def compared(batches: Iterator[Any]) -> Iterator[Any]:
        centre = np.empty(0, np.uint64)
        for t in batches:
            out: list[tuple] = []
            for a, b, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True):
                s = shingle_set(text, words)
                if b is None:
                    centre = s
                else:
                    d = difference(centre, s)
                    out.append((a, b, len(centre), len(s), (100 + hundredths) * len(d) <= (100 - hundredths) * (len(s) + len(centre)), d))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (t.schema.field(0).type, t.schema.field(1).type, pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "na", "n", "linked", "differs"])

    return rows.select("a", "b", "text").mapInArrow(compared, f"a {kind}, b {kind}, na bigint, n bigint, linked boolean, differs array<bigint>")


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The elements of one of two sorted distinct arrays, as signed integers."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    alone = np.ones(len(both), bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    return both[alone].view(np.int64)


def _recentred(stars: DataFrame) -> DataFrame:
    """(a, b, known): stars with outliers once more, around the class closest to the majority.

    An element that more than half of a star's classes differ in from the centre is in most
    of them, or the centre's own; the class whose difference is closest to these elements
    becomes the centre a of all classes b of the star, if it is not the centre already.
    """
    size = staged(stars.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.bool_and("linked").alias("all")).where("not all").select("a", "m"), "star-sizes")
    near = staged(stars.select("a", "b", "differs").join(size, "a"), "mixed-stars")
    each = near.select("a", "b", "m", F.explode("differs").alias("e"))
    major = staged(each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("df"), F.first("m").alias("m")).where("2 * df > m").select("a", "e"), "major")
    of = major.groupBy("a").agg(F.count(F.lit(1)).alias("majority"))
    held = each.join(major, ["a", "e"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("held"))
    off = near.select("a", "b", F.size("differs").alias("d")).join(held, ["a", "b"], "left").selectExpr("a", "b", "d - 2 * coalesce(held, 0) as off")
    # |difference ^ majority| = d + majority - 2 * held; the centre itself is `majority` away
    best = off.groupBy("a").agg(F.min(F.struct("off", "b")).alias("best")).where("best.off < 0").join(of, "a").join(size, "a")
    best = staged(best.select("a", F.col("best.b").alias("c"), "m"), "best")
    members = near.select("a", "b").union(best.select("a", F.col("a").alias("b")))
    moved = members.join(best, "a").where("b <> c").select(F.col("c").alias("a"), "b", "m")
    return moved.groupBy("a", "b").agg(F.max("m").alias("known"))


def _of_differences(stars: DataFrame, comp: DataFrame, centres: DataFrame, least: float) -> DataFrame:
    """(a, x, y): pairs of classes of one star, in different components, that may be linked.

    A class linked with the centre needs prefixes against outliers only (bucket kind 'L'),
    whose F is above (100 - s) |a|. Of two outliers (kind 'O'), the one with the smaller F
    is found by the prefix that its own F asks for.

    Each class has a main centre, the best known one of its stars. Two classes with the same
    main centre are joined there only: it is closest to what they were edited from, so
    their differences from it are mostly edits of their own.
    """
    s = round(100 * least)
    main = stars.select("a", "b").join(centres, "a").groupBy("b").agg(F.max_by("a", F.struct("known", "a")).alias("main"))
    stars = stars.join(main, "b").join(comp.select(F.col("id").alias("b"), "comp"), "b")
    stars = stars.withColumn("d", F.size("differs").cast("long")).withColumn("f", F.expr(f"{100 + s} * d - {100 - s} * n"))
    facts = ["a", "b", "comp", "main", "n", "na", "linked", "d", "f"]
    each = staged(stars.select(*facts, F.explode("differs").alias("e")), "each")
    df = staged(each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    # elements of one class alone come first in its order and meet no other
    held = each.join(df, ["a", "e"]).groupBy(*facts).agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    prefix = lambda overlap: f"(d - ceil(({overlap}) / {2 * (100 + s)}D) + 1)"
    outlier, low = f"{100 - s} * na + 1", f"{100 + s} - {100 - s} * na * 100 div {s}"
    held = held.withColumn("first", F.expr("d - size(es)"))
    held = held.withColumn("to_l", F.expr(f"least(d, {prefix(f'f + if(linked, {outlier}, {low})')})"))
    held = held.withColumn("to_o", F.expr(f"if(linked, 0L, least(d, {prefix(f'f + {outlier}')}))"))
    held = held.withColumn("to_own", F.expr(f"if(linked, 0L, least(d, {prefix('f + f')}))"))
    cut = F.expr("posexplode(slice(es, 1, greatest(0, cast(greatest(to_l, to_o) - first as int))))").alias("k", "at")
    rows = held.select(*facts, "first", "to_l", "to_o", "to_own", cut).withColumn("pos", F.expr("first + k"))
    kinds = "filter(array(if(pos < to_l, 'L', null), if(pos < to_o, 'O', null)), x -> x is not null)"
    rows = rows.select(*facts, "pos", "to_own", F.col("at.e").alias("e"), F.explode(F.expr(kinds)).alias("kind"))
    rows = rows.withColumn("probe", F.expr("not linked")).withColumn("index", F.expr("if(kind = 'L', linked, pos < to_own)"))
    rows = staged(rows.drop("to_own", "linked", "na"), "prefixes")
    by_comp = rows.groupBy("a", "e", "kind", "comp").agg(F.count(F.lit(1)).alias("m"), F.max("probe").alias("probe"), F.max("index").alias("index"))
    buckets = by_comp.groupBy("a", "e", "kind").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"), F.max("probe").alias("p"), F.max("index").alias("i"))
    buckets = staged(buckets.where("comps > 1 and p and i").select("a", "e", "kind", "most"), "buckets")
    rows = staged(rows.join(buckets, ["a", "e", "kind"]), "bucketed")
    # classes of a bucket's commonest component meet only those of others
    side = lambda x, tags: [F.explode(F.expr(tags)).alias("tag"), "a", "e", "kind", *(F.col(c).alias(f"{c}{x}") for c in ("b", "comp", "main", "n", "d", "f", "pos"))]
    left = rows.where("probe").select(*side("x", "if(comp = most, array(false), array(true, false))"))
    right = rows.where("index").select(*side("y", "array(comp = most)"))
    may = (
        "compx <> compy and (kind = 'L' or fy < fx or (fy = fx and by < bx)) and not (mainx = mainy and mainx <> a) "
        f"and 100 * least(nx, ny) >= {s} * greatest(nx, ny) and {2 * (100 + s)} * least(dx - posx, dy - posy) >= fx + fy"
    )
    return left.join(right, ["a", "e", "kind", "tag"]).where(may).select("a", F.col("bx").alias("x"), F.col("by").alias("y")).distinct()


def _linked_by_differences(found: DataFrame, stars: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs x, y of `found` whose differences from their centre show that they are linked."""
    s = round(100 * least)
    side = lambda x: stars.select("a", F.col("b").alias(x), F.col("n").alias(f"n{x}"), F.col("differs").alias(f"d{x}"))
    both = found.join(side("x"), ["a", "x"]).join(side("y"), ["a", "y"])
    apart = "(size(dx) + size(dy) - 2 * size(array_intersect(dx, dy)))"
    return both.where(f"{100 + s} * {apart} <= {100 - s} * (nx + ny)").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """id, comp: for each node of `nodes` the least id that links reach, by alternating star contractions.

    Each round hangs the larger neighbours of a node, then all but the least of its
    smaller ones, below its least neighbour; the tables stay as large as the links and
    the number of rounds grows with the logarithm of a component. Ends when no edge moves.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    before = None
    for k in count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low-{k}")
        # edges point down from u to v, so a node's larger neighbours are the u of its rows
        large = staged(edges.select(F.col("u").alias("w"), F.col("v").alias("u")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large-{k}")
        # every node is again above its neighbour; now the smaller ones meet at the least
        small = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small-{k}")
        moved = large.join(small, "u").select(F.expr("if(v = m, u, v)").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, edges = [edges, low, large, small], staged(moved, f"{name}-{k}")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop(*old)
        tidy(session(edges))
        if mark == before:
            break
        before = mark
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _linked(rows: DataFrame, words: int, least: float, also: DataFrame | None = None) -> DataFrame:
    """id, n_shingles, comp for each row (id, text), whose ids are distinct; `also` are further links (a, b)."""
    made = staged(sketches(rows, words, "id", "text"), "sketches")
    texts = rows.where("id is not null and text is not null")
    of_class = F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "n_bytes", "sketch"))
    classes = made.where("doc_id is not null and n_shingles > 0").groupBy("digest").agg(of_class.alias("x"))
    classes = staged(classes.select("digest", "x.*"), "classes")

    keys = staged(centred_keys(band_keys(classes)), "keys")
    pairs = staged(keys.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    # only the texts of classes in pairs are read on
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "paired")
    texts = staged(texts.join(F.broadcast(ids) if broadcastable(ids) else ids, "id", "left_semi"), "texts")
    stars = staged(_verified(_close(pairs, classes, least), texts, classes, words, least, "star"), "stars")
    again = staged(_recentred(stars), "again")
    moved = _verified(_close(again.select("a", "b"), classes, least), texts, classes, words, least, "moved")
    stars = staged(stars.unionByName(moved).dropDuplicates(["a", "b"]), "all-stars")
    links = stars.where("linked").select("a", "b")
    comp = staged(components(classes.select("id"), links, "star"), "comp")

    # stars with several components: the differences of all their classes, near the centre or not
    members = pairs.unionByName(again.select("a", "b")).distinct().join(comp.select(F.col("id").alias("b"), "comp"), "b")
    members = staged(members, "members")
    mixed = staged(members.groupBy("a").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("a"), "mixed")
    members = staged(members.join(mixed, "a").select("a", "b"), "mixed-members")
    far = _verified(members.join(stars.select("a", "b"), ["a", "b"], "left_anti"), texts, classes, words, least, "far")
    stars = staged(stars.join(members, ["a", "b"]).select(*stars.columns).unionByName(far), "mixed-stars")
    # a centre that was chosen for a majority goes before all others
    centres = keys.select("a", "known").union(again.selectExpr("a", f"known + {1 << 60}")).groupBy("a").agg(F.max("known").alias("known"))
    found = staged(_of_differences(stars, comp, staged(centres, "centres"), least), "found")
    close = _close(found.select("a", "x", "y").toDF("centre", "a", "b"), classes, least).toDF("a", "x", "y")
    more = _linked_by_differences(close, stars, least).unionByName(stars.where("linked").select("a", "b"))

    labelled = classes.join(comp, "id").select("digest", "comp")
    label = made.join(labelled, "digest", "left").select(F.col("doc_id").alias("id"), "n_shingles", F.expr("if(doc_id is null, null, coalesce(comp, doc_id))").alias("comp"))
    label = staged(label, "label")
    # the links found last join components
    end = lambda x: label.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
    more = more if also is None else more.unionByName(also)
    joins = staged(more.join(end("a"), "a").join(end("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "joins")
    if joins.isEmpty():
        return label
    final = components(joins.select(F.col("a").alias("id")).union(joins.select("b")).distinct(), joins, "all")
    final = staged(final.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "final")
    final = F.broadcast(final) if broadcastable(final) else final
    return label.join(final, "comp", "left").select("id", "n_shingles", F.coalesce("top", "comp").alias("comp"))


def link_documents(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links are pairs of sets with a similarity of `least` or more."""
    return _link(docs, words, least, id_col, text_col)[0]


def _link(docs: DataFrame, words: int, least: float, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(the result of `link_documents`, whether no two rows share an id)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = F.expr("doc_id <=> component_id").alias("kept")
    with Scratch(session(docs)) as scratch:
        unique = rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
        out = (_linked if unique else _linked_by_text)(rows, words, least).toDF("doc_id", "n_shingles", "component_id")
        return scratch.keep(out.select("*", kept), "near-duplicates"), unique


def _linked_by_text(rows: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id, n_shingles, component_id for rows (id, text) of which some share an id: one node for each text of an id."""
    node = F.concat_ws(":", F.col("id").cast("string"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = rows.withColumn("node", F.when(F.col("id").isNotNull(), node))
    nodes = staged(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("text").alias("text")), "nodes")
    same = nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    also = nodes.join(same, "id").where("node <> a").select("a", F.col("node").alias("b"))
    got = staged(_linked(nodes.select(F.col("node").alias("id"), "text"), words, least, also), "by-text")
    least_id = staged(got.join(nodes.select(F.col("node").alias("id"), F.col("id").alias("doc_id")), "id").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least-id")
    got = got.join(least_id, "comp").select(F.col("id").alias("node"), "n_shingles", "component_id")
    known = rows.where("node is not null").select("id", "node").join(got, "node").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
    null = sketches(rows.where("id is null"), words, "id", "text").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(null)


def keep_first(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document has the least id of its component, with their own columns.

    Of rows that share that id one stays, with the least of their texts. Rows with a null id all stay.
    """
    gone_id, kept_text = fresh(docs, "_gone_id"), fresh(docs, "_kept_text")
    linked, unique = _link(docs, words, least, id_col, text_col)
    is_same = F.col(id_col) == F.col(gone_id)
    gone = linked.where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    left = docs.join(F.broadcast(gone) if broadcastable(gone) else gone, is_same, "left_anti")
    if unique:
        return left
    again = staged(linked.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(gone_id)).count().where("count > 1").select(gone_id), "repeated")
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = left.join(again, is_same).groupBy(gone_id).agg(F.min(text).alias(kept_text))
    one = left.join(first, is_same & (text == F.col(kept_text))).select(*docs.columns).dropDuplicates([id_col])
    return left.join(again, is_same, "left_anti").unionByName(one)
