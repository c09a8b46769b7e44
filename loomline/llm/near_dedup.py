"""Near-duplicate detection by one-permutation MinHash.

1. A task turns each text into its set of hashed word shingles and signs it with one permutation: the
   hash's leading bits name a bin, the bin's least hash is its value, and an empty bin borrows that of a
   bin chosen by a fixed random sequence (optimal densification). Bands of values are bucket keys.
   Rows with equal sets are one node from here on, however many they are.
2. In each bucket of two or more nodes one is the centre of a star: the one with most company over all
   its buckets. The star's edges are the candidates, so a bucket gives one less than it has nodes.
3. Candidates are confirmed on their full sets, and links make components.
4. Where a bucket still has nodes of several components, a task compares the signatures, a byte a value, of
   those outside the bucket's largest component with all others; pairs of other components stay if the
   estimate isn't five standard errors below the threshold. Two bytes of each shingle's hash then bound their
   intersection from above, and each such node's most similar few that remain are candidates.
   The nodes of buckets over BLOCK aren't compared by bucket: they meet by their rarest shingles instead
   (a prefix filter, exact for any order of shingles), and a shingle of many nodes is split into tiles.
   Rounds go on, with more candidates each, until every node has had all of its own confirmed. A link is lost
   only when its ends share no bucket or estimate that low, at similarity 0.8 a few times in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .batches import by_bytes

BANDS, ROWS = 42, 6
#: Leaves that one copy of a centre's text serves.
HUB = 2000
#: Candidates of a node in the first round over open buckets; each further round has as many times more.
FIRST = 32
#: Shingles of a set at most of which ``likely`` gets two bytes each; larger sets go by their estimates alone.
SMALL = 4096
#: Nodes of an open bucket that are compared in one place, and of each side of a tile.
BLOCK = 1024
#: Nodes whose shingles are counted, and counted shingles that are kept, to order shingles by how common they are.
SAMPLE, COMMON = 10_000, 400_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits look random (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``words`` words.

    A-Z count as a-z; words end at ASCII white space. A text of fewer words is one shingle, and one
    without words, or null, has none.
    """
    import xxhash

    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    at = cut.offsets.to_numpy().astype(np.int64)
    flat = cut.values.slice(at[0], at[-1] - at[0])
    full = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)])
    at = full[at - at[0]]
    coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = min(words, hi - lo)
        if not n:
            out.append(h[:0])
            continue
        acc = np.full(hi - lo - n + 1, np.uint64(n))
        for k in range(n):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[lo + k : hi - n + 1 + k])
        acc.sort()
        out.append(acc[np.concatenate([[True], acc[1:] != acc[:-1]])])
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures of non-empty sets, densified."""
    sig, full = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for j, s in enumerate(sets):
        own = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sig[j, own[first]] = s[first]
        full[j, own[first]] = True
    rng = np.random.default_rng(11)
    row, col = np.nonzero(~full)
    filled = sig.copy()
    while len(row):
        source = rng.integers(0, bins, bins)[col]
        ok = full[row, source]
        filled[row[ok], col[ok]] = sig[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    return filled


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    parts = sig.reshape(len(sig), bands, rows)
    for k in range(rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return acc.view(np.int64)


def sign(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """(id, text) -> (id, n, set_key, bands, sketch); for an empty set set_key is null.

    sketch: one byte of each value of the signature.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            full = np.array([len(s) > 0 for s in sets], bool)
            sig = signatures([s for s in sets if len(s)], bands * per_band)
            keys, sketch = band_keys(sig, bands, per_band), iter(mix(sig).astype(np.uint8))
            at = np.concatenate([[0], np.cumsum(full) * bands]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists, pa.array([next(sketch).tobytes() if f else None for f in full], pa.binary())], names=["id", "n", "set_key", "bands", "sketch"])

    return rows.mapInArrow(run, "id long, n long, set_key binary, bands array<long>, sketch binary")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts: (id, text), one or more rows an id.

    Each pair's texts meet at its b; an a with many pairs is copied for each few thousand of them.
    """
    roles = pairs.select(F.col("a").alias("id"), F.col("b").alias("leaf")).union(pairs.select("b", "b").distinct().toDF("id", "leaf"))
    degree = roles.groupBy("id").agg(F.ceil(F.count("*") / HUB).alias("copies"))
    roles = roles.join(degree, "id").select("id", "leaf", F.pmod(F.xxhash64("leaf"), "copies").alias("copy"))
    copied = texts.join(degree, "id").select("id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    met = roles.join(copied, ["id", "copy"]).select("leaf", (F.col("id") != F.col("leaf")).alias("other"), "id", "text")
    met = met.repartition("leaf").sortWithinPartitions("leaf", "other")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, own = None, []
        for batch in by_bytes(batches, "text"):
            a, b = [], []
            for key, other, doc, s in zip(*(batch.column(c).to_pylist() for c in ("leaf", "other", "id")), shingle_sets(batch.column("text"), words), strict=True):
                if key != leaf:
                    leaf, own = key, []
                if not other:
                    own.append(s)
                    continue
                for t in own:
                    small, large = (s, t) if len(s) <= len(t) else (t, s)
                    if 100 * len(small) < percent * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        a.append(doc)
                        b.append(leaf)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every end of a link; comp is the smallest id reachable. Links: (a, b), a != b.

    Alternating large and small stars: each step links a node's neighbours to its smallest one. Steps
    end when every node has one parent, which has none.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a smallest node keeps its neighbours
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = scratch.write_table(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).distinct(), "near-stars")
        roles = edges.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)").isEmpty():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())


def small_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, small): two bytes of each shingle's hash; none for sets over SMALL, or where rows of an id differ."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text"), words)
            small = [(s >> np.uint64(48)).astype("<u2").tobytes() if len(s) <= SMALL else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(small, pa.binary())], names=["id", "small"])

    same = F.min("small") == F.max("small")
    return texts.mapInArrow(run, "id long, small binary").groupBy("id").agg(F.when(same, F.min("small")).otherwise(F.lit(b"")).alias("small"))


def common_shingles(texts: DataFrame, words: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most common shingles, and in how many of about SAMPLE of the ``nodes`` texts each is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(batch.column("text"), words) or [np.zeros(0, np.uint64)]).view(np.int64))], names=["shingle"])

    chosen = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < min(1.0, SAMPLE / nodes) * 1_000_003
    counts = scratch.write_table(texts.where(chosen).select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("texts")), "near-common")
    least = max(2, (counts.agg(F.sum("texts")).first()[0] or 0) // COMMON + 1)
    got = counts.where(F.col("texts") >= least).toArrow()
    shingle, n = got.column("shingle").to_numpy().view(np.uint64), got.column("texts").to_numpy()
    at = np.argsort(shingle)
    return shingle[at], n[at]


def prefix(s: np.ndarray, percent: int, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set one of which it shares with every set similar enough and no larger, and how many
    of them, the first, are such for every set no smaller."""
    n = len(s)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, counts[at], 0)
    # s is sorted: equal ranks are in order of their hashes, in every set the same
    least, equal = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
    return s[np.argsort(rank, kind="stable")[: n - least + 1]], n - equal + 1


def prefixes(texts: DataFrame, words: int, percent: int, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(id, shingle, lead): two similar sets share a shingle here that is a lead of the smaller (of either, if equal)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            out = [(doc, *prefix(s, percent, common, counts)) for doc, s in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text"), words), strict=True) if len(s)]
            if out:
                ids, own, lead = (np.concatenate(c) for c in zip(*((np.full(len(x), doc, np.int64), x.view(np.int64), np.arange(len(x)) < k) for doc, x, k in out), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), pa.array(lead)], names=["id", "shingle", "lead"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingle long, lead boolean").groupBy("id", "shingle").agg(F.max("lead").alias("lead"))


def tiles(rows: DataFrame) -> DataFrame:
    """(key, inside, id, n, comp) from rows (id, n, comp, shingle, lead): for ``likely``, blocks of at most about BLOCK
    held nodes and as many others.

    Of the nodes of a shingle, leads outside its largest component meet each other and all others, and leads
    inside it meet the others outside. Either side is dealt into parts, and each pair of parts is a tile.
    """
    rows = scratch.write_table(rows, "near-prefixes")
    sizes = rows.groupBy("shingle", "comp").agg(F.count("*").alias("c"), F.count_if("lead").alias("l"))
    top = F.max(F.struct("c", "comp", "l"))
    sums = sizes.groupBy("shingle").agg(F.count("*").alias("comps"), F.sum("c").alias("all"), F.sum("l").alias("leads"), top.alias("top"))
    outer, inner = F.col("leads") - F.col("top.l"), F.col("top.l")
    rest, other = F.col("all") - outer, F.col("all") - F.col("top.c") - outer
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    meets = (F.col("comps") > 1) & ((outer > 0) | ((inner > 0) & (other > 0)))
    known = sums.select("shingle", "all", F.col("top.comp").alias("main"), meets.alias("meets"), (outer > 0).alias("a"), ((inner > 0) & (other > 0)).alias("b"), parts(outer).alias("ka"), parts(rest).alias("ra"), parts(inner).alias("kb"), parts(other).alias("rb"))
    known = scratch.write_table(known.where((F.col("all") > BLOCK) | F.col("meets")), "near-shingles")
    # a shingle of many nodes is no key of a shuffle
    hot = rows.join(F.broadcast(known.where(F.col("all") > BLOCK)), "shingle", "left")
    cold = hot.where("main is null").select(*rows.columns).join(known.where(F.col("all") <= BLOCK), "shingle")
    met = hot.where("meets").unionByName(cold)

    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    part = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.col(k)).cast("int")
    tile = lambda kind, i, j, inside: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), inside.alias("inside"))
    no, yes = F.lit(False), F.lit(True)
    none = F.array().cast("array<struct<kind:string,i:int,j:int,inside:boolean>>")
    # the others' part 0 goes with the tiles of the leads outside that meet each other
    i = part("ka")
    own = F.concat(F.transform(upto("ka"), lambda j: tile("a", F.least(i, j), F.greatest(i, j), j < i)), F.transform(F.slice(upto("ra"), 2, F.col("ra")), lambda j: tile("r", i, j, no)))
    j = part("ra")
    others = F.transform(upto("ka"), lambda i: F.when(j == 0, tile("a", i, i, yes)).otherwise(tile("r", i, j, yes)))
    outside, lead = F.col("comp") != F.col("main"), F.col("lead")
    first = F.when(~F.col("a"), none).when(outside & lead, own).otherwise(others)
    second = F.when(F.col("b") & ~outside & lead, F.transform(upto("rb"), lambda j: tile("b", part("kb"), j, no))).when(F.col("b") & outside & ~lead, F.transform(upto("kb"), lambda i: tile("b", i, part("rb"), yes))).otherwise(none)
    dealt = met.select("shingle", "id", "n", "comp", F.explode(F.concat(first, second)).alias("t"))
    return dealt.select(F.xxhash64("shingle", "t.kind", "t.i", "t.j").alias("key"), "t.inside", "id", "n", "comp")


def likely(most: int, percent: int, width: int):
    """mapInArrow over open buckets, rows (key, inside, id, n, comp, sketch, small) in order of key and inside: candidates.

    The nodes outside the bucket's largest component (or a tile's first side), which come first, are held;
    those inside stream past. Each node outside gets its ``most`` best partners of other components; ``total`` is how many
    would do.
    """
    least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / width)

    class Bucket:
        def __init__(self, key: int):
            self.key, self.parts, self.best, self.total, self.cols = key, [], None, None, None
            self.mark = np.zeros(1 << 16, bool)

        def seal(self) -> None:
            """All nodes outside are known: compare them among themselves."""
            self.cols = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            m = len(self.cols[0])
            self.best, self.total = [[] for _ in range(m)], np.zeros(m, np.int64)
            self.meet(self.cols, earlier=True)

        def may(self, one: np.ndarray, others: list[np.ndarray], n: int, sizes: np.ndarray) -> np.ndarray:
            """Whether each pair's intersection, counted by equal two bytes, is large enough."""
            length = np.array([len(x) for x in others])
            known = np.flatnonzero(length)
            out = np.ones(len(others), bool)
            if len(one) and len(known):
                self.mark[one] = True
                both = np.add.reduceat(self.mark[np.concatenate(others)], np.cumsum(length)[known] - length[known], dtype=np.int64)
                self.mark[one] = False
                both = np.minimum(both, np.minimum(n, sizes[known]))
                out[known] = 100 * both >= percent * (n + sizes[known] - both)
            return out

        def meet(self, cols: list[np.ndarray], earlier: bool = False) -> None:
            ids, n, comp, sketch, small = self.cols
            for j in range(len(ids)):
                other = [c[:j] for c in cols] if earlier else cols
                fit = (other[2] != comp[j]) & (100 * np.minimum(other[1], n[j]) >= percent * np.maximum(other[1], n[j]))
                at = np.flatnonzero(fit)
                if len(at):
                    same = (other[3][at] == sketch[j]).mean(axis=1)
                    at, same = at[same >= least], same[same >= least]
                if len(at):
                    fine = self.may(small[j], list(other[4][at]), n[j], other[1][at])
                    at, same = at[fine], same[fine]
                    self.total[j] += len(at)
                    self.best[j] = sorted([*self.best[j], *zip((-same).tolist(), other[0][at].tolist(), strict=True)])[:most]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(b: Bucket | None):
            if b and b.parts:
                if b.cols is None:
                    b.seal()
                rows = [(p, int(i), int(t)) for i, ps, t in zip(b.cols[0], b.best, b.total, strict=True) for _, p in ps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "total"])

        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, inside, ids, n, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "inside", "id", "n", "comp"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(keys), width)
            small = np.empty(len(keys), object)
            for j, x in enumerate(batch.column("small").to_pylist()):
                small[j] = np.frombuffer(x, "<u2")
            cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (inside[1:] != inside[:-1])]))
            for lo, hi in zip(cut, [*cut[1:], len(keys)], strict=True):
                if now is None or now.key != keys[lo]:
                    yield from close(now)
                    now = Bucket(keys[lo])
                cols = [x[lo:hi] for x in (ids, n, comp, sketch, small)]
                if not inside[lo]:
                    now.parts.append(cols)
                elif now.parts:
                    if now.cols is None:
                        now.seal()
                    now.meet(cols)
        yield from close(now)

    return run


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of documents linked when 100 * intersection >= percent * union of their shingle sets.

    Returns one row per input row: the id column, n_shingles, component_id (smallest id reachable) and kept
    (whether that is the row's own). Texts without words, and nulls, are linked with nothing. Rows that
    repeat an id are one document: linked with what any of them is linked with. Rows without an id are
    linked with nothing and kept. Other columns of the input aren't carried. An empty table gives an empty result.
    """
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.write_table(sign(rows_in, words, bands, rows), "near-signed")
    linkable = signed.where("set_key is not null and id is not null")
    classes = linkable.groupBy("set_key").agg(F.min("id").alias("id"))
    keyed = linkable.join(classes, ["set_key", "id"]).select("id", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("company")).where("company > 1")
    shared = scratch.write_table(keyed.join(buckets, "key").select("key", "id", "n", "company").distinct(), "near-shared")
    # repeats of an id may have made a bucket of one node
    central = shared.groupBy("id").agg(F.sum("company").alias("central"))
    placed = scratch.write_table(shared.join(central, "id").select("key", "id", "n", "central"), "near-placed")
    texts = scratch.write_table(rows_in.join(central, "id", "left_semi"), "near-texts")

    centres = placed.groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("neg"), "n")).alias("c")).select("key", (-F.col("c.neg")).alias("a"), F.col("c.n").alias("a_n"))
    fits = F.least("n", "a_n") * 100 >= F.greatest("n", "a_n") * percent
    pairs = placed.join(centres, "key").where((F.col("id") != F.col("a")) & fits).select("a", F.col("id").alias("b")).distinct()
    pairs = scratch.write_table(pairs, "near-pairs")
    links = scratch.write_table(confirm(pairs, texts, words, percent), "near-links")
    sketches = linkable.join(central, "id", "left_semi").select("id", "sketch").dropDuplicates(["id"])
    tested, most, width, comps, rare = pairs, FIRST, bands * rows, components(links), None
    while True:
        labelled = placed.join(comps, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
        sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("size"))
        open_keys = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("size").alias("size"), F.max_by("comp", F.struct("size", "comp")).alias("main")).where("comps > 1").drop("comps")
        left = labelled.join(open_keys, "key").select("key", (F.col("comp") == F.col("main")).alias("inside"), "id", "n", "comp", (F.col("size") > BLOCK).alias("wide"))
        left = scratch.write_table(left, "near-open")
        wide = left.where("wide").select("id", "n", "comp").distinct()
        left = left.where("not wide").drop("wide")
        if nodes := wide.count():
            if rare is None:
                # later rounds have no other nodes in such buckets
                wide_texts = texts.join(wide.select("id").distinct(), "id", "left_semi")
                rare = scratch.write_table(prefixes(wide_texts, words, percent, *common_shingles(wide_texts, words, nodes)), "near-rare")
            left = scratch.write_table(left.unionByName(tiles(rare.join(wide, "id"))), "near-blocks")
        open_texts = texts.join(left.select("id").distinct(), "id", "left_semi")
        left = left.join(sketches.join(small_sets(open_texts, words), "id"), "id").select("key", "inside", "id", "n", "comp", "sketch", "small")
        found = scratch.write_table(left.repartition("key").sortWithinPartitions("key", "inside").mapInArrow(likely(most, percent, width), "a long, b long, total long"), "near-likely")
        pairs = scratch.write_table(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
        more = scratch.write_table(confirm(pairs, texts, words, percent), "near-links")
        if not more.isEmpty():
            # a component's star stands for its links
            comps = components(comps.where("id != comp").toDF("a", "b").union(more))
        if (found.agg(F.max("total")).first()[0] or 0) <= most:
            break
        tested, most = tested.union(pairs), most * FIRST
    ends = classes.withColumnRenamed("id", "node").join(comps.withColumnRenamed("id", "node"), "node", "left").select("set_key", F.coalesce("comp", "node").alias("comp"))
    out = signed.select("id", "n", "set_key").join(ends, "set_key", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("comp"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("comp").eqNullSafe(F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``cluster`` keeps: one document of each component.

    Null, empty and wordless texts are linked with nothing and stay. Rows that repeat an id stay or go together;
    ids and ties, an empty table and very long texts are as in ``cluster``.
    """
    kept = cluster(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLE: dict[str, str] = {}
