"""Near-duplicate classes by DartMinHash (Christiani, 2020) over five-word shingles weighted by their counts.

Hashed darts fall into the (weight, rank) region of every shingle: arrival times of a Poisson process along the rank,
one process per unit of weight.  Each dart names a coordinate; the earliest dart below the weight is the coordinate's
value.  A signature takes about k ln k darts however long the text is.  Two signatures agree in a coordinate with the
probability of the weighted Jaccard similarity.

Bands of coordinates give buckets.  Each text is compared with the centres of its buckets, first with one of a few, then
with those that are still of another class.  Components that share a bucket and whose sketches agree enough are one
family, and its texts are compared in blocks: those outside its largest component with all.  The exact weighted Jaccard
similarity decides each link; a cell of two blocks returns a forest of links, never its pairs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import Scratch, id_and_text, mix64, row_hash, same_row, whole_rows
from rankweave.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6  # a pair at 0.8 misses all bands with probability (1 - 0.8**6)**40 = 5e-6
SLACK = 5  # standard deviations that a signature may fall below the threshold before the exact check
FIRST = 5  # bands whose centres are tried first
BLOCK = 1024
LOAD = 500_000  # shingles of a block of texts
CACHED_WORDS = 100_000  # in a Python worker, about 15 MB
DARTS_AT_ONCE = 250_000  # shingles and darts of a group of texts that throw together

_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@functools.lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def weighted_shingles(words: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts; fewer words than a shingle has make one shingle."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    rolled = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        rolled = rolled * _BASE + hashed[i:len(words) - size + 1 + i]
    return np.unique(mix64(rolled), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """(sets, k) signatures of weighted sets (element hashes, positive weights); no set may be empty."""
    out = np.zeros((len(sets), k), np.uint64)
    totals = np.array([w.sum() for _, w in sets], float)
    reach = (np.log(k) + 3) * k / totals  # ranks up to here leave a coordinate empty once in e**3 * k
    todo = np.arange(len(sets))
    while len(todo):
        sizes = [len(sets[i][0]) for i in todo]
        owner = np.repeat(np.arange(len(todo)), sizes)
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype(float)
        layers = np.ceil(weight).astype(np.int64)  # one process per unit of weight; the last one may be cut
        layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
        owner, weight = np.repeat(owner, layers), np.repeat(weight, layers)
        seed = mix64(np.repeat(element, layers) + mix64(layer.astype(np.uint64) + np.uint64(1)))
        limit, rank = reach[todo][owner], np.zeros(len(owner))
        thrown = []
        while len(owner):
            seed = seed + _GOLDEN
            rank = rank - np.log(_uniform(mix64(seed)))
            alive = rank <= limit
            owner, weight, layer, seed, limit, rank = (x[alive] for x in (owner, weight, layer, seed, limit, rank))
            dart = mix64(seed ^ _BASE)
            hit = layer + _uniform(mix64(dart ^ _GOLDEN)) < weight
            thrown.append((owner[hit], rank[hit], dart[hit]))
        owner, rank, dart = (np.concatenate(x) for x in zip(*thrown))
        cell = owner * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # of several darts in a cell the earliest is written last
        value, filled = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        value[cell[order]] = mix64(dart[order] + np.uint64(7))
        filled[cell] = True
        done = filled.reshape(len(todo), k).all(axis=1)
        out[todo[done]] = value.reshape(len(todo), k)[done]
        todo = todo[~done]
        reach[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys; the band's number is part of the key."""
    grid = signature.reshape(len(signature), bands, rows)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    for i in range(rows):
        keys = mix64(keys * _BASE + grid[:, :, i])
    return keys


def _sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, _rh, print, weight, bands, sketch): one row per document.  print: hash of the words in order, or of
    the stripped text if it has none; sketch: one byte of each coordinate."""
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    schema = StructType([
        docs.schema["doc_id"], docs.schema["_rh"], StructField("print", BinaryType()), StructField("weight", LongType()),
        StructField("bands", ArrayType(LongType())), StructField("sketch", BinaryType()),
    ])
    k = bands * rows
    darts = int((np.log(k) + 3) * k)  # of one text, on average

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for frame in frames:
            # Texts of about one length throw together: the shortest needs the most arrivals per shingle.
            frame = frame.iloc[frame["text"].str.len().argsort(kind="stable")]
            at = 0
            while at < len(frame):
                sets, prints, load = [], [], 0
                while at + len(sets) < len(frame) and load < DARTS_AT_ONCE:
                    text = frame["text"].iat[at + len(sets)]
                    words = words_of(text)
                    prints.append(xxhash.xxh3_128_digest(" ".join(words) or text.strip()))
                    sets.append(weighted_shingles(words, size))
                    load += len(words) + darts
                full = [i for i, s in enumerate(sets) if len(s[0])]
                keys: list = [[]] * len(sets)
                sketch = [b""] * len(sets)
                if full:
                    signed = signatures([sets[i] for i in full], k)
                    banded, low = band_keys(signed, bands, rows).view(np.int64), signed.astype(np.uint8)
                    for row, i in enumerate(full):
                        keys[i], sketch[i] = banded[row], low[row].tobytes()
                part = frame.iloc[at:at + len(sets)]
                yield part[["doc_id", "_rh"]].assign(
                    print=prints, weight=[int(s[1].sum()) for s in sets], bands=pd.Series(keys, index=part.index, dtype=object), sketch=sketch)
                at += len(sets)

    return docs.mapInPandas(run, schema)


def agreement(left: Column, right: Column) -> Column:
    """Share of coordinates in which two sketches agree."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean() for x, y in zip(a, b)], dtype=float)

    return run(left, right)


def similarity(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    """Exact weighted Jaccard similarity of two shingle arrays (sorted hashes, counts; binary)."""

    @F.pandas_udf("double")
    def run(ha: pd.Series, ca: pd.Series, hb: pd.Series, cb: pd.Series) -> pd.Series:
        out = []
        for x, u, y, v in zip(ha, ca, hb, cb):
            x, u, y, v = (np.frombuffer(z, np.int64) for z in (x, u, y, v))
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            both = np.minimum(u[i], v[j]).sum()
            out.append(both / (u.sum() + v.sum() - both))
        return pd.Series(out, dtype=float)

    return run(a, wa, b, wb)


def _shingle_table(texts: DataFrame, size: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node, text in zip(frame["node"], frame["text"]):
                h, c = weighted_shingles(words_of(text), size)
                yield pd.DataFrame({"node": [node], "h": [h.tobytes()], "c": [c.tobytes()]})

    return texts.select("node", "text").mapInPandas(run, "node long, h binary, c binary")


def _cells(rows: DataFrame, key: str, load: Column, block: int, most: int) -> DataFrame:
    """Deals the rows (``node, component``) of each key with at least two components over cells (_a, _m).

    The component with most rows of a key is its main one, and the rows of the others ask.  Each asking row meets each row
    of its key in one cell: held rows are in one block _a of all rows, asking ones in one block _m, and a block has about
    ``block`` rows and a load of ``most``.  A key whose rows are nearly all of one component so costs little more than
    its rows, and one with many components as many cells as it has pairs of blocks.
    """
    each = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"), F.sum(load).alias("l"))
    whole = each.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("l").alias("l"), F.max(F.struct("n", "l", "component")).alias("top"), F.count(F.lit(1)).alias("of")).filter("of > 1")
    blocks = lambda n, l: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(l / most)).cast("int")
    sizes = whole.select(
        key, F.col("top.component").alias("_main"), blocks(F.col("n"), F.col("l")).alias("_na"),
        blocks(F.col("n") - F.col("top.n"), F.col("l") - F.col("top.l")).alias("_nm"))
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    cell = lambda a, m, asks: F.struct(a.alias("a"), m.alias("m"), F.lit(asks).alias("asks"))
    minor = F.col("component") != F.col("_main")
    held = F.transform(F.sequence(F.lit(0), F.col("_nm") - 1), lambda m: cell(own("_na", 17), m, False))
    asking = F.transform(F.sequence(F.lit(0), F.col("_na") - 1), lambda a: cell(a, own("_nm", 19), True))
    return (
        rows.join(sizes, key).withColumn("minor", minor)
        .withColumn("_c", F.explode(F.when(minor, F.concat(held, asking)).otherwise(held)))
        .select(*rows.columns, "minor", F.col("_c.a").alias("_a"), F.col("_c.m").alias("_m"), F.col("_c.asks").alias("asks"))
    )


def _shared(held: pd.DataFrame):
    """Function of one row's shingles: the weight it shares with each held row, from the sorted shingles of all of them."""
    hashes, counts = (np.frombuffer(b"".join(held[name]), np.int64) for name in ("h", "c"))
    owner = np.repeat(np.arange(len(held)), held["h"].str.len().to_numpy() // 8)
    order = np.argsort(hashes, kind="stable")
    hashes, counts, owner = hashes[order], counts[order], owner[order]

    def of(h: bytes, c: bytes) -> np.ndarray:
        asked = np.frombuffer(h, np.int64)
        low = np.searchsorted(hashes, asked, "left")
        n = np.searchsorted(hashes, asked, "right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[at], np.minimum(counts[at], np.repeat(np.frombuffer(c, np.int64), n)), len(held))

    return of


def _joining(frame: pd.DataFrame, least: float, similar: float) -> list[tuple[int, int, int, int]]:
    """(node, its component, other node, its component) that join the components of a cell, as a forest: fewer than it has components.

    Rows link where their sketches agree enough, and with columns ``h`` and ``c`` where the exact similarity does too.  A
    pair whose components are joined already is not looked at.
    """
    asks = frame["asks"].to_numpy()
    held, asking = frame[~asks], frame[asks]
    out: list[tuple[int, int, int, int]] = []
    if not len(held) or not len(asking):
        return out
    x, y = (np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(len(f), -1) for f in (asking, held))
    names, label = np.unique(frame["component"].to_numpy(), return_inverse=True)
    cx, cy, label = label[asks], label[~asks], np.arange(len(names))
    (nx, wx), (ny, wy) = ((f["node"].to_numpy(), f["weight"].to_numpy()) for f in (asking, held))
    once = ~held["minor"].to_numpy()  # two asking rows meet in two cells; the smaller node looks
    k = x.shape[1]
    head = max(1, k // 4)
    first = np.ascontiguousarray(y[:, :head])
    floor = least - SLACK * np.sqrt(least * (1 - least) / head)  # a quarter of the coordinates sifts first
    shared = _shared(held) if "h" in frame else None
    for i in range(len(x)):
        near = np.nonzero((label[cy] != label[cx[i]]) & (once | (ny > nx[i])) & (np.minimum(wy, wx[i]) >= similar * np.maximum(wy, wx[i])))[0]
        near = near[(first[near] == x[i, :head]).sum(axis=1, dtype=np.int32) >= floor * head]
        near = near[(y[near] == x[i]).sum(axis=1, dtype=np.int32) >= least * k]
        if shared and len(near):
            both = shared(asking["h"].iat[i], asking["c"].iat[i])[near]
            near = near[both / (wy[near] + wx[i] - both) >= similar]
        while len(near):
            j = near[0]
            out.append((nx[i], names[cx[i]], ny[j], names[cy[j]]))
            label[label == label[cy[j]]] = label[cx[i]]
            near = near[label[cy[near]] != label[cx[i]]]
    return out


def _joined(cells: DataFrame, key: str, least: float, similar: float) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_joining(frame, least, similar), columns=["a", "ca", "b", "cb"], dtype=np.int64)

    return cells.groupBy(key, "_a", "_m").applyInPandas(run, "a long, ca long, b long, cb long")


def near_duplicates(
    docs: DataFrame, similar: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, first_bands: int = FIRST,
    block: int = BLOCK, load: int = LOAD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, _rh, class_id, kept): one row per document; class_id is the smallest doc_id of its class, kept the one row of it.

    Words are runs of word characters in lower case.  Texts with the same words in the same order are one node; of
    texts without words only those equal but for white space at their ends are.  Classes are the connected components of links at ``similar`` or more.  A null doc_id
    counts as larger than any other; of rows with equal doc_id and text in a class's first place one is kept.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("_rh", row_hash(F.col("text")))
    scratch = Scratch(docs.sparkSession, "dart-minhash")
    sketched = scratch.store(_sketches(docs, shingle, bands, rows).withColumn("_row", F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row", "_rh")
    nodes = scratch.store(
        sketched.groupBy("print").agg(F.min(first).alias("first"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()))

    least = similar - SLACK * np.sqrt(similar * (1 - similar) / (bands * rows))
    info = nodes.select("node", "weight", "sketch")
    tables: list[DataFrame] = []

    def shingles(wanted: DataFrame) -> DataFrame:
        """The shingle table, with the wanted nodes made where earlier steps have not."""
        wanted = wanted.select("node").distinct()
        for table in tables:
            wanted = wanted.join(table.select("node"), "node", "left_anti")
        named = nodes.select("node", F.col("first.doc_id").alias("_id"), F.col("first._rh").alias("_nh")).join(wanted, "node")
        texts = docs.join(named, (F.col("_rh") == F.col("_nh")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        tables.append(scratch.store(_shingle_table(texts.select("node", "text").dropDuplicates(["node"]), shingle)))
        return functools.reduce(DataFrame.unionByName, tables)

    def classed(links: DataFrame | None) -> DataFrame:
        """(node, component, bands) of every text."""
        plain = nodes.select("node", "bands")
        if links is None:
            return plain.withColumn("component", F.col("node"))
        found = components(links, scratch).withColumnRenamed("id", "node")
        return plain.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def placed(texts: DataFrame, n: int) -> DataFrame:
        return texts.select("node", "component", F.explode(F.slice("bands", 1, n)).alias("bucket"))

    def stars(members: DataFrame) -> DataFrame:
        """(a, b, n): texts and the centre of n buckets they share, where it is of another component.

        A hash that differs from bucket to bucket chooses the centre.
        """
        centres = (
            members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("bucket", "node"), "node", "component")).alias("c"))
            .filter("low < high").select("bucket", F.col("c.node").alias("b"), F.col("c.component").alias("_cb"))
        )
        met = members.join(centres, (members["bucket"] == centres["bucket"]) & (members["component"] != centres["_cb"]))
        return met.groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda end: info.select(F.col("node").alias(end), F.col("weight").alias(f"w{end}"), F.col("sketch").alias(f"s{end}"))
        sized = F.least("wa", "wb") >= similar * F.greatest("wa", "wb")
        near = scratch.store(
            pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter(sized)
            .filter(agreement(F.col("sa"), F.col("sb")) >= least).select("a", "b"))
        made = shingles(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))))
        of = lambda end: made.select(F.col("node").alias(end), F.col("h").alias(f"h{end}"), F.col("c").alias(f"c{end}"))
        both = near.join(of("a"), "a").join(of("b"), "b")
        return scratch.store(both.filter(similarity(F.col("ha"), F.col("ca"), F.col("hb"), F.col("cb")) >= similar).select("a", "b"))

    # 1: each text with one centre of its first few buckets; 2: with the centres of all its buckets that are still of other components.
    best = stars(placed(classed(None), min(first_bands, bands))).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    links = verified(best)
    links = links.unionByName(verified(stars(placed(classed(links), bands))))

    # 3: families: components that some two texts of one bucket join if sketches decided.  Each bucket returns a forest; in
    # a bucket of two texts the stars have decided the only pair.
    texts = scratch.store(classed(links))
    members = placed(texts, bands)
    live = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("n > 2 AND low < high")
    members = scratch.store(members.join(live.select("bucket"), "bucket"))
    cells = _cells(members, "bucket", F.lit(0), block, 1).join(info, "node")
    maybe = scratch.store(_joined(cells, "bucket", least, similar).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    inside = maybe.select("a").union(maybe.select("b")).distinct().toDF("component")
    families = components(maybe, scratch).withColumnRenamed("component", "family")
    families = inside.join(families, F.col("component") == F.col("id"), "left").select("component", F.coalesce("family", "component").alias("family"))

    # 4: inside a family the shingles decide, and each cell returns the links that join its components.
    members = scratch.store(texts.select("node", "component").join(families, "component").join(nodes.select("node", F.col("weight").alias("load")), "node"))
    cells = _cells(members, "family", F.col("load"), block, load).join(info, "node").join(shingles(members), "node")
    late = _joined(cells, "family", least, similar).select("a", "b")
    classes = components(links.unionByName(scratch.store(late)), scratch)

    grouped = nodes.select("node", "print", "first").join(classes.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    leading = grouped.groupBy("component").agg(F.min("first").alias("_lead"))
    named = grouped.join(leading, "component").select("print", F.col("_lead.doc_id").alias("class_id"), F.col("_lead._row").alias("_lead_row"))
    return sketched.select("doc_id", "_rh", "print", "_row").join(named, "print").select(
        "doc_id", "_rh", "class_id", (F.col("_row") == F.col("_lead_row")).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs without the near duplicates: the row of each class's smallest doc_id stays, with all its columns."""
    kept = near_duplicates(docs, **settings).filter("kept").select("doc_id", "_rh")
    keyed = whole_rows(docs)
    joined = keyed.join(kept, same_row(keyed, kept), "left_semi")
    return joined.dropDuplicates(["doc_id", "_rh"]).select("row.*")
