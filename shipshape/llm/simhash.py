"""SimHash near-de-duplication: fingerprints, pigeonhole blocks, Hamming check, components.

A 64-bit fingerprint is cut into ``max_bits + 3`` blocks. Two fingerprints at most ``max_bits``
bits apart agree in at least three blocks, so every choice of three blocks is one key and close
pairs share a key. Components need connections, not all pairs, so a bucket is linked in two steps:
first every member with the bucket's smallest one (rows stay linear in the bucket), then, over the
components found so far, only members outside a bucket's largest component with the members of
other components. Pairs inside one component are never formed, yet no connection is lost.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipshape.llm import caches
from shipshape.llm.common import connected_components, row_tag, ship, staged, text_of

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Blocks that a key joins; more make rarer keys and more of them.
AGREE = 3
#: Keys that a task makes at most: few fingerprints in few bytes make many keys.
TASK_KEYS = 1_000_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 where it has no words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[width:]] + [len(joined)]
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)), dtype="<u8",
                         count=len(ends))
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[i:i + 65536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tag, fp): fp is the fingerprint as a signed long, tag tells texts of one doc_id apart."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        caches.only("simhash")
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64), pa.int64())],
                                             names=["doc_id", "tag", "fp"])
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(text_of(docs)).alias("tag"),
                       text_of(docs).alias("text")).mapInArrow(run, "doc_id long, tag long, fp long")


def _keys(fp: Column, max_bits: int) -> Column:
    """The keys of a fingerprint: the choice of blocks and the bits in them."""
    n = max_bits + AGREE
    edges = [round(i * 64 / n) for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[fp.bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))) for c in combinations(range(n), AGREE)])


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component) for each fingerprint that another one links with; ``fps`` holds distinct ones."""
    fps = staged(fps, "distinct")
    tasks = max(1, math.ceil(fps.count() * math.comb(max_bits + AGREE, AGREE) / TASK_KEYS))
    rows = fps.repartition(tasks).select("fp", F.posexplode(_keys(F.col("fp"), max_bits)).alias("c", "m"))
    hubs = rows.groupBy("c", "m").agg(F.min("fp").alias("hub"), F.max("fp").alias("top"), F.count(F.lit(1)).alias("n"))
    hubs = staged(hubs.where("hub != top"), "hubs")  # aggregates are staged so that AQE can split their joins
    # two members are the pair itself, as most keys that are shared by chance; rows are joined back for larger ones
    pairs = hubs.where((F.col("n") == 2) & (_far("hub", "top") <= max_bits)).select(F.col("top").alias("fp"), "hub")
    large = hubs.where("n > 2").select("c", "m", "hub").hint("merge")  # grows with the data, so never broadcast
    rows = staged(rows.join(large, ["c", "m"]), "blocks")  # rows that share a key with two others or more
    stars = rows.where((F.col("fp") != F.col("hub")) & (_far("fp", "hub") <= max_bits)).select("fp", "hub")
    stars = staged(stars.unionByName(pairs).distinct(), "stars")
    comps = staged(connected_components(stars, "fp", "hub"), "components")

    known = rows.select("c", "m", "fp").join(comps, rows["fp"] == comps["node"], "left").select(
        "c", "m", "fp", F.coalesce("component", "fp").alias("comp"))
    sizes = known.groupBy("c", "m", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("c", "m").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"),
                                        F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    split = staged(split, "split")
    known = staged(known.join(split, ["c", "m"]), "parts")
    few = known.where("comp != main").select("c", "m", F.col("fp").alias("x"), F.col("comp").alias("xc"))
    across = few.join(known.select("c", "m", F.col("fp").alias("y"), F.col("comp").alias("yc")), ["c", "m"]).where(
        (F.col("xc") != F.col("yc")) & (_far("x", "y") <= max_bits)).select("xc", "yc").distinct()
    over = staged(connected_components(across, "xc", "yc").select(F.col("node").alias("part"), F.col("component").alias("whole")),
                  "joined")  # components of the first ones, which are few
    named = comps.join(over, comps["component"] == over["part"], "left").select(
        F.col("node").alias("fp"), F.coalesce("whole", "component").alias("component"))
    alone = over.join(comps, over["part"] == comps["node"], "left_anti")  # fingerprints that only such a link joins
    return named.unionByName(alone.select(F.col("part").alias("fp"), F.col("whole").alias("component")))


def simhash_dedup(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id, tag.

    Null texts are empty; texts without words have fingerprint 0 and link like any other.
    Fewer words than a shingle make one shingle of them all. Repeated rows give repeated
    result rows; rows that share a doc_id with different texts are linked each by its own
    fingerprint. A null doc_id belongs to a component but never names one while another
    member has an id. An empty table gives an empty result; further columns are not read.
    """
    fps = staged(fingerprints(docs, width), "fingerprints")
    links = fingerprint_links(fps.select("fp").distinct(), max_bits)
    links = links.select(F.col("fp").alias("f"), "component")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    own = own.join(links, own["fp"] == links["f"], "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    own = staged(own, "owners")
    low = staged(own.groupBy("c").agg(F.min("low").alias("component_id")), "components")
    ids = own.join(low, "c").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                      "component_id", "tag")
