"""Near-duplicate detection: fast similarity sketching, banding, exact sets.

Sketch. A text's distinct word shingles are thrown into ``BINS`` bins in
rounds: in round i < BINS every shingle goes to a hashed bin with a hashed
value above all values of earlier rounds; in round i >= BINS every shingle
goes to bin i - BINS. A bin keeps its least value, and rounds stop once every
bin is filled, so each coordinate fills after at most 2 BINS rounds, usually
a few, and the share of equal coordinates estimates the Jaccard similarity
with Chernoff-type concentration (Dahlgaard, Knudsen and Thorup, "Fast
Similarity Sketching").

Search. Texts with the same set are one class. Classes that agree on one of
32 bands of four coordinates share a bucket; two sets of similarity 0.8 miss
all 32 with probability 5e-8. A bucket first links its members to its least
member, so a bucket of n gives n - 1 candidates. Candidates whose sketches
agree on fewer than ``MIN_AGREE`` of the bins are dropped (probability below
1e-6 at similarity 0.8); the rest are confirmed on the full sets. Buckets that
still hold several components are searched again in blocks: members outside
the largest component are compared with all others, and a group emits at most
one link for each merge of two components, which is then confirmed. So no
link between different components of a bucket is lost, and no group emits
its pairs.

Components are labelled by repeated least-neighbour labels with shortcuts;
every round is a written table, nothing but counts reaches the driver.

Edge cases: null, empty and blank texts have no shingles and stand alone;
shorter texts are one shingle of all their words; a null id never becomes a
component's id unless all its ids are null; rows of one id are rows of one
document; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm.common import annotate, set_aside, staged

BINS = 128
BAND = 4
MIN_AGREE = 77  # of 128 bins, 0.6
BLOCK = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
                                          0x9E3779B97F4A7C15))
_S30, _S27, _S31, _S8 = (np.uint64(x) for x in (30, 27, 31, 8))
_BIN_MASK = np.uint64(BINS - 1)
_ROUNDS = np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _STEP


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * _STEP + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """The ``BINS`` coordinates of a non-empty set of hashes."""
    bins = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(2 * BINS):
        g = _mix(items + _ROUNDS[i])
        value = (g >> _S8) | np.uint64(i << 56)
        if i < BINS:
            np.minimum.at(bins, (g & _BIN_MASK).astype(np.intp), value)
        else:
            bins[i - BINS] = min(bins[i - BINS], value.min())
        if bins.max() != np.iinfo(np.uint64).max:
            break
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number included."""
    groups = bins.reshape(-1, BAND)
    key = np.arange(len(groups), dtype=np.uint64)
    for k in range(BAND):
        key = _mix(key * _STEP + groups[:, k])
    return key.view(np.int64)


def _signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def make():
        def run(texts):
            n, fp, bands, sig = [], [], [], []
            for text in texts:
                s = shingles(text, size)
                n.append(len(s))
                if len(s):
                    b = sketch(s)
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(b))
                    sig.append((b & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                else:
                    fp.append(None)
                    bands.append(None)
                    sig.append(None)
            return [n, fp, bands, sig]
        return run

    return annotate(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")),
                    make, "n long, fp binary, bands array<long>, sig binary", "t", ["id"])


def _agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches and set sizes allow the similarity."""
    a = nodes.select(F.col("fp").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    b = nodes.select(F.col("fp").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    joined = pairs.join(a, "a").join(b, "b").filter(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint16).reshape(-1, BINS)
                    for c in (batch.column("sig_a"), batch.column("sig_b")))
            ok = (x == y).sum(axis=1) >= MIN_AGREE
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")],
                                             ["a", "b"]).filter(pa.array(ok))

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def _with_sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str,
               size: int) -> DataFrame:
    """Adds each class's full set (``items``) and the upper halves of its hashes."""
    own = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("t"))
    keys = nodes.select(F.col("key").alias("wanted")).distinct()
    texts = own.join(keys, own["key"].eqNullSafe(keys["wanted"]), "left_semi")

    def make():
        def run(values):
            sets = [shingles(t, size) for t in values]
            return [[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    [s.tobytes() for s in sets], [_halves(s).tobytes() for s in sets]]
        return run

    # A key may stand for rows of several texts: the set's own digest tells them apart.
    sets = annotate(texts, make, "fp binary, items binary, halves binary", "t", [])
    return nodes.join(sets.dropDuplicates(["fp"]), "fp")


def _halves(items: np.ndarray) -> np.ndarray:
    return np.unique((items >> np.uint64(32)).astype(np.uint32))


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    full = pairs.join(nodes.select(F.col("fp").alias("a"), F.col("items").alias("x")), "a").join(
        nodes.select(F.col("fp").alias("b"), F.col("items").alias("y")), "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ok = [_similar(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in xy), percent)
                      for xy in zip(part.column("x"), part.column("y"))]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")],
                                                 ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return staged(full.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"),
                  "dedup-links")


def components(links: DataFrame) -> DataFrame:
    """(fp, comp) for every end of a link: the least end it is connected to.

    Each round a node takes the least label among itself and its neighbours,
    then its label's label; rounds stop when no label changes. Only a count
    comes back from a round.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).toDF("fp", "other"),
                  "dedup-edges")
    labels = staged(both.groupBy("fp").agg(F.min("other").alias("m"))
                    .select("fp", F.least("fp", "m").alias("comp")), "dedup-labels")
    while True:
        near = (both.join(labels.select(F.col("fp").alias("other"), "comp"), "other")
                .groupBy("fp").agg(F.min("comp").alias("m")))
        step = labels.join(near, "fp").select("fp", "comp", F.least("comp", "m").alias("next"))
        jump = step.select(F.col("fp").alias("next"), F.col("next").alias("far"))
        fresh = staged(step.join(jump, "next").select(
            "fp", F.least("next", "far").alias("comp"),
            (F.least("next", "far") < F.col("comp")).alias("moved")), "dedup-labels")
        labels = fresh.select("fp", "comp")
        if not fresh.filter("moved").head(1):
            return labels


def _across(entries: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between the components of a bucket, one for each two it joins.

    A bucket of several components is dealt into blocks of about ``BLOCK``
    members; each pair of blocks is one group (:func:`_joins`).
    """
    member = entries.join(labels, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    mixed = member.groupBy("band").agg(F.count("*").alias("members"), F.min("comp").alias("lo"),
                                       F.max("comp").alias("hi")).filter("lo < hi")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = (member.join(mixed.select("band", blocks.alias("blocks")), "band")
             .join(nodes.select("fp", "n", "sig", "bands", "halves"), "fp")
             .withColumn("own", F.pmod(F.hash("fp"), "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("band", F.least("own", "other").alias("i"),
                     F.greatest("own", "other").alias("j"), "own", "fp", "comp", "n", "sig",
                     "bands", "halves"))
    return dealt.groupBy("band", "i", "j").applyInPandas(
        lambda pdf: _joins(pdf, percent), "a binary, b binary").distinct()


def _joins(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links found between different components of one group.

    Members outside the group's largest component are compared with all
    others: set sizes, sketches, whether this is the first bucket the two
    share, then the sets (by half hashes; links are confirmed afterwards). A
    link merges two components here, so their other pairs need no look.
    """
    comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
    order = np.lexsort((pdf["fp"].to_numpy(), comp == np.bincount(comp).argmax()))
    pdf, comp = pdf.iloc[order], comp[order]
    small = int((comp != np.bincount(comp).argmax()).sum())
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(-1, BINS)
    bands = np.stack(pdf["bands"].to_numpy())
    n, own, fp = (pdf[c].to_numpy() for c in ("n", "own", "fp"))
    halves = [np.frombuffer(h, dtype=np.uint32) for h in pdf["halves"]]
    two = pdf["i"].iloc[0] != pdf["j"].iloc[0]
    here = int(np.flatnonzero(bands[0] == pdf["band"].iloc[0])[0])
    a, b = [], []
    for k in range(small):
        open_ = (comp[k + 1:] != comp[k]) & (
            np.minimum(n[k + 1:], n[k]) * 100 >= np.maximum(n[k + 1:], n[k]) * percent)
        if two:
            open_ &= own[k + 1:] != own[k]
        at = np.flatnonzero(open_) + k + 1
        agree = (sig[at] == sig[k]).sum(axis=1)
        at, agree = at[agree >= MIN_AGREE], agree[agree >= MIN_AGREE]
        at = at[np.argsort(-agree, kind="stable")]
        if here:
            at = at[~(bands[at, :here] == bands[k, :here]).any(axis=1)]
        for m in at:
            if comp[m] != comp[k] and _similar(halves[k], halves[m], percent):
                a.append(min(fp[k], fp[m]))
                b.append(max(fp[k], fp[m]))
                comp[comp == comp[m]] = comp[k]
    return pd.DataFrame({"a": a, "b": b})


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id of
    the rows linked with it, directly or not) and kept (its own id is that).

    Two texts are linked if ``100 * intersection >= percent * union`` for
    their sets of ``shingle``-word shingles; ``percent`` is 80 or more.
    """
    if percent < 80:
        raise ValueError("the banding is laid out for similarities of 0.8 and more")
    sigs = staged(_signatures(docs, id_col, text_col, shingle), "dedup-signatures")
    some = sigs.filter("n > 0")
    entries = staged(some.select("fp", F.explode("bands").alias("band")).distinct(),
                     "dedup-entries")
    buckets = entries.groupBy("band").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter(
        "a < z")
    shared = staged(entries.join(buckets.select("band", "a"), "band"), "dedup-shared")
    classes = some.join(shared.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(
        F.min("id").alias("key"), *[F.first(c).alias(c) for c in ("n", "sig", "bands")])
    nodes = staged(_with_sets(staged(classes, "dedup-classes"), docs, id_col, text_col, shingle),
                   "dedup-nodes")
    star = shared.filter("fp > a").select("a", F.col("fp").alias("b")).distinct()
    links = _confirmed(_agreeing(star, nodes, percent), nodes, percent)
    labels = components(links)
    cross = _confirmed(_across(shared.select("band", "fp"), nodes, labels, percent), nodes, percent)
    if cross.head(1):
        labels = components(links.union(cross))
    rows = some.select("id", "n", "fp").join(labels, "fp", "left").select(
        "id", "n", F.coalesce("comp", "fp").alias("comp"))
    least = rows.groupBy("comp").agg(F.min("id").alias("component_id"))
    alone = sigs.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = rows.join(least, "comp").select("id", "n", "component_id").union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Keeps one row of each component: the least id, of one id's texts the
    least text hash, of equal rows any one.

    All columns stay. Rows without words are kept. The table is not copied: a
    row is known by its id and its text's hash.
    """
    own, place = set_aside(docs, ["__row"])
    rank = F.struct(F.col(f"`{place[id_col]}`").isNull().alias("none"),
                    F.col(f"`{place[id_col]}`").alias("id"),
                    F.xxhash64(f"`{place[text_col]}`").alias("text"))
    keyed = own.withColumn("__row", rank)
    found = staged(near_duplicates(keyed, shingle, percent, "__row", place[text_col])
                   .filter("kept"), "dedup-kept")
    kept = keyed.join(found.select("__row").distinct(), "__row", "left_semi")
    repeated = found.filter("n_shingles > 0").groupBy("__row").count().filter(
        "count > 1").select("__row")
    if repeated.head(1):  # equal rows of one id: any one of them
        kept = kept.join(repeated, "__row", "left_anti").unionByName(
            kept.join(repeated, "__row", "left_semi").dropDuplicates(["__row"]))
    return kept.select(*[F.col(f"`{place[c]}`").alias(c) for c in docs.columns])
