"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, components.

1. Each text gets the set of its distinct word shingles and a SuperMinHash signature, cut
   into bands.  Texts with the same words (by a 128-bit BLAKE2 digest of them) are one class.
2. Bands are exploded and grouped by their hash.  Each bucket's members are paired with its
   smallest member only, so a bucket gives as many pairs as it has members.
3. Pairs are verified on the full sets of their texts, shingles with equal hashes word by
   word, and joined to components.
4. Buckets that still hold several components: large ones are compared with the smallest member
   of another component in the same way, TURNS times.  Then of small ones every pair between
   components is verified; large ones are split into blocks, and each pair of blocks is
   compared as a matrix product in one task, whose hits are verified like all others; the task
   returns a spanning forest.  So every pair that shares a band is linked, or verified as no
   link, or already in one component.

Wherever rows meet by a key that many may have (band, class, leader, component), counts come
first and hot keys' rows are spread (see common.join_spread).

The number of bands follows from the threshold: if slots were independent, a pair at the
threshold would miss all bands with probability at most `MISS`.  Slots of a SuperMinHash are
not: ranks of one element differ between slots, so the number of unequal slots varies less
than a binomial one.  A pair misses all bands only if every band has an unequal slot, which
takes more of them than expected, so less variance means fewer misses; a test counts them."""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, groups, join_spread, marked_hot, materialise, table, utf8
from .components import connected_components
from .shingles import ShingleSet, Vocabulary, shingle_sets, words_of
from .superminhash import bands, signatures

ROWS = 6
MISS = 1e-6
#: Buckets of up to this many members give all pairs between components.
SMALL_BUCKET = 16
#: Members of a block; two blocks are compared in one task.
BLOCK = 256
#: Further members that large buckets are compared with, one after the other, before blocks are.
TURNS = 2
#: Shingles of parsed texts that a task keeps.
KEPT = 1 << 18


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    p = (percent / 100) ** rows
    return 1 if p >= 1 else math.ceil(math.log(miss) / math.log1p(-p))


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, m): m tells apart texts of rows that share an id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("m"))


def features(picked: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, m, key, n_shingles, bands) of each row; key is null without words."""
    n_bands = band_count(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in groups(batches):
            vocabulary.forget()
            words = [words_of(t) for t in utf8(batch.column(1))]
            hashes, bounds, size = shingle_sets([vocabulary.numbers(w) for w in words], vocabulary, width)
            sig = bands(signatures(hashes, bounds, n_bands * ROWS), ROWS).view(np.int64)
            has = size > 0
            keys = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]
            offsets = pa.array(np.concatenate([[0], np.cumsum(has * n_bands)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sig[has].reshape(-1)))],
                names=["doc_id", "m", "key", "n_shingles", "bands"],
            )

    return picked.mapInArrow(run, "doc_id long, m string, key binary, n_shingles long, bands array<long>")


class Parsed:
    """Shingle sets of texts by number, the last ones kept as long as they are few."""

    def __init__(self, width: int) -> None:
        self.width, self.vocabulary, self.size = width, Vocabulary(), 0
        self.kept: OrderedDict[int, ShingleSet] = OrderedDict()

    def get(self, number: int, text: bytes) -> ShingleSet:
        found = self.kept.get(number)
        if found is None:
            found = self.kept[number] = ShingleSet(self.vocabulary.numbers(words_of(text)), self.vocabulary, self.width)
            self.size += found.size
        self.kept.move_to_end(number)
        return found

    def trim(self) -> None:
        """Between pairs: word numbers stay the same as long as any set is kept."""
        if len(self.vocabulary) > Vocabulary.MOST:
            self.kept.clear()
            self.size = 0
            self.vocabulary.forget()
        while self.size > KEPT and self.kept:
            self.size -= self.kept.popitem(last=False)[1].size


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold.  A node that many pairs
    name first has its text copied for each share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = Parsed(width)
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                keep.append(parsed.get(a, x.as_buffer().to_pybytes()).linked(parsed.get(b, y.as_buffer().to_pybytes()), percent))
                parsed.trim()
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sizes = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sizes = marked_hot(sizes, ["a"], "n").select("a", "_is_hot", F.ceil(F.col("n") / F.col("_share")).cast("int").alias("copies"))
    sizes = materialise(sizes, "copies")
    # only hot nodes have several copies
    dealt = pairs.join(F.broadcast(sizes.where("_is_hot").select("a", "copies")), "a", "left")
    dealt = dealt.select("a", "b", F.pmod(F.hash("b"), F.coalesce("copies", F.lit(1))).alias("copy"))
    left = texts.join(sizes.select(F.col("a").alias("node"), "copies"), "node").select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    both = dealt.join(right.hint("merge"), "b").join(left.hint("merge"), ["a", "copy"])
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int, confirm=None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the members of two blocks (or of one), over and
    above the components that `labels` tells.  `confirm` has the last word on a pair."""
    root = {int(x): int(x) for x in set(labels.tolist())}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if len(root) < 2:
        return []
    size = np.array([len(s) for s in sets], dtype=np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code = (np.cumsum(count > 1) - 1)[code[shared]]
    owner = owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    at, step = 0, 4096
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        stop = int(np.searchsorted(code, first + step))
        x = np.zeros((len(sets), step), dtype=np.float32)
        x[owner[at:stop], code[at:stop] - first] = 1
        both += x @ x.T
        at = stop
    inter = np.rint(both).astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    hit = np.argwhere(np.triu(100 * inter >= percent * union, 1))
    out = []
    for i, j in hit:
        p, q = find(int(labels[i])), find(int(labels[j]))
        if p != q and (confirm is None or confirm(int(i), int(j))):
            root[max(p, q)] = min(p, q)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _dense_links(members: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links inside large buckets (h, n, node, label), by pairs of blocks of each.

    Every step is written before join_spread takes it: that names its frames several times over, and
    where one such step stands unwritten in the next, the plan, which the driver holds, grows by the product.

    A pair may meet in many buckets.  Each node has a home, the largest of its buckets; buckets of
    which a quarter or more has its home in another one are joined to a family with it.  Nodes of
    one family are compared once, in a group of its own; buckets compare only across families.
    Blocks hold nodes of one family and one component where a group has many such; the list of
    blocks tells which pairs of blocks have anything to compare, and only for those are members
    sent."""
    home = members.groupBy("node").agg(F.max(F.struct("n", "h")).alias("home")).select("node", F.col("home.h").alias("home"))
    inside = materialise(members.join(home, "node").select("h", "n", "node", "label", "home"), "inside")
    close = inside.groupBy("h", "home").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where("h != home and 4 * c >= n")
    family = connected_components(close, "h", "home").withColumnsRenamed({"node": "home", "root": "family"})
    sizes = inside.groupBy("home").agg(F.count(F.lit(1)).alias("c"))
    family = materialise(family.join(sizes, "home"), "family")
    inside = join_spread(inside, family, ["home"], "c", ["node"], how="left").select("h", "node", "label", F.coalesce("family", "home").alias("home"))
    inside = materialise(inside, "inside")
    across = inside.groupBy("h").agg(F.min("home").alias("x"), F.max("home").alias("y"), F.count(F.lit(1)).alias("c")).where("x != y").select("h", "c")
    across = materialise(across, "across")
    own = inside.select(F.concat(F.lit("family "), "home").alias("h"), "node", "label", "home").distinct()
    rest = join_spread(inside, across, ["h"], "c", ["node"]).select(F.concat(F.lit("bucket "), "h").alias("h"), "node", "label", "home")
    inside = materialise(own.unionByName(rest), "groups")
    few = BLOCK // 2

    def pooled(rows: DataFrame, key: list[str], name: str, of: str) -> DataFrame:
        """Adds `name`: the value of `of` where its group has many rows in it, else null."""
        sizes = materialise(rows.groupBy(*key, of).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= few), "sizes")
        got = join_spread(rows, sizes, [*key, of], "c", ["node"], how="left")
        return materialise(got.withColumn(name, F.when(F.col("c").isNotNull(), F.col(of))).drop("c", "hot"), name)

    dealt = pooled(pooled(inside, ["h"], "of_home", "home").withColumn("_g", F.coalesce("of_home", F.lit(0))), ["h", "_g"], "of_label", "label")
    dealt = dealt.withColumn("pool", F.concat_ws("/", F.coalesce(F.col("of_home").cast("string"), F.lit("-")), F.coalesce(F.col("of_label").cast("string"), F.lit("-"))))
    sizes = dealt.groupBy("h", "pool").agg(F.count(F.lit(1)).alias("c"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    sizes = materialise(sizes, "sizes")
    dealt = join_spread(dealt, sizes, ["h", "pool"], "c", ["node"])
    dealt = materialise(dealt.select("h", "node", "label", "home", F.concat_ws("/", "pool", F.pmod(F.xxhash64("node"), "parts").cast("string")).alias("block")), "dealt")
    blocks = dealt.groupBy("h", "block").agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    other = blocks.select("h", *[F.col(c).alias(f"{c}_") for c in ("block", "h0", "h1", "l0", "l1")])
    some = blocks.join(other, "h").where("block <= block_ and least(l0, l0_) != greatest(l1, l1_) and (least(h0, h0_) != greatest(h1, h1_) or startswith(h, 'family'))")
    some = materialise(some.select("h", F.col("block").alias("i"), F.col("block_").alias("j")), "block_pairs")
    sides = some.select("h", "i", "j", F.col("i").alias("block")).unionByName(some.where("i != j").select("h", "i", "j", F.col("j").alias("block")))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        vocabulary = Vocabulary()
        sets = [ShingleSet(vocabulary.numbers(words_of(x.as_buffer().to_pybytes())), vocabulary, width) for x in group.column("text")]
        col = lambda k: np.asarray(group.column(k))
        out = block_links(col("node"), col("label"), [s.hashes for s in sets], percent, lambda i, j: sets[i].linked(sets[j], percent))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    full = dealt.join(sides, ["h", "block"]).join(texts, "node").select("h", "i", "j", "node", "label", "text")
    return full.groupBy("h", "i", "j").applyInArrow(run, "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    return connected_components(links).withColumnsRenamed({"node": "node", "root": "label"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, m for each row of `docs`; m is the md5 of the text.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct
    `width`-word shingles (A-Z lower-cased; with fewer words the whole sequence is the one
    shingle).  component_id is the smallest id reachable, kept tells whether it is the
    document's own.  Null, empty and blank texts have 0 shingles and are linked with nothing.
    A row without an id is linked with nothing and kept.  Rows that share an id are judged each
    by its own text.  Other columns of `docs` are not read."""
    picked = _picked(docs, id_col, text_col)
    feats = materialise(features(picked, percent, width), "features")
    usable = feats.where("key is not null and doc_id is not null")
    classes = usable.groupBy("key").agg(F.min(F.struct("doc_id", "m")).alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "key", "rep", "bands", "copies"), "classes")
    rows = classes.select(F.explode("bands").alias("h"), "node")
    low = materialise(rows.groupBy("h").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = materialise(join_spread(rows, low, ["h"], "n", ["node"]).drop("hot"), "members")
    stars = materialise(members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    wanted = classes.join(wanted, "node").select("node", "rep.doc_id", "rep.m")
    texts = picked.join(wanted.hint("merge"), ["doc_id", "m"]).groupBy("node").agg(F.first(F.col("text").cast("binary")).alias("text"))
    texts = materialise(texts, "texts")
    links = materialise(_verified(stars, texts, percent, width), "links")
    for turn in range(TURNS + 1):
        roots = materialise(_labels(links), "roots")
        marked = members.select("h", "n", "node").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
        marked = materialise(marked, "marked")
        several = marked.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("n").alias("n")).where("x != y").select("h", "n", "x")
        several = materialise(several, "several")
        rest = materialise(join_spread(marked.select("h", "node", "label"), several, ["h"], "n", ["node"]).drop("hot"), "rest")
        many = rest.where(F.col("n") > SMALL_BUCKET)
        discard(marked, several)
        if turn == TURNS or many.isEmpty():
            break
        lead = many.where("label != x").groupBy("h").agg(F.min(F.struct("node", "label")).alias("lead"), F.max("n").alias("n"))
        pairs = join_spread(many.select("h", "node", "label"), materialise(lead, "lead"), ["h"], "n", ["node"]).where(F.col("label") != F.col("lead.label"))
        pairs = pairs.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
        pairs = materialise(pairs, "pairs")
        more = materialise(_verified(pairs, texts, percent, width), "links")
        links = materialise(links.unionByName(more), "links")
        discard(rest, more)
    few = rest.where(F.col("n") <= SMALL_BUCKET)
    other = few.select("h", F.col("node").alias("b"), F.col("label").alias("other"))
    cross = few.join(other, "h").where("node < b and label != other").select(F.col("node").alias("a"), "b").distinct()
    cross = materialise(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    more = _verified(cross, texts, percent, width)
    if not many.isEmpty():
        more = more.unionByName(_dense_links(many, texts, percent, width))
    more = materialise(more, "links")
    if not more.isEmpty():
        roots = _labels(links.unionByName(more))
    roots = materialise(roots, "roots")
    sizes = roots.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    found = classes.select("node", "rep.doc_id", "key", "copies").join(roots, "node")
    least = materialise(found.groupBy("label").agg(F.min("doc_id").alias("component_id")).join(sizes, "label"), "least")
    linked = join_spread(found.select("node", "label"), least, ["label"], "n", ["node"]).select("node", "component_id")
    # classes of one row without a link stand for themselves
    by_key = classes.select("node", "key", "rep.doc_id", "copies").join(linked, "node", "left").where("copies > 1 or component_id is not null")
    by_key = materialise(by_key.select("key", "copies", F.coalesce("component_id", "doc_id").alias("component_id")), "by_key")
    discard(members, low, stars, texts, links, rest, cross, more)
    out = join_spread(feats.select("doc_id", "m", "key", "n_shingles"), by_key, ["key"], "copies", ["doc_id"], how="left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"), "m")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("m")


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows without those whose text a smaller id of their component stands for.  Rows
    without an id stay; rows that share an id go or stay each by its own text; repeats of a kept
    row stay."""
    found = near_duplicates(docs, percent=percent).where("not kept")
    gone = found.select(F.col("doc_id").alias("_gone_id"), F.col("m").alias("_gone_text")).distinct()
    same = (docs["doc_id"].cast("long") == gone["_gone_id"]) & (F.md5(docs["text"].cast("string").cast("binary")) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")


#: The same in DuckDB: all pairs with a common shingle, then what is reachable.
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = f"translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}')"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id, coalesce(c.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
