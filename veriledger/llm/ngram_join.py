"""N-gram Jaccard join over a prefix tree.

A document is its set of distinct word n-grams. Two documents link when 100 * |A & B| >= percent * |A | B|.

1. Which n-grams does more than one document hold? Packed hashes answer that over the whole corpus (exchange.py).
   A document that links to another shares at least percent of its n-grams, so all others leave here, alone in their class.
2. The global order puts n-grams that one document holds first, then the rest from rare to frequent, then by hash. Linked documents
   share an n-gram within the first |A| - ceil(percent/100 |A|) + 1; documents that do, and whose sizes allow a link, form families.
3. Each family's sets go into a trie in the global order. Every document walks the trie, adding up its overlap along shared
   paths once, and leaves subtrees whose sizes or remaining lengths cannot reach the threshold, or whose documents
   are in its class already. Families of more than ``block_tokens`` are split: blocks are joined within, their main
   classes are linked, and what lies outside the family's main class is then joined with every block.

Equal sets are joined once, through a representative. Links are decided on n-gram ids of 40 bits and a bucket.

Defined results: a document without words (null, empty) has no n-grams and links with nothing; with fewer words than n, the whole
sequence is its one n-gram; a null doc_id links with nothing and keeps a null class; rows that repeat a doc_id are one document
with the links of all of them; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriledger.llm import exchange as X
from veriledger.llm import kernels as K
from veriledger.llm import small_ints as small
from veriledger.llm.components import components
from veriledger.llm.storage import discard, materialise, small_batches
from veriledger.llm.substrings import load, save
from veriledger.llm.workers import lean

NGRAM, PERCENT = 5, 75
BLOCK_TOKENS = 2_000_000
SALTS = 16
TOKEN_BYTES = 8
#: Rows of n-grams that a chunk holds in several documents; single ones are X.ASK.
ASK_MANY = 6


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) pairs in the order of hashes, and each document's set size."""
    data = K.lower(data)
    starts, ends, firsts = K.words(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    sizes = np.diff(firsts)
    found, docs = [], []
    for width in range(1, n + 1):
        low = np.where(sizes == width, firsts[:-1], 0) if width < n else firsts[:-1]
        high = np.where(sizes == width, low + 1, low) if width < n else np.maximum(firsts[1:] - n + 1, low)
        at = K.ranges(low, high)
        if len(at):
            found.append(K.window_hashes(hashes, width)[at])
            docs.append(np.repeat(np.arange(len(sizes)), high - low))
    if not found:
        return np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    h, d = np.concatenate(found), np.concatenate(docs)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, d, np.bincount(d, minlength=len(sizes))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


SETS = "doc_id long, n_shingles long, tokens binary"


def place_of(df: np.ndarray, bucket: np.ndarray | int, low: np.ndarray) -> np.ndarray:
    """An n-gram's id, which is its place in the global order: frequency (in steps of a fourth root of two), bucket, hash."""
    level, bucket = np.minimum(63, (4 * np.log2(np.maximum(df, 1))).astype(np.int64)), np.asarray(bucket, np.int64)
    if bucket.max(initial=0) > 0x1FFFF:
        raise ValueError("more than 131,072 buckets: ids of n-grams would clash; set fewer shuffle partitions")
    return level << 57 | bucket << 40 | low.astype(np.int64)


def _blobs(table: pa.Table, kind: int) -> list[tuple]:
    return [r for r in zip(*(table.column(c).to_pylist() for c in ("chunk", "kind", "h", "r")), strict=True) if r[1] == kind]


def _frequencies(table: pa.Table) -> pa.Table:
    """One bucket: how many documents hold each n-gram, answered for those that more than one holds."""
    bucket = table.column("bucket")[0].as_py()
    single, many = _blobs(table, X.ASK), _blobs(table, ASK_MANY)
    hs, hm = [X.unpack(r[2], 5) for r in single], [X.unpack(r[2], 5) for r in many]
    out: list[tuple] = []
    if hs or hm:
        h = np.concatenate([*hs, *hm])
        n = np.concatenate([*(np.ones(len(x), np.int64) for x in hs), *(small.ints(r[3]) for r in many)])
        distinct, where = np.unique(h, return_inverse=True)
        df = np.bincount(where, n, len(distinct)).astype(np.int64)[where]
        at = 0
        for (chunk, _, _, refs), own in zip(single, hs, strict=True):
            mine = df[at : at + len(own)]
            twice = mine > 1
            if twice.any():
                out.append((bucket, chunk, X.ANSWER, X.pack(own[twice], 5), np.frombuffer(refs, "<u2")[twice].tobytes(), small.small_ints(mine[twice])))
            at += len(own)
        for (chunk, _, _, _), own in zip(many, hm, strict=True):
            out.append((bucket, chunk, ASK_MANY, None, None, small.small_ints(df[at : at + len(own)])))
            at += len(own)
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    answers = pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["bucket", "chunk", "kind", "h", "r", "t"])
    kept = table.filter(pa.array([k == X.SKELETON for k in table.column("kind").to_pylist()], pa.bool_()))
    return pa.concat_tables([kept.cast(answers.schema), answers])


def shared_sets(docs: DataFrame, *, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, and tokens: the ids of n-grams that other documents hold too, ascending, if they are enough for a link."""
    small_batches(docs.sparkSession)
    keys = X.bucket_keys(docs.sparkSession)
    n_buckets = len(keys)

    def ask(batches):
        chunks = X.Chunks()
        for batch in batches:
            for part, data, offsets in K.steps(batch, limit=X.CHUNK_BYTES):
                chunk = chunks.new()
                h, d, sizes = sets_of(data, offsets, n)
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                runs = np.diff(np.append(np.flatnonzero(first), len(h)))
                alone = np.repeat(runs == 1, runs)
                rows: dict[str, list] = {c: [] for c in ("bucket", "kind", "h", "r", "t")}

                def add(bucket, kind, hashes=None, refs=None, t=None):
                    for name, value in zip(rows, (bucket, kind, hashes, refs, t), strict=True):
                        rows[name].append(value)

                one, one_doc, some, some_n = h[alone], d[alone].astype("<u2"), h[first & ~alone], runs[runs > 1]
                cuts = np.searchsorted(X.bucket_of(one, n_buckets), np.arange(n_buckets + 1))
                cuts_some = np.searchsorted(X.bucket_of(some, n_buckets), np.arange(n_buckets + 1))
                for b in range(n_buckets):
                    s, m = slice(cuts[b], cuts[b + 1]), slice(cuts_some[b], cuts_some[b + 1])
                    if s.start < s.stop:
                        add(int(keys[b]), X.ASK, X.pack(one[s], 5), one_doc[s].tobytes())
                    if m.start < m.stop:
                        add(int(keys[b]), ASK_MANY, X.pack(some[m], 5), small.small_ints(some_n[m]))
                ids = part.column(0)
                add(int(keys[chunk % n_buckets]), X.SKELETON, t=save(
                    ids=ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null=np.asarray(ids.is_null()), sizes=sizes,
                    some=some, runs=some_n, docs=d[~alone].astype("<u2"),
                ))
                k = len(rows["kind"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["bucket"], pa.int32()), pa.array([chunk] * k, pa.int64()), pa.array(rows["kind"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in ("h", "r", "t")]],
                    ["bucket", "chunk", "kind", "h", "r", "t"],
                )

    def build(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "h", "r", "t")), strict=True))
        s = load(next(r[4] for r in rows if r[0] == X.SKELETON))
        tokens, of = [], []
        for kind, b, h, r, t in rows:
            if kind == X.ANSWER:
                tokens.append(place_of(small.ints(t), np.searchsorted(keys, b), X.unpack(h, 5)))
                of.append(np.frombuffer(r, "<u2").astype(np.int64))
        told = sorted((b, t) for kind, b, _, _, t in rows if kind == ASK_MANY)
        if told:
            df = np.concatenate([small.ints(t) for _, t in told])
            tokens.append(np.repeat(place_of(df, X.bucket_of(s["some"], n_buckets), s["some"] & X.LOW40), s["runs"]))
            of.append(s["docs"].astype(np.int64))
        tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        of = np.concatenate(of) if of else np.zeros(0, np.int64)
        order = np.lexsort((tokens, of))
        tokens, cuts, sizes = tokens[order], np.searchsorted(of[order], np.arange(len(s["ids"]) + 1)), s["sizes"]
        enough = (np.diff(cuts) >= needed(sizes, percent)) & (sizes > 0) & ~s["null"]
        return pa.table([
            pa.array(s["ids"], mask=s["null"]), pa.array(sizes, pa.int64()),
            pa.array([X.pack(tokens[cuts[i] : cuts[i + 1]], TOKEN_BYTES) if enough[i] else None for i in range(len(sizes))], pa.binary()),
        ], names=["doc_id", "n_shingles", "tokens"])

    asked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(ask), X.SCHEMA)
    return asked.groupBy("bucket").applyInArrow(lean(_frequencies), X.SCHEMA).groupBy("chunk").applyInArrow(lean(build), SETS)


class Classes:
    """Union-find with the smaller root winning."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.n = 0

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Node:
    __slots__ = ("ids", "below", "docs", "least", "most", "longest", "one", "mixed")

    def __init__(self, ids: np.ndarray):
        self.ids, self.below, self.docs = ids, {}, []
        self.least, self.most, self.longest, self.one, self.mixed = 1 << 60, 0, 0, -1, False


def trie_join(sizes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, known: list | None = None) -> list[int]:
    """Class of each document of one family: the index of its first member.

    sizes: |set| including n-grams of that document alone; sets: the others, ascending in the global order.
    known: documents with equal values are in one class from the start.
    """
    n = len(sets)
    classes = Classes(n)
    if known is not None:
        seen: dict = {}
        for i, k in enumerate(known):
            classes.join(i, seen.setdefault(k, i))
    flat = np.concatenate(sets) if n else np.zeros(0, np.int64)
    distinct, local = np.unique(flat, return_inverse=True)
    local = local.astype(np.int32)
    cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    rows = [local[cuts[i] : cuts[i + 1]] for i in range(n)]
    root = Node(np.zeros(0, np.int32))
    mark = np.zeros(len(distinct), bool)
    whole, both = 100 + percent, percent  # linked: whole * overlap >= percent * (|A| + |B|)
    inserted: set[int] = set()
    for x in range(n):
        own, size = rows[x], int(sizes[x])
        mark[own] = True
        stack = [(root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if node.one < 0 or node.most * 100 < both * size or node.least * both > 100 * size:
                continue
            if not node.mixed and classes.find(node.one) == classes.find(x):
                continue
            ids = node.ids
            rest = len(own)
            if len(ids):
                overlap += int(np.count_nonzero(mark[ids]))
                rest -= int(np.searchsorted(own, ids[-1], "right"))
                depth += len(ids)
            if whole * (overlap + min(rest, node.longest - depth)) < both * (size + node.least):
                continue
            for y in node.docs:
                if whole * overlap >= both * (size + int(sizes[y])):
                    classes.join(x, y)
            stack += [(child, overlap, depth) for child in node.below.values()]
            if len(inserted) and classes.find(x) in inserted and len(inserted) == 1:
                break
        mark[own] = False
        inserted = {classes.find(i) for i in inserted} | {classes.find(x)} if len(inserted) <= 64 or x % 64 == 0 else inserted | {classes.find(x)}
        _insert(root, own, x, size, classes)
    return [classes.find(i) for i in range(n)]


def _insert(root: Node, own: np.ndarray, x: int, size: int, classes: Classes) -> None:
    node, depth, mine = root, 0, classes.find(x)
    while True:
        if node.one < 0:
            node.one = x
        elif not node.mixed and classes.find(node.one) != mine:
            node.mixed = True
        node.least, node.most, node.longest = min(node.least, size), max(node.most, size), max(node.longest, len(own))
        if depth == len(own):
            node.docs.append(x)
            return
        first = int(own[depth])
        child = node.below.get(first)
        if child is None:
            child = node.below[first] = Node(own[depth:])
            depth = len(own)
            node = child
            continue
        rest = own[depth : depth + len(child.ids)]
        apart = np.flatnonzero(child.ids[: len(rest)] != rest)
        same = int(apart[0]) if len(apart) else len(rest)
        if same < len(child.ids):  # split the edge
            upper = Node(child.ids[:same])
            upper.least, upper.most, upper.longest, upper.one, upper.mixed = child.least, child.most, child.longest, child.one, child.mixed
            child.ids = child.ids[same:]
            upper.below[int(child.ids[0])] = child
            node.below[first] = child = upper
        depth += same
        node = child


def _chains(tok: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int):
    """Spans of sizes in the order of token and size, and which have the next as a possible partner, directly or through those before."""
    order = np.lexsort((doc, high, low, tok))
    tok, doc, low, high = tok[order], doc[order], low[order], high[order]
    if not len(tok):
        return tok, doc, low, high, np.zeros(0, bool)
    # the largest size of the token so far
    nth = np.concatenate(([0], np.cumsum(tok[1:] != tok[:-1])))
    step = int(high.max()) + 1
    most = np.maximum.accumulate(nth * step + high) - nth * step
    near = (tok[1:] == tok[:-1]) & (100 * most[:-1] >= percent * low[1:])
    return tok, doc, low, most, near


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """As few edges that connect the same ids."""
    if not len(u):
        return [], []
    pairs = np.unique(np.stack([u, v], 1), axis=0)
    ids, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(-1, 2)
    classes, out = Classes(len(ids)), []
    for a, b in place.tolist():
        if classes.join(a, b):
            out.append((a, b))
    return [int(ids[a]) for a, _ in out], [int(ids[b]) for _, b in out]


def families(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, component): documents that share an n-gram of their prefixes and whose sizes allow a link, directly or through others."""
    n_parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def prefixes(batches):
        for batch in batches:
            tok, doc, size = [], [], []
            for d, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = X.unpack(blob, TOKEN_BYTES).astype(np.int64)
                k = n - int(needed(np.int64(n), percent)) + 1 - (n - len(ids))
                tok.append(ids[:k])
                doc.append(np.full(min(k, len(ids)), d))
                size.append(np.full(min(k, len(ids)), n))
            if not tok:
                continue
            size = np.concatenate(size)
            tok, doc, low, high, near = _chains(np.concatenate(tok), np.concatenate(doc), size, size, percent)
            u, v = _forest(doc[:-1][near], doc[1:][near])
            # each chain goes on as one span: any size between its ends is near one of its members
            begin, end = np.append(True, ~near), np.append(~near, True)
            tie = np.array(u, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([tok[begin], tie]), pa.int64()), pa.array(np.concatenate([doc[begin], tie]), pa.int64()), pa.array([*low[begin].tolist(), *[None] * len(u)], pa.int64()), pa.array([*high[end].tolist(), *v], pa.int64())],
                ["tok", "doc", "low", "high"],
            )

    def edges(batches):
        table = pa.Table.from_batches(list(batches), schema=pa.schema([(c, pa.int64()) for c in ("tok", "doc", "low", "high")]))
        span = table.filter(table.column("low").is_valid())
        tie = table.filter(table.column("low").is_null())  # doc and high are two documents of one family
        _, doc, _, _, near = _chains(*(span.column(i).to_numpy() for i in range(4)), percent)
        u, v = _forest(np.concatenate([doc[:-1][near], tie.column(1).to_numpy()]), np.concatenate([doc[1:][near], tie.column(3).to_numpy()]))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    entries = sets.select("doc_id", "n_shingles", "tokens").mapInArrow(lean(prefixes), "tok long, doc long, low long, high long")
    return components(entries.repartition(n_parts, "tok").mapInArrow(lean(edges), "u long, v long"))


def _grouped(batches, key: int):
    """Lists of rows with an equal key, from batches sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _join_groups(rows: DataFrame, percent: int) -> DataFrame:
    """(part, doc_id, root) for rows (part, doc_id, n_shingles, tokens, known) joined within each part; root: the smallest doc_id of its class."""

    def run(batches):
        for group in _grouped(batches, 0):
            group.sort(key=lambda r: r[1])
            known = [("class", r[4]) if r[4] is not None else ("doc", r[1]) for r in group]
            roots = trie_join(np.array([r[2] for r in group]), [X.unpack(r[3], TOKEN_BYTES).astype(np.int64) for r in group], percent, known)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in group], pa.string()), pa.array([r[1] for r in group], pa.int64()), pa.array([group[i][1] for i in roots], pa.int64())], ["part", "doc_id", "root"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = rows.select("part", "doc_id", "n_shingles", "tokens", "known").repartition(n, "part").sortWithinPartitions("part")
    return ready.mapInArrow(lean(run), "part string, doc_id long, root long")


def classes(sets: DataFrame, *, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, root) of the documents that link with others; sets from shared_sets(), one row for each distinct set."""
    family = materialise(families(sets, percent))
    rows = sets.join(family, F.col("doc_id") == F.col("id")).select("doc_id", "n_shingles", "tokens", F.col("component").alias("family"))
    rows = materialise(rows)
    discard(family)
    none = F.lit(None).cast("long").alias("known")
    n_tokens = F.length("tokens") / TOKEN_BYTES
    total = rows.groupBy("family").agg(F.ceil(F.sum(n_tokens) / block_tokens).cast("int").alias("n_blocks"))
    large = materialise(total.where("n_blocks > 1"))
    if large.isEmpty():
        return _join_groups(rows.select(F.col("family").cast("string").alias("part"), "doc_id", "n_shingles", "tokens", none), percent).select("doc_id", "root")
    small = rows.join(large, "family", "left_anti")
    done = _join_groups(small.select(F.col("family").cast("string").alias("part"), "doc_id", "n_shingles", "tokens", none), percent).select("doc_id", "root")
    # blocks of a large family, each joined within
    block = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks"))
    split = rows.join(large, "family").select("family", "n_blocks", block.alias("block"), "doc_id", "n_shingles", "tokens")
    part = F.concat_ws("/", "family", "block")
    within = materialise(_join_groups(split.select(part.alias("part"), "doc_id", "n_shingles", "tokens", none), percent))
    split = materialise(split.join(within.select("doc_id", "root"), "doc_id"))
    # the first member of each block's largest class stands for it, and all of these are joined
    heads = split.groupBy("family", "block", "root").count().groupBy("family", "block").agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("doc_id"))
    heads = split.join(heads.select("doc_id"), "doc_id", "left_semi")
    linked = _join_groups(heads.select(F.col("family").cast("string").alias("part"), "doc_id", "n_shingles", "tokens", none), percent)
    edges = materialise(split.select(F.col("doc_id").alias("u"), F.col("root").alias("v")).union(linked.select("doc_id", "root")))
    label = components(edges)
    split = materialise(split.join(label, F.col("doc_id") == F.col("id"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("id", "component", "root"))
    # what is outside the family's main class meets every block
    main = split.groupBy("family", "label").count().groupBy("family").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("main"))
    apart = split.join(main, "family").where("label <> main")
    chunks = apart.groupBy("family").agg(F.ceil(F.sum(n_tokens) / block_tokens).cast("int").alias("n_chunks"))
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("n_chunks"))
    probes = apart.join(chunks, "family").select("family", "n_blocks", chunk.alias("chunk"), "doc_id", "n_shingles", "tokens", "label").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    probes = probes.withColumn("part", F.concat_ws("/", "family", "block", "chunk"))
    asked = probes.select("family", "block", "part").distinct()
    members = split.join(asked, ["family", "block"]).select("part", "doc_id", "n_shingles", "tokens", F.col("label").alias("known"))
    met = members.union(probes.select("part", "doc_id", "n_shingles", "tokens", F.col("label").alias("known"))).dropDuplicates(["part", "doc_id"])
    crossed = _join_groups(met, percent)
    final = components(edges.union(crossed.select("doc_id", "root")))
    return done.union(split.select("doc_id").join(final, F.col("doc_id") == F.col("id")).select("doc_id", F.col("component").alias("root")))


def link(docs: DataFrame, *, n: int = NGRAM, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    all_sets = materialise(shared_sets(docs, n=n, percent=percent))
    near = all_sets.where("tokens IS NOT NULL")
    # equal sets: only those that other documents share in full can have equals
    print_ = F.when(F.length("tokens") == TOKEN_BYTES * F.col("n_shingles"), F.sha2("tokens", 256)).otherwise(F.concat_ws("/", "doc_id", F.sha2("tokens", 256), "n_shingles"))
    # a set that very many documents have is met in SALTS places
    near = near.withColumn("print", print_).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    first = near.groupBy("print").agg(F.min("doc_id").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = materialise(near.select("doc_id", "print", "salt").join(first, ["print", "salt"]).select("doc_id", "first"))
    heads = materialise(near.select("doc_id", "n_shingles", "tokens").join(copies.where("doc_id = first").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "tokens"]))
    roots = materialise(classes(heads, percent=percent, block_tokens=block_tokens))
    discard(heads)
    label = copies.join(roots.groupBy(F.col("doc_id").alias("head")).agg(F.min("root").alias("root")), F.col("first") == F.col("head"), "left")
    label = label.select("doc_id", F.coalesce("root", "first").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    sizes = materialise(all_sets.select("doc_id", "n_shingles"))
    discard(all_sets)
    out = sizes.join(label, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the first of their class, with all their columns. Rows with a null doc_id stay; repeats of a row (doc_id and text) go."""
    found = materialise(link(docs, **options))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    repeats = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(repeats).select(*docs.columns)


def op1_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_prefix_tree_join": op1_prefix_tree_join}
_W = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = {
    "op1_prefix_tree_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_W}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT s.*, count(*) OVER (PARTITION BY g) AS df FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id WHERE a.df > 1 AND b.df > 1 GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""
}
