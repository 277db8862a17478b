r"""N-gram Jaccard join with adaptive multi-match prefixes, up to connected components.

A document's set is its distinct ``k``-word shingles (words
``[^\x20\x09-\x0D]+``, A-Z lower-cased; a shorter document is one shingle, one
without words has an empty set and links with nothing).  Two documents link when
``100 * |A & B| >= percent * |A | B|``.  Links are needed only up to connectivity:
the result is each document's component.

Prefixes.  Tokens get one global order, rare before frequent; a set of ``n`` tokens
that links with another shares at least ``need(n) = ceil(t * n)`` of them, so the
``l``-prefixes (the first ``n - need(n) + l`` tokens) of two linked sets share at
least ``l`` tokens.  ``l`` is chosen per document by the estimated number of
candidates behind its 1-prefix: expensive documents get longer prefixes and have to
share more tokens.  For a pair the smaller ``l`` is required.  The order comes from
counts over all documents (:func:`frequent_tokens`); it steers cost only, any
order gives the same result.

Budget.  Of two sets, let ``a`` be the one whose prefix ends earlier in the order: all that
its prefix shares with the other lies in the other's prefix too.  So the two share at
most ``shared prefix tokens + n - prefix`` of ``a``, and a link takes
``ceil(t / (1 + t) * (n + m))``: a link needs that many shared prefix tokens, and ``a`` has
a largest partner size.  Pairs and list entries out of budget are dropped.

Copies.  Equal sets are one node.  Groups of near copies are not expanded into
pairs: ``STAR_ROUNDS`` rounds link the members of each token's list to its hub, the most
central node (the one with the largest share of frequent tokens), which joins such
a group by a linear number of verified links.  Then a token whose list lies in one
component needs nothing more.  The rest is counted exactly: lists with the same hub
meet in one unit (split into pairs of node blocks where a hub has many nodes), shared
prefix tokens are counted inside the task, only pairs across components that can
still have the shared tokens a link needs leave it, and those whose counts over all
hubs suffice are verified.  No link
is lost.  Everything else per list or node is an aggregate with partial sums or a join
with one row per key on one side.

Nodes are 64-bit set hashes, checked against a second hash and the size: two
different sets under one node raise an error instead of being merged.

Defined cases: null, empty and wordless texts have ``n_shingles`` 0 and are their own
component; a row with a null ``doc_id`` belongs to no component (null) and links
nothing; repeated rows and rows sharing an id are judged each by its text;
an empty table gives an empty result; further columns are ignored, and kept by
:func:`keep_one`, which keeps one row of every component and every row without words or
id: of rows sharing an id each text stands for itself, so both stay unless they link; of
rows repeated with id and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.llm.graph import components
from pitchside.llm.textops import (gram_hashes, let_go, lower_ascii, materialise, mix64, small_batches, text_bytes,
                                   text_slices, tidy, word_hashes, word_spans)

SHINGLE_WORDS = 4
PERCENT = 85
STAR_ROUNDS = 1
MAX_MATCHES = 4              # the longest l
COST_STEP = 64               # estimated candidates of a 1-prefix from which l grows, four-fold each step
FREQUENT_TOKENS = 250_000    # rows of the broadcast order table: the most frequent shingles of the corpus
COUNT_CHUNK = 1_500_000      # tokens counted together inside a task
BLOCK_NODES = 500            # nodes of one block of a hub; a unit counts the pairs of two blocks
TOKEN_CHUNK = 4096           # tokens counted together in a unit
BROADCAST_ROWS = 1_000_000   # id lists are broadcast up to this counted size, joined by shuffle beyond
BATCH_BYTES = 1 << 20


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted per text, and the number of each."""
    data = lower_ascii(np.frombuffer(b" ".join(texts), dtype=np.uint8))
    start, end = word_spans(data)
    edge = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(edge, start, side="right")
    words = np.bincount(owner, minlength=len(texts))
    items = word_hashes(data, start, end)
    grams = gram_hashes(items, k)
    inside = owner[:len(grams)] == owner[k - 1:]
    tokens, of = [grams[inside]], [owner[:len(grams)][inside]]
    for n in range(1, k):                              # shorter texts: the whole sequence
        short = np.flatnonzero(words == n)
        if len(short):
            first = np.searchsorted(owner, short)
            tokens.append(gram_hashes(items, n)[first] ^ np.uint64(n))
            of.append(short)
    token, of = np.concatenate(tokens), np.concatenate(of)
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
    return token[new], np.bincount(of[new], minlength=len(texts))


def set_keys(token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every set."""
    some = size > 0
    first = (np.cumsum(size) - size)[some]
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        key = np.zeros(len(size), dtype=np.uint64)
        if len(first):
            key[some] = mix64(np.add.reduceat(mix64(token ^ np.uint64(salt)), first) + size[some].astype(np.uint64))
        out.append(key.view(np.int64))
    return out[0], out[1]


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _batches(batches: Iterator[pa.RecordBatch], *more: str):
    for batch in batches:
        for part in text_slices(batch, "text", BATCH_BYTES):
            yield part.column("doc_id"), list(text_bytes(part.column("text"))), *(part.column(c) for c in more)


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """One pass: rows (doc_id, text_key, n, node, check) of documents, and (token, count) of tokens seen twice in a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "n", "node", "check", "token", "count"]

        def counted(tokens: list[np.ndarray]) -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(tokens), return_counts=True)
            value, count = value[count > 1].view(np.int64), count[count > 1]
            none = pa.nulls(len(value), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(value), pa.array(count)], names)

        let_go()
        held, n_held = [], 0
        for ids, texts, keys in _batches(batches, "text_key"):
            token, size = shingle_sets(texts, k)
            node, check = set_keys(token, size)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array(size), pa.array(node), pa.array(check), none, none], names)
            held.append(token)
            n_held += len(token)
            if n_held >= COUNT_CHUNK:
                yield counted(held)
                held, n_held = [], 0
        if n_held:
            yield counted(held)

    return docs.select(F.col("doc_id").cast("long"), "text", _text_key().alias("text_key")).mapInArrow(
        tidy(run), "doc_id long, text_key long, n long, node long, check long, token long, count long")


def frequent_tokens(counts: DataFrame, limit: int = FREQUENT_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens (sorted) and their counts: at most ``limit`` rows reach the driver."""
    top = (counts.groupBy("token").agg(F.sum("count").alias("count")).where("count > 3")
           .orderBy(F.desc("count"), "token").limit(limit).toPandas())
    token = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["count"].to_numpy(dtype=np.int64)[order]


def need(n, percent: int):
    """Least overlap of a set of ``n`` tokens with anything it links with."""
    return -(-n * percent // 100)


def prefixes(token: np.ndarray, size: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int):
    """Prefix tokens, their set's index, and per set l, the share of frequent tokens and where the prefix ends."""
    value, count = frequent
    estimate = np.ones(len(token), dtype=np.int64)
    if len(value):
        at = np.minimum(np.searchsorted(value, token), len(value) - 1)
        hit = value[at] == token
        estimate[hit] = count[at[hit]]
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(owner * (np.int64(1) << 36) + np.minimum(estimate, (1 << 36) - 1), kind="stable")
    token, estimate = token[order], estimate[order]
    first = np.cumsum(size) - size
    place = np.arange(len(token)) - np.repeat(first, size)
    base = size - need(size, percent)                   # tokens before the first match has to come
    in_one = place < np.repeat(base + 1, size)
    cost = np.bincount(owner[in_one], weights=estimate[in_one] - 1, minlength=len(size))
    matches = 1 + np.clip(np.ceil(np.log(np.maximum(cost, 1) / COST_STEP) / np.log(4)), 0, MAX_MATCHES - 1).astype(np.int64)
    matches = np.minimum(matches, np.maximum(need(size, percent), 1))
    inside = place < np.repeat(base + matches, size)
    share = np.bincount(owner, weights=estimate > 1, minlength=len(size)) / np.maximum(size, 1)
    # where the prefix ends in the order, to 32 bits of the hash (equal values: unknown which ends earlier)
    last = np.zeros(len(size), dtype=np.int64)
    at = (first + base + matches - 1)[size > 0]
    last[size > 0] = (np.minimum(estimate[at], (1 << 31) - 1) << 32) | (token[at] >> np.uint64(32)).astype(np.int64)
    return token[inside], owner[inside], matches, share, last


def postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """Prefix entries (token, node, n, l, share, last); equal sets of one batch send theirs once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            token, size = shingle_sets(texts, k)
            node, _ = set_keys(token, size)
            t, owner, matches, share, last = prefixes(token, size, shared.value, percent)
            once = np.zeros(len(size), dtype=bool)
            once[np.unique(node, return_index=True)[1]] = True
            once &= ~ids.is_null().to_numpy(zero_copy_only=False)
            keep = once[owner]
            t, owner = t[keep], owner[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.view(np.int64)), pa.array(node[owner]),
                 pa.array(size[owner].astype(np.int32)), pa.array(matches[owner].astype(np.int32)),
                 pa.array(np.round(share[owner] * 1000).astype(np.int32)), pa.array(last[owner])],
                ["token", "node", "n", "l", "share", "last"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "token long, node long, n int, l int, share int, last long")


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Sets:
    """Token arrays of the nodes that verification asks for, read once per node from its smallest document."""

    def __init__(self, docs: DataFrame, rows: DataFrame, k: int):
        self.docs, self.rows, self.k = docs.select(F.col("doc_id").cast("long"), "text"), rows, k

    def of(self, nodes: DataFrame) -> DataFrame:
        k = self.k
        wanted = materialise(self.rows.where("doc_id IS NOT NULL").join(nodes, "node").groupBy("node")
                             .agg(F.min("doc_id").alias("doc_id")), "set_owners")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts in _batches(batches):
                token, size = shingle_sets(texts, k)
                node, _ = set_keys(token, size)
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.ListArray.from_arrays(pa.array(offsets), pa.array(token.view(np.int64)))],
                    ["node", "tokens"])

        found = (self.docs.join(_checked(wanted.select("doc_id")), "doc_id", "left_semi")
                 .mapInArrow(tidy(run), "node long, tokens array<long>"))
        return materialise(found.join(_checked(wanted.select("node")), "node", "left_semi"), "sets")


def _verified(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets link."""
    pairs = materialise(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    tokens = sets.of(nodes)
    left = tokens.select(F.col("node").alias("u"), F.col("tokens").alias("a"))
    right = tokens.select(F.col("node").alias("v"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return materialise(pairs.join(left, "u").join(right, "v")
                       .where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v").distinct(), "links")


def _in_budget(a: str, b: str, percent: int) -> Column:
    """Sizes within the threshold of each other, and the side whose prefix ends earlier has budget for the other's
    size (both may where the ends tie)."""
    def side(x: str, y: str) -> Column:
        return (F.col(f"{x}.last") <= F.col(f"{y}.last")) & (F.col(f"{y}.n") <= F.col(f"{x}.most"))

    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (side(a, b) | side(b, a))


def _rest(n: Column, l: Column, percent: int) -> Column:
    """Tokens after the prefix."""
    return n - F.least(n, n - _need(n, percent) + l)


def _needed(a: str, b: str, percent: int) -> Column:
    """Shared prefix tokens that a link between ``a`` and ``b`` takes at least."""
    rest_a, rest_b = (_rest(F.col(f"{x}.n"), F.col(f"{x}.l"), percent) for x in (a, b))
    rest = (F.when(F.col(f"{a}.last") < F.col(f"{b}.last"), rest_a).when(F.col(f"{a}.last") > F.col(f"{b}.last"), rest_b)
            .otherwise(F.greatest(rest_a, rest_b)))
    overlap = F.ceil((F.col(f"{a}.n") + F.col(f"{b}.n")) * F.lit(percent / (100 + percent)) - F.lit(1e-9))
    return F.greatest(overlap - rest, F.lit(1))


def unit_pairs(node: np.ndarray, token: np.ndarray, block: np.ndarray, component: np.ndarray, n: np.ndarray, rest: np.ndarray,
               last: np.ndarray, lists: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one unit that may have the shared prefix tokens that a link needs.

    ``lists`` is the number of a node's lists anywhere: those outside the unit may all be shared as well.
    """
    node, first, at = np.unique(node, return_index=True, return_inverse=True)
    token, of = np.unique(token, return_inverse=True)
    m = len(node)
    count = np.zeros((m, m), dtype=np.float32)
    for lo in range(0, len(token), TOKEN_CHUNK):
        some = (of >= lo) & (of < lo + TOKEN_CHUNK)
        holds = np.zeros((m, min(TOKEN_CHUNK, len(token) - lo)), dtype=np.float32)
        holds[at[some], of[some] - lo] = 1
        count += holds @ holds.T
    outside = lists[first] - np.bincount(at, minlength=m)
    size, rest, last = n[first], rest[first], last[first]
    overlap = np.ceil((size[:, None] + size[None, :]) * (percent / (100 + percent)) - 1e-9)
    earlier = last[:, None] < last[None, :]
    tie = last[:, None] == last[None, :]
    most_rest = np.where(tie, np.maximum(rest[:, None], rest[None, :]), np.where(earlier, rest[:, None], rest[None, :]))
    needed = np.maximum(overlap - most_rest, 1)
    may = (count > 0) & (count + np.minimum(outside[:, None], outside[None, :]) >= needed)
    may &= component[first][:, None] != component[first][None, :]
    may &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    blocks = block[first]
    if blocks.min() != blocks.max():
        may &= blocks[:, None] != blocks[None, :]           # pairs within a block have their own unit
    u, v = np.nonzero(np.triu(may, 1))
    return node[u], node[v], count[u, v].astype(np.int64), needed[u, v].astype(np.int64)


def remaining_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(u, v) across components that share enough prefix tokens, counted unit by unit."""
    hubs = live.groupBy("token").agg(F.max(F.struct("share", "node")).alias("h")).select("token", F.col("h.node").alias("hub"))
    lists = live.groupBy("node").agg(F.count("*").cast("int").alias("lists"))
    entries = live.join(hubs, "token").join(lists, "node")
    # hubs with several blocks, few: counted, so that no hub's entries have to meet in one task
    blocks = materialise(entries.select("hub", "node").distinct().groupBy("hub").agg(F.count("*").alias("c"))
                         .where(F.col("c") > BLOCK_NODES).select("hub", F.ceil(F.col("c") / BLOCK_NODES).cast("int").alias("blocks")), "hub_blocks")
    rest = _rest(F.col("n"), F.col("l"), percent)
    units = (entries.join(_checked(blocks), "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "token", "node",
                     "block", "component", F.col("n").cast("long").alias("n"), rest.cast("long").alias("rest"), "last", "lists"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            c = {k: np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in held[0].schema.names}
            key = np.stack([c["hub"], c["i"].astype(np.int64), c["j"].astype(np.int64)])
            cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
            found = [unit_pairs(*[c[k][a:b] for k in ("node", "token", "block", "component", "n", "rest", "last", "lists")], percent)
                     for a, b in zip(cut[:-1], cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v", "shared", "needed"])

        held: list[pa.RecordBatch] = []
        for batch in batches:                           # a unit may span batches: hold back the last one
            if not batch.num_rows:
                continue
            c = [batch.column(k).to_numpy() for k in ("hub", "i", "j")]
            same = np.logical_and.reduce([x == x[-1] for x in c])
            start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if start or (held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in ("hub", "i", "j"))):
                yield pairs([*held, batch.slice(0, start)] if start else held)
                held = []
            held.append(batch.slice(start))
        if held:
            yield pairs(held)

    return (units.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
            .mapInArrow(tidy(run), "u long, v long, shared long, needed long")
            .groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed"))   # over all hubs
            .where("shared >= needed").select("u", "v"))


def _need(n: Column, percent: int) -> Column:
    return F.ceil(n * F.lit(percent) / F.lit(100) - F.lit(1e-9)).cast("long")


def _linked_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, component and component_id of every row of ``docs``; component is null without words or id."""
    small_batches(docs.sparkSession)
    scan = materialise(document_sets(docs, k), "set_scan")
    rows = scan.where("node IS NOT NULL").select("doc_id", "text_key", "n", "node", "check")
    frequent = frequent_tokens(scan.where("token IS NOT NULL").select("token", "count"))

    entries = materialise(postings(docs, frequent, k, percent), "entries")      # read by a count and a join
    repeated = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    lists = materialise(entries.join(repeated, "token", "left_semi").distinct(), "lists")
    lists_two = lists.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    live = lists.join(lists_two, "token", "left_semi")
    # budget of every node: shared prefix tokens + tokens after the prefix bound the overlap, hence the partner's size
    prefix = F.least(F.col("n"), F.col("n") - _need(F.col("n"), percent) + F.col("l"))
    budget = live.groupBy("node").agg(F.count("*").alias("shared"), F.max("n").alias("n"), F.max("l").alias("l")).select(
        "node", (F.floor((F.col("shared") + F.col("n") - prefix) * F.lit(100 + percent) / F.lit(percent) + F.lit(1e-9))
                 - F.col("n")).cast("long").alias("most"))
    live = materialise(live.join(budget, "node"), "lists")

    sets, links, tried = _Sets(docs, rows, k), None, None
    label = live.select("node").distinct().withColumn("component", F.col("node"))
    for _ in range(STAR_ROUNDS):
        live = _prune(live, label)
        hubs = live.groupBy("token").agg(F.max(F.struct("share", "node", "n", "l", "most", "last", "component")).alias("hub"))
        to_hub = live.withColumn("own", F.struct("node", "n", "l", "most", "last")).join(hubs, "token").where(
            (F.col("component") != F.col("hub.component")) & _in_budget("own", "hub", percent))
        # verified where the lists led by the hub alone hold enough; other links are left to the exact count below
        likely = (to_hub.groupBy(F.col("node").alias("u"), F.col("hub.node").alias("v"))
                  .agg(F.count("*").alias("c"), F.max(_needed("own", "hub", percent)).alias("needed")).where("c >= needed"))
        likely = materialise(likely.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), "likely")
        found = _verified(likely, sets, percent)
        links, tried = (found, likely) if links is None else (links.union(found), tried.union(likely))
        label = _labels(label, links)
    open_pairs = remaining_pairs(_prune(live, label), percent).join(tried, ["u", "v"], "left_anti")
    rest = _verified(open_pairs, sets, percent)
    label = _labels(label, links.union(rest)).where(F.col("node") != F.col("component"))

    sizes = rows.groupBy("node").agg(F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n0"),
                                     F.max("n").alias("n1"), F.min("doc_id").alias("first_id"))
    sizes = sizes.withColumn("first_id", F.when((F.col("c0") == F.col("c1")) & (F.col("n0") == F.col("n1")), F.col("first_id"))
                             .otherwise(F.raise_error("two different shingle sets share a node"))).select("node", "first_id")
    of_node = sizes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_node.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = of_node.join(smallest, "component").select("node", "component", "component_id")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return (rows.join(of_node, "node")
            .select("doc_id", "text_key", "n", F.when(~alone, F.col("component")).alias("component"),
                    F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def linked_components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    return _linked_rows(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _prune(live: DataFrame, label: DataFrame) -> DataFrame:
    """List entries that can still link two components: lists with two of them, partners in budget."""
    now = live.drop("component").join(label, "node")
    span = now.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"),
                                    F.min("n").alias("least_n"), F.max("most").alias("most_n")).where("c0 <> c1")
    return materialise(now.join(span, "token").where("least_n <= most OR n <= most_n").select(*now.columns), "lists")


def _labels(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the links so far; nodes without a link are their own component."""
    found = components(links)
    return materialise(label.select("node").join(found, "node", "left")
                       .select("node", F.coalesce("component", "node").alias("component")), "labels")


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of every component: of the document whose id names it, and of its texts in the component the
    one with the smallest hash.  Rows are told apart by id and text (see the defined cases)."""
    rows = materialise(_linked_rows(docs, k, percent), "components")
    named = rows.where("component IS NOT NULL")
    first = named.where("doc_id = component_id").groupBy("component").agg(F.min("text_key").alias("first_key"))
    gone = materialise(named.join(first, "component").where("doc_id <> component_id OR text_key <> first_key")
                       .select("doc_id", "text_key").distinct(), "gone")
    twice = materialise(rows.where("doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count("*").alias("c"))
                        .where("c > 1").select("doc_id", "text_key"), "twice")

    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__text_key", _text_key())

    def of(frame: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        named = _checked(pairs.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")))
        return frame.join(named, ["__id", "__text_key"], how)

    kept = of(keyed, gone, "left_anti")
    if not twice.isEmpty():
        kept = of(kept, twice, "left_anti").unionByName(of(kept, twice, "left_semi").dropDuplicates(["__id", "__text_key"]))
    return kept.select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT DISTINCT u AS node, u AS reached FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reached),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = documents.doc_id
"""
