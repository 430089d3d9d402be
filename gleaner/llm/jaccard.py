"""Exact Jaccard join of shingle sets through a token-group matrix.

1. *Screen.* A document whose partner shares 80 % of its set must share some of
   its ``p`` least tokens. These prefixes are counted once; a document with too
   few shared ones has no partner. It leaves with its own id.
2. *Groups.* Documents with one least token form a group of similar ones, in blocks
   of a bounded size; each block is clustered where it lies.
3. *Matrix.* Each block's union of prefix tokens, against the prefixes of the
   documents of other blocks. What a document shares with the union bounds its
   overlap with every member; only blocks whose bound reaches the threshold are
   opened, and their members verified on whole sets.
4. *Components.* Verified links and clusters give the components.

Tokens that a large share of documents have come last in every prefix, so that
common passages open nothing by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, landed
from .components import connected
from .shingles import scramble, shingle_sets

PERCENT = 80  # fixed by the query contract
#: Extra tokens of a prefix, as a share of the set: so many must be shared as well.
EXTRA = 0.1
#: Members of a group that are clustered in one task; a larger group is dealt out.
BLOCK = 400
#: Groups over this share of all sets are dealt out by a list that all tasks get.
LARGE_SHARE = 1 / 200_000
#: Sets of a task that are remembered to send equal ones once.
SEEN = 1_000_000
#: A token that more than this share of all sets have comes last; the list is
#: at most the mean set size times its inverse.
FREQUENT = 1 / 1000
#: Bits of a token that name its cell in the first count, and of those that name the cell's part.
CELL_BITS, PART_BITS = 20, 6
NO_ID = (1 << 63) - 1  # a null doc_id: never the smallest of its component

SCHEMA = "did long, row_key long, n int, rid long, tokens binary"


def least_overlap(n, percent: int = PERCENT):
    """Tokens of a set of size n that any partner shares."""
    return -(-percent * n // 100)


def slack(n):
    return np.maximum(1, (EXTRA * n).astype(np.int64) if isinstance(n, np.ndarray) else int(EXTRA * n))


def prefix_length(n, percent: int = PERCENT):
    return np.minimum(n, n - least_overlap(n, percent) + slack(n))


def linked(overlap, n, m, percent: int = PERCENT):
    return 100 * overlap >= percent * (n + m - overlap)


def _partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    batches = [b for b in batches if len(b)]
    return pa.Table.from_batches(batches) if batches else None


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for c in
            (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) for x in c]


def screen(rows: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """Keys (40 bits of ``row_key``) of documents that may have a partner.

    A batch sends each token of its prefixes once, with one owner, as packed
    arrays; owners of a token that the batch holds twice are known already. So a
    token of any frequency costs one entry per batch. Two keys that happen to be
    equal only let a document through, which the verification then settles."""

    def pack(values: np.ndarray, width: int) -> bytes:
        return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()

    def wide(blobs, width: int) -> np.ndarray:
        data = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        out = np.zeros((len(data), 8), np.uint8)
        out[:, :width] = data
        return out.view("<u8")[:, 0].astype(np.int64)

    def row(part=None, batch=None, tokens=None, owners=None, flags=None):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([batch], pa.int64()), pa.array([tokens], pa.binary()),
                                           pa.array([owners], pa.binary()), pa.array([flags], pa.binary())], SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text")) if len(batch) else []
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets])
            keys = batch.column("row_key").to_numpy().view(np.uint64)
            name = int(scramble(keys + np.arange(len(keys), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
            lengths = prefix_length(sizes, percent)
            token = np.concatenate([s[:k] for s, k in zip(sets, lengths)])
            owner = np.repeat(np.arange(len(sets)), lengths)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            new, last = np.ones(len(token), bool), np.ones(len(token), bool)
            new[1:] = last[:-1] = token[1:] != token[:-1]
            several = ~(new & last)
            # found so far, less the shared tokens that a document needs
            have = np.bincount(owner[several], minlength=len(sets)) - slack(sizes)
            have = np.where(sizes > 0, have, -(1 << 30))
            yield row(int(name % parts), name, None, pack(keys, 5), have.astype("<i4").tobytes())
            token, owner, shared = token[new], owner[new], several[new]
            part = (token >> np.uint64(40)) % np.uint64(parts)
            for p in range(parts):
                at = np.flatnonzero(part == p)
                if len(at):
                    yield row(p, name, pack(token[at], 6), pack(owner[at], 3), shared[at].tobytes())

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        if table is None:
            return
        lists = table.filter(table.column("tokens").is_valid())
        for r in table.filter(table.column("tokens").is_null()).to_pylist():
            yield row(**r)
        token = wide(lists.column("tokens").to_pylist(), 6)
        owner = wide(lists.column("owners").to_pylist(), 3)
        shared = np.frombuffer(b"".join(lists.column("flags").to_pylist()), bool)
        sender = np.repeat(np.arange(len(lists)), [len(x) for x in lists.column("flags").to_pylist()])
        order = np.argsort(token)
        same = token[order[1:]] == token[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = order[twice]
        found = found[~shared[found]]  # a token that its batch holds twice is counted there
        names = lists.column("batch").to_numpy()
        pair, n = np.unique(sender[found] << 24 | owner[found], return_counts=True)
        for i in np.unique(pair >> 24):
            mine = pair >> 24 == i
            yield row(None, int(names[i]), None, pack(pair[mine] & 0xFFFFFF, 3), n[mine].astype("<u4").tobytes())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        if table is None:
            return
        have: dict[int, list] = {}
        replies = []
        for r in table.to_pylist():
            if r["part"] is None:
                replies.append(r)
            else:
                have.setdefault(r["batch"], []).append((wide([r["owners"]], 5), np.frombuffer(r["flags"], "<i4").copy()))
        for r in replies:
            for _, count in have[r["batch"]]:
                count[wide([r["owners"]], 3)] += np.frombuffer(r["flags"], "<u4").astype(np.int32)
        for known in have.values():
            for keys, count in known:
                yield pa.RecordBatch.from_arrays([pa.array(keys[count >= 0])], ["key"])

    kinds = "part int, batch long, tokens binary, owners binary, flags binary"
    sent = rows.select("row_key", "text").mapInArrow(send, kinds)
    return (sent.repartition("part").mapInArrow(receive, kinds)
            .repartition("batch").mapInArrow(tally, "key long").distinct())


SENT = ["part", "batch", "tokens", "owners", "flags"]


def with_sets(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """All documents with their set sizes; those that passed the screen with their
    sets too, unless the task has sent an equal set. ``rid`` identifies a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if not len(batch):
                continue
            sets = shingle_sets(batch.column("text"))
            passed = batch.column("passed").to_pylist()
            a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            for i, s in enumerate(sets):
                a[i], b[i] = s.sum(dtype=np.uint64), scramble(s + np.uint64(0x5851F42D)).sum(dtype=np.uint64)
            rid = scramble(a ^ b)
            sent: list[bytes | None] = []
            for number, s, p in zip(rid.tolist(), sets, passed):
                sent.append(s.tobytes() if p and len(s) and number not in seen else None)
                if sent[-1] and len(seen) < SEEN:
                    seen.add(number)
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("row_key"), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array(rid.view(np.int64)), pa.array(sent, pa.binary())], ["did", "row_key", "n", "rid", "tokens"])

    key = F.col("row_key").bitwiseAND(F.lit((1 << 40) - 1))
    joined = rows.join(keys.withColumn("passed", F.lit(True)), key == F.col("key"), "left")
    return joined.select("did", "row_key", "text", "passed").mapInArrow(run, SCHEMA)


def frequent_tokens(sets: DataFrame, n_sets: int) -> np.ndarray:
    """Tokens that more than a FREQUENT share of all sets have (8 sets at least).

    Every token of every set counts. Tokens are counted by cells first, a bounded
    table per task: a cell that is not over the limit holds no token that is. Only
    tokens of the other cells are then counted by themselves."""
    least = max(8, int(FREQUENT * n_sets))
    cell = lambda tokens: tokens >> np.uint64(64 - CELL_BITS)
    size = 1 << CELL_BITS - PART_BITS

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(1 << CELL_BITS, np.int64), False
        for batch in batches:
            if len(batch):
                tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint64)
                counts += np.bincount(cell(tokens).view(np.int64), minlength=len(counts))
                some = True
        for part, x in enumerate(counts.reshape(-1, size) if some else ()):
            narrow = np.min_scalar_type(int(x.max()))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([narrow.itemsize], pa.int32()),
                                              pa.array([x.astype(narrow).tobytes()], pa.binary())], ["part", "width", "counts"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, width, x in zip(*(batch.column(c).to_pylist() for c in ("part", "width", "counts"))):
                sums[part] = sums.get(part, 0) + np.frombuffer(x, f"u{width}").astype(np.int64)
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(part * size + np.flatnonzero(x > least))], ["cell"])

    cells = (sets.select("tokens").mapInArrow(tally, "part int, width int, counts binary")
             .repartition(1 << PART_BITS, "part").mapInArrow(over, "cell long").toPandas())
    full = np.zeros(1 << CELL_BITS, bool)
    full[cells["cell"].to_numpy(np.int64)] = True
    bits = np.packbits(full)  # what all tasks get

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.unpackbits(bits).view(bool)
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint64)
            token, n = np.unique(tokens[full[cell(tokens)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    found = (sets.select("tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
             .where(F.col("n") > least).select("token").toPandas())
    return np.sort(found["token"].to_numpy(np.int64, copy=True).view(np.uint64))


def _is_frequent(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    return frequent[np.searchsorted(frequent, tokens).clip(max=len(frequent) - 1)] == tokens


def _overlaps(sets: list[np.ndarray]):
    """A function that counts the tokens a set shares with each of ``sets``."""
    union = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(union, kind="stable")
    union, owner = union[order], owner[order]

    def count(query: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(union, query), np.searchsorted(union, query, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        return np.bincount(owner[at], minlength=len(sets))

    return count


def dealt_groups(sets: DataFrame, frequent: np.ndarray, n_sets: int) -> DataFrame:
    """``block, rid, leader, tokens``: sets grouped by one token, in blocks.

    The token is the least one, among the frequent ones if these make up the set.
    A group over BLOCK (or over its share of all sets, so that the list of such
    groups stays bounded) is dealt out; its leader goes to each of its blocks."""

    def key_of(tokens: np.ndarray) -> int:
        common = tokens[_is_frequent(tokens, frequent)]
        return (common if 2 * len(common) >= len(tokens) else tokens)[:1].view(np.int64)[0]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array([key_of(s) for s in _sets(batch.column("tokens"))], pa.int64())],
                ["rid", "token"])

    sizes = sets.select("rid", "tokens").mapInArrow(keys, "rid long, token long").groupBy("token").agg(
        F.count("*").alias("size"), F.min("rid").alias("leader"))
    large = sizes.where(F.col("size") > max(BLOCK, n_sets * LARGE_SHARE)).toPandas()
    dealt = {t: (-(-size // BLOCK), leader) for t, size, leader in large.itertuples(index=False)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, blocks, leaders = [], [], []
            for i, (rid, s) in enumerate(zip(batch.column("rid").to_pylist(), _sets(batch.column("tokens")))):
                token = key_of(s)
                n, leader = dealt.get(token, (1, rid))
                for k in range(n) if rid == leader else (rid % n,):
                    at.append(i)
                    blocks.append(token ^ (k * _STEP & _ODD))
                    leaders.append(n > 1 and rid == leader)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column("rid").take(pa.array(at, pa.int64())),
                                              pa.array(leaders, pa.bool_()), batch.column("tokens").take(pa.array(at, pa.int64()))],
                                             ["block", "rid", "leader", "tokens"])

    return sets.select("rid", "tokens").mapInArrow(deal, "block long, rid long, leader boolean, tokens binary")


_STEP, _ODD = 0x9E3779B97F4A7C15, (1 << 62) - 1


def _blocks(table: pa.Table, first: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each block of a table, those with ``first`` before the others."""
    block, rid = table.column("block").to_numpy(), table.column("rid").to_numpy()
    order = np.lexsort((rid, ~first, block))
    yield from np.split(order, np.flatnonzero(block[order[1:]] != block[order[:-1]]) + 1)


def group_matrix(sets: DataFrame, frequent: np.ndarray, n_sets: int, percent: int = PERCENT) -> DataFrame:
    """Cluster the sets of each block, and list the tokens of their prefixes.

    Rows of KIND_MEMBER: ``rid, label, block, pure, need`` (``pure``: the block is one
    cluster; ``need``: tokens that a partner must share in the prefix). Rows of
    KIND_TOKEN: ``token, rid, block, need``. A hot group's leader is a member of its own
    block only; it just ties the clusters of the others together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        if table is None:
            return
        block, rid, leader = (table.column(c).to_numpy() for c in ("block", "rid", "leader"))
        sets = _sets(table.column("tokens"))
        for at in _blocks(table, leader):
            label = rid[at][_clusters([sets[i] for i in at], percent)]
            pure = bool((label == label[0]).all())
            sizes = np.array([len(sets[i]) for i in at])
            yield _rows(kind=KIND_MEMBER, rid=rid[at], label=label, block=block[at], pure=pure, need=slack(sizes))
            token, owner = [], []
            for i, n in zip(at, prefix_length(sizes, percent)):
                late = _is_frequent(sets[i], frequent)
                token.append(np.concatenate((sets[i][~late], sets[i][late]))[:n])
                owner.append(np.full(len(token[-1]), rid[i]))
            token = np.concatenate(token).view(np.int64)
            yield _rows(kind=KIND_TOKEN, token=token, rid=np.concatenate(owner), block=np.full(len(token), block[at[0]]),
                        need=np.repeat(slack(sizes), [len(x) for x in owner]))

    return dealt_groups(sets, frequent, n_sets).repartition("block").mapInArrow(run, MATRIX)


KIND_MEMBER, KIND_TOKEN = 0, 1
MATRIX = "kind int, rid long, label long, block long, pure boolean, need long, token long"


def _rows(kind: int, rid: np.ndarray, block: np.ndarray, label=None, pure=None, need=None, token=None) -> pa.RecordBatch:
    n = len(rid)
    of = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), of(rid), of(label), of(block),
         pa.nulls(n, pa.bool_()) if pure is None else pa.array(np.full(n, pure)), of(need), of(token)],
        ["kind", "rid", "label", "block", "pure", "need", "token"])


def _clusters(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first set that it is linked with, over any
    chain inside the block. A set is compared until it has a cluster."""
    sizes = np.array([len(s) for s in sets])
    count = _overlaps(sets)
    label = np.full(len(sets), -1)
    for i in range(len(sets)):
        if label[i] >= 0:
            continue
        label[i] = i
        wave = [i]
        while wave and (label < 0).any():
            j = wave.pop()
            near = np.flatnonzero((label < 0) & linked(count(sets[j]), sizes[j], sizes, percent))
            label[near] = i
            wave.extend(near.tolist())
    return label


def opened_blocks(matrix: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rid, block``: sets and the blocks that may hold a partner of theirs, by
    the tokens they share with the union of the block's prefixes. A pair of blocks
    is looked at from the lesser one. A block that is one cluster is not opened for
    members of that cluster.

    Two partners share as many prefix tokens as the lesser of their needs says, and a
    partner's need is at least ``percent`` of a set's own (``low``). So a set with fewer
    tokens in other blocks has no partner there, and half of ``low`` may be left out:
    its tokens that most sets have, which would meet many blocks by chance."""
    low_of = lambda need: F.greatest(F.lit(1), F.floor(F.col(need) * percent / 100))
    members = matrix.where(F.col("kind") == KIND_MEMBER)
    tokens = matrix.where(F.col("kind") == KIND_TOKEN).select("token", "rid", "block", "need")
    # most tokens lie in one block: they go before anything is joined
    several = tokens.groupBy("token").agg(F.min("block").alias("a"), F.max("block").alias("z"), F.count("*").alias("sets")).where("a < z")
    own = Window.partitionBy("rid", "block")
    tokens = landed(tokens.join(several.select("token", "sets"), "token").distinct()
                    .withColumn("place", F.row_number().over(own.orderBy(F.desc("sets"), "token")))
                    .withColumn("several", F.count("*").over(own)).where(F.col("several") >= low_of("need"))
                    .select("token", "rid", "block", "need", "place"), "tokens", release=True)
    labels = members.groupBy("rid").agg(F.min("label").alias("label"))
    unions = (members.groupBy("block").agg(F.min("need").alias("least"), F.max("need").alias("most"),
                                           F.when(F.min("pure"), F.min("label")).alias("pure"))
              .join(tokens.select("token", "block").distinct(), "block").withColumnRenamed("block", "other"))
    query = (tokens.withColumn("low", low_of("need")).withColumn("out", F.floor(F.col("low") / 2))
             .where("place > out").join(labels, "rid"))
    met = query.join(unions, "token").where("block < other AND NOT (pure <=> label)").where(
        (F.col("most") >= F.col("low")) & (F.col("need") >= low_of("least")))
    shared = F.least("need", F.greatest("least", "low")) - F.col("out")
    return (met.groupBy("rid", "other").agg(F.countDistinct("token").alias("shared"), F.min(shared).alias("bound"))
            .where("shared >= bound").select("rid", F.col("other").alias("block")))


def verified(sets: DataFrame, matrix: DataFrame, opened: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges ``a, b``: a set of an opened block for each cluster in it that the
    query is linked with; the cluster's other members follow."""
    members = matrix.where(F.col("kind") == KIND_MEMBER).select("rid", "block", "label")
    wanted = members.join(opened.select("block").distinct(), "block").select(
        "rid", F.struct("block", "label").alias("to"))
    asked = opened.select("rid", F.struct("block", F.lit(None).cast("long").alias("label")).alias("to"))
    places = wanted.union(asked).distinct().groupBy("rid").agg(F.collect_list("to").alias("to"))
    sent = sets.select("rid", "tokens").join(places, "rid").select("rid", "tokens", F.explode("to").alias("to")).select(
        "rid", "tokens", "to.block", "to.label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        if table is None:
            return
        rid = table.column("rid").to_numpy()
        member = np.array(table.column("label").is_valid())
        label = np.array(table.column("label").fill_null(0))
        sets = _sets(table.column("tokens"))
        a, b = [], []
        for at in _blocks(table, member):
            there, asked = at[member[at]], at[~member[at]]
            if not len(there) or not len(asked):
                continue
            count = _overlaps([sets[i] for i in there])
            sizes = np.array([len(sets[i]) for i in there])
            for i in asked:
                hit = there[linked(count(sets[i]), len(sets[i]), sizes, percent)]
                for j in hit[np.unique(label[hit], return_index=True)[1]]:
                    a.append(rid[i])
                    b.append(rid[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sent.repartition("block").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, row_key, n_shingles, set_id, component_id, keeper`` of each row.

    Rows link when their shingle sets have a Jaccard similarity of ``percent`` or
    more; ``component_id`` is the smallest ``doc_id`` that links reach. Null and
    empty texts, and texts without words, have an empty set and link with nothing,
    not even with each other. ``keeper`` marks one document of each component, and
    all without words (equal rows are marked together). A null ``doc_id`` is never the smallest; it stays
    null when nothing else is reached. Equal rows link like any equal texts. Other
    columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = keyed(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "row_key", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = landed(screen(rows, parts, percent), "keys", release=True)
    sets = landed(with_sets(rows, keys), "sets", release=True)
    # a set stands for its equals, here those of a task; the rest meet in one block
    full = sets.where("tokens IS NOT NULL").select("rid", "n", "tokens")
    n_sets = full.count()
    frequent = frequent_tokens(full, n_sets) if n_sets else np.zeros(0, np.uint64)
    matrix = landed(group_matrix(full, frequent, n_sets, percent), "matrix", release=True)
    members = matrix.where(F.col("kind") == KIND_MEMBER)
    opened = landed(opened_blocks(matrix, percent), "opened", release=True)
    # read twice: for the rounds and for the nodes
    links = landed(verified(full, matrix, opened, percent).union(members.where("rid <> label").select("rid", "label")),
                   "links", release=True)
    roots = connected(links)
    ids = (sets.where("n > 0").groupBy(F.col("rid").alias("node")).agg(F.min(F.struct("did", "row_key")).alias("first"))
           .join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"))
    first = F.col("first.did").alias("least")
    firsts = ids.groupBy("root").agg(F.min("first").alias("first"))
    component = ids.select("node", "root").join(firsts, "root").select(F.col("node").alias("rid"), "first")
    alone = sets.where("n = 0").select("did", "row_key", "n", "rid", F.col("did").alias("least"), F.lit(True).alias("keeper"))
    together = sets.where("n > 0").select("did", "row_key", "n", "rid").join(component, "rid").select(
        "did", "row_key", "n", "rid", first, (F.struct("did", "row_key") == F.col("first")).alias("keeper"))
    null_id = F.lit(NO_ID)
    return alone.union(together).select(
        F.nullif("did", null_id).alias("doc_id"), "row_key", F.col("n").cast("long").alias("n_shingles"),
        F.col("rid").alias("set_id"), F.nullif("least", null_id).alias("component_id"), "keeper")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates: the
    document with the smallest ``doc_id`` of each component stays, once."""
    found = near_duplicates(docs, percent).where("keeper").select("row_key", "n_shingles").distinct()
    kept = keyed(docs, tuple(docs.columns)).select("row_key", "row").join(found, "row_key")
    # equal rows share a key: one of them stays, but all of those that link with nothing
    one = kept.where("n_shingles > 0").groupBy("row_key").agg(F.first("row").alias("row")).select("row.*")
    return one.union(kept.where("n_shingles = 0").select("row.*"))
