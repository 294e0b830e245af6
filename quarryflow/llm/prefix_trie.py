"""Prefix tries of conversations, built as burst tries.

A turn is 16 bytes that tell its role and text, a conversation their sequence.
Equal sequences collapse first, so thousands of copies cost one row. A container
holds the suffixes of all sequences under one trie head; at first one holds all.
A container of too many sequences or turns bursts: the turns that all its
suffixes share become a chain of trie nodes, and the suffixes go on to containers
by the next turn, so each burst parts them. The containers left are dealt over
shards; a task sorts each and sweeps it into nodes. Totals of subtrees then climb
from the containers to the heads, a level at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, drop_stored, slices, small, spread, store

#: Sequences, and turns, of a container that is swept in one task.
MOST_SEQUENCES, MOST_TURNS = 4096, 1 << 16
#: Ids whose decimal forms are joined before they reach the task that hashes them.
JOINED = 4096
_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_sid binary, end_n long, end_least long"


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (tid, words) in order of turn, null first; rows of one turn come in order of their ids. Null conv_ids are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tid = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", tid.alias("tid"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["tid"].alias("tid"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    named = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return named.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(0)))).alias("turns"))


def _shared(lo: str, hi: str) -> Column:
    """How many elements two arrays begin with alike."""
    return F.expr(f"aggregate(zip_with({lo}, {hi}, (x, y) -> coalesce(x = y, false)), struct(0 AS n, true AS going), (s, e) -> struct(s.n + int(s.going AND e) AS n, s.going AND e AS going), s -> s.n)")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come container by container, suffixes in order; each container becomes nodes once its last row is there."""
    held, box, out = [], None, _Nodes()
    for batch in slices(batches):
        for row in batch.to_pylist():
            if held and row["box"] != box:
                out.add(held)
                held = []
                if len(out) > 10_000:
                    yield out.batch()
                    out = _Nodes()
            box = row["box"]
            held.append(row)
    if held:
        out.add(held)
    if len(out):
        yield out.batch()


class _Nodes:
    """Rows of nodes, column by column."""

    names = [*(part.split()[0] for part in _NODE.split(", ")), "under"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in self.names]

    def __len__(self) -> int:
        return len(self.columns[0])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, self.kinds, strict=True)], self.names)

    def add(self, rows: list[dict]) -> None:
        """The nodes of one container. under: the container's parent, on its topmost node alone."""
        top = rows[0]
        depth, parent, words, ends = [top["depth"]], [-1], [top["top_words"]], [None]
        stack, before = [0], []
        for row in rows:
            rest, same = row["tids"], 0
            while same < len(before) and same < len(rest) and before[same] == rest[same]:
                same += 1
            del stack[same + 1 :]
            for w in row["words"][same:]:
                parent.append(stack[-1])
                depth.append(depth[stack[-1]] + 1)
                words.append(w)
                ends.append(None)
                stack.append(len(parent) - 1)
            ends[stack[-1]] = row
            before = rest
        size = len(parent)
        n = [e["n"] if e else 0 for e in ends]
        least = [e["least"] if e else None for e in ends]
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for i in range(size - 1, -1, -1):  # children stand after their parents
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * words[i]
            p = parent[i]
            if p >= 0:
                n[p] += n[i]
                least[p] = least[i] if least[p] is None else min(least[p], least[i])
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        above = [top["up"], *(least[p] for p in parent[1:])]
        end = [[e[c] if e else None for e in ends] for c in ("sid", "n", "least")]
        for column, values in zip(self.columns, [least, depth, above, n, children, leaves, saved, *end, [top["under"], *[None] * (size - 1)]], strict=True):
            column += values


def _burst(open_: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the heads of containers that burst, their members in new containers).

    A head: box, under, depth, up, n_convs, conv_id, chain (words of the texts
    of its nodes, from the topmost on), end (the sequence that ends at the last one).
    """
    members = open_.join(small(big.select("box")), "box")
    ends = F.struct("tids", "words")
    facts = members.groupBy("box").agg(
        *[F.first(c).alias(c) for c in ("under", "depth", "up", "top_words")], F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min(ends).alias("lo"), F.max("tids").alias("hi")
    )
    facts = facts.withColumn("same", _shared("lo.tids", "hi"))
    facts = store(facts.withColumn("chain", F.concat(F.array("top_words"), F.slice("lo.words", F.lit(1), F.col("same")))).drop("lo", "hi", "top_words"), "trie-heads")
    placed = members.drop("under", "up").join(small(facts.select("box", "same", F.col("conv_id").alias("up"))), "box")
    last = placed.filter(F.size("tids") == F.col("same")).select("box", F.struct("sid", "n", "least").alias("end"))
    heads = store(facts.join(last, "box", "left"), "trie-heads")
    on = F.col("same") + 1
    after = placed.filter(F.size("tids") > F.col("same")).select(
        "sid", "n", "least", F.unhex(F.md5(F.concat(F.hex("box"), F.hex(F.get("tids", F.col("same")))).cast("binary"))).alias("box"), F.col("box").alias("under"), "up",
        (F.col("depth") + on).cast("int").alias("depth"), F.get("words", F.col("same")).alias("top_words"),
        *[F.slice(c, on + 1, F.size(c)).alias(c) for c in ("tids", "words")],
    )
    return heads, after


def _head_nodes(heads: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the nodes of a level's heads, stored; what each level above sums of them). below: under, n_leaves, saved_tokens of the containers one level below."""
    sums = below.groupBy(F.col("under").alias("box")).agg(F.count("*").alias("fan"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    nodes = heads.join(sums, "box").select("*", F.posexplode("chain").alias("at", "w"))
    onward = Window.partitionBy("box").orderBy(F.desc("at"))
    shown = nodes.select(
        "conv_id", (F.col("depth") + F.col("at")).cast("int").alias("depth"), F.when(F.col("at") == 0, F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("at") == F.col("same"), F.col("fan")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.sum((F.col("n_convs") - 1) * F.col("w")).over(onward)).cast("long").alias("saved_tokens"),
        *[F.when(F.col("at") == F.col("same"), F.col(f"end.{c}")).alias(f"end_{c}") for c in ("sid", "n", "least")], F.when(F.col("at") == 0, F.col("under")).alias("under"),
    )
    shown = store(shown, "trie-nodes")
    return shown, shown.filter("under IS NOT NULL").select("under", "n_leaves", "saved_tokens")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sid, conv_id in order: up to JOINED decimal ids of one sid as one text, with the first of them."""
    sid, ids = None, []
    for batch in slices(batches):
        rows = []
        for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (s != sid or len(ids) == JOINED):
                rows.append((sid, ids[0], ",".join(map(str, ids))))
                ids = []
            sid = s
            ids.append(c)
        if rows:
            yield _id_rows(rows)
    if ids:
        yield _id_rows([(sid, ids[0], ",".join(map(str, ids)))])


def _id_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["sid", "first", "ids"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each sid's ids, joined texts coming in order; only the hash's state is held."""

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["sid", "sha"])

    sid, state = None, None
    for batch in slices(batches, 64):
        done = []
        for s, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s == sid:
                state.update(b",")
            else:
                if state:
                    done.append((sid, state.hexdigest()))
                sid, state = s, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield rows(done)
    if state:
        yield rows([(sid, state.hexdigest())])


def ends_of(members: DataFrame) -> DataFrame:
    """sid, sha: the SHA-256 of each sid's decimal conv_ids, ascending, comma-joined. members: sid, conv_id, each pair once.

    Ranges of (sid, conv_id) join ids to texts, so a group of a third of all rows
    is spread over many tasks, and the task that hashes it takes one row for
    JOINED of them.
    """
    dealt = members.select("sid", "conv_id").repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    joined = dealt.mapInArrow(_join_ids, "sid binary, first long, ids string")
    return joined.repartition("sid").sortWithinPartitions("sid", "first").select("sid", "ids").mapInArrow(_hash_ids, "sid binary, sha string")


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4, sequences: int = MOST_SEQUENCES, turns: int = MOST_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of rebuilt conversations.

    Turns are ordered by `turn`, null first; ties and repeated rows of one turn
    by a digest of role and text. Null roles and texts are empty, rows with a null
    conv_id belong to no conversation. A conversation is held whole by a task, 20
    bytes a turn however long its texts are. An empty table has no root, hence no
    rows; further columns are ignored.
    """
    own = store(conversation_turns(spread(conversations)), "trie-own")
    placed = rebuilt(own, every, most)
    tids = F.transform("turns", lambda t: t["tid"])
    words = F.transform("turns", lambda t: t["words"])
    rows = store(placed.select("conv_id", tids.alias("tids"), words.alias("words")).withColumn("sid", F.unhex(F.md5(F.array_join(F.transform("tids", F.hex), "").cast("binary")))), "trie-rows")
    drop_stored(own)
    unique = rows.groupBy("sid").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("tids").alias("tids"), F.first("words").alias("words"))
    start = unique.select("sid", "n", "least", F.unhex(F.lit("00")).alias("box"), F.lit(None).cast("binary").alias("under"), F.lit(None).cast("long").alias("up"), F.lit(0).alias("depth"), F.lit(0).alias("top_words"), "tids", "words")
    open_ = store(start, "trie-open")
    seqs = open_.select("sid", "n")

    settled, levels = [], []
    while True:
        sizes = store(open_.groupBy("box").agg(F.count("*").alias("k"), F.sum(F.size("tids")).alias("t")).filter((F.col("k") > 1) & ((F.col("k") > sequences) | (F.col("t") > turns))), "trie-sizes")
        if sizes.isEmpty():
            settled.append(open_)
            break
        settled.append(open_.join(small(sizes.select("box")), "box", "left_anti").select(*open_.columns))
        heads, after = _burst(open_, sizes)
        levels.append(heads)
        open_ = store(after.select(*open_.columns), "trie-open")

    boxes = settled[0]
    for s in settled[1:]:
        boxes = boxes.unionByName(s)
    dealt = boxes.repartition("box").sortWithinPartitions("box", "tids")
    nodes = store(dealt.mapInArrow(_sweep, f"{_NODE}, under binary"), "trie-nodes")
    tops = nodes.filter("under IS NOT NULL").select("under", "n_leaves", "saved_tokens")
    for heads in reversed(levels):
        shown, more = _head_nodes(heads, tops)
        nodes, tops = nodes.unionByName(shown), tops.unionByName(more)

    several = rows.select("sid", "conv_id").join(seqs.filter("n > 1").select("sid"), "sid")
    ends = store(ends_of(several), "trie-ends")
    sha = F.when(F.col("end_sid").isNull(), hashlib.sha256().hexdigest()).when(F.col("end_n") == 1, F.sha2(F.col("end_least").cast("string").cast("binary"), 256)).otherwise(F.col("sha"))
    out = nodes.join(small(ends).withColumnRenamed("sid", "end_sid"), "end_sid", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
