"""Keyed state in hash buckets, of which an upsert writes the changed rows alone.

A table is a set of buckets by key hash; each has a base and the deltas that came
since. An upsert reads the buckets that its batch touches and writes a delta of
the changed rows to each; a bucket whose deltas have grown to a share of its base
is folded into a new base, so a row is rewritten a bounded number of times. A
manifest names the files of every bucket and is put in place by one rename, hence
readers see all of a commit or nothing, and of two writers that start from the
same version one fails. Manifests also note which batches of which streams they
hold, so a stream that starts anew skips what it had written, and no other's.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import delete, exists, listed, put_file, read_file, store, with_positions
from .state import upsert

#: Rows of a delta table that may be broadcast.
MOST_BROADCAST = 1_000_000
_BUCKET, _VERSION = "__bucket", "__version"


@dataclass(frozen=True)
class Bucket:
    """base and deltas: names of commits, oldest first; rows in them."""

    base: str | None = None
    deltas: tuple[str, ...] = ()
    base_rows: int = 0
    delta_rows: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int
    n_buckets: int
    buckets: dict[int, Bucket] = field(default_factory=dict)
    top_id: int = 0
    streams: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def parse(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(**{**d, "buckets": {int(b): Bucket(**{**x, "deltas": tuple(x["deltas"])}) for b, x in d["buckets"].items()}})


class ConflictError(RuntimeError):
    """Another writer committed the version that this one was about to commit."""


@dataclass(frozen=True)
class BucketState:
    """A table of state below root. schema: its columns as DDL, first_seen and last_seen among them; id numbers new rows, if it is a column.

    n_buckets counts when the table is made and is kept from then on. fold: the
    share of a bucket's base at which its deltas are folded into it.
    """

    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]
    n_buckets: int = 64
    fold: float = 0.5
    keep: int = 3

    # Reading

    def manifest(self) -> Manifest:
        """The newest, or an empty one of version 0."""
        found = listed(self.spark, f"{self.root}/manifests")
        return Manifest.parse(read_file(self.spark, f"{self.root}/manifests/{max(found)}")) if found else Manifest(0, self.n_buckets)

    def read(self, manifest: Manifest | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version (the newest, if not given), or of some of its buckets.

        Bases are scanned where they lie: only rows of deltas, the latest for each
        key, are shuffled or broadcast.
        """
        m = manifest or self.manifest()
        chosen = {b: x for b, x in m.buckets.items() if buckets is None or b in buckets}
        base = self._scan([self._folder(x.base, b) for b, x in chosen.items() if x.base])
        rows = sum(x.delta_rows for x in chosen.values())
        if not rows:
            return base.drop(_VERSION)
        deltas = self._scan([self._folder(c, b) for b, x in chosen.items() for c in x.deltas])
        rest = [c for c in deltas.columns if c not in self.keys]
        latest = deltas.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), _VERSION).alias("r")).select(*self.keys, "r.*").select(*deltas.columns)
        changed = latest.select(*self.keys)
        kept = base.join(F.broadcast(changed) if rows <= MOST_BROADCAST else changed, list(self.keys), "left_anti").select(*deltas.columns)
        return kept.unionByName(latest).drop(_VERSION)

    def _folder(self, commit: str, bucket: int) -> str:
        return f"{self.root}/data/{commit}/{_BUCKET}={bucket}"

    def _scan(self, folders: list[str]) -> DataFrame:
        schema = f"{self.schema}, {_VERSION} int"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # Writing

    def upsert(self, batch: DataFrame, replaced: list[str], defaults: dict[str, Column], ord: str = "ord", stream: tuple[str, int] | None = None) -> DataFrame:
        """Commits a batch (as `state.upsert` takes it) and returns its rows as they are now, with is_new, stored.

        stream: the id of a stream and the number of its batch; a batch whose
        number was committed before is not committed again, and returns no rows.
        """
        m = self.manifest()
        known = self.spark.createDataFrame([], f"{self.schema}, is_new boolean")
        if stream and m.streams.get(stream[0], -1) >= stream[1]:
            return known
        types = dict(known.dtypes)
        batch = batch.withColumns({k: F.col(k).cast(types[k]) for k in self.keys})  # else equal keys of two types hash apart
        keyed = store(batch.withColumn(_BUCKET, self._bucket(m)), "state-batch")
        touched = {r[0] for r in keyed.select(_BUCKET).distinct().collect()}  # a number for each bucket at most
        if not touched and not stream:
            return known
        names = keyed.select(*self.keys).distinct()
        names = F.broadcast(names) if keyed.count() <= MOST_BROADCAST else names
        before = self.read(m, touched).join(names, list(self.keys), "left_semi")
        after = store(upsert(before, keyed.drop(_BUCKET), list(self.keys), replaced, defaults, ord).drop("in_batch"), "state-changed")
        top = m.top_id
        if "id" in after.columns:
            fresh = store(with_positions(after.filter("id IS NULL"), list(self.keys), name="state-ids"), "state-numbered")
            after = store(after.filter("id IS NOT NULL").unionByName(fresh.withColumn("id", F.col("row_pos") + top + 1).drop("row_pos")), "state-changed")
            top += fresh.count()
        self._commit(replace(m, top_id=top), after.drop("is_new"), stream)
        return after

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(m.n_buckets)).cast("int")

    def _write(self, rows: DataFrame, m: Manifest) -> tuple[str, dict[int, int]]:
        """(name, rows by bucket) of a new commit's files; no manifest names them yet."""
        commit = f"{m.version + 1}-{uuid.uuid4().hex}"
        placed = rows.withColumn(_VERSION, F.lit(m.version + 1)).withColumn(_BUCKET, self._bucket(m))
        # a file for each bucket; sorted, so that a look-up of keys skips row groups
        dealt = placed.repartition(_BUCKET).sortWithinPartitions(_BUCKET, *self.keys)
        dealt.write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.root}/data/{commit}")
        counted = self.spark.read.schema(f"{_BUCKET} int").parquet(f"{self.root}/data/{commit}").groupBy(_BUCKET).count().collect()
        return commit, {r[0]: r[1] for r in counted}

    def _commit(self, m: Manifest, rows: DataFrame, stream: tuple[str, int] | None) -> None:
        buckets = dict(m.buckets)
        commit, counts = self._write(rows, m)
        for b, n in counts.items():
            old = buckets.get(b, Bucket())
            buckets[b] = replace(old, deltas=(*old.deltas, commit), delta_rows=old.delta_rows + n)
        ready = replace(m, version=m.version + 1, buckets=buckets, streams={**m.streams, stream[0]: stream[1]} if stream else m.streams)
        fresh = {b for b in counts if not buckets[b].base and len(buckets[b].deltas) == 1}
        grown = {b for b in counts if b not in fresh and buckets[b].delta_rows > self.fold * buckets[b].base_rows}
        if grown:
            folded, sizes = self._write(self.read(ready, grown), m)
            buckets.update({b: Bucket(folded, (), n) for b, n in sizes.items()})
        buckets.update({b: Bucket(commit, (), counts[b]) for b in fresh})
        if not put_file(self.spark, f"{self.root}/manifests/{ready.version:012d}.json", ready.text()):
            raise ConflictError(f"version {ready.version} of {self.root} exists")
        self._forget()

    def _forget(self) -> None:
        """Manifests before the last `keep`, and the files that only they name, go."""
        names = sorted(listed(self.spark, f"{self.root}/manifests"))
        old, kept = names[: -self.keep], names[-self.keep :]
        if not old:
            return
        files = lambda n: {self._folder(c, b) for b, x in Manifest.parse(read_file(self.spark, f"{self.root}/manifests/{n}")).buckets.items() for c in (x.base, *x.deltas) if c}
        wanted = set().union(*map(files, kept))
        for n in old:
            for folder in files(n) - wanted:
                delete(self.spark, folder)
            delete(self.spark, f"{self.root}/manifests/{n}")

    def add(self, rows: DataFrame) -> None:
        """Commits rows of the table's columns, whose keys it does not have yet, as they are: a table taken over from elsewhere."""
        m = self.manifest()
        top = rows.agg(F.max("id")).first()[0] or 0 if "id" in rows.columns else 0
        self._commit(replace(m, top_id=max(m.top_id, top)), rows, None)

    def exists(self) -> bool:
        return exists(self.spark, f"{self.root}/manifests")
