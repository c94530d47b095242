"""Token counts: rollups by source, language and tokenizer version kept up by deltas.

Every change is a signed row: an insert adds (+1 document, +n tokens), a delete takes
them back, a revised count is a delete and an insert. A batch is first summed by group,
so what is stored grows with the groups, not with the documents, and totals are plain
sums of deltas, in any order.

Commits are idempotent. Each attempt writes its deltas to a folder of its own, then writes
a commit file under a name of its own, and last renames that to the batch's name, which
must be free: a step that either happens as a whole or does not. The first attempt that
gets there counts for good, however long another runs; an attempt that dies anywhere
before changes nothing, and a replay may take its place. Compaction sums what is committed
to a base, published in the same way; batches that a base has are known from it, so a late
commit of one of them counts for nothing. ``vacuum`` deletes what a base has made useless.

Defined cases: null source, language or version are groups of their own; null and empty
texts count 0 tokens but one document; repeated rows count each time; an empty batch
commits as such; a store without commits has no totals; groups whose totals are all zero
are left out of the totals; an empty commit file, which this code never leaves, counts as
none. A very long text is one count. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["source", "lang", "tokenizer_version"]
_SUMS = "source string, lang string, tokenizer_version string, docs long, tokens long"


def signed(counted: DataFrame, sign: int) -> DataFrame:
    """Rows (source, lang, tokenizer_version, n_tokens) as signed changes."""
    return counted.select(*GROUP, F.lit(sign).cast("long").alias("sign"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """A revised count: the old one goes, the new one comes."""
    return signed(before, -1).unionByName(signed(after, 1))


@dataclass
class TokenRollup:
    """A rollup store below ``path``, a shared folder: deltas of each attempt, a commit file
    for each batch since the last base, and bases."""

    spark: SparkSession
    path: str

    def commit(self, batch_id: int, changes: DataFrame) -> None:
        """Commit signed changes (source, lang, tokenizer_version, sign, n_tokens), unless
        the batch is committed already."""
        if self.is_committed(batch_id):
            return
        attempt = self.write_attempt(changes)
        self.publish("commits", str(batch_id), attempt)

    def is_committed(self, batch_id: int) -> bool:
        return str(batch_id) in self._published("commits") or not self._based().where(F.col("batch_id") == batch_id).isEmpty()

    def write_attempt(self, changes: DataFrame) -> str:
        """Write the changes, summed by group, and return the attempt's name."""
        attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        sums = changes.groupBy(*GROUP).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
        sums.write.parquet(f"{self.path}/deltas/{attempt}")
        return attempt

    def publish(self, kind: str, name: str, attempt: str) -> bool:
        """Give the attempt the name, if it is free; whether it got it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target, written = self._at(f"{kind}/{name}"), self._at(f"pending/{attempt}-{uuid.uuid4().hex}")
        files = target.getFileSystem(conf)
        out = files.create(written, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        files.mkdirs(target.getParent())
        if files.exists(target) and not files.getFileStatus(target).getLen():
            files.delete(target, False)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:  # refuses a target that exists, in one step
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(written, target, options)
        except Py4JJavaError:
            if not files.exists(target):
                raise
            files.delete(written, False)
            return False
        return True

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _published(self, kind: str) -> dict[str, str]:
        """Names of a kind with the attempt that has each."""
        folder = self._at(kind)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return {}
        names = {f.getPath().getName(): f.getPath() for f in files.listStatus(folder) if f.getLen()}
        found = {}
        for n, at in names.items():
            stream = files.open(at)
            found[n] = bytes(stream.readAllBytes()).decode()
            stream.close()
        return found

    def _base(self) -> tuple[int, str | None]:
        """Number and attempt of the newest base."""
        bases = {int(n): a for n, a in self._published("bases").items()}
        return max(bases.items(), default=(0, None))

    def _based(self) -> DataFrame:
        """(batch_id) of the batches that the newest base has."""
        _, attempt = self._base()
        read = self.spark.read.schema("batch_id long")
        return read.parquet(f"{self.path}/deltas/{attempt}-batches") if attempt else self.spark.createDataFrame([], "batch_id long")

    def _counted(self) -> tuple[list[str], list[int]]:
        """Attempts whose deltas count, the base's first, and the batches they are of since
        the base. The commit files are those since the last compaction, so few."""
        commits = {int(n): a for n, a in self._published("commits").items()}
        _, base = self._base()
        if base and commits:
            own = self.spark.createDataFrame([(n,) for n in commits], "batch_id long")
            for r in own.join(self._based(), "batch_id", "left_semi").collect():
                del commits[r["batch_id"]]
        return [*([base] if base else []), *commits.values()], list(commits)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, docs, tokens) over all committed batches."""
        attempts, _ = self._counted()
        if not attempts:
            return self.spark.createDataFrame([], _SUMS)
        return self._sums(attempts).where("docs <> 0 or tokens <> 0")

    def _sums(self, attempts: list[str]) -> DataFrame:
        deltas = self.spark.read.schema(_SUMS).parquet(*[f"{self.path}/deltas/{a}" for a in attempts])
        return deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self) -> bool:
        """Sum what is committed to a new base; false if there is nothing new, or another
        compaction was first."""
        number, _ = self._base()
        attempts, batches = self._counted()
        if not batches:
            return False
        attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        new = self.spark.createDataFrame([(n,) for n in batches], "batch_id long")
        self._based().unionByName(new).write.parquet(f"{self.path}/deltas/{attempt}-batches")
        self._sums(attempts).write.parquet(f"{self.path}/deltas/{attempt}")
        return self.publish("bases", str(number + 1), attempt)

    def vacuum(self) -> None:
        """Delete commit files that the newest base has, and deltas that no longer count,
        those of attempts that died too. For a time without other readers or writers."""
        folder = self._at("deltas")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        attempts, batches = self._counted()
        number, base = self._base()
        for name in self._published("commits"):
            if int(name) not in batches:
                files.delete(self._at(f"commits/{name}"), False)
        for name in self._published("bases"):
            if int(name) != number:
                files.delete(self._at(f"bases/{name}"), False)
        kept = {*attempts, f"{base}-batches"}
        for f in files.listStatus(folder) if files.exists(folder) else []:
            if f.getPath().getName() not in kept:
                files.delete(f.getPath(), True)
        files.delete(self._at("pending"), True)
