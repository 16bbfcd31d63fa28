"""Small helpers that the corpus jobs share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression for a run of the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is set, a session on one machine takes a new temporary folder; on
    a cluster that is an error, as executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def place(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read again; `name` is a path, or a word in a new one under the shared folder.

    Unlike `checkpoint`, columns can be pruned and filters pushed in later reads.
    """
    path = name if "/" in name else place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` stored in the shared folder by a hash of `column`: grouping by it needs no further shuffle of what is stored."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = place(spark, name)
    held = os.path.basename(path).replace("-", "_")
    df.repartition(n, column).write.bucketBy(n, column).option("path", path).saveAsTable(held)
    out = spark.table(held)
    # The result knows its files by now; the catalog need not.
    spark.sql(f"DROP TABLE {held}")
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """(row, and `columns` by the names c0, c1, ...): the caller's columns in one struct, where no name of theirs is in the way."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """`wanted`, each with underscores in front until no column has that name; case does not tell names apart."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes, by ASCII white space."""
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_powers: dict[int, np.ndarray] = {}


def odd_powers(n: int, base: int = _ODD) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return held[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in a few passes over all bytes."""
    powers = odd_powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    # The inverse power moves every word to the start, wherever it stands.
    back = odd_powers(len(raw), pow(_ODD, -1, 1 << 64))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int, base: int = _ODD) -> np.ndarray:
    """A 64-bit hash of every run of n consecutive word hashes."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    powers = odd_powers(len(words), base)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    first = np.arange(len(words) - n + 1)
    return mixed((sums[first + n] - sums[first]) * odd_powers(len(words), pow(base, -1, 1 << 64))[first])


class TwoAges:
    """A dictionary of bounded size that forgets what two ages have not asked for.

    When the young half is full it becomes the old one; keys found in the old
    half move back. `fill(keys, learn)` makes all `keys` present in `young`.
    """

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def fill(self, keys: set, learn) -> dict:
        missing = keys.difference(self.young)
        if missing and len(self.young) + len(missing) > self.most // 2:
            self.old, self.young, missing = self.young, {}, keys
        if missing:
            old = self.old
            back = {k: old[k] for k in missing if k in old}
            self.young.update(back)
            learn(self.young, missing.difference(back))
        return self.young
