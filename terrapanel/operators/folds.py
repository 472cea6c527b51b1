"""Fold assignment of spatial blocks and years, and the train/test splits built on it.

Folds belong to blocks, never to rows.  Seeded shuffles order blocks by an MD5, so that no draw depends on a library or on
the order of rows.  The number of blocks is bounded by the grid: ranks go over the table of blocks, and the one policy that
walks them (least loaded first) does so on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_BLOCKS = 1_000_000


def dense_folds(df: DataFrame, key: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """key, fold: rank among the sorted distinct keys, modulo k."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(fold, ((F.dense_rank().over(W.orderBy(key)) - 1) % k).cast("int"))


def chunk_folds(df: DataFrame, key: str, k: int = 5, fold: str = "tfold") -> DataFrame:
    """key, fold: k contiguous chunks of the sorted distinct keys, the first ones longer by one."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(fold, (F.ntile(k).over(W.orderBy(key)) - 1).cast("int"))


def lot(key: str | Column, seed: int) -> Column:
    """The seeded place of a block in a shuffle: an MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key) if isinstance(key, str) else key))


def shuffled_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, fold: str = "fold") -> DataFrame:
    """key, fold: seeded shuffle of the keys, then in turn."""
    return dense_folds(df.withColumn("_lot", lot(key, seed)), "_lot", k, fold).join(df.select(key, lot(key, seed).alias("_lot")).where(F.col(key).isNotNull()).distinct(), "_lot").select(key, fold)


def balanced_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, fold: str = "fold") -> DataFrame:
    """key, fold: largest blocks first to the fold with the fewest rows (the first of equals); lots settle equal sizes.

    The walk is sequential, over at most MAX_BLOCKS blocks, and so on the driver.
    """
    counted = df.where(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), lot(key, seed)).limit(MAX_BLOCKS + 1).collect()
    if len(counted) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks: use dense_folds")
    load, out = [0] * k, []
    for b, n in counted:
        least = min(range(k), key=load.__getitem__)
        load[least] += n
        out.append((b, least))
    return df.sparkSession.createDataFrame(out, f"{key} {dict(df.dtypes)[key]}, {fold} int")


def assigned(df: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Rows with their fold; a key without a fold is an error."""
    out = df.join(folds, key, "left")
    name = next(c for c in folds.columns if c != key)
    return out.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{key} without a fold"))).otherwise(F.col(name)))


@dataclass(frozen=True)
class Split:
    """Which rows train the model that predicts a test cell.

    ``spatial``: train on other folds.  ``both``: test cells are (fold, tfold); train where both differ.  ``either``:
    test label f is fold = f or tfold = f; train where neither is.
    """

    kind: str = "spatial"
    k: int = 5
    k_time: int = 5

    @property
    def cells(self) -> list[str]:
        return ["fold"] if self.kind == "spatial" else ["fold", "tfold"]

    @property
    def tests(self) -> list[str]:
        return ["test", "test_time"] if self.kind == "both" else ["test"]

    def train_rows(self, cells: DataFrame) -> DataFrame:
        """Every cell once for each test cell that it trains."""
        out = cells.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(self.k - 1)))).where("fold <> test")
        if self.kind == "both":
            return out.withColumn("test_time", F.explode(F.sequence(F.lit(0), F.lit(self.k_time - 1)))).where("tfold <> test_time")
        return out.where("tfold <> test") if self.kind == "either" else out

    def test_rows(self, df: DataFrame) -> DataFrame:
        """Every row once for each test cell that it is in."""
        if self.kind == "spatial":
            return df.withColumn("test", F.col("fold"))
        if self.kind == "both":
            return df.withColumn("test", F.col("fold")).withColumn("test_time", F.col("tfold"))
        return df.withColumn("test", F.explode(F.array_distinct(F.array("fold", "tfold"))))

    def sizes(self, df: DataFrame) -> DataFrame:
        """n_train and n_test of each test cell."""
        cells = df.groupBy(*self.cells).agg(F.count("*").alias("n"))
        train = self.train_rows(cells).groupBy(*self.tests).agg(F.sum("n").alias("n_train"))
        test = self.test_rows(cells).groupBy(*self.tests).agg(F.sum("n").alias("n_test"))
        return train.join(test, self.tests, "full").select(*self.tests, F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_test", F.lit(0)).alias("n_test"))
