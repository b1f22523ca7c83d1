"""Token counts as additive totals that signed changes maintain, with idempotent batch commits."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a change does.
OPERATIONS = ("insert", "delete", "revise")
KEYS = ("source", "lang", "tokenizer")


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, documents, tokens): the sum of all changes of a key.

    ``changes(op, source, lang, tokenizer, tokens, old_tokens)``: an insert adds a document and its
    tokens, a delete takes them away, a revision adds the difference to ``old_tokens``. A null count
    is 0; null keys are keys of their own; any other op is an error. Partial sums are taken before the
    shuffle, so a source with a third of all rows is one row a task.
    """
    tokens, old = (F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("tokens", "old_tokens"))
    wrong = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("bigint")
    documents = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    amount = (
        F.when(F.col("op") == "insert", tokens)
        .when(F.col("op") == "delete", -tokens)
        .when(F.col("op") == "revise", tokens - old)
    )
    return changes.groupBy(*KEYS).agg(
        F.sum(documents.otherwise(wrong)).cast("bigint").alias("documents"), F.sum(amount).alias("tokens")
    )


class TokenRollup:
    """Totals in a folder that all executors share: one folder of sums for each committed batch.

    A batch is committed once: committing its id again changes nothing, and a commit that was broken
    off is written anew, because only the writer's success mark makes it count. ``compact`` adds the
    batches up into one base, which remembers their ids.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def _done(self, folder: str) -> list[str]:
        """Names of the finished folders below one."""
        fs, there = self._fs(f"{self.path}/{folder}")
        if not fs.exists(there):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(there)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.path}/{folder}/{n}/_SUCCESS")[1]))

    def _base(self) -> str | None:
        done = self._done("base")
        return f"{self.path}/base/{done[-1]}" if done else None

    def committed(self) -> set[str]:
        """Ids of all batches that count."""
        found = {unquote(n) for n in self._done("batch")}
        base = self._base()
        if base is not None:
            found |= {r["id"] for r in self.spark.read.parquet(base).filter("id IS NOT NULL").select("id").collect()}
        return found

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if it has been committed before."""
        if batch_id in self.committed():
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.path}/batch/{quote(batch_id, safe='')}")
        return True

    def _parts(self) -> tuple[list[str], DataFrame | None]:
        base, parts = self._base(), []
        merged: set[str] = set()
        columns = [*KEYS, "documents", "tokens"]
        if base is not None:
            table = self.spark.read.parquet(base)
            merged = {r["id"] for r in table.filter("id IS NOT NULL").select("id").collect()}
            parts.append(table.filter("id IS NULL").select(*columns))
        fresh = [n for n in self._done("batch") if unquote(n) not in merged]
        if fresh:
            parts.append(self.spark.read.parquet(*(f"{self.path}/batch/{n}" for n in fresh)).select(*columns))
        rows = None
        for part in parts:
            rows = part if rows is None else rows.unionByName(part)
        return sorted(merged | {unquote(n) for n in fresh}), rows

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) of all committed batches; keys without
        documents and tokens are left out."""
        _, rows = self._parts()
        if rows is None:
            form = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
            return self.spark.createDataFrame([], form)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Write all committed batches as one base."""
        ids, rows = self._parts()
        if rows is None:
            return
        number = len(self._done("base"))
        names = self.spark.createDataFrame([(i,) for i in ids], "id string")
        table = self.totals().unionByName(names, allowMissingColumns=True)
        table.write.mode("overwrite").parquet(f"{self.path}/base/{number:09d}")
