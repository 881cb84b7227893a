"""Delta-maintained token counts.

Changes to documents come in batches of signed rows: an insert adds a document's tokens to the totals
of its source, language and tokenizer version, a delete takes them away, a revision takes the old
count away and adds the new one. A batch is summed to one row a key and written to a folder of its own;
it is committed by an entry in the log that names the folder: a small file, moved into its place, which
fails if there is one. So an id counts once, whoever tries again or at the same time, and what a
lost attempt has written is never read. Totals are the sums over the folders that the log names.
compact() writes the totals to one folder and puts an entry in the log which says what that holds:
the same step replaces the old batches by it, so totals are right at any moment.

Reading takes one listing and one read of the log (a line a batch), then Spark's read of the folders.

Defined cases: null source, language or version is a key of its own; a null count is 0; a null sign is
0, which changes nothing; keys whose documents and tokens are all 0 have no row; empty batches count
as committed; repeated rows of a batch all count (the batch, not the row, is what is applied once); ids
of batches are letters, digits, dot, underscore and hyphen; columns other than KEYS, sign and n_tokens
are not read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import counted, default_vocabulary
from .common import shared_dir, stash, table

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")


def inserts(counted: DataFrame) -> DataFrame:
    """counted: KEYS and n_tokens, a row a document."""
    return counted.select(*KEYS, F.lit(1).alias("sign"), "n_tokens")


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).alias("sign"), "n_tokens")


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """What documents counted as, and what they now count as (under the same or other keys)."""
    return deletes(old).unionByName(inserts(new))


@dataclass
class Entry:
    """Of the log: a batch's id (or a compaction's), its folder, and the ids that it holds besides."""

    name: str
    folder: str
    held: list[str]
    fold: bool


class Rollup:
    """Totals by source, language and tokenizer version, kept below a folder that all tasks can write to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")

    def _fs(self):
        return self._path("log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[Entry]:
        if not self._fs().exists(self._path("log")):
            return []
        rows = self.spark.read.text(f"{self.folder}/log", wholetext=True).select("_metadata.file_name", "value").collect()
        lines = sorted((r["file_name"], r["value"].split("\n")) for r in rows)
        return [Entry(x[0], x[1], x[2:], name.startswith("fold.")) for name, x in lines]

    def _publish(self, name: str, lines: list[str]) -> bool:
        """Moves a log entry into its place; False if there is one of that name."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        draft = self._path(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write("\n".join(lines).encode())
        out.close()
        fs.mkdirs(self._path("log"))
        at = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            at.rename(draft, self._path(f"log/{name}"), no_options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def committed(self) -> list[str]:
        """Ids of the batches whose totals count, without those that a compaction holds."""
        return sorted(e.name for e in self._live(self.log()))

    @staticmethod
    def _live(log: list[Entry]) -> list[Entry]:
        held = {x for e in log for x in e.held}
        return [e for e in log if e.name not in held]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies the changes (KEYS, sign, n_tokens) once; False if the id had been committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"{batch!r} can't be a batch's id")
        if any(batch == e.name for e in self.log()):
            return False
        sign = F.coalesce(F.col("sign"), F.lit(0)).cast("long")
        delta = changes.groupBy(*KEYS).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce(F.col("n_tokens"), F.lit(0))).alias("n_tokens"))
        return self._publish(f"batch.{batch}", [batch, self._written(delta)])

    def _written(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", "))).write.parquet(f"{self.folder}/{folder}")
        return folder

    def _totals(self, entries: list[Entry]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{e.folder}" for e in entries))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._totals(self._live(self.log()))

    def compact(self, name: str) -> bool:
        """One folder for all committed so far; False if there is one of that name, or another was made meanwhile.

        Log entries stay, as they say which ids have been applied; folders that a compaction holds may be removed
        once nobody reads them."""
        log = self.log()
        if any(name == e.name for e in log):
            return False
        live = self._live(log)
        number = sum(e.fold for e in log) + 1  # of two at a time, one finds its place taken
        return self._publish(f"fold.{number:09d}", [name, self._written(self._totals(live)), *(e.name for e in live)])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five commits and a compaction: all documents counted under the first version; all revised to the second;
    that batch sent again (which must do nothing); copies (equal texts, of which the least doc_id stays) deleted; and
    all that stay counted under the first version, too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    docs = docs.withColumn("same", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    paths, pattern = {v: default_vocabulary(f"{v}.tiktoken")[0] for v in VERSIONS}, default_vocabulary()[1]
    rows = stash(counted(docs, paths, pattern, carry=["doc_id", "source", "lang", "same"]), "token-rows")
    # written, so that Spark can split the rows of a text that many documents have
    least = rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("same").alias("s"), "least")
    marked = rows.join(stash(least, "token-copies"), F.col("same") == F.col("s"), "left").withColumn("copy", F.coalesce(F.col("doc_id") != F.col("least"), F.lit(False)))
    marked = stash(marked.select("source", "lang", *VERSIONS, "copy"), "token-marked")
    by = lambda df, version: df.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(version).alias("n_tokens"))
    first, second = VERSIONS
    rollup = Rollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    revised = revisions(by(marked, first), by(marked, second))
    for name, changes in (
        ("1-load", inserts(by(marked, first))), ("2-revise", revised), ("2-revise", revised),
        ("3-copies", deletes(by(marked.filter("copy"), second))), ("4-first", inserts(by(marked.filter("NOT copy"), first))),
    ):
        rollup.commit(name, changes)
    rollup.compact("all")
    return rollup.totals()


#: Byte-pair encoding has no DuckDB form; tests/llm holds the query against another library's counts.
SQL = None
