"""New batches against everything accepted before, as read when it was accepted, by a segment index for edit distance.

A question is coded as a string: a letter per word, names and numbers from one range of letters, other words from another, in
an order that hangs on the words alone.  Questions that ask the same then differ by at most ``EDITS`` letters.  The store keeps
each accepted string in ``EDITS + 1`` segments by length, number and place; of such a string at least one segment stands
unchanged in any string within ``EDITS`` edits.  A batch probes with the substrings selected by length and place; what
meets is verified by edit distance, then word by word; what is accepted is appended.

The store's tables are bucketed by what they are probed with: a batch is shuffled, the history is not.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import questions
from graphweft.session import cut, fresh_path, keep, partitions

EDITS = questions.LEFT_OVER
#: Two ranges of private letters: names and numbers, and other words.
NAMES, OTHERS, RANGE = 0xF0000, 0x100000, 0xFFF0


def coded(subject: str, line: str) -> str:
    """A letter per word of the line, in the order of the words' hashes: a word more or less is one edit wherever it stood."""
    about = set(subject.split(" "))
    letters = sorted((zlib.crc32(w.encode()) % RANGE, w not in about) for w in line.split(" ") if w)
    return "".join(chr((OTHERS if other else NAMES) + h) for h, other in letters)


def segments(form: str) -> list[tuple[int, int, str]]:
    """``EDITS + 1`` pieces of near equal length: (number, begin, piece)."""
    n, k = len(form), EDITS + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(i, cuts[i], form[cuts[i] : cuts[i + 1]]) for i in range(k)]


def probes(form: str) -> list[tuple[int, int, str]]:
    """Every (length, number, piece) that a form within ``EDITS`` edits may have stored."""
    n, k = len(form), EDITS + 1
    out = set()
    for length in range(max(0, n - EDITS), n + EDITS + 1):
        delta = n - length
        for i in range(k):
            begin, size = length * i // k, length * (i + 1) // k - length * i // k
            for start in range(max(0, begin - (EDITS - delta) // 2), min(n - size, begin + (EDITS + delta) // 2) + 1):
                out.add((length, i, form[start : start + size]))
    return sorted(out)


def within(a: str, b: str, most: int = EDITS) -> bool:
    """Whether at most ``most`` letters must be added, dropped or changed to turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, most + 1) + 1
            if j:
                best = min(best, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
            new[j] = best
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), most + 1) <= most


def digest(signature: Column) -> Column:
    """A digest without the ways of writing it; NULL for blank ones."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(signature)), r"^[a-z0-9-]+:|[^0-9a-f]", ""), F.lit(""))


def read_tasks(tasks: DataFrame) -> DataFrame:
    """``task_id``, ``batch_no``, ``signature``, ``folded``: each task once, in its first batch; rows with a NULL id or batch
    are left out, and a payload that is no whole JSON text has no question."""
    question = F.try_variant_get(F.try_parse_json("payload"), "$.question", "string")
    rows = tasks.select("task_id", "batch_no", digest(F.col("signature")).alias("signature"), question.alias("question")).filter("task_id is not null and batch_no is not null")
    once = rows.groupBy("task_id").agg(F.min_by(F.struct("batch_no", "signature", "question"), F.struct("batch_no", F.col("question").isNull(), "question", "signature")).alias("r")).select("task_id", "r.*")
    return once.withColumn("folded", F.nullif(questions.folded(F.col("question")), F.lit(""))).drop("question")


def keyed(vocabulary: Mapping[str, int]) -> Callable[[Column], Column]:
    """A column function: a folded question to a struct of ``subject``, ``kept``, ``code``, ``stored`` and ``probed``, the keys
    under which the index holds it and those that find what may ask the same.

    A segment without a name or number is a turn of phrase that any number of questions share: its key has the subject with
    it.  A question with words that may be slips of several is not bound to ``EDITS`` edits; it is stored under its subject
    too (sign ?), and probes by subject (sign =).
    """
    made: list[questions.Reader] = []

    @F.pandas_udf("subject string, kept string, code string, stored array<string>, probed array<string>")
    def read(text: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(questions.Reader(vocabulary))
        rows = []
        for t in text:
            subject, _, kept, line, doubts = made[0].read_whole(t or "")
            code = coded(subject, line)
            key = lambda n, i, piece, s=subject: f"{n}:{i}:{piece}" if any(ch < chr(OTHERS) for ch in piece) else f"{n}:{i}:{piece}:{s}"
            stored = [key(len(code), i, piece) for i, _, piece in segments(code)] + [f"={subject}"] + [f"?{subject}"] * (doubts > 0)
            probed = [f"={subject}"] if doubts else [*(key(*p) for p in probes(code)), f"?{subject}"]
            rows.append((subject, kept, code, stored, probed))
        return pd.DataFrame(rows, columns=["subject", "kept", "code", "stored", "probed"])

    return read


class Store:
    """The accepted tasks, as bucketed tables in the shared folder that only grow: ``tasks`` by text (task_id, batch_no,
    signature, text), ``digests`` by signature (signature, task_id), ``segments`` by key (key, text, subject, kept, code).

    ``name`` finds a store again within the session's catalogue; its vocabulary is that of the first history.
    """

    def __init__(self, spark: SparkSession, vocabulary: Mapping[str, int], name: str | None = None):
        self.spark, self.vocabulary = spark, dict(vocabulary)
        self.name = name or f"graphweft_{uuid.uuid4().hex}"
        self.buckets = partitions(spark)

    def read(self, tasks: DataFrame) -> DataFrame:
        """Tasks with what the index needs, written once; ``text`` tells questions of one subject and the same kept words."""
        read = tasks.withColumn("_r", keyed(self.vocabulary)("folded"))
        own = [F.when(F.col("folded").isNotNull(), F.col(f"_r.{c}")).alias(c) for c in ("subject", "kept", "code", "stored", "probed")]
        read = read.select("task_id", "batch_no", "signature", *own)
        text = F.when(F.col("kept").isNotNull(), F.sha2(F.concat_ws("\x1f", "subject", "kept"), 256))
        path = fresh_path(self.spark, "batch")
        read.withColumn("text", text).write.parquet(path)
        return self.spark.read.parquet(path)

    def accept(self, tasks: DataFrame) -> None:
        """Appends tasks as ``read`` gave them."""
        self._append("tasks", tasks.select("task_id", "batch_no", "signature", "text"), "text")
        self._append("digests", tasks.filter("signature is not null").select("signature", "task_id"), "signature")
        texts = tasks.filter("text is not null").dropDuplicates(["text"])
        self._append("segments", texts.select(F.explode("stored").alias("key"), "text", "subject", "kept", "code"), "key")

    def _append(self, kind: str, rows: DataFrame, by: str) -> None:
        name = f"{self.name}_{kind}"
        new = not self.spark.catalog.tableExists(name)
        writer = rows.repartition(self.buckets, by).write.format("parquet").bucketBy(self.buckets, by)
        if new:
            writer = writer.option("path", fresh_path(self.spark, kind))
            keep(self.spark, name)
        writer.mode("append").saveAsTable(name)

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def tasks(self) -> DataFrame:
        return self.table("tasks")

    def repeats(self, batch: DataFrame) -> DataFrame:
        """Pairs ``task`` of the (read) batch and ``accepted`` task it repeats."""
        # The tables grow without bound, so none is broadcast: merge joins read their buckets as they lie.
        digests = self.table("digests").withColumnRenamed("task_id", "accepted").hint("merge")
        by_digest = batch.filter("signature is not null").select(F.col("task_id").alias("task"), "signature").join(digests, "signature").select("task", "accepted")
        texts = batch.filter("text is not null").dropDuplicates(["text"])
        probing = texts.select(F.explode("probed").alias("key"), F.col("text").alias("_text"), F.col("subject").alias("_subject"), F.col("kept").alias("_kept"), F.col("code").alias("_code"))
        met = probing.join(self.table("segments").hint("merge"), "key").filter(F.col("subject") == F.col("_subject"))
        near = F.substring("key", 1, 1).isin("=", "?") | (F.levenshtein("code", "_code", EDITS) >= 0)
        same = questions.sameness(self.vocabulary)
        met = met.filter(near).select("_text", "text", "_kept", "kept").distinct().filter(same("_kept", "kept")).select("_text", "text")
        accepted = self.tasks().select("text", F.col("task_id").alias("accepted")).hint("merge")
        asked = batch.select(F.col("task_id").alias("task"), F.col("text").alias("_text"))
        by_question = met.join(accepted, "text").join(asked.hint("merge"), "_text").select("task", "accepted")
        return cut(by_digest.unionByName(by_question).distinct())


def check_batches(tasks: DataFrame, history_batch: int = 0, store: Store | None = None) -> tuple[Store, DataFrame]:
    """Checks the batches in order: the store with all accepted tasks, and ``task``, ``accepted`` pairs.

    Batches up to ``history_batch`` are the accepted history (none of them is read if a ``store`` is given, which holds them).
    A task that repeats an accepted one of an earlier batch is not accepted; tasks of one batch are not held against each
    other.  Without tasks there are no pairs.
    """
    spark = tasks.sparkSession
    if store is not None:
        tasks = tasks.filter(F.col("batch_no") > history_batch)
    at = fresh_path(spark, "tasks")
    rows = read_tasks(tasks)
    (rows.write if tasks.isEmpty() else rows.write.partitionBy("batch_no")).parquet(at)
    rows = spark.read.schema("task_id string, signature string, folded string, batch_no int").parquet(at)
    batches = sorted(r.batch_no for r in rows.select("batch_no").distinct().collect() if r.batch_no > history_batch)
    if store is None:
        history = rows.filter(F.col("batch_no") <= history_batch)
        store = Store(spark, questions.vocabulary(history, "folded"))
        store.accept(store.read(history))
    found = spark.createDataFrame([], "task string, accepted string")
    for b in batches:
        batch = store.read(rows.filter(F.col("batch_no") == b))
        pairs = store.repeats(batch)
        store.accept(batch.join(pairs.select(F.col("task").alias("task_id")).distinct().hint("merge"), "task_id", "left_anti"))
        found = found.unionByName(pairs)
    return store, found
