"""Readers and writers of files around a graph: SQLite, remote endpoints, JSON, logs, task files, manifests, reports."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators import primitives
from graphweft.session import ship
from graphweft.sources.catalog import GraphCatalog, build

#: Rows of a SQLite table that one task reads.
SLICE = 500_000
RETRIES, WAIT = 3, 0.5


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a SQLite file that all workers can read, opened read-only, a range of row numbers per task.  Columns are those
    of the schema; a table the file lacks is empty."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        there = db.execute("SELECT count(*) FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (name,)).fetchone()[0]
        last = db.execute(f'SELECT coalesce(max(rowid), 0) FROM "{name}"').fetchone()[0] if there else 0
    if not last:
        return spark.createDataFrame([], schema)
    columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    chosen = ", ".join(f'"{c}"' for c in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for low in batch.id:
                    rows = db.execute(f'SELECT {chosen} FROM "{name}" WHERE rowid > ? AND rowid <= ?', (int(low), int(low) + SLICE))
                    while part := rows.fetchmany(20_000):
                        yield pd.DataFrame(part, columns=columns, dtype=object)

    slices = -(-last // SLICE)
    return ship(spark).range(0, slices * SLICE, SLICE, slices).mapInPandas(read, schema)


def sqlite_catalog(spark: SparkSession, path: str) -> GraphCatalog:
    """A graph from a SQLite file with the tables entities, entity_types, edges, attributes, facts, qualifiers, relations and
    passages; what is missing is empty."""
    value = "value string, datatype string, unit string"
    read = lambda name, schema: sqlite_table(spark, path, name, schema)
    entities = read("entities", "entity_id string, label string, aliases string")
    return build(
        spark,
        entities=entities.withColumn("aliases", F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>"))),
        entity_types=read("entity_types", "entity_id string, type_id string"),
        edges=read("edges", "subject string, relation string, object string").distinct(),
        attributes=read("attributes", f"entity_id string, key string, {value}"),
        facts=read("facts", f"fact_id string, kind string, subject string, predicate string, object_entity string, {value}"),
        qualifiers=read("qualifiers", f"fact_id string, key string, {value}"),
        relation_labels=read("relations", "relation_id string, label string"),
        passages=read("passages", "page_id string, paragraph_id long, title string, text string"),
    )


def post(endpoint: str, query: str, timeout: float = 30.0) -> str:
    request = urllib.request.Request(endpoint, urllib.parse.urlencode({"query": query}).encode(), {"Accept": "application/sparql-results+json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode()


def remote(spark: SparkSession, endpoint: str, query: str, snapshot: str, cache: str, send: Callable[[str, str], str] = post, wait: float = WAIT) -> DataFrame:
    """The answers of a remote SPARQL endpoint, a STRING column per variable (NULL where unbound).

    A query is sent by POST, at most ``RETRIES`` times with doubled pauses, and its answer kept in ``cache`` under a digest of
    snapshot, endpoint and query, from which it is read next time.
    """
    name = Path(cache) / f"{hashlib.sha256(json.dumps([snapshot, endpoint, query]).encode()).hexdigest()}.json"
    if name.exists():
        text = name.read_text()
    else:
        for attempt in range(RETRIES):
            try:
                text = send(endpoint, query)
                break
            except OSError:
                if attempt == RETRIES - 1:
                    raise
                time.sleep(wait * 2**attempt)
        json.loads(text)  # only whole answers are kept
        name.parent.mkdir(parents=True, exist_ok=True)
        part = name.with_suffix(".part")
        part.write_text(text)
        part.replace(name)
    data = json.loads(text)
    if "boolean" in data:
        return spark.createDataFrame([(data["boolean"],)], "answer boolean")
    columns = data["head"]["vars"]
    rows = [tuple(b.get(c, {}).get("value") for c in columns) for b in data["results"]["bindings"]]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def json_array(spark: SparkSession, path: str, schema: str, limit: int | None = None, chars: int = 1 << 20) -> DataFrame:
    """The elements of a file that is one JSON array, read in pieces of ``chars`` characters: no task holds the whole array.
    Anything but an array of whole values is refused."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch.path:
                part: list[str] = []
                for value in elements(source, limit, chars):
                    part.append(json.dumps(value, ensure_ascii=False))
                    if len(part) >= 1000:
                        yield pd.DataFrame({"value": part})
                        part = []
                yield pd.DataFrame({"value": part}, dtype=object)

    raw = ship(spark).createDataFrame([(path,)], "path string").mapInPandas(read, "value string")
    return raw.select(F.from_json("value", schema).alias("r")).select(*(F.col("r").getField(c).alias(c) for c in names))


def elements(path: str, limit: int | None = None, chars: int = 1 << 20) -> Iterator[object]:
    decoder, held, done, began, ended = json.JSONDecoder(), "", 0, False, False
    with open(path, encoding="utf-8") as file:
        more = True
        while True:
            held = held.lstrip()
            if began and not ended and held.startswith(","):
                held = held[1:].lstrip()
            if not began and held:
                if not held.startswith("["):
                    raise ValueError("no JSON array")
                held, began = held[1:], True
                continue
            if began and held.startswith("]"):
                held, ended = held[1:].lstrip(), True
            if ended:
                while held := held.strip() or file.read(chars):
                    if held.strip():
                        raise ValueError("text after the array")
                return
            if limit is not None and done >= limit:
                return
            try:
                value, end = decoder.raw_decode(held)
                if end == len(held) and more:
                    raise ValueError  # a number may go on in the next piece
            except ValueError:
                piece = file.read(chars)
                more = bool(piece)
                if not piece and (not held or held.isspace() or not _whole(decoder, held)):
                    raise ValueError("the array is cut off") from None
                held += piece
                continue
            yield value
            done, held = done + 1, held[end:]


def _whole(decoder: json.JSONDecoder, held: str) -> bool:
    try:
        decoder.raw_decode(held)
    except ValueError:
        return False
    return True


def row_count(spark: SparkSession, path: str) -> int:
    """How many rows a Parquet dataset has, from its footers alone."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return spark.read.parquet(path).count()


def tasks(spark: SparkSession, paths: list[str], limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Tasks of several Parquet files, in order of the files' places in the list where a limit over all of them cuts."""
    out = None
    for k, path in enumerate(paths):
        df = spark.read.parquet(path)
        df = (df.select(*columns) if columns else df).withColumn("_source", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return (out if limit is None else out.orderBy("_source").limit(limit)).drop("_source")


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a trainer's log, a JSON object per line; blank lines are passed over, a line that is none fails with its text."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = F.when(F.try_parse_json("value").isNull(), F.raise_error(F.concat(F.lit("BAD_LINE: "), F.substring("value", 1, 80)))).otherwise(F.from_json("value", schema))
    return lines.select(read.alias("r")).select("r.*")


def preflight(catalog: GraphCatalog) -> dict[str, object]:
    """Whether a graph can be read: how many entities and edges, one neighbourhood, and the seconds that took."""
    began = time.monotonic()
    first = catalog.entities.agg(F.count("*").alias("n"), F.min("entity_id").alias("first")).first()
    near = primitives.neighbors(catalog, catalog.spark.createDataFrame([(first["first"],)], "entity_id string"), "both", limit=10).count() if first["n"] else 0
    return {"entities": first["n"], "edges": catalog.edges.count(), "probe": first["first"], "neighbours": near, "seconds": round(time.monotonic() - began, 3)}


def typed_sink(df: DataFrame, path: str, schema: str) -> None:
    """Rows as Parquet with just the columns and types of the schema; a column the rows lack is NULL, and no rows still give a file
    with the schema."""
    kinds = [(f.name, f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds)).write.mode("overwrite").parquet(path)


def split_sink(df: DataFrame, path: str, split: str = "split") -> None:
    """Examples as Parquet, a folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def export(archive: DataFrame, path: str) -> int:
    """An archive in order of its ids, as JSON lines; gives how many."""
    archive.orderBy("task_id").write.mode("overwrite").json(path)
    return archive.count()


def manifest(path: str, config: dict[str, object], commit: str, artifacts: list[str]) -> dict[str, object]:
    """Writes what a run was made from: a digest of its configuration, the commit, and its artifacts, in order."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    out = {"config_sha256": hashlib.sha256(text.encode()).hexdigest(), "commit": commit, "artifacts": sorted(artifacts)}
    _write(path, json.dumps(out, indent=2, sort_keys=True))
    return out


def report(rows: DataFrame, path: str, most: int = 100_000) -> int:
    """A summary as JSON lines in one file, in order of its columns; tables of more than ``most`` rows are no summary and refused."""
    data = [json.loads(r.value) for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).limit(most + 1).collect()]
    if len(data) > most:
        raise ValueError("too many rows for a report")
    _write(path, "".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in sorted(data, key=lambda r: json.dumps(r, sort_keys=True))))
    return len(data)


def compact_view(records: DataFrame, path: str, columns: list[str]) -> None:
    """The few columns training reads, beside the full records."""
    records.select(*columns).write.mode("overwrite").parquet(path)


def _write(path: str, text: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(text, encoding="utf-8")
    part.replace(target)


def file_digest(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while piece := file.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()
