"""Readers of directories, manifests, journals, sessions and transcripts."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator
from fnmatch import fnmatch
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyweave.functions.hashing import keccak256, path_leaf
from tallyweave.functions.text import posix_path
from tallyweave.operators.logs import strict_json

MANIFEST = "root string, files array<struct<relPath:string,contentHash:string,leaf:string,hints:struct<source:string,license:string>>>"
JOURNAL = "journal string, seq bigint, prevHash string, ts string, artifact string, verdict string, entryHash string"


def scan_directory(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of all regular files below a folder, with paths relative to it; dotfiles and links are left out.

    The reader skips empty files, so these are listed apart: their paths alone come from the driver's listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = "file:" + str(Path(folder).resolve()) if "://" not in folder else folder.rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^" + base.replace("file:", "file:/*") + "/", "")
    read = reader.load(folder).select("path", "length", "content")
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    listing, empty = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while listing.hasNext():
        f = listing.next()
        if not f.getLen() and (glob is None or fnmatch(f.getPath().getName(), glob)):
            empty.append((f.getPath().toString(), 0, bytearray()))
    every = read.unionByName(spark.createDataFrame(empty, read.schema)) if empty else read
    x = every.select(posix_path(rel).alias("path"), "length", "content")
    return x.filter(~F.col("path").rlike(r"(?:^|/)\."))


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length) of the files below a folder whose names end so, in whatever case, by path; dotfiles and dot folders are left out."""
    ends = F.lower("path").rlike("(?:" + "|".join(re.escape(s.lower()) for s in suffixes) + ")$")
    return scan_directory(spark, folder).filter(ends).select("path", "length").orderBy("path")


def directory_manifest(files: DataFrame) -> DataFrame:
    """(path, content_hash, leaf) in Keccak of the result of scan_directory(); the leaf binds path and content."""
    digest = files.select("path", keccak256(F.col("content")).alias("digest"))
    return digest.select("path", F.concat(F.lit("0x"), F.lower(F.hex("digest"))).alias("content_hash"), F.concat(F.lit("0x"), F.lower(F.hex(path_leaf(F.col("path"), F.col("digest"))))).alias("leaf"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash, leaf, source, license) of a manifest file in JSON."""
    f = F.col("f")
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST").select(F.explode("files").alias("f"))
    return rows.select(f.relPath.alias("path"), f.contentHash.alias("content_hash"), f.leaf.alias("leaf"), f.hints.source.alias("source"), f.hints.license.alias("license"))


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.text(path) if Path(path.removeprefix("file:")).exists() or "://" in path else None


def read_journal(spark: SparkSession, path: str, journal: str = "journal") -> DataFrame:
    """Journal entries of a JSON-lines file in the columns of chain_breaks(); a missing file is an empty journal."""
    lines = _lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], "journal string, seq bigint, prev_hash string, body string, entry_hash string")
    v = F.try_parse_json(F.col("value"))
    text = lambda p: F.try_variant_get(v, p, "string")
    rows = lines.filter(F.btrim("value") != "").select(F.lit(journal).alias("journal"), text("$.seq").try_cast("bigint").alias("seq"), text("$.prevHash").alias("prev_hash"), F.get_json_object("value", "$.verdict").alias("body"), text("$.entryHash").alias("entry_hash"))
    return rows


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """Session events (seq, ts, actor, type, payload, payload_hash, redacted, meta) of a JSON-lines file or one JSON array; blank lines are ignored."""
    whole = spark.read.text(path, wholetext=True).select(F.btrim("value", F.lit(" \t\r\n\ufeff")).alias("t"))
    items = F.from_json("t", "array<string>")
    lines = F.filter(F.split("t", r"\r?\n"), lambda x: F.btrim(x) != "")
    rows = whole.select(F.explode(F.when(F.col("t").startswith("["), items).otherwise(lines)).alias("e"))
    return rows.select(F.from_json("e", "seq bigint, ts string, actor string, type string, payload string, payloadHash string, redacted boolean, meta string").alias("e")).select("e.seq", "e.ts", "e.actor", "e.type", "e.payload", F.col("e.payloadHash").alias("payload_hash"), "e.redacted", "e.meta")


def transcript_events(lines: DataFrame, session: str, position: str, line: str) -> DataFrame:
    """(session, seq, ts, actor, type, payload) of raw transcript lines {ts, role, content}: none to many events a line.

    Content is a text or a list of blocks (text, tool_use, tool_result); events are numbered from 0 in the order of lines
    and blocks. Lines and blocks of other forms give no events.
    """
    v = F.try_parse_json(F.col(line))
    blocks = F.try_variant_get(v, "$.content", "array<variant>")
    plain = F.try_variant_get(v, "$.content", "string")
    is_list = F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")).startswith("ARRAY")
    role = F.try_variant_get(v, "$.role", "string")
    x = lines.select(session, position, F.try_variant_get(v, "$.ts", "string").alias("ts"), role.alias("actor"), F.when(is_list, blocks).alias("blocks"), F.when(~is_list, plain).alias("plain"))
    text_type = F.when(F.col("actor") == "user", "prompt").when(F.col("actor") == "assistant", "completion")
    one = x.filter("plain is not null").select(session, position, F.lit(0).alias("part"), "ts", "actor", text_type.alias("type"), F.col("plain").alias("payload"))
    many = x.filter("blocks is not null").select(session, position, "ts", "actor", F.posexplode("blocks").alias("part", "b"))
    kind = F.try_variant_get("b", "$.type", "string")
    block_type = F.when(kind == "text", text_type).when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result")
    payload = F.when(kind == "text", F.try_variant_get("b", "$.text", "string")).otherwise(F.to_json("b"))
    many = many.select(session, position, "part", "ts", "actor", block_type.alias("type"), payload.alias("payload"))
    events = one.unionByName(many).filter("type is not null and payload is not null")
    seq = F.row_number().over(Window.partitionBy(session).orderBy(position, "part")) - 1
    return events.select(session, seq.cast("bigint").alias("seq"), "ts", "actor", "type", "payload")


def batch_entries(text: str) -> list[str]:
    """Files named by a batch manifest: a JSON array of texts, or words of lines with `#` comments."""
    if text.lstrip().startswith("["):
        return [str(x) for x in json.loads(text)]
    return [w for line in text.splitlines() for w in line.split("#")[0].split()]


class ArtifactError(ValueError):
    """A small artifact is no JSON object, or lacks members, or has unknown ones."""


def read_artifact(path: str, required: dict[str, type | tuple], optional: dict[str, type | tuple] | None = None, kind: tuple[str, str] | None = None) -> dict:
    """A policy, receipt, close or baseline: one small JSON object, read strictly on the driver.

    `required` and `optional` name the members and their Python types; `kind` a member and the value it must have.
    ArtifactError names the first member that is missing, unknown or of another type.
    """
    try:
        value = strict_json(Path(path).read_text("utf-8-sig"))
    except (OSError, ValueError) as e:
        raise ArtifactError(f"{path}: {e}") from e
    if not isinstance(value, dict):
        raise ArtifactError(f"{path}: no JSON object")
    every = required | (optional or {})
    if kind is not None and value.get(kind[0]) != kind[1]:
        raise ArtifactError(f"{path}: {kind[0]} is not {kind[1]}")
    for name in required:
        if name not in value:
            raise ArtifactError(f"{path}: {name} is missing")
    for name, v in value.items():
        if name not in every and (kind is None or name != kind[0]):
            raise ArtifactError(f"{path}: {name} is unknown")
        if name in every and (not isinstance(v, every[name]) or isinstance(v, bool) and every[name] is int):
            raise ArtifactError(f"{path}: {name} has another type")
    return value


def agreeing_profiles(baseline: dict, current: str, path: str = "baseline") -> None:
    """ArtifactError unless a baseline report was made under the profile that is current; one without profile fits none."""
    if baseline.get("profile") != current:
        raise ArtifactError(f"{path}: made under profile {baseline.get('profile')}, not {current}")


def load_settings(folder: str, name: str, table_name: str | None = None) -> tuple[dict, str | None]:
    """(settings, file they came from) of the nearest TOML file `name` in `folder` or above, or its table; ({}, null) if there is none."""
    import tomllib

    for at in (Path(folder).resolve(), *Path(folder).resolve().parents):
        if (at / name).is_file():
            with (at / name).open("rb") as f:
                found = tomllib.load(f)
            for part in (table_name or "").split(".") if table_name else ():
                found = found.get(part, {})
            return found, str(at / name)
    return {}, None


def chunk_digests(chunks: DataFrame, file: str, number: str, content: str) -> DataFrame:
    """(file, size, digest): SHA-256 of files that come as chunks, in order of their numbers; memory holds one batch of chunks.

    Chunks are parted by file and sorted; the running hash goes from batch to batch of a task, so a file of any size needs
    no cell of its own. Null chunks count as empty.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, digest, size, out = None, None, 0, []
        for batch in batches:
            for f, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest is None or f != open_:
                    if digest is not None:
                        out.append((open_, size, digest.hexdigest()))
                    open_, digest, size = f, hashlib.sha256(), 0
                digest.update(data or b"")
                size += len(data or b"")
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        if digest is not None:
            out.append((open_, size, digest.hexdigest()))
        yield _rows(out)

    kind = chunks.schema[file].dataType.simpleString()
    ddl = f"`{file}` {kind}, size bigint, digest string"
    types = to_arrow_schema(StructType.fromDDL(ddl))
    _rows = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(types)], schema=types)
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.select(file, number, content).repartition(n, file).sortWithinPartitions(file, number).mapInArrow(run, ddl)


def git_files(spark: SparkSession, folder: str, ref: str = "HEAD") -> DataFrame:
    """(path) of the files tracked at a ref."""
    out = subprocess.run(["git", "-C", folder, "ls-tree", "-r", "-z", "--name-only", ref], capture_output=True, check=True).stdout.decode()
    return spark.createDataFrame([(p,) for p in out.split("\0") if p], "path string")


def git_commits(spark: SparkSession, folder: str, span: str) -> DataFrame:
    """(oid, position) of the commits of a range, oldest first."""
    out = subprocess.run(["git", "-C", folder, "rev-list", "--reverse", span], capture_output=True, check=True, text=True).stdout.split()
    return spark.createDataFrame([(o, k) for k, o in enumerate(out)], "oid string, position bigint")


def point(df: DataFrame, key: str, value: Column | str) -> DataFrame:
    """Rows of one key; an unknown key gives none, which is no error."""
    return df.filter(F.col(key) == value)
