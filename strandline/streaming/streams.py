"""Streams: reference logs as they grow, and command streams folded into states."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.text import parse_signature
from ..sources.formats import reflog_rows


def parse_log_lines(lines: DataFrame, text: str = "value", source: Column | None = None) -> DataFrame:
    """Rows of a reference log from its lines, batch or stream alike."""
    head, reason = F.substring_index(text, "\t", 1), F.expr(f"substring({text}, locate('\t', {text}) + 1)")
    size = F.locate(" ", F.col(text))
    who = head.substr(2 * size + 1, F.lit(1 << 20))
    out = lines.select(
        (source if source is not None else F.lit(None).cast("string")).alias("ref_name"),
        head.substr(F.lit(1), size - 1).alias("original_id"), head.substr(size + 1, size - 1).alias("target_id"), parse_signature(who).alias("signature"), reason.alias("reason"),
    )
    return out.filter(F.length("original_id") > 0)


def read_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the log files that appear below ``folder``; the reference's name is the file's path."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(folder)
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"/logs/(.*)$", 1), r"\.[0-9]+$", "")
    return parse_log_lines(lines.select("value", name.alias("__ref")), "value", F.col("__ref"))


LOG = "ref_name string, original_id string, target_id string, signature struct<name:string,email:string,epoch:bigint,tz_offset_min:int>, reason string"


class LogSource(DataSource):
    """Reference logs as they grow: ``spark.readStream.format("reference_log").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "reference_log"

    def schema(self) -> str:
        return LOG

    def simpleStreamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"])


class LogReader(SimpleDataSourceStreamReader):
    """The offset is how many bytes of each file have been read, always up to the end of a line."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict):
        end = dict(start)
        for name, path in self._files():
            with open(path, "rb") as f:
                f.seek(start.get(name, 0))
                end[name] = start.get(name, 0) + f.read().rfind(b"\n") + 1
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = []
        for name, path in self._files():
            begin = start.get(name, 0)
            with open(path, "rb") as f:
                f.seek(begin)
                text = f.read(end.get(name, begin) - begin).decode("utf-8", "replace")
            rows += [(name, old, new, None if who is None else tuple(who.values()), reason) for _, old, new, who, reason in reflog_rows(text)]
        return iter(rows)

    def _files(self) -> list[tuple[str, str]]:
        found = [os.path.join(d, n) for d, _, names in os.walk(self.folder) for n in names]
        return sorted((os.path.relpath(p, self.folder), p) for p in found)


def follow_logs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines that are appended to the logs below a folder; the reference's name is a file's path there."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("reference_log").load(folder)


STATE = "files string, n long"
FOLDED = "stream string, seq long, n_files long, files string"


def fold_commands(commands: DataFrame) -> DataFrame:
    """(stream, seq, op, path, blob) of puts and deletes -> the file list after each micro-batch of a stream's commands.

    A stream's state is its path table; commands of one batch apply by ``seq``.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        files = json.loads(state.get[0]) if state.exists else {}
        seen = state.get[1] if state.exists else 0
        last = -1
        for row in pd.concat(list(pdfs)).sort_values("seq").itertuples():
            last, seen = row.seq, seen + 1
            for p in [p for p in files if p == row.path or p.startswith(row.path + "/")]:
                del files[p]
            if row.op == "M":
                files[row.path] = row.blob
        state.update((json.dumps(files, sort_keys=True), seen))
        yield pd.DataFrame({"stream": [key[0]], "seq": [last], "n_files": [len(files)], "files": [json.dumps(files, sort_keys=True)]})

    return commands.groupBy("stream").applyInPandasWithState(run, FOLDED, STATE, "update", "NoTimeout")
