"""What sessions leave as files while they live: the state they were resolved to and copies of their transcripts.

A sink for the rows of lifecycle.session_lives(), to be called for each micro-batch. A start writes `sessions/<id>/resolved.json`, a compaction
copies the transcript to `sessions/<id>/snapshots/<number>.jsonl`, and the end, or expiry, deletes the session's folder. A session's
rows are one task's, in order; files are written under another name and renamed. Doing a batch again does the same again. A transcript
that isn't there yet is no snapshot; ids that are no file names are left out.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.sources.text_files import file_system
from lodestrand.streaming.ingest import LIFECYCLE

ENDS = ("SessionEnd", "Expired")
_NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]*")


def keep_files(lives: DataFrame, folder: str, most_bytes: int = 1 << 23) -> None:
    """Does what the rows of a micro-batch say. Transcripts are copied in pieces of at most most_bytes."""
    columns = ["session_id", "event", "started_at", "cwd", "transcript_path", "skip_reason", "settings", "snapshot"]

    def put(files, path: str, pieces: Iterator[bytes]) -> None:
        files.create_dir(posixpath.dirname(path), recursive=True)
        part = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}")
        with files.open_output_stream(part) as out:
            for piece in pieces:
                out.write(piece)
        files.move(part, path)

    def copy(files, target: str, source: str) -> None:
        there, path = file_system(source)
        if there.get_file_info(path).is_file:
            with there.open_input_stream(path) as read:
                put(files, target, iter(lambda: read.read(most_bytes), b""))

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if not _NAME.fullmatch(row["session_id"]):
                    continue
                base = posixpath.join(root, "sessions", row["session_id"])
                if row["event"] == "SessionStart":
                    known = {c: row[c] for c in ("session_id", "started_at", "cwd", "transcript_path", "skip_reason")} | json.loads(row["settings"] or "{}")
                    put(files, posixpath.join(base, "resolved.json"), iter([json.dumps(known, ensure_ascii=False, indent=2).encode()]))
                elif row["event"] == "PreCompact" and row["transcript_path"]:
                    copy(files, posixpath.join(base, "snapshots", row["snapshot"]), row["transcript_path"])
                elif row["event"] in ENDS and files.get_file_info(base).type.name == "Directory":
                    files.delete_dir(base)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["rows"])

    nth = F.array_position(F.array(*map(F.lit, [*LIFECYCLE, *ENDS[1:]])), F.col("event"))
    rows = lives.withColumn("nth", nth).repartition("session_id").sortWithinPartitions("session_id", "at", "nth", "snapshot")
    rows.select(*[F.col(c).cast("string") for c in columns]).mapInArrow(act, "rows bigint").write.format("noop").mode("overwrite").save()
