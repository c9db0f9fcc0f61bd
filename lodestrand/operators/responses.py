"""A store of what a text model answered, filled once for each request.

Answers are kept by request id, one small file each, renamed into place as soon as the answer is there; so whatever breaks off, a
task, a job or the driver, an answer that was paid for is found again, by a second attempt of the task as by the next run. Failures aren't
kept: the next run asks again. compact() moves the files into a table; readers and fills see both.

One fill at a time: two would ask twice. Speculative execution would, too, so fill() refuses to run with it.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.sources.text_files import file_system

ANSWERS = "request_id string, text string, input_tokens bigint, output_tokens bigint"
FILLED = f"{ANSWERS}, error string, tries int"
COLUMNS = ["request_id", "text", "input_tokens", "output_tokens"]


class ResponseStore:
    """Answers below a folder that all executors share and pyarrow can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, name: str) -> bool:
        files, root = file_system(self.root)
        return files.get_file_info(posixpath.join(root, name)).type.name == "Directory"

    def answers(self) -> DataFrame:
        """All answers, one row each."""
        none = self.spark.createDataFrame([], ANSWERS)
        new = self.spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.root}/new") if self._there("new") else none
        old = self.spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(f"{self.root}/table") if self._there("table") else none
        return new.unionByName(old).groupBy("request_id").agg(F.max(F.struct(*COLUMNS[1:])).alias("a")).select("request_id", "a.*")

    def fill(self, requests: DataFrame, provider: Callable[[str, str], str | dict], tries: int = 3, pause: float = 1.0, per_second: float | None = None) -> DataFrame:
        """FILLED for each distinct request of requests(request_id, system, user, ...): stored answers, and new ones by provider(system, user), which
        gives a text or a mapping with text, input_tokens and output_tokens. What raises is tried again, `tries` times at most, after a pause that
        doubles; the last error is then the row's. per_second bounds the calls of an executor. A request asked for twice is one.
        """
        if self.spark.conf.get("spark.speculation", "false") == "true":
            raise ValueError("a speculative task would ask a second time")
        conf = self.spark.sparkContext.getConf()
        slots = max(1, int(conf.get("spark.executor.cores", str(self.spark.sparkContext.defaultParallelism))) // int(conf.get("spark.task.cpus", "1")))
        every, root = (slots / per_second if per_second else 0.0), self.root

        def ask(system: str, user: str) -> tuple[dict | None, str | None, int]:
            error, wait = None, pause
            for n in range(1, tries + 1):
                begun = time.monotonic()
                try:
                    said = provider(system, user)
                    return (said if isinstance(said, dict) else {"text": said}), None, n
                except Exception as e:  # noqa: BLE001  one failed request mustn't fail the others
                    error = str(e)
                finally:
                    time.sleep(max(0.0, every - (time.monotonic() - begun)))
                if n < tries:
                    time.sleep(wait)
                    wait *= 2
            return None, error, tries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = file_system(root)
            for batch in batches:
                rows = []
                for key, system, user in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    folder = posixpath.join(base, "new", key[:2])
                    path = posixpath.join(folder, f"{key}.json")
                    if files.get_file_info(path).is_file:  # an attempt before this one got it
                        with files.open_input_file(path) as f:
                            kept, error, n = json.loads(f.read()), None, 0
                    else:
                        got, error, n = ask(system, user)
                        kept = None if got is None else {"request_id": key, **{c: got.get(c) for c in COLUMNS[1:]}}
                        if kept is not None:
                            files.create_dir(folder, recursive=True)
                            part = posixpath.join(folder, f".{uuid.uuid4().hex}")
                            with files.open_output_stream(part) as f:
                                f.write(json.dumps(kept, ensure_ascii=False).encode())
                            files.move(part, path)
                    rows.append((key, *((kept or {}).get(c) for c in COLUMNS[1:]), error, n))
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*COLUMNS, "error", "tries"])

        asked = requests.groupBy("request_id").agg(F.first(F.struct("system", "user")).alias("r")).select("request_id", "r.system", "r.user")
        stored = self.answers()
        known = asked.select("request_id").join(stored, "request_id").withColumns({"error": F.lit(None).cast("string"), "tries": F.lit(0)})
        wanting = asked.join(stored.select("request_id"), "request_id", "left_anti")
        return known.unionByName(wanting.mapInArrow(run, FILLED))

    def complete(self, requests: DataFrame, provider: Callable[[str, str], str | dict], **options) -> DataFrame:
        """fill(), run to its end once, and then read from the store: what is worked on the result asks nothing again. (request_id, text, input_tokens,
        output_tokens); requests that failed are not in it."""
        self.fill(requests, provider, **options).write.format("noop").mode("overwrite").save()
        return requests.select("request_id").distinct().join(self.answers(), "request_id")

    def compact(self) -> None:
        """Moves single answers into the table. A run that breaks off leaves some in both, which is one answer to a reader."""
        if not self._there("new"):
            return
        files, base = file_system(self.root)
        self.spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.root}/new").write.parquet(f"{self.root}/table/{uuid.uuid4().hex}")
        files.delete_dir(posixpath.join(base, "new"))
