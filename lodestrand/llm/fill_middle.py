"""Fill-in-the-middle rewriting over run-length character classes.

A text is kept as its maximal runs of characters of one class and one UTF-8 width, each with the units and characters that end by
it, cumulated. A cut after k units lies in the first run whose cumulative units reach k; a binary search finds that run, and since all
its characters are equally wide, the cut's byte and character offsets follow by arithmetic. Texts are cut as the UTF-8 bytes that
Arrow holds, so nothing is decoded, and a text costs a pass over its bytes however many cuts are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, text_or_empty, tidy

UNITS = ("word", "line", "char")


@dataclass(frozen=True)
class Runs:
    """Maximal runs of a text: the byte where each ends, its characters' width, and units and characters up to its end."""

    ends: np.ndarray
    width: np.ndarray
    units: np.ndarray
    chars: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, character) behind the first k units."""
        if k <= 0:
            return 0, 0
        r = int(np.searchsorted(self.units, k))
        back = int(self.units[r]) - k  # units of the run that lie behind the cut; only runs whose characters are units have any
        return int(self.ends[r]) - back * int(self.width[r]), int(self.chars[r]) - back


def encode_runs(utf8: np.ndarray, unit: str = "word") -> Runs:
    """Runs of a text's bytes. Units by `unit`: word, ASCII white space and the other characters behind it (white space at the end is a
    unit of its own); line, what a line feed ends, or the end of the text; char, each character."""
    lead = np.flatnonzero((utf8 & 0xC0) != 0x80)
    if not len(lead):
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none)
    first = utf8[lead]
    width = 1 + (first >= 0xC0).astype(np.int8) + (first >= 0xE0) + (first >= 0xF0)
    if unit == "word":
        mark = (first == 32) | ((first >= 9) & (first <= 13))
    elif unit == "line":
        mark = first == 10
    elif unit == "char":
        mark = np.zeros(len(first), bool)
    else:
        raise ValueError(f"unit must be one of {UNITS}, not {unit!r}")
    start = np.concatenate(([0], 1 + np.flatnonzero((mark[1:] != mark[:-1]) | (width[1:] != width[:-1]))))
    chars = np.concatenate((start[1:], [len(lead)]))
    marked, last = mark[start], np.arange(len(start)) == len(start) - 1
    if unit == "word":
        gain = last | ~marked & np.concatenate((marked[1:], [False]))
    elif unit == "line":
        gain = np.where(marked, chars - start, last)
    else:
        gain = chars - start
    return Runs(np.concatenate((lead[start[1:]], [len(utf8)])), width[start].astype(np.int64), np.cumsum(gain), chars)


def _draws(seed: str, key: Column) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of `<seed>:<key>` as numbers; a null key is spelled empty."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, rate: int = 50, spm_rate: int = 80, unit: str = "word", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), seed: str = "42", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n (units), form, prefix_chars, middle_chars, output.

    Of texts, `rate` in a hundred are rewritten, of these `spm_rate` in a hundred as spm: suffix, prefix, middle, each behind its mark; the others
    as psm: prefix, suffix, middle. Draws hang on seed and id only, so equal ids are dealt with alike. Cuts fall between units; parts may
    be empty. Plain, with the text as output and null counts, are empty and null texts, those that hold a mark, and those not drawn. A null
    id draws as an empty one. Repeated rows give a row each; other columns are left out; an empty table gives an empty result.
    """
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)
    held = "|".join(re.escape(m) for m in marks)
    mark = re.compile(held.encode())
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    )

    def rewrite(utf8: memoryview, runs: Runs, draws: list[int]) -> tuple[str, int | None, int | None, bytes]:
        h1, h2, h3, h4 = draws
        if not len(utf8) or h3 % 100 >= rate or mark.search(utf8):
            return "plain", None, None, bytes(utf8)
        a, b = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
        (start, before), (end, through) = runs.cut(a), runs.cut(b)
        prefix, middle, suffix = utf8[:start], utf8[start:end], utf8[end:]
        if h4 % 100 < spm_rate:
            return "spm", before, through - before, b"".join((suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))
        return "psm", before, through - before, b"".join((prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, *draws in zip(batch.column(1), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                utf8 = memoryview(text.as_buffer())
                runs = encode_runs(np.frombuffer(utf8, np.uint8), unit)
                rows.append((runs.n, *rewrite(utf8, runs, draws)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), pa.array(columns[4], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
        tidy()

    key = F.col(id_col)
    asked = docs.select(key.alias("id"), text_or_empty(F.col(text_col).cast("string")).alias("text"), *[d.alias(f"h{i}") for i, d in enumerate(_draws(seed, key))])
    return asked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restore(output: str = "output", form: str = "form", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that fill_in_middle() made an output from. Rewritten texts hold no mark, so each mark's only place is its own."""
    quoted = [f"\\Q{m}\\E" for m in marks]

    def parts(lead: int, mid: int) -> Column:
        return F.split(F.substring(F.col(output), F.lit(1 + len(marks[lead])), F.length(output)), f"{quoted[mid]}|{quoted[2]}")

    psm, spm = parts(0, 1), parts(1, 0)
    return F.when(F.col(form) == "psm", F.concat(psm[0], psm[2], psm[1])).when(F.col(form) == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(F.col(output))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fill_in_middle over all documents, with digests of its output and of the text rebuilt from it; nulls, repeats, empty tables and
    extra columns as there."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"))


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
