"""String expressions: normal forms, similarities, budgets, blocks and managed regions. All are native column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that outputs must agree on.
SUMMARY_CHARS = 400
FACT_ID_CHARS = 80
USER_CAP, ASSISTANT_CAP, TOOL_INPUT_CAP, TOOL_OUTPUT_CAP = 8192, 16384, 4096, 8192


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_each(s: Column | str) -> Column:
    """Lower case one character at a time: a capital sigma gives the medial form even at a word's end."""
    return F.lower(F.replace(col(s), F.lit("Σ"), F.lit("σ")))


def collapse_whitespace(s: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(s), r"(?U)\s+", " "))


def normalize(s: Column | str) -> Column:
    """Lower case, with runs of hyphens, underscores and white space as one space, trimmed."""
    return F.trim(F.regexp_replace(lower_each(s), r"(?U)[-_\s]+", " "))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance over the longer length, in characters; two empty strings are alike."""
    longer = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(col(a), col(b)) / longer)


def similar_at_least(a: Column | str, b: Column | str, num: int, den: int) -> Column:
    """similarity >= num / den in whole numbers; the edit distance gives up beyond what that allows."""
    longer = F.greatest(F.length(col(a)), F.length(col(b)))
    shorter = F.least(F.length(col(a)), F.length(col(b)))
    allowed = F.floor(longer * (den - num) / F.lit(den)).cast("int")
    # Lengths alone settle most pairs before any distance is computed.
    return (longer == 0) | ((den * shorter >= num * longer) & _within(a, b, allowed))


def _within(a: Column | str, b: Column | str, allowed: Column) -> Column:
    return F.call_function("levenshtein", col(a), col(b), allowed) >= 0


def word_set(s: Column | str) -> Column:
    """ASCII words of three characters and more, lower-cased after the split."""
    return F.array_distinct(F.transform(F.filter(F.split(col(s), "[^A-Za-z0-9_-]+"), lambda w: F.length(w) >= 3), lambda w: F.lower(w)))


def bare_chars(s: Column | str) -> Column:
    """The lower-cased text without white space."""
    return F.regexp_replace(lower_each(F.replace(col(s), F.lit("İ"), F.lit("i"))), r"(?U)\s+", "")


def bigram_set(s: Column | str) -> Column:
    """Neighbouring characters of the lower-cased text without white space."""
    chars = F.split(bare_chars(s), "")
    # The last pair lacks its second character; an empty text has one empty character.
    return F.array_distinct(F.filter(F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda x, y: F.concat(x, y)), lambda g: g.isNotNull()))


def cjk_set(s: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(col(s), ""), lambda c: c.rlike(r"^[\x{4E00}-\x{9FFF}]$")))


def overlap(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Sizes of intersection and union of two sets."""
    both = F.size(F.array_intersect(col(a), col(b)))
    return both, F.size(col(a)) + F.size(col(b)) - both


def jaccard(a: Column | str, b: Column | str) -> Column:
    both, either = overlap(a, b)
    return F.when((F.size(col(a)) == 0) | (F.size(col(b)) == 0), F.lit(0.0)).otherwise(both / either)


def jaccard_at_least(a: Column | str, b: Column | str, num: int, den: int) -> Column:
    both, either = overlap(a, b)
    return (both > 0) & (den * both >= num * either)


def truncate_bytes(s: Column | str, cap: int) -> Column:
    """At most cap bytes, cut at a character, with a note of the original size; texts within the cap are unchanged."""
    raw = F.encode(col(s), "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, cap - k).cast("string")) for k in range(4) if cap - k > 0]
    return F.when(F.octet_length(col(s)) <= cap, col(s)).otherwise(
        F.concat(F.coalesce(*cuts, F.lit("")), F.lit("\n[... truncated, original was "), F.octet_length(col(s)).cast("string"), F.lit(" bytes]"))
    )


def truncate_chars(s: Column | str, most: int = SUMMARY_CHARS) -> Column:
    return F.when(F.length(col(s)) > most, F.concat(F.substring(col(s), 1, max(0, most - 1)), F.lit("…"))).otherwise(col(s))


def fact_id(slug: Column | str, summary: Column | str) -> Column:
    """Eight hexadecimal digits that name a fact of a page."""
    key = F.concat(col(slug), F.lit(":"), collapse_whitespace(F.lower(col(summary))))
    return F.substring(F.sha2(F.substring(key, 1, FACT_ID_CHARS), 256), 1, 8)


def unfence(s: Column | str, *tags: str) -> Column:
    """Content of a code fence, if the text is one with one of the tags or none; else the text, trimmed."""
    bare = F.regexp_replace(col(s), r"(?U)^\s+|\s+$", "")
    names = "|".join(sorted(tags, key=len, reverse=True))
    inner = F.regexp_replace(F.regexp_replace(bare, rf"^```({names})?", ""), r"```\s*$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")).otherwise(bare)


def json_object_in(s: Column | str) -> Column:
    """From the first opening to the last closing brace; null without such."""
    first, last = F.instr(col(s), "{"), F.length(col(s)) - F.instr(F.reverse(col(s)), "}") + 1
    return F.when((first > 0) & (F.instr(col(s), "}") > 0) & (last > first), F.substring(col(s), first, last - first + 1))


def trim_all(s: Column | str) -> Column:
    return F.regexp_replace(col(s), r"(?U)^\s+|\s+$", "")


@dataclass(frozen=True)
class PageFormat:
    """Comment marks of engine-owned parts of a page. mark is the word that pages written before use."""

    mark: str = "engine"

    @property
    def open(self) -> str:
        return f"<!-- {self.mark}:fact id="

    @property
    def close(self) -> str:
        return f"<!-- {self.mark}:end -->"

    @property
    def region(self) -> tuple[str, str]:
        return f"<!-- {self.mark.upper()}-INDEX-START -->", f"<!-- {self.mark.upper()}-INDEX-END -->"

    @property
    def new_index(self) -> str:
        """An index file before its first region is written."""
        start, end = self.region
        return f"# Index\n\n{start}\n{end}\n\n## My notes\n\n<!-- Anything below this line is yours. {self.mark.capitalize()} will not touch it. -->\n"

    @property
    def pattern(self) -> str:
        return rf"(?s)<!-- {self.mark}:fact id=(.*?) -->(.*?)<!-- {self.mark}:end -->"

    def block(self, ident: Column, body: Column) -> Column:
        return F.concat(F.lit(self.open), ident, F.lit(" -->\n"), trim_all(body), F.lit("\n" + self.close))

    def blocks(self, body: Column | str) -> Column:
        """Array of (id, body) of all closed blocks, in order. An unclosed block is dropped, or swallows the next opening."""
        ids = F.regexp_extract_all(col(body), F.lit(self.pattern), 1)
        return F.zip_with(ids, F.regexp_extract_all(col(body), F.lit(self.pattern), 2), lambda i, b: F.struct(i.alias("id"), trim_all(b).alias("body")))

    def summary(self, body: Column | str) -> Column:
        """The first block if it says anything, else the first line that is no heading and no comment, on one line."""
        first = trim_all(F.coalesce(F.regexp_extract(col(body), self.pattern, 2), F.lit("")))
        lines = F.filter(F.transform(F.split(col(body), r"\r?\n"), trim_all), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("<!--"))
        return truncate_chars(collapse_whitespace(F.when(first != "", first).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))))

    def upsert(self, body: Column | str, ident: Column | str, text: Column | str) -> Column:
        """The block of that id replaced where it stands, or a new one appended after a blank line."""
        body, ident = col(body), col(ident)
        opening = F.concat(F.lit(self.open), ident, F.lit(" -->"))
        start = F.position(opening, body)
        rest = F.substring(body, start + F.length(opening), F.length(body))
        stop = F.position(F.lit(self.close), rest)
        new = self.block(ident, col(text))
        after = F.substring(rest, stop + len(self.close), F.length(rest))
        bare = F.regexp_replace(body, r"\n+$", "")
        appended = F.concat(bare, F.when(bare == "", "").otherwise("\n\n"), new, F.lit("\n"))
        return F.when((start > 0) & (stop > 0), F.concat(F.substring(body, F.lit(1), start - 1), new, after)).otherwise(appended)

    def splice_all(self, body: Column | str, ident: Column, text: Column) -> Column:
        """One block in place of all from the first to the last; what lies between goes, what lies around stays."""
        span = rf"(?s)<!-- {self.mark}:fact id=.*? -->.*<!-- {self.mark}:end -->"
        return self._splice(col(body), span, self.block(ident, text))

    def splice_first(self, body: Column | str, ident: Column, text: Column) -> Column:
        return self._splice(col(body), self.pattern, self.block(ident, text))

    def _splice(self, body: Column, pattern: str, new: Column) -> Column:
        found = F.regexp_extract(body, pattern, 0)
        at = F.position(found, body)
        return F.when(found == "", body).otherwise(F.concat(F.substring(body, F.lit(1), at - 1), new, F.substring(body, at + F.length(found), F.length(body))))

    def replace_region(self, existing: Column | str, inside: Column | str) -> Column:
        """New text between the first start mark and the first end mark behind it; else a region at the end."""
        start_mark, end_mark = self.region
        text = col(existing)
        s, e = F.instr(text, start_mark), F.instr(text, end_mark)
        kept = F.concat(F.substring(text, F.lit(1), s + len(start_mark) - 1), col(inside), F.substring(text, e, F.length(text)))
        line = F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
        return F.when((s > 0) & (e > s), kept).otherwise(F.concat(line, F.lit("\n" + start_mark), col(inside), F.lit(end_mark + "\n")))


def insert_under_heading(existing: Column | str, heading: Column | str, entry: Column | str) -> Column:
    """An entry at the end of the section whose heading line begins so; a new section at the end where there is none."""
    text, heading, entry = col(existing), col(heading), col(entry)
    at = F.when(text.startswith(heading), F.lit(1)).otherwise(F.coalesce(F.nullif(F.position(F.concat(F.lit("\n"), heading), text), F.lit(0)) + 1, F.lit(0)))
    behind = at + F.length(heading)
    next_at = F.position(F.lit("\n## "), F.substring(text, behind, F.length(text)))
    stop = F.when(next_at > 0, behind + next_at - 2).otherwise(F.length(text))
    before = F.regexp_replace(F.substring(text, F.lit(1), stop), r"\n+$", "")
    after = F.substring(text, stop + 1, F.length(text))
    inside = F.concat(before, F.lit("\n"), entry, F.lit("\n"), after)
    bare = F.regexp_replace(text, r"\n+$", "")
    return F.when(at > 0, inside).otherwise(F.concat(bare, F.lit("\n\n"), heading, F.lit("\n\n"), entry, F.lit("\n")))
