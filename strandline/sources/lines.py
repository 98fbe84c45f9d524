"""Pileup text with damaged lines: typed records and located syntax errors.

A recursive-descent parser reads every record field by field.  On an error it notes where
and why.  A quote that is not closed swallows what follows, line ends included, until the
parser finds a validated anchor: a line start at which a record begins, with a chrom of
the catalogue, a start, and an end one behind it and not beyond the chrom.  There it
resumes; the lines between are reported as ``inside a broken quote``.  Every valid record
is an anchor, so a broken quote costs no valid record.  After other errors the parser
resumes at the next line.

Grammar, one record::

    record    = field(chrom) tab field(start) tab ... field(color) tab tail [tab] [cr]
    tail      = 9 fields parted by tabs | 9 fields parted by single spaces   (from field 10 on)
    field     = text | quote text quote          text holds no quote, tab or line end

and then the checks of values (``check``).  Blank lines, comments (``#``) and the header
line are skipped, wherever they are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.schema import BASE_OF_CODE, BEDMETHYL_COLUMNS, COLOR

MAX_LONG = 2**63 - 1
HEADER = "\t".join(BEDMETHYL_COLUMNS)
_NAME = re.compile(r"([^,]*)(?:,([ACGTUNRYSWKMBDHVX]+),([0-9]{1,18}))?\Z")
_PERCENT = re.compile(r"[0-9]+\.[0-9]{2}\Z")
_FIELD, _LOOSE = re.compile(r'"[^"\t\n\r]*"|[^"\t\n\r]*'), re.compile(r'"[^"\t\n\r]*"|[^" \t\n\r]*')
_QUOTE_STOP = re.compile(r'["\t\n\r]')
_TAB_STOP, _ANY_STOP = re.compile(r"[\t\n\r]"), re.compile(r"[ \t\n\r]")
BROKEN_QUOTE, SWALLOWED = "quote not closed", "inside a broken quote"

RECORD_TYPE = ", ".join(
    f"`{c}` " + ("string" if c in ("chrom", "name", "strand", "color") else "double" if c == "percent_modified" else "bigint") for c in BEDMETHYL_COLUMNS
)


class Fault(Exception):
    """reason, offset in the text, field (1 to 18, 0: the record as a whole)"""

    def __init__(self, reason: str, at: int, field: int):
        super().__init__(reason)
        self.reason, self.at, self.field = reason, at, field


class Parser:
    def __init__(self, text: str, contigs: dict[str, int]):
        self.text, self.contigs, self.at = text, contigs, 0

    def items(self) -> Iterator[tuple[int, list | Fault]]:
        """(offset of the start, record or fault) of everything that is not skipped."""
        text, n = self.text, len(self.text)
        swallowing = False
        while self.at < n:
            start = self.at
            end = text.find("\n", start)
            end = n if end < 0 else end
            if self.skipped(start, end):
                self.at = end + 1
                continue
            if swallowing and not self.anchor():
                yield start, Fault(SWALLOWED, start, 0)
                self.at = end + 1
                continue
            self.at, swallowing = start, False
            try:
                yield start, self.record()
            except Fault as fault:
                swallowing = fault.reason == BROKEN_QUOTE
                yield start, fault
            self.at = end + 1

    def skipped(self, start: int, end: int) -> bool:
        first = self.text[start : start + 1]
        if first == "#":
            return True
        if not first.isspace() and not self.text.startswith("chrom", start):
            return False
        line = self.text[start:end]
        return not line.strip() or line.removesuffix("\r") == HEADER

    def anchor(self) -> bool:
        """Whether a record begins here: chrom, start and end are as in a valid one."""
        try:
            chrom, _ = self.read(1, _FIELD, _TAB_STOP, "\t")
            start, _ = self.read(2, _FIELD, _TAB_STOP, "\t")
            end, _ = self.read(3, _FIELD, _TAB_STOP, "\t")
        except Fault:
            return False
        if chrom not in self.contigs or not (start.isascii() and start.isdigit() and end.isascii() and end.isdigit()):
            return False
        return int(start) + 1 == int(end) <= self.contigs[chrom]

    def record(self) -> list:
        return self.check(*self.fields())

    def fields(self) -> tuple[list[str], list[int]]:
        """The 18 fields and where they begin, and the end of the line."""
        fields, places = [], []
        for k in range(1, 10):
            value, at = self.read(k, _FIELD, _TAB_STOP, "\t")
            fields.append(value)
            places.append(at)
        places.append(self.at)
        fields.append(self.field(10, _ANY_STOP))
        mark = self.text[self.at : self.at + 1]
        if mark not in ("\t", " "):
            raise Fault("too few fields", self.at, 10)
        self.at += 1
        form, stops = (_FIELD, _TAB_STOP) if mark == "\t" else (_LOOSE, _ANY_STOP)
        for k in range(11, 18):
            value, at = self.read(k, form, stops, mark)
            fields.append(value)
            places.append(at)
        places.append(self.at)
        fields.append(self.field(18, stops))
        if self.text[self.at : self.at + 1] == "\t":
            self.at += 1
        if self.text[self.at : self.at + 1] == "\r":
            self.at += 1
        if self.at < len(self.text) and self.text[self.at] != "\n":
            raise Fault("too many fields", self.at, 18)
        return fields, places

    def read(self, number: int, form: re.Pattern, stops: re.Pattern, mark: str) -> tuple[str, int]:
        """A field and the separator behind it; the field's value and where it begins."""
        start = self.at
        end = form.match(self.text, start).end()
        if self.text[end : end + 1] != mark:
            # something is wrong: find out what
            self.field(number, stops)
            self.separator(mark, number)
            raise AssertionError("unreachable")
        self.at = end + 1
        return (self.text[start + 1 : end - 1] if self.text[start] == '"' else self.text[start:end]), start

    def field(self, number: int, stops: re.Pattern) -> str:
        text, start = self.text, self.at
        if text.startswith('"', start):
            m = _QUOTE_STOP.search(text, start + 1)
            if not m or m[0] != '"':
                raise Fault(BROKEN_QUOTE, start, number)
            self.at = m.end()
            if self.at < len(text) and not stops.match(text, self.at):
                raise Fault("text after a closing quote", self.at, number)
            return text[start + 1 : m.start()]
        m = stops.search(text, start)
        stop = m.start() if m else len(text)
        inner = text.find('"', start, stop)
        if inner >= 0:
            raise Fault("quote inside a field", inner, number)
        self.at = stop
        return text[start:stop]

    def separator(self, mark: str, number: int) -> None:
        found = self.text[self.at : self.at + 1]
        if found == mark:
            self.at += 1
        elif found in ("", "\n", "\r"):
            raise Fault("too few fields", self.at, number)
        else:
            raise Fault("wrong separator", self.at, number)

    def check(self, f: list[str], places: list[int]) -> list:
        def place(k: int) -> int:
            return places[k]

        def number(k: int) -> int:
            s = f[k]
            if not (s.isascii() and s.isdigit()):
                raise Fault("empty value" if not s else "not a number", place(k), k + 1)
            if len(s) > 18 and int(s) > MAX_LONG:
                raise Fault("number too large", place(k), k + 1)
            return int(s)

        def demand(ok: bool, reason: str, k: int) -> None:
            if not ok:
                raise Fault(reason, place(k), k + 1)

        demand(f[0] in self.contigs, "unknown chrom", 0)
        start, end = number(1), number(2)
        demand(end == start + 1, "chromEnd is not chromStart + 1", 2)
        demand(end <= self.contigs[f[0]], "beyond the end of chrom", 2)
        name = _NAME.match(f[3])
        demand(bool(name) and name[1] in BASE_OF_CODE, "unknown modification code", 3)
        score = number(4)
        demand(f[5] in ("+", "-", "."), "invalid strand", 5)
        demand(number(6) == start, "thickStart differs", 6)
        demand(number(7) == end, "thickEnd differs", 7)
        demand(f[8] == COLOR, "invalid color", 8)
        coverage = number(9)
        counts = [number(k) for k in range(11, 18)]
        demand(coverage >= 1, "no coverage", 9)
        demand(score == coverage, "score differs from valid_coverage", 4)
        demand(coverage == sum(counts[:3]), "valid_coverage is not the sum of its counts", 9)
        demand(bool(_PERCENT.match(f[10])) and f[10].isascii(), "percent_modified is not written with two decimals", 10)
        # |percent - 100 modified / coverage| <= 0.011, in whole numbers
        cents = int(f[10].replace(".", ""))
        demand(10 * abs(cents * coverage - 10000 * counts[0]) <= 11 * coverage, "percent_modified differs from its counts", 10)
        return [f[0], start, end, f[3], score, f[5], start, end, f[8], coverage, float(f[10]), *counts]


def parse(text: str, contigs: dict[str, int]) -> tuple[list[list], list[tuple[int, int, str, int]]]:
    """Records, and errors (line from 1, column from 1, reason, field), of a text of any number of lines."""
    records, errors = [], []
    for start, item in Parser(text, contigs).items():
        if isinstance(item, Fault):
            errors.append((text.count("\n", 0, start) + 1, item.at - start + 1, item.reason, item.field))
        else:
            records.append(item)
    return records, errors


#: Lines of a file that are parsed as one text.
BLOCK_LINES = 4096


def parse_lines(
    lines: DataFrame, contigs: DataFrame, keep: list[str], line: str = "line", file: str | None = None, number: str | None = None, block: int = BLOCK_LINES, only_errors: bool = False
) -> DataFrame:
    """The columns ``keep`` of each input row with, for every record or error in it,
    ``record`` (its 18 columns, null for an error), ``reason``, ``error_field`` and
    ``error_column`` (null for a record).  Rows that are skipped give nothing.

    With ``file`` and ``number`` (columns that place a line in a file) the lines of a file
    are parsed in order, as texts of at most ``block`` lines, which is as far as a broken
    quote reaches; this shuffles the lines once, by file and block, so a large file is
    spread.  Without them, or where they are null, each row is a text of its own.
    ``only_errors`` leaves the records out where they are made.

    A null line is an error (``null line``) and ends a text; an empty one is blank; a row
    that holds several lines gives a row for each; repeated lines are parsed alike; lines
    of one number come in the order of their text; columns of the input that clash with
    the new ones must not be in ``keep``.  ``contigs`` is a catalogue of reference
    sequences and is sent to the tasks."""
    sizes = {r["chrom"]: r["size"] for r in contigs.where("chrom is not null and size is not null").select("chrom", "size").collect()}
    shared = lines.sparkSession.sparkContext.broadcast(sizes)
    names = [*keep, *([] if only_errors else BEDMETHYL_COLUMNS), "reason", "error_field", "error_column"]
    own = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in keep)
    schema = ", ".join(x for x in (own, *([] if only_errors else [RECORD_TYPE]), "reason string, error_field int, error_column int") if x)
    blank = () if only_errors else (None,) * len(BEDMETHYL_COLUMNS)

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str | None], list[tuple]]]:
        """Runs of rows that are one text: of one file and block, without null lines."""
        last, run, values = None, [], []
        for frame in frames:
            kept = list(zip(*[frame[c].tolist() for c in keep])) if keep else [()] * len(frame)
            for text, key, v in zip(frame["_line"].tolist(), frame["_text"].tolist(), kept):
                if run and (key is None or key != last or text is None or run[-1] is None):
                    yield run, values
                    run, values = [], []
                last = key
                run.append(text)
                values.append(v)
        if run:
            yield run, values

    def rows_of(run: list[str | None], values: list[tuple]) -> Iterator[tuple]:
        if run[0] is None:
            yield (*values[0], *blank, "null line", 0, 1)
            return
        starts = list(itertools.accumulate((len(t) + 1 for t in run), initial=0))
        row = 0
        for start, item in Parser("\n".join(run), shared.value).items():
            while starts[row + 1] <= start:
                row += 1
            if isinstance(item, Fault):
                yield (*values[row], *blank, item.reason, item.field, item.at - start + 1)
            elif not only_errors:
                yield (*values[row], *item, None, None, None)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run, values in texts(frames):
            out = pd.DataFrame(list(rows_of(run, values)), columns=names)
            for c in BEDMETHYL_COLUMNS if not only_errors else ():
                if c not in ("chrom", "name", "strand", "color", "percent_modified"):
                    out[c] = out[c].astype("Int64")
            for c in ("error_field", "error_column"):
                out[c] = out[c].astype("Int32")
            if len(out):
                yield out

    if file and number:
        key = F.concat_ws("/", F.expr(f"`{number}` div {block}").cast("string"), F.col(file).cast("string"))
        key = F.when(F.col(file).isNotNull() & F.col(number).isNotNull(), key)
        rows = lines.select(*keep, F.col(line).alias("_line"), key.alias("_text"), F.col(number).alias("_number"))
        # rows without a place are spread by their text: each is a text of its own
        rows = rows.withColumn("_spread", F.when(F.col("_text").isNull(), F.xxhash64("_line")).otherwise(F.xxhash64("_text"))).repartition("_spread").sortWithinPartitions("_text", "_number", "_line").drop("_number", "_spread")
    else:
        rows = lines.select(*keep, F.col(line).alias("_line"), F.lit(None).cast("string").alias("_text"))
    return rows.mapInPandas(apply, schema)


def records(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason", "error_field", "error_column")


def errors(parsed: DataFrame, keep: list[str]) -> DataFrame:
    return parsed.where("reason is not null").select(*keep, "reason", "error_field", "error_column")
