"""Loading delimited records when some of them don't parse.

A block of records goes through a columnar CSV reader at once; if the reader
fails, the block is split in two and each half tried again, down to few records.
What patterns over whole columns tell (broken quoting before the reading, wrong
values after it) needs no splitting.  Every record that didn't get through is
diagnosed by a strict state machine, with the same rules, so that its neighbours
don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import ship_package

#: Failing blocks are halved down to this many records, which are then diagnosed one by one.
SMALL_BLOCK = 8
#: A whole record made of fields that are either quoted throughout or free of quotes (RE2 syntax).
FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
WELL_QUOTED = rf"\A{FIELD}(?:,{FIELD})*\z"
DIGITS = r"\A[0-9]+\z"
#: What counts as blank, for both engines (white space of Unicode and the separators U+001C to U+001F).
BLANK = r"\A[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*\z"
CONTROL = r"[\x{0}-\x{1f}\x{7f}-\x{9f}\x{fffd}]"
CONTROL_BUT_LF_TAB = r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}\x{fffd}]"


@dataclass(frozen=True)
class FieldRule:
    """A column: its Spark type, a pattern every value must hold and one that no value may (RE2), blanks allowed or not."""

    name: str
    type: str = "string"
    must: str | None = None
    never: str | None = None
    blank_ok: bool = True


@dataclass(frozen=True)
class RecordSpec:
    """The columns of one kind of file."""

    fields: tuple[FieldRule, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def python_pattern(p: str) -> re.Pattern:
    """The same pattern for Python's engine."""
    p = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p)
    return re.compile(p.replace(r"\z", r"\Z"), re.S)


def split_strict(text: str) -> list[str] | None:
    """The fields of one record, or None if its quoting is broken."""
    out, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            j, value = i + 1, []
            while True:
                k = text.find('"', j)
                if k < 0:
                    return None
                value.append(text[j:k])
                if k + 1 < n and text[k + 1] == '"':
                    value.append('"')
                    j = k + 2
                    continue
                i = k + 1
                break
            if i < n and text[i] != ",":
                return None
            out.append("".join(value))
        else:
            k = text.find(",", i)
            k = n if k < 0 else k
            if '"' in text[i:k]:
                return None
            out.append(text[i:k])
            i = k
        if i >= n:
            return out
        i += 1


class BlockParser:
    """Parses lists of records against a spec; ``tries`` counts the blocks attempted."""

    def __init__(self, spec: RecordSpec):
        self.spec, self.tries = spec, 0
        self.checks = [(f, f.must and python_pattern(f.must), f.never and python_pattern(f.never)) for f in spec.fields]
        self.convert = pacsv.ConvertOptions(column_types={n: pa.string() for n in spec.names}, strings_can_be_null=False, null_values=[])
        self.csv = pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False)
        self.types = {f.name: {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}.get(f.type) for f in spec.fields}

    def one(self, f: FieldRule, value: str):
        """A single value in its type; digits beyond the type are null."""
        kind = self.types[f.name]
        if kind is None:
            return value
        if value == "":
            return None
        if kind == pa.float64():
            return float(value)
        n = int(value)
        return n if n < 1 << (kind.bit_width - 1) else None

    def typed(self, f: FieldRule, col: pa.Array) -> pa.Array:
        kind = self.types[f.name]
        if kind is None:
            return col
        return pc.cast(pc.if_else(pc.equal(col, ""), pa.scalar(None, pa.string()), col), kind)

    def read(self, texts: pa.Array) -> pa.Table | None:
        """The columns of well-quoted records as strings, None if the reader doesn't get one row of them from each record."""
        self.tries += 1
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.string())), "\n")
        body = lines[0].as_py().encode() + b"\n"
        try:
            table = pacsv.read_csv(pa.BufferReader(body), pacsv.ReadOptions(column_names=self.spec.names, use_threads=False, block_size=len(body) + 1), self.csv, self.convert)
        except pa.ArrowInvalid:
            return None
        return table if table.num_rows == len(texts) else None

    def wrong_values(self, table: pa.Table) -> pa.Array:
        """For every record, whether a value breaks a rule."""
        wrong = None
        for f in self.spec.fields:
            col = table.column(f.name)
            marks = [pc.invert(pc.match_substring_regex(col, f.must))] if f.must else []
            marks += [pc.match_substring_regex(col, f.never)] if f.never else []
            marks += [pc.match_substring_regex(col, BLANK)] if not f.blank_ok else []
            for m in marks:
                wrong = m if wrong is None else pc.or_(wrong, m)
        wrong = pa.array([False] * table.num_rows) if wrong is None else wrong
        return wrong.combine_chunks() if isinstance(wrong, pa.ChunkedArray) else wrong

    def strict(self, text: str | None) -> tuple[str | None, str, list]:
        """Reason (None: the record is right), what exactly, and the values of one record."""
        if text is None:
            return "columns", "no text", []
        values = split_strict(text)
        if values is None:
            return "quoting", "a quote that isn't closed or stands in the wrong place", []
        if len(values) != len(self.spec.fields):
            return "columns", f"{len(values)} fields", []
        for (f, must, never), v in zip(self.checks, values):
            if (must and not must.search(v)) or (never and never.search(v)) or (not f.blank_ok and _BLANK.search(v)):
                return "value", f"{f.name}: {v[:60]!r}", []
        return None, "", [self.one(f, v) for f, v in zip(self.spec.fields, values)]

    def columns(self, table: pa.Table, right: pa.Array) -> list[pa.Array]:
        """The typed columns of the right records; digits beyond a type are null."""
        out = []
        for f in self.spec.fields:
            col = pc.filter(table.column(f.name), right).combine_chunks()
            col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
            try:
                out.append(self.typed(f, col))
            except pa.ArrowInvalid:
                out.append(pa.array([self.one(f, v) for v in col.to_pylist()], self.types[f.name]))
        return out

    def parse(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[pa.Array] | None, list[tuple] | None]]:
        """(places, columns, None) of right records and (places, None, diagnoses) of those diagnosed singly."""
        quoted = pc.match_substring_regex(texts, WELL_QUOTED)
        lined = pc.match_substring(texts, "\r")  # the reader takes it for a line end
        fit = pc.fill_null(pc.and_not(quoted, lined), False).to_numpy(zero_copy_only=False)
        odd = [np.flatnonzero(~fit)]
        stack = [np.flatnonzero(fit)]
        while stack:
            at = stack.pop()
            if not len(at):
                continue
            table = self.read(texts.take(pa.array(at))) if len(at) > SMALL_BLOCK or not self.tries else None
            if table is not None:
                wrong = self.wrong_values(table).to_numpy(zero_copy_only=False)
                odd.append(at[wrong])
                if not wrong.all():
                    yield at[~wrong], self.columns(table, pa.array(~wrong)), None
            elif len(at) <= SMALL_BLOCK:  # halving on would cost more than looking at each record
                odd.append(at)
            else:
                half = len(at) // 2
                stack += [at[half:], at[:half]]
        single = np.sort(np.concatenate(odd))
        if len(single):
            yield single, None, [self.strict(texts[int(k)].as_py()) for k in single]


_BLANK = python_pattern(BLANK)


def parse_records(df: DataFrame, spec: RecordSpec, text: str, keep: list[str]) -> DataFrame:
    """All records: the ``keep`` columns, the spec's typed columns, ``reason`` and ``detail``.

    ``reason`` is null for right records and else the first of ``quoting``,
    ``columns`` and ``value``; the typed columns are null then.  Blanks belong to
    fields, empty fields of numeric columns are null, digits beyond a column's
    type load as null, a null text has no columns.  Order, copies and other
    columns of ``df`` don't matter; an empty table gives an empty result; names
    in ``keep`` must differ from the spec's.
    """
    ship_package(df.sparkSession)
    clash = {*keep} & {*spec.names, "reason", "detail"}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    source = df.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    fields = [*source.schema.fields[:-1], *(T.StructField(f.name, T._parse_datatype_string(f.type)) for f in spec.fields)]
    schema = T.StructType([*fields, T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType())])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        n_fields = len(spec.fields)

        def out(batch: pa.RecordBatch, rows: np.ndarray, columns: list[pa.Array]) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            whole = [batch.column(i).take(at) for i in range(n_keep)] + columns
            return pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(whole, arrow)], schema=arrow)

        for batch in batches:
            # one batch of right records and one of those diagnosed singly, however many blocks there were
            parser = BlockParser(spec)
            right: list[np.ndarray] = []
            blocks: list[list[pa.Array]] = []
            for at, cols, told in parser.parse(batch.column(n_keep)):
                if cols is not None:
                    right.append(at)
                    blocks.append(cols)
                    continue
                columns = [pa.array([d[2][i] if d[2] else None for d in told], arrow.field(n_keep + i).type) for i in range(n_fields)]
                columns += [pa.array([d[0] for d in told], pa.string()), pa.array([d[1] if d[0] else None for d in told], pa.string())]
                yield out(batch, at, columns)
            if blocks:
                rows = np.concatenate(right)
                columns = [pa.concat_arrays([b[i].cast(arrow.field(n_keep + i).type) for b in blocks]) for i in range(n_fields)]
                yield out(batch, rows, columns + [pa.nulls(len(rows), pa.string())] * 2)

    return source.mapInArrow(run, schema)


def failed_records(df: DataFrame, specs: dict[str, RecordSpec], file: str, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``reason`` and ``detail`` of the records of all files that aren't right, in one pass.

    ``file`` says which of ``specs`` a record must hold; a record of another
    file, or of none, has the reason ``file``.  All else is as for
    ``parse_records``.
    """
    ship_package(df.sparkSession)
    source = df.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{file}`").cast("string").alias("__file"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType())])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            files = np.array(batch.column(n_keep).to_pylist(), object)
            places, told = [np.flatnonzero([f not in specs for f in files])], []
            told += [("file", "no such file")] * len(places[0])
            for name, spec in specs.items():
                own = np.flatnonzero(files == name)
                for at, cols, diagnoses in BlockParser(spec).parse(batch.column(n_keep + 1).take(pa.array(own))) if len(own) else ():
                    if cols is None:
                        bad = [k for k, d in enumerate(diagnoses) if d[0] is not None]
                        places.append(own[at[bad]] if bad else at[:0])
                        told += [diagnoses[k][:2] for k in bad]
            rows = pa.array(np.concatenate(places).astype(np.int64))
            whole = [batch.column(i).take(rows) for i in range(n_keep)] + [pa.array([d[k] for d in told], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(whole, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)
