"""Files, delimited text, JSON and binaries."""

from __future__ import annotations

import base64
import binascii
import gzip
import json
import re
import zlib
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlode.functions.kit import Kit
from mlode.operators.positional import ORDINAL
from mlode.plans import values as V
from mlode.plans.errors import EvalError
from mlode.plans.values import BINARY, JSON, NUMBER, TEXT, Col, Enum, Rec, Table, as_col
from mlode.sources.literal import from_rows

#: fixed values: code pages
CODE_PAGES = {1200: "utf-16-le", 1201: "utf-16-be", 1252: "cp1252", 10000: "mac_roman", 20127: "ascii", 28591: "latin-1", 65000: "utf-7", 65001: "utf-8"}
SPARK_NAMES = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "ascii": "US-ASCII", "latin-1": "ISO-8859-1", "utf-8": "UTF-8"}
ONE_BYTE = ("cp1252", "mac_roman")
CORRUPT = V.HIDDEN + "bad"


@dataclass
class FileRef:
    """A file that a reader takes: its bytes are read by Spark, not here."""

    path: str


def register(kit: Kit) -> None:
    ev, fn = kit.ev, kit.fn
    for n in ("Base64", "Hex"):
        kit.enum(f"BinaryEncoding.{n}")
    for n in ("None", "Deflate", "GZip"):
        kit.enum(f"Compression.{n}")

    def contents(path: Any, options: Any = None) -> FileRef:
        if options is not None:
            kit.refuse("options of File.Contents")
        path = ev.text(path, "path")
        if ev.ctx.base and not re.match(r"^([a-z][a-z0-9+.-]*:|/)", path):
            path = f"{ev.ctx.base.rstrip('/')}/{path}"
        return FileRef(path)

    fn("File.Contents", 1, 2, contents)

    def raw_bytes(ref: FileRef) -> bytes:
        try:
            row = ev.ctx.spark.read.format("binaryFile").load(ref.path).select("content").first()
        except Exception as e:
            raise EvalError(f"{ref.path} can't be read; bind the step to a table: {e}") from e
        if row is None:
            raise EvalError(f"{ref.path} doesn't exist; bind the step to a table")
        return bytes(row[0])

    def encoding_of(v: Any, name: str) -> str:
        v = ev.const(v, f"encoding of {name}")
        if v is None:
            return "utf-8"
        if v not in CODE_PAGES:
            kit.refuse(f"code page {v} of {name}")
        return CODE_PAGES[v]

    def decoded(raw: bytes, encoding: str, name: str) -> str:
        for bom, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if raw.startswith(bom) and encoding in (codec, "utf-8"):
                raw, encoding = raw[len(bom) :], codec
                break
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError as e:
            raise EvalError(f"{name}: {e}") from e

    def from_binary(v: Any, page: Any = None) -> Any:
        encoding = encoding_of(page, "Text.FromBinary")
        if v is None:
            return None
        if isinstance(v, FileRef):
            v = raw_bytes(v)
        if isinstance(v, bytes):
            return decoded(v, encoding, "Text.FromBinary")
        c = as_col(v)
        if c.kind.name not in ("binary", "any"):
            raise EvalError("Text.FromBinary needs a binary")
        if encoding in SPARK_NAMES:
            return Col(F.regexp_replace(F.decode(c.c, SPARK_NAMES[encoding]), "^\\x{FEFF}", ""), TEXT, c.free)

        @F.pandas_udf("string")
        def decode(column: pd.Series) -> pd.Series:
            return column.map(lambda b: None if b is None else bytes(b).decode(encoding))

        return Col(decode(c.c), TEXT, False)

    fn("Text.FromBinary", 1, 2, from_binary)

    def binary_encoding(v: Any) -> str:
        if v is None:
            return "Base64"
        if not isinstance(v, Enum) or not v.name.startswith("BinaryEncoding."):
            raise EvalError("a binary encoding is expected")
        return v.name.removeprefix("BinaryEncoding.")

    def from_text(v: Any, encoding: Any = None) -> Any:
        e = binary_encoding(encoding)
        if v is None:
            return None
        if isinstance(v, str):
            try:
                return base64.b64decode(v, validate=True) if e == "Base64" else bytes.fromhex(v)
            except (ValueError, binascii.Error) as x:
                raise EvalError(f"Binary.FromText: {x}") from x
        c = as_col(v)
        if c.kind.name not in ("text", "any"):
            raise EvalError("Binary.FromText needs a text")
        return Col(F.unbase64(c.c) if e == "Base64" else F.unhex(c.c), BINARY, c.free)

    def to_text(v: Any, encoding: Any = None) -> Any:
        e = binary_encoding(encoding)
        if v is None:
            return None
        if isinstance(v, FileRef):
            v = raw_bytes(v)
        c = as_col(v)
        if c.kind.name not in ("binary", "any"):
            raise EvalError("Binary.ToText needs a binary")
        return Col(F.regexp_replace(F.base64(c.c), "[\r\n]", "") if e == "Base64" else F.hex(c.c), TEXT, c.free)

    fn("Binary.FromText", 1, 2, from_text)
    fn("Binary.ToText", 1, 2, to_text)

    def inflate(raw: bytes, how: str) -> bytes:
        try:
            return raw if how == "None" else zlib.decompress(raw, -15) if how == "Deflate" else gzip.decompress(raw)
        except (zlib.error, OSError, EOFError) as e:
            raise EvalError(f"Binary.Decompress: {e}") from e

    def decompress(v: Any, kind: Any) -> Any:
        if not isinstance(kind, Enum) or not kind.name.startswith("Compression."):
            raise EvalError("a compression is expected")
        how = kind.name.removeprefix("Compression.")
        if v is None:
            return None
        if isinstance(v, FileRef):
            v = raw_bytes(v)
        if isinstance(v, bytes):
            return inflate(v, how)
        c = as_col(v)
        if how == "None":
            return c

        @F.pandas_udf("binary")
        def opened(column: pd.Series) -> pd.Series:
            one = (lambda b: zlib.decompress(b, -15)) if how == "Deflate" else gzip.decompress
            return column.map(lambda b: None if b is None else one(bytes(b)))

        return Col(opened(c.c), BINARY, False)

    fn("Binary.Decompress", 2, 2, decompress)

    def length(v: Any) -> Any:
        if v is None:
            return None
        if isinstance(v, FileRef):
            v = raw_bytes(v)
        if isinstance(v, bytes):
            return len(v)
        c = as_col(v)
        if c.kind.name not in ("binary", "any"):
            raise EvalError("Binary.Length needs a binary")
        return Col(F.octet_length(c.c).cast("long"), NUMBER, c.free, True)

    fn("Binary.Length", 1, 1, length)

    def literal(v: Any) -> bytes:
        v = ev.const(v)
        if isinstance(v, bytes):
            return v
        if isinstance(v, str):
            return from_text(v)
        if isinstance(v, list) and all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 256 for x in v):
            return bytes(v)
        raise EvalError("#binary needs bytes, a base64 text or a binary")

    fn("#binary", 1, 1, literal)

    # -- JSON
    def jsoned(v: Any) -> Any:
        if isinstance(v, dict):
            return Rec((k, jsoned(x)) for k, x in v.items())
        return [jsoned(x) for x in v] if isinstance(v, list) else v

    def document(v: Any, page: Any = None) -> Any:
        encoding = encoding_of(page, "Json.Document")
        if isinstance(v, FileRef):
            v = raw_bytes(v)
        if isinstance(v, bytes):
            v = decoded(v, encoding, "Json.Document")
        if isinstance(v, str):
            try:
                return jsoned(json.loads(v))
            except ValueError as e:
                raise EvalError(f"Json.Document: {e}") from e
        c = as_col(v)
        if c.kind.name not in ("text", "any"):
            raise EvalError("Json.Document needs a text")
        if ev.ctx.failures is None:
            return Col(F.parse_json(c.c.cast("string")), JSON, c.free)
        made = F.try_parse_json(c.c.cast("string"))
        ev.ctx.failures.append(made.isNull() & c.c.isNotNull())
        return Col(made, JSON, c.free)

    fn("Json.Document", 1, 2, document)

    # -- delimited text
    def names_of(columns: Any, width: int) -> list[str]:
        if isinstance(columns, V.TypeValue):
            if not columns.fields:
                kit.refuse("a Columns type without fields")
            return columns.fields
        columns = ev.const(columns, "columns")
        if columns is None:
            return [f"Column{k + 1}" for k in range(width)]
        if isinstance(columns, int) and not isinstance(columns, bool):
            if columns < 0:
                raise EvalError("Csv.Document: a negative number of columns")
            return [f"Column{k + 1}" for k in range(columns)]
        if isinstance(columns, list) and all(isinstance(x, str) for x in columns):
            return columns
        raise EvalError("Csv.Document: columns must be a list, a number or a type")

    def csv(source: Any, columns: Any = None, delimiter: Any = None, extra: Any = None, page: Any = None) -> Table:
        newlines = True
        if isinstance(columns, Rec):
            if any(x is not None for x in (delimiter, extra, page)):
                raise EvalError("Csv.Document: options go in the record or as arguments, not both")
            o = columns
            if set(o) - {"Columns", "Delimiter", "ExtraValues", "Encoding", "QuoteStyle", "CsvStyle"}:
                kit.refuse(f"options {sorted(set(o) - {'Columns', 'Delimiter', 'ExtraValues', 'Encoding', 'QuoteStyle', 'CsvStyle'})} of Csv.Document")
            columns, delimiter, extra, page = o.get("Columns"), o.get("Delimiter"), o.get("ExtraValues"), o.get("Encoding")
            if isinstance(o.get("QuoteStyle"), Enum):
                newlines = o["QuoteStyle"].name == "QuoteStyle.Csv"
        delimiter = ev.const(delimiter, "delimiter")
        if isinstance(delimiter, list):
            if len(set(delimiter)) != 1:
                kit.refuse("several delimiters of Csv.Document")
            delimiter = delimiter[0]
        delimiter = "," if delimiter is None else delimiter
        if not isinstance(delimiter, str):
            raise EvalError("Csv.Document: the delimiter must be a text")
        style = extra.name if isinstance(extra, Enum) else None
        if style == "ExtraValues.List":
            kit.refuse("ExtraValues.List of Csv.Document")
        encoding = encoding_of(page, "Csv.Document")
        if isinstance(source, FileRef) and encoding in SPARK_NAMES:
            return scan(source.path, columns, delimiter, style, SPARK_NAMES[encoding], newlines)
        if isinstance(source, FileRef) and encoding in ONE_BYTE and delimiter.isascii():
            # read byte by byte, then every cell is translated
            return recoded(scan(source.path, columns, delimiter, style, SPARK_NAMES["latin-1"], newlines), encoding)
        if isinstance(source, FileRef):
            source = raw_bytes(source)
        if isinstance(source, bytes):
            source = decoded(source, encoding, "Csv.Document")
        text = ev.text(source, "text")
        rows = [line.split() for line in text.splitlines() if line.split()] if delimiter == "" else cut(text, delimiter, newlines)
        names = names_of(columns, len(rows[0]) if rows else 0)
        if style != "ExtraValues.Ignore" and any(len(r) > len(names) for r in rows):
            raise EvalError("Csv.Document: a row has more values than columns")
        return from_rows(ev, names, [[r[k] if k < len(r) else None for k in range(len(names))] for r in rows])

    def recoded(t: Table, encoding: str) -> Table:
        """Texts that were read as ISO-8859-1, in another code page of one byte a character."""
        known, lost = {}, ""
        for b in range(128, 256):
            try:
                known[chr(b)] = bytes([b]).decode(encoding)
            except UnicodeDecodeError:
                lost += chr(b)
        made = []
        for n in t.cols:
            c = F.translate(V.quoted(n), "".join(known), "".join(known.values()))
            made.append((n, F.when(V.quoted(n).rlike(f"[{lost}]"), F.raise_error(F.lit(f"Csv.Document: a byte that {encoding} lacks")).cast("string")).otherwise(c) if lost else c))
        return t.select(made)

    def cut(text: str, delimiter: str, newlines: bool) -> list[list[str]]:
        """Rows of a small text: a token is a quoted stretch, a delimiter, a line end, or a character."""
        body = '(?:[^"]|"")*' if newlines else '(?:[^"\r\n]|"")*'
        token = re.compile(rf'(?P<q>"{body}(?:"|\Z|(?=[\r\n])))|(?P<d>{re.escape(delimiter)})|(?P<n>\r\n|\r|\n)|(?P<c>.)', re.S)
        rows, row, cell, fresh = [], [], "", True
        for m in token.finditer(text):
            kind = m.lastgroup
            if kind == "q" and fresh:
                inner = m[0][1:]
                cell, fresh = cell + (inner[:-1] if inner.endswith('"') else inner).replace('""', '"'), False
            elif kind == "d":
                row, cell, fresh = [*row, cell], "", True
            elif kind == "n":
                rows.append([*row, cell])
                row, cell, fresh = [], "", True
            else:
                cell, fresh = cell + m[0], False
        if row or cell or not rows:
            rows.append([*row, cell])
        return rows

    def scan(path: str, columns: Any, delimiter: str, style: str | None, encoding: str, newlines: bool) -> Table:
        """A distributed read: every column text, short rows padded with nulls, long rows an error unless ignored."""
        spark = ev.ctx.spark
        if delimiter == "":
            lines = spark.read.option("encoding", encoding).text(path).select(F.split(F.trim(F.col("value"), F.lit(" \t\r\x0b\x0c")), "\\s+").alias("p"), *place())
            lines = lines.filter(F.element_at("p", 1) != "")
            width = lines.select(F.size("p")).first()
            names = names_of(columns, width[0] if width else 0)
            cells = [F.get("p", F.lit(k)) for k in range(len(names))]
            extra = F.size("p") > len(names)
            base = lines
        else:
            reader = spark.read.options(sep=delimiter, quote='"', escape='"', multiLine=str(newlines).lower(), encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
            try:
                width = len(reader.csv(path).columns)
            except Exception as e:
                raise EvalError(f"{path} can't be read; bind the step to a table: {str(e).splitlines()[0]}") from e
            names = names_of(columns, width)
            schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))] + [T.StructField(CORRUPT, T.StringType())])
            base = reader.schema(schema).csv(path).select("*", *place())
            literal_d = "".join("\\x{%X}" % ord(c) for c in delimiter)
            there = F.when(F.col(CORRUPT).isNull(), len(names)).otherwise(F.size(F.split(F.col(CORRUPT), literal_d + '(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)))
            # an empty value is an empty text; only what a short row lacks is null
            cells = [F.coalesce(F.col(f"c{k}"), F.when(there > k, F.lit(""))) for k in range(len(names))]
            extra = there > len(names)
        if style != "ExtraValues.Ignore" and cells:
            cells[0] = F.when(extra, F.raise_error(F.lit("Csv.Document: a row has more values than columns")).cast("string")).otherwise(cells[0])
        df = base.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)], ORDINAL)
        return Table(df, names, [(ORDINAL, True)])

    def place() -> list:
        at = F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
        return [F.struct(at.alias("f"), F.monotonically_increasing_id().alias("r")).alias(ORDINAL)]

    fn("Csv.Document", 1, 5, csv)


def bound(spark: Any, value: Any, ordered: bool) -> Any:
    """A binding: a DataFrame, a path to Parquet, CSV (header, all text) or JSON, rows as dicts, or a value."""
    from mlode.operators.positional import counted_ordinal, file_ordinal

    if isinstance(value, str) and re.search(r"\.(parquet|csv|json|orc)/?$", value):
        kind = re.search(r"\.(\w+)/?$", value)[1]
        if kind == "parquet":
            df = spark.read.parquet(value)
            return file_ordinal(df) if ordered else df
        df = spark.read.csv(value, header=True, multiLine=True, escape='"') if kind == "csv" else spark.read.json(value, multiLine=True) if kind == "json" else spark.read.orc(value)
        return counted_ordinal(df) if ordered else df
    return value

