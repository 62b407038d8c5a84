"""Stored queries in workbooks and report files: the section document inside, read only."""

from __future__ import annotations

import base64
import io
import re
import struct
import textwrap
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from mlode.plans.errors import EvalError

MOST_BYTES = 10 << 20


def _package_of(blob: bytes) -> bytes:
    """The inner zip of a mashup blob: version (4 bytes), length (4 bytes), zip."""
    if len(blob) < 8:
        raise EvalError("the stored query is too short")
    version, size = struct.unpack_from("<II", blob)
    if version != 0 or 8 + size > len(blob):
        raise EvalError("the stored query has an unknown form")
    return blob[8 : 8 + size]


def _section_of(package: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(package)) as inner:
        name = next((n for n in inner.namelist() if n.endswith("Section1.m")), None)
        if name is None:
            raise EvalError("no section document is stored")
        if inner.getinfo(name).file_size > MOST_BYTES:
            raise EvalError("the section document is too large")
        return inner.read(name).decode("utf-8-sig")


def read_section(path: str) -> str:
    """The section document of an .xlsx, .pbix or .pbit file."""
    with zipfile.ZipFile(path) as outer:
        names = outer.namelist()
        if "DataMashup" in names:
            return _section_of(_package_of(outer.read("DataMashup")))
        for name in names:
            if re.fullmatch(r"customXml/item\d+\.xml", name):
                raw = outer.read(name)
                root = ElementTree.fromstring(raw)
                if root.tag.endswith("DataMashup") and root.text:
                    return _section_of(_package_of(base64.b64decode(root.text)))
    raise EvalError(f"{path} stores no queries")


#: A step's source in a model definition: the expression between triple backticks.
_FENCED = re.compile(r"source\s*=\s*```[^\S\n]*\n(.*?)\n?[^\S\n]*```", re.S)


def read_project(path: str) -> dict[str, str]:
    """File (relative, by name order) -> query of a .pbip project or its folder: query files, and model definitions with exactly one fenced source."""
    root = Path(path) if Path(path).is_dir() else Path(path).parent
    found: dict[str, str] = {}
    for file in sorted(root.rglob("*")):
        if file.suffix.lower() not in (".pq", ".tmdl") or not file.is_file() or file.stat().st_size > MOST_BYTES:
            continue
        try:
            text = file.read_text("utf-8-sig")
        except (OSError, UnicodeDecodeError):
            continue
        sources = [text] if file.suffix.lower() == ".pq" else [textwrap.dedent(x) for x in _FENCED.findall(text)]
        if len(sources) == 1:
            found[str(file.relative_to(root))] = sources[0]
    if not found:
        raise EvalError(f"{path} stores no queries")
    return found
