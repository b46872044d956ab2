"""Arc coverages in exchange text: arcs with the polygons on either side, and attribute tables.

A file is cut into its sections first; each kind of section has its own reader. A coverage is one text whose lines hang on
those before, so that a file is one task's work and many files are many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, batched, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.sources.binary import read

ARC_SCHEMA = "arc_id int, lpoly int, rpoly int, pts array<struct<x:double,y:double>>"
TABLE_SCHEMA = "name string, record int, attributes map<string,string>"

SECTION = re.compile(r"([A-Z]{3})  ([23])\s*")
#: Characters of a coordinate and coordinates on a line by precision (2 single, 3 double). Fixed values of the format.
COORDINATES = {"2": (14, 4), "3": (21, 2)}
#: Characters of an item by its kind and stored bytes; None stands for the bytes themselves. Fixed values of the format.
WIDTHS = {(1, None): 8, (2, None): None, (3, None): None, (4, None): None, (5, 2): 6, (5, 4): 11, (6, 4): 14, (6, 8): 24}
#: Characters of a line in a table's records. Fixed value of the format.
LINE = 80


def sections(content: bytes) -> Iterator[tuple[str, str, list[str]]]:
    """(tag, precision, lines) of each section. An error if the text isn't an exchange file or is a compressed one."""
    lines = content.decode("latin-1").splitlines()
    if not lines or not lines[0].startswith("EXP"):
        raise ValueError("not an exchange file")
    if lines[0][3:8].strip().startswith("1"):
        raise ValueError("a compressed exchange file")
    starts = [i for i, x in enumerate(lines) if SECTION.fullmatch(x)]
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        tag, precision = SECTION.fullmatch(lines[a]).groups()
        yield tag, precision, lines[a + 1 : b]


def cut(text: str, width: int) -> list[str]:
    return ["".join(c) for c in batched(text, width)]


def arcs(precision: str, body: list[str]) -> Iterator[tuple]:
    """Arcs of an ARC section: a line of seven integers, the last of which counts the vertices that follow."""
    width, per_line = COORDINATES[precision]
    rest = iter(body)
    for head in rest:
        _, number, _, _, left, right, vertices = map(int, cut(head, 10)[:7]) if not head.startswith(f"{-1:10d}") else (-1,) * 7
        if vertices < 0:
            return
        written = (x.rstrip() for x in islice(rest, -(-2 * vertices // per_line)))
        numbers = [float(c) for x in written for c in cut(x, width)]
        yield number, left, right, [{"x": x, "y": y} for x, y in batched(numbers, 2, strict=True)]


def tables(body: list[str]) -> Iterator[tuple[str, pd.DataFrame]]:
    """Tables of an IFO section as text columns: a heading, a line for each item, then records wrapped at 80 characters."""
    rest = iter(body)
    for head in rest:
        if head.startswith("EOI"):
            return
        name, items, records = head[:32].strip(), int(head[34:38]), int(head[46:56])
        layout = []
        for line in islice(rest, items):
            size, kind, place = int(line[16:19]), int(line[34:37]) // 10, line[65:69].strip()
            if int(place or -1) >= 0:  # others are views of items that are written already
                width = WIDTHS[kind, size if kind > 4 else None]
                layout.append((line[:16].strip(), size if width is None else width))
        ends = list(accumulate((w for _, w in layout), initial=0))
        each = max(1, -(-ends[-1] // LINE))
        rows = ["".join(x.ljust(LINE) for x in islice(rest, each)) for _ in range(records)]
        text = pd.Series(rows, dtype="str")
        frame = pd.DataFrame({n: text.str.slice(a, a + w).str.strip() for (n, w), a in zip(layout, ends[:-1], strict=True)}, index=text.index)
        yield name, frame


def arc_rows(content: bytes) -> pd.DataFrame:
    rows, found = [], False
    for tag, precision, body in sections(content):
        if tag == "ARC":
            found = True
            rows += arcs(precision, body)
    if not found:
        raise ValueError("no arcs in the exchange file")
    return pd.DataFrame(rows, columns=["arc_id", "lpoly", "rpoly", "pts"])


def table_rows(content: bytes) -> pd.DataFrame:
    found = [t for tag, _, body in sections(content) if tag == "IFO" for t in tables(body)]
    rows = [(name, i, record) for name, frame in found for i, record in enumerate(frame.to_dict("records"), 1)]
    return pd.DataFrame(rows, columns=["name", "record", "attributes"])


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """(path, arc_id, lpoly, rpoly, pts) of exchange files."""
    return read(spark, path, arc_rows, ARC_SCHEMA)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, record, attributes) of all attribute tables; records count from 1 and attributes are trimmed texts."""
    return read(spark, path, table_rows, TABLE_SCHEMA)


def labelled_arcs(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Arcs with the value of an item of the polygon table on their left and right; the outside, polygon 1, has an empty value."""
    polygons = read_tables(spark, path).where(F.upper("name").endswith(".PAT") & (F.col("record") > 1))
    value = polygons.select("path", F.col("record").alias("poly"), F.element_at("attributes", item).alias("value"))
    out = read_arcs(spark, path)
    for side in ("left", "right"):
        out = out.join(value.select("path", F.col("poly").alias(f"{side[0]}poly"), F.col("value").alias(side)), ["path", f"{side[0]}poly"], "left").fillna("", [side])
    return out
