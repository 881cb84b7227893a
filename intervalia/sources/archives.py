"""Readers for zip archives of sheets and scores, as tables. Standard library only.

Input is what `spark.read.format("binaryFile")` gives (path, content). Files that can't be opened give no
rows in the tables, and one with the reason in `archive_errors`.
"""

from __future__ import annotations

import contextlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how sheets are named in their archive.
SHEET = re.compile(r"sheet#(\d+)/sheet#\1\.xml")


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


class _PlainNames:
    """Builds a tree from expat's events, with local names, and notes prefixes used outside the reach of a declaration.

    Expat is told nothing of name spaces, so that it takes prefixed names as they stand."""

    def __init__(self) -> None:
        self.tree, self.reach, self.lacking = ElementTree.TreeBuilder(), [frozenset(["xml", "xmlns"])], set()
        self.expat = expat.ParserCreate()
        self.expat.StartElementHandler, self.expat.EndElementHandler, self.expat.CharacterDataHandler = self._start, self._end, self.tree.data

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        self.reach.append(self.reach[-1] | {a.removeprefix("xmlns:") for a in attributes if a.startswith("xmlns:")})
        prefixes = {n.split(":", 1)[0] for n in (name, *attributes) if ":" in n}
        self.lacking |= prefixes - self.reach[-1]
        self.tree.start(name.rpartition(":")[2], {a.rpartition(":")[2]: v for a, v in attributes.items() if not a.startswith("xmlns")})

    def _end(self, name: str) -> None:
        self.reach.pop()
        self.tree.end(name.rpartition(":")[2])


def parse_tolerantly(data: bytes) -> tuple[ElementTree.Element | None, list[str]]:
    """The root, with prefixes passed over that are declared nowhere, and those prefixes; (None, []) if it still can't be read."""
    with contextlib.suppress(ElementTree.ParseError):
        return ElementTree.fromstring(data), []
    plain = _PlainNames()
    try:
        plain.expat.Parse(data.decode(errors="replace"), True)
    except expat.ExpatError:
        return None, []
    return (plain.tree.close(), sorted(plain.lacking)) if plain.lacking else (None, [])


def _table(files: DataFrame, schema: str, rows: Callable[[str, zipfile.ZipFile], Iterator[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        made = list(rows(path, z))
                except zipfile.BadZipFile:
                    continue
                if made:
                    yield pd.DataFrame(made, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def archive_errors(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = [p for p, c in zip(b["path"], b["content"], strict=True) if not zipfile.is_zipfile(io.BytesIO(c))]
            yield pd.DataFrame({"path": bad, "reason": ["not_an_archive"] * len(bad)}, dtype=object)

    return files.select("path", "content").mapInPandas(run, "path string, reason string")


def sheets(files: DataFrame) -> DataFrame:
    """path, sheet_no, member of the sheets in each archive."""

    def rows(path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for name in z.namelist():
            if m := SHEET.fullmatch(name):
                yield path, int(m.group(1)), name

    return _table(files, "path string, sheet_no int, member string", rows)


def _sheet_groups(z: zipfile.ZipFile) -> Iterator[tuple[int, int, int, ElementTree.Element]]:
    """Sheet, number of the page group (from 1), index of the system in the sheet (from 0), system."""
    for name in sorted(n for n in z.namelist() if SHEET.fullmatch(n)):
        root, _ = parse_tolerantly(z.read(name))
        index = 0
        for group, page in enumerate(root.iter("page") if root is not None else (), 1):
            for system in page.iter("system"):
                yield int(SHEET.fullmatch(name).group(1)), group, index, system
                index += 1


def _number(x: str | None) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def staves(files: DataFrame) -> DataFrame:
    """A row a staff: its ends, header start, the ids of its bar-lines, and its five lines' mean heights."""

    def rows(path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for sheet, group, index, system in _sheet_groups(z):
            for staff in system.iter("staff"):
                header, bars = staff.find("header"), staff.findtext("barlines") or ""
                heights = []
                for line in staff.iter("line"):
                    ys = [y for p in line.iter("point") if (y := _number(p.get("y"))) is not None]
                    if ys:
                        heights.append(sum(ys) / len(ys))
                yield path, sheet, group, index, staff.get("id"), _number(staff.get("left")), _number(staff.get("right")), _number(header.get("start")) if header is not None else None, bars.split(), heights

    kinds = "path string, sheet_no int, source_group_index int, system_index int, staff_id string, x_left double, x_right double, header_start double, barline_ids array<string>, line_ys array<double>"
    return _table(files, kinds, rows)


def symbols(files: DataFrame) -> DataFrame:
    """A row a symbol of a system: tag, staff, bounds, and the median segment where it has one."""

    def rows(path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for sheet, group, index, system in _sheet_groups(z):
            for inters in system.iter("inters"):
                for el in inters:
                    box = el.find("bounds")
                    ends = [el.find(f"median/{p}") for p in ("p1", "p2")]
                    points = [_number(e.get(c)) if e is not None else None for e in ends for c in ("x", "y")]
                    size = [_number(box.get(c)) if box is not None else None for c in ("x", "y", "w", "h")]
                    yield path, sheet, group, index, el.get("id"), local_name(el.tag), el.get("staff"), *size, *points

    kinds = "path string, sheet_no int, source_group_index int, system_index int, symbol_id string, tag string, staff_id string, x double, y double, w double, h double, x1 double, y1 double, x2 double, y2 double"
    return _table(files, kinds, rows)


def staff_barlines(staff: DataFrame, symbol: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """staff rows with barline_xs: the bar-lines that they name, else those of their system that share most of their height."""
    on = ["path", "sheet_no", "system_index"]
    top, bottom = F.array_min("line_ys"), F.array_max("line_ys")
    x = F.coalesce((F.col("x1") + F.col("x2")) / 2, F.col("x") + F.col("w") / 2)
    bars = symbol.filter("tag = 'barline'").select(*on, "symbol_id", x.alias("_x"), F.coalesce(F.least("y1", "y2"), "y").alias("_t"), F.coalesce(F.greatest("y1", "y2"), F.col("y") + F.col("h")).alias("_b"))
    s = staff.withColumns({"_top": top, "_bottom": bottom, "_row": F.monotonically_increasing_id()})
    both = s.select("_row", *on, "barline_ids", "_top", "_bottom").join(bars, on)
    shares = F.least("_b", "_bottom") - F.greatest("_t", "_top") >= 0.5 * F.least(F.col("_b") - F.col("_t"), F.col("_bottom") - F.col("_top")) - tolerance
    named = F.array_contains("barline_ids", F.col("symbol_id"))
    got = both.withColumns({"_n": named, "_any": F.bool_or(named).over(Window.partitionBy("_row"))}).filter(F.when(F.col("_any"), F.col("_n")).otherwise(shares))
    xs = got.groupBy("_row").agg(F.array_sort(F.collect_list("_x")).alias("barline_xs"), F.when(F.first("_any"), "staff_ids").otherwise("overlap").alias("barline_source"))
    return s.join(xs, "_row", "left").drop("_row", "_top", "_bottom")


def members(files: DataFrame) -> DataFrame:
    """A row an XML member of each archive: its place, root, how many measures it has, and whether it could be read."""

    def rows(path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for i, name in enumerate(n for n in z.namelist() if not n.startswith("META-INF/") and n.lower().endswith((".xml", ".musicxml"))):
            root, repaired = parse_tolerantly(z.read(name))
            count = 0 if root is None else sum(local_name(e.tag) == "measure" for e in root.iter())
            yield path, i, name, "unknown" if root is None else local_name(root.tag), count, root is not None, repaired

    return _table(files, "path string, place int, member string, root string, n_measures int, parsed boolean, repaired_prefixes array<string>", rows)


def chosen_member(members_: DataFrame) -> DataFrame:
    """Per archive the member that is a score, has most measures and can be read (the first of equals)."""
    score = F.col("root").isin("score-partwise", "score-timewise")
    w = Window.partitionBy("path").orderBy(score.desc(), F.col("n_measures").desc(), F.col("parsed").desc(), "place")
    why = F.when(score & (F.col("n_measures") > 0), "score_root_with_measures").when(F.col("n_measures") > 0, "max_measures_non_score_root").when(score, "score_root_no_measures").otherwise("fallback_first")
    return members_.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("path", "member", "root", "n_measures", why.alias("reason"))


def measures(files: DataFrame) -> DataFrame:
    """A row a measure of the first part of each score member: its number and what its print elements begin."""

    def rows(path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for name in z.namelist():
            if name.startswith("META-INF/") or not name.lower().endswith((".xml", ".musicxml")):
                continue
            root, _ = parse_tolerantly(z.read(name))
            part = next((e for e in root.iter() if local_name(e.tag) == "part"), None) if root is not None else None
            for i, m in enumerate(e for e in (part if part is not None else ()) if local_name(e.tag) == "measure"):
                prints = [p for p in m if local_name(p.tag) == "print"]
                says = lambda a, prints=prints: any((p.get(a) or "").strip().lower() in ("yes", "true", "1") for p in prints)
                yield path, name, i, (m.get("number") or "").strip() or str(i + 1), says("new-page"), says("new-system"), any(local_name(e.tag) == "system-layout" for p in prints for e in p)

    return _table(files, "path string, member string, place int, number string, new_page boolean, new_system boolean, system_layout boolean", rows)


def system_starts(measure_rows: DataFrame) -> DataFrame:
    """Per page of a score the numbers that its systems begin with."""
    w = Window.partitionBy("path", "member").orderBy("place")
    first = F.col("place") == 0
    df = measure_rows.withColumn("page_no", F.sum((first | F.col("new_page")).cast("int")).over(w)).filter(first | F.col("new_page") | F.col("new_system") | F.col("system_layout"))
    return df.groupBy("path", "member", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "number"))), lambda x: x["number"]).alias("starts"))


#: Entries of a page manifest; missing fields are null, others are left out.
MANIFEST = "entries array<struct<page_number:int,status:string,error:string,mxl_path:string,parts_count:int,measures_count:int,system_starts:array<string>>>"


def manifest(text_rows: DataFrame, value: str = "value") -> DataFrame:
    """One row a page (the last entry of it) of manifests given as JSON text, a list or an object with entries."""
    wrapped = F.when(F.ltrim(F.col(value)).startswith("["), F.concat(F.lit('{"entries":'), F.col(value), F.lit("}"))).otherwise(F.col(value))
    rows = text_rows.select(F.posexplode(F.from_json(wrapped, MANIFEST)["entries"]).alias("ord", "e")).filter("e.page_number IS NOT NULL")
    return rows.groupBy("e.page_number").agg(F.max_by("e", "ord").alias("e")).select("e.*").withColumn("failed", F.coalesce(F.col("status") != "ok", F.lit(True)))


def resolved_scores(listing: DataFrame, stem: Column, path: str = "path") -> DataFrame:
    """Per stem (a column of the file's own stem and `wanted`) the score file to use: same stem, then same base, then the first by name."""
    kind = F.when(F.lower(path).endswith(".mxl"), 0).when(F.lower(path).endswith(".musicxml"), 1).when(F.lower(path).endswith(".xml"), 2)
    rank = F.when(stem == F.col("wanted"), 0).when(stem.startswith(F.col("wanted")), 1).otherwise(2)
    w = Window.partitionBy("wanted").orderBy(rank, "_kind", path)
    return listing.withColumn("_kind", kind).filter("_kind IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("wanted", path)


def movements(listing: DataFrame, path: str = "path") -> DataFrame:
    """Files of a score in order: the plain one, then `.mvtN` by number, then the rest by name."""
    number = F.regexp_extract(F.col(path), r"\.mvt(\d+)\.", 1).try_cast("int")
    return listing.dropDuplicates([path]).withColumns({"movement": number, "_plain": ~F.col(path).rlike(r"\.mvt")}).orderBy(F.col("_plain").desc(), F.col("movement").asc_nulls_last(), path).drop("_plain")
