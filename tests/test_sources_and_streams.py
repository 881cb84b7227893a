import datetime
import io
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F

from intervalia.sources import archives
from intervalia.streaming import ledger

SHEET = """<sheet><picture width="240" height="220"/>{}</sheet>"""
GROUP = """<page id="1"><system id="1"><staff id="1" left="20" right="220"><header start="20"/><lines>{lines}</lines><barlines>1 2</barlines></staff>
<sig><inters><barline id="1" staff="1"><bounds x="89" y="{y}" w="2" h="40"/><median><p1 x="90" y="{y}"/><p2 x="90" y="{b}"/></median></barline>
<barline id="2"><bounds x="159" y="{y}" w="2" h="40"/></barline></inters></sig></system></page>"""


def sheet():
    line = lambda y: f'<line><point x="20" y="{y}"/><point x="220" y="{y}"/></line>'
    return SHEET.format("".join(GROUP.format(lines="".join(line(y + 10 * i) for i in range(5)), y=y, b=y + 40) for y in (20, 130)))


SCORE = """<score-partwise><part id="P1"><measure number="1"/><measure number="2"/><measure number="3"><print new-system="yes"/></measure>
<measure number="4"><print new-page="yes"/></measure><measure><print><system-layout/></print></measure></part></score-partwise>"""


def files(spark, **archives_):
    out = []
    for name, members in archives_.items():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for member, text in members.items():
                z.writestr(member, text)
        out.append((name, data.getvalue()))
    return spark.createDataFrame([*out, ("broken", b"no zip")], "path string, content binary")


def test_sheets(spark):
    df = files(spark, a={"sheet#2/sheet#2.xml": sheet(), "sheet#1/sheet#1.xml": sheet(), "other.xml": "<x/>"})
    assert sorted((r["sheet_no"], r["member"]) for r in archives.sheets(df).collect()) == [(1, "sheet#1/sheet#1.xml"), (2, "sheet#2/sheet#2.xml")]
    one = archives.staves(df).filter("sheet_no = 1")
    rows = sorted(one.collect(), key=lambda r: r["system_index"])
    assert [(r["system_index"], r["source_group_index"]) for r in rows] == [(0, 1), (1, 2)]
    assert rows[0]["line_ys"] == [20.0, 30.0, 40.0, 50.0, 60.0] and rows[0]["barline_ids"] == ["1", "2"]
    got = archives.staff_barlines(one, archives.symbols(df).filter("sheet_no = 1")).collect()
    assert all(r["barline_xs"] == [90.0, 160.0] and r["barline_source"] == "staff_ids" for r in got)
    loose = archives.staff_barlines(one.withColumn("barline_ids", F.array().cast("array<string>")), archives.symbols(df).filter("sheet_no = 1")).collect()
    assert all(r["barline_xs"] == [90.0, 160.0] and r["barline_source"] == "overlap" for r in loose)
    assert [tuple(r) for r in archives.archive_errors(df).collect()] == [("broken", "not_an_archive")]


def test_scores(spark):
    torn = '<score-partwise><part><measure xlink:href="x" number="9"/></part></score-partwise>'
    df = files(spark, a={"META-INF/container.xml": "<c/>", "s.xml": SCORE, "notes.xml": "<notes><measure/></notes>"}, b={"t.musicxml": torn}, c={"u.xml": "<open"})
    m = archives.members(df)
    assert {(r["member"], r["n_measures"], r["parsed"], tuple(r["repaired_prefixes"])) for r in m.collect()} == {("s.xml", 5, True, ()), ("notes.xml", 1, True, ()), ("t.musicxml", 1, True, ("xlink",)), ("u.xml", 0, False, ())}
    assert {(r["path"], r["member"], r["reason"]) for r in archives.chosen_member(m).collect()} == {("a", "s.xml", "score_root_with_measures"), ("b", "t.musicxml", "score_root_with_measures"), ("c", "u.xml", "fallback_first")}
    starts = archives.system_starts(archives.measures(df).filter("member = 's.xml'")).orderBy("page_no").collect()
    assert [r["starts"] for r in starts] == [["1", "3"], ["4", "5"]]
    assert ET.fromstring(SCORE).tag == "score-partwise"


def test_manifest_and_paths(spark):
    text = ['{"entries": [{"page_number": 1, "status": "ok", "system_starts": ["1", "5"]}, {"page_number": 2, "status": "missing"}, {"page_number": 1, "status": "late"}, {"status": "ok"}]}', '[{"page_number": 7, "status": "ok"}]', "broken"]
    got = {r["page_number"]: (r["status"], r["failed"]) for r in archives.manifest(spark.createDataFrame([(t,) for t in text], "value string")).collect()}
    assert got == {1: ("late", True), 2: ("missing", True), 7: ("ok", False)}
    paths = spark.createDataFrame([("d/a.mvt10.mxl",), ("d/a.mvt2.mxl",), ("d/a.mxl",), ("d/a.mvt2.mxl",)], "path string")
    assert [r["path"] for r in archives.movements(paths).collect()] == ["d/a.mxl", "d/a.mvt2.mxl", "d/a.mvt10.mxl"]
    some = spark.createDataFrame([("b", "x/a.mxl"), ("b", "x/b.xml"), ("b", "x/b.mxl"), ("c", "x/a.xml"), ("c", "x/c2.musicxml")], "wanted string, path string")
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    assert {(r["wanted"], r["path"]) for r in archives.resolved_scores(some, stem).collect()} == {("b", "x/b.mxl"), ("c", "x/c2.musicxml")}


def stream(spark, folder, rows, schema):
    """A stream that reads the rows (lists: one file and batch each)."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drained(df, spark, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


T0 = datetime.datetime(2026, 1, 1)
AT = lambda s: T0 + datetime.timedelta(seconds=s)


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    charges = stream(spark, f"{tmp_path}/c", [[("c1", AT(0)), ("c1", AT(1)), ("c2", AT(2))], [("c1", AT(3)), ("c3", AT(4))]], "charge string, t timestamp")
    assert sorted(r[0] for r in drained(ledger.charged_once(charges, ["charge"], "t"), spark, "charges")) == ["c1", "c2", "c3"]
    fails = stream(spark, f"{tmp_path}/f", [[(1, AT(100)), (1, AT(0)), (2, AT(5))], [(1, AT(899)), (1, AT(900)), (1, AT(901))]], "o int, t timestamp")
    got = drained(ledger.anchored_limit(fails, "o", "t", 900, 3), spark, "fails")
    base = int(T0.replace(tzinfo=datetime.UTC).timestamp())
    assert sorted((o, at - base, n, b) for o, at, _, n, b in got) == [(1, 0, 1, False), (1, 100, 2, False), (1, 899, 3, True), (1, 900, 1, False), (1, 901, 2, False), (2, 5, 1, False)]
    held = stream(spark, f"{tmp_path}/r", [[("a", AT(0), "reserve"), ("b", AT(0), "reserve"), ("c", AT(0), "reserve")], [("a", AT(10), "spend"), ("b", AT(2000), "spend")], [("z", AT(9000), "reserve")], [("z", AT(9001), "release")]], "k string, t timestamp, action string")
    assert sorted(drained(ledger.reservations(held, "k", "t"), spark, "held")) == [("a", "spent"), ("b", "expired"), ("c", "expired"), ("z", "released")]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_prefixes_that_are_declared_nowhere():
    root, lacking = archives.parse_tolerantly(b'<score xmlns:a="x"><a:part b:id="1"><m c="2">t</m></a:part><c:end/></score>')
    assert lacking == ["b", "c"] and [e.tag for e in root.iter()] == ["score", "part", "m", "end"]
    assert root.find("part").attrib == {"id": "1"} and root.findtext("part/m") == "t"
    assert archives.parse_tolerantly(b"<a><b></a>") == (None, []) and archives.parse_tolerantly(b"<a/>")[0].tag == "a"
