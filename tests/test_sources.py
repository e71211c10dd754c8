"""Format scans on small hand-written files."""

import zipfile

from pyspark.sql import functions as F

from scorespark.operators import windows as N
from scorespark.sources import archives, datasets, kern, layout_files, musicxml, semantic

KERN = (
    "**kern\t**kern\n*clefF4\t*clefG2\n*k[f#]\t*k[f#]\n*M3/4\t*M3/4\n=-\t=-\n4C 4E\t8.ee-'L\n.\t16ff#J\n*\t*^\n4r\t4g\t4b;\n"
    "*\t*v\t*v\n=\t=\n*clefC3\t*\n2.GG\t[2.an\n==\t==\n*-\t*-\n"
)


def frame(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "score string, text string")


def listed(df, *order):
    return [(r.rhythm, r.pitch, r.lift, r.articulation, r.slur, r.position) for r in df.orderBy(*order).collect()]


def test_kern_parts(spark):
    tokens = kern.kern_tokens(frame(spark, a=KERN))
    upper = listed(tokens.where("part = 0"), "ord")
    assert [t[0] for t in upper] == [
        "clef_G2", "keySignature_1", "timeSignature/4", "note_8.", "note_16", "note_4", "chord", "note_4", "barline", "note_2.", "bolddoublebarline",
    ]
    assert upper[3] == ("note_8.", "E5", "b", "staccato", "_", "upper")
    assert upper[7] == ("note_4", "B4", "_", "fermata", "_", "upper")
    lower = [t[0] for t in listed(tokens.where("part = 1"), "ord")]
    assert lower == ["clef_F4", "keySignature_1", "timeSignature/4", "note_4", "chord", "note_4", "rest_4", "barline", "clef_C3", "note_2.", "bolddoublebarline"]


def test_kern_merged(spark):
    tokens = listed(kern.kern_tokens(frame(spark, a=KERN), merged=True), "ord")
    assert [t[0] for t in tokens[:3]] == ["clef_G2", "chord", "clef_F4"]
    assert [t[5] for t in tokens if t[0].startswith("note_2")] == ["upper", "lower"]


def test_kern_documents_carry_signatures(spark):
    doc = "**kern\n*clefG2\n*k[{}]\n*M4/4\n4{}\n=\n*-\n"
    text = doc.format("", "c") + doc.format("", "d") + doc.format("b-", "e")
    rhythms = [t[0] for t in listed(kern.kern_tokens(frame(spark, a=text)), "ord")]
    assert rhythms == ["clef_G2", "keySignature_0", "timeSignature/4", "note_4", "barline", "note_4", "barline", "keySignature_-1", "note_4", "barline"]


def test_kern_parts_keep_the_width_of_the_session(spark):
    """Small texts become many tokens: parts are not joined by the size of the texts, and one exchange serves the merge."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert kern._decode(frame(spark, a=KERN, b=KERN), "score").rdd.getNumPartitions() == width > 1
    for merged in (False, True):
        plan = kern.kern_tokens(frame(spark, a=KERN), merged=merged)._jdf.queryExecution().executedPlan().toString()
        main = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ":" not in line.split("Exchange")[0]]
        assert sum("onset" in line for line in main) == 0 and sum("REPARTITION_BY_NUM" in line for line in main) == 1


def test_kern_errors(spark):
    texts = frame(spark, good="**kern\n4c\n*-\n", bad="**kern\n*k[q]\n4c\n*-\n")
    assert [r.score for r in kern.kern_errors(texts).collect()] == ["bad"]
    assert {r.score for r in kern.kern_tokens(texts).select("score").collect()} == {"good"}


def test_semantic(spark):
    text = "clef-G2 keySignature-FM timeSignature-3/8 note-F4_quarter. barline note-G#4_eighth tie note-G4_eighth_fermata multirest-1 multirest-12 gracenote-A4_sixteenth"
    rows = listed(semantic.semantic_tokens(frame(spark, a=text)), "pos")
    assert [r[0] for r in rows] == ["clef_G2", "keySignature_-1", "timeSignature/8", "note_4.", "barline", "note_8", "note_8", "rest_0", "rest_10m", "note_16G", "barline"]
    assert rows[5] == ("note_8", "G4", "#", "_", "slurStart", "upper")
    assert rows[6] == ("note_8", "G4", "_", "fermata", "slurStop", "upper")


def note(step, octave, duration, kind, staff=1, chord=False, extra="", attr=""):
    body = f"<pitch><step>{step}</step><octave>{octave}</octave></pitch>" if step else "<rest/>"
    return f"<note{attr}>{'<chord/>' if chord else ''}{body}<duration>{duration}</duration><type>{kind}</type><staff>{staff}</staff>{extra}</note>"


def back(n):
    return f"<backup><duration>{n}</duration></backup>"


HEAD = (
    "<attributes><divisions>4</divisions><key><fifths>1</fifths></key><time><beat-type>4</beat-type></time>"
    "<clef number='1'><sign>G</sign><line>2</line></clef><clef number='2'><sign>F</sign><line>4</line></clef></attributes>"
)
THIRDS = "<time-modification><actual-notes>3</actual-notes><normal-notes>2</normal-notes></time-modification>"


def xml(*measures):
    return "<score-partwise><part>" + "".join(f"<measure>{m}</measure>" for m in measures) + "</part></score-partwise>"


def test_musicxml(spark):
    tie = "<notations><tied type='stop'/></notations>"
    first = HEAD + note("A", 3, 16, "whole", extra=tie) + note("G", 4, 16, "whole", chord=True) + back(16) + note("", 0, 8, "half") + note("E", 4, 8, "half") + back(16)
    first += note("G", 3, 8, "half", 2) + note("C", 3, 8, "half", 2)
    second = (
        note("C", 5, 2, "eighth", extra=THIRDS + "<notations><tuplet type='start'/></notations>") + note("D", 5, 2, "eighth", extra=THIRDS)
        + note("E", 5, 2, "eighth", extra=THIRDS + "<notations><tuplet type='stop'/></notations>") + note("G", 5, 4, "quarter")
        + "<attributes><clef number='2' after-barline='yes'><sign>G</sign><line>2</line></clef></attributes>"
        + "<barline><bar-style>light-heavy</bar-style><repeat direction='backward'/></barline>"
    )
    third = note("C", 5, 16, "whole", attr=" print-object='no'") + back(16) + note("C", 4, 16, "whole", 2)
    rows = listed(musicxml.musicxml_tokens(frame(spark, a=xml(first, second, third))), "ord")
    assert [r[0] for r in rows] == [
        "clef_G2", "chord", "clef_F4", "keySignature_1", "timeSignature/4", "note_1", "chord", "note_1", "chord", "rest_2", "chord", "note_2",
        "note_2", "chord", "note_2", "barline", "note_12", "note_12", "note_12", "note_4", "repeatEnd", "clef_G2", "note_1", "barline",
    ]
    assert rows[5] == ("note_1", "A3", "_", "_", "slurStop", "upper")
    assert rows[21][5] == "lower"


def test_musicxml_rejects(spark):
    good = xml(HEAD + note("C", 4, 4, "quarter"))
    texts = frame(spark, good=good, broken="<x", time=good.replace("<beat-type>4", "<beat-type>5"), long=xml(back(3) + note("C", 4, 4, "quarter")))
    assert {r.score for r in musicxml.musicxml_tokens(texts).select("score").collect()} == {"good"}
    assert {r.score for r in musicxml.musicxml_errors(texts).collect()} == {"broken", "time", "long"}


def test_bar_line_rules(spark):
    rows = [("s", i, 0, r) for i, r in enumerate(["note_4", "barline", "barline", "repeatEnd", "repeatStart", "note_4"])]
    df = spark.createDataFrame(rows, "seq_id string, pos int, measure int, rhythm string")
    got = [r.rhythm for r in N.coalesce_bar_lines(df).orderBy(N.F.col("pos").isNull(), "pos").collect()]
    assert got == ["note_4", "barline", "repeatEndStart", "note_4", "barline"]


def test_archives(spark, tmp_path):
    for name, members in {"a": ["META-INF/container.xml", "score.xml"], "b": ["in/one.xml"], "c": []}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.mxl", "w") as archive:
            for m in members:
                archive.writestr(m, f"<{m}>")
    (tmp_path / "d.mxl").write_bytes(b"nothing")
    rows = {r.score[-5]: r for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert rows["a"].text == "<score.xml>" and rows["b"].text == "<in/one.xml>"
    assert rows["c"].error == "no score in archive" and rows["d"].error.startswith("BadZipFile")


def test_index_and_listing(spark, tmp_path):
    (tmp_path / "index.txt").write_text("a.jpg,a.tokens\nb.jpg,b.tokens\n")
    assert datasets.read_index(spark, str(tmp_path / "index.txt")).count() == 2
    for name in ("x.jpg", "x_debug.jpg", "y.PNG", "z.txt"):
        (tmp_path / name).write_bytes(b"1")
    paths = [r.path.rsplit("/", 1)[1] for r in datasets.list_images(spark, str(tmp_path)).collect()]
    assert paths == ["x.jpg", "y.PNG"]


def test_layout_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 1, 100.0, 60.0, 40.0, 20.0), (2, 0, 50.0, 60.0, 40.0, 20.0)], "page int, class int, cx double, cy double, w double, h double")
    layout_files.write_layout(boxes, str(tmp_path / "out"), 200.0, 120.0, "class")
    row = layout_files.read_bundle(spark, str(tmp_path / "out"), 200.0, 120.0).where("page = '1'").first()
    assert (row.grand, row.x1, row.y1, row.x2, row.y2) == (True, 80, 50, 120, 70)
    (tmp_path / "plain.txt").write_text("1 0.5 0.5 0.2 0.1\nnot a box\n")
    assert layout_files.read_layout(spark, str(tmp_path / "plain.txt"), 200.0, 120.0).count() == 1


def test_index_and_diff_bundles(spark, tmp_path):
    samples = spark.createDataFrame([("a,1.png", "a.tokens"), ("b.png", None), (None, "c.tokens")], "image string, tokens string")
    datasets.write_index(samples, str(tmp_path / "index"))
    datasets.write_index(samples, str(tmp_path / "index"))
    assert [tuple(r) for r in datasets.read_index_bundle(spark, str(tmp_path / "index")).collect()] == [("a,1.png", "a.tokens")] * 2
    pairs = spark.createDataFrame([("s/1", "**kern\n4c\n", "<score/>\n"), ("s2", "", "**kern\n4d\n")], "sample_id string, kern_text string, actual_text string")
    datasets.export_diff(pairs, str(tmp_path / "diff"))
    assert sorted(tuple(r) for r in datasets.read_diff(spark, str(tmp_path / "diff")).collect()) == [
        ("s/1", "actual", "<score/>\n", "musicxml"), ("s/1", "expected", "**kern\n4c\n", "krn"), ("s2", "actual", "**kern\n4d\n", "krn"),
    ]


def test_scores_from_files_and_bundles_give_the_same_tokens(spark, tmp_path):
    (tmp_path / "a.krn").write_text(KERN)
    (tmp_path / "b.krn").write_text("**kern\n4c\n*-\n")
    files = kern.read_kern(spark, str(tmp_path / "*.krn"))
    kern.write_bundle(files, str(tmp_path / "bundle"))
    bundle = kern.read_bundle(spark, str(tmp_path / "bundle")).where(F.col("score").endswith("a.krn")).drop("error")
    assert listed(kern.kern_tokens(bundle).where("part = 0"), "ord") == listed(kern.kern_tokens(files.where(F.col("score").endswith("a.krn"))).where("part = 0"), "ord")
    (tmp_path / "x.musicxml").write_text("<score-partwise><part><measure><note><rest/><duration>1</duration><type>quarter</type></note></measure></part></score-partwise>")
    rows = listed(musicxml.musicxml_tokens(musicxml.read_musicxml(spark, str(tmp_path / "*.musicxml"))), "ord")
    assert rows[0][0] == "rest_4"


def test_metadata_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("path,n_tracks,complexity,subset:all_valid,subset:no_license_conflict\na,1,2,True,True\nb,x,2,True,True\nc,1,9,True,True\nd,1,1,true,True\ne,1,1,True,False\n")
    assert [r.path for r in datasets.read_metadata(spark, str(tmp_path / "m.csv"), 2, 3).collect()] == ["a"]
