"""Stages, services, sources, sinks and settings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumi.config import ContourJob, Settings, Trim, env_int, load
from sumi.functions import register
from sumi.functions import text as X
from sumi.operators import boxes as B
from sumi.plans import stages
from sumi.services import HttpJudge, Recorded, ask, patient
from sumi.sources import images as I
from sumi.sources import sinks as S
from sumi.streaming.watch import run_on_arrivals


def image_rows(spark, n=3, size=48):
    rows = []
    for k in range(n):
        x = np.full((size, size, 3), 235, np.uint8)
        x[8:40, 8 + k : 20] = 15
        x[8:40, 28:40] = 25
        rows.append((f"img{k}", size, size, 3, bytearray(x.tobytes())))
    return spark.createDataFrame(rows, "image_id string, height int, width int, n_channels int, data binary")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("text,want", [("", "unknown"), (None, "unknown"), ("a/b", "a_b"), ("x" * 25, "x" * 20), ('<:>"|?*\\', "________")])
def test_safe_filename(spark, text, want):
    assert one(spark, X.safe_filename, text) == want
    register(spark)
    quoted = "NULL" if text is None else "'" + text.replace("\\", "\\\\") + "'"
    assert spark.sql(f"SELECT safe_filename({quoted}) AS r").first().r == want


@pytest.mark.parametrize(
    "raw,flags,character",
    [
        ('```json\n{"single_character": true, "recognizable": "false", "has_noise": 0, "character": " 書 "}\n```', (True, True, False), "書"),
        ('{"single_character": [], "recognizable": null, "has_noise": {}, "character": null}', (False, False, False), ""),
        ("sorry", (None, None, None), None),
        (None, (None, None, None), None),
    ],
)
def test_verdict(spark, raw, flags, character):
    v = one(spark, X.verdict, raw)
    assert (v.single_character, v.recognizable, v.has_noise) == flags and v.character == character and not v.error
    if raw == "sorry":
        assert v.comment == "sorry" and not v.parsed


@pytest.mark.parametrize("raw", ["[1]", "3", '{"character": 5}'])
def test_verdict_errors(spark, raw):
    assert one(spark, X.verdict, raw).error


@pytest.mark.parametrize("flags,want", [((True, True, False, "書"), True), ((True, True, False, "書法"), False), ((True, True, True, "書"), False), ((True, True, False, "A"), False)])
def test_keep(spark, flags, want):
    v = F.struct(*(F.lit(x).alias(n) for x, n in zip(flags, ("single_character", "recognizable", "has_noise", "character"), strict=True)))
    assert spark.range(1).select(X.keep(v).alias("r")).first().r is want


def test_boxes(spark):
    lit = lambda d: spark.range(1).select(*(c.alias(k) for k, c in d.items())).first()
    n = [F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]
    assert tuple(lit(B.denormalise(*n, F.lit(200), F.lit(100)))) == (20, 40, 60, 40)
    assert tuple(lit(B.clamp_box(*map(F.lit, (-5, 10, 120, 200)), F.lit(100), F.lit(50)))) == (0, 10, 100, 50)
    polygon = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((10, 5), (30, 5), (30, 25), (10, 25))))
    assert spark.range(1).select(B.polygon_box(polygon).alias("r")).first().r == [10, 5, 30, 25]


def test_pipeline_with_recorded_models(spark, tmp_path):
    images = image_rows(spark)
    reply = json.dumps({"success": True, "text_regions": [{"rect": [4, 4, 44, 44], "text": "t", "confidence": 0.5}, {"bbox": [1, 2]}]})
    detector = Recorded({"img0": reply, "img1": "no json"})

    def characters(regions):
        found = F.array(*(F.struct(F.lit(k).alias("det_idx"), F.lit("山").alias("text"), F.lit(1.0).alias("confidence"), F.array(*map(F.lit, (x, 0.0, 0.5, 1.0))).alias("nbox")) for k, x in enumerate((0.5, 0.0))))
        return regions.select("image_id", F.lit(1).alias("region_id"), F.explode(found).alias("d")).select("image_id", "region_id", "d.*")

    def judge(key, png):
        assert png.startswith(b"\x89PNG")
        if key.startswith("img2"):
            raise ValueError("refused")
        return '{"single_character": true, "recognizable": true, "has_noise": %s, "character": "山"}' % ("true" if key.endswith("0001.png") else "false")

    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    out = stages.run_pipeline(images, Settings(), ("preprocess", "preocr", "segment", "postocr"), detector, characters, judge, write)
    regions = {r.image_id: (r.x1, r.y1, r.x2, r.y2, r.text, r.file) for r in out["preocr"].collect()}
    assert regions["img0"] == (4, 4, 44, 44, "t", "region_001.jpg")
    assert regions["img1"] == regions["img2"] == (0, 0, 48, 48, "", "region_001.jpg")
    verdicts = out["postocr"].collect()
    assert sorted((r.image_id, r.status) for r in verdicts) == [("img0:1", "accepted"), ("img0:1", "filtered_out"), ("img1:1", "accepted"), ("img1:1", "filtered_out"), ("img2:1", "error"), ("img2:1", "error")]
    assert {r.output_file for r in verdicts} == {"reject_001.png", "002_山.png", None}
    total = out["report"].where("image_id is null").first()
    assert (total.total_files, total.accepted, total.filtered_out, total.error) == (6, 2, 2, 2)
    # resume: cached rows with other settings are stale
    work = out["segment"].select("image_id", "region_id", "filename").withColumn("settings", F.lit(Settings(trim=Trim(tighten=0.02)).digest()))
    on = ["image_id", "region_id", "filename", "settings"]
    assert I.pending(work, out["postocr"], on).count() == 6
    assert I.pending(out["postocr"].select(*on), out["postocr"], on).count() == 0
    assert I.pending(out["postocr"].select(*on), out["postocr"], on, force=True).count() == 6
    disabled = stages.judge(out["segment"], None, Settings())
    assert {r.status for r in disabled.collect()} == {"filtered_out"}
    assert stages.segment_summary(out["segment"]).count() == 3


def test_unknown_stage(spark):
    with pytest.raises(ValueError):
        stages.run_pipeline(image_rows(spark), Settings(), ("nonsense",))


def test_retries():
    calls = []

    def flaky(key, png):
        calls.append(key)
        if len(calls) < 3:
            raise ConnectionError("down")
        return "ok"

    assert patient(flaky, 3, 0.01)("k", b"")[0] == "ok" and len(calls) == 3
    assert patient(lambda k, p: 1 / 0, 3, 0.01)("k", b"")[2]
    with pytest.raises(ValueError):
        HttpJudge("http://localhost", "", "m")


def test_ask_keeps_going(spark):
    rows = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "key string, png binary")
    got = {r.key: (r.raw, r.error is None) for r in ask(rows, Recorded({"a": "x"})).collect()}
    assert got == {"a": ("x", True), "b": (None, False)}


def test_images_round_trip(spark, tmp_path):
    folder = tmp_path / "preocr" / "book1" / "x"
    folder.mkdir(parents=True)
    written = S.write_files(S.with_png(image_rows(spark)).withColumn("output_file", F.concat("image_id", F.lit(".png"))), f"file://{folder}").collect()
    assert len(written) == 3
    (folder / "region_001.png").write_bytes((folder / "img0.png").read_bytes())
    (folder / "note.txt").write_text("x")
    (folder / "bad.png").write_bytes(b"not an image")
    back = {r.image_id.rsplit("/", 1)[1]: bytes(r.data) for r in I.read_images(spark, str(tmp_path)).collect()}
    want = {r.image_id: bytes(r.data) for r in image_rows(spark).collect()}
    assert back["img1.png"] == want["img1"] and set(back) == {"img0.png", "img1.png", "img2.png", "region_001.png"}
    files = I.list_images(spark, str(tmp_path))
    assert files.count() == 5
    assert [(r.dataset, r.region) for r in I.region_images(files).collect()] == [("book1", "region_001.png")]
    S.write_json(files.select("length"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 5


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    first, second = (bytes(r.png) for r in S.with_png(image_rows(spark, 2)).collect())
    (tmp_path / "in" / "a.png").write_bytes(first)
    for k, body in ((1, None), (2, second)):
        if body:
            (tmp_path / "in" / "b.png").write_bytes(body)
        run = run_on_arrivals(spark, source, lambda x: stages.preprocess(x, Settings()), out, mark)
        run.awaitTermination(60)
        assert spark.read.parquet(out).count() == k
        assert len({r.batch for r in spark.read.parquet(out).collect()}) == k


def test_settings(tmp_path):
    Settings().check()
    with pytest.raises(ValueError):
        Settings(trim=Trim(cut=(0.2, 0.2, 0.2, 1.4))).check()
    assert Settings().digest() != Settings(trim=Trim(tighten=0.5)).digest() and "tighten=0.01" in Settings().summary()
    file = tmp_path / "job.toml"
    file.write_text('gamma = 1.3\nmethod = "otsu"\ninput = "x"\n')
    job = load(ContourJob, str(file), given={"method": "canny", "open_k": None})
    assert (job.gamma, job.method, job.open_k) == (1.3, "canny", 5)
    assert load(ContourJob, auto=(str(file),)).method == "otsu" and load(ContourJob).method == "auto"
    with pytest.raises(FileNotFoundError):
        load(ContourJob, "nowhere.toml")
    assert env_int("NO_SUCH_VARIABLE", 30) == 30


def test_closing_fence_alone_stays(spark):
    assert one(spark, X.strip_fence, '{"a": 1}\n```') == '{"a": 1}\n```'
    assert one(spark, X.strip_fence, '```json\n{"a": 1}\n```') == '{"a": 1}'


def test_refused_requests_are_not_repeated():
    calls = []

    class Refused(OSError):
        def __init__(self, status):
            self.response = type("Answer", (), {"status_code": status})

    def call(key, png):
        calls.append(key)
        raise Refused(int(key))

    for status, times in (("401", 1), ("404", 1), ("429", 3), ("503", 3)):
        calls.clear()
        assert patient(call, 2, pause=0.0)(status, b"")[0] is None and len(calls) == times


def test_images_that_do_not_decode(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(I.encode_png(np.full((4, 5), 7, np.uint8)))
    (tmp_path / "a.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    folder = str(tmp_path)
    assert [r.path.rsplit("/", 1)[1] for r in I.list_images(spark, folder).collect()] == ["a.png", "b.png"]
    assert [r.image_id.rsplit("/", 1)[1] for r in I.read_images(spark, folder).collect()] == ["b.png"]
    assert [(r.image_id.rsplit("/", 1)[1], r.error) for r in I.unreadable_images(spark, folder).collect()] == [("a.png", "does not decode")]


def test_one_bad_raster_is_a_row(spark):
    rows = image_rows(spark).withColumn("data", F.when(F.col("image_id") == "img1", F.lit(b"short")).otherwise(F.col("data")))
    good, bad = stages.preprocess_errors(rows, Settings())
    assert sorted(r.image_id for r in good.collect()) == ["img0", "img2"]
    found = bad.collect()
    assert [r.image_id for r in found] == ["img1"] and "Error" in found[0].error
    want = {r.image_id: bytes(r.data) for r in stages.preprocess(image_rows(spark), Settings()).collect()}
    assert {r.image_id: bytes(r.data) for r in good.collect()} == {k: v for k, v in want.items() if k != "img1"}


def test_debug_numbers_are_those_of_the_refined_box():
    from sumi.operators import glyphs

    x = np.full((40, 40, 3), 235, np.uint8)
    x[10:30, 12:28] = 10
    trace: dict = {}
    box, _ = glyphs.refine(x, (8, 8, 24, 24), Settings(), trace)
    assert box == glyphs.refine(x, (8, 8, 24, 24), Settings())[0]
    left, _, top, _ = trace["trim"]
    a, b, c, d = trace["border"]
    pad, (l, _, t, _) = Settings().refine.final_pad, Settings().refine.expand
    assert box[0] == max(0, 8 - l) + max(0, left + a - pad) and box[1] == max(0, 8 - t) + max(0, top + c - pad)
    assert b > a and d > c and trace["parts"] >= 1


def test_median_of_groups(spark):
    from sumi.functions.stats import median

    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.normal(size=501)] + [("b", float(v)) for v in rng.integers(0, 5, 400)] + [("c", 3.0)] * 7 + [("d", None), ("e", 1.0), ("e", 4.0)]
    got = {r.k: r.median for r in median(spark.createDataFrame(rows, "k string, v double"), "k", "v", 16).collect()}
    want = {k: float(np.median([v for g, v in rows if g == k])) for k in "abce"}
    assert got == pytest.approx(want)
