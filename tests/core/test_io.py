"""File sink, listings, pulls, verifier stage, write-back, progress and image containers."""

import json
import os
import struct
import subprocess
import sys
import zlib
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import batch as B
from marlstone.operators import pull as P
from marlstone.operators import verify as Q
from marlstone.sources import files as W
from marlstone.sources import images as I
from marlstone.sources import listing as L
from marlstone.sources import writers as X
from marlstone.streaming import progress as G


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


# the staged sink


def test_failed_attempt_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit(f"{tmp_path}/out/"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("target"), F.concat(F.lit("b"), "id").alias("body")).repartition(4)
    with pytest.raises(Exception, match="rehearsed"):
        W.write_files(rows, staging=str(tmp_path / "stage"), attempts=1, failing=1)
    assert not (tmp_path / "out").exists() and tree(tmp_path) == {}
    done = W.write_files(rows, staging=str(tmp_path / "stage"), failing=1)
    assert {r["status"] for r in done.collect()} == {"written"}
    assert tree(tmp_path) == {f"out/{i % 3}/{i}": f"b{i}".encode() for i in range(40)}


def test_a_task_that_runs_again_writes_the_same_files(tmp_path):
    """Spark's own retry of a task, which a session in this process doesn't have."""
    script = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
from marlstone.sources import files
def once(batches):
    import os, pyarrow as pa
    for batch in batches:
        yield batch
        from pyspark import TaskContext
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 0:
            raise OSError("lost")
rows = spark.range(20).repartition(2).select(F.concat(F.lit("{tmp_path}/out/"), "id").alias("target"), F.col("id").cast("string").alias("body"))
print("DONE", files.write_files(rows.mapInArrow(once, rows.schema), staging="{tmp_path}/stage", attempts=1).count())
"""
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    got = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=180, env=env)
    assert "DONE 20" in got.stdout, got.stderr[-2000:]
    assert tree(tmp_path) == {f"out/{i}": str(i).encode() for i in range(20)}


def test_publishing_may_be_interrupted(tmp_path):
    system, _ = W.located(str(tmp_path))
    for overwrite in (True, False):
        staged, target = tmp_path / "s", tmp_path / f"t{overwrite}"
        staged.write_text("new")
        assert W.place(system, str(staged), str(target), overwrite) == "written" and target.read_text() == "new"
        assert W.place(system, str(staged), str(target), overwrite) == "written"  # again, after the move
    staged.write_text("other")
    assert W.place(system, str(staged), str(target), False) == "exists" and target.read_text() == "new"
    os.unlink(staged)
    target.write_text("linked")
    os.link(target, staged)  # stopped between link and unlink
    assert W.place(system, str(staged), str(target), False) == "written" and not staged.exists()


def test_two_rows_for_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/a", "1"), (f"{tmp_path}/a", "2")], "target string, body string")
    with pytest.raises(ValueError, match="two rows"):
        W.write_files(rows, staging=str(tmp_path / "stage"), attempts=1)
    assert tree(tmp_path) == {}
    none = W.write_files(rows.filter("body = ''"), staging=str(tmp_path / "stage"))
    assert none.count() == 0
    W.write_files(spark.createDataFrame([(f"{tmp_path}/n", None)], "target string, body string"))
    assert tree(tmp_path)["n"] == b""


def test_json_array(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else f'q"{i}\n') for i in range(50)], "k int, t string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little text would be one part
    try:
        X.json_array(df, str(tmp_path / "a"), "k", str(tmp_path / "a.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert json.loads((tmp_path / "a.json").read_text()) == [{"k": i, "t": None if i % 3 else f'q"{i}\n'} for i in range(50)]
    assert len([f for f in os.listdir(tmp_path / "a") if f.startswith("part-")]) > 1
    X.json_array(df.filter("k < 0"), str(tmp_path / "b"), "k", str(tmp_path / "b.json"))
    assert json.loads((tmp_path / "b.json").read_text()) == []
    assert sorted(f for f in os.listdir(tmp_path) if f.endswith(".part")) == []


# outcomes


def one_by_one(rows, existing, write_txt, write_xmp, xmp_overwrite):
    """The rows written one after the other."""
    written, out = set(), {}
    for idx, path, error in rows:
        plain = os.path.normpath(path)
        txt, meta = os.path.splitext(plain)[0] + ".txt", plain + ".xmp"
        if error:
            out[idx] = (None, None, False)
            continue
        if write_txt and txt in written:
            out[idx] = (None, None, False)
            continue
        if write_txt:
            written.add(txt)
        sidecar = txt if write_txt else None
        if not write_xmp:
            out[idx] = (sidecar, None, True)
        elif meta in written or (meta in existing and not xmp_overwrite):
            out[idx] = (sidecar, None, False)
        else:
            written.add(meta)
            out[idx] = (sidecar, path + ".xmp", True)
    return out


@pytest.mark.parametrize("txt", [True, False])
@pytest.mark.parametrize("xmp", [True, False])
@pytest.mark.parametrize("over", [True, False])
def test_outcomes_follow_the_order(spark, txt, xmp, over):
    paths = ["/a/cat.jpg", "/a/cat.png", "/a/b/../cat.jpg", "/a/dog.jpg", "/a/./dog.jpg", "/a/cow", "/b/cat.jpg", "/a/dog.jpg"]
    rows = [(i, paths[(i * 5) % len(paths)], "bad" if i % 4 == 0 else None) for i in range(24)]
    there = spark.createDataFrame([("/a/dog.jpg.xmp",), ("/b/x/../cat.jpg.xmp",)], "path string")
    df = spark.createDataFrame(rows, "idx int, path string, error string").repartition(3)
    got = B.manifest_outcomes(df, there, txt, xmp, over)
    assert {r["idx"]: (r["sidecar"], r["xmp_path"], r["error"] is None) for r in got.collect()} == one_by_one(rows, {"/a/dog.jpg.xmp", "/b/cat.jpg.xmp"}, txt, xmp, over)
    if xmp and txt and not over:
        assert any("its .txt sidecar was written" in (r["error"] or "") for r in got.collect())


# listings

T0 = datetime(2024, 5, 1, tzinfo=UTC)


def service(rows):
    """Pages of (id, time or None) between two bounds."""

    def fetch(page, size, after, before):
        some = sorted((u or "", i) for i, u in rows if (u is None and after is None) or (u is not None and (after is None or u >= after) and (before is None or u < before)))
        return {"items": [{"id": i, "updated_at": u or None} for u, i in some[(page - 1) * size : page * size]], "next_page": page + 1 if page * size < len(some) else None}

    return fetch


def listed(fetch, parts, size):
    reader = L._Reader(fetch, size, 0, None, L.now_utc)
    return [list(reader.read(p)) for p in parts]


@pytest.mark.parametrize("most, size", [(6, 3), (1, 1), (100, 10), (5, 10)])
def test_ranges_cover_every_asset_once(most, size):
    rows = [(f"t{i}", L.stamp(T0 + timedelta(seconds=i // 2))) for i in range(40)] + [(f"tie{i}", L.stamp(T0)) for i in range(30)]
    rows += [("undated", None), ("future", L.stamp(T0 + timedelta(days=900))), ("late1", L.stamp(T0 + timedelta(days=30))), ("old", "1960-01-01T00:00:00.000Z")]
    fetch = service(rows)
    parts = L.split(fetch, size, most, None, None, T0 + timedelta(days=30))
    got = listed(fetch, parts, size)
    assert sorted(i for p in got for i, _ in p) == sorted(i for i, _ in rows)
    assert all(0 < len(p) <= max(most // size, 1) * size for p in got)
    later = L.split(fetch, size, most, T0 + timedelta(seconds=3), None, T0)
    assert sorted(i for p in listed(fetch, later, size) for i, _ in p) == sorted(i for i, u in rows if u and u >= L.stamp(T0 + timedelta(seconds=3)))
    assert L.split(service([]), size, most, None, None, T0) == []


def test_stream_offsets_have_one_size_and_ties_fall_on_one_side():
    now, rows = [T0], [("a", L.stamp(T0 - timedelta(seconds=1))), ("n", None), ("b", L.stamp(T0))]
    fetch = service(rows)
    make = lambda: L._StreamReader(fetch, 2, 2, None, lambda: now[0], timedelta(0))
    stream = make()
    begin, seen = stream.initialOffset(), []

    def trigger(stream, begin):
        end = stream.latestOffset()
        for part in stream.partitions(begin, end):
            seen.extend(i for i, _ in stream.read(part))
        return end

    begin = trigger(stream, begin)
    assert seen == ["n", "a"] and begin == {"before": L.stamp(T0)}  # b is stamped now: others may still come
    rows += [("c", L.stamp(T0)), ("d", L.stamp(T0 + timedelta(seconds=5)))]
    assert trigger(stream, begin) == begin  # the clock stands
    now[0] = T0 + timedelta(seconds=1)
    begin = trigger(stream, begin)
    now[0] = T0 + timedelta(seconds=9)
    begin = trigger(make(), begin)  # a restart
    assert seen == ["n", "a", "b", "c", "d"] and len(json.dumps(begin)) < 60
    with pytest.raises(ValueError, match="clock"):
        make().partitions(begin, {"before": L.stamp(T0)})


# pulls


def test_pull_stores_in_order_and_leaves_no_part(spark, tmp_path):
    def fetch(key):
        if key.startswith("bad"):
            raise TimeoutError(key)
        return key.encode() * 3

    assets = spark.createDataFrame([(i, f"{'bad' if i % 5 == 0 else 'ok'}{i}", f"x/{i % 30}.jpg" if i % 7 else f"x/{i}") for i in range(40)], "pos int, id string, path string")
    have = spark.createDataFrame([("3.jpg",)], "basename string")
    folder = tmp_path / "dest"
    got = P.pull(B.pull_plan(assets, have), fetch, str(folder)).cache()
    rows = {r["pos"]: r for r in got.collect()}
    assert len(rows) == 40 and rows[5]["error"] == "TimeoutError: bad5" and rows[5]["status"] == "failed"
    assert rows[3]["status"] == "skipped" and rows[33]["status"] == "failed" and rows[33]["error"].startswith("file already")
    assert rows[7]["status"] == "downloaded" and "no extension" in rows[7]["warning"] and rows[35]["warning"] is None
    assert tree(folder) == {r["basename"]: r["id"].encode() * 3 for r in rows.values() if r["status"] == "downloaded"}
    assert tuple(P.pull_summary(got).first()) == tuple(sum(r["status"] == s for r in rows.values()) for s in ("downloaded", "skipped", "failed"))


def test_no_more_than_some_downloads_at_once(tmp_path):
    import threading

    now, most, lock, begun = [0], [0], threading.Lock(), []

    def work(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            begun.append(i)
        threading.Event().wait(0.01)
        with lock:
            now[0] -= 1
        if i == 6:
            raise OSError("x")

    taken = []
    for (i,), error in P.in_order(((i,) for i in range(20)), work, 4):
        assert len(begun) <= len(taken) + 4 + 1  # work isn't begun far ahead of what is taken
        taken.append((i, error is None))
    assert taken == [(i, i != 6) for i in range(20)] and 1 < most[0] <= 4


def test_a_write_that_fails_leaves_nothing(tmp_path):
    (tmp_path / "a").mkdir()
    with pytest.raises(OSError):
        P.put(str(tmp_path), "a", b"x")  # a folder stands in the way
    assert os.listdir(tmp_path) == ["a"] and os.listdir(tmp_path / "a") == []
    (tmp_path / "b").write_bytes(b"body")
    assert P.fetch_uri(str(tmp_path / "b")) == P.fetch_uri(f"file://{tmp_path}/b") == b"body"
    with pytest.raises(FileNotFoundError):
        P.fetch_uri(str(tmp_path / "gone"))


# verifiers


def test_verifier_is_asked_once_and_its_errors_are_counted(spark, tmp_path):
    log = tmp_path / "asked"

    def load():
        def call(asked):
            with open(log, "a") as f:
                f.writelines(f"{q['sha']}:{q['kind']}:{q['subject']}\n" for q in asked)
            if any(q["subject"] == "posture" for q in asked):
                raise RuntimeError("no")
            return ["red" if q["subject"] == "dress" else None for q in asked]

        return call

    rows = [(1, "h1", "red_dress, standing", "a blue dress, sitting"), (2, "h1", "red_dress, standing", "a blue dress, sitting"), (3, "h2", "red_hat", "a blue hat"), (4, "h3", "smile", "fine"), (5, "h4", None, None)]
    df = spark.createDataFrame(rows, "id int, sha string, tags string, prose string")
    got = {r["id"]: r for r in Q.reconcile_asked(df, "id", load, same=("sha",)).collect()}
    assert got[1]["prose"] == got[2]["prose"] == "a red dress, sitting" and got[1]["verify_errors"] == 1
    assert got[3]["prose"] == "a blue hat" and got[3]["verify_errors"] == 0 and got[4]["prose"] == "fine" and got[5]["verify_errors"] == 0
    asked = log.read_text().split()
    assert asked.count("h1:color:dress") <= 2 and set(asked) == {"h1:color:dress", "h1:pose:posture", "h2:color:hat"}


def test_pace_and_bad_batches():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = Q.Pace(10, lambda: now[0], sleep)
    for n in (5, 5, 1):
        pace.wait(n)
    assert slept == [0.5, 0.5]
    assert Q.said(lambda a: [None], [{}, {}]) == [(None, None)] * 2  # too few answers: asked one by one
    assert Q.said(lambda a: ["x", ValueError("v")], [{}, {}]) == [("x", None), (None, "ValueError: v")]


# write-back


def test_write_back_in_order_and_once(spark, tmp_path):
    log = tmp_path / "sent"

    def step(name):
        def send(i, text, words):
            if name == "tags" and i == "2" and not (tmp_path / "mended").exists():
                raise PermissionError("403")
            with open(log, "a") as f:
                f.write(f"{i}:{name}\n")

        return send

    rows = spark.createDataFrame([("1", "d", "a, b"), ("2", "d", "a"), ("3", "", "a"), ("4", "d", None), ("5", None, "")], "id string, final_caption string, raw_tags string").repartition(1)
    steps = {n: step(n) for n in X.STEPS}
    first = {r["id"]: (r["steps_done"], r["error"]) for r in X.write_back_steps(rows, steps, str(tmp_path / "ledger"), 7).collect()}
    assert first == {"1": (["description", "tags", "assign"], None), "2": (["description"], "tags: PermissionError: 403"), "3": (["tags", "assign"], None), "4": (["description"], None), "5": ([], None)}
    (tmp_path / "mended").write_text("")
    again = X.write_back_steps(rows, steps, str(tmp_path / "ledger"), 7).collect()
    assert [r["id"] for r in again] == ["2"] and again[0]["error"] is None
    sent = log.read_text().split()
    assert len(sent) == len(set(sent)) + 1 and sent.count("2:description") == 2  # only the row that failed is sent again
    assert X.write_back_steps(rows, steps, str(tmp_path / "ledger"), 7).count() == 0
    assert X.write_back_steps(rows, steps, str(tmp_path / "ledger"), 8).count() == 5


# progress


def test_progress_survives_a_crash(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "idx long, error string"

    def deliver(k):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("idx"), F.when(F.col("id") % 4 == 0, "bad").alias("error")).coalesce(1).write.mode("append").parquet(f"{inbox}/{k}")

    def run(after=None):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(inbox)
        G.follow(stream, lambda df: df, out, state, total=30, after_batch=after).awaitTermination()

    def crash(batch_id):
        if batch_id == 1:
            raise RuntimeError("crash")

    deliver(0), deliver(1)
    with pytest.raises(Exception, match="crash"):
        run(crash)
    deliver(2)
    run()
    got = [(r["done"], r["idx"], r["total"], r["type"]) for r in G.events(spark, out).orderBy("done").collect()]
    assert got == [(i + 1, i, 30, "progress") for i in range(30)]
    assert tuple(G.completion(spark, out).first()) == ("complete", 30, 22, 8, 0)
    assert tuple(G.completion(spark, str(tmp_path / "none")).first()) == ("complete", 0, 0, 0, 0)


# images


def test_png_filters_against_the_definition():
    rng = np.random.default_rng(3)
    for step in (1, 3, 4):
        height, width = 11, 5 * step
        plain = rng.integers(0, 256, (height, width), dtype=np.uint8)
        kinds, rows = rng.integers(0, 5, height), np.zeros_like(plain)
        for y in range(height):
            for x in range(width):
                a = int(plain[y, x - step]) if x >= step else 0
                b = int(plain[y - 1, x]) if y else 0
                c = int(plain[y - 1, x - step]) if y and x >= step else 0
                p = a + b - c
                paeth = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
                rows[y, x] = (int(plain[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
        assert np.array_equal(I.unfiltered(rows, kinds, step), plain)


def png(width, height, colour, rows, extra=b"", depth=8):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return I.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_containers():
    good = I.encode_png(np.arange(24, dtype=np.uint8).reshape(2, 4, 3))
    assert I.parsed(good)[:4] == ("png", None, 4, 2) and np.array_equal(I.parsed(good).pixels.ravel(), np.arange(24))
    for cut in range(8, len(good)):
        assert I.parsed(good[:cut]).error
    for at in range(len(I.PNG), len(good)):
        assert I.parsed(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]).error
    grey = png(2, 1, 0, b"\0\x05\x07")
    assert I.parsed(grey).pixels.tolist() == [[[5, 5, 5], [7, 7, 7]]]
    assert I.parsed(png(2, 1, 6, b"\0" + bytes(range(8)))).pixels.tolist() == [[[0, 1, 2], [4, 5, 6]]]
    plte = struct.pack(">I", 6) + b"PLTE" + bytes(range(6)) + struct.pack(">I", zlib.crc32(b"PLTE" + bytes(range(6))))
    assert I.parsed(png(2, 1, 3, b"\0\1\0", plte)).pixels.tolist() == [[[3, 4, 5], [0, 1, 2]]]
    assert I.parsed(png(2, 1, 3, b"\0\1\2", plte)).error == "bad palette"
    assert I.parsed(png(2, 2, 0, b"\0\5")).error.startswith("bad image data") and I.parsed(png(0, 1, 0, b"\0")).error == "no size"
    assert I.parsed(png(2, 1, 0, b"\0\1\2\3\4", depth=16))[:4] == ("png", None, 2, 1)
    segment = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    jpeg = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\1\1\x11\0") + segment(0xDA, b"\1\1\0\0?\0") + b"data"
    assert I.parsed(jpeg + b"\xff\xd9")[:4] == ("jpeg", None, 40, 30) and I.parsed(jpeg).error == "truncated"
    assert I.parsed(None).error == "empty" and I.parsed(b"hello").error == "not an image" and I.parsed(b"BMxx").error == "truncated"


def test_uploads(spark):
    good = I.encode_png(np.full((1, 2, 3), 9, np.uint8))
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:-1])), ("c", None), ("d", bytearray(b"x"))], "name string, content binary")
    rows = I.valid_images(df).collect()
    assert [(r["name"], r["width"], r["height"], r["mean_rgb"]) for r in rows] == [("a", 2, 1, [9.0, 9.0, 9.0])]


def test_sources_of_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "k int, source binary")
    a, b = I.load_images(df).orderBy("k").collect()
    assert bytes(a["content"]) == b"abc" and a["name"] is None and a["load_error"] is None
    assert b["content"] is None and b["load_error"].startswith("ValueError")
    paths = spark.createDataFrame([("/no/dir/",), ("/no/x.png?size=3",)], "source string")
    assert sorted(r["name"] for r in I.load_images(paths).collect()) == ["image", "x.png"]
