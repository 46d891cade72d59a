"""Queries on tables of a shape that larger inputs have: what must not grow with them, and what must not be lost."""

import os
import pickle

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle

from marlstone.plans import io_queries as Q
from marlstone.sources import files as S
from marlstone.sources import readers as R


def tables(folder, orders=(), pages=()):
    pq.write_table(pa.table({"o_orderkey": pa.array(orders, pa.int64()), "o_custkey": pa.array([k * 7 % 31 for k in orders], pa.int64())}), f"{folder}/orders.parquet")
    items = [(k, n, k + 3 * n) for k in orders for n in range(1, 1 + k % 3)]
    columns = {"l_orderkey": [i[0] for i in items], "l_linenumber": [i[1] for i in items], "l_partkey": [i[2] for i in items], "l_quantity": [float(i[1]) for i in items]}
    pq.write_table(pa.table({n: pa.array(v, pa.float64() if n == "l_quantity" else pa.int32() if n == "l_linenumber" else pa.int64()) for n, v in columns.items()}), f"{folder}/lineitem.parquet")
    pq.write_table(pa.table({"page_id": pa.array(pages, pa.int64())}), f"{folder}/pages.parquet")
    return str(folder)


def test_the_number_of_micro_batches_does_not_grow(spark, tmp_path, monkeypatch):
    d = tables(tmp_path, orders=[p * 4000 + k for p in range(19) for k in (1, 26)])
    seen, record = [], Q.G.record
    monkeypatch.setattr(Q.G, "record", lambda results, batch_id, *rest: (seen.append(batch_id), record(results, batch_id, *rest)))
    rows = Q.stream_progress(spark, d).collect()
    assert sorted((r["done"], r["image_id"]) for r in rows if r["type"] == "progress") == [(i + 1, k) for i, k in enumerate(sorted(p * 4000 + k for p in range(19) for k in (1, 26)))]
    assert len(set(seen)) <= 8 and seen.count(1) == 2  # the batch after which it crashed is recorded again


def test_a_stream_of_pages_misses_no_late_update(spark, tmp_path):
    pages = [1, 7 * 3, 7 * 4000 + 1, 7 * 9000 + 1, 7 * 90000 + 1]
    got = {r["id"]: r["trigger"] for r in Q.listing_stream(spark, tables(tmp_path, pages=pages)).collect()}
    assert got == {"1": 0, "21": 2, "28001": 1, "63001": 2, "630001": 2}


def test_a_worker_reads_the_listing_once(spark, tmp_path):
    fetch = Q._service(spark, tables(tmp_path, pages=list(range(1, 40))))
    sent = cloudpickle.dumps(fetch)
    before = set(Q._services)
    first = pickle.loads(sent)(2, 10, None, "2024-02-01T00:00:00.000Z")
    assert len(set(Q._services) - before) == 1
    (folder,) = set(Q._services) - before
    Q._services[folder] = Q._services[folder][:15]
    assert len(first["items"]) == 10 and first["next_page"] == 3
    again = pickle.loads(sent)(2, 10, None, "2024-02-01T00:00:00.000Z")
    assert len(again["items"]) == 5 and again["next_page"] is None


def test_files_are_written_and_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 200, 1, 1).selectExpr(f"concat('{tmp_path}/out/', id % 3, '/', id, '.PNG') as target", "cast(id as string) as body")
    assert S.write_files(rows).count() == 200
    found = S.contents(S.listed_files(spark, str(tmp_path / "out")))
    assert found.rdd.getNumPartitions() >= 4  # not by bytes: 200 small files were a few tasks, millions tens of thousands
    assert {(r["path"].rsplit("/", 1)[1], r["content"].decode()) for r in found.collect()} == {(f"{i}.PNG", str(i)) for i in range(200)}
    scanned = R.scan_images(spark, str(tmp_path / "out"))
    assert "BinaryFile" not in scanned._jdf.queryExecution().toString()  # sorting would read all contents twice
    assert [r["id"] for r in scanned.limit(2).collect()] == ["0/0.PNG", "0/102.PNG"]
    S.delete_files(found)
    assert S.listed_files(spark, str(tmp_path / "out")).count() == 0


def test_sidecars_come_in_slices_that_leave_no_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "SLICE", 15)
    roots, listed = [], Q.listed_files
    monkeypatch.setattr(Q, "listed_files", lambda spark, root: (roots.append(root), listed(spark, root))[1])
    rows = Q.sidecar_files(spark, tables(tmp_path, orders=list(range(1, 41)))).collect()
    assert sorted((r["image_id"], r["kind"]) for r in rows) == sorted([(k, "txt") for k in range(1, 41)] + [(k, "xmp") for k in range(3, 41, 3)])
    assert len(roots) == 3 and all(listed(spark, root).count() == 0 for root in roots)


def test_a_json_array_is_checked_in_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.read), "json", lambda *a, **k: pytest.fail("one task reads the whole array"))
    d = tables(tmp_path, orders=list(range(1, 41)))
    assert [(r["line"], r["image_id"]) for r in Q.json_array(spark, d).orderBy("line").collect()] == [(k, k) for k in range(1, 41)]
    write = Q.W.json_array

    def broken(rows, folder, order, single):
        write(rows, folder, order, single)
        with open(single) as f:
            text = f.read()
        with open(single, "w") as f:
            f.write(text.replace(',{"image_id":7,', '{"image_id":7,').replace("]", close))

    monkeypatch.setattr(Q.W, "json_array", broken)
    close = ""
    with pytest.raises(ValueError, match="closed"):
        Q.json_array(spark, d)
    close = "]"
    got = {r["line"]: r["image_id"] for r in Q.json_array(spark, d).collect()}
    assert got[7] is None and got[6] == 6


def test_files_of_a_finished_round_are_written_over(spark, tmp_path):
    pool = str(tmp_path / "pool")

    def written(name, n, body, **how):
        rows = spark.range(n).selectExpr(f"concat('{tmp_path}/{name}/', id % 8, '/', id) as target", f"concat('{body}', id) as body")
        assert {r["status"] for r in S.write_files(rows, staging=str(tmp_path / "stage"), spare=pool, **how).collect()} == {"written"}
        found = list((tmp_path / name).glob("*/*"))
        assert {(f.name, f.read_text()) for f in found} == {(str(i), f"{body}{i}") for i in range(n)}
        return {f.stat().st_ino for f in found}

    def spare():
        return {f.stat().st_ino for f in (tmp_path / "pool").glob("*/*")}

    first = written("a", 60, "a long first text ")
    S.spare_folders(S.listed_files(spark, str(tmp_path / "a")), pool)
    assert not list((tmp_path / "a").glob("*/*")) and spare() == first
    second = written("b", 20, "")
    assert second <= first and spare() == first - second  # what wasn't needed is spare again
    third = written("c", 50, "c", failing=0)
    assert not third & second and not list((tmp_path / "stage").glob("*/*"))
    assert not spare() & third


def test_a_second_slice_of_sidecars_makes_no_new_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "SLICE", 100)
    made, listed = [], Q.listed_files

    def seen(spark, root):
        files = listed(spark, root)
        made.append({os.stat(r[0][5:]).st_ino for r in files.collect()})
        return files

    monkeypatch.setattr(Q, "listed_files", seen)
    assert Q.sidecar_files(spark, tables(tmp_path, orders=list(range(1, 301)))).count() == 400
    assert len(made) == 3 and len(made[2] & (made[0] | made[1])) > 100
