"""Reading region files, the store, the binary layout and the command line."""

import gzip
import random

import pytest

from spanloom import cli
from spanloom.operators import overlap
from spanloom.plans import strategy
from spanloom.sources import bed, sinks, tilefile
from spanloom.sources.store import IntervalStore

A = "chr1\t100\t200\tx\t5\nchr1\t100\t200\tx\t5\nchr1\t16380\t16390\nchr1\t16384\t16400\tx\t10\textra\n"
B = "chr1\t10\t70000\tx\t900\r\nchr2\t40000\t40010\tx\t1\r\nchr1\t300\t300\tx\t1\r\nshort\tline\r\n"
C = "chr3\t5\t9\tx\t-3\nscaf\t1\t2\tx\tjunk\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a 1.bed").write_text(A)
    with gzip.open(tmp_path / "in/b.bed.gz", "wt", newline="") as f:
        f.write(B)
    (tmp_path / "in/c.bed").write_text(C)
    (tmp_path / "in/d.bed").write_text("")
    return tmp_path


def test_folder(spark, folder):
    rows, names = bed.read_folder(spark, f"{folder}/in/*")
    assert [(r.ds_idx, r.file) for r in names.orderBy("ds_idx").collect()] == [(0, "a 1.bed"), (1, "b.bed.gz"), (2, "c.bed"), (3, "d.bed")]
    assert sorted(tuple(r) for r in rows.where("ds_idx = 0").collect()) == [("chr1", 100, 200, 5, 0), ("chr1", 100, 200, 5, 0), ("chr1", 16380, 16390, 0, 0), ("chr1", 16384, 16400, 10, 0)]
    assert rows.where("ds_idx = 1").count() == 3 and rows.where("contig = 'scaf' AND value = 0").count() == 1
    assert "value" not in bed.read_folder(spark, f"{folder}/in", with_value=False)[0].columns
    (folder / "folders.txt").write_text(f"{folder}/in\n")
    assert bed.read_folder_list(spark, f"{folder}/folders.txt")[0].count() == rows.count()


def test_list(spark, folder):
    (folder / "bad.bed").write_text("nochr\t1\t2\n")
    (folder / "l.txt").write_text(f"{folder}/in/c.bed\n{folder}/missing\n{folder}/bad.bed\n{folder}/in/a 1.bed\n{folder}/in/d.bed\n")
    rows, names = bed.read_list(spark, f"{folder}/l.txt")
    assert [(r.ds_idx, r.file) for r in names.orderBy("ds_idx").collect()] == [(0, "c.bed"), (1, "a 1.bed")]
    assert rows.where("ds_idx = 0").count() == 1 and rows.where("ds_idx = 1").count() == 4
    assert bed.read_list(spark, f"{folder}/l.txt", validate=False)[1].count() == 4


def test_named(spark, tmp_path):
    (tmp_path / "n.bed").write_text("chr1\t1\t5\tzeta\t7\nchr1\t2\t6\talpha\nchr2\t1\t3\tzeta\t1\nchr2\t1\t3\n")
    rows, names = bed.read_named(spark, f"{tmp_path}/n.bed")
    assert [(r.ds_idx, r.file) for r in names.orderBy("ds_idx").collect()] == [(0, "zeta"), (1, "alpha")]
    assert sorted(tuple(r) for r in rows.collect()) == [("chr1", 1, 5, 7, 0), ("chr1", 2, 6, 0, 1), ("chr2", 1, 3, 1, 0)]


def test_store(spark, folder):
    rows, names = bed.read_folder(spark, f"{folder}/in/*")
    IntervalStore.create(spark, f"{folder}/store", rows, names)
    s = IntervalStore.open(spark, f"{folder}/store")
    with pytest.raises(Exception, match="(?i)exist"):
        IntervalStore.create(spark, f"{folder}/store", rows, names)
    assert (s.bin_size, s.has_value, s.n_contigs, s.n_datasets) == (16384, True, 4, 4)
    assert (s.contig_id("chr1"), s.contig_id("none")) == (0, -1)
    assert s.bin_len(1, 1) == 4 and s.bin_len(1, 99) is None and s.bin_len(9, 1) is None and s.bin_len(2, 1) == 0
    assert [tuple(r) for r in s.bin_data(1, 2).collect()] == [(1, 10, 70000), (0, 16380, 16390), (0, 16384, 16400)]
    info = {r.ds_idx: r for r in s.datasets.collect()}
    assert (info[1].n_regions, info[1].n_stored, info[3].n_regions, info[3].avg_size) == (3, 2, 0, None)
    (folder / "q.bed").write_text("chr1\t150\t160\nnochr\t1\t2\nchr2\t1\t50000\n")
    q = bed.read_queries(spark, f"{folder}/q.bed")
    assert q.count() == 2 and bed.read_queries(spark, f"{folder}/q.bed", strict=False).count() == 3 and bed.read_regions_csv(spark, f"{folder}/q.bed").count() == 3
    assert {r.ds_idx: r.n_hits for r in s.count_hits(q).collect()} == {0: 2, 1: 2, 2: 0, 3: 0}
    assert {r.ds_idx: r.n_hits for r in s.search("chr1", 150, 160, 6).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    once = s.hit_vector(q)
    assert once.tolist() == [2, 2, 0, 0] and s.hit_vector(q, once).tolist() == [4, 4, 0, 0] and s.hit_vector(q, min_value=6).sum() == 1
    assert s.full_hits(q).count() == 4 and s.region("chr1", 0, 50).count() == 1
    assert {r.ds_idx: round(r.similarity, 4) > 0 for r in s.similarity(q).collect()} == {0: True, 1: True, 2: False, 3: False}
    sinks.index_tsv(s.datasets, f"{folder}/index")
    assert sinks.read_index_tsv(spark, f"{folder}/index").count() == 4


def test_ids_with_gaps(spark, tmp_path):
    """Datasets whose ids leave numbers out, and a region of a dataset that the catalogue doesn't have."""
    regions = spark.createDataFrame([("chr1", 10, 20, 5, 7), ("chr1", 15, 30, 5, 1_000_003), ("chr1", 90, 95, 5, 2), ("chr1", 12, 14, 5, 8), ("chr1", 12, 14, 5, None)], "contig string, start long, end long, value int, ds_idx int")
    s = IntervalStore.create(spark, f"{tmp_path}/s", regions, spark.createDataFrame([(7, "b"), (1_000_003, "c"), (2, "a"), (None, "d")], "ds_idx int, file string"))
    q = spark.createDataFrame([(1, "chr1", 13, 18), (2, "chr1", 13, 14)], "q_id long, contig string, start long, end long")
    assert s.dataset_ids == [2, 7, 1_000_003, None]
    once = s.hit_vector(q)
    assert once.tolist() == [0, 2, 1, 0] and s.hit_vector(q, once).tolist() == [0, 4, 2, 0]


def test_matrix_of_ids_with_gaps(spark, monkeypatch):
    """Lines of the matrix are made by tasks, a few at a time, whatever the ids; cells of unknown datasets have no place."""
    cells = [(2, 2, 4), (2, 900_000, 1), (900_000, 2, 1), (900_000, 900_000, 30), (8, 2, 5), (2, 8, 5), (None, None, 3)]
    matrix = spark.createDataFrame(cells, "ds_a int, ds_b int, n long")
    want = ["4\t4\t6", "4\t0\t1\t0\t", "0\t0\t0\t0\t", "1\t0\t30\t0\t", "0\t0\t0\t0\t"]
    ids = [2, 7, 900_000, None]
    assert list(sinks.matrix_lines(matrix, ids, 6)) == want
    for size in (1, 1 << 22):
        monkeypatch.setattr(sinks, "PART", size)
        assert sorted(map(tuple, sinks.matrix_table(matrix, ids, 6).collect())) == list(enumerate(want))
    assert list(sinks.matrix_lines(matrix, [], 0)) == ["0\t0\t0"] == [r.line for r in sinks.matrix_table(matrix, [], 0).collect()]


def test_many_files(spark, folder, monkeypatch):
    """More files than are broadcast at once, and no shuffle of lines by file or name."""
    whole = sorted(map(tuple, bed.read_folder(spark, f"{folder}/in/*")[0].collect()))
    monkeypatch.setattr(bed, "CATALOGUE", 1)
    rows, _ = bed.read_folder(spark, f"{folder}/in/*")
    assert sorted(map(tuple, rows.collect())) == whole and strategy.exchanges(rows) == 0
    (folder / "n.bed").write_text("".join(f"chr1\t{i}\t{i + 5}\tname{i % 3}\t7\n" for i in range(50)))
    rows, _ = bed.read_named(spark, f"{folder}/n.bed")
    assert rows.count() == 50 and strategy.exchanges(rows) == 0


def test_carriage_returns(spark, tmp_path):
    (tmp_path / "r.bed").write_bytes(b"chr1\t1\t2\tn\t3\r\nchr1\t4\t5\ta\rb\t6\nchr1\t7\t8\r\n")
    rows, _ = bed.read_folder(spark, f"{tmp_path}/r.bed")
    assert sorted(map(tuple, rows.collect())) == [("chr1", 1, 2, 3, 0), ("chr1", 4, 5, 6, 0), ("chr1", 7, 8, 0, 0)]


def brute(regions, queries):
    return sorted((q.q_id, r.contig, r.start, r.end, r.ds_idx) for r in regions for q in queries if q.contig == r.contig and r.start < q.end and r.end > q.start)


def far(seed=1):
    r = random.Random(seed)
    regions = [(r.choice(["chr1", "chr2", "chr3"]), s := r.randrange(-50, 2_000_000), s + r.choice([0, 5, 900, 40_000, 900_000]), 1, r.randrange(3)) for _ in range(600)]
    queries = [(i, r.choice(["chr1", "chr2", "none"]), s := r.choice([0, 300_000, 310_000, 1_200_000]) + r.randrange(-30, 3000), s + r.choice([-3, 0, 7, 20_000])) for i in range(40)]
    return regions, queries + [(98, None, 1, 2), (99, "chr1", None, 2)]


@pytest.mark.parametrize("ranges", [1, 2, 3, 64])
def test_pruned_search(spark, tmp_path, monkeypatch, ranges):
    """Searches by query sets read only what lies near the queries, in both layouts, and lose nothing."""
    regions, queries = far()
    rows = spark.createDataFrame(regions, "contig string, start long, end long, value int, ds_idx int")
    q = spark.createDataFrame(queries, "q_id long, contig string, start long, end long")
    names = spark.createDataFrame([(i, f"f{i}") for i in range(3)], "ds_idx int, file string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(overlap, "RANGES", ranges)
    monkeypatch.setattr(overlap.covering_ranges, "__defaults__", (ranges,))
    try:
        s = IntervalStore.create(spark, f"{tmp_path}/store", rows, names)
        f = s.save_file(f"{tmp_path}/tiles.bin")
        want = brute([r for r in rows.collect() if r.start < r.end], [x for x in q.collect() if x.contig and x.start is not None])
        found = overlap.covering_ranges(q)
        assert (found is None) == (ranges < 3) and (found is None or len(found) <= ranges)
        for store in (s, f):
            pairs = store.pairs(q)
            assert sorted((x.q_id, x.contig, x.r_start, x.r_end, x.ds_idx) for x in pairs.collect()) == want
            assert {x.ds_idx: x.n_hits for x in store.count_hits(q).collect()} == {d: sum(x[4] == d for x in want) for d in range(3)}
            for c, lo, hi in (("chr1", 300_000, 301_000), ("chr2", 5, 5), ("none", 1, 2), ("chr1", -100, 10)):
                mine = sorted((r.contig, r.start, r.end, r.ds_idx) for r in store.region(c, lo, hi).collect())
                assert mine == sorted((r.contig, r.start, r.end, r.ds_idx) for r in rows.collect() if r.contig == c and r.start < r.end and r.start < hi and r.end > lo)
            one = {x.ds_idx: x.similarity for x in store.similarity(q.where("start >= 0")).collect()}
            assert all(0 <= v <= 1 for v in one.values()) and sum(one.values()) > 0
        assert s.bin_len(1, 1) == f.bin_len(1, 1) and s.bin_len(1, 60) == f.bin_len(1, 60) > 0 and s.n_contigs == f.n_contigs == 3 and f.n_datasets == 3
        near = q.where("contig = 'chr1' AND start > 1000000")
        pairs = s.pairs(near)
        if ranges > 1:
            assert "EqualTo(contig,chr1)" in strategy.pushed_filters(pairs) and "LessThan(start" in strategy.pushed_filters(pairs)
            few, every = scanned(s.near(near)), scanned(s.intervals)
            assert few < 0.7 * every and scanned(s.near(q)) <= every
            assert sum(1 for _ in tile_parts(f, near)) >= 1 and tile_rows(f, near) < 0.7 * f.intervals.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def scanned(df):
    """Rows that leave the file scan, after row groups have been skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def tile_parts(store, queries):
    r = tilefile._Reader(store.path, False, overlap.covering_ranges(queries))
    return r.partitions()


def tile_rows(store, queries):
    r = tilefile._Reader(store.path, False, overlap.covering_ranges(queries))
    return sum(b.num_rows for p in r.partitions() for b in r.read(p))


def test_names_too_long(spark, tmp_path):
    one = spark.createDataFrame([("chr" + "x" * 36, 1, 5, 0), ("chr" + "y" * 35, 1, 5, 0)], "contig string, start long, end long, ds_idx int")
    tilefile.register(spark)
    tilefile.write(one, f"{tmp_path}/a.bin")
    assert {r.contig for r in spark.read.format("tilefile").load(f"{tmp_path}/a.bin").collect()} == {r.contig for r in one.collect()}
    for name in ("chr" + "x" * 37, "chr" + "ü" * 19):
        with pytest.raises(ValueError):
            tilefile.write(spark.createDataFrame([(name, 1, 5, 0)], one.schema), f"{tmp_path}/b.bin")


def test_hot_tile(spark, tmp_path):
    """One tile with nearly all records is written by several tasks, in order."""
    rows = spark.range(0, 30000, numPartitions=6).selectExpr("'chr1' contig", "id * 7919 % 16000 start", "id * 7919 % 16000 + 1 + id % 9 end", "cast(id % 5 as int) ds_idx")
    tilefile.register(spark)
    tilefile.write(rows, f"{tmp_path}/hot.bin")
    back = spark.read.format("tilefile").load(f"{tmp_path}/hot.bin")
    assert sorted(map(tuple, back.select("start", "end", "ds_idx").collect())) == sorted(map(tuple, rows.select("start", "end", "ds_idx").collect()))
    starts = [r.start for r in back.orderBy("r_id").collect()]
    assert starts == sorted(starts)


def test_binary(spark, folder):
    rows, _ = bed.read_folder(spark, f"{folder}/in/*")
    tilefile.register(spark)
    tilefile.write(rows, f"{folder}/tiles.bin", 4096)
    back = spark.read.format("tilefile").load(f"{folder}/tiles.bin")
    key = ["contig", "start", "end", "value", "ds_idx"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, rows.where("start < end").select(key).collect()))
    copies = spark.read.format("tilefile").option("copies", "true").load(f"{folder}/tiles.bin")
    assert copies.count() == rows.where("start < end").selectExpr("sum((end - 1) div 4096 - start div 4096 + 1)").head()[0]
    h = tilefile.header(f"{folder}/tiles.bin")
    assert h["data"] == 12 + 44 * len(h["contigs"]) + 4 * int(h["tiles"].sum())
    tilefile.write(rows.drop("value"), f"{folder}/plain.bin")
    assert spark.read.format("tilefile").load(f"{folder}/plain.bin").where("value IS NULL").count() == 8


def test_command_line(spark, folder, capsys):
    cli.main(["create", f"{folder}/in/*", str(folder), "db", "-b", "12"])
    assert "Total intervals" in capsys.readouterr().out
    assert IntervalStore.open(spark, f"{folder}/db").bin_size == 4096
    (folder / "q.bed").write_text("chr1\t150\t160\n")
    for flags, want in (
        (["-q", f"{folder}/q.bed"], "Total: 3"),
        (["-q", f"{folder}/q.bed", "-v", "6"], "Total: 1"),
        (["-q", f"{folder}/q.bed", "-f"], "Total overlaps: 3"),
        (["-q", f"{folder}/q.bed", "-s"], "0.0"),
        (["-r", "chr1", "150", "160"], "0\t4\t2\ta 1.bed\n1\t3\t1\tb.bed.gz\n2\t2\t0\tc.bed\n3\t0\t0\td.bed\n"),
        (["-m", "-q", f"{folder}/q.bed"], "Total: 3"),
        (["-s", "-q", f"{folder}/q.bed"], "Total: 3"),
        (["-q", f"{folder}/q.bed", "-r", "chr1", "150", "160", "-s"], "3\t0\t0\td.bed"),
        (["-m", "-f"], "Not supported -f option"),
        (["-q", f"{folder}/q.bed", "-s"], "similarity\t dataset name"),
        (["-q", f"{folder}/q.bed"], "number of hits\t File_name"),
        (["-q", f"{folder}/q.bed", "-f"], "Query chr1, 150, 160: \n0\t 10\t 70000\t b.bed.gz\n1\t 100\t 200\t a 1.bed"),
        (["-r", "chr1", "150", "160", "-f"], "Total overlaps: 3"),
    ):
        cli.main(["search", f"{folder}/db", *flags])
        assert want in capsys.readouterr().out
    cli.main(["search", f"{folder}/db", "-m", "-o", f"{folder}/m"])
    text = (folder / "m").read_text().splitlines()
    assert text[0] == "4\t4\t0" and text[1].split("\t")[:2] == ["8", "4"] and len(text) == 5
    for kind in (["-s", "0"], ["-s", "2"], ["-f"]):
        source = f"{folder}/in/*" if kind[-1] == "0" else f"{folder}/in/a 1.bed" if kind[-1] == "2" else f"{folder}/l.txt"
        (folder / "l.txt").write_text(f"{folder}/in/a 1.bed\n")
        cli.main(["create", source, str(folder), "db" + kind[-1], *kind])
