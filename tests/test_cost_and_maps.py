import os

import pytest

from tilewright.functions import cost
from tilewright.operators import distribution
from tilewright.plans import planner
from tilewright.plans.matrix import Matrix
from tilewright.plans.settings import Settings


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_formulas(spark):
    assert value(spark, cost.flops_gemm(2, 3, 4)) == 48
    assert value(spark, cost.flops_gemm(2, 3, 4, "z")) == 192
    assert value(spark, cost.flops_trsm("L", 3, 2)) == 24
    assert value(spark, cost.flops_trmm("R", 2, 3)) == 18
    assert value(spark, cost.bytes_gemm(2, 3, 4, "z")) == 16 * (6 + 8 + 12)
    assert value(spark, cost.intensity(cost.flops_gemm(0, 0, 0), cost.bytes_gemm(0, 0, 0))) is None
    assert value(spark, cost.is_offloaded(cost.flops_gemm(1, 1, 1), cost.bytes_gemm(1, 1, 1))) is False
    assert abs(value(spark, cost.flops_getrf(3, 2)) - (3 * 4 / 2 - 8 / 6 - 2 + 3 + 4 / 3 + 6 - 8 / 6 - 3 + 1 / 3)) < 1e-9


@pytest.mark.parametrize(
    "kernel,m,n,g,expected",
    [("GEMM", 16384, 10, 8, 2048), ("GEMM", 100, 100, 8, 512), ("GEMM", 40000, 1, 1, 20032), ("SYRK", 16384, 1, 8, 2048), ("SYMM", 8192, 1, 8, 2048),
     ("TRSM", 16384, 1, 8, 2048), ("TRSM", 40000, 1, 4, 5056), ("SYR2K", 16384, 1, 8, 1024), ("SWAP", 100, 1, 1, 1024), ("gemm", 8, 8, 0, None)],
)
def test_tile_sizes(spark, kernel, m, n, g, expected):
    assert value(spark, cost.auto_tile(kernel, m, n, g)) == expected
    assert value(spark, cost.auto_tile(kernel, m, n, g, user=77)) == 77


def test_grid():
    assert [distribution.auto_grid(g) for g in (1, 2, 3, 4, 6, 7, 8, 9, 12)] == [(1, 1), (2, 1), (1, 3), (2, 2), (3, 2), (1, 7), (2, 4), (3, 3), (4, 3)]
    with pytest.raises(ValueError):
        distribution.auto_grid(0)


def test_assign_keeps_unless_forced(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(0, 0, 5), (0, 1, None)], "ti long, tj long, pid int")
    keep = {r.tj: r.pid for r in distribution.assign(t, F.lit(1), force=False).collect()}
    assert keep == {0: 5, 1: 1}
    assert {r.pid for r in distribution.assign(t, F.lit(1)).collect()} == {1}


def test_load_affinity_graph(spark):
    q = spark.createDataFrame([(0, 0.0), (1, 4.0), (2, 4.0)], "device int, load double")
    s = distribution.load_statistics(q).first()
    assert (s.min_load, s.max_load, s.n_idle, s.busiest) == (0.0, 4.0, 1, [1, 2])
    assert abs(s.deviation - 16 / 3) < 1e-9
    r = spark.createDataFrame([(9, 0, 1, 10, False), (9, 1, 1, 8, True)], "task long, device int, kind int, bytes long, readwrite boolean")
    d = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "device int, kind int")
    assert tuple(distribution.affinity(r, d).first()) == (9, 1, 16, 10, 0)
    odd = spark.createDataFrame([(9, 7, None, 10, False), (9, 8, None, 3, False), (4, 2, 0, 5, False)], "task long, device int, kind int, bytes long, readwrite boolean")
    assert sorted(tuple(x) for x in distribution.affinity(odd, d).collect()) == [(4, 2, 5, 0, 0), (9, 0, 0, 0, 13)]
    g = distribution.task_graph(spark, "gemm", 2, 1, 2)
    assert sorted(x.line for x in distribution.to_dot(g).collect()) == ['"gemm_0_0_0" -> "gemm_0_0_1";', '"gemm_1_0_0" -> "gemm_1_0_1";']


def test_planner(spark):
    own = Settings.from_environment({"TILEWRIGHT_THRESHOLD": "50", "TILEWRIGHT_THRESHOLD_SYRK": "2"})
    assert planner.offload("gemm", 1e6, 10.0, own) == "distributed" and planner.offload("gemm", 100.0, 10.0, own) == "local"
    assert planner.offload("syrk", 100.0, 10.0, own) == "distributed"
    dense = Matrix(spark.range(4096).selectExpr("id div 64 as i", "id % 64 as j", "1.0D as v"), 64, 64)
    assert planner.product_method("gemm", "auto", dense, dense, own) == "coo" and planner.product_method("syrk", "auto", dense, dense, own) == "tile"
    thin = dense.with_df(dense.df.where("i = j"))
    assert planner.product_method("syrk", "auto", thin, thin, own) == "coo"
    assert planner.gemm_is_noop(0, 1, 1, 1, 2) and planner.gemm_is_noop(2, 2, 0, 1, 1) and not planner.gemm_is_noop(2, 2, 0, 1, 2)
    with pytest.raises(ValueError):
        planner.product_method("gemm", "best", None, None)


def test_storage_reads_the_session(spark, monkeypatch):
    from tilewright.plans import storage

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert storage.shared_dir(spark) == named.rstrip("/")
    monkeypatch.setattr(storage, "_KEY", "tilewright.no.such.setting")
    own = storage.shared_dir(spark)
    assert own.startswith("file://") and own == storage.shared_dir(spark)
    made = storage.materialize(spark.range(3), "t")
    assert made.count() == 3
    storage.discard(made)
    assert not os.path.exists(made._tilewright_path.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace as Box

    from tilewright.plans import storage

    def session(master):
        context = Box(master=master, applicationId="app", getConf=lambda: Box(get=lambda k: None))
        return Box(conf=Box(get=lambda k, d=None: None), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(session(master))
    assert storage.shared_dir(session("local[4]")).startswith("file://")


def test_package_is_sent_once(spark, monkeypatch):
    from tilewright.plans import ship

    sent = []
    monkeypatch.setattr(ship, "_sent", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    monkeypatch.setenv("PYTHONPATH", "")
    ship.ship(spark)
    ship.ship(spark)
    assert len(sent) == 1 and sent[0].endswith("tilewright.zip")
