"""What passes the driver: results and broadcasts do not grow with the rows of a search."""

import numpy as np

from quillpool.plans import genetic


def sent_mb(spark, run) -> float:
    """MB that the tasks of run() send to the driver."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).resultSize() for i in range(found.size())}

    before = stages()
    run()
    return sum(v for k, v in stages().items() if k not in before) / 1e6


def test_search_sends_no_rows_to_the_driver(spark, tmp_path):
    """Spark takes all of these tables to be small enough to broadcast, which at their real sizes they are here."""
    words = np.random.default_rng(1).integers(0, 3000, (20_000, 8))
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, " ".join(f"w{x}" for x in w), "xyz"[w[0] % 3]) for i, w in enumerate(words.tolist())], "row_id long, text string, label string").write.parquet(path)
    rows = spark.read.parquet(path)
    search = genetic.GeneticOptimizer(size=6, population=2, generations=2, mutation_rate=1.0)
    assert sent_mb(spark, lambda: search.run(rows)) < 1.5
    assert len(search.log) == 4 and all(0 < acc < 1 for _, _, acc, _ in search.log)
