"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from balancier.operators import dashboard as B  # noqa: E402
from balancier.operators import datamart as D  # noqa: E402
from balancier.operators import metrics as M  # noqa: E402
from balancier.operators import quality as Q  # noqa: E402
from balancier.operators import scenario as X  # noqa: E402
from balancier.plans import catalog as K  # noqa: E402
from balancier.session import build_session, work_folder, written  # noqa: E402
from checks import corpus, star  # noqa: E402
from checks.staging import VIEWS, staging  # noqa: E402
from checks.tables import DATAMART_SQL, datamart  # noqa: E402
from checks.workload import METRICS50, RATIOS28, SHOCKS2  # noqa: E402

DATE = "1998-03-01"


def scenario(spark, sf, at):
    out = X.balance_scenario(PREPARED["star"], METRICS50, RATIOS28, SHOCKS2, at)
    return out.metrics.select("code", "delta").unionByName(out.ratios.select("code", "delta"))


def fill(spark, sf):
    ratios = {code: (i, tree) for i, (code, tree) in enumerate(RATIOS28.items())}
    return B.fill(PREPARED["star"], ratios, METRICS50).rows


PREPARED = {}


def prepare(spark, sf):
    """Raw staging tables and the star, stored as they would be; not timed."""
    folder = work_folder(spark)
    for name in VIEWS:
        PREPARED[name] = written(staging(spark, sf, name), f"{folder}/{name}")
    views = datamart(spark, sf)
    stored = {n: views[n] for n in (*DATAMART_SQL, "sub_dim_date") if n != "fact_balance"}
    PREPARED["star"] = {n: written(df, f"{folder}/star/{n}") for n, df in stored.items()}
    path = f"{folder}/star/fact_balance"  # stored by date, as the library's own load does
    views["fact_balance"].hint("rebalance", "id_date").write.partitionBy("id_date").parquet(path)
    PREPARED["star"]["fact_balance"] = spark.read.parquet(path)


def clean(spark, sf):
    PREPARED["clean"] = D.clean_staging(*[PREPARED[n] for n in VIEWS], work_folder(spark))
    return Q.one_row(*[df.agg(F.count(F.lit(1)).alias(n)) for n, df in zip(VIEWS, PREPARED["clean"])])


def load(spark, sf):
    PREPARED["root"] = f"{work_folder(spark)}/mart"  # an empty one for every run
    return reload(spark, sf)


def reload(spark, sf):
    return D.table_counts(D.load_datamart(spark, *PREPARED["clean"], PREPARED["root"]))


QUERIES = {
    "flagship_top10": star.metric_filtered_diff_topn,
    "metrics50_one_date": lambda s, d: M.metrics_at(PREPARED["star"], METRICS50, DATE),
    "metrics50_all_dates": lambda s, d: M.metrics_by_date(PREPARED["star"], METRICS50),
    "scenario50_one_date": lambda s, d: scenario(s, d, DATE),
    "scenario50_all_rows": lambda s, d: scenario(s, d, None),
    "dashboard_fill28": fill,
    "star_wide57": lambda s, d: K.star(PREPARED["star"]),
    "filter_ops": star.filter_ops_matrix,
    "dq_counters": lambda s, d: Q.counters(PREPARED["stg_compta"], Q.LEDGER),
    "dq_deletions": lambda s, d: Q.deletion_counts(PREPARED["stg_contrat"], Q.CONTRACTS),
    "clean_staging": clean,
    "datamart_load": load,
    "datamart_reload": reload,
    "entities": corpus.entities_long,
    "tokens_top": corpus.tokens_top,
    "chunks": corpus.chunks,
    "retrieve_dense": corpus.retrieve_dense,
    "retrieve_fused": corpus.retrieve_fused,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()  # start the engine
    prepare(spark, sf_dir)
    times, cold = {}, {}
    for name in sys.argv[1:] or QUERIES:
        for took in (cold, times):  # the first run also generates and compiles its code
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
