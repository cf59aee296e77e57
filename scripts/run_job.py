"""Run one batch job over a folder of tables, for spark-submit.

  spark-submit scripts/run_job.py nodes --tables T [--step 1.0]
  spark-submit scripts/run_job.py ingest|backfill|all --tables T --weather W --air A [--as-of 2026-01-01T00:00]
  spark-submit scripts/run_job.py forecast --tables T --weather W --air A
  spark-submit scripts/run_job.py proxy|train|refresh|skill|prune --tables T
  spark-submit scripts/run_job.py export --tables T --out O
"""

import argparse
import os
import sys
from datetime import datetime, timedelta, timezone

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from vayuspark.plans import batch  # noqa: E402
from vayuspark.plans.ingest import hours_from_payloads  # noqa: E402
from vayuspark.plans.proxy import load_proxy  # noqa: E402
from vayuspark.plans.training import Settings  # noqa: E402
from vayuspark.session import prepare  # noqa: E402
from vayuspark.sources.readers import read_payloads  # noqa: E402
from vayuspark.vocab import AIR_NAMES, FORECAST_DAYS, RAW_DAYS, WEATHER_NAMES  # noqa: E402


JOBS = ["nodes", "ingest", "backfill", "proxy", "train", "forecast", "refresh", "skill", "prune", "export", "all"]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("job", choices=JOBS)
    ap.add_argument("--tables", required=True)
    ap.add_argument("--weather")
    ap.add_argument("--air")
    ap.add_argument("--out")
    ap.add_argument("--as-of", type=datetime.fromisoformat)
    ap.add_argument("--lookback-days", type=int, default=batch.LOOKBACK_DAYS)
    ap.add_argument("--raw-days", type=int, default=RAW_DAYS)
    ap.add_argument("--forecast-days", type=int, default=FORECAST_DAYS)
    ap.add_argument("--step", type=float, default=1.0, help="degrees between grid nodes")
    ap.add_argument("--version", help="of a training run")
    ap.add_argument("--val-days", type=int, default=21)
    ap.add_argument("--test-days", type=int, default=35)
    ap.add_argument("--stride", type=int, default=1)
    args = ap.parse_args()
    now = args.as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    spark = prepare(SparkSession.builder.appName(f"vayuspark {args.job}").getOrCreate())
    tables = batch.Tables(spark, args.tables)
    payloads = lambda: (read_payloads(spark, args.weather, WEATHER_NAMES), read_payloads(spark, args.air, AIR_NAMES))
    if args.job == "nodes":
        batch.nodes_job(tables, now, args.step)
    elif args.job == "ingest":
        batch.ingest_job(tables, *payloads(), now, load_proxy(spark, tables.path("proxy_models")))
    elif args.job == "backfill":
        batch.backfill_job(tables, *payloads(), now)
    elif args.job == "proxy":
        batch.proxy_job(tables).show()
    elif args.job == "train":
        settings = Settings(val_days=args.val_days, test_days=args.test_days, stride=args.stride)
        batch.train_job(tables, now, settings, args.version).show()
    elif args.job == "forecast":
        batch.champion_forecast_job(tables, hours_from_payloads(*payloads()), now)
    elif args.job == "all":
        batch.all_job(tables, *payloads(), now)
    elif args.job == "refresh":
        batch.refresh_job(tables, now, now - timedelta(days=args.lookback_days))
    elif args.job == "skill":
        batch.skill_job(tables, now)
    elif args.job == "prune":
        batch.prune_job(tables, now, args.raw_days, args.forecast_days)
    else:
        batch.export_job(tables, now, args.out)


if __name__ == "__main__":
    main()
