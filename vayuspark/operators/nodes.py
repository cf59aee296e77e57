"""The node dimension: cities and grid points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vayuspark.functions.geo import grid_label
from vayuspark.operators.spatial import drop_near, hashed
from vayuspark.vocab import BREAKPOINTS, CITIES, INDEX_LEVELS, LABELS, POLLUTANTS, WINDOW_HOURS

NODE_COLUMNS = ["location_hash", "location_name", "state", "lat", "lon", "kind"]


def cities(spark: SparkSession) -> DataFrame:
    rows = [(i, *city) for i, city in enumerate(CITIES)]
    return spark.createDataFrame(rows, "city_order int, location_name string, state string, lat double, lon double")


def breakpoints(spark: SparkSession) -> DataFrame:
    """(pollutant, label, hours, segment, from and to concentration, from and to index)."""
    rows = [
        (p, LABELS[p], WINDOW_HOURS[p], i, *BREAKPOINTS[p][i:i + 2], *INDEX_LEVELS[i:i + 2])
        for p in POLLUTANTS for i in range(len(INDEX_LEVELS) - 1)
    ]
    return spark.createDataFrame(
        rows, "pollutant string, label string, hours int, segment int, c_from double, c_to double, "
        "i_from double, i_to double",
    )


def build_nodes(city_rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Cities and the grid points away from them, one per hash; a city wins over a grid point."""
    named = drop_near(grid, city_rows).withColumns({
        "location_name": grid_label(F.col("lat"), F.col("lon"), F.col("near")), "kind": F.lit("grid"),
        "_rank": F.lit(1), "_order": F.lit(0),
    })
    both = hashed(city_rows.withColumns({"kind": F.lit("city"), "_rank": F.lit(0), "_order": F.col("city_order")})).select(
        *NODE_COLUMNS, "_rank", "_order"
    ).unionByName(hashed(named).select(*NODE_COLUMNS, "_rank", "_order"))
    first = F.min_by(F.struct(*NODE_COLUMNS[1:]), F.struct("_rank", "_order", "lat", "lon"))
    return both.groupBy("location_hash").agg(first.alias("n")).select("location_hash", "n.*")


#: Texts of the nodes whose runs of letters are worked out in one task.
TEXTS_AT_ONCE = 10_000


def _runs(text: Column, lengths: Column) -> Column:
    """The distinct runs of letters of these lengths."""
    n = F.length(text)
    of_length = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def _first(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first rows of each key with their `place`: cities, then by name. Spark applies the limit before the shuffle as well."""
    rank = Window.partitionBy(*keys).orderBy(F.when(F.col("kind") == "city", 0).otherwise(1), "location_name", "location_hash")
    return rows.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= limit)


def text_hits(nodes: DataFrame, wanted: DataFrame, limit: int = 12) -> DataFrame:
    """(query, location_hash) of the first hits of each wanted text: at most `limit` rows each, in any order.

    A text that is part of a name is one of the name's runs of that length, so runs meet texts by equality and nothing has to be
    verified: work grows with the nodes, not with the nodes that share letters with a text. Of nodes with the same name (or state) only
    the first few can count. A node that a name finds is left out under its state.
    """
    # a handful of numbers, which become literals
    lengths = F.array(*[F.lit(r["n"]) for r in wanted.select(F.length("query").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")
    lowered = nodes.where("location_hash is not null").select("location_hash", "location_name", "kind", F.explode(F.array(
        F.struct(F.lower("location_name").alias("text"), F.lit(False).alias("by_state")), F.struct(F.lower("state").alias("text"), F.lit(True).alias("by_state")),
    )).alias("x")).select("location_hash", "location_name", "kind", "x.*").where("text <> ''")
    tasks = nodes.count() // TEXTS_AT_ONCE + 1
    # names side by side share runs, so that more of them stop at the limit before the shuffle
    texts = _first(lowered, ["text", "by_state"], limit).drop("place").repartitionByRange(tasks, "text", "location_hash")
    runs = texts.select("location_hash", "location_name", "kind", "by_state", F.explode(_runs(F.col("text"), lengths)).alias("query"))
    named = F.coalesce(F.lower("location_name").contains(F.col("query")), F.lit(False))
    return _first(runs.where(~(F.col("by_state") & named)).drop("by_state"), ["query"], limit).join(wanted, "query").select("query", "location_hash")


def search_nodes(nodes: DataFrame, texts: list[str] | DataFrame, limit: int = 12) -> DataFrame:
    """The best hits per search text: part of the name or state, cities first, then by name.

    texts: a list, or a table with a column `query`. Each distinct text (trimmed, lower case; empty ones have no hits) meets the runs
    of letters of its length in names and states.
    """
    if not isinstance(texts, DataFrame):
        texts = nodes.sparkSession.createDataFrame([(t,) for t in texts], "query string")
    query = F.lower(F.trim("query")).alias("query")
    wanted = texts.select(query).where("query <> ''").distinct()
    found = text_hits(nodes, wanted, limit).join(nodes, "location_hash")
    name, state = F.lower("location_name"), F.lower(F.coalesce("state", F.lit("")))
    hits = found.where(F.coalesce(name.contains(F.col("query")), F.lit(False)) | state.contains(F.col("query")))
    return _first(hits.select("query", *nodes.columns), ["query"], limit)
