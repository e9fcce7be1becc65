"""Which nodes get a label at each zoom: a top-k whose k depends on the zoom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Zooms where some and where all types get labels, the weight from which a
# type is one of the some, the weight of other types, the radius on the screen, and how
# many labels there are at a zoom of 1 and at most.
BANDS, SOME, REST, RADIUS, PER_ZOOM, MOST = (0.55, 0.85), 3, 1, 6.0, 40, 160
PRIORITY = {"decision": 5, "adr": 4, "workspace": 4, "repo": 4, "person": 3, "file": 3, "class": 3, "folder": 2, "document": 2}


def labels_by_zoom(nodes: DataFrame, zooms: list[float], chosen: list[str] | None = None) -> DataFrame:
    """(zoom, place, id, label, score) of the labels at each of the zooms, in their order:
    chosen nodes (hovered, selected) first, by id and with a null score, then by type,
    degree and zoom, equal scores by id. nodes have id, label, type, degree and radius; below the
    first band nothing is labelled, a null degree or radius is 0.

    A node that may be labelled at a zoom may be at every greater one, but for its type
    below the second band. So nodes fall into classes, by the first zoom that shows them
    and by whether they are of the some types; the best ``MOST`` of a class are found
    once (each task keeps no more), and zooms choose from these few."""
    levels = sorted({float(z) for z in zooms if z >= BANDS[0]})
    spark = nodes.sparkSession
    schema = "zoom double, budget int, all_types boolean, level int"
    table = spark.createDataFrame([(z, min(MOST, int(PER_ZOOM * z + 0.5)), z >= BANDS[1], k) for k, z in enumerate(levels)], schema)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("type")), F.lit(REST))
    rows = nodes.select("id", "label", weight.alias("weight"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("radius", F.lit(0.0)).cast("double").alias("radius"))
    first = F.lit(None).cast("int")
    for k in range(len(levels) - 1, -1, -1):
        first = F.when(F.col("radius") * levels[k] >= RADIUS, F.lit(k)).otherwise(first)
    picked = F.col("id").isin(chosen or [])
    rows = rows.withColumns({"picked": picked, "first": F.when(picked, 0).otherwise(first), "some": picked | (F.col("weight") >= SOME), "base": F.col("weight") * (1 + F.col("degree") / 10)})
    best = Window.partitionBy("first", "some", "picked").orderBy(F.desc("base"), "id")
    few = rows.filter("first IS NOT NULL").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= MOST)
    # a row for each zoom on one side, MOST for each class on the other
    shown = few.join(F.broadcast(table), (F.col("first") <= F.col("level")) & (F.col("some") | F.col("all_types")))
    place = F.row_number().over(Window.partitionBy("zoom").orderBy(F.desc("picked"), F.desc(F.when(~F.col("picked"), F.col("base"))), "id"))
    score = F.when(~F.col("picked"), F.round(F.col("base") * (0.5 + F.col("zoom")), 6))
    return shown.withColumn("place", place).filter(F.col("place") <= F.col("budget")).select("zoom", "place", "id", "label", score.alias("score"))
